"""Each operator on null, empty, long, tied and repeated rows, empty tables and clashing column names."""

import pytest

from padlens.llm import decontaminate, licenses, media, packing, quality, simhash, substring, tokencount, toxicity, urlfilter

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
TEXTS = [None, "", " ", "\n\n", "word", "a b", LONG, LONG, "x" * 50_000, "ünï çödé 中文 😀 \x00 tab\tend", "same text here now", "same text here now", "<|endoftext|> </s>"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, y int, score double, chunks string, component_id long, bucket int, _cuts string, label string"


def documents(spark, texts=TEXTS):
    rows = [(i, t, None, "s", None, 1, 2, 0.5, "c", 9, 3, "k", "l") for i, t in enumerate(texts)]
    rows += rows[3:5] * 2  # repeated rows
    return spark.createDataFrame(rows + [(None, "no id", *rows[0][2:])], SCHEMA)


def labels(spark, n=13):
    return spark.createDataFrame([(i, None if i == 2 else i % 2, i % 3 % 2) for i in range(n)], "doc_id long, quality int, toxic int")


BENCH = [(0, None), (1, ""), (2, "same text here now"), (3, "alpha beta gamma delta epsilon zeta eta theta")]


def runs(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    return {
        "packing": packing.pack,
        "quality": lambda d: quality.scores(d, labels(spark)),
        "toxicity": lambda d: toxicity.scores(d, labels(spark)),
        "licenses": licenses.scan,
        "simhash": simhash.near_duplicates,
        "tokencount": tokencount.count_tokens,
        "decontaminate": lambda d: decontaminate.contained(d, bench),
        "substring": substring.repeated_spans,
        "without_spans": lambda d: substring.without_spans(d, substring.repeated_spans(d)),
        "media": lambda d: media.decode(media.store(d), tensor=False),
        "urls": lambda d: urlfilter.judge(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")),
    }


ONE_EACH = {"quality", "toxicity", "licenses", "tokencount", "without_spans", "media", "urls"}
NAMES = ["packing", "quality", "toxicity", "licenses", "simhash", "tokencount", "decontaminate", "substring", "without_spans", "media", "urls"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_all_kinds(spark, name):
    docs = documents(spark)
    out = runs(spark)[name](docs).collect()
    if name in ONE_EACH:
        assert len(out) == docs.count()
    elif name == "simhash":
        assert len(out) == docs.count() - 1
    elif name == "packing":
        assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert runs(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(spark, name):
    docs, none = documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {"quality": quality, "toxicity": toxicity}[name].scores(docs, none).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)


def test_defined_values(spark):
    docs = documents(spark)
    tokens = {r["doc_id"]: r for r in tokencount.count_tokens(docs).collect()}
    assert tokens[0]["n_tokens"] == tokens[1]["n_tokens"] == 0 and tokens[0]["n_bytes"] == 0
    groups = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {groups[i]["component_id"] for i in (0, 1, 2, 3)} == {0} and groups[0]["fingerprint"] == "0" * 16
    assert groups[10]["component_id"] == groups[11]["component_id"] == 10
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, spark.createDataFrame(BENCH, "item_id long, text string")).collect()}
    assert found == {(10, 2), (11, 2), (6, 3), (7, 3)}
    spans = substring.repeated_spans(docs).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in spans if r["doc_id"] == 7} == {(7, 6)}


def test_one_doc_id_with_several_texts(spark):
    """Each text is judged and cut by itself, and a text cut at another one's offsets would lose what it alone holds."""
    words = lambda name, n: " ".join(f"{name}{i}ü" for i in range(n))
    shared, own, other = words("shared", 60), words("own", 40), words("é", 90)
    rows = [(1, shared), (2, f"{own} {shared}"), (2, other), (2, other), (3, other), (4, words("z", 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = substring.repeated_spans(docs)
    found = {(r["doc_id"], r["first_doc_id"]) for r in spans.collect()}
    assert found == {(2, 1), (3, 2)} and spans.filter("doc_id = 2").count() == 1
    left = sorted((r["doc_id"], r["text"]) for r in substring.without_spans(docs, spans).collect())
    assert [i for i, _ in left] == [1, 2, 2, 2, 3, 4] and left.count((2, other)) == 2 and (1, shared) in left
    cut = next(t for i, t in left if i == 2 and t != other)
    assert cut.startswith(own) and len(cut) < len(own) + 200 and len(left[4][1]) < 100
    scores = {m: sorted(m.scores(docs, labels(spark)).select("doc_id", "score").collect()) for m in (quality, toxicity)}
    assert all(len(s) == 6 for s in scores.values())


def test_no_benchmark(spark):
    assert decontaminate.contained(documents(spark), spark.createDataFrame([], "item_id long, text string")).collect() == []
