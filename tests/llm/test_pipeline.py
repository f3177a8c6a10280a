"""The pipeline stage by stage against the operators' brute-force definitions."""

import re
from collections import defaultdict

import oracle
import pytest

import corpus_pipeline
from padlens.llm import simhash, toxicity
from padlens.llm.queries import QUERIES
from padlens.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    assert all(d.columns == steps[0].columns for d in steps[1:5])


def test_toxic_documents_go(spark, steps):
    bad = {r["doc_id"] for r in toxicity.scores(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids(steps[1]) == [i for i in ids(steps[0]) if i not in bad]


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_of_each_group_stays(steps):
    """Groups by links of five-word Jaccard similarity 0.8 or more, by brute force."""
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in steps[1].collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert ids(steps[2]) == sorted({find(i) for i in sets})


def test_passages_go_and_documents_stay(steps):
    assert ids(steps[3]) == ids(steps[2])
    before, after = ({r["doc_id"]: r["text"] or "" for r in d.collect()} for d in steps[2:4])
    windows = defaultdict(set)
    for i, t in after.items():
        words = t.split()
        for k in range(len(words) - 54):
            windows[" ".join(words[k : k + 55])].add(i)
    assert not [w for w, held in windows.items() if len(held) > 1]
    for i, t in after.items():
        rest = iter(before[i].split())
        assert t == before[i] or len(t) < len(before[i])
        assert all(any(w == x for x in rest) for w in t.split()) or t != before[i]


def test_no_item_is_left(spark, steps):
    words = lambda t: re.findall(r"[a-z0-9_\x80-\U0010ffff]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [grams(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: grams(words(r["text"] or "")) for r in steps[4].collect()}
    dirty = [i for i, g in kept.items() if any(s and len(s & g) >= 0.8 * len(s) for s in items)]
    assert not dirty and set(kept) <= set(ids(steps[3]))


def test_packing_takes_all_that_is_left(spark, steps):
    assert sorted(set(ids(steps[5]))) == ids(steps[4])
    assert corpus_pipeline.run(spark, SF).groupBy("doc_id").count().count() == steps[4].count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) == ""


def test_odd_rows_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, y int, _cuts string"
    rows = [(0, None, "en", "s", None, 1, 2, "k"), (1, "", "en", "s", 0, 1, 2, "k"), (2, "word " * 5000, None, None, 5, 1, 2, "k"), (3, "a small text", "en", "s", 12, 1, 2, "k"), (3, "a small text", "en", "s", 12, 1, 2, "k"), (None, "no id", "en", "s", 5, 1, 2, "k")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        left = sorted(r["doc_id"] for r in docs.collect())
        assert left == ([0, 2, 3] if n else [])
        assert {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()} == set(left)
