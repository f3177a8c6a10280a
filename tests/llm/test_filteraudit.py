"""The filter audit against a row-by-row walk through all orders, on planted rows and on the given table."""

import re
from collections import defaultdict
from itertools import permutations

import oracle
import pytest

from padlens.llm import filteraudit
from padlens.llm.queries import op11_filter_audit
from padlens.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
FINE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, FINE, "en"),
    (2, FINE, "en"),  # E
    (2, FINE, "en"),  # a repeated row
    (3, "short", "en"),  # A
    (4, "short", None),  # A, E
    (5, None, None),  # A
    (6, "", ""),  # A, E
    (7, " ".join(["same words"] * 90), "de"),  # B
    (8, "LOUD # " * 60, "de"),  # B, C, D
    (9, FINE + " 100%", "de"),  # D
    (10, FINE.upper(), "fr"),  # C
    (None, FINE, "fr"),
    (11, " ".join(f"w{i}" for i in range(30_000)), "fr"),
    (12, "é ü\x1c" * 30, "fr"),  # one word: A
]
LABELS = [(1, 1, 0), (2, 1, 0), (3, 1, 1), (3, 0, 0), (4, None, 1), (6, 1, None), (8, 0, 1), (10, 1, 1), (99, 1, 1), (None, 1, 1)]


def walk(rows, labels):
    """Every order, step by step, over the rows themselves."""
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    failing = []
    for d, text, _ in rows:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        tests = len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), bool(re.search("[#$%&*|]", x)), d is not None and first[x] < d
        failing.append({f for f, t in zip("ABCDE", tests) if t})
    out, total = {}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in {p or "" for *_, p in rows}:
            alive = [i for i, r in enumerate(rows) if (r[2] or "") == part]
            every = list(alive)
            for step, f in enumerate(order, 1):
                gone = [i for i in alive if f in failing[i]]
                alive = [i for i in alive if f not in failing[i]]
                fails = [i for i in every if f in failing[i]]
                known = [rows[i][0] for i in gone]
                out[part, order, step] = [len(alive), len(gone), len(fails) - len(gone), sum(failing[i] == {f} for i in fails), sum(d in good for d in known if d), sum(d in toxic for d in known if d)]
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_planted_rows(spark):
    docs = spark.createDataFrame([(*r, "s", 1, 2, 3) for r in ROWS], "doc_id long, text string, lang string, source string, good int, part int, rid int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert result(filteraudit.audit(docs, labels)) == walk(ROWS, LABELS)
    ids, fails = filteraudit.failing_ids(docs, labels)
    assert {f: t.count() for f, t in fails.items()} == {"A": 5, "B": 2, "C": 2, "D": 2, "E": 4}
    for prefix in ("", "A", "EA", "BDC"):
        for f in set("ABCDE") - set(prefix):
            took, kept = filteraudit.removed(ids, fails, prefix, f).count(), filteraudit.redundant(fails, prefix, f).count()
            assert took + kept == fails[f].count() and filteraudit.survivors(ids, fails, prefix).count() - took == filteraudit.survivors(ids, fails, prefix + f).count()


def test_given_table_and_sql(spark):
    got = op11_filter_audit(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert result(got) == walk(rows, labels)
    assert oracle.differences(got, oracle.connect(SF), ORACLES["op11_filter_audit"]) == ""


@pytest.mark.parametrize("labelled", [True, False])
def test_no_rows(spark, labelled):
    labels = spark.createDataFrame(LABELS if labelled else [], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).collect() == []
    one = filteraudit.audit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r["kept"] for r in one if r["step"] == 5} == {0}
