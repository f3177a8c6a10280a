"""Ball k-means against plain rounds over all entries in Python's integers."""

import hashlib
import math
import random

import numpy as np
import oracle
import pytest

from padlens.llm import vectorcodes
from padlens.llm.queries import op13_vector_codes
from padlens.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, v int, error int"


def slow(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label), as the docstrings say."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])) or sorted(kept, key=lambda r: r[1])
    size = len(order[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = -(-size // 4)
    cut = lambda v: [(v + [0] * (4 * width - size))[p * width : (p + 1) * width] for p in range(4)]
    start = {}
    for i, v, _ in order:
        if len(v) == size:
            start.setdefault(i if i is not None else tuple(v), v)
    book = [list(b) for b in zip(*[cut(v) for v in list(start.values())[:entries]])]
    parts = [cut(v) for _, v, _ in kept]

    def nearest(x, entry):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(entry))

    for _ in range(rounds):
        for p in range(4):
            held = {}
            for x in parts:
                held.setdefault(nearest(x[p], book[p])[1], []).append(x[p])
            for e, xs in held.items():
                book[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(x[p], book[p]) for p in range(4)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    sha = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    long = lambda n: n if n < 1 << 63 else None
    return [(i, "".join(f"{e:02x}" for _, e in f), long(n), long(total[label]), sha) for (i, _, label), f, n in zip(kept, found, errors)]


def check(spark, rows):
    table = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, vectorcodes.codes(table).collect()), key=key) == sorted(slow(rows), key=key)


def test_vectors_of_all_kinds(spark):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(900)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(300)]  # a third alike
    rows += [rows[3], rows[3], (None, rows[5][1], 2), (4, rows[9][1], 0), (-1, None, 1), (-2, [], 1), (-3, [1.0, None] * 4, 1), (-4, [float("nan")] * 8, 1), (-5, [float("-inf")] * 8, 1), (9000, [1.0] * 7, 1)]
    check(spark, rows)


@pytest.mark.parametrize("scale", [1e-3, 1e5, 1e30])
def test_small_tables_ties_and_large_numbers(spark, scale):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-2, 3) * scale for _ in range(6)], i % 3) for i in range(150)]  # parts of two, zeros behind
    check(spark, rows)
    check(spark, rows[:1])


def test_no_rows_and_no_ids(spark):
    check(spark, [(1, None, 1)])
    check(spark, [(None, [0.5, 0.25, 1.0, 2.0], None), (None, [0.0] * 4, None)])
    assert vectorcodes.codes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stable_cores_and_rings_give_the_nearest():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 40, (3000, 4)))
    for entries in (1, 5, 64):
        book = np.floor(rng.normal(0, 40, (1, entries, 4)))
        book[0, -1] = book[0, 0]  # equal entries
        code, error, before, radius = np.zeros(len(x), np.int64), np.zeros(len(x)), None, None
        for _ in range(5):
            books = vectorcodes.Books(book, radius, before)
            vectorcodes.assign(x, code, error, books, 0)
            far = vectorcodes.squares(x, book[0])
            assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
            before, book = book, book.copy()
            radius = [[math.isqrt(int(error[code == e].max(initial=0))) + 2 for e in range(entries)]]
            book[0, : entries // 4] += 1  # some entries move, the others stand
            for e in range(entries // 4):
                radius[0][e] += 3


def test_given_table_and_sql(spark):
    got = op13_vector_codes(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(slow(rows))
    assert oracle.differences(got, oracle.connect(SF), ORACLES["op13_vector_codes"]) == ""
