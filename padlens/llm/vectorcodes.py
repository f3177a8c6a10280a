"""Vector codes: product quantisation in exact integers by ball k-means.

Each part position has a codebook. An entry with the vectors it holds is a ball: of all entries only its neighbours,
those within twice its radius, can take a part from it. A ball that stands as its neighbours do keeps its parts without
work (a stable core); parts nearer to their entry than half its distance to the next entry stay too; for the others,
rings of the neighbours in order of distance hold the candidates, and these are compared exactly. All comparisons are
of squared integer distances: in float64 where that holds every sum exactly, else in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlens.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose parts are compared together.
BATCH = 16_384
_LONG = (1 << 63) - 1


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """`vec_id, label, v array<double>`: rows whose vector is whole, each component x as floor(1024 x).

    Vectors are as long as that of the least vec_id; others (and vectors without components) are dropped like those
    that are null or hold nulls or non-finite components.
    """
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Doubles beyond a float's range whose product isn't finite are dropped too.
    scaled = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    rows = vectors.filter(whole).select("vec_id", "label", scaled.alias("v")).filter(F.forall("v", lambda x: F.abs(x) != float("inf")))
    # FLOOR of a double is a long: beyond 2**53 a double has no fraction, and is its own floor.
    return rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))


class Books:
    """The codebooks of all parts, with what the balls need: neighbours, their distances, and which balls stand."""

    def __init__(self, entries: np.ndarray, radius: list[list[int]] | None = None, before: np.ndarray | None = None) -> None:
        """entries: parts x entries x components; radius: of each ball, in whole units, no less than the true one;
        before: the entries by which the rows' codes were found."""
        self.entries = entries
        parts, n, _ = entries.shape
        self.order, self.apart, self.standing = [], [], np.zeros((parts, n), bool)
        for p in range(parts):
            apart = squares(entries[p], entries[p])
            order = np.argsort(apart, axis=1, kind="stable")
            self.order.append(order)
            self.apart.append(np.take_along_axis(apart, order, axis=1))
            if radius is not None:
                same = (entries[p] == before[p]).all(axis=1)
                for i in range(n):
                    near = order[i][self.apart[p][i] <= 4 * radius[p][i] ** 2]
                    self.standing[p, i] = same[i] and same[near].all()


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y, exact if all sums fit the kind of number."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def assign(x: np.ndarray, code: np.ndarray, error: np.ndarray, books: Books, p: int) -> None:
    """Moves each row of x (one part position) from the ball `code` names to its nearest entry, ties to the lower index;
    code and error (the squared distance) are changed in place. error: right for rows in balls that stand."""
    entries, order, apart = books.entries[p], books.order[p], books.apart[p]
    by = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[by], np.arange(len(entries) + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        if books.standing[p, i]:
            continue  # a stable core
        at = by[cuts[i] : cuts[i + 1]]
        away = x[at] - entries[i]
        own = (away * away).sum(axis=1)
        error[at] = own
        # Entries up to twice the distance: a farther one is farther from the row than its own entry is.
        ring = np.searchsorted(apart[i], 4 * own, side="right")
        moved = np.flatnonzero(ring > 1)  # the first is the entry itself or one equal to it
        if not len(moved):
            continue
        moved = moved[np.argsort(ring[moved], kind="stable")]
        width = 8
        while len(moved):  # rows whose rings have up to `width` entries together
            width = max(width, int(ring[moved[0]]))
            n = int(np.searchsorted(ring[moved], width, side="right"))
            some, moved = moved[:n], moved[n:]
            near = np.sort(order[i][:width])  # by index, so that the first of equal distances is the lowest
            far = squares(x[at[some]], entries[near])
            best = far.argmin(axis=1)
            code[at[some]] = near[best]
            error[at[some]] = far[np.arange(len(some)), best]
            width *= 2


def _numbers(column: pa.Array, floats: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not floats:
        flat = np.array([int(v) for v in flat.tolist()], object)
    return flat.reshape(len(column), -1)


def _parts(v: np.ndarray) -> np.ndarray:
    """rows x parts x components; zeros behind the last component make the parts equally long."""
    size = -(-v.shape[1] // PARTS)
    out = np.zeros((len(v), PARTS * size), v.dtype)
    out[:, : v.shape[1]] = v
    return out.reshape(len(v), PARTS, size)


def reassigned(state: DataFrame, books: Books, floats: bool, first: bool) -> DataFrame:
    """state with code and error found anew. first: there are none yet, so each row starts in the ball of entry 0."""
    shared = state.sparkSession.sparkContext.broadcast(books)  # entries of a fixed number and their mutual distances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            parts = _parts(_numbers(batch.column("v"), floats))
            n = len(parts)
            if first:
                code, error = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), parts.dtype)
            else:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
                error = _errors(batch.column("error"), floats).reshape(n, PARTS)
            for p in range(PARTS):
                c, e = code[:, p].copy(), error[:, p].copy()
                assign(parts[:, p], c, e, shared.value, p)
                code[:, p], error[:, p] = c, e
            raw = code.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    batch.column("v"),
                    pa.array([raw[i : i + PARTS] for i in range(0, len(raw), PARTS)], pa.binary()),
                    _long_lists(error),
                ],
                ["vec_id", "label", "v", "code", "error"],
            )

    kinds = dict(state.dtypes)
    return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<double>, code binary, error array<{'long' if floats else 'string'}>")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH rows: the balls cost the same for few rows as for many."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BATCH:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _errors(column: pa.Array, floats: bool) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64) if floats else np.array([int(v) for v in flat.to_pylist()], object)


def _long_lists(error: np.ndarray) -> pa.Array:
    """Distances as longs, or as decimal strings where Python's integers hold them."""
    n = len(error)
    flat = pa.array(error.astype(np.int64).ravel()) if error.dtype != object else pa.array([str(e) for e in error.ravel()])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PARTS), flat)


def ball_sums(state: DataFrame, floats: bool) -> dict[tuple[int, int], tuple[int, list[int], int]]:
    """Of each ball (part, entry): its number of parts, the sums of their components, the greatest squared distance.

    Each task adds up its rows first, so the shuffle holds at most 1024 rows a task, and the driver gets 1024 rows.
    Sums travel as strings: they can be longer than a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in _gathered(batches):
            parts = _parts(_numbers(batch.column("v"), floats))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            error = _errors(batch.column("error"), floats).reshape(-1, PARTS)
            for p in range(PARTS):
                by = np.argsort(code[:, p], kind="stable")
                entry, start, count = np.unique(code[by, p], return_index=True, return_counts=True)
                sums = np.add.reduceat(parts[by, p], start, axis=0)
                most = np.maximum.reduceat(error[by, p], start)
                for e, n, s, m in zip(entry.tolist(), count.tolist(), sums.tolist(), most.tolist()):
                    have = total.setdefault((p, e), [0, [0] * len(s), 0])
                    have[0] += n
                    have[1] = [a + int(b) for a, b in zip(have[1], s)]
                    have[2] = max(have[2], int(m))
        rows = [(p, e, n, [str(x) for x in s], str(m)) for (p, e), (n, s, m) in sorted(total.items())]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums", "most"])

    def merged(key: tuple, batches: pa.Table) -> pa.Table:
        columns = zip(*batches.column("sums").to_pylist())
        sums = [str(sum(map(int, c))) for c in columns]
        most = str(max(map(int, batches.column("most").to_pylist())))
        values = [[key[0].as_py()], [key[1].as_py()], [sum(batches.column("n").to_pylist())], [sums], [most]]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string()))], ["part", "entry", "n", "sums", "most"])

    schema = "part int, entry int, n long, sums array<string>, most string"
    out = state.select("v", "code", "error").mapInArrow(run, schema).groupBy("part", "entry").applyInArrow(merged, schema)
    return {(r["part"], r["entry"]): (r["n"], [int(s) for s in r["sums"]], int(r["most"])) for r in out.collect()}


def first_entries(kept: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the least vec_ids; of several rows of one vec_id the least vector."""
    ids = kept.filter("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    rows = kept.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")
    return [r["v"] for r in rows.collect()]


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray | None]:
    """`vec_id, label, v, code binary, error array` for each kept row of vectors(vec_id, embedding, label), and the codebooks.

    The codebooks start as the parts of the least vec_ids' vectors. Each round assigns every part to the nearest entry
    (squared distance, ties to the lower index) and replaces each entry that holds parts by the floor of their mean; then all
    parts are assigned again. The result doesn't depend on the partitioning: sums are exact. Rows without vec_id are
    coded but are no entries; where no row has one, entries are those of the least vectors. Repeated rows count each. Without kept rows there are no codebooks (None).
    The rows with their codes are written after each round, so a lost executor costs one round at most.
    """
    kept = kept_vectors(vectors)
    lead = kept.select("vec_id", F.size("v").alias("size"), "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not lead:
        return kept.withColumn("code", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("array<long>")), None
    kept = staged(kept.filter(F.size("v") == lead[0]["size"]), "vectors")
    start = first_entries(kept, entries) or [r["v"] for r in kept.select("v").distinct().orderBy("v").limit(entries).collect()]
    most = int(kept.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0])
    floats = 16 * lead[0]["size"] * (most + 1) ** 2 < 1 << 53 and 4 * BATCH * (most + 1) < 1 << 53  # all squares and the sums of a batch
    book = _parts(np.array(start) if floats else np.array([[int(x) for x in v] for v in start], object)).transpose(1, 0, 2)
    books, state = Books(np.ascontiguousarray(book)), kept
    for done in range(rounds + 1):
        state = staged(reassigned(state, books, floats, done == 0), "codes")
        if done == rounds:
            return state, books.entries
        balls = ball_sums(state, floats)
        new = books.entries.copy()
        radius = [[0] * new.shape[1] for _ in range(PARTS)]
        for (p, e), (n, sums, far) in balls.items():
            new[p, e] = [s // n for s in sums]
            shift = sum((int(a) - int(b)) ** 2 for a, b in zip(new[p, e].tolist(), books.entries[p, e].tolist()))
            radius[p][e] = isqrt(far) + 1 + isqrt(shift) + 1
        books = Books(new, radius, books.entries)
    raise AssertionError


def codes(vectors: DataFrame) -> DataFrame:
    """`vec_id, code, error, label_error, codebooks_sha256` for each kept row, as `encode` finds them.

    code: two hex digits a part; error: the squared distances summed over the parts; label_error: that summed over the rows of
    an equal label, null labels together; both null where they are no longs. codebooks_sha256: of all entries' integer components by part, entry and position,
    joined by commas (zeros that make the parts equally long included). Clashing names of other columns don't matter.
    """
    rows, book = encode(vectors.select("vec_id", "embedding", "label"))
    text = ",".join(str(int(x)) for x in book.ravel().tolist()) if book is not None else ""
    wide = "decimal(38,0)"
    total = F.aggregate(F.transform("error", lambda e: e.try_cast("long").cast(wide)), F.lit(0).cast(wide), lambda a, b: (a + b).cast(wide))
    rows = rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), total.alias("total"))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.when(F.count("*") == F.count("total"), F.sum("total")).alias("sum"))
    sums = staged(sums, "labels")  # a row a label: Spark knows the size before it joins

    def fits(c: str) -> Column:
        return F.when(F.col(c) <= _LONG, F.col(c)).cast("long")

    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", fits("total").alias("error"), fits("sum").alias("label_error"), F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")
    )
