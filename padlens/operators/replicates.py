"""Replicates of a user bootstrap as vectors: each user has one vector of how often each replicate drew them.

Rows meet a user's vector once instead of once for each replicate, and sums over replicates are vector sums inside the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padlens.functions.prefix import running_totals
from padlens.functions.quantiles import place, stepped
from padlens.functions.shared import written

#: Users in a block of draws, slots that one row of work hashes, rows of a bucket of values, bytes of sums that a task holds.
BLOCK, CHUNK, BUCKET_ROWS, HELD = 4096, 1 << 20, 2000, 1 << 26


def binaries(matrix: np.ndarray) -> pa.Array:
    """One binary a row: a byte a replicate, four where a count of the matrix exceeds a byte."""
    rows = np.ascontiguousarray(matrix.astype("<u1" if matrix.size == 0 or matrix.max() < 256 else "<u4"))
    width = rows.shape[1] * rows.itemsize
    edges = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(rows)]).cast(pa.binary())


def matrix(column: pa.Array | pa.ChunkedArray, replicates: int) -> np.ndarray:
    """The counts behind `binaries`, rows by replicates."""
    found = column.to_pylist()
    if all(len(b) == replicates for b in found):
        return np.frombuffer(b"".join(found), "<u1").reshape(len(found), replicates)
    return np.stack([np.frombuffer(b, "<u1" if len(b) == replicates else "<u4").astype("<u4") for b in found])


def messages(head: bytes, line: bytes) -> list[bytes]:
    """head before each of the numbers that `line` holds, each behind a line end; a head that holds one itself would be torn."""
    if b"\n" in head:
        return [head + s for s in line.split(b"\n")[1:]]
    return line.replace(b"\n", b"\n" + head).split(b"\n")[1:]


def vector_draws(users: DataFrame, replicates: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """`resample.draws` with one row a user: *by, user_id, times, replicates; times is a `binaries` row. users(user_id, *by).

    A task hashes the slots of one replicate, at most CHUNK of them, and sends the picks of each block of users as one row; a
    block's rows of all replicates, about 2 * BLOCK * replicates bytes, become its users' vectors. The result is written. The slots'
    digits are the same in all replicates, so a task writes them once.
    """
    by = by or []
    ranked = running_totals(users.select(*by, "user_id").distinct().withColumn("one", F.lit(1)), by, "user_id", ["one"])
    ranked = written(ranked.select(*by, "user_id", (F.col("cum_one") - 1).cast("long").alias("slot")), "ranked")
    n = ranked.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 0")
    n = n.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    reps = users.sparkSession.range(0, replicates, 1, max(1, min(replicates, 200))).select(F.col("id").cast("int").alias("rep"))
    work = reps.crossJoin(F.broadcast(n)).withColumn("head", F.concat_ws("|", F.lit(seed), "rep", *by, F.lit("")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, lines, digest = range(0), [], type(hashlib.sha256()).digest
        for batch in batches:
            kept = batch.select(["rep", *by])
            for i, r in enumerate(batch.select(["head", "n", "chunk"]).to_pylist()):
                wanted = range(r["chunk"] * CHUNK, min(r["n"], (r["chunk"] + 1) * CHUNK))
                if wanted != slots:
                    slots, lines = wanted, [b"".join([b"\n%d" % s for s in wanted[a : a + 1024]]) for a in range(0, len(wanted), 1024)]
                head = r["head"].encode()
                digests = b"".join([b"".join(map(digest, map(hashlib.sha256, messages(head, line)))) for line in lines])
                wide = np.zeros((len(slots), 8), "u1")
                wide[:, 2:] = np.frombuffer(digests, "u1").reshape(-1, 32)[:, :6]
                picks = np.sort(np.floor(wide.view(">u8")[:, 0].astype(float) / float(1 << 48) * r["n"]).astype(np.int64))
                blocks, starts = np.unique(picks // BLOCK, return_index=True)
                parts = [p.astype("<u2").tobytes() for p in np.split(picks % BLOCK, starts[1:])]
                same = kept.take(pa.array(np.full(len(blocks), i)))
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(blocks), pa.array(parts, pa.binary())], names=["rep", *by, "block", "at"])

    keys = [ranked.schema[c] for c in by]
    picks = work.mapInArrow(pick, T.StructType([T.StructField("rep", T.IntegerType()), *keys, T.StructField("block", T.LongType()), T.StructField("at", T.BinaryType())]))

    def turned(table: pa.Table) -> pa.Table:
        times = np.zeros((replicates, BLOCK), np.uint32)
        for rep, at in zip(table["rep"].to_pylist(), table["at"].to_pylist()):
            times[rep] += np.bincount(np.frombuffer(at, "<u2"), minlength=BLOCK).astype(np.uint32)
        first = table.slice(0, 1).select([*by, "block"]).take(pa.array(np.zeros(BLOCK, np.int64)))
        slots = table["block"][0].as_py() * BLOCK + np.arange(BLOCK)
        return pa.table([*[first[c] for c in by], pa.array(slots), binaries(times.T)], names=[*by, "slot", "times"])

    shape = T.StructType([*keys, T.StructField("slot", T.LongType()), T.StructField("times", T.BinaryType())])
    vectors = picks.groupBy(*by, "block").applyInArrow(turned, shape)
    return written(ranked.join(vectors, [*by, "slot"]).drop("slot").withColumn("replicates", F.lit(replicates)), "drawn")


def vectors_of(drawn: DataFrame) -> tuple[DataFrame, list[str], int]:
    """Vectors, the columns that tell a user, and the number of replicates; drawn as from `vector_draws` or (rep, *keys, mult)."""
    if "times" in drawn.columns:
        keys = [c for c in drawn.columns if c not in ("times", "replicates")]
        first = drawn.select("replicates").first()
        return drawn.drop("replicates"), keys, first[0] if first else 0
    keys = [c for c in drawn.columns if c not in ("rep", "mult")]
    replicates = (drawn.agg(F.max("rep")).first()[0] or 0) + 1
    lists = drawn.groupBy(*keys).agg(F.collect_list(F.struct("rep", "mult")).alias("times"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = np.zeros((batch.num_rows, replicates), np.uint32)
            for i, pairs in enumerate(batch.column("times").to_pylist()):
                for p in pairs:
                    times[i, p["rep"]] += p["mult"]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, binaries(times)], names=[*keys, "times"])

    return lists.mapInArrow(pack, T.StructType([*[lists.schema[c] for c in keys], T.StructField("times", T.BinaryType())])), keys, replicates


def grouped(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Of each key its values and its rows."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    table = pa.table([*batch.select(keys).columns, pa.array(np.arange(batch.num_rows))], names=[*keys, "_i"])
    found = table.group_by(keys).aggregate([("_i", "list")])
    for key, rows in zip(zip(*[found[k].to_pylist() for k in keys]), found["_i_list"].to_pylist()):
        yield key, np.array(rows)


def replicate_sums(counts: DataFrame, drawn: DataFrame, cell: list[str], sums: list[str]) -> DataFrame:
    """*cell, rep, *sums: over a cell's users each sum times how often the replicate drew the user; replicates in which a cell has
    no user are left out. counts(*cell, *keys of drawn, *sums), several rows a user or one.

    A user's sums of all cells, one entry a cell, lie in one row and meet the vector once. A task adds up the vectors of its rows by
    cell, at most HELD bytes of them, before it sends them.
    """
    vectors, keys, replicates = vectors_of(drawn)
    added = counts.groupBy(*keys, *[c for c in cell if c not in keys]).agg(*[F.sum(F.col(s).cast("double")).alias(s) for s in sums])
    lists = added.select(*keys, F.struct(*cell, *sums).alias("_e")).groupBy(*keys).agg(F.collect_list("_e").alias("_each"))
    joined = lists.join(vectors, keys).select("_each", "times")
    fields = [added.schema[c] for c in cell]
    names = ["_met", *sums]
    types = [pa.field(c, batch_type(f.dataType)) for c, f in zip(cell, fields)]
    most = max(1, HELD // (8 * len(names) * max(1, replicates)))

    def send(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(types)]
        vectors = [pa.array([v[j].tobytes() for v in held.values()], pa.binary()) for j in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, *vectors], names=[*cell, *names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                times = matrix(batch.column("times"), replicates).astype(float)
                entries, users = batch.column("_each").flatten(), pc.list_parent_indices(batch.column("_each")).to_numpy()
                entries = pa.RecordBatch.from_struct_array(entries)
                each = np.stack([np.ones(len(users)), *[entries.column(s).to_numpy(zero_copy_only=False) for s in sums]])
                found = list(grouped(entries, cell))
                if len(found) * len(times) <= 4 * len(users):  # most users have most cells
                    dense = np.zeros((len(found), len(names), len(times)))
                    for i, (_, rows) in enumerate(found):
                        dense[i][:, users[rows]] = each[:, rows]
                    totals = iter((dense.reshape(-1, len(times)) @ times).reshape(len(found), len(names), -1))
                else:
                    totals = (each[:, rows] @ times[users[rows]] for _, rows in found)
                for (key, _), total in zip(found, totals):
                    if key in held:
                        held[key] += total
                    else:
                        held[key] = total
                if len(held) >= most:
                    yield send(held)
                    held = {}
        if held:
            yield send(held)

    parts = joined.mapInArrow(add, T.StructType([*fields, *[T.StructField(s, T.BinaryType()) for s in names]]))

    def merge(table: pa.Table) -> pa.Table:
        total = [np.sum([np.frombuffer(b) for b in table[s].to_pylist()], axis=0) for s in names]
        met = np.flatnonzero(total[0] > 0)
        first = table.slice(0, 1).take(pa.array(np.zeros(len(met), np.int64)))
        return pa.table([*[first[c] for c in cell], pa.array(met.astype(np.int32)), *[pa.array(t[met]) for t in total[1:]]], names=[*cell, "rep", *sums])

    shape = T.StructType([*fields, T.StructField("rep", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in sums]])
    return parts.groupBy(*cell).applyInArrow(merge, shape)


def batch_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def bucketed(counts: DataFrame, cell: list[str], value: str) -> DataFrame:
    """counts, written, with `bucket`: its number among a cell's parts by value, of about BUCKET_ROWS rows, at most 2000
    parts; equal values share one."""
    counts = written(counts, "counts")
    sizes = counts.groupBy(*cell).agg(F.count("*").alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    parts = min(2000, -(-largest // BUCKET_ROWS))
    if parts < 2:
        return counts.withColumn("bucket", F.lit(0))
    levels = F.lit([i / parts for i in range(1, parts)])
    edges = counts.groupBy(*cell).agg(F.percentile_approx(value, levels, F.lit(20 * parts)).alias("_e")) if cell else counts.agg(F.percentile_approx(value, levels, F.lit(20 * parts)).alias("_e"))
    edges = written(stepped(edges, "_e", parts), "edges")
    placed = counts.join(F.broadcast(edges), cell) if cell else counts.crossJoin(F.broadcast(edges))
    return placed.withColumn("bucket", place(F.col(value))).drop("_runs", "_heads")


def weighted_rows(counts: DataFrame, drawn: DataFrame, keep: list[str], count: str) -> tuple[DataFrame, int]:
    """*keep, times: counts met with their users' vectors times `count`, rows of equal `keep` of a batch added up."""
    vectors, keys, replicates = vectors_of(drawn)
    joined = counts.join(vectors, keys).select(*keep, F.col(count).alias("_count"), "times")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                count = batch.column("_count").to_numpy(zero_copy_only=False)
                groups = [rows for _, rows in grouped(batch, keep)]
                if len(groups) == batch.num_rows and (count == 1).all():  # nothing to add up
                    same = batch.select([*keep, "times"])  # its columns may be marked as never null, those below are not
                    yield pa.RecordBatch.from_arrays(same.columns, names=same.schema.names)
                    continue
                times = matrix(batch.column("times"), replicates)
                if (count != 1).any():
                    times = times.astype(np.uint32) * count.astype(np.uint32)[:, None]
                first = batch.select(keep).take(pa.array([r[0] for r in groups]))
                yield pa.RecordBatch.from_arrays([*first.columns, binaries(added(times, groups))], names=[*keep, "times"])

    return joined.mapInArrow(add, T.StructType([*[joined.schema[c] for c in keep], T.StructField("times", T.BinaryType())])), replicates


def by_value(table: pa.Table, value: str, side: str, replicates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending values of a bucket, and the weights of its rows of side 0 and of side 1, values by replicates."""
    values, at = np.unique(table[value].to_numpy(), return_inverse=True)
    out = []
    for own, total in by_side(at, table, side, replicates):
        whole = np.zeros((len(values), replicates), np.int64)
        whole[own] = total
        out.append(whole)
    return values, *out


def added(times: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Sums of the rows of each group, of 32 bits."""
    order = np.concatenate(groups)
    starts = np.cumsum([0, *[len(r) for r in groups[:-1]]])
    return np.add.reduceat(times[order], starts, axis=0, dtype=np.uint32) if len(groups) < len(times) else times[order].astype(np.uint32)


def by_side(at: np.ndarray, table: pa.Table, side: str, replicates: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of side 0 and of side 1 the ascending places `at` that its rows have, and their rows' weights added up, places by replicates."""
    times, sides = matrix(table["times"], replicates), table[side].to_numpy()
    for k in (0, 1):
        rows = np.flatnonzero(sides == k)
        rows = rows[np.argsort(at[rows], kind="stable")]
        own, starts = np.unique(at[rows], return_index=True)
        yield own, np.add.reduceat(times[rows], starts, axis=0, dtype=np.int64) if len(rows) else np.zeros((0, replicates), np.int64)


def bucket_wins(table: pa.Table, value: str, side: str, replicates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each replicate the weight of a bucket's rows of side 0, of side 1, and that of the pairs in which side 1 has the greater
    value, ties half."""
    _, at = np.unique(table[value].to_numpy(), return_inverse=True)
    (low, real), (high, fake) = by_side(at, table, side, replicates)
    upto = np.zeros((len(low) + 1, replicates), np.int64)
    np.cumsum(real, axis=0, out=upto[1:])
    twice = np.zeros(replicates, np.int64)
    for a in range(0, len(high), 256):  # few rows at a time stay near
        part = high[a : a + 256]
        twice += np.einsum("ij,ij->j", fake[a : a + 256], upto[np.searchsorted(low, part)] + upto[np.searchsorted(low, part, "right")])
    return upto[-1], fake.sum(axis=0), twice / 2


def at_buckets(rows: DataFrame, wanted: DataFrame, key: list[str], fine: Callable[[pa.Table, pa.Table], pa.Table], shape: T.StructType) -> DataFrame:
    """fine(rows of a bucket, what is wanted of it) for the buckets of which something is wanted."""
    return rows.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(fine, shape)


def below(totals: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """totals(*key, bucket, *sums) with `below_<s>`, the sums of lower buckets, and `all_<s>`; a key's buckets are few."""
    whole = Window.partitionBy(*key)
    lower = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"below_{s}": F.coalesce(F.sum(s).over(lower), F.lit(0.0)) for s in sums} | {f"all_{s}": F.sum(s).over(whole) for s in sums})
