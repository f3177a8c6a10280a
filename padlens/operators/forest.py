"""Random forests whose trees are grown to the end, whole trees in a task (L3).

Trees see a column only through its bins, so rows are counted by their cells of bins and each task holds all cells; their number is bounded
by the bins to the power of the columns, and by the rows. A tree is not kept: it judges all cells that are to be scored while it grows, and
tasks send sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from padlens.functions.shared import written

#: Trees that a task grows.
TREES = 4


def tree(codes: np.ndarray, counts: np.ndarray, weights: np.ndarray, wanted: np.ndarray, leaf: int, take: int, depth: int | None, random: np.random.Generator) -> np.ndarray:
    """Of each row of `wanted` the share of label 1 in its leaf.

    codes: cells by columns, counts: of each cell the drawn rows of label 0 and of label 1, weights of both labels. A node is split by
    the Gini index at the best edge of `take` random columns, or of the first one that differs within the node where none of these does; each
    side keeps `leaf` drawn rows. It is a leaf if it holds one label or no edge is left. All nodes of a level are split at once; for each column
    the cells stay in order of node and code, which a split only parts.
    """
    some = counts.sum(axis=1) > 0
    codes, counts = codes[some], counts[some].astype(float)
    columns = codes.shape[1]
    orders = [np.argsort(codes[:, j], kind="stable") for j in range(columns)]
    starts = np.array([0, len(codes)])
    out, at, node_of = np.zeros(len(wanted)), np.arange(len(wanted)), np.zeros(len(wanted), np.int64)
    level = 0
    while len(starts) > 1:
        nodes, sizes = len(starts) - 1, np.diff(starts)
        totals = np.add.reduceat(counts[orders[0]], starts[:-1], axis=0)
        share = totals * weights
        share = share[:, 1] / share.sum(axis=1)
        node = np.repeat(np.arange(nodes), sizes)
        grows = (totals > 0).all(axis=1) & (totals.sum(axis=1) >= 2 * leaf) & (sizes > 1) & (depth is None or level < depth)
        differs = np.stack([codes[o[starts[:-1]], j] != codes[o[starts[1:] - 1], j] for j, o in enumerate(orders)], axis=1)
        rank = random.random((nodes, columns)).argsort(axis=1).argsort(axis=1)
        ahead = np.where(differs, rank, columns).min(axis=1)  # the first column that differs
        tried = ((rank < take) | (rank == ahead[:, None])) & differs & grows[:, None]
        best, best_rank, column, edge = np.full(nodes, -np.inf), np.full(nodes, columns), np.zeros(nodes, np.int64), np.zeros(nodes, codes.dtype)
        for j, o in enumerate(orders):
            code = codes[o, j]
            ends = np.flatnonzero((code[:-1] != code[1:]) & (node[:-1] == node[1:]) & tried[node[:-1], j])
            if not len(ends):
                continue
            upto = counts[o].cumsum(axis=0)
            of = node[ends]
            first = starts[of]
            left = upto[ends] - np.where(first[:, None] > 0, upto[first - 1], 0.0)
            right = totals[of] - left
            fits = (left.sum(axis=1) >= leaf) & (right.sum(axis=1) >= leaf)
            ends, of, left, right = ends[fits], of[fits], left[fits] * weights, right[fits] * weights
            if not len(ends):
                continue
            purity = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1)
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            most = np.maximum.reduceat(purity, heads)
            hit = np.flatnonzero(purity == np.repeat(most, np.diff(np.r_[heads, len(of)])))
            hit = hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]
            found = of[hit]
            better = (most > best[found]) | ((most == best[found]) & (rank[found, j] < best_rank[found]))
            found, hit, most = found[better], hit[better], most[better]
            best[found], best_rank[found], column[found], edge[found] = most, rank[found, j], j, code[ends[hit]]
        split = best > -np.inf
        ended = ~split[node_of]
        out[at[ended]] = share[node_of[ended]]
        at, node_of = at[~ended], node_of[~ended]
        renumbered = np.cumsum(split) - 1
        below = wanted[at, column[node_of]] <= edge[node_of]
        node_of = 2 * renumbered[node_of] + ~below
        stays = split[node]
        cells, kept = orders[0][stays], node[stays]
        goes = np.zeros(len(codes), bool)
        goes[cells] = codes[cells, column[kept]] <= edge[kept]
        sizes, kept = sizes[split], renumbered[kept]
        first = np.cumsum(sizes) - sizes
        lefts = np.bincount(kept, goes[cells], minlength=len(sizes)).astype(np.int64)
        for j, o in enumerate(orders):
            o = o[stays]
            g = goes[o]
            before = np.cumsum(g)
            before -= (before[first] - g[first])[kept] if len(first) else 0  # cells of the node that went left, this one included
            place = np.where(g, first[kept] + before - 1, lefts[kept] + np.arange(len(o)) - before)
            orders[j] = np.empty_like(o)
            orders[j][place] = o
        starts = np.r_[0, np.cumsum(np.stack([lefts, sizes - lefts], axis=1).ravel())].astype(np.int64)
        level += 1
    return out


def trees(codes: np.ndarray, counts: np.ndarray, wanted: np.ndarray, numbers: range, leaf: int, depth: int | None) -> np.ndarray:
    """Sums over the trees of these numbers. Each draws as many rows as there are, with repeats; classes are balanced by the number of rows;
    a node tries the square root of the columns. A tree's draws depend on its number and the cells alone, not on their order."""
    order = np.lexsort(codes.T)
    codes, counts = codes[order], counts[order]
    each = counts.sum(axis=0)
    weights = np.divide(each.sum(), (each > 0).sum() * each, out=np.zeros(2), where=each > 0)
    out = np.zeros(len(wanted))
    for number in numbers:
        random = np.random.default_rng([1, number])
        drawn = random.multinomial(each.sum(), counts.ravel() / each.sum()).reshape(-1, 2)
        out += tree(codes, drawn, weights, wanted, leaf, max(1, int(codes.shape[1] ** 0.5)), depth, random)
    return out


def forest_scored(binned: Bucketizer, rows: DataFrame, sizes: dict[str, float | None]) -> DataFrame:
    """rows of val and test with `score`, the mean share of label 1 in their leaves of all trees, grown on the rows of train.

    rows(label, pool, *columns of binned). The cells, of as many bytes as columns and 17 more each, go to all tasks by a broadcast.
    """
    names = binned.getOutputCols()
    coded = binned.transform(rows)
    kinds = [F.count(F.when((F.col("pool") == "train") & (F.col("label") == k), 1)).alias(f"n{k}") for k in (0, 1)]
    cells = coded.groupBy(*names).agg(*kinds, (F.count(F.when(F.col("pool") != "train", 1)) > 0).alias("wanted"))
    blocks = range(0, int(sizes["trees"]), TREES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for i, batch in enumerate(batches):
            codes = np.stack([batch.column(n).to_numpy().astype("u1") for n in names], axis=1)
            counts = np.stack([batch.column(n).to_numpy() for n in ("n0", "n1")], axis=1).astype("<i8")
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False)
            columns = [pa.array([TaskContext.get().partitionId() << 32 | i]), *[pa.array([a.tobytes()], pa.binary()) for a in (codes, counts, wanted)]]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "codes", "counts", "wanted"])

    chunks = written(cells.mapInArrow(pack, "chunk long, codes binary, counts binary, wanted binary"), "cells")

    def unpack(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts = zip(*[table[c].to_pylist() for c in ("codes", "counts", "wanted")])
        return [(np.frombuffer(a, "u1").reshape(-1, len(names)), np.frombuffer(b, "<i8").reshape(-1, 2), np.frombuffer(c, bool)) for a, b, c in parts]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found)
        parts = unpack(table)
        codes, counts, wanted = (np.concatenate(p) for p in zip(*parts))
        train = counts.sum(axis=1) > 0
        if not train.any():
            raise ValueError("no rows to train on")
        first = table["block"][0].as_py()
        sums = trees(codes[train], counts[train], codes[wanted], range(first, min(first + TREES, blocks.stop)), int(sizes["leaf"]), sizes["depth"])
        edges = np.cumsum([0, *[w.sum() for _, _, w in parts]])
        each = [sums[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(table["chunk"].to_pylist()), pa.array(each, pa.binary())], names=["chunk", "sums"])

    tasks = rows.sparkSession.range(0, len(blocks), 1, len(blocks)).select((F.col("id") * TREES).alias("block"))
    sums = written(tasks.crossJoin(F.broadcast(chunks)).mapInArrow(grow, "chunk long, sums binary"), "sums")

    def mean(found: pa.Table, of: pa.Table) -> pa.Table:
        [(codes, _, wanted)] = unpack(of)
        total = np.sum([np.frombuffer(s) for s in found["sums"].to_pylist()], axis=0)
        return pa.table([*[pa.array(codes[wanted, j].astype(float)) for j in range(len(names))], pa.array(total / blocks.stop)], names=[*names, "score"])

    shape = T.StructType([T.StructField(n, T.DoubleType()) for n in [*names, "score"]])
    scores = written(sums.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(mean, shape), "scores")
    return coded.filter("pool <> 'train'").join(scores, names)
