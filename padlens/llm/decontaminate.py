"""Benchmark items inside long documents: size-partitioned MinHash containment search with an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlens.llm.common import buffer_of, mix, run_hashes, runs, slices, texts_of

WIDTH, THRESHOLD = 5, 0.8
#: Hash functions of a signature. An item at the threshold shares each with the window around it with a chance of
#: 0.19 or more, so all miss with a chance of 0.81^128, about 2e-12.
PERMUTATIONS = 128
#: Items searched in one pass over the documents; more items take more passes. Bounds what is sent to a task: 2 KB for an
#: item's least values and 16 bytes for each of its shingles, so about 60 MB for items of 60 words.
ITEMS_A_PASS = 20_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts in order, and the n + 1 offsets of each text's.

    Words are runs of letters, digits, underscores and characters beyond ASCII, in lower case. A text of fewer
    words has one shingle, the whole sequence; a text without words has none.
    """
    data, offsets = buffer_of([t.lower() for t in texts])
    starts, ends = runs(_WORD[data])
    words = run_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    if len(words) >= width:
        n = len(words) - width + 1
        joined = np.zeros(n, np.uint64)
        for k in range(width):
            joined = joined * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
        joined = mix(joined)
        doc = np.repeat(np.arange(len(count)), count)
        whole = joined[doc[:n] == doc[width - 1 :]]
    else:
        whole = np.zeros(0, np.uint64)
    size = np.maximum(count - width + 1, 0)
    short = np.flatnonzero((count > 0) & (count < width))
    size[short] = 1
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    if len(short):
        out = np.zeros(at[-1], np.uint64)
        of_short = np.zeros(at[-1], bool)
        of_short[at[short]] = True
        out[~of_short] = whole
        for i in short.tolist():
            x = np.array([count[i]], np.uint64)
            for w in words[first[i] : first[i + 1]]:
                x = mix(x * np.uint64(0xD1342543DE82EF95) + w)
            out[at[i]] = x[0]
        whole = out
    return whole, at


def least_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Under each hash function the place of the shingle with the least value, and that value; in parts of a few MB."""
    step = max(1, (1 << 20) // max(len(values), 1))
    place = np.empty(PERMUTATIONS, np.int64)
    least = np.empty(PERMUTATIONS, np.uint64)
    for a in range(0, PERMUTATIONS, step):
        hashed = mix(values[None, :] ^ _SEEDS[a : a + step, None])
        place[a : a + step] = hashed.argmin(1)
        least[a : a + step] = hashed[np.arange(len(hashed)), place[a : a + step]]
    return place, least


@dataclass
class Items:
    """Items with their shingle sets, partitioned by size: a class holds sizes above half its bound up to the bound."""

    ids: np.ndarray
    sets: list[np.ndarray]
    bounds: list[int]  # of the classes
    tables: list[tuple[np.ndarray, np.ndarray]]  # of each class: least values in order, and the item of each
    leads: np.ndarray  # all shingles that are least in an item under some function


def index(ids: list[int], texts: list[str], width: int = WIDTH) -> Items:
    values, at = shingles(texts, width)
    sets = [np.unique(values[a:b]) for a, b in zip(at, at[1:])]
    keep = [i for i, s in enumerate(sets) if len(s)]
    bound = [1 << (len(s) - 1).bit_length() for s in sets]
    bounds = sorted({bound[i] for i in keep})
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in bounds]
    leads = [np.zeros(0, np.uint64)]
    for i in keep:
        place, least = least_places(sets[i])
        leads.append(sets[i][np.unique(place)])
        found[bounds.index(bound[i])].append((least, np.full(PERMUTATIONS, i)))
    tables = []
    for rows in found:
        least, item = (np.concatenate(x) for x in zip(*rows))
        by = np.argsort(least, kind="stable")
        tables.append((least[by], item[by]))
    return Items(np.array(ids, np.int64), sets, bounds, tables, np.unique(np.concatenate(leads)))


def _present(values: np.ndarray, among: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the values that are among a sorted array; bits is its bit table by the top 22 bits."""
    at = np.flatnonzero(bits[values >> np.uint64(42)])
    if not len(among):
        return at[:0]
    x = values[at]
    return at[among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x]


def search(items: Items, values: np.ndarray, at: np.ndarray, bits: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(document, item, shared shingles) for all items contained to the threshold.

    For each size class a document is cut into windows of twice the class bound, each overlapping the next by
    half, so that any run as long as an item lies in one. A window meets an item where their signatures share a
    value. Signatures are made only for windows with a shingle that leads some item, as no other can share one.
    """
    hits = _present(values, items.leads, bits)
    if not len(hits):
        return
    docs = np.searchsorted(at, hits, side="right") - 1
    for doc in np.unique(docs).tolist():
        own = values[at[doc] : at[doc + 1]]
        where = hits[docs == doc] - at[doc]
        found: set[int] = set()
        for bound, (keys, item) in zip(items.bounds, items.tables):
            step = np.unique(where // bound)
            for w in np.unique(np.concatenate([step, np.maximum(step - 1, 0)])).tolist():
                _, least = least_places(own[w * bound : (w + 2) * bound])
                for a, b in zip(np.searchsorted(keys, least), np.searchsorted(keys, least, side="right")):
                    found.update(item[a:b].tolist())
        if found:
            whole = np.unique(own)
            for i in sorted(found):
                shared = int(np.isin(items.sets[i], whole, assume_unique=True).sum())
                if shared >= threshold * len(items.sets[i]):
                    yield doc, i, shared


def contained(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, item_id, shared, item_shingles, containment` for each document and item whose share of distinct
    item shingles found in the document is `threshold` or more.

    Null and empty texts and items hold no shingle and match nothing; equal items each match; repeated documents
    come back as often as they came in; an empty benchmark gives no rows; other columns are ignored. The documents
    aren't shuffled: items go to the tasks in passes of about ITEMS_A_PASS, however many there are.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    passes = max(1, -(-items.count() // ITEMS_A_PASS))
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"

    def one(number: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(index([r["item_id"] for r in part], [r["text"] for r in part], width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            bits = np.zeros(1 << 22, bool)
            bits[known.leads >> np.uint64(42)] = True
            for batch in slices(batches, 1 << 20):
                values, at = shingles(texts_of(batch), width)
                found = list(search(known, values, at, bits, threshold))
                if found:
                    ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
                    size = [len(known.sets[i]) for _, i, _ in found]
                    columns = [
                        pa.array([ids[d] for d, _, _ in found], pa.int64()),
                        pa.array([int(known.ids[i]) for _, i, _ in found], pa.int64()),
                        pa.array([n for _, _, n in found], pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array([n / s for (_, _, n), s in zip(found, size)], pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out = one(0)
    for number in range(1, passes):
        out = out.unionByName(one(number))
    return out
