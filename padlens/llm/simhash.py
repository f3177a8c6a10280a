"""SimHash fingerprints, their exact linkage by tiled comparison, and the connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from padlens.llm.common import buffer_of, mix, run_hashes, runs, slices, staged, texts_of

RADIUS = 4
TILE = 512
#: Similar documents: words of a shingle, least share of common shingles (Jaccard), bits that a pair may differ in before its
#: shingles are compared (at 0.8 the mean is 9.7, the deviation 2.9), and the bands of least values that bring documents
#: together with the values of each: a pair at 0.8 shares none of them with a chance of (1 - 0.8^5)^20, under 0.0004.
WIDTH, SIMILARITY, WIDE, BANDS, VALUES = 5, 0.8, 20, 20, 5
#: Shingles of a block of documents that are compared with each other at once, and of a part that has blocks of its own.
SHINGLES, OWN = 500_000, 250_000
#: Rows of one block of a large key; larger keys are compared block by block, each pair of blocks in a group of its own.
BLOCK = 4096


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts, ends = [0], []
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = [*at.tolist(), len(joined)]
    starts = [0, *(at + 1).tolist()]
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    array = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(array), 1 << 16):
        bits = np.unpackbits(array[a : a + (1 << 16)].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(array)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """`doc_id, fp`: the fingerprint as a signed long. Null and wordless texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, width, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def blocking(n: int, radius: int = RADIUS) -> tuple[list[tuple[int, int]], int]:
    """Bit blocks (start, width) and how many of them a key joins.

    Of `radius + m` blocks at least m are equal in any two fingerprints within the radius, so keys of all
    combinations of m blocks lose no link. m grows with the number of fingerprints to keep groups small.
    """
    m = 1 if n < 1 << 21 else 2 if n < 1 << 29 else 3
    edges = np.linspace(0, 64, radius + m + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:])], m


def _keys(fp: Column, blocks: list[tuple[int, int]], m: int) -> Column:
    def piece(a: int, w: int) -> Column:
        return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1))

    keys = []
    for number, chosen in enumerate(combinations(blocks, m)):
        key = F.lit(number).cast("long")
        for a, w in chosen:
            key = F.shiftleft(key, w).bitwiseOR(piece(a, w))
        keys.append(key)
    return F.array(*keys)


def forest(fp: np.ndarray, side: np.ndarray | None, radius: int, turns: int = 1, tile: int = TILE // 4) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within the radius that join what such pairs join, the nearest first: at most 2 * turns a fingerprint.

    In turn each part takes its nearest pair with another part, until none is within the radius. Every further turn
    does so anew with the pairs that are left; so where fewer than `turns` pairs cross between two parts, all are given.
    Tiles are compared as in group_links, but each with the run of all fingerprints whose number of ones isn't too far off.
    """
    ones = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    fp, ones, n = fp[order], ones[order], len(fp)
    side = None if side is None else side[order]
    found = [np.zeros((2, 0), np.int64)]
    for _ in range(turns):
        label, taken = np.arange(n), np.concatenate(found, axis=1)
        while True:
            near, mate = np.full(n, 255), np.zeros(n, np.int64)
            for a in range(0, n, tile):
                low = np.searchsorted(ones, ones[a] - radius)
                high = np.searchsorted(ones, ones[min(a + tile, n) - 1] + radius, side="right")
                x = slice(a, a + tile)
                differing = np.bitwise_count(fp[x, None] ^ fp[None, low:high])
                differing[label[x, None] == label[None, low:high]] = 255
                if side is not None:
                    differing[side[x, None] == side[None, low:high]] = 255
                for i, j in (taken, taken[::-1]):
                    here = (i >= a) & (i < a + tile) & (j >= low) & (j < high)
                    differing[i[here] - a, j[here] - low] = 255
                j = differing.argmin(1)
                near[x], mate[x] = differing[np.arange(len(j)), j], j + low
            open_ = np.flatnonzero(near <= radius)
            if not len(open_):
                break
            by = open_[np.lexsort((near[open_], label[open_]))]
            i = by[np.concatenate([[True], np.diff(label[by]) != 0])]
            j = mate[i]
            found.append(np.stack([i, j]))
            while len(i):
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while not np.array_equal(deeper := label[label], label):
                    label = deeper
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
    left, right = np.concatenate(found, axis=1)
    return order[left], order[right]


def group_links(fp: np.ndarray, side: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within the radius in one group: at most one for each fingerprint.

    The fingerprints are sorted by their number of ones and cut into tiles. Two tiles whose numbers of ones differ
    by more than the radius hold no link and are skipped; other pairs are compared bit by bit. With `side` only
    fingerprints of different sides are compared.
    """
    n = len(fp)
    ones = np.bitwise_count(fp)
    order = np.argsort(ones, kind="stable")
    fp, ones = fp[order], ones[order].astype(np.int64)
    side = None if side is None else side[order]
    label = np.arange(n)
    for a in range(0, n, tile):
        x = fp[a : a + tile]
        for b in range(a, n, tile):
            if ones[b] - ones[min(a + tile, n) - 1] > radius:
                break
            y = fp[b : b + tile]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if side is not None:
                near &= side[a : a + tile, None] != side[None, b : b + tile]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            while len(i):
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                while not np.array_equal(deeper := label[label], label):
                    label = deeper
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
    moved = np.flatnonzero(label != np.arange(n))
    return order[moved], order[label[moved]]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect everything within the radius; not all pairs."""
    n = nodes.count()
    blocks, m = blocking(n, radius)
    rows = nodes.select(F.col("fp").alias("id"), "fp", F.explode(_keys(F.col("fp"), blocks, m)).alias("key"))
    return _in_groups(rows, partial(group_links, radius=radius))


def _in_groups(rows: DataFrame, compare: Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs (a, b) of ids that compare() finds among the rows(id, fp, key) of each key.

    A key of more than BLOCK rows is split: rows are dealt to blocks by a hash, and each pair of blocks is a group.
    """
    large = staged(rows.groupBy("key").count().filter(F.col("count") > BLOCK), "large")  # few: Spark sees the file's size
    rows = rows.join(large, "key", "left").withColumn("k", F.ceil(F.coalesce(F.col("count"), F.lit(1)) / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select(
        "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") > F.col("other")).alias("second"), "id", "fp"
    )
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")  # by id too, so that ties fall alike in every run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            fp, ids = group.column("fp").to_numpy().view(np.uint64), group.column("id").to_numpy()
            cross = group.column("p")[0].as_py() != group.column("q")[0].as_py()
            i, j = compare(fp, group.column("second").to_numpy(zero_copy_only=False) if cross else None)
            return ids[i], ids[j]

        def emit(table: pa.Table) -> pa.RecordBatch:
            at = np.zeros(table.num_rows, bool)
            for name in ("key", "p", "q"):
                x = table.column(name).to_numpy()
                at[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(at).tolist(), table.num_rows]
            found = [of(table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
            ends = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        kept: list[pa.RecordBatch] = []  # of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*kept, batch]).combine_chunks()
            last = [table.column(c)[table.num_rows - 1] for c in ("key", "p", "q")]
            same = pc.and_(pc.and_(pc.equal(table.column("key"), last[0]), pc.equal(table.column("p"), last[1])), pc.equal(table.column("q"), last[2]))
            cut = table.num_rows - pc.sum(same).as_py()
            if cut:
                yield emit(table.slice(0, cut).combine_chunks())
            kept = table.slice(cut).combine_chunks().to_batches()
        if kept:
            yield emit(pa.Table.from_batches(kept).combine_chunks())

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """`id, component`: the least id reachable, for ids that have an edge. edges(u, v).

    Large-star and small-star in turn, each a grouped minimum and a join, until nothing changes; every round is
    written to the shared folder, so a lost executor costs no more than one round.
    """
    state = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = state.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        state = staged(small.distinct(), "edges")


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """`doc_id, fingerprint, component_id` for each row of docs(doc_id, text).

    Documents link if their fingerprints differ in at most `radius` bits; component_id is the least doc_id that
    links reach. Null or empty texts have fingerprint zero and link like others. Equal fingerprints are compared
    once, so groups of copies of any size cost one row. Repeated rows come back as often as they came in; rows
    with a null doc_id are left out, as they can't be named. No rows give no rows; other columns are ignored.
    """
    marked = staged(fingerprints(docs.filter("doc_id is not null"), width, seed), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("root")), "nodes")
    pairs = links(nodes.select("fp"), radius)
    pairs = pairs.join(nodes.select(F.col("fp").alias("a"), F.col("root").alias("u")), "a").join(
        nodes.select(F.col("fp").alias("b"), F.col("root").alias("v")), "b"
    )
    groups = components(pairs.select("u", "v"))
    named = nodes.join(groups, nodes["root"] == groups["id"], "left").select("fp", F.coalesce("component", "root").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_ODD = mix(np.arange(BANDS * VALUES, dtype=np.uint64)) | np.uint64(1)


def word_shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text in lower case, and the n + 1 offsets of each text's.

    A text of fewer words has one, the whole sequence; a text without words has none.
    """
    data, offsets = buffer_of([t.lower() for t in texts])
    starts, ends = runs(_WORD[data])
    words = run_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    size = np.where(count < width, np.minimum(count, 1), count - width + 1)
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(first[:-1] - at[:-1], size) + np.arange(at[-1])  # each shingle's first word
    stop = np.repeat(first[1:], size)
    out = np.zeros(at[-1], np.uint64)
    for k in range(width):
        inside = place + k < stop
        word = words[np.minimum(place + k, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(inside, mix(out * np.uint64(0xD1342543DE82EF95) + word), out)
    return out, at


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`doc_id, version, digest, size, fp, keys`: the text's xxhash64, 128 bits of the words, the number of shingles, their SimHash,
    and a key for each band of least values.

    A text without words has no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 1 << 20):
            texts = texts_of(batch)
            digest = [xxhash.xxh3_128_digest(b" ".join(t.lower().encode("utf-8", "surrogatepass").split())) for t in texts]
            hashes, at = word_shingles(texts, width)
            full = np.flatnonzero(np.diff(at))
            fp, keys = np.zeros(len(texts), np.uint64), np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                start, size = at[full], np.diff(at)[full]
                for byte in range(8):
                    bits = np.unpackbits((hashes >> np.uint64(56 - 8 * byte)).astype(np.uint8)[:, None], axis=1)
                    ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
                    fp[full] = fp[full] << np.uint64(8) | np.packbits(2 * ones > size[:, None], axis=1)[:, 0]
                for k, odd in enumerate(_ODD):
                    band = k // VALUES
                    keys[:, band] = mix(keys[:, band] + np.uint64(band + 1) + np.minimum.reduceat(hashes * odd, start))
            offsets = np.zeros(len(texts) + 1, np.int32)
            offsets[1:] = np.cumsum(np.diff(at) > 0) * BANDS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("version"),
                    pa.array(digest, pa.binary()),
                    pa.array(np.diff(at)),
                    pa.array(fp.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())),
                ],
                ["doc_id", "version", "digest", "size", "fp", "keys"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    return rows.mapInArrow(run, "doc_id long, version long, digest binary, size long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """nodes' columns with `hashes binary`: the sorted distinct shingle hashes of each node(id, doc_id, version), from a row of docs
    with that doc_id and text. Rows repeated in docs give repeated rows."""
    kinds = [(n, t) for n, t in nodes.dtypes if n not in ("doc_id", "version")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            hashes, at = word_shingles(texts_of(batch), width)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in kinds), pa.array(sets, pa.binary())], [*(n for n, _ in kinds), "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version")).join(nodes, ["doc_id", "version"])
    return rows.select(*(n for n, _ in kinds), "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds) + ", hashes binary")


def jaccard_links(ids: np.ndarray, fp: np.ndarray, part: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids of that Jaccard similarity or more that join what such pairs join: no more than one for each id.

    Pairs of one part are joined already. A pair is compared if its SimHashes differ in at most `radius` bits and its
    sets' sizes allow the similarity; a document's shingles are looked up in all its candidates' sets at once. With
    `side` only documents of different sides are compared.
    """
    size = np.array([len(x) for x in sets])
    _, label = np.unique(part, return_inverse=True)
    label = label.copy()
    left, right = [], []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        j = j[(label[j] != label[i]) & (np.bitwise_count(fp[j] ^ fp[i]) <= radius) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]))]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j) or not size[i]:
            continue
        flat = np.concatenate([sets[k] for k in j])
        near = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
        starts = np.concatenate([[0], np.cumsum(size[j])[:-1]])
        shared = np.add.reduceat((sets[i][near] == flat).astype(np.int64), starts)
        for k in j[shared >= similarity * (size[i] + size[j] - shared)].tolist():
            if label[k] != label[i]:
                left.append(ids[i])
                right.append(ids[k])
                label[label == label[k]] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs(a, b) of nodes(id, doc_id, version) whose texts have that share of common shingles or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                shared = int((x[at] == y).sum()) if len(x) and len(y) else 0
                keep[i] = shared >= similarity * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = staged(shingle_sets(docs, nodes.join(ends, "id", "left_semi").select("id", "doc_id", "version"), width), "sets")
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a")
    rows = rows.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b")
    return rows.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def left_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, parts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = WIDE, shingles: int = SHINGLES, own: int = OWN) -> DataFrame:
    """Pairs (a, b) of nodes(id, doc_id, version, size, fp) that join the parts of a group, if any pair across them is alike.

    groups(id, component): what candidates join; parts(id, component): what pairs of them found alike join; both without
    the nodes that stand alone. Groups of one part are done. In the others all documents within the radius of different parts
    are compared, block by block: blocks hold about `shingles` shingles, a large part has blocks of its own, and those are
    never paired with each other, so a large part meets the group's other documents alone.
    """
    rows = nodes.join(groups.withColumnRenamed("component", "grp"), "id").join(parts.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    split = rows.groupBy("grp").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("grp")
    rows = staged(rows.join(split, "grp", "left_semi").select("grp", "part", "id", "doc_id", "version", "size", "fp"), "split")
    large = rows.groupBy("grp", "part").agg(F.sum("size").alias("total")).withColumn("large", F.col("total") > own)
    few = large.filter(~F.col("large")).groupBy("grp").agg(F.sum("total").alias("rest")).select("grp", F.ceil(F.col("rest") / shingles).cast("int").alias("few"))
    before = Window.partitionBy("grp").orderBy("part")  # over the large parts of a group
    much = large.filter("large").select("grp", "part", F.ceil(F.col("total") / shingles).cast("int").alias("mine"))
    much = much.withColumn("upto", F.sum("mine").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = staged(much.groupBy("grp").agg(F.max("upto").alias("all")), "all")
    much, few = staged(much, "much"), staged(few, "few")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    rows = rows.join(few, "grp", "left").join(last, "grp", "left").join(much, ["grp", "part"], "left").withColumns({c: zero(c) for c in ("few", "all")})
    rows = rows.withColumn("k", F.col("few") + F.col("all")).withColumn("low", zero(F.col("few") + F.col("upto") - F.col("mine")))
    deal = F.pmod(F.xxhash64("id"), F.greatest(zero("mine"), F.lit(1))).cast("int")
    rows = rows.withColumn("at", F.when(F.col("mine").isNull(), F.pmod(F.xxhash64("id"), F.greatest("few", F.lit(1))).cast("int")).otherwise(F.col("low") + deal))
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda b: F.col("mine").isNull() | (b < F.col("low")) | (b >= F.col("low") + F.col("mine")))
    rows = shingle_sets(docs, rows.select("grp", "part", "id", "doc_id", "version", "fp", "at", others.alias("others")), width)
    rows = rows.select("grp", "part", "id", "fp", "hashes", "at", F.explode("others").alias("other"))
    rows = rows.select("grp", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"), (F.col("at") > F.col("other")).alias("second"), "part", "id", "fp", "hashes")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        ids = group.column("id").to_numpy()
        once = np.concatenate([[True], ids[1:] != ids[:-1]])  # of repeated rows
        group, ids = group.filter(pa.array(once)), ids[once]
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in group.column("hashes")]
        side = group.column("second").to_numpy(zero_copy_only=False) if key[1].as_py() != key[2].as_py() else None
        found = jaccard_links(ids, group.column("fp").to_numpy().view(np.uint64), group.column("part").to_numpy(), sets, side, similarity, radius)
        return pa.Table.from_arrays([pa.array(x) for x in found], ["a", "b"])

    return rows.groupBy("grp", "p", "q").applyInArrow(compare, "a long, b long")


def similar_documents(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = WIDE) -> DataFrame:
    """`doc_id, component_id` for each row of docs(doc_id, text): groups by links of `similarity` or more.

    Two documents link if their sets of `width`-word shingles (lower case) have that Jaccard similarity; component_id is
    the least doc_id that links reach. Documents that share a band of least values are compared bit by bit in tiles;
    the nearest pairs within the radius that hold a group together have their shingles compared. Where that leaves a
    group in parts, all its documents of different parts within the radius are compared, so a link is lost only if
    neither its documents nor others lead from one to the other by bands and the radius (README has the recall).
    Texts of the same words collapse first, so groups of copies of any size cost one row; texts without words are such
    copies of each other; different texts of one doc_id are one document. Null texts are empty; texts of any length are
    taken whole. Repeated rows come back as often as they came in; rows with a null doc_id are left out; no rows give no
    rows; other columns are ignored.
    """
    docs = docs.filter("doc_id is not null")
    marked = staged(signatures(docs, width), "signatures")
    nodes = marked.groupBy("digest").agg(F.min(F.struct("doc_id", "version", "size", "fp", "keys")).alias("n"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("id"), "digest", "n.*"), "nodes")
    rows = nodes.select("id", "fp", F.explode("keys").alias("key"))
    found = _in_groups(rows, partial(forest, radius=radius)).filter("a <> b")
    pairs = staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    groups, alikes = staged(components(pairs.toDF("u", "v")), "groups"), staged(alike(pairs, docs, nodes, width, similarity), "alike")
    parts = components(alikes.toDF("u", "v"))
    joined = left_links(docs, nodes.select("id", "doc_id", "version", "size", "fp"), groups, parts, width, similarity, radius)
    members = staged(marked.select("doc_id", "digest").join(nodes.select("digest", "id"), "digest").select("doc_id", "id"), "members")
    several = members.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("_most")).filter("v <> _most").select("doc_id", "v")
    own = members.join(staged(several, "several"), "doc_id").select(F.col("id").alias("u"), "v")
    whole = components(alikes.unionByName(joined).toDF("u", "v").unionByName(own))
    named = members.join(whole, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = staged(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "component").select("doc_id", "component_id")
