"""Repeated passages by content-defined chunks with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from padlens.llm.common import buffer_of, mix, runs, slices, staged, texts_of

#: Units on either side that a cut's hash exceeds, units in every run of which one ends a chunk, words of a compared passage.
NEAR, REACH, LEAST_WORDS = 3, 10, 12
#: Least words of a span. Of 51 repeated words some run of REACH within the first 17 holds a cut that both places share and another
#: one within the last 22, so their passages cover 25 or more. In long words each WORD_BYTES bytes count as a word.
LEAST_RUN = 22
#: Words of more bytes are cut into pieces; in every run of PIECE bytes one ends.
LONG_WORD, PIECE, WORD_BYTES = 48, 12, 6

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash: twice shifted per byte, so the last 16 bytes count; computed by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint32(2 * width))
    return h


def picked(value: np.ndarray, before: np.ndarray, after: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the greatest, and the last of equal ones, in some run of `width` places; none below zero.

    before and after: how many places of the same text stand on either side. Each run holds such a place if one of its
    values isn't negative, and which one depends on the run alone.
    """
    reach = np.ones(len(value), np.int64)
    for side in (0, 1):
        held = value >= 0
        room = after if side else before
        for k in range(1, min(width, len(value))):
            held[-k if side else 0 : None if side else k] = False
            if side:
                held[:-k] &= value[k:] < value[:-k]
            else:
                held[k:] &= value[:-k] <= value[k:]
            held &= room >= k
            reach += held
    return (value >= 0) & (reach >= width)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last byte, end without white space, weight and hash (-1 in a text's first 16 bytes) of each unit.

    A unit is a word with the white space behind it, of weight WORD_BYTES, or a piece of a long word, whose weight is
    its number of bytes. Pieces end between characters, where the hash of the 16 bytes before is greatest.
    """
    gap = _SPACE[data]
    last, stop = gap.copy(), gap.copy()
    last[:-1] &= ~gap[1:]  # the last white space of a run
    last[offsets[1:] - 1] = True
    stop[1:] &= ~gap[:-1]  # and the first
    stop[offsets[:-1]] = gap[offsets[:-1]]
    at, end = np.flatnonzero(last), np.flatnonzero(stop)
    begin = np.concatenate([[0], at[:-1] + 1])
    rolled = (mix(gear(data).astype(np.uint64)) >> np.uint64(16)).astype(np.int64)
    light = np.zeros(len(at), bool)
    long = np.flatnonzero(end - begin > LONG_WORD)
    if len(long):
        size = (end - begin)[long]
        before = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(begin[long], size) + before
        after = np.repeat(size, size) - 1 - before
        text = np.searchsorted(offsets, place, side="right") - 1
        value = np.where(((data[place + 1] & 0xC0) == 0x80) | (place - offsets[text] < 15), -1, rolled[place])
        value[after == 0] = -1  # the word's own end
        inner = place[picked(value, before, after, PIECE)]
        at, order = np.unique(np.concatenate([at, inner]), return_index=True)
        end = np.concatenate([end, inner + 1])[order]
        begin = np.concatenate([[0], at[:-1] + 1])
        light = np.zeros(len(data), bool)
        light[place] = True
        light = light[begin]
    weight = np.where(light, end - begin, WORD_BYTES)
    text = np.searchsorted(offsets, at, side="right") - 1
    return at, end, weight, np.where(at - offsets[text] < 16, -1, rolled[at])


def chosen(at: np.ndarray, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Units that end a chunk: the greatest hash among NEAR units on either side, and where REACH units in a row hold
    none, the greatest of these; so every such row holds a cut, and cuts move with their text.

    Where the hash stays the same for REACH units, a chunk ends where that begins and ends and every REACH units between.
    The same count from the last cut holds in a text's first 16 bytes.
    """
    n = len(at)
    number = np.arange(n)
    doc = np.searchsorted(offsets, at, side="right") - 1
    final = np.searchsorted(at, offsets[1:] - 1)
    first = np.concatenate([[0], final[:-1] + 1])
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (h[1:] >= 0) & (doc[1:] == doc[:-1])
    value = np.where(same, -1, h)
    cut = (value >= 0) & (number - first[doc] >= NEAR) & (final[doc] - number >= NEAR)
    for k in range(1, NEAR + 1):
        cut[k:] &= value[k:] > value[:-k]
        cut[:-k] &= value[:-k] > value[k:]
    left = np.maximum(np.maximum.accumulate(np.where(cut, number + 1, 0)), first[doc])  # after the cut before
    right = np.minimum(np.minimum.accumulate(np.where(cut, number, n)[::-1])[::-1] - 1, final[doc])
    cut |= picked(np.where(cut, -1, value), number - left, right - number, REACH)
    a, b = runs(same)
    steady = b - a >= REACH - 1
    cut[a[steady] - 1] = True
    cut[b[steady] - 1] = True
    cut[final] = True
    ends = np.flatnonzero(cut)
    size = np.diff(ends, prepend=-1)
    far = np.flatnonzero(size > REACH)
    if len(far):
        begin = ends[far] - size[far]
        ends = np.unique(np.concatenate([ends, *[np.arange(b + REACH, e, REACH) for b, e in zip(begin.tolist(), ends[far].tolist())]]))
    return ends


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End offsets of all chunks, and the number of units in each. data: texts that each end in a line feed."""
    at, _, _, h = units(data, offsets)
    ends = chosen(at, h, offsets)
    return at[ends] + 1, np.diff(ends, prepend=-1)


def passages(data: np.ndarray, offsets: np.ndarray, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Text number, start, end without white space, end, and weight before it in its text, of each passage.

    From each chunk's start, and up to each text's end, the fewest units that weigh as much as least_words words, a unit
    as much as one word at most, so that a passage reaches the next cut. Texts that weigh less have none.
    """
    at, end, weight, h = units(data, offsets)
    passed = np.cumsum(weight) - weight
    total = np.cumsum(np.minimum(weight, WORD_BYTES))
    before = total - np.minimum(weight, WORD_BYTES)
    final = np.searchsorted(at, offsets[1:] - 1)
    least = least_words * WORD_BYTES
    tail = np.searchsorted(before, total[final] - least, side="right") - 1
    head = np.concatenate([[0], final[:-1] + 1])
    ends = tail >= head
    begin = np.concatenate([[0], chosen(at, h, offsets)[:-1] + 1])
    stop = np.concatenate([np.searchsorted(total, before[begin] + least), final[ends]])
    begin = np.concatenate([begin, tail[ends]])
    doc = np.searchsorted(final, begin)
    fits = stop <= final[doc]
    begin, stop = np.unique(np.stack([begin[fits], stop[fits]]), axis=1)
    doc = np.searchsorted(final, begin)
    start = np.where(begin > 0, at[begin - 1] + 1, 0)
    return doc, start, end[stop], at[stop] + 1, passed[begin] - passed[head][doc]


def passage_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`doc_id, version, passages array<struct<digest, check, start, stop, weight>>`: offsets in bytes of the UTF-8 text, version its
    64-bit hash, digest and check 96 bits of the passage's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, low = xxhash.xxh3_128_intdigest, (1 << 96) - 1
        for batch in slices(batches, 1 << 20):
            data, offsets = buffer_of(texts_of(batch))
            doc, start, end, stop, weight = passages(data, offsets, least_words)
            raw = data.tobytes()
            keys = b"".join([(digest(raw[a:b]) & low).to_bytes(12, "little") for a, b in zip(start.tolist(), end.tolist())])
            keys = np.frombuffer(keys, np.dtype([("digest", "<i8"), ("check", "<i4")]))
            base = offsets[doc]
            stop = np.minimum(stop, offsets[doc + 1] - 1)  # without the added line feed
            numbers = [pa.array(x.astype(np.int32)) for x in (start - base, stop - base, weight)]
            parts = pa.StructArray.from_arrays([pa.array(keys["digest"].copy()), pa.array(keys["check"].copy()), *numbers], ["digest", "check", "start", "stop", "weight"])
            of = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("version"), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), parts)], ["doc_id", "version", "passages"]
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(
        run, "doc_id long, version long, passages array<struct<digest: long, check: int, start: int, stop: int, weight: int>>"
    )


def versions(table: DataFrame) -> DataFrame:
    """The doc_ids of several texts among table(doc_id, version): `doc_id, several` (true)."""
    found = table.groupBy("doc_id").agg(F.min("version").alias("a"), F.max("version").alias("b")).filter("a < b")
    return staged(found.select("doc_id", F.lit(True).alias("several")), "versions")  # Spark knows its size


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """`doc_id, version, span_start, span_stop, n_chunks, n_words, first_doc_id`: byte ranges whose text came before.

    Passages of `least_words` words (in long words: as many times WORD_BYTES bytes) are compared from each chunk's
    start. Of equal passages the first (least doc_id, version, position) stays; others that overlap make one span, with the
    white space behind it. Spans of fewer than `least_run` words, such as a licence line, are left alone. A repeat loses
    at most the bytes and units up to its first cut and after its last one, so none of over 50 words is missed. n_chunks
    counts a span's passages; first_doc_id is the least document that holds any of them first; it equals doc_id where a
    text repeats itself. Passages are equal if 96 bits of their hashes are.

    Null and empty texts have no span; texts of any length are read whole; rows without doc_id are left out. Rows repeated
    with the same doc_id and text count as one document, rows of one doc_id with different texts as one each: there
    `version` is the text's xxhash64, else 0. No rows give no rows.
    """
    table = staged(passage_table(docs.filter("doc_id is not null and text <> ''"), least_words), "passages")
    known = table.join(versions(table), "doc_id", "left").withColumn("version", F.when(F.col("several"), F.col("version")).otherwise(F.lit(0)))
    rows = known.select("doc_id", "version", F.posexplode("passages").alias("i", "c")).select("doc_id", "version", "i", "c.*")
    first = rows.groupBy("digest", "check").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "i")).alias("f")).filter("n > 1")
    first = staged(first.select("digest", "check", "f"), "repeated")  # few; a join of two shuffles, which Spark splits at digests of many rows
    again = rows.join(first, ["digest", "check"]).filter(F.struct("doc_id", "version", "i") != F.col("f"))
    again = again.select("doc_id", "version", "i", "start", "stop", "weight", F.col("f.doc_id").alias("first")).distinct()  # of repeated rows
    order = Window.partitionBy("doc_id", "version").orderBy("i")
    again = again.withColumn("reached", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    again = again.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reached"), 0).otherwise(1)).over(order))
    return again.groupBy("doc_id", "version", "island").agg(
        F.min("start").cast("long").alias("span_start"),
        F.max("stop").cast("long").alias("span_stop"),
        F.count("*").alias("n_chunks"),
        ((F.max("weight") - F.min("weight")) / WORD_BYTES + least_words).cast("long").alias("n_words"),
        F.min("first").alias("first_doc_id"),
    ).filter(F.col("n_words") >= least_run).drop("island")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans, which repeated_spans found in docs, cut out of their texts and n_chars counted anew; all rows and columns stay.

    Rows repeated with the same doc_id and text are cut alike; where a doc_id has several texts, each is cut by the spans
    of its version. Null and empty texts and rows without doc_id stay as they are; texts of any length are cut whole.
    """
    schema = docs.schema
    name = "_cuts" + "_" * max(map(len, schema.names))  # longer than any name, so it can't clash
    version = name + "_"
    cuts = spans.groupBy("doc_id", F.col("version").alias(version)).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_stop"))).alias(name))
    several = staged(spans.filter("version <> 0").select("doc_id", F.lit(True).alias(name)).distinct(), "several")  # Spark knows its size
    known = docs.join(several, "doc_id", "left").withColumn(version, F.when(F.col(name), F.xxhash64("text")).otherwise(F.lit(0))).drop(name)
    joined = known.join(cuts, ["doc_id", version], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist()):
                if spans and text:
                    raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
                    for s in spans:
                        kept.append(raw[at : s["span_start"]])
                        at = s["span_stop"]
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    out = joined.select(*schema.names, name).mapInArrow(run, schema)
    if "n_chars" in schema.names:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*schema.names)
    return out
