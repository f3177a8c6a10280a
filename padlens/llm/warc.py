"""WARC archives: written by Spark's text sink, read back in splits by the chain of record boundaries.

A record begins with the line `WARC/1.1`, and its Content-Length says where the next one begins. A payload may hold that
line too, so a reader that starts in the middle of a file can't tell records from look-alikes. Here each task takes every
such line of its split as a candidate, works out where its successor would begin, follows the successors that fall
into its own split, and emits where each candidate's chain leads out of it. From the start of each file pointer jumping
over these links, twice as far each turn, finds the one entry of each split that the chain of true records reaches; the
second pass reads records from there on, and look-alikes inside of payloads are never met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from padlens.llm.common import staged

#: Fixed values of the format: first line, the end of the header and of the record, the profile of a repeated payload.
MAGIC, BREAK, PROFILE = "WARC/1.1\r\n", "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are stored each.
LEAST_BYTES = 100
#: Splits, a row of some 100 bytes each, whose entries are broadcast; those of more are joined by a shuffle and a sort.
BROADCAST_SPLITS = 200_000
#: The records' date, as pages have none.
DATE = "1970-01-01T00:00:00Z"

_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*?)[ \t]*\Z")


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Writes a record for each row of pages(page_id, url, html) to a new folder: a file for each partition.

    Of rows with equal payloads of at least `least` bytes those of the least page_id are responses, the others revisits
    that refer to it. A row without page_id is a response without a page's name. Null html is an empty payload; a url's
    control characters are escaped, null leaves its field out.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html, 256).alias("digest"))
    known = rows.filter(F.col("page_id").isNotNull() & (F.col("n") >= least)).groupBy(F.unhex("digest").alias("same"))
    first = known.agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select(F.lower(F.hex("same")).alias("digest"), "first")
    first = staged(first, "repeated")  # repeated payloads alone: Spark knows their size; a digest of many rows it splits
    rows = rows.join(first, "digest", "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    name = F.when(F.col("page_id").isNull(), F.concat(F.lit("<urn:sha256:"), "digest", F.lit(">"))).otherwise(F.format_string("<urn:page:%d>", "page_id"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.when(again, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(again, F.format_string("WARC-Refers-To: <urn:page:%d>", "first")),
        F.when(again, f"WARC-Profile: {PROFILE}"),
        F.when(again, F.format_string("X-Payload-Length: %d", "n")),
        F.lit("Content-Type: text/html"),
        F.format_string("Content-Length: %d", F.when(again, 0).otherwise(F.col("n"))),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(BREAK), F.when(again, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", BREAK).text(path)  # the sink ends each record as the format asks


def header_of(text: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """The fields (names in lower case) of a record's header, which `text` begins with after the first line, and where its
    block begins; None if there is no whole header with type, id and length."""
    end = text.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in text[:end].split(b"\r\n"):
        found = _FIELD.match(line)
        if not found:
            return None
        fields[found[1].lower()] = found[2]
    if not {b"warc-type", b"warc-record-id"} <= fields.keys() or not re.fullmatch(rb"[0-9]{1,18}", fields.get(b"content-length", b"")):
        return None
    return fields, end + 4


def segments(spark: SparkSession, path: str) -> DataFrame:
    """`file, split, place, text binary`: the bytes between one first line of a record and the next, whatever they are. `place`
    grows with the place in the file within each split; each segment belongs to one split, and its rows come in that order."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return rows.select(*at, F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("text"))


def _walk(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[tuple[tuple, int, bytes | None]]:
    """For each segment: (file, split, values of the other columns), where its first line begins, counted from where the split's
    first segment's text begins, and its bytes; after a split's last one its length with None for the bytes.

    The first segment of a file has no first line before it; it too is given as if it had.
    """
    key, at = None, 0
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("file", "split", *others)]
        for text, *new in zip(batch.column("text"), *columns):
            if key is not None and key[:2] != tuple(new[:2]):
                yield key, at, None
                key = None
            if key is None:
                key, at = tuple(new), 0
            raw = text.as_py()
            yield key, at - len(MAGIC), raw
            at += len(raw) + len(MAGIC)
    if key is not None:
        yield key, at, None


def _end(place: int, head: tuple[dict[bytes, bytes], int]) -> int:
    """Where the record ends whose first line begins at `place`."""
    return place + len(MAGIC) + head[1] + int(head[0][b"content-length"]) + len(BREAK)


def links(spark: SparkSession, path: str) -> DataFrame:
    """`file, split, at, next, size`: for each candidate of a split the end of the record by which its chain leaves the split,
    null if it breaks off inside; at and next count from the split's first segment. A row without `at` for each split
    has the split's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (file, split), place, raw in _walk(batches, []):
            if raw is not None:
                head = None if split == 0 and place < 0 else header_of(raw)
                if head:
                    found.append((place, _end(place, head)))
                continue
            leads: dict[int, int | None] = {}
            for at, end in reversed(found):
                leads[at] = leads.get(end) if end < place - len(MAGIC) else end
            rows = [(None, None), *((at, leads[at]) for at, _ in found)]
            found = []
            for k in range(0, len(rows), 10_000):
                some = rows[k : k + 10_000]
                numbers = [pa.array(c, pa.int64()) for c in ([split] * len(some), *zip(*some), [place] * len(some))]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), *numbers], ["file", "split", "at", "next", "size"])

    return segments(spark, path).select("file", "split", "text").mapInArrow(run, "file string, split long, at long, next long, size long")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """`file, split, entry, carry`, a row for each split: where the first record begins that starts in it (null: none does), and
    where the record ends that runs into it, counted from its first segment.

    Pointer jumping: `reached` begins with the start of each file; each turn adds what the links lead to from there, and
    then joins the links with themselves, so that they lead twice as far. The turns are the logarithm of the splits of
    the longest file; only candidates that some link leads to take part.
    """
    table = staged(links(spark, path), "links")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each split
    parts = table.filter("at is null").select("file", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    parts = staged(parts, "splits")
    nodes = table.filter("at is not null").join(parts, ["file", "split"]).select("file", "split", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("next")).alias("next"))
    starts = parts.select("file", F.lit(0).cast("long").alias("at")).distinct()
    aims = nodes.filter("next is not null").select("file", F.col("next").alias("at")).unionByName(starts).distinct()
    places = staged(nodes.join(aims, ["file", "at"], "left_semi"), "jumps")
    jump = places.filter("next is not null").select("file", "at", "next")
    reached, n = starts, -1
    while n != (n := (reached := staged(reached, "reached")).count()):
        step = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = reached.unionByName(step).distinct()
        jump = staged(jump.join(jump.select("file", F.col("at").alias("next"), F.col("next").alias("then")), ["file", "next"]).select("file", "at", F.col("then").alias("next")), "jumps")
    found = places.join(reached, ["file", "at"]).groupBy("file", "split").agg(F.min("at").alias("at"), F.max("next").alias("next"))
    marks = parts.join(found, ["file", "split"], "left").withColumn("carry", F.max("next").over(before) - F.col("base"))
    return marks.select("file", "split", (F.col("at") - F.col("base")).alias("entry"), "carry")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "split": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "block": pa.binary(), "missing": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def read(spark: SparkSession, path: str, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """`headers map<string,string>, block binary`: every record of the archives at `path`, field names in lower case.

    Records are those that a file's start leads to, each by its length; of a field given twice the last one counts. Where
    the chain breaks off (no header, or a length that leads to no record) nothing behind is read; a block that the file's
    end cuts short is left out. Blocks are read when they are asked for and pass no shuffle, but for those that run over the
    segments of several splits; where there are such, the archives are read once more for them. An empty file has no records.
    """
    marks = staged(entries(spark, path), "entries")
    rows = segments(spark, path)
    if marks.count() <= broadcast_splits:
        rows = rows.join(F.broadcast(marks), ["file", "split"])
    else:
        rows = rows.join(marks, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        head, pieces, missing, after = None, [], 0, None  # of the record being put together; after: where the next one begins
        fresh = True
        for (file, split, entry, carry), place, raw in _walk(batches, ["entry", "carry"]):
            if fresh:
                after, fresh = entry, False
            if raw is None:
                if pieces:
                    out.append((file, split, head, b"".join(pieces), None if head is None else missing))
                head, pieces, missing, fresh = None, [], 0, True
            elif head is None and carry is not None and place < carry:
                pieces.append(MAGIC.encode() + raw)  # of a record that began in an earlier split, which knows its length
            elif place == after:
                if pieces:
                    out.append((file, split, None, b"".join(pieces), None))
                head, pieces, after = header_of(raw), [], None
                if head:
                    begin, after = head[1], _end(place, head)
                    missing = int(head[0][b"content-length"])
                    head = [(k.decode("latin-1"), v.decode("utf-8", "replace")) for k, v in head[0].items()]
                    pieces = [raw[begin : begin + missing]]
                    missing -= len(pieces[0])
            elif head is not None:
                pieces.append((MAGIC.encode() + raw)[:missing])  # what looks like a record lies in the block
                missing -= len(pieces[-1])
            if head is not None and not missing:
                block = b"".join(pieces)
                out.append((file, split, head, block, 0))
                held += len(block)
                head, pieces = None, []
            if out and (held > 4 << 20 or len(out) >= 1000):
                yield _records(out)
                out, held = [], 0
        if out:
            yield _records(out)

    schema = "file string, split long, headers map<string,string>, block binary, missing long"
    found = rows.select("file", "split", "entry", "carry", "text").mapInArrow(run, schema)
    whole = found.filter("missing = 0").select("headers", "block")
    if marks.filter(F.col("carry") > -len(MAGIC)).isEmpty():  # no record runs over the segments of several splits
        return whole
    order = Window.partitionBy("file").orderBy("split", F.col("headers").isNotNull())
    cut = found.filter("missing is null or missing > 0").withColumn("owner", F.last(F.when(F.col("headers").isNotNull(), F.col("split")), True).over(order))
    cut = cut.filter("owner is not null").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("split", F.col("headers").isNull().alias("later"), "block"))).alias("pieces"),  # one record's
        F.max(F.when(F.col("headers").isNotNull(), F.octet_length("block") + F.col("missing"))).alias("length"),
        F.first(F.col("headers"), True).alias("headers"),
    )
    joined = F.aggregate(F.transform("pieces", lambda p: p["block"]), F.lit(b""), lambda a, b: F.concat(a, b))
    cut = cut.select("headers", joined.alias("block"), "length").filter(F.octet_length("block") >= F.col("length"))
    return whole.unionByName(cut.select("headers", F.expr("substring(block, 1, cast(length as int))").alias("block")))


def pages_of(records: DataFrame) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of records that `write` made: both of the full
    payload, which a revisit states, as it holds none. page_id is null for a page without one."""
    field = lambda name: F.try_element_at("headers", F.lit(name))
    number = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    again = field("warc-type") == "revisit"
    return records.select(
        number("warc-record-id").alias("page_id"),
        F.when(again, field("x-payload-length").cast("long")).otherwise(F.octet_length("block").cast("long")).alias("payload_bytes"),
        F.when(again, F.regexp_extract(field("warc-payload-digest"), "^sha256:([0-9a-f]{64})$", 1)).otherwise(F.sha2("block", 256)).alias("payload_digest"),
        field("warc-type").alias("record_type"),
        F.when(again, number("warc-refers-to")).alias("refers_to"),
    )
