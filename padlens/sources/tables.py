"""Readers and writers of the library's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the raw touch rows and of the one-finger rows.
TOUCH = "sys_t evt_t act_id pointer_count pointer_id action x y pressure size orient".split()
ONE_FINGER = "sys_t evt_t act_id tap_id tap_type action x y pressure size orient".split()
WHOLE = {"sys_t", "evt_t", "act_id", "pointer_count", "pointer_id", "tap_id", "tap_type", "action", "orient"}
# Columns of the accelerometer rows.
SENSOR = "t x y z".split()


def cleaned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to numbers, those in WHOLE to integers; a row with any cell that isn't a number goes."""
    typed = rows.withColumns({c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in columns}).na.drop(subset=columns)
    return typed.withColumns({c: F.col(c).cast("long") for c in columns if c in WHOLE})


def touch_csv(spark: SparkSession, path: str, columns: list[str] = TOUCH) -> DataFrame:
    """Scan without a header, with user and session from the path and an ingest ordinal.

    The ordinal keeps a file's order: files are read whole by one task up to maxPartitionBytes, and its value rises
    with the position in the scan.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path).select(
        "*", F.regexp_extract(F.input_file_name(), r"/(\d+)/(\d+)/[^/]*$", 1).alias("user_id"), F.regexp_extract(F.input_file_name(), r"/(\d+)/(\d+)/[^/]*$", 2).alias("session_id")
    )
    return cleaned(raw, columns).withColumn("source_row", F.monotonically_increasing_id())


def score_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzip JSON lines; the cell comes from the folder names action/modality/detector."""
    schema = "event_id long, user_id long, session_id long, action string, label int, fake_high_score double"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    cell = r"/([^/]+)/([^/]+)/([^/]+)/[^/]*$"
    return rows.withColumn("action", F.coalesce("action", F.regexp_extract(F.input_file_name(), cell, 1))).withColumns(
        {"modality": F.regexp_extract(F.input_file_name(), cell, 2), "detector": F.regexp_extract(F.input_file_name(), cell, 3)}
    )


def threshold_files(spark: SparkSession, path: str) -> DataFrame:
    """Per-cell scalars, with a mark where direction, split or target aren't the agreed ones."""
    rows = spark.read.schema("frr5 double, eer double, score_direction string, selection_split string, target_frr double").option("multiLine", "true").json(path)
    fine = (F.col("score_direction") == "larger_is_more_fake") & (F.col("selection_split") == "val") & (F.col("target_frr") == 0.05)
    return rows.withColumn("valid", F.coalesce(fine, F.lit(False)))


def to_ragged(points: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Long rows to one row for each event with an ordered array."""
    return points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("points"))


def from_ragged(events: DataFrame, key: str) -> DataFrame:
    """Back to long rows."""
    return events.select(key, F.explode("points").alias("p")).select(key, "p.*")


def write_events(rows: DataFrame, path: str) -> None:
    """Partitioned by action, each action in several files; Spark's committer makes the folder appear whole."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(16))
    rows.repartition("action", salt).write.mode("overwrite").partitionBy("action").parquet(path)


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Counts by action, status and reason, with subtotals."""
    return audit.rollup("action", "status", "reason").agg(F.count("*").alias("n"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """Order-free content hash of a table: row count, sum of row hashes, and the schema's hash."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
    part = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    schema = F.sha2(F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(rows.schema, key=lambda f: f.name))), 256)
    return rows.agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("hash")).withColumn("schema_hash", schema)


def genuine_windows(samples: DataFrame, split: str, least: int = 2) -> DataFrame:
    """Genuine events of one split with at least two rows, user kept. samples(event, user_id, label, pool, t_ms, ...)."""
    rows = samples.filter((F.col("pool") == split) & (F.col("label") == 0))
    return rows.join(rows.groupBy("event").count().filter(F.col("count") >= least).select("event"), "event", "left_semi")
