"""Views of the given tables under the names the operators use, each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlens.operators.splits import hash_rank_split

CELL = ["action", "detector"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector scores: event_id, user_id, action, label (1 fake), detector, score, pool."""
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("action"),
        (F.col("event_id") % 2).cast("int").alias("label"),
        (F.col("event_id") % 3).cast("int").alias("detector"),
        F.col("value").alias("score"),
    )
    return hash_rank_split(rows, ["user_id", "action"], "event_id", seed="7")


def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw touch rows: user_id, act_id, evt_t (ms), code, x, y, source_row."""
    code = F.element_at(F.array(*map(F.lit, [0, 2, 2, 1, 2, 3, 5])), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("user_id").alias("act_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("evt_t"),
        code.alias("code"),
        F.col("value").alias("x"),
        (F.col("value") * 0.5).alias("y"),
        F.col("event_id").alias("source_row"),
    )


def rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of sessions: user_id, session_id (days since 1970), action, start_ms, end_ms, event_id."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.floor(start / 86_400_000).cast("long").alias("session_id"),
        F.col("event_type").alias("action"),
        start.alias("start_ms"),
        (start + F.floor("value").cast("long")).alias("end_ms"),
        "event_id",
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor windows as long rows: vec_id, label, i, v."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with durations: duration, score, label, arm, pool."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("duration"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_linestatus").alias("arm"),
        F.when(F.col("l_orderkey") % 2 == 0, "train").otherwise("test").alias("pool"),
    )


SCORES = """ranked AS (SELECT event_id, user_id, event_type AS action, CAST(event_id % 2 AS INTEGER) AS label, CAST(event_id % 3 AS INTEGER) AS detector, value AS score,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY sha256(concat_ws('|', '7', user_id, event_type, event_id)), event_id) AS rn,
  count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
scores AS (SELECT event_id, user_id, action, label, detector, score,
  CASE WHEN rn <= floor(CAST(0.6 AS DOUBLE) * n) THEN 'train' WHEN rn <= floor(CAST(0.6 AS DOUBLE) * n) + floor(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS pool FROM ranked)"""
TOUCH = """touch AS (SELECT user_id, user_id AS act_id, epoch_us(ts) // 1000 AS evt_t, [0, 2, 2, 1, 2, 3, 5][event_id % 7 + 1] AS code, value AS x, value * 0.5::DOUBLE AS y,
  event_id AS source_row FROM events)"""
RHYTHM = """rhythm AS (SELECT user_id, CAST(floor((epoch_us(ts) // 1000) / 86400000) AS BIGINT) AS session_id, event_type AS action, epoch_us(ts) // 1000 AS start_ms,
  epoch_us(ts) // 1000 + CAST(floor(value) AS BIGINT) AS end_ms, event_id FROM events)"""
WINDOWS = """windows AS (SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
BINS = """bins AS (SELECT l_quantity AS duration, l_extendedprice AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label, l_linestatus AS arm,
  CASE WHEN l_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS pool FROM lineitem)"""
