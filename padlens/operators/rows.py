"""Row-level rules, pools and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens that mean a correction.
CORRECTION = ["backspace", "delete", "del", "<bs>", "keycode_del", "\b"]


def pointer_semantics(rows: DataFrame) -> DataFrame:
    """Gestures whose pointers don't suit the action: pinch needs two at once and two in all, others one.

    rows(gesture, action, pointer_count, pointer_id).
    """
    g = rows.groupBy("gesture", "action").agg(F.max("pointer_count").alias("most"), F.countDistinct("pointer_id").alias("pointers"))
    fits = F.when(F.col("action") == "pinch", (F.col("most") == 2) & (F.col("pointers") == 2)).otherwise((F.col("most") == 1) & (F.col("pointers") == 1))
    return g.withColumn("fits", fits)


def one_orientation(rows: DataFrame) -> DataFrame:
    """Gestures with one orientation that is the label's, unless the label's is -1. rows(gesture, orient, label_orient)."""
    g = rows.groupBy("gesture").agg(F.countDistinct("orient").alias("n"), F.min("orient").alias("orient"), F.min("label_orient").alias("label_orient"))
    return g.filter((F.col("n") == 1) & ((F.col("label_orient") == -1) | (F.col("label_orient") == F.col("orient")))).select("gesture", "orient")


def canonical_keycode(code: Column) -> Column:
    """P5: negative codes are 0; codes over 16383 are errors, here null."""
    return F.when(code < 0, 0).when(code > 16383, None).otherwise(code)


def key_token(code: Column) -> Column:
    """The letter of an ASCII letter's code, else keycode_N."""
    letter = code.between(65, 90) | code.between(97, 122)
    return F.when(letter, F.chr(code)).otherwise(F.concat(F.lit("keycode_"), code.cast("string")))


def is_correction(token: Column) -> Column:
    """P7."""
    return F.lower(F.trim(token)).isin(*CORRECTION)


def record_contract(frames: DataFrame) -> DataFrame:
    """Broken rules of frames(event, t_ms, i, contact, active, gap, x): rule, event, how many."""
    order = Window.partitionBy("event").orderBy("i")
    rules = {
        "time_runs_back": F.col("t_ms") < F.col("_before"),
        "active_without_contact": (F.col("active") == 1) & (F.col("contact") == 0),
        "gap_with_contact": (F.col("gap") == 1) & (F.col("contact") == 1),
        "value_without_contact": (F.col("contact") == 0) & (F.coalesce("x", F.lit(0.0)) != 0),
        "not_finite": F.col("x").isNull() | F.isnan("x"),
    }
    named = frames.withColumn("_before", F.lag("t_ms").over(order)).select("event", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    return named.groupBy("event", "rule").agg(F.count("*").alias("n"))


def component_contract(rows: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Ids not unique, digests that aren't 64 hex digits, durations not positive, and columns without the prefix."""
    ids = rows.groupBy("sample_id").count().filter("count > 1").select(F.lit("repeated_id").alias("rule"), F.col("sample_id").cast("string").alias("key"))
    cells = F.array_compact(
        F.array(F.when(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("bad_digest")), F.when(~F.coalesce(F.col("duration_ms") > 0, F.lit(False)), F.lit("duration_not_positive")))
    )
    bad = rows.select(F.explode(cells).alias("rule"), F.col("sample_id").cast("string").alias("key"))
    wrong = [c for c in columns if not c.startswith(prefix)]
    named = rows.sparkSession.createDataFrame([("bad_prefix", c) for c in wrong], "rule string, key string")
    return ids.unionByName(bad).unionByName(named)


def mixed_policy(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Fakes take their user's pool from split(user_id, user_pool); genuine rows keep their own."""
    return rows.join(F.broadcast(split), "user_id", "left").withColumn("pool", F.when(F.col("label") == 1, F.col("user_pool")).otherwise(F.col("pool"))).drop("user_pool")


def user_split(users: DataFrame, train: int = 70, val: int = 10) -> DataFrame:
    """D3: pools of whole users by their number: the first `train` of each hundred, then `val`, then test."""
    k = F.col("user_id") % 100
    return users.select("user_id", F.when(k < train, "train").when(k < train + val, "val").otherwise("test").alias("user_pool"))


def machine_cadence(events: DataFrame, jitter_s: float = 1.0) -> DataFrame:
    """Genuine gaps replaced by a constant, and by a hash-uniform number around it: the class that a rhythm detector learns
    against. events(user_id, session_id, event_id, gap_s)."""
    u = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return events.withColumn("constant_s", F.when(F.col("gap_s").isNotNull(), 2.0)).withColumn("jittered_s", F.when(F.col("gap_s").isNotNull(), 2.0 + (2 * u - 1) * jitter_s))


def pointer_slots(rows: DataFrame) -> DataFrame:
    """Slots by first appearance, not by number. rows(event, pointer, t_ms, source_row)."""
    first = rows.groupBy("event", "pointer").agg(F.min(F.struct("t_ms", "source_row")).alias("f"))
    return first.select("event", "pointer", (F.row_number().over(Window.partitionBy("event").orderBy("f")) - 1).alias("slot"))


def typing_events(keys: DataFrame) -> DataFrame:
    """Keys in order of down and up: frame offset by the frames before, hold, flight (first 0), half-even rounded mean error.

    keys(event, key_index, down_ms, up_ms, n_frames, error).
    """
    order = Window.partitionBy("event").orderBy("down_ms", "up_ms", "key_index")
    before = F.coalesce(F.sum("n_frames").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keys.select(
        "event",
        "key_index",
        before.alias("frame_offset"),
        (F.col("up_ms") - F.col("down_ms")).alias("hold"),
        F.coalesce(F.col("down_ms") - F.lag("up_ms").over(order), F.lit(0)).alias("flight"),
        F.bround(F.avg("error").over(Window.partitionBy("event")), 0).cast("long").alias("mean_error"),
    )


def convention_check(scores: DataFrame, stored: DataFrame, cell: list[str]) -> DataFrame:
    """FAR and FRR recomputed at stored cuts beside the stored values. stored(cell, cut, far, frr)."""
    j = scores.join(F.broadcast(stored), cell)
    re = j.groupBy(*cell).agg(
        F.avg(F.when(F.col("label") == 1, (F.col("score") < F.col("cut")).cast("double"))).alias("far_again"),
        F.avg(F.when(F.col("label") == 0, (F.col("score") >= F.col("cut")).cast("double"))).alias("frr_again"),
        F.first("far").alias("far"),
        F.first("frr").alias("frr"),
    )
    return re.withColumn("agrees", (F.abs(F.col("far") - F.col("far_again")) < 1e-6) & (F.abs(F.col("frr") - F.col("frr_again")) < 1e-6))
