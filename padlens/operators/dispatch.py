"""each event to the features of its action, in one result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlens.operators.features import finger_features, typing_features
from padlens.operators.more import pinch_features
from padlens.operators.rows import canonical_keycode, key_token

ONE_FINGER = ("tap", "scroll", "swipe")


def event_features(events: DataFrame, points: DataFrame, keys: DataFrame) -> DataFrame:
    """`event_id, action, finger, pinch, typing, problem`: the features of the event's kind as a struct, the others null, or what
    keeps it from having any.

    events(event_id, action), points(event_id, slot 0 or 1, t_ms, source_row, x, y, contact 0 or 1, key_index),
    keys(event_id, key_index, keycode, down_ms, up_ms). Taps, scrolls and swipes take slot 0 while it touches; pinches the
    times at which both slots touch, of rows of one time the last; typed events their keys, negative keycodes as 0, a
    key's place its first contact row, and no places at all if one of the event's keys has none.

    Points and keys are routed by action before any feature is computed, so each is shuffled by its event once.
    """
    of = events.select("event_id", "action")
    touching = points.filter("contact = 1").join(of, "event_id")

    finger = finger_features(touching.filter(F.col("action").isin(*ONE_FINGER) & (F.col("slot") == 0)), ["event_id"])

    slot = lambda k, c: F.max_by(F.when(F.col("slot") == k, F.col(c)), F.when(F.col("slot") == k, F.col("source_row")))
    frames = touching.filter("action = 'pinch'").groupBy("event_id", "t_ms").agg(*[slot(k, c).alias(f"{c}{k}") for k in (0, 1) for c in "xy"])
    pinch = pinch_features(frames.dropna(subset=["x0", "x1"]).withColumnRenamed("event_id", "event")).withColumnRenamed("event", "event_id")

    first = touching.filter("action = 'keystroke'").groupBy("event_id", "key_index").agg(*[F.min_by(c, "source_row").alias(c) for c in "xy"])
    typed = keys.join(of.filter("action = 'keystroke'"), "event_id").join(first, ["event_id", "key_index"], "left")
    placed = typed.groupBy("event_id").agg((F.count("x") == F.count("*")).alias("_placed"))
    place = lambda c: F.when(F.col("_placed"), F.col(c)).alias(c)
    typed = typed.join(placed, "event_id").select(
        F.col("event_id").alias("user_id"), F.lit(0).alias("session_id"), F.col("key_index").alias("event_id"), F.col("down_ms").alias("start_ms"), F.col("up_ms").alias("end_ms"),
        key_token(canonical_keycode(F.col("keycode"))).alias("action"), place("x"), place("y"),
    )
    typing = typing_features(typed).withColumnRenamed("user_id", "event_id").drop("session_id")

    out = of
    for name, found in (("finger", finger), ("pinch", pinch), ("typing", typing)):
        out = out.join(found.select("event_id", F.struct(*[c for c in found.columns if c != "event_id"]).alias(name)), "event_id", "left")
    why = (
        F.when(F.col("action").isin(*ONE_FINGER), F.when(F.col("finger").isNull(), "no_contact_row"))
        .when(F.col("action") == "pinch", F.when(F.col("pinch").isNull(), "no_simultaneous_two_pointer_frame"))
        .when(F.col("action") == "keystroke", F.when(F.col("typing").isNull(), "no_key"))
        .otherwise("unsupported_action")
    )
    return out.withColumn("problem", why)
