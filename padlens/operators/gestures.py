"""Gesture assembly from raw touch rows as window functions (G1-G13, P1-P4). Keys: user_id, act_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["user_id", "act_id"]
# Motion event codes.
DOWN, UP, MOVE, CANCEL, POINTER_DOWN, POINTER_UP = 0, 1, 2, 3, 5, 6
SUPPORTED = [DOWN, UP, MOVE, CANCEL, POINTER_DOWN, POINTER_UP]


def frames(touch: DataFrame) -> DataFrame:
    """G1: rows of equal activity and time are one frame."""
    code = F.col("code")
    return touch.groupBy(*KEY, "evt_t").agg(
        F.count("*").alias("n_rows"),
        F.bool_or(code == DOWN).alias("down"),
        F.bool_or(code == UP).alias("up"),
        F.bool_or(code == CANCEL).alias("cancel"),
        (F.countDistinct("code") > 1).alias("mixed"),
        F.count(F.when(~code.isin(SUPPORTED), 1)).alias("unsupported"),
    )


def segmented(touch: DataFrame) -> DataFrame:
    """Frames with the number of the contact they belong to, and that contact's end.

    A DOWN opens a contact; its first later UP or CANCEL frame, the DOWN's own included, ends it.
    """
    run = Window.partitionBy(*KEY).orderBy("evt_t").rowsBetween(Window.unboundedPreceding, 0)
    seg = frames(touch).withColumn("seg", F.sum(F.col("down").cast("long")).over(run))
    one = Window.partitionBy(*KEY, "seg")
    return seg.withColumn("term", F.min(F.when(F.col("up") | F.col("cancel"), F.col("evt_t"))).over(one)).withColumn(
        "last_seg", F.max("seg").over(Window.partitionBy(*KEY))
    )


def contacts(touch: DataFrame) -> DataFrame:
    """One row for each contact with its state: complete, cancelled, restarted or eof."""
    kept = segmented(touch).filter("seg > 0 and (term is null or evt_t <= term)")
    return kept.groupBy(*KEY, "seg").agg(
        F.min("evt_t").alias("start_ms"),
        F.max("evt_t").alias("end_ms"),
        F.count("*").alias("n_frames"),
        F.sum("n_rows").alias("n_rows"),
        F.when(F.max("term").isNull(), F.when(F.col("seg") < F.max("last_seg"), "restarted").otherwise("eof"))
        .when(F.bool_or(F.col("cancel") & (F.col("evt_t") == F.col("term"))), "cancelled")
        .otherwise("complete")
        .alias("state"),
    )


def counters(touch: DataFrame) -> DataFrame:
    """Parser totals; orphan frames have no open contact."""
    parts = segmented(touch).agg(
        F.sum("n_rows").alias("rows"), F.count("*").alias("frames"), F.count(F.when((F.col("seg") == 0) | (F.col("evt_t") > F.col("term")), 1)).alias("orphan")
    )
    state = contacts(touch).agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("complete", "cancelled", "restarted", "eof")])
    return parts.crossJoin(F.broadcast(state))


def points(touch: DataFrame) -> DataFrame:
    """Rows inside complete contacts, with relative time and frame index."""
    whole = contacts(touch).filter("state = 'complete'").select(*KEY, "seg", "start_ms", "end_ms")
    seg = segmented(touch).filter("seg > 0").select(*KEY, "evt_t", "seg")
    rows = touch.join(seg, [*KEY, "evt_t"]).join(whole, [*KEY, "seg"]).filter("evt_t between start_ms and end_ms")
    index = F.dense_rank().over(Window.partitionBy(*KEY, "seg").orderBy("evt_t")) - 1
    return rows.select(*KEY, "seg", "source_row", "x", "y", "evt_t", (F.col("evt_t") - F.col("start_ms")).alias("t_ms"), index.alias("frame"))


def one_finger_pairs(touch: DataFrame) -> DataFrame:
    """An UP pairs with the DOWN straight before it among the activity's 0/1 rows, if time has passed."""
    order = Window.partitionBy(*KEY).orderBy("evt_t", "source_row")
    rows = touch.filter(F.col("code").isin(DOWN, UP))
    rows = rows.withColumns({n: F.lag(c).over(order) for n, c in (("was", "code"), ("start_ms", "evt_t"), ("start_x", "x"), ("start_y", "y"))})
    return rows.filter((F.col("code") == UP) & (F.col("was") == DOWN) & (F.col("evt_t") > F.col("start_ms"))).select(
        *KEY, (-F.col("source_row")).alias("contact_id"), "start_ms", F.col("evt_t").alias("end_ms"), "start_x", "start_y", F.col("x").alias("end_x"), F.col("y").alias("end_y")
    )


def last_row_of_frame(touch: DataFrame) -> DataFrame:
    """Of repeated rows in a frame the last stays."""
    return touch.groupBy(*KEY, "evt_t").agg(F.max_by(F.struct("code", "x", "y"), "source_row").alias("r"), F.max("source_row").alias("source_row")).select(
        *KEY, "evt_t", "r.*", "source_row"
    )


def with_gap_rows(keys: DataFrame) -> DataFrame:
    """Between events with a positive gap one row without contact at the midpoint. keys(user_id, session_id, start_ms, end_ms, event_id)."""
    order = Window.partitionBy("user_id", "session_id").orderBy("start_ms", "event_id")
    rows = keys.withColumn("_end", F.lag("end_ms").over(order))
    own = F.struct(F.col("start_ms").alias("t_ms"), F.lit(1).alias("contact"))
    gap = F.struct((F.col("_end") + F.floor((F.col("start_ms") - F.col("_end")) / 2)).cast("long").alias("t_ms"), F.lit(0).alias("contact"))
    both = F.when(F.col("start_ms") > F.col("_end"), F.array(gap, own)).otherwise(F.array(own))
    return rows.select("user_id", "session_id", "event_id", F.explode(both).alias("r")).select("user_id", "session_id", "event_id", "r.*")


def contact_phase(rows: DataFrame, slot: str | None = None) -> DataFrame:
    """In each run of contact the first row is a DOWN, the last an UP (a run of one row is an UP), those between are moves.

    rows(user_id, act_id, evt_t, source_row, contact). With the name of a slot column each slot has runs of its own, and
    those of slots other than 0 begin and end with POINTER_DOWN and POINTER_UP.
    """
    order = Window.partitionBy(*KEY, *([slot] if slot else [])).orderBy("evt_t", "source_row")
    before, after = F.coalesce(F.lag("contact").over(order), F.lit(0)), F.coalesce(F.lead("contact").over(order), F.lit(0))
    first = F.col(slot) == 0 if slot else F.lit(True)
    phase = F.when(F.col("contact") == 0, F.lit(-1)).when(after == 0, F.when(first, UP).otherwise(POINTER_UP)).when(before == 0, F.when(first, DOWN).otherwise(POINTER_DOWN)).otherwise(MOVE)
    return rows.withColumn("phase", phase)


def deltas(rows: DataFrame) -> DataFrame:
    """Steps only between neighbouring rows that are both in contact, else 0."""
    order = Window.partitionBy(*KEY).orderBy("evt_t", "source_row")
    both = (F.col("contact") == 1) & (F.lag("contact").over(order) == 1)
    step = lambda c: F.when(both, F.col(c) - F.lag(c).over(order)).otherwise(0.0)
    return rows.withColumns({"dx": step("x"), "dy": step("y")})


def union_timeline(rows: DataFrame) -> DataFrame:
    """Both pointers at all update times of their event, each held from its last update inside its own lifetime.

    rows(event, pointer, t_ms, source_row, x). The last row wins where a pointer has several at one time.
    """
    own = rows.groupBy("event", "pointer", "t_ms").agg(F.max_by("x", "source_row").alias("x"))
    life = own.groupBy("event", "pointer").agg(F.min("t_ms").alias("first"), F.max("t_ms").alias("last"))
    grid = own.select("event", "t_ms").distinct().join(life, "event")
    fill = Window.partitionBy("event", "pointer").orderBy("t_ms").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.join(own, ["event", "pointer", "t_ms"], "left").withColumn("x", F.last("x", ignorenulls=True).over(fill))
    inside = F.col("t_ms").between(F.col("first"), F.col("last"))
    return held.select("event", "pointer", "t_ms", inside.cast("int").alias("contact"), F.when(inside, F.col("x")).alias("x"))
