"""An audit of event tables. Rules are SQL conditions that hold where a row is wrong; each level is read once.

    events  event_id, action, user_id, external_id, session_id, orientation_id, label_start_ms, label_end_ms, label_duration_ms,
            touch_start_ms, touch_end_ms, touch_duration_ms, active_start_rel_ms, active_end_rel_ms, match_start_error_ms,
            match_end_error_ms, n_rows, n_frames, n_pointers, max_pointer_count, n_keys, n_letters, n_raw_gestures,
            raw_gesture_id, active_row_count, bundle, point_lo, point_hi, key_lo, key_hi
    keys    event_id, key_index, keycode, is_letter, down_ms, up_ms, hold_ms, flight_ms, key_touch_start_ms, key_touch_end_ms,
            key_start_error_ms, key_end_error_ms, key_orientation_id, source, found, key_raw_id, point_lo, point_hi, key_row
    points  event_id, point_row, frame, t_rel_ms, event_time_ms, pointer_id, pointer_count, code, active, valid,
            point_orientation_id, x, y, pressure, size, key_index, keycode

Ranges are half-open row numbers within a bundle (a stored file). Every audit returns `rule, key, detail`; no rows: passed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ["tap", "scroll", "swipe", "pinch", "keystroke"]
_ONE = "action in ('tap', 'scroll', 'swipe')"
_TYPED = "action = 'keystroke'"

#: What an event's own columns show.
EVENT = {
    "action_unknown": f"action not in ({', '.join(map(repr, ACTIONS))})",
    "label_duration": "label_duration_ms <> label_end_ms - label_start_ms",
    "touch_duration": "touch_duration_ms <> touch_end_ms - touch_start_ms",
    "label_not_positive": "label_duration_ms <= 0",
    "touch_not_positive": "touch_duration_ms <= 0",
    "active_start": "active_start_rel_ms <> label_start_ms - touch_start_ms",
    "active_end": "active_end_rel_ms <> label_end_ms - touch_start_ms",
    "match_start": f"not {_TYPED} and active_start_rel_ms <> -match_start_error_ms",
    "match_end": f"not {_TYPED} and active_end_rel_ms - touch_duration_ms <> -match_end_error_ms",
    "label_after_touch": "active_start_rel_ms > touch_duration_ms",
    "label_before_touch": "active_end_rel_ms < 0",
    "active_interval": "active_end_rel_ms < active_start_rel_ms",
    "no_active_rows": "active_row_count < 1",
    "orientation_unknown": "orientation_id not in (-1, 0, 1, 3)",
    "session_range": "session_id not between 1 and 24",
    "keys_of_typing": f"{_TYPED} and n_keys <= 0",
    "keys_of_others": f"not {_TYPED} and n_keys <> 0",
    "letters_range": "n_letters not between 0 and n_keys",
    "raw_gestures": f"n_raw_gestures <> case when {_TYPED} then n_keys else 1 end",
    "raw_id_of_typing": f"{_TYPED} and raw_gesture_id <> -1",
    "one_pointer": f"({_ONE} or {_TYPED}) and (n_pointers <> 1 or max_pointer_count <> 1)",
    "pinch_pointers": "action = 'pinch' and (n_pointers <> 2 or max_pointer_count <> 2)",
    "row_range": "point_hi - point_lo <> n_rows",
    "key_range": "key_hi - key_lo <> n_keys",
}
#: What the points of an event show about it.
EVENT_POINTS = {
    "without_points": "rows_seen is null",
    "n_rows": "n_rows <> rows_seen",
    "active_row_count": "active_row_count <> active_seen",
    "n_frames": "n_frames <> frames_seen",
    "first_frame": "first_t <> 0",
    "last_frame": "last_t <> touch_duration_ms",
    "n_pointers": f"not {_TYPED} and n_pointers <> pointers_seen",
    "max_pointer_count": f"not {_TYPED} and max_pointer_count <> count_seen",
    "first_not_down": f"{_ONE} and first_code <> 0",
    "last_not_up": f"{_ONE} and last_code <> 1",
}
#: What the keys of a typed event show about it.
EVENT_KEYS = {
    "n_keys": "n_keys <> coalesce(keys_seen, 0)",
    "n_letters": "n_letters <> coalesce(letters_seen, 0)",
    "label_of_keys": f"{_TYPED} and (label_start_ms <> first_down or label_end_ms <> last_up)",
    "touch_of_keys": f"{_TYPED} and (touch_start_ms <> first_touch or touch_end_ms <> last_touch)",
    "start_error_mean": f"{_TYPED} and match_start_error_ms <> start_error_mean",
    "end_error_mean": f"{_TYPED} and match_end_error_ms <> end_error_mean",
}
#: A point beside its event and the point before it.
POINT = {
    "valid_mask": "valid <> 1",
    "active_not_binary": "active not in (0, 1)",
    "active_mask": "active <> case when event_time_ms between label_start_ms and label_end_ms then 1 else 0 end",
    "place_not_finite": "x is null or y is null or not (abs(x) < 1e300 and abs(y) < 1e300)",
    "contact_not_finite": "pressure is null or size is null or not (abs(pressure) < 1e300 and abs(size) < 1e300)",
    "point_orientation_unknown": "point_orientation_id not in (-1, 0, 1, 3)",
    "point_orientation": "point_orientation_id <> orientation_id",
    "code_unsupported": "code not in (0, 1, 2, 5, 6)",
    "pointer_count_low": "pointer_count < 1",
    "pointer_count_one": f"({_ONE} or {_TYPED}) and pointer_count <> 1",
    "frame_backwards": "frame < frame_before",
    "frame_time_differs": "frame = frame_before and (t_rel_ms <> t_before or event_time_ms <> time_before)",
    "frame_time_stands": f"frame > frame_before and not {_TYPED} and t_rel_ms <= t_before",
    "frame_time_falls": f"frame > frame_before and {_TYPED} and t_rel_ms < t_before",
    "equal_time_inside_key": f"frame > frame_before and {_TYPED} and t_rel_ms = t_before and key_index <= key_before",
}
#: The points of one frame.
FRAME = {
    "frame_pointer_count": "count_seen <> pointers_seen",
    "pinch_frame_lacks_pointer": "action = 'pinch' and active_seen > 0 and pointers_seen <> 2",
}
#: A key beside its event, the key before it and its points.
KEY = {
    "key_of_other_action": f"not {_TYPED}",
    "letter_flag": "is_letter <> case when keycode between 65 and 90 or keycode between 97 and 122 then 1 else 0 end",
    "contact_missing": "found <> 1",
    "up_before_down": "up_ms < down_ms",
    "hold": "hold_ms <> up_ms - down_ms",
    "key_start_error": "key_touch_start_ms - down_ms <> key_start_error_ms",
    "key_end_error": "key_touch_end_ms - up_ms <> key_end_error_ms",
    "key_orientation": "key_orientation_id <> orientation_id",
    "source_unknown": "source not in (0, 1)",
    "raw_id_sign": "(source = 0) <> (key_raw_id >= 0)",
    "key_index": "key_index <> coalesce(index_before + 1, 0)",
    "first_flight": "index_before is null and flight_ms <> 0",
    "flight": "index_before is not null and flight_ms <> down_ms - up_before",
    "key_without_points": "rows_seen is null",
    "key_pointers": "pointers_seen <> 1 or count_seen <> 1",
    "key_codes": "first_code <> 0 or last_code <> 1",
    "key_keycode": "least_keycode <> keycode or most_keycode <> keycode",
    "fallback_rows": "source = 1 and rows_seen <> 2",
}
#: A child beside the child before it and its parent.
TILE = {
    "range_empty": "hi <= lo",
    "range_without_parent": "parent_lo is null",
    "range_starts_late": "lo_before is null and lo <> parent_lo",
    "range_gap": "lo > hi_before",
    "range_overlap": "lo < hi_before",
    "range_ends_early": "is_last and hi <> parent_hi",
}


def broken(rows: DataFrame, rules: dict[str, str], key: Iterable[str], detail: str = "", prefix: str = "") -> DataFrame:
    """`rule, key, detail` of all rules that hold for a row; a condition that is null doesn't."""
    named = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(prefix + n)) for n, c in rules.items()]))
    what = F.col(detail) if detail else F.lit(None)
    return rows.select(F.explode(named).alias("rule"), F.concat_ws("/", *key).alias("key"), what.cast("string").alias("detail"))


def _seen(extra: dict[str, Column] | None = None) -> list[Column]:
    order = "point_row"
    columns = {
        "rows_seen": F.count("*"),
        "active_seen": F.sum("active"),
        "pointers_seen": F.countDistinct("pointer_id"),
        "count_seen": F.max("pointer_count"),
        "first_code": F.min_by("code", order),
        "last_code": F.max_by("code", order),
    } | (extra or {})
    return [c.alias(n) for n, c in columns.items()]


def event_rules(events: DataFrame, keys: DataFrame, points: DataFrame) -> DataFrame:
    """Events by themselves and against sums of their points and keys."""
    seen = points.groupBy("event_id").agg(*_seen({"frames_seen": F.countDistinct("frame"), "first_t": F.min_by("t_rel_ms", "point_row"), "last_t": F.max_by("t_rel_ms", "point_row")}))
    typed = keys.groupBy("event_id").agg(
        F.count("*").alias("keys_seen"),
        F.sum("is_letter").alias("letters_seen"),
        *[f(c, "key_index").alias(n) for f, c, n in ((F.min_by, "down_ms", "first_down"), (F.max_by, "up_ms", "last_up"), (F.min_by, "key_touch_start_ms", "first_touch"), (F.max_by, "key_touch_end_ms", "last_touch"))],
        F.bround(F.avg("key_start_error_ms")).alias("start_error_mean"),
        F.bround(F.avg("key_end_error_ms")).alias("end_error_mean"),
    )
    return broken(events.join(seen, "event_id", "left").join(typed, "event_id", "left"), EVENT | EVENT_POINTS | EVENT_KEYS, ["event_id"], "action")


def point_rules(events: DataFrame, points: DataFrame) -> DataFrame:
    """Points beside their event and the point before, and frames."""
    own = events.select("event_id", "action", "label_start_ms", "label_end_ms", "orientation_id")
    rows = points.join(own, "event_id")
    before = Window.partitionBy("event_id").orderBy("point_row")
    lagged = {"frame_before": "frame", "t_before": "t_rel_ms", "time_before": "event_time_ms", "key_before": "key_index"}
    found = broken(rows.withColumns({n: F.lag(c).over(before) for n, c in lagged.items()}), POINT, ["event_id", "point_row"], "action")
    frames = rows.groupBy("event_id", "action", "frame").agg(F.countDistinct("pointer_id").alias("pointers_seen"), F.max("pointer_count").alias("count_seen"), F.sum("active").alias("active_seen"))
    return found.unionByName(broken(frames, FRAME, ["event_id", "frame"], "action"))


def key_rules(events: DataFrame, keys: DataFrame, points: DataFrame) -> DataFrame:
    """Keys beside their event, the key before and their points."""
    seen = points.groupBy("event_id", "key_index").agg(*_seen({"least_keycode": F.min("keycode"), "most_keycode": F.max("keycode")}))
    before = Window.partitionBy("event_id").orderBy("key_index")
    rows = keys.join(events.select("event_id", "action", "orientation_id"), "event_id").join(seen, ["event_id", "key_index"], "left")
    return broken(rows.withColumns({"index_before": F.lag("key_index").over(before), "up_before": F.lag("up_ms").over(before)}), KEY, ["event_id", "key_index"], "source")


def tiling(parents: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Where the ranges of children(parent, child, lo, hi) don't cover those of parents(parent, parent_lo, parent_hi) without
    gap or overlap, each child following the one before it by its lower end."""
    order = Window.partitionBy("parent").orderBy("lo", "hi", "child")
    rows = children.withColumns({"lo_before": F.lag("lo").over(order), "hi_before": F.lag("hi").over(order), "is_last": F.lead("lo").over(order).isNull()})
    found = broken(rows.join(parents, "parent", "left"), TILE, ["parent", "child"], prefix=name + "_")
    bare = parents.filter("parent_hi > parent_lo").join(children, "parent", "left_anti")
    return found.unionByName(bare.select(F.lit(name + "_range_bare").alias("rule"), F.concat_ws("/", "parent").alias("key"), F.lit(None).cast("string").alias("detail")))


def tilings(events: DataFrame, keys: DataFrame, points: DataFrame, bundles: DataFrame) -> DataFrame:
    """Nested ranges: events in a bundle(bundle, n_points), keys in an event's key rows, and keys' points in its points."""
    span = lambda lo, hi: [F.col(lo).alias("parent_lo"), F.col(hi).alias("parent_hi")]
    parts = (
        ("event", bundles.select(F.col("bundle").alias("parent"), F.lit(0).cast("long").alias("parent_lo"), F.col("n_points").alias("parent_hi")), events.select(F.col("bundle").alias("parent"), F.col("event_id").alias("child"), F.col("point_lo").alias("lo"), F.col("point_hi").alias("hi"))),
        ("key", events.select(F.col("event_id").alias("parent"), *span("key_lo", "key_hi")), keys.select(F.col("event_id").alias("parent"), F.col("key_index").alias("child"), F.col("key_row").alias("lo"), (F.col("key_row") + 1).alias("hi"))),
        ("contact", events.filter(_TYPED).select(F.col("event_id").alias("parent"), *span("point_lo", "point_hi")), keys.select(F.col("event_id").alias("parent"), F.col("key_index").alias("child"), F.col("point_lo").alias("lo"), F.col("point_hi").alias("hi"))),
    )
    out = None
    for name, parents, children in parts:
        found = tiling(parents, children, name)
        out = found if out is None else out.unionByName(found)
    return out


def global_rules(events: DataFrame, keys: DataFrame, audited: DataFrame, users: int) -> DataFrame:
    """Over all tables: ids once, one owner of a raw gesture (user, session, id of 0 or more) across actions, one external id a
    user, the ids of audited(event_id) those of the tables, and the number of users each action has."""

    def named(rows: DataFrame, rule: str, key: list[str], detail: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.concat_ws("/", *key).alias("key"), F.col(detail).cast("string").alias("detail"))

    held = ["user_id", "session_id", "raw"]
    typed = keys.filter("source = 0").select("event_id", F.col("key_raw_id").alias("raw")).join(events.select("event_id", "user_id", "session_id"), "event_id")
    raw = events.filter(f"not {_TYPED}").select("event_id", F.col("raw_gesture_id").alias("raw"), "user_id", "session_id").unionByName(typed).filter("raw >= 0")
    n = lambda rows, by: rows.groupBy(*by).agg(F.count("*").alias("n"))
    outs = [
        named(n(events, ["event_id"]).filter("n > 1"), "event_id_repeated", ["event_id"], "n"),
        named(n(raw, held).filter("n > 1"), "raw_gesture_owned_twice", held, "n"),
        named(events.groupBy("user_id").agg(F.countDistinct("external_id").alias("n")).filter("n > 1"), "external_ids", ["user_id"], "n"),
        named(events.groupBy("action").agg(F.countDistinct("user_id").alias("n")).filter(F.col("n") != users), "user_count", ["action"], "n"),
        named(events.select("event_id", "action").join(audited, "event_id", "left_anti"), "not_audited", ["event_id"], "action"),
        named(audited.join(events, "event_id", "left_anti").withColumn("none", F.lit(None)), "audited_without_event", ["event_id"], "none"),
        named(n(audited, ["event_id"]).filter("n > 1"), "audited_twice", ["event_id"], "n"),
        named(points_of_no_event(events, keys), "key_without_event", ["event_id", "key_index"], "source"),
    ]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def points_of_no_event(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (points or keys) whose event isn't there."""
    return rows.join(events.select("event_id"), "event_id", "left_anti")


def audit(events: DataFrame, keys: DataFrame, points: DataFrame, bundles: DataFrame, audited: DataFrame, users: int) -> DataFrame:
    """All rules of all levels: `rule, key, detail`."""
    stray = points_of_no_event(events, points).select(F.lit("point_without_event").alias("rule"), F.concat_ws("/", "event_id", "point_row").alias("key"), F.lit(None).cast("string").alias("detail"))
    out = event_rules(events, keys, points)
    for part in (point_rules(events, points), key_rules(events, keys, points), tilings(events, keys, points, bundles), global_rules(events, keys, audited, users), stray):
        out = out.unionByName(part)
    return out
