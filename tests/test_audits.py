"""Event-table audit: a sound set of tables passes, and each rule is broken once. Recompute audit: faults named by hand."""

import pytest

from padlens.operators import eventaudit as V
from padlens.operators import recompute as R

EVENT = "event_id long, action string, user_id long, external_id long, session_id int, orientation_id int, label_start_ms long, label_end_ms long, label_duration_ms long, touch_start_ms long, touch_end_ms long, touch_duration_ms long, active_start_rel_ms long, active_end_rel_ms long, match_start_error_ms long, match_end_error_ms long, n_rows int, n_frames int, n_pointers int, max_pointer_count int, n_keys int, n_letters int, n_raw_gestures int, raw_gesture_id long, active_row_count int, bundle string, point_lo long, point_hi long, key_lo long, key_hi long"
KEY = "event_id long, key_index int, keycode int, is_letter int, down_ms long, up_ms long, hold_ms long, flight_ms long, key_touch_start_ms long, key_touch_end_ms long, key_start_error_ms long, key_end_error_ms long, key_orientation_id int, source int, found int, key_raw_id long, point_lo long, point_hi long, key_row long"
POINT = "event_id long, point_row long, frame int, t_rel_ms long, event_time_ms long, pointer_id int, pointer_count int, code int, active int, valid int, point_orientation_id int, x double, y double, pressure double, size double, key_index int, keycode int"
NAN = float("nan")


def event(i, action, **other):
    """An event of 3 points over 100 ms; label and touch agree."""
    base = dict(event_id=i, action=action, user_id=5, external_id=50, session_id=1, orientation_id=0, label_start_ms=1000, label_end_ms=1100, label_duration_ms=100, touch_start_ms=1000, touch_end_ms=1100, touch_duration_ms=100, active_start_rel_ms=0,
                active_end_rel_ms=100, match_start_error_ms=0, match_end_error_ms=0, n_rows=3, n_frames=3, n_pointers=1, max_pointer_count=1, n_keys=0, n_letters=0, n_raw_gestures=1, raw_gesture_id=i, active_row_count=3, bundle="b", point_lo=0, point_hi=3, key_lo=0, key_hi=0)
    return base | other


def point(i, row, frame, t, code, **other):
    return dict(event_id=i, point_row=row, frame=frame, t_rel_ms=t, event_time_ms=1000 + t, pointer_id=0, pointer_count=1, code=code, active=1, valid=1, point_orientation_id=0, x=1.0, y=2.0, pressure=0.5, size=0.1, key_index=0, keycode=-1) | other


def key(i, k, lo, hi, down, up, **other):
    base = dict(event_id=i, key_index=k, keycode=65, is_letter=1, down_ms=down, up_ms=up, hold_ms=up - down, flight_ms=0, key_touch_start_ms=down, key_touch_end_ms=up, key_start_error_ms=0, key_end_error_ms=0, key_orientation_id=0, source=0, found=1, key_raw_id=900 + k, point_lo=lo, point_hi=hi, key_row=k)
    return base | other


def sound():
    """A tap, a pinch of two frames of two pointers, and a typed event of two keys, the second a fallback that begins as the first ends."""
    events = [
        event(1, "tap"),
        event(2, "pinch", n_rows=4, n_frames=2, n_pointers=2, max_pointer_count=2, active_row_count=4, point_lo=3, point_hi=7),
        event(3, "keystroke", n_rows=5, n_frames=5, n_keys=2, n_letters=1, n_raw_gestures=2, raw_gesture_id=-1, active_row_count=5, point_lo=7, point_hi=12, key_hi=2),
    ]
    points = [point(1, 0, 0, 0, 0), point(1, 1, 1, 40, 2), point(1, 2, 2, 100, 1)]
    points += [point(2, 3 + 2 * f + p, f, 100 * f, (0, 5)[p] if f == 0 else (1, 6)[p], pointer_id=p, pointer_count=2) for f in (0, 1) for p in (0, 1)]
    points += [point(3, 7 + j, j, t, c, key_index=k, keycode=(65, 48)[k]) for j, (t, c, k) in enumerate([(0, 0, 0), (20, 2, 0), (60, 1, 0), (60, 0, 1), (100, 1, 1)])]
    keys = [key(3, 0, 7, 10, 1000, 1060), key(3, 1, 10, 12, 1060, 1100, keycode=48, is_letter=0, source=1, key_raw_id=-1)]
    return events, keys, points


def audited(spark, events, keys, points, bundles=(("b", 12),), ids=(1, 2, 3), users=1):
    tables = [spark.createDataFrame([tuple(r[c.split()[0]] for c in s.split(", ")) for r in rows], s) for rows, s in ((events, EVENT), (keys, KEY), (points, POINT))]
    out = V.audit(*tables, spark.createDataFrame(list(bundles), "bundle string, n_points long"), spark.createDataFrame([(i,) for i in ids], "event_id long"), users)
    return {(r["rule"], r["key"]) for r in out.collect()}


#: rule, where it shows, and what breaks it: (table, row, changed columns).
BROKEN = [
    ("action_unknown", "1", [(0, 0, dict(action="fling"))]),
    ("label_duration", "1", [(0, 0, dict(label_duration_ms=99))]),
    ("touch_duration", "1", [(0, 0, dict(touch_end_ms=1101))]),
    ("label_not_positive", "1", [(0, 0, dict(label_duration_ms=0))]),
    ("touch_not_positive", "1", [(0, 0, dict(touch_duration_ms=-1))]),
    ("active_start", "1", [(0, 0, dict(active_start_rel_ms=1))]),
    ("active_end", "1", [(0, 0, dict(active_end_rel_ms=99))]),
    ("match_start", "1", [(0, 0, dict(match_start_error_ms=3))]),
    ("match_end", "1", [(0, 0, dict(match_end_error_ms=3))]),
    ("label_after_touch", "1", [(0, 0, dict(active_start_rel_ms=101))]),
    ("label_before_touch", "1", [(0, 0, dict(active_end_rel_ms=-1))]),
    ("active_interval", "1", [(0, 0, dict(active_start_rel_ms=50, active_end_rel_ms=40))]),
    ("no_active_rows", "1", [(0, 0, dict(active_row_count=0))]),
    ("orientation_unknown", "1", [(0, 0, dict(orientation_id=2))]),
    ("session_range", "1", [(0, 0, dict(session_id=25))]),
    ("keys_of_typing", "3", [(0, 2, dict(n_keys=0))]),
    ("keys_of_others", "1", [(0, 0, dict(n_keys=1))]),
    ("letters_range", "3", [(0, 2, dict(n_letters=3))]),
    ("raw_gestures", "3", [(0, 2, dict(n_raw_gestures=1))]),
    ("raw_id_of_typing", "3", [(0, 2, dict(raw_gesture_id=4))]),
    ("one_pointer", "1", [(0, 0, dict(n_pointers=2))]),
    ("pinch_pointers", "2", [(0, 1, dict(max_pointer_count=1))]),
    ("row_range", "1", [(0, 0, dict(n_rows=4))]),
    ("key_range", "3", [(0, 2, dict(key_hi=3))]),
    ("without_points", "4", [(0, None, event(4, "tap", point_lo=12, point_hi=15))]),
    ("n_rows", "1", [(0, 0, dict(n_rows=2))]),
    ("active_row_count", "1", [(0, 0, dict(active_row_count=2))]),
    ("n_frames", "2", [(0, 1, dict(n_frames=4))]),
    ("first_frame", "1", [(2, 0, dict(t_rel_ms=1))]),
    ("last_frame", "1", [(2, 2, dict(t_rel_ms=99))]),
    ("n_pointers", "2", [(0, 1, dict(n_pointers=3))]),
    ("max_pointer_count", "2", [(0, 1, dict(max_pointer_count=3))]),
    ("first_not_down", "1", [(2, 0, dict(code=2))]),
    ("last_not_up", "1", [(2, 2, dict(code=2))]),
    ("n_keys", "3", [(0, 2, dict(n_keys=3))]),
    ("n_letters", "3", [(0, 2, dict(n_letters=2))]),
    ("label_of_keys", "3", [(0, 2, dict(label_end_ms=1099))]),
    ("touch_of_keys", "3", [(0, 2, dict(touch_start_ms=999))]),
    ("start_error_mean", "3", [(0, 2, dict(match_start_error_ms=1))]),
    ("end_error_mean", "3", [(1, 0, dict(key_end_error_ms=3))]),
    ("valid_mask", "1/1", [(2, 1, dict(valid=0))]),
    ("active_not_binary", "1/1", [(2, 1, dict(active=2))]),
    ("active_mask", "1/1", [(2, 1, dict(active=0))]),
    ("place_not_finite", "1/1", [(2, 1, dict(x=NAN))]),
    ("contact_not_finite", "1/1", [(2, 1, dict(pressure=None))]),
    ("point_orientation_unknown", "1/1", [(2, 1, dict(point_orientation_id=7))]),
    ("point_orientation", "1/1", [(2, 1, dict(point_orientation_id=1))]),
    ("code_unsupported", "1/1", [(2, 1, dict(code=3))]),
    ("pointer_count_low", "1/1", [(2, 1, dict(pointer_count=0))]),
    ("pointer_count_one", "3/8", [(2, 8, dict(pointer_count=2))]),
    ("frame_backwards", "1/2", [(2, 2, dict(frame=0))]),
    ("frame_time_differs", "2/4", [(2, 4, dict(t_rel_ms=1))]),
    ("frame_time_stands", "1/1", [(2, 1, dict(t_rel_ms=0))]),
    ("frame_time_falls", "3/9", [(2, 9, dict(t_rel_ms=10))]),
    ("equal_time_inside_key", "3/8", [(2, 8, dict(t_rel_ms=0))]),
    ("frame_pointer_count", "2/1", [(2, 5, dict(pointer_count=3))]),
    ("pinch_frame_lacks_pointer", "2/1", [(2, 5, dict(pointer_id=1))]),
    ("key_of_other_action", "1/0", [(1, None, key(1, 0, 0, 3, 1000, 1100))]),
    ("letter_flag", "3/1", [(1, 1, dict(is_letter=1))]),
    ("contact_missing", "3/1", [(1, 1, dict(found=0))]),
    ("up_before_down", "3/1", [(1, 1, dict(up_ms=1050))]),
    ("hold", "3/1", [(1, 1, dict(hold_ms=1))]),
    ("key_start_error", "3/1", [(1, 1, dict(key_start_error_ms=1))]),
    ("key_end_error", "3/1", [(1, 1, dict(key_touch_end_ms=1))]),
    ("key_orientation", "3/1", [(1, 1, dict(key_orientation_id=3))]),
    ("source_unknown", "3/1", [(1, 1, dict(source=2))]),
    ("raw_id_sign", "3/1", [(1, 1, dict(key_raw_id=1))]),
    ("key_index", "3/2", [(1, 1, dict(key_index=2))]),
    ("first_flight", "3/0", [(1, 0, dict(flight_ms=1))]),
    ("flight", "3/1", [(1, 1, dict(flight_ms=1))]),
    ("key_without_points", "3/5", [(1, 1, dict(key_index=5))]),
    ("key_pointers", "3/0", [(2, 8, dict(pointer_id=4))]),
    ("key_codes", "3/0", [(2, 9, dict(code=2))]),
    ("key_keycode", "3/0", [(2, 8, dict(keycode=66))]),
    ("fallback_rows", "3/0", [(1, 0, dict(source=1))]),
    ("event_range_empty", "b/1", [(0, 0, dict(point_hi=0))]),
    ("event_range_without_parent", "c/1", [(0, 0, dict(bundle="c"))]),
    ("event_range_starts_late", "b/1", [(0, 0, dict(point_lo=1))]),
    ("event_range_gap", "b/2", [(0, 1, dict(point_lo=4))]),
    ("event_range_overlap", "b/2", [(0, 0, dict(point_hi=4))]),
    ("event_range_ends_early", "b/3", [(0, 2, dict(point_hi=11))]),
    ("key_range_gap", "3/1", [(1, 1, dict(key_row=2))]),
    ("key_range_bare", "1", [(0, 0, dict(key_hi=2))]),
    ("contact_range_overlap", "3/1", [(1, 1, dict(point_lo=9))]),
    ("contact_range_ends_early", "3/1", [(0, 2, dict(point_hi=13))]),
    ("event_id_repeated", "1", [(0, None, event(1, "tap"))]),
    ("raw_gesture_owned_twice", "5/1/900", [(0, 0, dict(raw_gesture_id=900))]),
    ("external_ids", "5", [(0, 0, dict(external_id=51))]),
    ("user_count", "tap", [(0, None, event(4, "tap", user_id=6, external_id=60))]),
    ("not_audited", "4", [(0, None, event(4, "tap"))]),
    ("key_without_event", "8/0", [(1, None, key(8, 0, 0, 3, 1000, 1100))]),
    ("point_without_event", "8/50", [(2, None, point(8, 50, 0, 0, 0))]),
]


def test_sound_tables_pass(spark):
    assert audited(spark, *sound()) == set()
    assert audited(spark, [], [], [], bundles=(), ids=()) == set()


def test_each_rule_is_broken(spark):
    """All cases as users of their own in one set of tables, ids moved apart by case."""
    tables, ids, bundles, wanted = ([], [], []), [], [], set()
    for case, (rule, where, changes) in enumerate(BROKEN):
        rows, off = sound(), 1000 * (case + 1)
        for table, row, columns in changes:
            if row is None:
                rows[table].append(columns)
            else:
                rows[table][row] |= columns
        for r in (r for part in rows for r in part):
            r["event_id"] += off
        for e in rows[0]:
            e["user_id"] += off
            e["external_id"] += off
            e["bundle"] += str(off)
        for part, r in zip(tables, rows):
            part.extend(r)
        ids += [off + 1, off + 2, off + 3]
        bundles.append((f"b{off}", 12))
        first, _, rest = where.partition("/")
        if rule.startswith("event_range"):
            where = f"{first}{off}/{int(rest) + off}"
        elif rule in ("external_ids", "raw_gesture_owned_twice"):
            where = "/".join([str(int(first) + off), *([rest] if rest else [])])
        elif rule != "user_count":
            where = "/".join([str(int(first) + off), *([rest] if rest else [])])
        wanted.add((rule, where))
    found = audited(spark, *tables, bundles=bundles, ids=[*ids, -7, ids[0]], users=7)
    assert wanted | {("audited_without_event", "-7"), ("audited_twice", str(ids[0]))} <= found, (wanted - found)
    rules = {f"{n}_{r}" for n in ("event", "key", "contact") for r in (*V.TILE, "range_bare")}
    listed = set(V.EVENT) | set(V.EVENT_POINTS) | set(V.EVENT_KEYS) | set(V.POINT) | set(V.FRAME) | set(V.KEY)
    assert listed <= {r for r, *_ in BROKEN} and len(listed) >= 60 and {r for r, _ in found} <= listed | rules | {r for r, *_ in BROKEN} | {"audited_without_event", "audited_twice"}


CLAIMS = [("cuts", "a", "eer", 0.5), ("cuts", "b", "eer", 0.25), ("metrics", "a", "far", 0.125), ("metrics", "a", "frr", None), ("report", "all", "far", 0.3), ("loose", "x", "y", 1.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "artifact string, key string, measure string, value double")


def verdicts(spark, claims, recomputed, bindings, current):
    bound = spark.createDataFrame(bindings, "artifact string, input string, fingerprint string")
    out = R.audit(frame(spark, claims), frame(spark, recomputed), bound, spark.createDataFrame(current, "name string, fingerprint string"))
    return {(r["artifact"], r["key"], r["measure"]): (r["verdict"], r["cause"]) for r in out.collect()}


def test_claims_hold_or_are_named(spark):
    bindings = [("cuts", "scores", "1"), ("metrics", "scores", "1"), ("metrics", "cuts", "c"), ("report", "metrics", "m")]
    current = [("scores", "1"), ("cuts", "c"), ("metrics", "m")]
    got = verdicts(spark, CLAIMS, CLAIMS, bindings, current)
    assert {v for k, v in got.items() if k[0] != "loose"} == {("holds", None)} and got["loose", "x", "y"] == ("unbound", None)
    wrong = [("cuts", "a", "eer", 0.5 + 1e-9), ("cuts", "b", "eer", 0.25 + 1e-13), ("metrics", "a", "far", None), ("metrics", "a", "frr", float("nan")), ("metrics", "a", "far2", 1.0), ("report", "all", "far", 0.3), ("report", "all", "far", 0.3)]
    got = verdicts(spark, wrong, CLAIMS, bindings, current)
    assert {k[:3]: v[0] for k, v in got.items()} == {
        ("cuts", "a", "eer"): "wrong", ("cuts", "b", "eer"): "holds", ("metrics", "a", "far"): "wrong", ("metrics", "a", "frr"): "wrong", ("metrics", "a", "far2"): "orphan", ("report", "all", "far"): "repeated", ("loose", "x", "y"): "missing",
    }


@pytest.mark.parametrize("now,states", [
    ([("scores", "2"), ("cuts", "c"), ("metrics", "m")], {"cuts": ("stale", "scores"), "metrics": ("stale", "scores"), "report": ("void", "metrics")}),
    ([("scores", "1"), ("cuts", "d"), ("metrics", "m")], {"metrics": ("stale", "cuts"), "report": ("void", "metrics")}),
    ([("scores", "1"), ("metrics", "m")], {"metrics": ("stale", "cuts"), "report": ("void", "metrics")}),
    ([("scores", "1"), ("cuts", "c"), ("metrics", "m")], {}),
])
def test_a_changed_input_voids_all_that_rests_on_it(spark, now, states):
    bindings = [("cuts", "scores", "1"), ("metrics", "scores", "1"), ("metrics", "cuts", "c"), ("report", "metrics", "m"), ("ring", "gnir", "g"), ("gnir", "ring", "r")]
    frames = spark.createDataFrame(bindings, "artifact string, input string, fingerprint string"), spark.createDataFrame([*now, ("gnir", "g"), ("ring", "r")], "name string, fingerprint string")
    assert {r["artifact"]: (r["state"], r["cause"]) for r in R.standing(*frames).collect()} == states
    got = verdicts(spark, CLAIMS, CLAIMS, bindings, [*now, ("gnir", "g"), ("ring", "r")])
    assert all(v == states.get(k[0], ("unbound" if k[0] == "loose" else "holds", None)) for k, v in got.items())
    passed = {r["artifact"]: r["passed"] for r in R.holds(R.audit(frame(spark, CLAIMS), frame(spark, CLAIMS), *frames)).collect()}
    assert passed == {a: a not in states and a != "loose" for a in ("cuts", "metrics", "report", "loose")}


def test_fingerprints_see_every_cell_and_no_order(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a", None), (2, "b", 0.5), (2, "b", 0.5)]
    prints = lambda r: {x["name"]: x["fingerprint"] for x in R.fingerprints(spark.createDataFrame(r, "i int, s string, v double"), F.lit("t")).collect()}
    assert prints(rows) == prints(rows[::-1]) != prints(rows[:2])
    assert prints(rows) != prints([(1, "a", 0.0), *rows[1:]])
