"""Hand-made cases: features, thresholds, gesture state machine, assignment, sessions, streams."""

import gzip
import json
import math
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from padlens.operators import contracts, features, gestures, joins, metrics, more, resample, sessions
from padlens.sources import archives, tables
from padlens.streaming import queries as streams


def line(spark, points):
    return spark.createDataFrame([(1, i, t, float(x), float(y)) for i, (x, y, t) in enumerate(points)], "e long, source_row long, t_ms long, x double, y double")


@pytest.mark.parametrize(
    "points, want",
    [
        ([(0, 0, 0), (1, 0, 100), (2, 0, 200)], {"duration_ms": 200, "length": 2, "v20": 10, "v50": 10, "v80": 10, "mean_speed": 10, "efficiency": 1, "a50": 0}),
        ([(0, 0, 0), (1, 0, 0), (2, 0, 100)], {"start_x": 1, "duration_ms": 100, "mean_speed": 10}),
        ([(0, 0, 0), (0, 0, 100), (1, 0, 200)], {"v50": 5, "mean_speed": 5, "resultant": 1}),
        ([(0, 0, 0), (1, -3, 100), (2, -1, 200), (3, 2, 300), (4, 0, 400)], {"max_dev": -3, "dev20": -1.4, "dev50": 0, "dev80": 0.4}),
        ([(x, 0, 100 * i) for i, x in enumerate([0, 7, 12, 16, 20, 25, 32, 42])], {"a20": -100, "a50": 50, "a80": 200, "early_accel": 0}),
        ([(7, 9, 15)], {"v50": 0, "length": 0, "max_dev": 0, "late_speed": 0, "end_x": 7}),
    ],
)
def test_finger_features(spark, points, want):
    row = features.finger_features(line(spark, points), ["e"]).first()
    assert {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} == {k: row[k] for k in want}


def test_typing_features(spark):
    keys = [(0, 50, "a"), (100, 160, "b"), (800, 850, "BACKSPACE"), (900, 970, "c")]
    df = spark.createDataFrame([(1, 1, s, e, a, i) for i, (s, e, a) in enumerate(keys)], "user_id long, session_id long, start_ms long, end_ms long, action string, event_id long")
    r = features.typing_features(df).first()
    assert (r["n_keys"], r["duration_ms"], r["hold_mean"], r["flight50"], r["bursts"]) == (4, 970, 57.5, 50, 2) and r["pause_fraction"] == pytest.approx(1 / 3)


def test_kinematics(spark):
    points = line(spark, [(0, 0, 0), (1, 0, 10), (3, 0, 20)]).withColumns({"pressure": (F.col("source_row") + 2) / 10, "size": F.lit(0.5)})
    r = features.kinematics(points, ["e"]).first()
    assert [r[k] for k in ("duration_ms", "path", "mean_speed", "max_speed", "max_accel", "median_dt", "pressure_mean", "size_std")] == pytest.approx([20, 3, 150, 200, 10000, 10, 0.3, 0])
    r = features.kinematics(points.filter("t_ms <= 10 or x > 5").unionByName(points.filter("t_ms = 10").withColumns({"t_ms": F.lit(90).cast("long"), "source_row": F.lit(9).cast("long")})), ["e"]).first()
    assert r["mean_speed"] == pytest.approx(1 / 0.09) and len(r) == 1 + 15  # one unit in 90 ms


def scores(spark, rows):
    return spark.createDataFrame([(1, lab, float(s)) for lab, s in rows], "cell int, label int, score double")


def test_equality_is_rejected(spark):
    df = scores(spark, [(0, -1), (0, 0), (1, 0), (1, 1)])
    cut = spark.createDataFrame([(1, 0.0)], "cell int, c double")
    r = metrics.at_cut(df, cut, ["cell"], "c").first()
    assert (r["frr"], r["far"]) == (0.5, 0) and metrics.auc(df, ["cell"]).first()["auc"] == 0.875


def test_empty_class_is_null(spark):
    r = metrics.at_cut(scores(spark, [(0, 1), (0, 2)]), spark.createDataFrame([(1, 1.5)], "cell int, c double"), ["cell"], "c").first()
    assert r["far"] is None and r["frr"] == 0.5
    assert metrics.auc(scores(spark, [(1, 1)]), ["cell"]).first()["auc"] is None


def test_cuts_against_brute_force(spark):
    rng = random.Random(0)
    rows = [(c, rng.randrange(2), rng.randrange(12) / 4) for c in range(8) for _ in range(40)]
    df = spark.createDataFrame(rows, "cell int, label int, score double").repartition(3)
    got = {r["cell"]: r for r in metrics.select_cuts(df, ["cell"]).collect()}
    for c in range(8):
        real = [s for k, y, s in rows if k == c and y == 0]
        fake = [s for k, y, s in rows if k == c and y == 1]
        v = sorted({*real, *fake})
        cuts = [v[0], *[a + 0.5 * (b - a) for a, b in zip(v, v[1:])], float("inf")]
        point = [(sum(f < t for f in fake) / len(fake), sum(r >= t for r in real) / len(real), t) for t in cuts]
        assert got[c]["eer"] == min((abs(fa - fr), max(fa, fr), t) for fa, fr, t in point)[2]
        assert got[c]["frr5"] == min((fa, -fr, t) for fa, fr, t in point if fr <= 0.05 + 1e-15)[2]


def machine(rows):
    """A plain state machine over one activity's frames."""
    frames = {}
    for t, code in rows:
        frames.setdefault(t, set()).add(code)
    out, start, n, orphan = [], None, 0, 0
    for t in sorted(frames):
        f = frames[t]
        if 0 in f:
            if start is not None:
                out.append((start, "restarted"))
            start, n = t, 0
        if start is None:
            orphan += 1
            continue
        n += 1
        if 3 in f or 1 in f:
            out.append((start, "cancelled" if 3 in f else "complete"))
            start = None
    if start is not None:
        out.append((start, "eof"))
    return sorted(out), orphan


def test_contacts_against_a_state_machine(spark):
    rng = random.Random(7)
    acts = {a: [(rng.randrange(20), rng.choice([0, 1, 2, 2, 3, 5, 6])) for _ in range(rng.randrange(1, 24))] for a in range(120)}
    df = spark.createDataFrame([(0, a, t, c, i) for a, rows in acts.items() for i, (t, c) in enumerate(rows)], "user_id long, act_id long, evt_t long, code int, source_row long")
    got = {}
    for r in gestures.contacts(df.repartition(4)).collect():
        got.setdefault(r["act_id"], []).append((r["start_ms"], r["state"]))
    want = {a: machine(rows) for a, rows in acts.items()}
    assert {a: sorted(got.get(a, [])) for a in acts} == {a: w[0] for a, w in want.items()}
    total = gestures.counters(df).first()
    assert total["orphan"] == sum(w[1] for w in want.values()) and total["rows"] == sum(map(len, acts.values()))


def test_one_finger_rows_out_of_order(spark):
    df = spark.createDataFrame([(0, 1, 110, 1, 204.0, 205.0, 1), (0, 1, 100, 0, 100.0, 200.0, 2)], "user_id long, act_id long, evt_t long, code int, x double, y double, source_row long")
    r = gestures.one_finger_pairs(df).first()
    assert (r["start_ms"], r["end_ms"], r["start_x"], r["end_y"]) == (100, 110, 100, 205) and r["contact_id"] < 0


def test_reserved_contact_blocks_a_later_action(spark):
    cols = "user_id long, session_id long, act_id long, start_ms long, end_ms long, x0 double, y0 double, x1 double, y1 double"
    z = (0.0,) * 4
    labels = spark.createDataFrame([(1, "swipe", 1, 1, 5, 100, 110, *z), (2, "tap", 1, 1, 5, 100, 110, *z), (3, "tap", 1, 1, 5, 500, 510, *z)], "event_id long, action string, " + cols)
    raw = spark.createDataFrame([(17, 1, 1, 5, 100, 110, *z)], "contact_id long, " + cols)
    got = {r["event_id"]: (r["contact_id"], r["status"]) for r in joins.assign(labels, joins.candidates(labels, raw, 5, 50)).collect()}
    assert got == {1: (17, "accepted"), 2: (None, "raw_contact_reserved_by_higher_priority_event"), 3: (None, "no_matching_complete_raw_contact")}


def test_pair_index_names_missing_chunks(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    right = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (4, 0)], "k long, chunk int")
    assert {r["k"]: r["status"] for r in joins.pair_index(left, right, ["k"], "chunk").collect()} == {1: "ok", 2: "broken", 3: "left_only", 4: "right_only"}


def test_session_validity(spark):
    rows = [(1, [(0, 1), (5, 6), (10, 11)]), (2, [(0, 9), (5, 6), (10, 11)]), (3, [(0, 1), (123, 124), (130, 131)]), (4, [(0, 1), (5, 6)])]
    df = spark.createDataFrame([(u, 1, a * 1000, b * 1000, i) for u, es in rows for i, (a, b) in enumerate(es)], "user_id long, session_id long, start_ms long, end_ms long, event_id long")
    assert {r["user_id"]: r["kept"] for r in sessions.validity(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_drawn_users_keep_all_their_rows(spark):
    users = spark.createDataFrame([(10,), (20,), (30,)], "user_id long")
    drawn = resample.draws(users, 50, "x")
    assert {r["n"] for r in drawn.groupBy("rep").agg(F.sum("mult").alias("n")).collect()} == {3}
    counts = spark.createDataFrame([(1, u, 1, n, 0, n) for u, n in ((10, 2), (20, 3), (30, 1))], "cell int, user_id long, accepted long, n_fake long, rejected long, n_real long")
    want = {r["rep"]: 3 / r["n"] for r in drawn.join(counts, "user_id").groupBy("rep").agg(F.sum(F.col("mult") * F.col("n_fake")).alias("n")).collect()}
    assert {r["rep"]: r["far"] for r in resample.replicate_rates(counts, drawn, ["cell"]).collect()} == pytest.approx(want)


def test_unchanged_rows_name_the_columns(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, "y")], "k long, v double, s string")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, "z"), (4, 3.0, "y")], "k long, v double, s string")
    assert {r["k"]: r["what"] for r in contracts.unchanged(a, b, "k", ["v", "s"]).collect()} == {2: "v,s", 3: "left_only", 4: "right_only"}


def test_pinch_features_by_plain_python(spark):
    """Angles across half a turn, coincident fingers at the start, inside and at the end, and one frame alone."""
    import numpy as np

    rng = np.random.default_rng(7)
    events = {}
    for e in range(6):
        n = 1 if e == 5 else 14
        t = np.cumsum(rng.integers(5, 40, n))
        a, b = rng.normal(0, 1, (n, 2)).cumsum(0), rng.normal(0, 1, (n, 2)).cumsum(0)
        for k in {1: [0, 1], 2: [5, 6], 3: [12, 13], 4: range(14)}.get(e, []):
            b[k] = a[k]
        events[e] = t, a, b
    rows = [(e, int(t[i]), *map(float, (*a[i], *b[i]))) for e, (t, a, b) in events.items() for i in range(len(t))]
    got = {r["event"]: r for r in more.pinch_features(spark.createDataFrame(rows, "event long, t_ms long, x0 double, y0 double, x1 double, y1 double")).collect()}
    for e, (t, a, b) in events.items():
        span, v = np.linalg.norm(b - a, axis=1), b - a
        good = span > 1e-12
        angle = np.interp(np.arange(len(t)), np.flatnonzero(good), np.unwrap(np.arctan2(v[good, 1], v[good, 0]))) if good.any() else np.zeros(len(t))
        dt = np.diff(t) / 1000
        p = lambda x, q: float(np.percentile(x, q)) if len(x) else 0.0
        m = lambda x: float(np.mean(x)) if len(x) else 0.0
        l0, l1 = (np.linalg.norm(np.diff(x, axis=0), axis=1) for x in (a, b))
        centre = (a + b) / 2
        want = {"span_std": span.std(), "span_path": np.abs(np.diff(span)).sum(), "span_delta": span[-1] - span[0], "span_delta_abs": abs(span[-1] - span[0]), "span_rate_abs": m(np.abs(np.diff(span) / dt)), "angle_first": angle[0], "angle_last": angle[-1],
                "angle_total": angle[-1] - angle[0], "angle_path": np.abs(np.diff(angle)).sum(), "angular_speed": m(np.abs(np.diff(angle) / dt)), "length0": l0.sum(), "length1": l1.sum(), "center_length": np.linalg.norm(np.diff(centre, axis=0), axis=1).sum(),
                "center_duration_ms": t[-1] - t[0], "speed_corr": np.corrcoef(l0 / dt, l1 / dt)[0, 1] if len(dt) >= 2 else 0.0}
        want |= {f"span_rate{q}": p(np.diff(span) / dt, q) for q in (20, 50, 80)} | {f"angular{q}": p(np.diff(angle) / dt, q) for q in (20, 50, 80)}
        assert {k: got[e][k] for k in want} == pytest.approx(want, abs=1e-9), e
    assert sum(c.startswith("center_") for c in got[0].asDict()) == 24


def test_events_go_to_the_features_of_their_action(spark):
    from padlens.operators.dispatch import event_features

    events = spark.createDataFrame([(1, "tap"), (2, "pinch"), (3, "keystroke"), (4, "keystroke"), (5, "fling"), (6, "swipe"), (7, "pinch"), (8, "keystroke")], "event_id long, action string")
    point = lambda e, slot, t, row, x, contact=1, k=0: (e, slot, t, row, x, 0.0, contact, k)
    points = [point(1, 0, 0, 0, 0.0), point(1, 0, 10, 1, 3.0), point(1, 0, 20, 2, 9.0, 0), point(1, 1, 10, 3, 50.0), point(6, 0, 0, 4, 1.0, 0)]
    points += [point(2, s, t, 10 + t + s, float(s * (1 + t))) for t in (0, 1, 2) for s in (0, 1) if (t, s) != (2, 1)] + [point(2, 1, 1, 99, 5.0), point(7, 0, 0, 20, 1.0), point(7, 1, 1, 21, 1.0)]
    points += [point(3, 0, 0, 30, 8.0, 0), point(3, 0, 5, 31, 1.0), point(3, 0, 6, 32, 2.0), point(3, 0, 9, 33, 5.0, 1, 1), point(4, 0, 0, 40, 1.0), point(4, 0, 0, 41, 1.0, 0, 1)]
    keys = [(3, 0, 65, 0, 50), (3, 1, -5, 60, 90), (4, 0, 97, 0, 50), (4, 1, 98, 60, 90)]
    out = event_features(events, spark.createDataFrame(points, "event_id long, slot int, t_ms long, source_row long, x double, y double, contact int, key_index int"), spark.createDataFrame(keys, "event_id long, key_index int, keycode int, down_ms long, up_ms long"))
    got = {r["event_id"]: r for r in out.collect()}
    assert {i: r["problem"] for i, r in got.items()} == {1: None, 2: None, 3: None, 4: None, 5: "unsupported_action", 6: "no_contact_row", 7: "no_simultaneous_two_pointer_frame", 8: "no_key"}
    assert got[1]["finger"]["length"] == 3.0 and got[1]["pinch"] is None and got[1]["typing"] is None
    assert (got[2]["pinch"]["n_frames"], got[2]["pinch"]["span_first"], got[2]["pinch"]["span_last"]) == (2, 1.0, 5.0)
    typed = got[3]["typing"]
    assert (typed["n_keys"], typed["n_letters"], typed["has_xy"], typed["way_sum"]) == (2, 1, 1, 4.0) and (got[4]["typing"]["has_xy"], got[4]["typing"]["way_sum"]) == (0, 0.0)


def test_spans_and_paths_equal_sql_to_the_last_bit(spark):
    """F.hypot is off by the last bit in some rows, so that values on a tie of the last digit are rounded otherwise than in SQL."""
    rng = random.Random(5)
    rows = [(e, t, *(rng.randrange(50_000) / 100 for _ in range(4))) for e in range(300) for t in (0, 10)]
    assert any(math.hypot(x1 - x0, y1 - y0) != math.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) for _, _, x0, y0, x1, y1 in rows)
    got = {r["event"]: r for r in more.pinch_features(spark.createDataFrame(rows, "event long, t_ms long, x0 double, y0 double, x1 double, y1 double")).collect()}
    way = lambda dx, dy: math.sqrt(dx * dx + dy * dy)
    for (e, _, *a), (_, _, *b) in zip(rows[::2], rows[1::2]):
        assert [got[e][c] for c in ("span_first", "span_last", "length0", "length1")] == [way(a[2] - a[0], a[3] - a[1]), way(b[2] - b[0], b[3] - b[1]), way(b[0] - a[0], b[1] - a[1]), way(b[2] - a[2], b[3] - a[3])]
        mid = [[(p[0] + p[2]) / 2, (p[1] + p[3]) / 2] for p in (a, b)]
        assert got[e]["center_length"] == way(mid[1][0] - mid[0][0], mid[1][1] - mid[0][1])
        assert got[e]["length_centre"] == way(*((b[k] + b[k + 2] - a[k] - a[k + 2]) / 2 for k in (0, 1)))


def test_pinch_angle_is_unwrapped(spark):
    import math

    rows = [(1, 10 * i, 0.0, 0.0, math.cos(i * 2.0), math.sin(i * 2.0)) for i in range(8)]
    r = more.pinch_features(spark.createDataFrame(rows, "event long, t_ms long, x0 double, y0 double, x1 double, y1 double")).first()
    assert r["angle_total"] == pytest.approx(14.0) and r["span_rate"] == pytest.approx(0, abs=1e-6)


def test_readers(spark, tmp_path):
    folder = tmp_path / "raw" / "7" / "3"
    folder.mkdir(parents=True)
    (folder / "Touch.csv").write_text("1,2,3,1,0,0,1.5,2,0.1,0.2,0\n1,bad,3,1,0,0,1.5,2,0.1,0.2,0\n1,5,3,1,0,1,1.5,2,0.1,,0\n")
    got = tables.touch_csv(spark, f"{tmp_path}/raw/*/*/*.csv").collect()
    assert [(r["evt_t"], r["x"], r["user_id"], r["session_id"]) for r in got] == [(2, 1.5, "7", "3")]
    inner = tmp_path / "u.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("7/3/Touch.csv", "1,2\n")
        z.writestr("__MACOSX/x", "no")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.write(inner, "u.zip")
    entries = {r["name"]: r["kept"] for r in archives.archive_rows(spark, str(tmp_path / "all.zip")).collect()}
    assert entries == {"7/3/Touch.csv": True, "__MACOSX/x": False}
    cell = tmp_path / "scores" / "tap" / "imu" / "forest"
    cell.mkdir(parents=True)
    with gzip.open(cell / "s.jsonl.gz", "wt") as f:
        f.write(json.dumps({"event_id": 1, "user_id": 2, "label": 1, "fake_high_score": 0.5}) + "\n")
    r = tables.score_lines(spark, str(tmp_path / "scores")).first()
    assert (r["action"], r["modality"], r["detector"], r["fake_high_score"]) == ("tap", "imu", "forest", 0.5)
    (tmp_path / "t.json").write_text(json.dumps({"frr5": 1.0, "eer": 2.0, "score_direction": "larger_is_more_fake", "selection_split": "test", "target_frr": 0.05}))
    assert tables.threshold_files(spark, str(tmp_path / "t.json")).first()["valid"] is False


def test_streaming_contacts_equal_batch(spark, tmp_path):
    """Several batches, rows out of order by less than the delay: the contacts of the batch form, up to the watermark."""
    rng = random.Random(3)
    rows = [(u, u, 1000 * t, rng.choice([0, 1, 2, 3]), i) for u in range(5) for i, t in enumerate(sorted(rng.sample(range(4000), 60)))]
    rows.append((9, 9, 5_000_000, 0, 0))
    df = spark.createDataFrame(rows, "user_id long, act_id long, evt_t long, code int, source_row long").withColumn("ts", F.timestamp_millis("evt_t"))
    late = sorted(rows, key=lambda r: r[2] + rng.randint(0, 300_000))
    for k in range(6):
        spark.createDataFrame(late[k * len(late) // 6 : (k + 1) * len(late) // 6], df.schema.names[:5]).selectExpr("user_id", "act_id", "evt_t", "int(code) code", "source_row", "timestamp_millis(evt_t) ts").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    out = streams.contacts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["user_id", "start_ms", "end_ms", "n_frames", "state"]
    got = {tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).select(key).collect() if r["state"] != "eof"}
    want = {tuple(r) for r in gestures.contacts(df).select(key).collect() if r["state"] != "eof"}
    assert got == want and len(want) > 50


def test_streaming_contacts_go_on_after_a_restart(spark, tmp_path):
    """A query that is stopped after each file and started again from its checkpoint gives the same contacts, each once."""
    rng = random.Random(6)
    rows = [(u, u, 1000 * t, rng.choice([0, 1, 2, 3]), i) for u in range(3) for i, t in enumerate(sorted(rng.sample(range(3000), 40)))]
    rows.append((9, 9, 5_000_000, 0, 0))
    names = ["user_id", "act_id", "evt_t", "code", "source_row"]
    df = spark.createDataFrame(rows, "user_id long, act_id long, evt_t long, code int, source_row long").withColumn("ts", F.timestamp_millis("evt_t"))
    late = sorted(rows, key=lambda r: r[2] + rng.randint(0, 300_000))
    for k in range(3):
        spark.createDataFrame(late[k * len(late) // 3 : (k + 1) * len(late) // 3], names).selectExpr("user_id", "act_id", "evt_t", "int(code) code", "source_row", "timestamp_millis(evt_t) ts").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streams.contacts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    key = ["user_id", "start_ms", "end_ms", "n_frames", "state"]
    got = [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).select(key).collect() if r["state"] != "eof"]
    want = [tuple(r) for r in gestures.contacts(df).select(key).collect() if r["state"] != "eof"]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_a_late_end_closes_its_own_contact(spark, tmp_path):
    """DOWN 500 and DOWN 1000 come before UP 800 of the first contact: 500-800 complete, 1000-1300 complete."""
    for k, part in enumerate([[(1, 500, 0), (1, 1000, 0)], [(1, 800, 1), (1, 1300, 1)], [(2, 10_000_000, 0)]]):
        rows = spark.createDataFrame(part, "user_id long, evt_t long, code int").selectExpr("user_id", "user_id act_id", "evt_t", "code", "timestamp_millis(evt_t) ts")
        rows.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    out = streams.contacts(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["start_ms"], r["end_ms"], r["state"]) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(500, 800, "complete"), (1000, 1300, "complete")]


def test_sensor_axes_stay_real(spark):
    r = tables.cleaned(spark.createDataFrame([("5", "0.5", "-1.25", "0.987"), ("6", "1", "2", "x")], "t string, x string, y string, z string"), tables.SENSOR).collect()
    assert [tuple(x) for x in r] == [(5.0, 0.5, -1.25, 0.987)]


def test_typing_pauses_lie_between_downs(spark):
    """Downs 0, 400, 1000 with ups 390, 410, 1010: flights 10 and 590, down-down 400 and 600: one pause; held 400..900: none."""
    schema = "user_id long, session_id long, start_ms long, end_ms long, action string, event_id long, x double, y double"
    keys = [(1, 1, 0, 390, "a", 0, 0.0, 0.0), (1, 1, 400, 410, "DEL", 1, 3.0, 4.0), (1, 1, 1000, 1010, "7", 2, 3.0, 4.0), (2, 1, 0, 10, "a", 0, 0.0, 0.0), (2, 1, 520, 1500, "A", 1, 6.0, 8.0), (2, 1, 1000, 1600, "é", 2, 6.0, 8.0)]
    a, b = features.typing_features(spark.createDataFrame(keys, schema)).orderBy("user_id").collect()
    assert (a["bursts"], a["burst_max"], a["pause_fraction"], a["n_letters"], a["n_unique"], a["way_sum"], a["step50"]) == (2, 2, 0.5, 1, 3, 5, 500)
    assert a["correction_ratio"] == pytest.approx(1 / 3) and a["key_rate"] == pytest.approx(3 / 1.01) and a["way50"] == 2.5
    assert (b["bursts"], b["overlap"], b["n_letters"], b["n_unique"], b["duration_ms"], b["has_xy"]) == (2, 0.5, 3, 2, 1600, 1)
    assert len(a) == 2 + 34


def test_no_movement_has_no_efficiency(spark):
    r = features.finger_features(line(spark, [(1, 1, 0), (1, 1, 50)]), ["e"]).first()
    assert (r["efficiency"], r["mean_speed"], r["duration_ms"]) == (0, 0, 50)
    r = features.finger_features(line(spark, [(0, 0, 0), (1, 0, 10), (1, 0, 100)]), ["e"]).first()
    assert r["mean_speed"] == pytest.approx(10)  # 1 in 0.1 s, not the mean of 100 and 0


def test_rhythm_by_hand(spark):
    """Starts 0, 8, 9 s; ends 10, 8.5, 11 s: gaps -2 (as 0) and 0.5; onsets 0, 10, 11 s; four bins of 3 s."""
    rows = [(1, 1, "a", 0, 10_000, 0), (1, 1, "b", 8_000, 8_500, 1), (1, 1, "b", 9_000, 11_000, 2), (2, 1, "a", 0, 5, 3)]
    df = spark.createDataFrame(rows, "user_id long, session_id long, action string, start_ms long, end_ms long, event_id long")
    assert [r["onset_s"] for r in sessions.gaps(df).orderBy("event_id").collect()] == [0, 10, 11, 0]
    r, one = sessions.rhythm_features(df, 30.0, 3.0).orderBy("user_id").collect()
    import math

    assert (r["duration_s"], r["gap_mean"], r["gap_std"], r["gap_min"], r["n_gaps"], r["repeat_rate"]) == (11, 0.25, 0.25, 0, 2, 0.5)
    assert (r["occ_empty"], r["occ_mean"], r["occ_max"]) == (0.5, 0.75, 2) and r["gap_cv"] == pytest.approx(1) and r["gap_log_std"] == pytest.approx(math.log(1.5) / 2)
    assert r["gap_entropy"] == 0 and r["entropy1"] == pytest.approx(-(math.log(1 / 3) / 3 + 2 * math.log(2 / 3) / 3))
    assert (one["n_gaps"], one["gap50"], one["duration_s"], one["occ_mean"], one["occ_max"]) == (2, 0, 0, 0, 0) and len(r) == 2 + 19


def test_linear_window_of_one_row_is_constant(spark):
    got = features.linear(spark.createDataFrame([(1, 0, 7.0), (2, 0, 0.0), (2, 1, 4.0)], "vec_id long, i int, v double"), 3).collect()
    assert sorted((r["vec_id"], r["k"], r["v"]) for r in got) == [(1, 0, 7), (1, 1, 7), (1, 2, 7), (2, 0, 0), (2, 1, 2), (2, 2, 4)]


def test_comparison_uses_training_rows_and_the_wider_scale(spark):
    rows = [(0, 0, "train", 100.0)] * 5 + [(0, 0, "test", 900.0)] * 5 + [(0, 1, "test", 102.0)] * 4
    r = metrics.real_fake_comparison(spark.createDataFrame(rows, "c int, label int, pool string, v double"), ["c"], "v").first()
    assert (r["outside"], r["distance"], r["ratio99"]) == (1, 2, pytest.approx(1.02))  # quartile range 0: 1 % of the median is 1


def test_pinch_slack_is_not_offset(spark):
    """A contact that begins 500 late has no slack before, so 300 after don't become -200."""
    label = spark.createDataFrame([(1, 1, 1, 1, "pinch", 1000, 2000, 0.0, 0.0, 0.0, 0.0)], "event_id long, user_id long, session_id long, act_id long, action string, start_ms long, end_ms long, x0 double, y0 double, x1 double, y1 double")
    contact = lambda a, b: spark.createDataFrame([(7, 1, 1, 1, a, b, 0.0, 3.0, 0.0, 4.0)], "contact_id long, user_id long, session_id long, act_id long, start_ms long, end_ms long, x0 double, y0 double, x1 double, y1 double")
    assert joins.candidates(label, contact(1500, 2300), 500, 100).count() == 0
    assert joins.candidates(label, contact(900, 2100), 500, 100).first()["score"] == pytest.approx(200.07)


def test_energy_distance_by_hand(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 4.0), ("b", 6.0)], "side string, m double")
    scale = 5**0.5  # spread of 0, 2, 4, 6
    assert more.energy_distance(rows, rows, ["m"], "a", "b").first()["energy"] == pytest.approx((2 * 4 - 1 - 1) / scale)


def test_session_points_by_hand(spark):
    flags = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 0.0), (2, 0.0), (3, 1.0), (3, 1.0), (3, 1.0), (3, 0.0)], "user_id long, flag double")
    r = sessions.user_spread(flags, 6.0).first()  # rates 0.5, 0, 0.75
    assert (r["median"], r["p90"], r["pooled"]) == (0.5, pytest.approx(0.7), 0.5) and r["days_median"] == pytest.approx(1 / 3) and r["days_p90"] == pytest.approx(1 / 4.2)
    b = sessions.beta_binomial(flags).first()  # mean 0.5, variance (2*0 + 2*.25 + 4*.0625) / 8 = 0.09375, mean size 8/3
    rho = (0.09375 - 0.25 * 3 / 8) / (0.25 * (1 - 3 / 8))
    assert (b["mean"], b["rho"]) == (0.5, pytest.approx(max(rho, 1e-6)))
    edges = sessions.ratio_edges(spark.createDataFrame([(0.0,)] * 30 + [(1.0,)] * 5 + [(2.0,)] * 30, "v double"), "v").first()["edges"]
    assert 0.0 not in edges and 2.0 not in edges and 1.0 in edges
    assert sessions.ratio_edges(spark.createDataFrame([(3.0,)] * 4, "v double"), "v").first()["edges"] == [3.0]
    stats = spark.createDataFrame([(0, 5), (0, 7), (1, 6), (1, 9)], "label int, v int")
    points = sorted((r["v"], r["caught"], r["false_alarm"]) for r in sessions.roc(stats, "v").collect())
    assert points[0] == (float("-inf"), 1, 1) and points[-1] == (float("inf"), 0, 0) and points[2] == (6, 1, 0.5)
    from padlens.operators import reports

    r = reports.oracle_point(stats, "v", 1.0).first()
    assert (r["caught"], r["false_alarm"]) == (1, 1)  # k = N: everything is flagged


def test_disjoint_price_against_every_target(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 6)) for _ in range(60)]
    side = {f: {y: sorted((v for g, z, v in rows if (g, z) == (f, y)), reverse=True) for y in (0, 1)} for f in (0, 1)}
    targets = sorted({i / len(side[f][0]) for f in (0, 1) for i in range(len(side[f][0]) + 1)})
    points = []
    for q in targets:
        flagged = {0: 0, 1: 0}
        for f in (0, 1):
            k = int((q + 1e-12) * len(side[f][0]))
            cut = side[f][0][k] if k < len(side[f][0]) else -1
            for y in (0, 1):
                flagged[y] += sum(v > cut for v in side[1 - f][y])
        points.append([flagged[y] / sum(z == y for _, z, _ in rows) for y in (0, 1)])
    r = more.disjoint_price(spark.createDataFrame(rows, "fold int, label int, v int"), "v").first()
    for t in (0.5, 0.8):
        assert r[f"price_{round(100 * t)}"] == pytest.approx(min(a for a, c in points if c >= t))


def test_mirrored_draw_has_no_repeats_in_a_session(spark):
    from padlens.operators import splits

    genuine = spark.createDataFrame([(1, s, "tap") for s in range(6) for _ in range(s + 1)] + [(2, 0, "tap")], "user_id long, session_id long, action string")
    fake = spark.createDataFrame([(1, "tap", 100 + i) for i in range(4)] + [(3, "tap", 9)], "user_id long, action string, event_id long")
    got = {}
    for r in splits.mirrored_draw(genuine, fake, 3).collect():
        got.setdefault((r["rep"], r["user_id"], r["session_id"]), []).append(r["fake_id"])
    assert {k: len(v) for k, v in got.items()} == {(rep, 1, s): min(s + 1, 4) for rep in range(3) for s in range(6)}
    assert all(len(set(v)) == len(v) for v in got.values())


def test_streamed_scores_equal_batch_scores(spark, tmp_path):
    from padlens.operators import detectors
    from padlens.plans.stream_queries import feature_rows

    rows = feature_rows(spark, "/root/testdata/sf0.001").cache()
    model = detectors.detector("logistic", ["f0", "f1", "f2", "f3"]).fit(detectors.balanced(rows.filter("pool = 'train'")))
    test = rows.filter("pool = 'test'")
    test.write.parquet(str(tmp_path / "in"))
    out = streams.scored(spark.readStream.schema(test.schema).parquet(str(tmp_path / "in")), model)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({r["event_id"]: r["score"] for r in detectors.scored(model, test).collect()})


def test_cross_fitted_cuts_of_weighted_users(spark):
    """By hand: user 1 drawn twice, 2 never in fold 0; alpha 0.5 of two genuine sessions leaves k = 1, so the cut is the lesser one."""
    rows = [(0, 1, 0, 1.0), (0, 1, 1, 9.0), (0, 2, 0, 50.0), (1, 3, 0, 4.0), (1, 4, 0, 6.0), (1, 3, 1, 0.5), (1, 4, 1, 5.0)]
    stats = spark.createDataFrame(rows, "fold int, user_id long, label int, v double")
    drawn = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 3, 1), (0, 1, 4, 1)], "rep int, fold int, user_id long, mult long")
    got = {r["mode"]: (r["caught"], r["false_alarm"]) for r in resample.crossfit_replicates(stats, drawn, "v", 0.5, []).collect()}
    # fold 0's cut 1 flags 4, 6 and the fake at 5, not that at 0.5; fold 1's cut 4 flags the fake at 9 (twice), not 1 (twice)
    # all four genuine 1, 1, 4, 6: k = 2, cut 1 flags the same
    assert got == {"crossfit": (3 / 4, 2 / 4), "oracle": (3 / 4, 2 / 4)}


def test_keys_take_raw_contacts_first(spark):
    keys = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21), (2, 22), (3, 30)], "e long, key_id long")
    raw = spark.createDataFrame([(10, 100, None), (11, 101, "bad"), (20, 102, "bad"), (21, None, None)], "key_id long, contact_id long, reason string")
    one = spark.createDataFrame([(10, 200, None), (11, 201, None), (20, 202, "worse"), (22, 203, "worse")], "key_id long, contact_id long, reason string")
    nothing = "key_has_no_matching_raw_or_one_finger_contact"
    got = {r["e"]: tuple(r)[1:] for r in joins.two_sources(keys, raw, one, ["e"]).collect()}
    assert got[1] == (2, 1, 1, "accepted", None)
    assert got[2] == (3, 0, 0, "rejected", f"incomplete_key_touch_alignment:bad=1;{nothing}=1;worse=1")
    assert got[3] == (1, 0, 0, "rejected", f"incomplete_key_touch_alignment:{nothing}=1")
    allowed = {r["e"]: (r["status"], r["reason"]) for r in joins.two_sources(keys, raw, one, ["e"], partial=True).collect()}
    assert allowed == {1: ("accepted", None), 2: ("rejected", "typing_event_has_zero_aligned_keys"), 3: ("rejected", "typing_event_has_zero_aligned_keys")}
    assert joins.two_sources(keys.limit(0), raw, one, ["e"]).count() == 0


def test_modalities_a_method_changed(spark):
    scores = spark.createDataFrame([(m, k) for m in "abc" for k in ("trajectory", "imu", "joint")], "method string, modality string")
    flags = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True)], "method string, touch boolean, sensor boolean")
    assert sorted(map(tuple, more.covered(scores, flags).collect())) == [("a", "imu"), ("a", "joint"), ("a", "trajectory"), ("b", "trajectory"), ("c", "imu")]
