"""Gesture and feature queries over the touch, rhythm and window views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlens.operators import features as X
from padlens.operators import gestures as G
from padlens.plans import adapters as A
from padlens.plans.adapters import BINS, CELL, RHYTHM, SCORES, TOUCH, WINDOWS
from padlens.plans.metric_queries import rounded

KEY = [*G.KEY, "seg"]
OFF = 1e-9
TOKENS = ["a", "B", "é", "BackSpace", "7", "keycode_66", "del"]


def contact_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.touch(spark, sf).withColumn("contact", (F.col("source_row") % 4 != 0).cast("int"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return A.rhythm(spark, sf)


def keystrokes(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as typing: tokens, and key places from the event's number."""
    token = F.element_at(F.array(*map(F.lit, TOKENS)), (F.col("event_id") % len(TOKENS) + 1).cast("int"))
    place = lambda k: (F.col("event_id") % k).cast("double")
    return A.rhythm(spark, sf).withColumns({"action": token, "x": place(13), "y": place(7)})


def pressed(points: DataFrame) -> DataFrame:
    """Points with a pressure and a size."""
    return points.withColumns({"pressure": F.col("x") / 100, "size": (F.col("source_row") % 5) / 10})


def pointer_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf)
    return t.select(F.col("user_id").alias("event"), (F.col("source_row") % 2).cast("int").alias("pointer"), F.col("evt_t").alias("t_ms"), "source_row", "x")


def all_rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return rounded(df, *[n for n, t in df.dtypes if t == "double"], digits=digits)


def off_ties(df: DataFrame) -> DataFrame:
    """df with OFF added to its doubles: means of terminating decimals fall on ties of the last digit, which two sums of
    another order round to either side."""
    return df.withColumns({n: F.col(n) + OFF for n, t in df.dtypes if t == "double"})


QUERIES = {
    "g1_frame_collapse": lambda s, d: G.frames(A.touch(s, d)),
    "g2_contact_reconstruction": lambda s, d: G.contacts(A.touch(s, d)),
    "g3_frame_index": lambda s, d: G.points(A.touch(s, d)).select("source_row", "seg", "t_ms", "frame"),
    "g5_one_finger_pairs": lambda s, d: G.one_finger_pairs(A.touch(s, d)),
    "g6_parser_counters": lambda s, d: G.counters(A.touch(s, d)),
    "g8_last_row_of_frame": lambda s, d: G.last_row_of_frame(A.touch(s, d)),
    "g9_gap_rows": lambda s, d: G.with_gap_rows(sessions(s, d)),
    "g10_contact_phase": lambda s, d: G.contact_phase(contact_rows(s, d).withColumn("slot", F.col("source_row") % 2), "slot").select("source_row", "phase"),
    "g12_deltas": lambda s, d: all_rounded(G.deltas(contact_rows(s, d)).select("source_row", "dx", "dy")),
    "g13_union_timeline": lambda s, d: G.union_timeline(pointer_rows(s, d)),
    "f1_coalesced": lambda s, d: X.coalesced(G.points(A.touch(s, d)), KEY).select("source_row", "t_ms"),
    "f2_primitives": lambda s, d: all_rounded(X.primitives(G.points(A.touch(s, d)), KEY).select("source_row", "dt", "dx", "dy", "length", "speed", "accel")),
    "f3_finger_features": lambda s, d: all_rounded(X.finger_features(G.points(A.touch(s, d)), KEY)),
    "f5_typing_features": lambda s, d: all_rounded(X.typing_features(keystrokes(s, d))),
    "f7_kinematics": lambda s, d: all_rounded(off_ties(X.kinematics(pressed(G.points(A.touch(s, d))), KEY))),
    "f10_concatenated": lambda s, d: all_rounded(X.concatenated(A.windows(s, d)).select("vec_id", "chunk", "j", "t_ms", "v")),
    "f11_channel_statistics": lambda s, d: all_rounded(X.channel_statistics(A.windows(s, d))),
    "f17_normaliser": lambda s, d: all_rounded(X.normaliser(A.scores(s, d), "score", CELL).select("event_id", "z")),
    "f18_lag_one_correlation": lambda s, d: all_rounded(X.lag_one_correlation(A.windows(s, d))),
    "f19_window_summaries": lambda s, d: all_rounded(X.window_summaries(A.windows(s, d))),
    "f20_held": lambda s, d: all_rounded(X.held(A.windows(s, d), 25)),
    "f21_linear": lambda s, d: all_rounded(X.linear(A.windows(s, d), 25)),
    "f22_duration_summary": lambda s, d: all_rounded(X.duration_summary(A.bins(s, d), ["arm"], cap=45.0)),
}

_SEG = f"""{TOUCH}, frames AS (SELECT user_id, act_id, evt_t, count(*) AS n_rows, bool_or(code = 0) AS down, bool_or(code = 1) AS up, bool_or(code = 3) AS cancel,
  count(DISTINCT code) > 1 AS mixed, count(*) FILTER (code NOT IN (0, 1, 2, 3, 5, 6)) AS unsupported FROM touch GROUP BY ALL),
s AS (SELECT *, CAST(sum(CAST(down AS INTEGER)) OVER (PARTITION BY user_id, act_id ORDER BY evt_t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM frames),
segs AS (SELECT *, min(CASE WHEN up OR cancel THEN evt_t END) OVER (PARTITION BY user_id, act_id, seg) AS term, max(seg) OVER (PARTITION BY user_id, act_id) AS last_seg FROM s),
contacts AS (SELECT user_id, act_id, seg, min(evt_t) AS start_ms, max(evt_t) AS end_ms, count(*) AS n_frames, CAST(sum(n_rows) AS BIGINT) AS n_rows,
  CASE WHEN max(term) IS NULL THEN CASE WHEN seg < max(last_seg) THEN 'restarted' ELSE 'eof' END WHEN bool_or(cancel AND evt_t = term) THEN 'cancelled' ELSE 'complete' END AS state
  FROM segs WHERE seg > 0 AND (term IS NULL OR evt_t <= term) GROUP BY user_id, act_id, seg)"""
_POINTS = f"""{_SEG}, points AS (SELECT t.user_id, t.act_id, seg, t.source_row, t.x, t.y, t.evt_t, t.evt_t - c.start_ms AS t_ms,
  CAST(dense_rank() OVER (PARTITION BY t.user_id, t.act_id, seg ORDER BY t.evt_t) - 1 AS INTEGER) AS frame
  FROM touch t JOIN segs g USING (user_id, act_id, evt_t) JOIN contacts c USING (user_id, act_id, seg) WHERE c.state = 'complete' AND t.evt_t BETWEEN c.start_ms AND c.end_ms)"""
_PRIM = f"""{_POINTS}, c1 AS (SELECT * FROM points QUALIFY coalesce(lead(t_ms) OVER (PARTITION BY user_id, act_id, seg ORDER BY t_ms, source_row) <> t_ms, true)),
p1 AS (SELECT *, (t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM c1 WINDOW w AS (PARTITION BY user_id, act_id, seg ORDER BY t_ms)),
p2 AS (SELECT *, sqrt(dx * dx + dy * dy) AS length, sqrt(dx * dx + dy * dy) / dt AS speed FROM p1),
prim AS (SELECT *, (speed - lag(speed) OVER w) / dt AS accel FROM p2 WINDOW w AS (PARTITION BY user_id, act_id, seg ORDER BY t_ms))"""


def _r(name: str) -> str:
    return f"round({name}, 5) AS {name}"


def _off(name: str) -> str:
    return f"round({name} + {OFF}, 5) AS {name}"


def _q(value: str, level: float, name: str) -> str:
    return f"round(coalesce(quantile_cont({value}, {level}), 0), 5) AS {name}"


_CONTACT = f"""{TOUCH}, rows AS (SELECT *, CAST(source_row % 4 <> 0 AS INTEGER) AS contact FROM touch)"""
_WP = "(PARTITION BY user_id, act_id ORDER BY evt_t, source_row)"

ORACLES = {
    "g1_frame_collapse": f"WITH {_SEG} SELECT * FROM frames",
    "g2_contact_reconstruction": f"WITH {_SEG} SELECT * FROM contacts",
    "g3_frame_index": f"WITH {_POINTS} SELECT source_row, seg, t_ms, frame FROM points",
    "g5_one_finger_pairs": f"""WITH {TOUCH}, r AS (SELECT *, lag(code) OVER w AS was, lag(evt_t) OVER w AS start_ms, lag(x) OVER w AS start_x, lag(y) OVER w AS start_y FROM touch WHERE code IN (0, 1) WINDOW w AS {_WP})
SELECT user_id, act_id, -source_row AS contact_id, start_ms, evt_t AS end_ms, start_x, start_y, x AS end_x, y AS end_y FROM r WHERE code = 1 AND was = 0 AND evt_t > start_ms""",
    "g6_parser_counters": f"""WITH {_SEG} SELECT CAST(sum(n_rows) AS BIGINT) AS rows, count(*) AS frames, count(*) FILTER (seg = 0 OR evt_t > term) AS orphan,
 (SELECT count(*) FROM contacts WHERE state = 'complete') AS complete, (SELECT count(*) FROM contacts WHERE state = 'cancelled') AS cancelled,
 (SELECT count(*) FROM contacts WHERE state = 'restarted') AS restarted, (SELECT count(*) FROM contacts WHERE state = 'eof') AS eof FROM segs""",
    "g8_last_row_of_frame": f"WITH {TOUCH} SELECT user_id, act_id, evt_t, code, x, y, source_row FROM touch QUALIFY row_number() OVER (PARTITION BY user_id, act_id, evt_t ORDER BY source_row DESC) = 1",
    "g9_gap_rows": f"""WITH {RHYTHM}, r AS (SELECT *, lag(end_ms) OVER (PARTITION BY user_id, session_id ORDER BY start_ms, event_id) AS e FROM rhythm)
SELECT user_id, session_id, event_id, start_ms AS t_ms, 1 AS contact FROM r UNION ALL SELECT user_id, session_id, event_id, CAST(e + floor((start_ms - e) / 2) AS BIGINT), 0 FROM r WHERE start_ms > e""",
    "g10_contact_phase": f"""WITH {_CONTACT} SELECT source_row, CASE WHEN contact = 0 THEN -1 WHEN coalesce(lead(contact) OVER w, 0) = 0 THEN CASE WHEN source_row % 2 = 0 THEN 1 ELSE 6 END
 WHEN coalesce(lag(contact) OVER w, 0) = 0 THEN CASE WHEN source_row % 2 = 0 THEN 0 ELSE 5 END ELSE 2 END AS phase
FROM rows WINDOW w AS (PARTITION BY user_id, act_id, source_row % 2 ORDER BY evt_t, source_row)""",
    "g12_deltas": f"""WITH {_CONTACT} SELECT source_row, round(CASE WHEN contact = 1 AND lag(contact) OVER w = 1 THEN x - lag(x) OVER w ELSE 0 END, 5) AS dx,
 round(CASE WHEN contact = 1 AND lag(contact) OVER w = 1 THEN y - lag(y) OVER w ELSE 0 END, 5) AS dy FROM rows WINDOW w AS {_WP}""",
    "g13_union_timeline": f"""WITH {TOUCH}, own AS (SELECT user_id AS event, CAST(source_row % 2 AS INTEGER) AS pointer, evt_t AS t_ms, arg_max(x, source_row) AS x FROM touch GROUP BY ALL),
life AS (SELECT event, pointer, min(t_ms) AS f, max(t_ms) AS l FROM own GROUP BY ALL), grid AS (SELECT DISTINCT event, t_ms FROM own),
h AS (SELECT event, life.pointer, t_ms, f, l, last_value(own.x IGNORE NULLS) OVER (PARTITION BY event, life.pointer ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS x FROM grid JOIN life USING (event) LEFT JOIN own USING (event, pointer, t_ms))
SELECT event, pointer, t_ms, CAST(t_ms BETWEEN f AND l AS INTEGER) AS contact, CASE WHEN t_ms BETWEEN f AND l THEN x END AS x FROM h""",
    "f1_coalesced": f"WITH {_PRIM} SELECT source_row, t_ms FROM c1",
    "f2_primitives": f"WITH {_PRIM} SELECT source_row, {', '.join(map(_r, ['dt', 'dx', 'dy', 'length', 'speed', 'accel']))} FROM prim",
    "f3_finger_features": f"""WITH {_PRIM}, e AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, last_value(x) OVER w AS x1, last_value(y) OVER w AS y1,
  row_number() OVER (PARTITION BY user_id, act_id, seg ORDER BY t_ms) AS n, row_number() OVER (PARTITION BY user_id, act_id, seg ORDER BY t_ms DESC) AS m FROM prim
  WINDOW w AS (PARTITION BY user_id, act_id, seg ORDER BY t_ms ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, CASE WHEN sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) > 0 THEN ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) ELSE 0 END AS dev,
  CASE WHEN length > 0 THEN dx / length END AS c, CASE WHEN length > 0 THEN dy / length END AS sn FROM e),
f AS (SELECT user_id, act_id, seg, count(*) AS n_points, max(t_ms) - min(t_ms) AS duration_ms, min(x0) AS start_x, min(y0) AS start_y, min(x1) AS end_x, min(y1) AS end_y,
  coalesce(sqrt(avg(c) ** 2 + avg(sn) ** 2), 0) AS resultant, coalesce(CASE WHEN avg(c) ** 2 + avg(sn) ** 2 > 1e-18 THEN atan2(avg(sn), avg(c)) END, 0) AS mean_direction,
  {", ".join(_q("speed", q / 100, f"v{q}") for q in (20, 50, 80))}, {", ".join(_q("accel", q / 100, f"a{q}") for q in (20, 50, 80))},
  round(coalesce(quantile_cont(speed, 0.5) FILTER (m <= 3), 0), 5) AS late_speed, arg_max(dev, abs(dev) * 1e9 - t_ms / 1e12) AS max_dev,
  {", ".join(_q("dev", q / 100, f"dev{q}") for q in (20, 50, 80))}, coalesce(sum(length), 0) AS length,
  round(coalesce(quantile_cont(accel, 0.5) FILTER (n BETWEEN 3 AND 7), 0), 5) AS early_accel FROM d GROUP BY ALL)
SELECT user_id, act_id, seg, n_points, duration_ms, {", ".join(map(_r, ["start_x", "start_y", "end_x", "end_y", "resultant", "mean_direction", "max_dev", "length"]))},
 v20, v50, v80, a20, a50, a80, late_speed, dev20, dev50, dev80, early_accel, round(sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2), 5) AS displacement,
 round(CASE WHEN end_x = start_x AND end_y = start_y THEN 0 ELSE atan2(end_y - start_y, end_x - start_x) END, 5) AS direction,
 round(CASE WHEN length > 1e-12 THEN sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) / length ELSE 0 END, 5) AS efficiency,
 round(CASE WHEN duration_ms > 0 THEN length / (duration_ms / 1000.0::DOUBLE) ELSE 0 END, 5) AS mean_speed FROM f""",
    "f5_typing_features": f"""WITH {RHYTHM}, k AS (SELECT *, {TOKENS}[event_id % {len(TOKENS)} + 1] AS token, (event_id % 13)::DOUBLE AS x, (event_id % 7)::DOUBLE AS y FROM rhythm),
r AS (SELECT *, end_ms - start_ms AS hold, start_ms - lag(end_ms) OVER w AS flight, start_ms - lag(start_ms) OVER w AS step, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS way FROM k WINDOW w AS (PARTITION BY user_id, session_id ORDER BY start_ms, end_ms, event_id)),
b AS (SELECT *, sum(CASE WHEN step > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, session_id ORDER BY start_ms, end_ms, event_id) AS burst FROM r),
z AS (SELECT user_id, session_id, count(*) AS bursts, avg(k) AS burst_mean, max(k) AS burst_max FROM (SELECT user_id, session_id, burst, count(*) AS k FROM b GROUP BY ALL) GROUP BY ALL),
o AS (SELECT user_id, session_id, count(*) AS n_keys, count(*) FILTER (regexp_full_match(token, '\\p{{L}}')) AS n_letters, count(DISTINCT lower(token)) AS n_unique, avg(CAST(lower(token) IN ('backspace', 'del') AS INTEGER)) AS correction_ratio,
 max(end_ms) - min(start_ms) AS duration_ms, {", ".join(f"{_q(v, q / 100, f'{v}{q}')}" for v in ("hold", "flight", "step", "way") for q in (20, 50, 80))}, {", ".join(f"round(coalesce(avg({v}), 0), 5) AS {v}_mean" for v in ("hold", "flight", "step", "way"))},
 {", ".join(f"round(coalesce(stddev_pop({v}), 0), 5) AS {v}_std" for v in ("hold", "flight", "step"))}, round(coalesce(sum(way), 0), 5) AS way_sum, round(coalesce(avg(CAST(flight < 0 AS INTEGER)), 0), 5) AS overlap,
 round(coalesce(avg(CAST(step > 500 AS INTEGER)), 0), 5) AS pause_fraction FROM b GROUP BY ALL)
SELECT o.* REPLACE (round(correction_ratio, 5) AS correction_ratio), round(n_unique::DOUBLE / n_keys, 5) AS unique_ratio, round(CASE WHEN duration_ms > 0 THEN n_keys / (duration_ms / 1000.0::DOUBLE) ELSE 0 END, 5) AS key_rate,
 1 AS has_up, 1 AS has_xy, bursts, round(burst_mean, 5) AS burst_mean, burst_max FROM o JOIN z USING (user_id, session_id)""",
    "f7_kinematics": f"""WITH {_PRIM}, k AS (SELECT *, abs(speed - lag(speed) OVER w) / ((dt + lag(dt) OVER w) / 2) AS acc, x / 100 AS pressure, (source_row % 5) / 10.0::DOUBLE AS size FROM prim WINDOW w AS (PARTITION BY user_id, act_id, seg ORDER BY t_ms)),
a AS (SELECT user_id, act_id, seg, max(t_ms) - min(t_ms) AS duration_ms, coalesce(sum(length), 0) AS path, coalesce(quantile_cont(speed, 0.95), 0) AS p95_speed, coalesce(max(speed), 0) AS max_speed,
 coalesce(avg(acc), 0) AS mean_accel, coalesce(max(acc), 0) AS max_accel, coalesce(quantile_cont(dt, 0.5) * 1000, max(t_ms) - min(t_ms)) AS median_dt, coalesce(stddev_pop(dt) / avg(dt), 0) AS dt_cv,
 avg(pressure) AS pressure_mean, stddev_pop(pressure) AS pressure_std, avg(size) AS size_mean, stddev_pop(size) AS size_std,
 sqrt((arg_max(x, t_ms) - arg_min(x, t_ms)) ** 2 + (arg_max(y, t_ms) - arg_min(y, t_ms)) ** 2) AS displacement FROM k GROUP BY ALL)
SELECT user_id, act_id, seg, duration_ms, {", ".join(map(_off, ["path", "p95_speed", "max_speed", "mean_accel", "max_accel", "median_dt", "dt_cv", "pressure_mean", "pressure_std", "size_mean", "size_std", "displacement"]))},
 round(CASE WHEN path > 1e-12 THEN displacement / path ELSE 1 END + {OFF}, 5) AS efficiency, round(CASE WHEN duration_ms > 0 THEN path / (duration_ms / 1000.0::DOUBLE) ELSE 0 END + {OFF}, 5) AS mean_speed FROM a""",
    "f10_concatenated": f"WITH {WINDOWS} SELECT vec_id, i // 16 AS chunk, i % 16 AS j, (row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1) * 10 AS t_ms, round(v, 5) AS v FROM windows",
    "f11_channel_statistics": f"""WITH {WINDOWS} SELECT vec_id, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS low, round(max(v), 5) AS high,
 round(quantile_cont(v, 0.05), 5) AS p5, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.95), 5) AS p95, count(*) AS n FROM windows GROUP BY vec_id""",
    "f17_normaliser": f"""WITH {SCORES}, f AS (SELECT action, detector, avg(score) AS m, stddev_pop(score) AS s FROM scores WHERE pool = 'train' GROUP BY ALL)
SELECT event_id, round((score - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 5) AS z FROM scores JOIN f USING (action, detector)""",
    "f18_lag_one_correlation": f"""WITH {WINDOWS}, b AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS back FROM windows), e AS (SELECT label, vec_id, corr(v, back) AS r, stddev_pop(v) AS s FROM b WHERE back IS NOT NULL GROUP BY ALL)
SELECT label, round(quantile_cont(r, 0.5), 5) AS r50, count(*) AS n FROM e WHERE s > 1e-9 GROUP BY label""",
    "f19_window_summaries": f"""WITH {WINDOWS}, s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY i)) AS st FROM windows)
SELECT vec_id, label, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(coalesce(avg(st), 0), 5) AS step, round(max(v) - min(v), 5) AS range FROM s GROUP BY ALL""",
    "f20_held": f"""WITH {WINDOWS}, n AS (SELECT vec_id, count(*) AS n FROM windows GROUP BY vec_id), g AS (SELECT vec_id, k, CAST(floor(k / 24.0::DOUBLE * (n - 1) + 0.5::DOUBLE) AS INTEGER) AS i FROM n, range(25) t(k))
SELECT vec_id, CAST(k AS INTEGER) AS k, round(v, 5) AS v FROM g JOIN windows USING (vec_id, i)""",
    "f21_linear": f"""WITH {WINDOWS}, n AS (SELECT vec_id, count(*) AS n FROM windows GROUP BY vec_id), g AS (SELECT vec_id, k, k * (n - 1) / 24.0::DOUBLE AS p, CAST(greatest(least(floor(k * (n - 1) / 24.0::DOUBLE), n - 2), 0) AS INTEGER) AS i FROM n, range(25) t(k)),
w AS (SELECT vec_id, i, v, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS nx FROM windows) SELECT vec_id, CAST(k AS INTEGER) AS k, round(v + (p - i) * (coalesce(nx, v) - v), 5) AS v FROM g JOIN w USING (vec_id, i)""",
    "f22_duration_summary": f"""WITH {BINS}, q AS (SELECT arm, quantile_cont(duration, [0.05, 0.5, 0.95]) FILTER (label = 0) AS r, quantile_cont(duration, [0.05, 0.5, 0.95]) FILTER (label = 1) AS f,
 avg(CAST(duration >= 45 AS INTEGER)) FILTER (label = 1) AS fake_at_cap, avg(CAST(duration > 45 AS INTEGER)) FILTER (label = 0) AS real_over_cap, avg(duration) FILTER (label = 0) AS real_mean, max(duration) FILTER (label = 0) AS real_max,
 avg(duration) FILTER (label = 1) AS fake_mean, max(duration) FILTER (label = 1) AS fake_max FROM bins GROUP BY arm)
SELECT arm, round(r[1], 5) AS real_p5, round(r[2], 5) AS real_p50, round(r[3], 5) AS real_p95, round(f[1], 5) AS fake_p5, round(f[2], 5) AS fake_p50, round(f[3], 5) AS fake_p95,
 round(f[2] - r[2], 5) AS shift, {", ".join(map(_r, ["fake_at_cap", "real_over_cap", "real_mean", "real_max", "fake_mean", "fake_max"]))} FROM q""",
}
