"""Source, pinch, consistency, coverage and reporting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from padlens.functions.shared import shared_folder
from padlens.operators import features as X
from padlens.operators import metrics as M
from padlens.operators import more as O
from padlens.operators.dispatch import event_features
from padlens.plans import adapters as A
from padlens.plans.adapters import CELL, RHYTHM, SCORES, TOUCH, WINDOWS
from padlens.plans.gesture_queries import all_rounded
from padlens.plans.session_queries import _STATS, folded
from padlens.sources import tables as S

#: The last of them is none that features exist for.
ACTIONS6 = ["tap", "scroll", "swipe", "pinch", "keystroke", "fling"]


def s1_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text cells, some of them broken, to numbers."""
    t = A.touch(spark, sf)
    raw = t.select(
        F.col("source_row").cast("string").alias("evt_t"),
        F.when(F.col("source_row") % 11 == 0, "bad").when(F.col("source_row") % 13 == 0, None).otherwise(F.concat(F.lit(" "), F.col("x").cast("string"))).alias("x"),
    )
    return S.cleaned(raw, ["evt_t", "x"])


def s7_ragged(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf)
    return S.from_ragged(S.to_ragged(t, "user_id", "source_row", ["evt_t", "x"]), "user_id")


def s8_event_writer(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "events")
    S.write_events(A.scores(spark, sf).select("event_id", "action", "score"), path)
    return spark.read.parquet(path).select("event_id", F.col("action").cast("string").alias("action"), "score")


def s11_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.scores(spark, sf)
    status = F.when(F.col("score") < 1, "rejected").when(F.col("score") > 80, "reserved_not_emitted").otherwise("accepted")
    return S.audit_rollup(rows.withColumn("status", status).withColumn("reason", F.when(F.col("score") < 0.5, "too_low").otherwise("none")))


def s15_genuine_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.scores(spark, sf).withColumn("event", F.concat_ws("-", "user_id", "action"))
    return S.genuine_windows(rows, "test").select("event_id", "event")


def f4_pinch(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf).withColumn("k", F.floor(F.col("source_row") / 2))
    both = t.groupBy(F.col("user_id").alias("event"), F.col("k").alias("t_ms")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), (F.max("y") + F.max(F.col("source_row") % 17)).alias("y1"))
    return all_rounded(O.pinch_features(both))


def dispatched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each user as one event: rows in turn to two slots, every twenty of them a key; some rows and some whole keys don't touch."""
    kinds = F.array(*map(F.lit, ACTIONS6))
    t = A.touch(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("source_row")) - 1)
    points = t.select(
        F.col("user_id").alias("event_id"), (F.col("rn") % 2).alias("slot"), (F.floor(F.col("rn") / 2) * 10).alias("t_ms"), "source_row", "x", "y",
        ((F.col("source_row") % 4 != 0) & ((F.col("user_id") % 4 != 0) | (F.col("rn") >= 20))).cast("int").alias("contact"), F.floor(F.col("rn") / 20).cast("int").alias("key_index"),
    )
    events = points.select("event_id", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("action")).distinct()
    code = F.when(F.col("key_index") % 9 == 8, -5).otherwise(60 + F.col("key_index") % 40)
    keys = points.groupBy("event_id", "key_index").agg(F.min("t_ms").alias("down_ms"), (F.max("t_ms") + F.max("source_row") % 40).alias("up_ms")).withColumn("keycode", code)
    return events, points, keys.filter("event_id % 7 > 0")


def f6_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    out = event_features(*dispatched(spark, sf))
    named = {"points": "finger.n_points", "length": "finger.length", "frames": "pinch.n_frames", "span_mean": "pinch.span_mean", "centre_length": "pinch.center_length", "keys": "typing.n_keys", "unique": "typing.n_unique", "has_xy": "typing.has_xy", "way_sum": "typing.way_sum", "hold_mean": "typing.hold_mean"}
    return all_rounded(out.select("event_id", "action", "problem", *[F.col(c).alias(n) for n, c in named.items()]))


def sensor(spark: SparkSession, sf: str) -> DataFrame:
    return A.touch(spark, sf).filter("source_row % 3 = 0").select(F.col("user_id").alias("event"), F.col("evt_t").alias("t_ms"), F.col("x").alias("v"), F.col("source_row").alias("sample_id"))


def f9_consistency(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf).filter("source_row % 3 <> 0").select(F.col("user_id").alias("event"), F.col("evt_t").alias("t_ms"), "x", "y")
    return all_rounded(O.consistency(t, sensor(spark, sf)))


def f16_background(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf).select("user_id", F.col("evt_t").alias("t"), F.col("x").alias("v"), F.col("source_row").alias("sample_id"))
    return all_rounded(O.background(t.filter("sample_id % 3 = 0"), t.filter("sample_id % 3 <> 0").groupBy("user_id", "t").agg(F.max("v").alias("v")), 3_600_000, 86_400_000, 2))


def f19_energy(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.window_summaries(A.windows(spark, sf)).withColumn("side", F.when(F.col("label") % 2 == 0, "a").otherwise("b"))
    return all_rounded(O.energy_distance(rows, rows.filter("vec_id % 20 = 0"), ["mean", "std", "step", "range"], "a", "b"))


def styled(spark: SparkSession, sf: str) -> DataFrame:
    clock = A.touch(spark, sf).select(F.col("source_row").alias("event_id"), (F.col("evt_t") % 86_400_000 / 1000.0).alias("clock"), F.floor(F.col("evt_t") / 86_400_000).alias("session_id"))
    return O.style_distances(A.scores(spark, sf).join(clock, "event_id").select("event_id", "user_id", "session_id", "label", "pool", "score", "clock"), ["score", "clock"])


def e21_overlap(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), (F.col("l_partkey") % 50).alias("ref"), F.col("l_linestatus").alias("side"))
    return O.reference_overlap(t.filter("side = 'F'"), t.filter("side = 'O'"), ["user_id"], "ref")


def p14_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.scores(spark, sf)
    cells = rows.select("user_id", "action").distinct()
    return O.coverage_status(cells, cells.filter("user_id % 5 <> 0"), rows.filter("label = 1 and user_id % 2 = 0"), rows.filter("score > 70"), ["user_id", "action"])


def n8_disjoint_price(spark: SparkSession, sf: str) -> DataFrame:
    return all_rounded(O.disjoint_price(folded(spark, sf), "s1_count"))


def p13_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Actions as methods, detectors as modalities; what a method changed is told by its own rows."""
    modality = F.element_at(F.array(*map(F.lit, ["trajectory", "imu", "joint"])), F.col("detector") + 1)
    rows = A.scores(spark, sf).select(F.col("action").alias("method"), modality.alias("modality"), "event_id", "score")
    flags = rows.groupBy("method").agg((F.count("*") % 2 == 0).alias("touch"), (F.count(F.when(F.col("score") > 20, 1)) % 2 == 0).alias("sensor"))
    return O.covered(rows, flags).groupBy("method", "modality").agg(F.count("*").alias("n"), F.max("score").alias("high"))


QUERIES = {
    "s1_touch_cleaning": s1_cleaned,
    "s7_ragged": s7_ragged,
    "s8_event_writer": s8_event_writer,
    "s11_audit_rollup": s11_audit,
    "s14_fingerprint": lambda s, d: S.fingerprint(A.table(s, d, "events").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 1000).cast("long").alias("value")).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))),
    "s15_genuine_windows": s15_genuine_windows,
    "f4_pinch_features": f4_pinch,
    "f6_dispatch": f6_dispatch,
    "f8_centre_speed": lambda s, d: all_rounded(O.centre_speed(A.touch(s, d).select(F.col("user_id").alias("event"), F.col("evt_t").alias("t_ms"), "x", "y")).select("event", "t_ms", "x", "y", "speed")),
    "f9_consistency": f9_consistency,
    "f16_background": f16_background,
    "f19_energy_distance": f19_energy,
    "f24_corpus_profile": lambda s, d: all_rounded(O.corpus_profile(A.scores(s, d))),
    "e20_style_distances": lambda s, d: all_rounded(styled(s, d)),
    "e20_style_summary": lambda s, d: all_rounded(O.style_summary(styled(s, d))),
    "e21_overlap_histogram": lambda s, d: all_rounded(O.overlap_histogram(e21_overlap(s, d))),
    "e21_reference_overlap": e21_overlap,
    "e22_latency_summary": lambda s, d: all_rounded(M.latency_summary(A.rhythm(s, d).withColumn("ms", F.col("end_ms") - F.col("start_ms")), ["action"], "ms")),
    "n8_disjoint_price": n8_disjoint_price,
    "p13_modality_coverage": p13_coverage,
    "p14_coverage_status": p14_coverage,
}

_SPEED = """m AS (SELECT user_id AS event, evt_t AS t_ms, avg(x) AS x, avg(y) AS y FROM src GROUP BY ALL), d AS (SELECT *, (t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE AS dt,
  sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS l FROM m WINDOW w AS (PARTITION BY event ORDER BY t_ms)), sp AS (SELECT event, t_ms, x, y, CASE WHEN dt > 0 THEN l / dt END AS speed, t_ms - dt * 500 AS mid FROM d)"""
_STYLE = f"""WITH {SCORES}, x AS (SELECT event_id, s.user_id, label, pool, score, (epoch_us(ts) // 1000) % 86400000 / 1000.0::DOUBLE AS clock, CAST(floor((epoch_us(ts) // 1000) / 86400000) AS BIGINT) AS session_id FROM scores s JOIN (SELECT event_id, ts FROM events) USING (event_id)),
m AS (SELECT avg(score) AS ms, stddev_pop(score) + 1e-9 AS ss, avg(clock) AS mc, stddev_pop(clock) + 1e-9 AS sc FROM x WHERE label = 0 AND pool = 'train'), z AS (SELECT event_id, user_id, session_id, label, (score - ms) / ss AS a, (clock - mc) / sc AS b FROM x, m),
c AS (SELECT user_id, avg(a) AS ca, avg(b) AS cb FROM z WHERE label = 0 GROUP BY user_id), d AS (SELECT user_id, label, sqrt((a - ca) ** 2 + (b - cb) ** 2) AS d FROM z JOIN c USING (user_id)),
q AS (SELECT user_id, quantile_cont(d, 0.5) FILTER (label = 1) AS fake_own, quantile_cont(d, 0.5) FILTER (label = 0) AS real_own FROM d GROUP BY user_id),
se AS (SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY session_id) <= count(*) OVER (PARTITION BY user_id) // 2 AS early FROM (SELECT DISTINCT user_id, session_id FROM z WHERE label = 0)),
ze AS (SELECT z.*, early FROM z JOIN se USING (user_id, session_id) WHERE label = 0), ce AS (SELECT user_id, avg(a) AS ca, avg(b) AS cb FROM ze WHERE early GROUP BY user_id),
la AS (SELECT user_id, quantile_cont(sqrt((a - ca) ** 2 + (b - cb) ** 2), 0.5) AS sessions_own FROM ze JOIN ce USING (user_id) WHERE NOT early GROUP BY user_id),
fw AS (SELECT user_id AS other, a, b FROM (SELECT *, sha256(event_id::VARCHAR) AS h, row_number() OVER (PARTITION BY user_id ORDER BY sha256(event_id::VARCHAR)) AS k FROM z WHERE label = 0) WHERE k <= 4 ORDER BY h LIMIT 2000),
fo AS (SELECT user_id, quantile_cont(sqrt((a - ca) ** 2 + (b - cb) ** 2), 0.5) AS others_own FROM c JOIN fw ON user_id <> other GROUP BY user_id),
st AS (SELECT *, others_own - fake_own AS delta, CAST(coalesce(sessions_own <= fake_own AND fake_own < others_own, false) AS INTEGER) AS chain FROM q LEFT JOIN la USING (user_id) LEFT JOIN fo USING (user_id))"""
_W = "(PARTITION BY event ORDER BY t_ms)"
_CENTRE = ["start_x", "start_y", "end_x", "end_y", "resultant", "mean_direction", "v20", "v50", "v80", "a20", "a50", "a80", "late_speed", "max_dev", "dev20", "dev50", "dev80", "length", "early_accel", "displacement", "direction", "efficiency", "mean_speed"]
_SPANS = ["span_first", "span_last", "span_min", "span_max", "span_mean", "span_std", "span_path", "span_rate", "span_rate20", "span_rate50", "span_rate80", "span_rate_abs", "span_speed50", "angle_first", "angle_last", "angle_total", "angle_path",
          "angular20", "angular50", "angular80", "angular_speed", "length0", "length1", "length_centre", "speed_corr", "length_ratio", "span_delta", "span_delta_abs"]
_LEVELS = lambda v, n: ", ".join(f"coalesce(quantile_cont({v}, {k / 100}), 0) AS {n}{k}" for k in (20, 50, 80))
#: Of f(event, t_ms, x0, y0, x1, y1): angles, spans and paths of two fingers, and their midpoint's path.
_PINCH = f"""f1 AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS span, CASE WHEN sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) > 1e-12 THEN atan2(y1 - y0, x1 - x0) END AS a, row_number() OVER {_W} AS i FROM f),
v1 AS (SELECT event, i, a - lag(a) OVER (PARTITION BY event ORDER BY i) AS st, a FROM f1 WHERE a IS NOT NULL),
v2 AS (SELECT event, i, sum(CASE WHEN st IS NULL THEN a WHEN st - 2 * pi() * floor((st + pi()) / (2 * pi())) = -pi() AND st > 0 THEN pi() ELSE st - 2 * pi() * floor((st + pi()) / (2 * pi())) END) OVER (PARTITION BY event ORDER BY i) AS u FROM v1),
f2 AS (SELECT f1.*, u, CASE WHEN u IS NOT NULL THEN f1.i END AS ui FROM f1 LEFT JOIN v2 USING (event, i)),
f3 AS (SELECT *, last_value(u IGNORE NULLS) OVER p AS ua, last_value(ui IGNORE NULLS) OVER p AS ia, first_value(u IGNORE NULLS) OVER n AS ub, first_value(ui IGNORE NULLS) OVER n AS ib FROM f2
  WINDOW p AS (PARTITION BY event ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY event ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f4 AS (SELECT *, coalesce(u, ua + (ub - ua) * (i - ia) / (ib - ia), ua, ub, 0) AS angle FROM f3),
r AS (SELECT *, (t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE AS dt, span - lag(span) OVER w AS ds, angle - lag(angle) OVER w AS turn, sqrt((x0 - lag(x0) OVER w) ** 2 + (y0 - lag(y0) OVER w) ** 2) AS l0, sqrt((x1 - lag(x1) OVER w) ** 2 + (y1 - lag(y1) OVER w) ** 2) AS l1,
 sqrt(((x0 + x1 - lag(x0) OVER w - lag(x1) OVER w) / 2) ** 2 + ((y0 + y1 - lag(y0) OVER w - lag(y1) OVER w) / 2) ** 2) AS lc FROM f4 WINDOW w AS {_W}),
o AS (SELECT event, count(*) AS n_frames, arg_min(span, t_ms) AS span_first, arg_max(span, t_ms) AS span_last, min(span) AS span_min, max(span) AS span_max, avg(span) AS span_mean, stddev_pop(span) AS span_std, coalesce(sum(abs(ds)), 0) AS span_path,
 coalesce(avg(ds / dt), 0) AS span_rate, {_LEVELS("ds / dt", "span_rate")}, coalesce(avg(abs(ds / dt)), 0) AS span_rate_abs, coalesce(quantile_cont(abs(ds / dt), 0.5), 0) AS span_speed50, arg_min(angle, t_ms) AS angle_first, arg_max(angle, t_ms) AS angle_last,
 coalesce(sum(turn), 0) AS angle_total, coalesce(sum(abs(turn)), 0) AS angle_path, {_LEVELS("turn / dt", "angular")}, coalesce(avg(abs(turn / dt)), 0) AS angular_speed, coalesce(sum(l0), 0) AS length0, coalesce(sum(l1), 0) AS length1, coalesce(sum(lc), 0) AS length_centre,
 coalesce(CASE WHEN count(l0) >= 2 AND stddev_pop(l0 / dt) > 1e-12 AND stddev_pop(l1 / dt) > 1e-12 THEN corr(l0 / dt, l1 / dt) END, 0) AS speed_corr FROM r GROUP BY event),
o2 AS (SELECT *, CASE WHEN greatest(length0, length1) > 1e-12 THEN least(length0, length1) / greatest(length0, length1) ELSE 0 END AS length_ratio, span_last - span_first AS span_delta, abs(span_last - span_first) AS span_delta_abs FROM o),
p0 AS (SELECT event, t_ms, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM f),
p1 AS (SELECT *, (t_ms - lag(t_ms) OVER w) / 1000.0::DOUBLE AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, row_number() OVER w AS n, row_number() OVER (PARTITION BY event ORDER BY t_ms DESC) AS m, first_value(x) OVER a AS sx, first_value(y) OVER a AS sy, last_value(x) OVER a AS ex, last_value(y) OVER a AS ey FROM p0
  WINDOW w AS {_W}, a AS (PARTITION BY event ORDER BY t_ms ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p2 AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, sqrt(dx * dx + dy * dy) / dt AS speed, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) AS chord FROM p1),
p3 AS (SELECT *, (speed - lag(speed) OVER {_W}) / dt AS accel, CASE WHEN chord > 0 THEN ((ex - sx) * (y - sy) - (ey - sy) * (x - sx)) / chord ELSE 0 END AS dev, CASE WHEN len > 0 THEN dx / len END AS c, CASE WHEN len > 0 THEN dy / len END AS s FROM p2),
p4 AS (SELECT event, max(t_ms) - min(t_ms) AS duration_ms, min(sx) AS start_x, min(sy) AS start_y, min(ex) AS end_x, min(ey) AS end_y, coalesce(sqrt(avg(c) ** 2 + avg(s) ** 2), 0) AS resultant, coalesce(CASE WHEN avg(c) ** 2 + avg(s) ** 2 > 1e-18 THEN atan2(avg(s), avg(c)) END, 0) AS mean_direction,
 {_LEVELS("speed", "v")}, {_LEVELS("accel", "a")}, coalesce(quantile_cont(speed, 0.5) FILTER (m <= 3), 0) AS late_speed, arg_max(dev, abs(dev) * 1e9 - t_ms / 1e12) AS max_dev, {_LEVELS("dev", "dev")}, coalesce(sum(len), 0) AS length, coalesce(quantile_cont(accel, 0.5) FILTER (n BETWEEN 3 AND 7), 0) AS early_accel FROM p3 GROUP BY event),
p5 AS (SELECT *, sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) AS displacement, CASE WHEN end_x = start_x AND end_y = start_y THEN 0 ELSE atan2(end_y - start_y, end_x - start_x) END AS direction,
 CASE WHEN length > 1e-12 THEN sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) / length ELSE 0 END AS efficiency, CASE WHEN duration_ms > 0 THEN length / (duration_ms / 1000.0::DOUBLE) ELSE 0 END AS mean_speed FROM p4)
SELECT o2.event, n_frames, {", ".join(f"round({c}, 5) AS {c}" for c in _SPANS)}, p5.duration_ms AS center_duration_ms, {", ".join(f"round(p5.{c}, 5) AS center_{c}" for c in _CENTRE)} FROM o2 JOIN p5 USING (event)"""

ORACLES = {
    "s1_touch_cleaning": "SELECT event_id AS evt_t, value AS x FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0",
    "s7_ragged": f"WITH {TOUCH} SELECT user_id, source_row, evt_t, x FROM touch",
    "s8_event_writer": "SELECT event_id, event_type AS action, value AS score FROM events",
    "s11_audit_rollup": f"""WITH a AS (SELECT event_type AS action, CASE WHEN value < 1 THEN 'rejected' WHEN value > 80 THEN 'reserved_not_emitted' ELSE 'accepted' END AS status, CASE WHEN value < 0.5::DOUBLE THEN 'too_low' ELSE 'none' END AS reason FROM events)
SELECT action, status, reason, count(*) AS n FROM a GROUP BY ROLLUP (action, status, reason)""",
    "s14_fingerprint": """SELECT count(*) AS n, CAST(sum(('0x' || substr(sha256(concat_ws(chr(31), event_id, event_type, epoch_us(ts), user_id, round(value * 1000)::BIGINT)), 1, 15))::BIGINT) AS VARCHAR) AS hash,
 sha256('event_id:bigint,event_type:string,ts:bigint,user_id:bigint,value:bigint') AS schema_hash FROM events""",
    "s15_genuine_windows": f"WITH {SCORES} SELECT event_id, user_id || '-' || action AS event FROM scores WHERE pool = 'test' AND label = 0 QUALIFY count(*) OVER (PARTITION BY user_id, action) >= 2",
    "f4_pinch_features": f"WITH {TOUCH}, f AS (SELECT user_id AS event, source_row // 2 AS t_ms, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) + max(source_row % 17) AS y1 FROM touch GROUP BY ALL), {_PINCH}",
    "f6_dispatch": f"""WITH {TOUCH}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_row) - 1 AS rn FROM touch),
p AS (SELECT user_id AS event_id, {ACTIONS6}[user_id % 6 + 1] AS action, rn % 2 AS slot, rn // 2 * 10 AS t_ms, source_row, x, y, source_row % 4 <> 0 AND (user_id % 4 <> 0 OR rn >= 20) AS contact, rn // 20 AS k FROM n),
e AS (SELECT DISTINCT event_id, action FROM p), a AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WHERE contact AND slot = 0 AND action IN ('tap', 'scroll', 'swipe') WINDOW w AS (PARTITION BY event_id ORDER BY t_ms)),
fi AS (SELECT event_id, count(*) AS points, coalesce(sum(sqrt(dx * dx + dy * dy)), 0) AS length FROM a GROUP BY event_id),
fr AS (SELECT a.event_id, a.t_ms, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b USING (event_id, t_ms) WHERE a.action = 'pinch' AND a.contact AND b.contact AND a.slot = 0 AND b.slot = 1),
pw AS (SELECT *, (x0 + x1) / 2 - lag((x0 + x1) / 2) OVER w AS cx, (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER w AS cy FROM fr WINDOW w AS (PARTITION BY event_id ORDER BY t_ms)),
pi AS (SELECT event_id, count(*) AS frames, avg(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS span_mean, coalesce(sum(sqrt(cx * cx + cy * cy)), 0) AS centre_length FROM pw GROUP BY event_id),
ke AS (SELECT event_id, k, min(t_ms) AS down, max(t_ms) + max(source_row) % 40 AS up, CASE WHEN k % 9 = 8 THEN 0 ELSE 60 + k % 40 END AS code, arg_min(x, source_row) FILTER (contact) AS x, arg_min(y, source_row) FILTER (contact) AS y FROM p WHERE action = 'keystroke' AND event_id % 7 > 0 GROUP BY event_id, k),
kw AS (SELECT *, CASE WHEN code BETWEEN 65 AND 90 OR code BETWEEN 97 AND 122 THEN chr(CAST(code AS INTEGER)) ELSE 'keycode_' || code END AS token, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS way FROM ke WINDOW w AS (PARTITION BY event_id ORDER BY down, up, k)),
ty AS (SELECT event_id, count(*) AS keys, count(DISTINCT lower(token)) AS u, CAST(count(x) = count(*) AS INTEGER) AS has_xy, coalesce(CASE WHEN count(x) = count(*) THEN sum(way) END, 0) AS way_sum, avg(up - down) AS hold_mean FROM kw GROUP BY event_id)
SELECT event_id, action, CASE WHEN action IN ('tap', 'scroll', 'swipe') THEN CASE WHEN points IS NULL THEN 'no_contact_row' END WHEN action = 'pinch' THEN CASE WHEN frames IS NULL THEN 'no_simultaneous_two_pointer_frame' END WHEN action = 'keystroke' THEN CASE WHEN keys IS NULL THEN 'no_key' END
 ELSE 'unsupported_action' END AS problem, points, round(length, 5) AS length, frames, round(span_mean, 5) AS span_mean, round(centre_length, 5) AS centre_length, keys, u AS unique, has_xy, round(way_sum, 5) AS way_sum, round(hold_mean, 5) AS hold_mean
FROM e LEFT JOIN fi USING (event_id) LEFT JOIN pi USING (event_id) LEFT JOIN ty USING (event_id)""",
    "f8_centre_speed": f"WITH {TOUCH}, src AS (SELECT * FROM touch), {_SPEED} SELECT event, t_ms, round(x, 5) AS x, round(y, 5) AS y, round(speed, 5) AS speed FROM sp",
    "f24_corpus_profile": f"WITH {SCORES} SELECT action, pool, count(*) AS n, count(DISTINCT user_id) AS users, round(min(score), 5) AS low, round(max(score), 5) AS high, round(avg(score), 5) AS mean FROM scores GROUP BY ROLLUP (action, pool)",
    "f19_energy_distance": f"""WITH {WINDOWS}, s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY i)) AS st FROM windows), r AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS side, avg(v) AS m, stddev_pop(v) AS sd, coalesce(avg(st), 0) AS st, max(v) - min(v) AS rg FROM s GROUP BY vec_id, label),
k AS (SELECT stddev_pop(m) + 1e-9 AS m, stddev_pop(sd) + 1e-9 AS sd, stddev_pop(st) + 1e-9 AS st, stddev_pop(rg) + 1e-9 AS rg FROM r),
d AS (SELECT a.side AS s, b.side AS t, avg(sqrt(((a.m - b.m) / k.m) ** 2 + ((a.sd - b.sd) / k.sd) ** 2 + ((a.st - b.st) / k.st) ** 2 + ((a.rg - b.rg) / k.rg) ** 2)) AS d FROM r a, (SELECT * FROM r WHERE vec_id % 20 = 0) b, k GROUP BY ALL)
SELECT round(2 * avg(d) FILTER (s <> t) - max(d) FILTER (s = 'a' AND t = 'a') - max(d) FILTER (s = 'b' AND t = 'b'), 5) AS energy FROM d""",
    "e20_style_distances": f"{_STYLE} SELECT user_id, {', '.join(f'round({c}, 5) AS {c}' for c in ['fake_own', 'real_own', 'sessions_own', 'others_own', 'delta'])}, chain FROM st",
    "e20_style_summary": f"""{_STYLE} SELECT count(*) AS users, round(avg(CAST(delta > 0 AS INTEGER)), 5) AS share_positive, round(avg(chain), 5) AS share_chain, {', '.join(f'round(quantile_cont({c}, 0.5), 5) AS median_{c}' for c in ['fake_own', 'sessions_own', 'others_own', 'delta'])} FROM st WHERE delta IS NOT NULL""",
    "e21_overlap_histogram": """WITH t AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey % 50 AS ref, l_linestatus AS side FROM lineitem), g AS (SELECT user_id, ref, count(*) AS k FROM t GROUP BY ALL), o AS (SELECT user_id, count(*) FILTER (k = 2) AS shared, count(*) AS either FROM g GROUP BY user_id)
SELECT CAST(shared AS INTEGER) AS shared, count(*) AS groups, round(avg(either), 5) AS mean_either FROM o GROUP BY shared""",
    "e21_reference_overlap": """WITH t AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey % 50 AS ref, l_linestatus AS side FROM lineitem), g AS (SELECT user_id, ref, count(*) AS k FROM t GROUP BY ALL)
SELECT user_id, CAST(count(*) FILTER (k = 2) AS INTEGER) AS shared, CAST(count(*) AS INTEGER) AS either FROM g GROUP BY user_id""",
    "e22_latency_summary": f"""WITH {RHYTHM}, q AS (SELECT action, quantile_cont(end_ms - start_ms, [0.5, 0.95, 1.0]) AS q, avg(end_ms - start_ms) AS mean, count(*) AS n FROM rhythm GROUP BY action)
SELECT action, n, round(mean, 5) AS mean, round(q[1], 5) AS p50, round(q[2], 5) AS p95, round(q[3], 5) AS max, q[1] <= q[2] AND q[2] <= q[3] AS monotone FROM q""",
    "n8_disjoint_price": f"""WITH {_STATS}, u AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 2 AS fold FROM (SELECT DISTINCT user_id FROM stats)), x AS (SELECT * FROM stats JOIN u USING (user_id)),
g AS (SELECT fold, s1_count AS v, count(*) AS c FROM x WHERE label = 0 GROUP BY ALL), n AS (SELECT fold, sum(c) AS n FROM g GROUP BY fold), w AS (SELECT DISTINCT fold, s1_count AS v FROM x),
step AS (SELECT w.fold, w.v, coalesce(sum(c), 0)::DOUBLE / any_value(n) AS q FROM w JOIN n ON n.fold = 1 - w.fold LEFT JOIN g ON g.fold = 1 - w.fold AND g.v >= w.v GROUP BY ALL),
p AS (SELECT q, count(*) FILTER (label = 1) AS f, count(*) FILTER (label = 0) AS r FROM x JOIN step ON step.fold = x.fold AND step.v = s1_count GROUP BY q),
k AS (SELECT sum(f) OVER o::DOUBLE / sum(f) OVER () AS caught, sum(r) OVER o::DOUBLE / sum(r) OVER () AS fa FROM p WINDOW o AS (ORDER BY q ROWS UNBOUNDED PRECEDING))
SELECT round(min(fa) FILTER (caught >= 0.5::DOUBLE - 1e-12), 5) AS price_50, round(min(fa) FILTER (caught >= 0.8::DOUBLE - 1e-12), 5) AS price_80 FROM k""",
    "p13_modality_coverage": """WITH s AS (SELECT event_type AS method, CASE event_id % 3 WHEN 0 THEN 'trajectory' WHEN 1 THEN 'imu' ELSE 'joint' END AS modality, value FROM events),
f AS (SELECT method, count(*) % 2 = 0 AS touch, count(*) FILTER (value > 20) % 2 = 0 AS sensor FROM s GROUP BY 1)
SELECT method, modality, count(*) AS n, max(value) AS high FROM s JOIN f USING (method) WHERE CASE modality WHEN 'trajectory' THEN touch WHEN 'imu' THEN sensor ELSE touch AND sensor END GROUP BY ALL""",
    "p14_coverage_status": f"""WITH c AS (SELECT user_id, event_type AS action, bool_or(value > 70) AS scored, bool_or(event_id % 2 = 1 AND user_id % 2 = 0) AS fakes FROM events GROUP BY ALL)
SELECT user_id, action, CASE WHEN scored THEN 'scored' WHEN user_id % 5 = 0 THEN 'not_owned' WHEN fakes THEN 'declined' ELSE 'missing' END AS status FROM c""",
}
