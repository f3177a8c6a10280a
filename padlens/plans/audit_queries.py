"""Audit queries: event tables built from the touch view with faults put in, and claims recomputed from their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlens.functions.shared import shared_folder, written
from padlens.operators import eventaudit as V
from padlens.operators import gestures as G
from padlens.operators import metrics as M
from padlens.operators import recompute as R
from padlens.plans import adapters as A
from padlens.plans.adapters import BINS, CELL
from padlens.plans.gesture_queries import _POINTS
from padlens.plans.metric_queries import _BINNED, _CELLS, _CUTS, CUT, LEVELS
from padlens.sources import registries as S

#: Each action has so many users in the given tables' smallest size; any other number is reported.
USERS = 50
#: SQL for both engines. A contact is an event; of every five groups of three contacts one is a typed event of three keys.
_BASE = """SELECT p.user_id, p.source_row, p.x, p.y, p.evt_t, t.code, CAST(floor(p.seg / 3) AS BIGINT) AS g, p.seg,
  {element} AS action FROM points p JOIN touch t ON p.user_id = t.user_id AND p.evt_t = t.evt_t AND p.source_row = t.source_row"""
_STEPS = {
    "named": "SELECT *, CASE WHEN action = 'keystroke' THEN -g - 1 ELSE seg END AS part FROM base",
    "placed": """SELECT *, min(source_row) OVER e AS event_id, min(evt_t) OVER e AS start, max(evt_t) OVER e AS stop,
  CAST(dense_rank() OVER (PARTITION BY user_id, part ORDER BY seg, evt_t) - 1 AS INTEGER) AS frame, CAST(dense_rank() OVER (PARTITION BY user_id, part ORDER BY seg) - 1 AS INTEGER) AS k,
  min(source_row) OVER (PARTITION BY user_id, part, seg) AS key_id FROM named WINDOW e AS (PARTITION BY user_id, part)""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id, seg, evt_t, source_row) - 1 AS point_row FROM placed",
    "points1": """SELECT user_id, event_id, point_row, CASE WHEN source_row % 29 = 0 THEN frame - 1 ELSE frame END AS frame, evt_t - start AS t_rel_ms, evt_t AS event_time_ms,
  CASE WHEN action = 'pinch' THEN source_row % 2 ELSE 0 END AS pointer_id, CASE WHEN source_row % 43 = 0 THEN 2 ELSE 1 END AS pointer_count, code,
  CASE WHEN source_row % 23 = 0 THEN 2 WHEN evt_t BETWEEN start + CASE WHEN action = 'keystroke' THEN 0 ELSE event_id % 3 END AND stop THEN 1 ELSE 0 END AS active,
  CASE WHEN source_row % 31 = 0 THEN 0 ELSE 1 END AS valid, CASE WHEN source_row % 47 = 0 THEN 2 ELSE 0 END AS point_orientation_id,
  CASE WHEN source_row % 37 = 0 THEN NULL ELSE x END AS x, y, x / 128 AS pressure, CASE WHEN source_row % 41 = 0 THEN CAST('NaN' AS DOUBLE) ELSE y END AS size, k AS key_index,
  CASE WHEN action = 'keystroke' THEN 60 + key_id % 50 ELSE -1 END AS keycode, action, start, stop, key_id, seg FROM numbered""",
    "keys1": """SELECT user_id, event_id, key_index, keycode, CASE WHEN (keycode BETWEEN 65 AND 90 OR keycode BETWEEN 97 AND 122) = (key_id % 7 > 0) THEN 1 ELSE 0 END AS is_letter,
  min(event_time_ms) AS down_ms, max(event_time_ms) AS up_ms, max(event_time_ms) - min(event_time_ms) + CASE WHEN key_id % 5 = 0 THEN 1 ELSE 0 END AS hold_ms,
  min(event_time_ms) + key_id % 2 AS key_touch_start_ms, max(event_time_ms) AS key_touch_end_ms, key_id % 2 AS key_start_error_ms, CASE WHEN key_id % 11 = 0 THEN 1 ELSE 0 END AS key_end_error_ms,
  key_id % 4 AS key_orientation_id, key_id % 3 AS source, CASE WHEN key_id % 13 = 0 THEN 0 ELSE 1 END AS found, CASE WHEN key_id % 6 = 0 THEN -seg ELSE seg END AS key_raw_id,
  min(point_row) AS point_lo, max(point_row) + 1 + CASE WHEN key_id % 17 = 0 THEN 1 ELSE 0 END AS point_hi FROM points1 WHERE action = 'keystroke' GROUP BY user_id, event_id, key_index, keycode, key_id, seg""",
    "keys2": """SELECT *, CASE WHEN lag(up_ms) OVER w IS NULL THEN key_start_error_ms ELSE down_ms - lag(up_ms) OVER w + CASE WHEN keycode % 9 = 0 THEN 1 ELSE 0 END END AS flight_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id, key_index) - 1 AS key_row FROM keys1 WINDOW w AS (PARTITION BY event_id ORDER BY key_index)""",
    "of_keys": "SELECT event_id AS of, count(*) AS n_keys, sum(is_letter) AS n_letters, min(key_row) AS key_lo, max(key_row) + 1 AS key_hi FROM keys2 GROUP BY event_id",
    "of_points": """SELECT event_id, action, user_id, start AS touch_start_ms, stop AS touch_end_ms, count(*) AS n_rows, count(DISTINCT frame) AS n_frames, count(DISTINCT pointer_id) AS n_pointers,
  sum(active) AS active_row_count, min(point_row) AS point_lo, max(point_row) + 1 AS point_hi, min(seg) AS seg FROM points1 GROUP BY event_id, action, user_id, start, stop""",
    "events1": """SELECT event_id, action, user_id, user_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS external_id, event_id % 26 AS session_id, CASE WHEN event_id % 53 = 0 THEN 2 ELSE 0 END AS orientation_id,
  touch_start_ms + CASE WHEN action = 'keystroke' THEN 0 ELSE event_id % 3 END AS label_start_ms, touch_end_ms AS label_end_ms,
  touch_end_ms - touch_start_ms - CASE WHEN action = 'keystroke' THEN 0 ELSE event_id % 3 END + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS label_duration_ms,
  touch_start_ms, touch_end_ms, touch_end_ms - touch_start_ms + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS touch_duration_ms,
  CASE WHEN action = 'keystroke' THEN 0 ELSE event_id % 3 END AS active_start_rel_ms, touch_end_ms - touch_start_ms AS active_end_rel_ms,
  CASE WHEN action = 'keystroke' THEN 0 ELSE -(event_id % 3) END AS match_start_error_ms, CASE WHEN event_id % 59 = 0 THEN 1 ELSE 0 END AS match_end_error_ms,
  n_rows - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS n_rows, n_frames, n_pointers, CASE WHEN action = 'pinch' THEN 2 ELSE 1 END AS max_pointer_count,
  coalesce(n_keys, 0) AS n_keys, coalesce(n_letters, 0) AS n_letters, CASE WHEN action = 'keystroke' THEN coalesce(n_keys, 0) ELSE 1 END AS n_raw_gestures,
  CASE WHEN action = 'keystroke' THEN -1 WHEN event_id % 7 = 0 THEN 1 ELSE seg END AS raw_gesture_id, active_row_count, user_id AS bundle, point_lo, point_hi + CASE WHEN event_id % 61 = 0 THEN 1 ELSE 0 END AS point_hi,
  coalesce(key_lo, 0) AS key_lo, coalesce(key_hi, 0) AS key_hi FROM of_points LEFT JOIN of_keys ON event_id = of""",
    "bundles1": "SELECT user_id AS bundle, count(*) AS n_points FROM points1 GROUP BY user_id",
    "audited1": "SELECT event_id FROM events1 WHERE event_id % 17 > 0 UNION ALL SELECT -event_id FROM events1 WHERE event_id % 71 = 0 UNION ALL SELECT event_id FROM events1 WHERE event_id % 73 = 0",
}


def event_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The touch view's complete contacts as event, key and point tables, with faults at rows of certain numbers."""
    touch = A.touch(spark, sf)
    element = f"element_at(array({', '.join(map(repr, V.ACTIONS))}), CAST(floor(p.seg / 3) % 5 + 1 AS INT))"
    views = {"touch": touch, "points": written(G.points(touch), "points")}
    out = views | {"base": spark.sql(_BASE.format(element=element).replace("FROM points p JOIN touch t", "FROM {points} p JOIN {touch} t"), **views)}
    names = ["base", *_STEPS]
    for name, text in _STEPS.items():
        for other in names:
            text = text.replace(f"FROM {other}", f"FROM {{{other}}}").replace(f"JOIN {other}", f"JOIN {{{other}}}")
        out[name] = spark.sql(text, **{k: v for k, v in out.items() if f"{{{k}}}" in text})
        if name in ("points1", "keys2", "events1"):
            out[name] = written(out[name], name)
    return out


def p27_event_audit(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    return V.audit(t["events1"], t["keys2"], t["points1"].drop("user_id", "action", "start", "stop", "key_id", "seg"), t["bundles1"], t["audited1"], USERS)


def _chosen(rules: dict[str, str], prefix: str = "") -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{prefix}{n}' END" for n, c in rules.items()) + "], lambda r: r IS NOT NULL)) AS rule"


_SEEN = """count(*) AS rows_seen, sum(active) AS active_seen, count(DISTINCT pointer_id) AS pointers_seen, max(pointer_count) AS count_seen, arg_min(code, point_row) AS first_code, arg_max(code, point_row) AS last_code"""
_P27 = f"""WITH {_POINTS}, base AS ({_BASE.format(element=f"{V.ACTIONS}[CAST(floor(p.seg / 3) % 5 + 1 AS INT)]")}), {', '.join(f'{n} AS MATERIALIZED ({s})' for n, s in _STEPS.items())},
pt AS (SELECT * EXCLUDE (user_id, action, start, stop, key_id, seg) FROM points1),
seen AS (SELECT event_id, {_SEEN}, count(DISTINCT frame) AS frames_seen, arg_min(t_rel_ms, point_row) AS first_t, arg_max(t_rel_ms, point_row) AS last_t FROM pt GROUP BY event_id),
typed AS (SELECT event_id, count(*) AS keys_seen, sum(is_letter) AS letters_seen, arg_min(down_ms, key_index) AS first_down, arg_max(up_ms, key_index) AS last_up, arg_min(key_touch_start_ms, key_index) AS first_touch,
  arg_max(key_touch_end_ms, key_index) AS last_touch, round_even(avg(key_start_error_ms), 0) AS start_error_mean, round_even(avg(key_end_error_ms), 0) AS end_error_mean FROM keys2 GROUP BY event_id),
ev AS (SELECT event_id::VARCHAR AS key, action AS detail, {_chosen(V.EVENT | V.EVENT_POINTS | V.EVENT_KEYS)} FROM events1 LEFT JOIN seen USING (event_id) LEFT JOIN typed USING (event_id)),
pj AS (SELECT pt.*, e.action, e.label_start_ms, e.label_end_ms, e.orientation_id, lag(frame) OVER w AS frame_before, lag(t_rel_ms) OVER w AS t_before, lag(event_time_ms) OVER w AS time_before, lag(key_index) OVER w AS key_before
  FROM pt JOIN events1 e USING (event_id) WINDOW w AS (PARTITION BY event_id ORDER BY point_row)),
po AS (SELECT concat_ws('/', event_id, point_row) AS key, action AS detail, {_chosen(V.POINT)} FROM pj),
fr AS (SELECT concat_ws('/', event_id, frame) AS key, action AS detail, {_chosen(V.FRAME)} FROM (SELECT event_id, action, frame, count(DISTINCT pointer_id) AS pointers_seen, max(pointer_count) AS count_seen, sum(active) AS active_seen FROM pj GROUP BY ALL)),
ks AS (SELECT event_id, key_index, {_SEEN}, min(keycode) AS least_keycode, max(keycode) AS most_keycode FROM pt GROUP BY event_id, key_index),
kr AS (SELECT concat_ws('/', event_id, key_index) AS key, source::VARCHAR AS detail, {_chosen(V.KEY)} FROM (SELECT keys2.*, e.action, e.orientation_id, ks.* EXCLUDE (event_id, key_index), lag(keys2.key_index) OVER w AS index_before, lag(up_ms) OVER w AS up_before
  FROM keys2 JOIN events1 e USING (event_id) LEFT JOIN ks ON ks.event_id = keys2.event_id AND ks.key_index = keys2.key_index WINDOW w AS (PARTITION BY keys2.event_id ORDER BY keys2.key_index))),
pa AS (SELECT 'event_' AS name, bundle AS parent, 0 AS parent_lo, n_points AS parent_hi FROM bundles1 UNION ALL SELECT 'key_', event_id, key_lo, key_hi FROM events1 UNION ALL SELECT 'contact_', event_id, point_lo, point_hi FROM events1 WHERE action = 'keystroke'),
ch AS (SELECT 'event_' AS name, bundle AS parent, event_id AS child, point_lo AS lo, point_hi AS hi FROM events1 UNION ALL SELECT 'key_', event_id, key_index, key_row, key_row + 1 FROM keys2 UNION ALL SELECT 'contact_', event_id, key_index, point_lo, point_hi FROM keys2),
ti AS (SELECT name, concat_ws('/', parent, child) AS key, {_chosen(V.TILE)} FROM (SELECT *, lag(lo) OVER w AS lo_before, lag(hi) OVER w AS hi_before, lead(lo) OVER w IS NULL AS is_last FROM ch WINDOW w AS (PARTITION BY name, parent ORDER BY lo, hi, child)) LEFT JOIN pa USING (name, parent)),
ra AS (SELECT user_id, session_id, raw_gesture_id AS raw FROM events1 WHERE action <> 'keystroke' AND raw_gesture_id >= 0 UNION ALL SELECT user_id, session_id, key_raw_id FROM keys2 JOIN (SELECT event_id, session_id FROM events1) USING (event_id) WHERE source = 0 AND key_raw_id >= 0)
SELECT rule, key, detail FROM ev UNION ALL SELECT rule, key, detail FROM po UNION ALL SELECT rule, key, detail FROM fr UNION ALL SELECT rule, key, detail FROM kr UNION ALL SELECT name || rule, key, NULL FROM ti
UNION ALL SELECT name || 'range_bare', parent::VARCHAR, NULL FROM pa WHERE parent_hi > parent_lo AND (name, parent) NOT IN (SELECT (name, parent) FROM ch)
UNION ALL SELECT 'event_id_repeated', event_id::VARCHAR, count(*)::VARCHAR FROM events1 GROUP BY event_id HAVING count(*) > 1
UNION ALL SELECT 'raw_gesture_owned_twice', concat_ws('/', user_id, session_id, raw), count(*)::VARCHAR FROM ra GROUP BY user_id, session_id, raw HAVING count(*) > 1
UNION ALL SELECT 'external_ids', user_id::VARCHAR, count(DISTINCT external_id)::VARCHAR FROM events1 GROUP BY user_id HAVING count(DISTINCT external_id) > 1
UNION ALL SELECT 'user_count', action, count(DISTINCT user_id)::VARCHAR FROM events1 GROUP BY action HAVING count(DISTINCT user_id) <> {USERS}
UNION ALL SELECT 'not_audited', event_id::VARCHAR, action FROM events1 WHERE event_id NOT IN (SELECT event_id FROM audited1)
UNION ALL SELECT 'audited_without_event', event_id::VARCHAR, NULL FROM audited1 WHERE event_id NOT IN (SELECT event_id FROM events1)
UNION ALL SELECT 'audited_twice', event_id::VARCHAR, count(*)::VARCHAR FROM audited1 GROUP BY event_id HAVING count(*) > 1"""


def evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the score and duration views give now: claims of the scaler, the cuts, the curves, the metrics of both pools, the
    duration bins and the macro report; the bindings of each to its inputs; the inputs' fingerprints."""
    rows = written(A.scores(spark, sf), "scores")
    bins = A.bins(spark, sf)
    by_action = lambda kind: F.concat(F.lit(kind + "/"), "action")
    val = rows.filter("pool = 'val'")
    scaler = rows.filter("pool = 'train'").groupBy(*CELL).agg(F.avg("score").alias("mean"), F.var_pop("score").alias("var"))
    points = written(M.curve(val, CELL), "curve")
    curves = points.groupBy(*CELL).agg(F.count("*").alias("cuts"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    cuts = written(M.select_cuts(val, CELL), "cuts")
    long_cuts = cuts.unpivot(CELL, ["eer", "frr5"], "point", "cut")
    cells = None
    for pool in ("val", "test"):
        at = M.at_cut(rows.filter(F.col("pool") == pool).crossJoin(F.broadcast(spark.createDataFrame([("eer",), ("frr5",)], "point string"))), long_cuts, [*CELL, "point"], "cut")
        at = at.withColumn("pool", F.lit(pool))
        cells = at if cells is None else cells.unionByName(at)
    cells = written(cells, "cells")
    spread = M.duration_metrics(bins.filter("pool = 'test'"), M.duration_cuts(bins.filter("pool = 'train'"), LEVELS), CUT)
    macro = cells.filter("pool = 'test'").groupBy("point").agg(F.avg("far").alias("far"), F.avg("frr").alias("frr"), F.count("*").alias("cells"))
    parts = [
        R.as_claims(scaler, by_action("scaler"), ["detector"], ["mean", "var"]),
        R.as_claims(curves, by_action("curves"), ["detector"], ["cuts", "accepted", "rejected"]),
        R.as_claims(cuts, by_action("cuts"), ["detector"], ["eer", "frr5", "val_fa", "val_frr"]),
        R.as_claims(cells, by_action("metrics"), ["detector", "pool", "point"], ["far", "frr", "n_real", "n_fake"]),
        R.as_claims(spread, F.lit("durations"), ["bin"], ["fa", "frr", "n_real", "n_fake"]),
        R.as_claims(macro, F.lit("report"), ["point"], ["far", "frr", "cells"]),
    ]
    claims = parts[0]
    for p in parts[1:]:
        claims = claims.unionByName(p)
    current = R.fingerprints(rows.select("event_id", "user_id", "action", "label", "detector", "score", "pool"), by_action("scores"))
    current = current.unionByName(R.fingerprints(bins, F.lit("bins")))
    actions = rows.select("action").distinct()
    rests = {"scaler": ["scores"], "curves": ["scores"], "cuts": ["scores", "curves"], "metrics": ["scores", "cuts"]}
    links = actions.select(F.explode(F.array(*[F.struct(by_action(a).alias("artifact"), by_action(i).alias("input")) for a, inputs in rests.items() for i in inputs])).alias("l")).select("l.*")
    links = links.unionByName(actions.select(F.lit("report").alias("artifact"), by_action("metrics").alias("input")))
    links = links.unionByName(spark.createDataFrame([("durations", "bins"), ("report", "durations")], "artifact string, input string"))
    return written(claims, "claims"), links, written(current, "fingerprints")


def p28_recompute_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence as stored, with faults: a scaler of another mean, cells left out, stated twice or of a detector that isn't there,
    and one action's artifacts bound to its scores before a tenth of the rows came."""
    claims, links, current = evidence(spark, sf)
    kinds = claims.select(F.substring_index("artifact", "/", -1).alias("action")).filter("artifact like 'scaler/%'").distinct()
    first, last = kinds.agg(F.min("action"), F.max("action")).first()
    value = F.when((F.col("artifact") == f"scaler/{last}") & (F.col("key") == "0"), F.col("value") + 1e-6).otherwise(F.col("value"))
    stored = claims.withColumn("value", value).filter(~((F.col("artifact") == f"metrics/{last}") & F.col("key").startswith("2|val")))
    again = claims.filter((F.col("artifact") == f"cuts/{last}") & (F.col("key") == "1"))
    odd = claims.filter((F.col("artifact") == f"curves/{last}") & (F.col("key") == "2")).withColumn("key", F.lit("7"))
    rows = A.scores(spark, sf).filter("event_id % 10 > 0").filter(F.col("action") == first)
    old = R.fingerprints(rows.select("event_id", "user_id", "action", "label", "detector", "score", "pool"), F.concat(F.lit("scores/"), "action"))
    inputs = current.join(old, "name", "left_anti").unionByName(old)
    # What an artifact states of another one, and what that one has now, are the same here: its name stands for both.
    names = claims.select(F.col("artifact").alias("name")).distinct().withColumn("fingerprint", F.col("name"))
    bound = links.join(inputs.unionByName(names).withColumnRenamed("name", "input"), "input")
    out = R.audit(stored.unionByName(again).unionByName(odd), claims, bound, current.unionByName(names))
    return out.withColumns({c: F.round(c, 5) for c in ("stored", "recomputed")})


def _print(name: str, cells: list[str], source: str) -> str:
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in cells)
    return f"SELECT {name} AS name, count(*) || ':' || sum(CAST('0x' || substr(sha256(concat_ws(chr(31), {text})), 1, 15) AS HUGEINT)) AS fingerprint FROM {source} GROUP BY 1"


_SCORE_CELLS = ["action", "detector", "event_id", "label", "pool", "score", "user_id"]
_P28 = f"""{_CUTS}, {BINS},
lc AS (SELECT action, detector, 'eer' AS point, eer AS cut FROM cuts UNION ALL SELECT action, detector, 'frr5', frr5 FROM cuts),
cell AS MATERIALIZED (SELECT action, detector, pool, point, avg(CAST(score < cut AS INTEGER)) FILTER (label = 1) AS far, avg(CAST(score >= cut AS INTEGER)) FILTER (label = 0) AS frr, count(*) FILTER (label = 0) AS n_real,
  count(*) FILTER (label = 1) AS n_fake FROM scores JOIN lc USING (action, detector) WHERE pool <> 'train' GROUP BY ALL),
dc AS (SELECT list_sort(list_distinct(quantile_cont(duration, {LEVELS}))) AS cuts FROM bins WHERE pool = 'train'),
dp AS (SELECT {_BINNED} AS bin, bins.* FROM bins, dc WHERE pool = 'test'), dl AS (SELECT unnest(range(0, len(cuts) + 1)) AS bin FROM dc),
dm AS (SELECT dl.bin AS bin, avg(CAST(score < {CUT} AS INTEGER)) FILTER (label = 1) AS fa, avg(CAST(score >= {CUT} AS INTEGER)) FILTER (label = 0) AS frr, count(*) FILTER (label = 0) AS n_real, count(*) FILTER (label = 1) AS n_fake
  FROM dl LEFT JOIN dp ON dp.bin = dl.bin GROUP BY dl.bin),
wide AS (SELECT 'scaler/' || action AS artifact, detector::VARCHAR AS key, ['mean', 'var'] AS m, [avg(score), var_pop(score)] AS v FROM scores WHERE pool = 'train' GROUP BY action, detector
  UNION ALL SELECT 'curves/' || action, detector::VARCHAR, ['cuts', 'accepted', 'rejected'], [count(*), sum(accepted), sum(rejected)]::DOUBLE[] FROM points GROUP BY action, detector
  UNION ALL SELECT 'cuts/' || action, detector::VARCHAR, ['eer', 'frr5', 'val_fa', 'val_frr'], [eer, frr5, val_fa, val_frr] FROM cuts
  UNION ALL SELECT 'metrics/' || action, concat_ws('|', detector, pool, point), ['far', 'frr', 'n_real', 'n_fake'], [far, frr, n_real, n_fake]::DOUBLE[] FROM cell
  UNION ALL SELECT 'durations', bin::VARCHAR, ['fa', 'frr', 'n_real', 'n_fake'], [fa, frr, n_real, n_fake]::DOUBLE[] FROM dm
  UNION ALL SELECT 'report', point, ['far', 'frr', 'cells'], [avg(far), avg(frr), count(*)]::DOUBLE[] FROM cell WHERE pool = 'test' GROUP BY point),
claim AS MATERIALIZED (SELECT artifact, key, unnest(m) AS measure, unnest(v) AS value FROM wide),
ends AS (SELECT min(action) AS a, max(action) AS z FROM scores),
stored AS (SELECT artifact, key, measure, CASE WHEN artifact = 'scaler/' || z AND key = '0' THEN value + 1e-6 ELSE value END AS value FROM claim, ends WHERE NOT (artifact = 'metrics/' || z AND key LIKE '2|val%')
  UNION ALL SELECT claim.* FROM claim, ends WHERE artifact = 'cuts/' || z AND key = '1' UNION ALL SELECT artifact, '7', measure, value FROM claim, ends WHERE artifact = 'curves/' || z AND key = '2'),
stated AS (SELECT artifact, key, measure, count(*) AS n, max(value) AS stored FROM stored GROUP BY ALL),
now AS ({_print("'scores/' || action", _SCORE_CELLS, "scores")}), old AS ({_print("'scores/' || action", _SCORE_CELLS, "scores, ends WHERE event_id % 10 > 0 AND action = a")}),
stale AS (SELECT a FROM ends WHERE (SELECT fingerprint FROM now WHERE name = 'scores/' || a) <> (SELECT fingerprint FROM old)),
fallen AS (SELECT k || '/' || a AS artifact, 'stale' AS state, 'scores/' || a AS cause FROM stale, (SELECT unnest(['scaler', 'curves', 'cuts', 'metrics']) AS k)
  UNION ALL SELECT 'report', 'void', 'metrics/' || a FROM stale),
joined AS (SELECT coalesce(s.artifact, c.artifact) AS artifact, coalesce(s.key, c.key) AS key, coalesce(s.measure, c.measure) AS measure, stored, value AS recomputed,
  CASE WHEN c.artifact IS NULL THEN 'orphan' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN stored IS NOT DISTINCT FROM value OR abs(stored - value) <= 1e-12 + 1e-12 * abs(value) THEN 'holds' ELSE 'wrong' END AS verdict
  FROM stated s FULL JOIN claim c ON s.artifact = c.artifact AND s.key = c.key AND s.measure = c.measure)
SELECT artifact, key, measure, round(stored, 5) AS stored, round(recomputed, 5) AS recomputed, CASE WHEN verdict IN ('orphan', 'missing') THEN verdict ELSE coalesce(state, verdict) END AS verdict,
  CASE WHEN verdict NOT IN ('orphan', 'missing') THEN cause END AS cause FROM joined LEFT JOIN fallen USING (artifact)"""


def s9_registries(spark: SparkSession, sf: str) -> DataFrame:
    """A split file of each action's users, one of them cut short, with users listed twice, in two pools, in none and unknown; written,
    read back and held against the events' users."""
    users = A.table(spark, sf, "events").select(F.col("event_type").alias("action"), "user_id").distinct()
    u = F.col("user_id")
    pools = {"train": u % 10 < 7, "val": (u % 10 == 7) | (u % 23 == 0), "test": u % 10 > 7}
    listed = users.filter("user_id % 31 > 0").groupBy("action").agg(*[F.sort_array(F.collect_list(F.when(c, F.when(u % 37 == 0, -u).otherwise(u)))).alias(f"{p}_users") for p, c in pools.items()])
    listed = listed.withColumn("test_users", F.concat("test_users", F.filter("test_users", lambda x: x % 29 == 0)))
    last = users.agg(F.max("action")).first()[0]
    text = F.to_json(F.struct("action", *[f"{p}_users" for p in pools]))
    folder = shared_folder(spark, "splits")
    listed.select(F.when(F.col("action") == last, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text).alias("value")).write.text(folder)
    rows = S.json_rows(spark, folder, "action string, train_users array<long>, val_users array<long>, test_users array<long>", ["action", *[f"{p}_users" for p in pools]])
    good = rows.filter("reason is null")
    known = users.join(good.select("action"), "action", "left_semi")
    faults = S.split_faults(S.split_users(good, ["action"]), ["action"], {"train": 7, "val": 1, "test": 2}, known)
    return faults.unionByName(rows.filter("reason is not null").select(F.lit(None).cast("string").alias("action"), F.col("reason").alias("rule"), F.lit(None).cast("string").alias("key")))


def s10_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cell results written as CSV and read back; one detector's rates are out of range."""
    cells = M.at_cut(A.scores(spark, sf).filter("pool = 'test'"), M.select_cuts(A.scores(spark, sf).filter("pool = 'val'"), CELL), CELL, "frr5")
    rate = F.round(F.col("far") + F.when(F.col("detector") == 2, 1).otherwise(0), 6)
    named = cells.select(F.lit("release").alias("method"), "action", F.lit("touch").alias("modality"), F.concat(F.lit("d"), "detector").alias("detector"), rate.alias("far_at_frr5"), F.when(F.col("detector") != 1, F.round("frr", 6)).alias("eer_test"))
    folder = shared_folder(spark, "cells")
    S.write_cells(named, folder)
    return S.read_cells(spark, folder)


_S9 = """WITH u AS (SELECT DISTINCT event_type AS action, user_id FROM events), z AS (SELECT max(action) AS z FROM u), g AS (SELECT u.* FROM u, z WHERE action <> z),
l AS (SELECT action, CASE WHEN user_id % 37 = 0 THEN -user_id ELSE user_id END AS id, unnest(list_filter([CASE WHEN user_id % 10 < 7 THEN 'train' END, CASE WHEN user_id % 10 = 7 OR user_id % 23 = 0 THEN 'val' END, CASE WHEN user_id % 10 > 7 THEN 'test' END], lambda p: p IS NOT NULL)) AS pool
  FROM g WHERE user_id % 31 > 0), e AS (SELECT action, id, pool, CASE WHEN pool = 'test' AND id % 29 = 0 THEN 2 ELSE 1 END AS n FROM l),
w AS (SELECT action, pool, want FROM (SELECT DISTINCT action FROM e), (SELECT unnest(['train', 'val', 'test']) AS pool, unnest([7, 1, 2]) AS want)), h AS (SELECT action, pool, count(*) AS n FROM e GROUP BY ALL)
SELECT action, 'user_twice_in_pool' AS rule, pool || '/' || id AS key FROM e WHERE n > 1
UNION ALL SELECT action, 'user_in_several_pools', string_agg(pool, '+' ORDER BY pool) || '/' || id FROM e GROUP BY action, id HAVING count(*) > 1
UNION ALL SELECT DISTINCT action, 'unknown_user', id::VARCHAR FROM e WHERE (action, id) NOT IN (SELECT (action, user_id) FROM g)
UNION ALL SELECT action, 'user_in_no_pool', user_id::VARCHAR FROM g WHERE (action, user_id) NOT IN (SELECT (action, id) FROM e)
UNION ALL SELECT w.action, 'pool_size', w.pool || '/' || coalesce(n, 0) FROM w LEFT JOIN h USING (action, pool) WHERE coalesce(n, 0) <> want
UNION ALL SELECT NULL, 'not_json', NULL"""
_S10 = f"""{_CELLS}, c AS (SELECT 'release' AS method, action, 'touch' AS modality, 'd' || detector AS detector, round(far + CASE WHEN detector = 2 THEN 1 ELSE 0 END, 6) AS far_at_frr5, CASE WHEN detector <> 1 THEN round(frr, 6) END AS eer_test FROM cells)
SELECT *, CASE WHEN far_at_frr5 NOT BETWEEN 0 AND 1 THEN 'bad:far_at_frr5' END AS reason FROM c"""

QUERIES = {"p27_event_audit": p27_event_audit, "p28_recompute_audit": p28_recompute_audit, "s9_registries": s9_registries, "s10_cells": s10_cells}
ORACLES = {"p27_event_audit": _P27, "p28_recompute_audit": _P28, "s9_registries": _S9, "s10_cells": _S10}
