"""Row rules, pools, bindings and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlens.operators import contracts as P
from padlens.operators import reports as T
from padlens.operators import resample as R
from padlens.operators import rows as W
from padlens.operators import sessions as N
from padlens.operators import splits as D
from padlens.plans import adapters as A
from padlens.plans.adapters import CELL, RHYTHM, SCORES, TOUCH
from padlens.plans.gesture_queries import all_rounded
from padlens.plans.metric_queries import _CELLS, cells_of, cuts_of
from padlens.plans.session_queries import _DRAWN, _STATS, drawn_of, flags_of, session_scores, stats_of


def p1_pointers(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf)
    return W.pointer_semantics(
        t.select(
            F.concat_ws("-", "user_id", (F.floor(F.col("source_row") / 2000)).cast("string")).alias("gesture"), F.when(F.col("user_id") % 3 == 0, "pinch").otherwise("tap").alias("action"),
            (F.col("source_row") % 2 + 1).alias("pointer_count"), (F.col("source_row") % 2).alias("pointer_id"),
        )
    )


def p2_orientation(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf)
    return W.one_orientation(t.select(F.col("source_row").alias("gesture"), (F.col("user_id") % 2).alias("orient"), (F.col("source_row") % 3 - 1).alias("label_orient")))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return A.rhythm(spark, sf).select(
        F.concat_ws("-", "user_id", "session_id").alias("event"), F.col("event_id").alias("key_index"), F.col("start_ms").alias("down_ms"), F.col("end_ms").alias("up_ms"),
        (F.col("event_id") % 4 + 1).alias("n_frames"), (F.col("event_id") % 10).alias("error"),
    )


def p5_p7_keys(spark: SparkSession, sf: str) -> DataFrame:
    code = F.col("event_id") % 130 - 5
    rows = A.table(spark, sf, "events").select("event_id", W.canonical_keycode(code).alias("code"), "event_type")
    token = W.key_token(F.col("code"))
    return rows.select("event_id", "code", token.alias("token"), W.is_correction(F.when(F.col("event_id") % 7 == 0, " BackSpace ").otherwise(token)).alias("correction"))


def p8_records(spark: SparkSession, sf: str) -> DataFrame:
    t = A.touch(spark, sf)
    k = F.col("source_row")
    return W.record_contract(
        t.select(
            F.col("user_id").alias("event"), F.col("evt_t").alias("t_ms"), k.alias("i"), (k % 4 != 0).cast("int").alias("contact"), (k % 5 != 0).cast("int").alias("active"),
            (k % 6 == 0).cast("int").alias("gap"), F.when(k % 31 == 0, None).otherwise(F.col("x")).alias("x"),
        )
    )


def p11_components(spark: SparkSession, sf: str) -> DataFrame:
    t = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_partkey") % 9 == 0, "xyz").otherwise(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("digest"), (F.col("l_quantity") - 2).alias("duration_ms")
    )
    return W.component_contract(t, ["touch__a", "b"], "touch__")


def p18_convention(spark: SparkSession, sf: str) -> DataFrame:
    stored = cells_of(spark, sf).join(cuts_of(spark, sf).select(*CELL, F.col("frr5").alias("cut")), CELL)
    stored = stored.select(*CELL, "cut", (F.col("far") + F.when(F.col("detector") == 1, 0.1).otherwise(0.0)).alias("far"), "frr")
    return all_rounded(W.convention_check(A.scores(spark, sf).filter("pool = 'test'"), stored, CELL))


def p21_changed(spark: SparkSession, sf: str) -> DataFrame:
    a = A.scores(spark, sf)
    b = a.withColumn("score", F.when(F.col("event_id") % 10 == 0, F.col("score")).otherwise(F.col("score") + 1))
    return all_rounded(P.changed_share(a, b, "event_id", "score", "action"))


def d2_mixed(spark: SparkSession, sf: str) -> DataFrame:
    a = A.scores(spark, sf)
    return W.mixed_policy(a, W.user_split(a.select("user_id").distinct())).groupBy("label", "pool").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def d9_cadence(spark: SparkSession, sf: str) -> DataFrame:
    return all_rounded(W.machine_cadence(N.gaps(A.rhythm(spark, sf))).select("event_id", "constant_s", "jittered_s"))


def j11_bindings(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").select("event_id", "user_id")
    clusters = e.filter("event_id % 10 = 3").select((F.col("event_id") * 7).alias("cluster_id"), F.when(F.col("event_id") % 50 == 13, -F.col("event_id")).otherwise(F.col("event_id")).alias("event_id"))
    return T.bindings(clusters, e, e.filter("event_id % 25 = 1").select("user_id", (-F.col("event_id")).alias("shot"), F.col("event_id").alias("enrolled_id")))


def j16_relink(spark: SparkSession, sf: str) -> DataFrame:
    a = A.scores(spark, sf).select("event_id", "label", F.col("score").alias("duration"))
    known = a.filter("event_id % 6 <> 1").select("event_id", (F.col("duration") + F.when(F.col("event_id") % 5 == 0, 0.5).otherwise(0.0)).alias("known_duration"))
    return T.identity_relink(a.filter("label = 0").drop("label"), a.filter("label = 1").drop("label"), known, 1e-5)


def r5_rate(spark: SparkSession, sf: str) -> DataFrame:
    return all_rounded(R.interval(T.clustered_rate(flags_of(spark, sf), drawn_of(spark, sf)), [], "rate"))


def r7_median(spark: SparkSession, sf: str) -> DataFrame:
    users = A.scores(spark, sf).groupBy("user_id").agg(F.avg("score").alias("delta"))
    return all_rounded(R.interval(T.median_delta(users, drawn_of(spark, sf)), [], "median"))


def r8_binned(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.scores(spark, sf).select(F.col("action").alias("arm"), "user_id", (F.col("event_id") % 4).alias("bin"), "score")
    return all_rounded(R.interval(T.binned_rates(rows, drawn_of(spark, sf), 20.0), ["arm", "bin"], "rate"))


def n10_cells(spark: SparkSession, sf: str) -> DataFrame:
    cell = (F.col("user_id") % 4).alias("cell")
    stats = stats_of(spark, sf).select("label", "s1_count", cell)
    ks = spark.range(1, 6).select(F.col("id").alias("level"))
    points = stats.crossJoin(F.broadcast(ks)).groupBy("cell", "level").agg(
        *[F.avg(F.when(F.col("label") == y, (F.col("s1_count") >= F.col("level")).cast("double"))).alias(n) for y, n in ((1, "caught"), (0, "false_alarm"))]
    )
    return all_rounded(T.per_cell_mean(points, ["cell"], 0.5))


QUERIES = {
    "p1_pointer_semantics": p1_pointers,
    "p2_one_orientation": p2_orientation,
    "p5_p7_key_tokens": p5_p7_keys,
    "p8_record_contract": p8_records,
    "p11_component_contract": p11_components,
    "p18_convention_check": p18_convention,
    "p21_changed_share": p21_changed,
    "d2_d3_mixed_policy": d2_mixed,
    "d9_machine_cadence": d9_cadence,
    "g7_pointer_slots": lambda s, d: W.pointer_slots(A.touch(s, d).select(F.col("user_id").alias("event"), (F.col("source_row") % 5).alias("pointer"), F.col("evt_t").alias("t_ms"), "source_row")),
    "g11_typing_events": lambda s, d: W.typing_events(keys(s, d)),
    "j11_bindings": j11_bindings,
    "j13_transfer": lambda s, d: all_rounded(T.transfer(A.scores(s, d).filter("pool = 'train'"), cuts_of(s, d), CELL)),
    "j16_identity_relink": j16_relink,
    "n5_oracle_point": lambda s, d: all_rounded(T.oracle_point(stats_of(s, d), "s1_count", 0.05)),
    "n10_cell_means": n10_cells,
    "n13_duration_only": lambda s, d: all_rounded(T.duration_only(session_scores(s, d), 0.1)),
    "r5_clustered_rate": r5_rate,
    "r7_median_delta": r7_median,
    "r8_binned_rates": r8_binned,
    "s13_report_table": lambda s, d: T.side_by_side(cells_of(s, d), "action", "detector", [0, 1, 2], "far").withColumnsRenamed({"0": "d0", "1": "d1", "2": "d2"}),
}

_INTERVAL = "round(avg(v), 5) AS mean, round(quantile_cont(v, 0.025), 5) AS low, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.975), 5) AS high, count(v) AS n"
_K = "event_id"
ORACLES = {
    "p1_pointer_semantics": """WITH g AS (SELECT concat_ws('-', user_id, event_id // 2000) AS gesture, CASE WHEN user_id % 3 = 0 THEN 'pinch' ELSE 'tap' END AS action, max(event_id % 2 + 1) AS most, count(DISTINCT event_id % 2) AS pointers FROM events GROUP BY ALL)
SELECT *, CASE WHEN action = 'pinch' THEN most = 2 AND pointers = 2 ELSE most = 1 AND pointers = 1 END AS fits FROM g""",
    "p2_one_orientation": "SELECT event_id AS gesture, user_id % 2 AS orient FROM events WHERE event_id % 3 - 1 IN (-1, user_id % 2)",
    "p5_p7_key_tokens": """WITH c AS (SELECT event_id, CASE WHEN event_id % 130 - 5 < 0 THEN 0 ELSE event_id % 130 - 5 END AS code FROM events), t AS (SELECT *, CASE WHEN code BETWEEN 65 AND 90 OR code BETWEEN 97 AND 122 THEN chr(code::INTEGER) ELSE 'keycode_' || code END AS token FROM c)
SELECT event_id, code, token, event_id % 7 = 0 AS correction FROM t""",
    "p8_record_contract": f"""WITH {TOUCH}, f AS (SELECT user_id AS event, source_row AS k, evt_t < lag(evt_t) OVER (PARTITION BY user_id ORDER BY source_row) AS back, CASE WHEN source_row % 31 = 0 THEN NULL ELSE x END AS x FROM touch),
r AS (SELECT event, 'time_runs_back' AS rule FROM f WHERE back UNION ALL SELECT event, 'active_without_contact' FROM f WHERE k % 5 <> 0 AND k % 4 = 0 UNION ALL SELECT event, 'value_without_contact' FROM f WHERE k % 4 = 0 AND coalesce(x, 0) <> 0
 UNION ALL SELECT event, 'gap_with_contact' FROM f WHERE k % 6 = 0 AND k % 4 <> 0 UNION ALL SELECT event, 'not_finite' FROM f WHERE x IS NULL) SELECT event, rule, count(*) AS n FROM r GROUP BY ALL""",
    "p11_component_contract": """SELECT 'repeated_id' AS rule, l_orderkey::VARCHAR AS key FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'bad_digest', l_orderkey::VARCHAR FROM lineitem WHERE l_partkey % 9 = 0
UNION ALL SELECT 'duration_not_positive', l_orderkey::VARCHAR FROM lineitem WHERE l_quantity <= 2 UNION ALL SELECT 'bad_prefix', 'b'""",
    "p18_convention_check": f"{_CELLS} SELECT action, detector, round(far, 5) AS far_again, round(frr, 5) AS frr_again, round(far + CASE WHEN detector = 1 THEN 0.1::DOUBLE ELSE 0 END, 5) AS far, round(frr, 5) AS frr, detector <> 1 AS agrees FROM cells",
    "p21_changed_share": "SELECT event_type AS action, round(avg(CAST(event_id % 10 <> 0 AS INTEGER)), 5) AS changed, count(*) AS n FROM events GROUP BY 1",
    "d2_d3_mixed_policy": f"""WITH {SCORES}, m AS (SELECT *, CASE WHEN label = 1 THEN CASE WHEN user_id % 100 < 70 THEN 'train' WHEN user_id % 100 < 80 THEN 'val' ELSE 'test' END ELSE pool END AS p FROM scores)
SELECT label, p AS pool, count(*) AS n, count(DISTINCT user_id) AS users FROM m GROUP BY ALL""",
    "d9_machine_cadence": f"""WITH {RHYTHM}, g AS (SELECT event_id, lag(end_ms) OVER (PARTITION BY user_id, session_id ORDER BY start_ms, event_id) IS NOT NULL AS has FROM rhythm)
SELECT event_id, CASE WHEN has THEN 2.0::DOUBLE END AS constant_s, CASE WHEN has THEN round(2 + (2 * (('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1), 5) END AS jittered_s FROM g""",
    "g7_pointer_slots": f"""WITH {TOUCH}, f AS (SELECT user_id AS event, source_row % 5 AS pointer, min((evt_t, source_row)) AS f FROM touch GROUP BY ALL) SELECT event, pointer, CAST(row_number() OVER (PARTITION BY event ORDER BY f) - 1 AS INTEGER) AS slot FROM f""",
    "g11_typing_events": f"""WITH {RHYTHM}, k AS (SELECT concat_ws('-', user_id, session_id) AS event, * FROM rhythm)
SELECT event, event_id AS key_index, CAST(coalesce(sum(event_id % 4 + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame_offset, end_ms - start_ms AS hold, coalesce(start_ms - lag(end_ms) OVER w, 0) AS flight,
 CAST(round_even(avg(event_id % 10) OVER (PARTITION BY event), 0) AS BIGINT) AS mean_error FROM k WINDOW w AS (PARTITION BY event ORDER BY start_ms, end_ms, event_id)""",
    "j11_bindings": """WITH c AS (SELECT event_id * 7 AS cluster_id, CASE WHEN event_id % 50 = 13 THEN -event_id ELSE event_id END AS event_id FROM events WHERE event_id % 10 = 3), s AS (SELECT user_id, string_agg(event_id, ',' ORDER BY -event_id) AS shots FROM events WHERE event_id % 25 = 1 GROUP BY user_id)
SELECT cluster_id, c.event_id, e.user_id, coalesce(shots, '') AS shots, e.user_id IS NULL AS unmapped FROM c LEFT JOIN events e USING (event_id) LEFT JOIN s ON s.user_id = e.user_id""",
    "j13_transfer": f"{_CELLS} SELECT action, detector, round(avg(CAST(score < frr5 AS INTEGER)), 5) AS far, count(*) AS n FROM scores JOIN cuts USING (action, detector) WHERE pool = 'train' AND label = 1 GROUP BY ALL",
    "j16_identity_relink": """SELECT event_id, event_id % 2 = 1 AS fake, CASE WHEN event_id % 6 = 1 THEN CASE WHEN event_id % 2 = 1 THEN 'missing' ELSE 'dropped' END WHEN event_id % 5 = 0 THEN 'differs' ELSE 'paired' END AS status FROM events""",
    "n5_oracle_point": f"""WITH {_STATS}, c AS (SELECT s1_count AS cut FROM (SELECT s1_count, row_number() OVER (ORDER BY s1_count DESC) - 1 AS i, count(*) OVER () AS n FROM stats WHERE label = 0) WHERE i = floor(0.05::DOUBLE * n))
SELECT round(avg(CAST(s1_count > cut AS INTEGER)) FILTER (label = 1), 5) AS caught, round(avg(CAST(s1_count > cut AS INTEGER)) FILTER (label = 0), 5) AS false_alarm FROM stats, c""",
    "n10_cell_means": f"""WITH {_STATS}, p AS (SELECT user_id % 4 AS cell, level, avg(CAST(s1_count >= level AS INTEGER)) FILTER (label = 1) AS caught, avg(CAST(s1_count >= level AS INTEGER)) FILTER (label = 0) AS fa FROM stats, range(1, 6) t(level) GROUP BY ALL),
m AS (SELECT level, avg(caught) AS caught, avg(fa) AS fa FROM p GROUP BY level)
SELECT round((SELECT avg(q) FROM (SELECT min(fa) FILTER (caught >= 0.5) AS q FROM p GROUP BY cell)), 5) AS mean_of_prices, round((SELECT min(fa) FILTER (caught >= 0.5) FROM m), 5) AS price_of_mean""",
    "r5_clustered_rate": f"""WITH {SCORES}, {_DRAWN}, c AS (SELECT user_id, sum(CAST(round(score / (score + 20.0::DOUBLE), 4) > 0.6::DOUBLE AS INTEGER)) AS s, count(*) AS n FROM scores WHERE label = 0 GROUP BY 1),
r AS (SELECT rep, sum(s * mult)::DOUBLE / sum(c.n * mult) AS v FROM c JOIN drawn USING (user_id) GROUP BY rep) SELECT {_INTERVAL} FROM r""",
    "r8_binned_rates": f"""WITH {SCORES}, {_DRAWN}, c AS (SELECT action AS arm, event_id % 4 AS bin, user_id, count(*) FILTER (score < 20) AS a, count(*) AS n FROM scores GROUP BY ALL),
r AS (SELECT arm, bin, rep, sum(a * mult)::DOUBLE / sum(c.n * mult) AS v FROM c JOIN drawn USING (user_id) GROUP BY ALL) SELECT arm, bin, {_INTERVAL} FROM r GROUP BY ALL""",
    "s13_report_table": f"{_CELLS} SELECT action, round(max(far) FILTER (detector = 0), 6) AS d0, round(max(far) FILTER (detector = 1), 6) AS d1, round(max(far) FILTER (detector = 2), 6) AS d2 FROM cells GROUP BY action",
}
