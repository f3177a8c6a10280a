"""Streaming and detector queries. A stream reads the events' folder once (available now) into a table that is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlens.functions.quantiles import exact_quantiles
from padlens.functions.shared import shared_folder, written
from padlens.operators import detectors as L
from padlens.operators import metrics as M
from padlens.operators import rows as W
from padlens.operators import sessions as N
from padlens.plans import adapters as A
from padlens.plans.adapters import TOUCH
from padlens.plans.gesture_queries import all_rounded
from padlens.streaming import queries as T


def once(spark: SparkSession, sf: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over the events table to its end and return what it wrote."""
    schema = A.table(spark, sf, "events").schema
    folder = shared_folder(spark, "stream")
    out = build(spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf))
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def touch_stream(events: DataFrame) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, [0, 2, 2, 1, 2, 3, 5])), (F.col("event_id") % 7 + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    return events.select("user_id", F.col("user_id").alias("act_id"), F.unix_millis(ts).alias("evt_t"), code.alias("code"), ts.alias("ts"))


def timed(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.col("event_type").alias("action"), F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("ts"))


def t4_sliding_alarm(spark: SparkSession, sf: str) -> DataFrame:
    cuts = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("action")).agg(F.round(F.avg("value"), 6).alias("cut"))
    return once(spark, sf, lambda e: T.caught_alarm(timed(e), cuts, 2)).withColumn("start", F.unix_seconds("start"))


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as samples: four features, label by return flag, pool by hash split."""
    rows = A.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_linestatus").alias("action"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_quantity").alias("f0"),
        F.col("l_extendedprice").alias("f1"),
        F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("f2"),
        F.col("l_discount").alias("f3"),
    )
    return rows.withColumn("pool", F.element_at(F.array(*map(F.lit, ["train", "train", "train", "val", "test"])), (F.pmod(F.xxhash64("event_id"), F.lit(5)) + 1).cast("int")))


FEATURES = ["f0", "f1", "f2", "f3"]


def detector_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: all_rounded(L.run_protocol(feature_rows(s, d), FEATURES, kind))


def l6_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two base detectors' out-of-sample scores, margins and rejections beside consistency columns, fused by a logistic model
    fitted on half of the validation rows; the cuts come from the other half."""
    rows = feature_rows(spark, sf)
    kinds = ["linear_svm", "logistic"]
    base = [L.run_protocol(rows, FEATURES, k).withColumn("detector", F.lit(k)) for k in kinds]
    meta = F.when((F.col("pool") == "val") & (F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(2)) == 0), "train").otherwise(F.col("pool"))
    scores = written(base[0].unionByName(base[1]).withColumn("pool", meta), "scores")
    cuts = M.select_cuts(scores.filter("pool = 'val'"), ["detector"])
    consistency = rows.select("event_id", (F.col("f1") / F.col("f0")).alias("consistency__unit"), (F.col("f2") * F.col("f3")).alias("consistency__spread"))
    fused, names = L.fusion_rows(L.decisions(scores, cuts, ["detector"]), consistency, kinds)
    return all_rounded(L.run_protocol(written(fused, "fused"), names, "logistic"))


def l7_protocol(spark: SparkSession, sf: str) -> DataFrame:
    """Five actions by two detectors: cuts, metrics of both pools, AUC and intervals of 2000 draws."""
    action = F.element_at(F.array(*map(F.lit, ["tap", "scroll", "swipe", "pinch", "keystroke"])), (F.pmod(F.xxhash64("event_id", F.lit(2)), F.lit(5)) + 1).cast("int"))
    return all_rounded(L.protocol(feature_rows(spark, sf).withColumn("action", action), FEATURES, ("linear_svm", "logistic")))


def l9_session_rhythm(spark: SparkSession, sf: str) -> DataFrame:
    """Genuine sessions against the same sessions with machine gaps, by all rhythm features: a forest, cut at the validation
    rows' 95 % quantile of genuine scores; caught and false-alarm share on test rows."""
    rows = W.machine_cadence(N.gaps(A.rhythm(spark, sf)), 0.5)
    pool = F.element_at(F.array(*map(F.lit, ["train", "train", "val", "test"])), (F.col("user_id") % 4 + 1).cast("int"))
    events = rows.select(*N.KEY, "action", "start_ms", "end_ms", "event_id", "jittered_s")
    sides = [N.rhythm_features(e.drop("jittered_s")).withColumn("label", F.lit(k)) for k, e in enumerate((events, N.at_cadence(events, "jittered_s")))]
    both = sides[0].unionByName(sides[1]).withColumn("pool", pool).withColumn("action", F.lit("session")).withColumn("event_id", F.concat_ws("-", *N.KEY, "label"))
    names = [c for c in sides[0].columns if c not in (*N.KEY, "label")]
    both = written(both.withColumns({n: F.col(n).cast("double") for n in names}), "rhythm")
    scored = written(L.run_protocol(both, names, "forest", L.SESSION), "scores")
    cut = exact_quantiles(scored.filter("pool = 'val' and label = 0"), [], "score", [0.95]).select(F.col("q")[0].alias("cut"))
    flag = (F.col("score") > F.col("cut")).cast("double")
    return scored.filter("pool = 'test'").crossJoin(F.broadcast(cut)).groupBy("label").agg(F.round(F.avg(flag), 5).alias("flagged"), F.count("*").alias("n"))


def t5_streaming_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic detector fitted on line items of the train pool scores them all as a stream."""
    rows = feature_rows(spark, sf)
    folder = shared_folder(spark, "stream")
    rows.write.parquet(f"{folder}/in")
    # Fitting passes over the rows several times; the written ones need no keys put together and hashed again.
    train = spark.read.schema(rows.schema).parquet(f"{folder}/in").filter("pool = 'train'").select("label", *FEATURES)
    model = L.detector("logistic", FEATURES).fit(L.balanced(train))
    out = T.scored(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), model)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return all_rounded(spark.read.schema(out.schema).parquet(f"{folder}/out").select("event_id", "pool", "label", "score"))


QUERIES = {
    "l9_session_rhythm": l9_session_rhythm,
    "t5_streaming_scores": t5_streaming_scores,
    "t1_streaming_contacts": lambda s, d: once(s, d, lambda e: T.contacts(touch_stream(e))),
    "t2_streaming_occupancy": lambda s, d: once(s, d, lambda e: T.occupancy(timed(e))).withColumn("start", F.unix_seconds("start")),
    "t3_streaming_sessions": lambda s, d: once(s, d, lambda e: T.gap_sessions(timed(e), "6 hours")).withColumn("start", F.unix_micros("start")),
    "t4_sliding_alarm": t4_sliding_alarm,
    "l2_linear_svm": detector_query("linear_svm"),
    "l3_forest": detector_query("forest"),
    "l4_boosted": detector_query("boosted"),
    "l5_rff_svm": detector_query("rff_svm"),
    "l6_fusion": l6_fusion,
    "l7_protocol": l7_protocol,
}

# A window closes when the watermark (ten minutes behind the latest event) passes its end; later windows stay open.
_MARK = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)"
ORACLES = {
    "t1_streaming_contacts": f"""WITH {TOUCH}, mark AS (SELECT {_MARK} // 1000 AS m), f AS (SELECT user_id, act_id, evt_t AS t, bool_or(code = 0) AS down, bool_or(code = 1) AS up, bool_or(code = 3) AS cancel FROM touch, mark WHERE evt_t < m GROUP BY ALL),
s AS (SELECT *, sum(CAST(down AS INTEGER)) OVER w AS seg, t - lag(t) OVER w >= 600000 AS far, lead(t) OVER w AS later FROM f WINDOW w AS (PARTITION BY user_id, act_id ORDER BY t)),
v AS (SELECT *, coalesce(sum(CAST(far AND NOT down AS INTEGER)) OVER w, 0) + coalesce(sum(CAST(up OR cancel AS INTEGER)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s WHERE seg > 0 WINDOW w AS (PARTITION BY user_id, act_id, seg ORDER BY t)),
c AS (SELECT user_id, act_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n_frames, bool_or(cancel) AS cancel, bool_or(up) AS up, max_by(later, t) AS later, any_value(m) AS m FROM v, mark WHERE over = 0 GROUP BY user_id, act_id, seg)
SELECT user_id, act_id, start_ms, end_ms, n_frames, CASE WHEN cancel THEN 'cancelled' WHEN up THEN 'complete' WHEN later - end_ms < 600000 THEN 'restarted' ELSE 'eof' END AS state FROM c WHERE up OR cancel OR later IS NOT NULL OR m > end_ms + 600000""",
    "t2_streaming_occupancy": f"SELECT * FROM (SELECT user_id, epoch_us(ts) // 3600000000 * 3600 AS start, count(*) AS n FROM events GROUP BY ALL) WHERE (start + 3600) * 1000000 <= {_MARK}",
    "t3_streaming_sessions": f"""WITH n AS (SELECT user_id, ts, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT user_id, min(t) AS start, count(*) AS n FROM g GROUP BY user_id, k HAVING max(t) + 21600000000 <= {_MARK}""",
    "t4_sliding_alarm": f"""WITH c AS (SELECT event_type, round(avg(value), 6) AS cut FROM events GROUP BY 1), k AS (SELECT user_id, epoch_us(ts) // 10800000000 * 10800 - o AS start FROM events JOIN c USING (event_type), (SELECT unnest([0, 10800]) AS o) WHERE value >= cut)
SELECT user_id, start, count(*) AS caught FROM k GROUP BY ALL HAVING count(*) >= 2 AND (start + 21600) * 1000000 <= {_MARK}""",
}
