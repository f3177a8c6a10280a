"""Session-level summaries and report tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlens.functions.shared import written
from padlens.operators import replicates as V
from padlens.operators import sessions as N


def bindings(clusters: DataFrame, events: DataFrame, enrolled: DataFrame) -> DataFrame:
    """Cluster to event to the user's enrolled events in shot order; what finds no event is named unmapped.

    clusters(cluster_id, event_id), events(event_id, user_id), enrolled(user_id, shot, enrolled_id).
    """
    shots = enrolled.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("shot", "enrolled_id")))["enrolled_id"].alias("shots"))
    j = clusters.join(events.select("event_id", "user_id"), "event_id", "left").join(shots, "user_id", "left")
    return j.select("cluster_id", "event_id", "user_id", F.concat_ws(",", F.transform("shots", lambda x: x.cast("string"))).alias("shots"), F.col("user_id").isNull().alias("unmapped"))


def transfer(scores: DataFrame, frozen: DataFrame, cell: list[str]) -> DataFrame:
    """Fakes of any source accepted at cuts frozen elsewhere."""
    return scores.filter("label = 1").join(F.broadcast(frozen.select(*cell, F.col("frr5").alias("cut"))), cell).groupBy(*cell).agg(
        F.avg((F.col("score") < F.col("cut")).cast("double")).alias("far"), F.count("*").alias("n")
    )


def identity_relink(real: DataFrame, fake: DataFrame, identities: DataFrame, tolerance: float) -> DataFrame:
    """Genuine rows without an identity go; fakes must have one; durations must agree.

    real, fake(event_id, duration), identities(event_id, known_duration). Status: paired, dropped, missing or differs.
    """
    both = real.withColumn("fake", F.lit(False)).unionByName(fake.withColumn("fake", F.lit(True))).join(identities, "event_id", "left")
    gap = F.abs(F.col("duration") - F.col("known_duration"))
    status = F.when(F.col("known_duration").isNull(), F.when(F.col("fake"), "missing").otherwise("dropped")).when(gap > tolerance, "differs").otherwise("paired")
    return both.select("event_id", "fake", status.alias("status"))


def oracle_point(stats: DataFrame, value: str, alpha: float) -> DataFrame:
    """The cut from all genuine sessions judges all sessions; where k >= N there is no cut and all are flagged."""
    cut = N.genuine_cut(stats, value, alpha, []).select("cut")
    judged = stats.join(F.broadcast(cut), F.lit(True), "left").withColumn("flag", F.coalesce((F.col(value) > F.col("cut")).cast("double"), F.lit(1.0)))
    return judged.agg(F.avg(F.when(F.col("label") == 1, F.col("flag"))).alias("caught"), F.avg(F.when(F.col("label") == 0, F.col("flag"))).alias("false_alarm"))


def per_cell_mean(points: DataFrame, cell: list[str], target: float) -> DataFrame:
    """The mean of per-cell prices, and the price of the mean curve, under separate names.

    points(cell, level, caught, false_alarm) at levels that all cells share.
    """
    each = points.groupBy(*cell).agg(F.min(F.when(F.col("caught") >= target, F.col("false_alarm"))).alias("p")).agg(F.avg("p").alias("mean_of_prices"))
    macro = points.groupBy("level").agg(F.avg("caught").alias("caught"), F.avg("false_alarm").alias("false_alarm"))
    return each.crossJoin(macro.agg(F.min(F.when(F.col("caught") >= target, F.col("false_alarm"))).alias("price_of_mean")))


def duration_only(rows: DataFrame, alpha: float) -> DataFrame:
    """The confound control: log likelihood ratio of durations, summed by session, conformal p, share with p <= alpha.

    rows(user_id, session_id, label, score) where score is the duration.
    """
    placed = rows.crossJoin(F.broadcast(N.ratio_edges(rows, "score"))).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("score"))))
    summed = placed.join(F.broadcast(N.log_ratio(rows, "score").select("bin", "llr")), "bin").groupBy("user_id", "session_id", "label").agg(F.round(F.sum("llr"), 9).alias("s"))
    return N.conformal(summed, "s").groupBy("label").agg(F.avg((F.col("p") <= alpha).cast("double")).alias("flagged"), F.count("*").alias("n"))


def clustered_rate(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rate of a flag per replicate with whole users drawn. rows(user_id, flag), drawn(rep, user_id, mult) or `vector_draws`."""
    c = rows.groupBy("user_id").agg(F.sum("flag").alias("s"), F.count("*").alias("n")).withColumn("_all", F.lit(0))
    return V.replicate_sums(c, drawn, ["_all"], ["s", "n"]).select("rep", (F.col("s") / F.col("n")).alias("rate"))


def median_delta(users: DataFrame, drawn: DataFrame) -> DataFrame:
    """Median over drawn users of a per-user value. users(user_id, delta), drawn(rep, user_id, mult) or `vector_draws`.

    Buckets of neighbouring values tell which of them holds a replicate's middle ranks; only there are values read one by one.
    """
    placed = V.bucketed(users.filter("delta is not null").select("user_id", F.col("delta").cast("double").alias("delta"), F.lit(1).alias("c"), F.lit(0).alias("side")), [], "delta")
    totals = V.below(V.replicate_sums(placed, drawn, ["bucket"], ["c"]), ["rep"], ["c"])
    middle = (F.col("all_c") - 1) / 2
    ranks = totals.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(middle), F.ceil(middle)))))
    wanted = ranks.filter("c > 0 and rank >= below_c and rank < below_c + c").select("bucket", "rep", (F.col("rank") - F.col("below_c")).cast("long").alias("rank"))
    wanted = written(wanted, "wanted")
    rows, n = V.weighted_rows(placed.join(wanted.select("bucket").distinct(), "bucket", "left_semi"), drawn, ["bucket", "side", "delta"], "c")

    def one(table: pa.Table, wants: pa.Table) -> pa.Table:
        values, weight, _ = V.by_value(table, "delta", "side", n)
        upto = weight.cumsum(axis=0)
        found = [float(values[np.searchsorted(upto[:, rep], rank, side="right")]) for rep, rank in zip(wants["rep"].to_pylist(), wants["rank"].to_pylist())]
        return pa.table([wants["rep"], pa.array(found, pa.float64())], names=["rep", "v"])

    found = V.at_buckets(rows, wanted, ["bucket"], one, "rep int, v double")
    # With two ranks both weigh a half, as in Spark's percentile.
    return found.groupBy("rep").agg(F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(0.5 * F.min("v") + 0.5 * F.max("v")).alias("median"))


def binned_rates(rows: DataFrame, drawn: DataFrame, cut: float) -> DataFrame:
    """Accepted share per replicate, arm and bin from per-user counts. rows(arm, user_id, bin, score)."""
    c = rows.groupBy("arm", "bin", "user_id").agg(F.count(F.when(F.col("score") < cut, 1)).alias("a"), F.count("*").alias("n"))
    return V.replicate_sums(c, drawn, ["arm", "bin"], ["a", "n"]).select("arm", "bin", "rep", (F.col("a") / F.col("n")).alias("rate"))


def side_by_side(cells: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """A report table, one column for each of the stated values."""
    return cells.groupBy(row).pivot(column, values).agg(F.round(F.avg(value), 6))
