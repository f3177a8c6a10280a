"""Operating metrics, curves, thresholds and comparisons (E1-E25). A score is accepted iff it is under the cut; label 1 is fake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlens.functions.prefix import running_totals
from padlens.functions.quantiles import exact_quantiles


def _real(x: Column | None = None) -> Column:
    return F.when(F.col("label") == 0, F.lit(1) if x is None else x)


def _fake(x: Column | None = None) -> Column:
    return F.when(F.col("label") == 1, F.lit(1) if x is None else x)


def score_counts(scores: DataFrame, cell: list[str]) -> DataFrame:
    """Genuine and fake rows of each distinct score; pre-aggregated, so ties cost one row."""
    return scores.groupBy(*cell, "score").agg(F.count(_real()).alias("real"), F.count(_fake()).alias("fake"))


def curve(scores: DataFrame, cell: list[str]) -> DataFrame:
    """Every attainable cut with FA and FRR. Cuts are the least score, the midpoints of neighbours, and +inf.

    The totals of the cells, which are few, go to the rows, so that no cell's cuts meet in one task."""
    counts = score_counts(scores, cell)
    cum = running_totals(counts, cell, "score", ["real", "fake"], last="before")
    whole = cum.groupBy(*cell).agg(F.sum("real").alias("n_real"), F.sum("fake").alias("n_fake"))
    at = cum.join(F.broadcast(whole), cell).select(
        *cell,
        F.when(F.col("before").isNull(), F.col("score")).otherwise(F.col("before") + 0.5 * (F.col("score") - F.col("before"))).alias("cut"),
        (F.col("cum_fake") - F.col("fake")).alias("accepted"),
        (F.col("n_real") - (F.col("cum_real") - F.col("real"))).alias("rejected"),
        "n_real",
        "n_fake",
    )
    top = whole.select(*cell, F.lit(float("inf")).alias("cut"), F.col("n_fake").alias("accepted"), F.lit(0).cast("long").alias("rejected"), "n_real", "n_fake")
    return at.unionByName(top).withColumn("fa", F.when(F.col("n_fake") > 0, F.col("accepted") / F.col("n_fake"))).withColumn(
        "frr", F.when(F.col("n_real") > 0, F.col("rejected") / F.col("n_real"))
    )


def select_cuts(val: DataFrame, cell: list[str], target: float = 0.05) -> DataFrame:
    """E5: the EER cut and the cut for a genuine rejection of at most `target`, from validation rows alone."""
    points = curve(val, cell)
    best = points.groupBy(*cell).agg(
        F.min(F.struct(F.abs(F.col("fa") - F.col("frr")).alias("gap"), F.greatest("fa", "frr").alias("worst"), F.col("cut"), F.col("fa"), F.col("frr"))).alias("e"),
        F.min(F.when(F.col("frr") <= target + 1e-15, F.struct(F.col("fa"), (-F.col("frr")).alias("minus"), F.col("cut")))).alias("b"),
    )
    return best.filter("b is not null").select(
        *cell, F.col("e.cut").alias("eer"), ((F.col("e.fa") + F.col("e.frr")) / 2).alias("eer_rate"), F.col("b.cut").alias("frr5"), F.col("b.fa").alias("val_fa"), (-F.col("b.minus")).alias("val_frr")
    )


def at_cut(scores: DataFrame, cuts: DataFrame, cell: list[str], cut: str) -> DataFrame:
    """FAR and FRR at a frozen cut. A cell without one of the classes has null there, never zero."""
    joined = scores.join(F.broadcast(cuts.select(*cell, F.col(cut).alias("cut"))), cell)
    return joined.groupBy(*cell).agg(
        F.avg(_fake((F.col("score") < F.col("cut")).cast("double"))).alias("far"),
        F.avg(_real((F.col("score") >= F.col("cut")).cast("double"))).alias("frr"),
        F.count(_real()).alias("n_real"),
        F.count(_fake()).alias("n_fake"),
    )


def auc(scores: DataFrame, cell: list[str]) -> DataFrame:
    """The chance that a fake scores higher than a genuine row, ties half."""
    cum = running_totals(score_counts(scores, cell), cell, "score", ["real"])
    wins = F.sum(F.col("fake") * (F.col("cum_real") - F.col("real") + F.col("real") / 2))
    return cum.groupBy(*cell).agg(
        F.when((F.sum("real") > 0) & (F.sum("fake") > 0), wins / (F.sum("real") * F.sum("fake"))).alias("auc"),
        F.sum("real").alias("n_real"),
        F.sum("fake").alias("n_fake"),
    )


def test_eer(scores: DataFrame, cell: list[str]) -> DataFrame:
    """Where FAR and FRR are nearest among cuts at observed scores; the first of equal gaps."""
    points = curve_at_scores(scores, cell)
    best = points.groupBy(*cell).agg(F.min(F.struct(F.abs(F.col("fa") - F.col("frr")).alias("gap"), F.col("score"), F.col("fa"), F.col("frr"))).alias("b"))
    return best.select(*cell, F.col("b.score").alias("cut"), ((F.col("b.fa") + F.col("b.frr")) / 2).alias("eer"))


def curve_at_scores(scores: DataFrame, cell: list[str]) -> DataFrame:
    counts = score_counts(scores, cell)
    cum = running_totals(counts, cell, "score", ["real", "fake"])
    cum = cum.join(cum.groupBy(*cell).agg(F.sum("real").alias("n_real"), F.sum("fake").alias("n_fake")), cell)
    return cum.select(
        *cell,
        "score",
        F.try_divide(F.col("cum_fake") - F.col("fake"), F.col("n_fake")).alias("fa"),
        F.try_divide(F.col("n_real") - F.col("cum_real") + F.col("real"), F.col("n_real")).alias("frr"),
    )


def grid_summary(cells: DataFrame, value: str, by: list[str], high: float = 0.6) -> DataFrame:
    """Count, mean, median and cells at or over `high`, for every grouping of `by` from one pass (cube)."""
    return cells.cube(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.sum((F.col(value) >= high).cast("long")).alias("n_high"),
    )


def paired_delta(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Over shared cells, the mean and median of left minus right, and how often left is higher."""
    joined = left.select(*on, F.col(value).alias("_a")).join(right.select(*on, F.col(value).alias("_b")), on)
    gap = F.col("_a") - F.col("_b")
    return joined.agg(
        F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.percentile(gap, F.lit(0.5)).alias("median_gap"), F.sum((gap > 0).cast("long")).alias("wins")
    )


def macro(cells: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Plain means over cells."""
    return cells.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_cells"))


def long_results(cells: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each cell and operating point."""
    return cells.unpivot(keys, values, "point", "value")


def duration_cuts(train: DataFrame, levels: list[float]) -> DataFrame:
    """Distinct quantile cuts of the training durations, as one row with an array."""
    return exact_quantiles(train, [], "duration", levels).select(F.array_sort(F.array_distinct("q")).alias("cuts"))


def bin_right(x: Column, cuts: Column) -> Column:
    """The bin of x; a value equal to a cut goes to the upper bin."""
    return F.size(F.filter(cuts, lambda c: c <= x))


def duration_metrics(rows: DataFrame, cuts: DataFrame, cut: float) -> DataFrame:
    """FA, FRR and AUC (null without one of the classes) in each duration bin at a global cut; bins without rows are listed too."""
    listed = cuts.select(F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("bin"))
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("bin", bin_right(F.col("duration"), F.col("cuts")))
    found = placed.groupBy("bin").agg(
        F.avg(_fake((F.col("score") < cut).cast("double"))).alias("fa"),
        F.avg(_real((F.col("score") >= cut).cast("double"))).alias("frr"),
        F.count(_real()).alias("n_real"),
        F.count(_fake()).alias("n_fake"),
    )
    return listed.join(found, "bin", "left").join(auc(placed, ["bin"]).select("bin", "auc"), "bin", "left").fillna(0, ["n_real", "n_fake"])


def standardised_rate(rows: DataFrame, cuts: DataFrame, cut: float, reference: str) -> DataFrame:
    """Each arm's acceptance rate with the duration bins weighted as in the reference arm; empty bins are skipped."""
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("bin", bin_right(F.col("duration"), F.col("cuts")))
    rate = placed.groupBy("arm", "bin").agg(F.avg((F.col("score") < cut).cast("double")).alias("rate"))
    weight = placed.filter(F.col("arm") == reference).groupBy("bin").agg(F.count("*").alias("w"))
    return rate.join(F.broadcast(weight), "bin").groupBy("arm").agg((F.sum(F.col("w") * F.col("rate")) / F.sum("w")).alias("rate"), F.count("*").alias("n_bins"))


def ks(scores: DataFrame, cell: list[str]) -> DataFrame:
    """The greatest gap between the distributions of the two classes."""
    counts = score_counts(scores, cell)
    cum = running_totals(counts, cell, "score", ["real", "fake"])
    cum = cum.join(cum.groupBy(*cell).agg(F.sum("real").alias("n_real"), F.sum("fake").alias("n_fake")), cell)
    return cum.groupBy(*cell).agg(F.max(F.abs(F.try_divide("cum_real", "n_real") - F.try_divide("cum_fake", "n_fake"))).alias("ks"))


#: Levels of E17.
LADDER = [0.0, 0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0]


def quantile_ladder(rows: DataFrame, by: list[str], value: str, levels: list[float] = LADDER) -> DataFrame:
    """Quantiles at all levels, one row each."""
    return exact_quantiles(rows, by, value, levels).select(*by, F.posexplode("q").alias("step", "value"))


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, 95th percentile and maximum of latencies, and whether the last three rise in this order (`monotone`)."""
    q = exact_quantiles(rows, by, value, [0.5, 0.95, 1.0])
    mean = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    p = [F.col("q")[i] for i in range(3)]
    return mean.join(q, by).select(*by, "n", "mean", *[c.alias(n) for c, n in zip(p, ("p50", "p95", "max"))], ((p[0] <= p[1]) & (p[1] <= p[2])).alias("monotone"))


def real_fake_comparison(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of fakes outside the 0.1-99.9 % range of genuine training rows, distance of medians over their quartile range
    (at least 1 % of their median), and the ratio of the 99th percentiles (null where theirs is 0). rows(*by, label, pool, value)."""
    real = exact_quantiles(rows.filter("label = 0 and pool = 'train'"), by, value, [0.001, 0.25, 0.5, 0.75, 0.99, 0.999]).withColumnRenamed("q", "r")
    beyond = (F.col(value) < F.col("r")[0]) | (F.col(value) > F.col("r")[5])
    fakes = rows.filter("label = 1")
    share = fakes.join(real, by).groupBy(*by).agg(F.avg(beyond.cast("double")).alias("outside"))
    fake = exact_quantiles(fakes, by, value, [0.5, 0.99]).withColumnRenamed("q", "f").join(share, by)
    return fake.join(real, by).select(
        *by,
        "outside",
        (F.abs(F.col("f")[0] - F.col("r")[2]) / F.greatest(F.col("r")[3] - F.col("r")[1], F.abs(F.col("r")[2]) * 0.01, F.lit(1e-9))).alias("distance"),
        F.when(F.abs(F.col("r")[4]) > 1e-12, F.col("f")[1] / F.col("r")[4]).alias("ratio99"),
    )


def plausibility(compared: DataFrame, outside: float = 0.2, distance: float = 8.0, ratio: tuple[float, float] = (0.05, 20.0)) -> DataFrame:
    """The comparisons that break a limit, with the limit's name."""
    broken = F.filter(
        F.array(
            F.when(F.col("outside") > outside, F.lit("outside")),
            F.when(F.col("distance") > distance, F.lit("distance")),
            F.when(~F.col("ratio99").between(*ratio), F.lit("ratio99")),
        ),
        lambda x: x.isNotNull(),
    )
    return compared.withColumn("rule", F.explode(broken))


def outside_unit(scores: DataFrame, by: list[str]) -> DataFrame:
    """Share of scores outside (0, 1)."""
    return scores.groupBy(*by).agg(F.avg((~((F.col("score") > 0) & (F.col("score") < 1))).cast("double")).alias("outside"), F.count("*").alias("n"))


def reconcile(left: DataFrame, right: DataFrame, on: list[str], value: str, tolerance: float = 0.005) -> DataFrame:
    """One quantity from two sources, the difference and its cause."""
    joined = left.select(*on, F.col(value).alias("left_value")).join(right.select(*on, F.col(value).alias("right_value")), on, "full_outer")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    cause = F.when(F.col("left_value").isNull(), "only_right").when(F.col("right_value").isNull(), "only_left").when(gap > tolerance, "differs").otherwise("agrees")
    return joined.withColumn("gap", gap).withColumn("cause", cause)


def reference_box(rows: DataFrame, reference: DataFrame, by: list[str], value: str) -> DataFrame:
    """Min-max scaling on the reference set, not clipped."""
    box = reference.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return rows.join(box, by).withColumn("scaled", (F.col(value) - F.col("_lo")) / span).drop("_lo", "_hi")
