"""Session-level analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from padlens.functions.prefix import running_totals
from padlens.functions.quantiles import exact_quantiles
from padlens.functions.shared import written

KEY = ["user_id", "session_id"]


def gaps(events: DataFrame) -> DataFrame:
    """per event the gap to its predecessor's end in seconds, its duration, and its onset: gaps and durations before it,
    negative ones as 0."""
    order = Window.partitionBy(*KEY).orderBy("start_ms", "event_id")
    rows = events.withColumn("duration_s", (F.col("end_ms") - F.col("start_ms")) / 1000.0).withColumn("gap_s", (F.col("start_ms") - F.lag("end_ms").over(order)) / 1000.0)
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    gap, lasts = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in ("gap_s", "duration_s"))
    onset = F.sum(gap).over(until) + F.sum(lasts).over(until) - lasts
    return rows.withColumn("onset_s", onset)


def validity(events: DataFrame, least: int = 3, longest_s: float = 120.0) -> DataFrame:
    """Sessions kept have three events, two gaps, and every gap in [0, longest]; the others are named with counts."""
    rows = gaps(events).groupBy(*KEY).agg(
        F.count("*").alias("n_events"),
        F.count(F.when(F.col("gap_s") < 0, 1)).alias("negative"),
        F.count(F.when(F.col("gap_s") > longest_s, 1)).alias("long"),
        F.count(F.when(F.col("gap_s").between(0, longest_s), 1)).alias("usable"),
    )
    return rows.withColumn("kept", (F.col("n_events") >= least) & (F.col("negative") == 0) & (F.col("long") == 0) & (F.col("usable") >= 2))


def rhythm_features(events: DataFrame, cap_s: float = 30.0, bin_s: float = 3600.0) -> DataFrame:
    """19 features: gaps clipped to the cap (two of 0 if there are fewer), their logs and 12-bin entropy, onsets a time bin
    with empty bins counted, the last onset as duration, entropy of actions and of pairs, repeat rate (1 for a session of one event).

    The last onset falls into the last of ceil(duration / bin_s) bins; without duration occupancy is 0. What is counted by value (actions,
    pairs, cells of gaps, time bins) is counted together; the events, put in order once, are written.
    """
    rows = gaps(events).withColumn("g", F.when(F.col("gap_s").isNotNull(), F.least(F.greatest("gap_s", F.lit(0.0)), F.lit(cap_s))))
    order = Window.partitionBy(*KEY).orderBy("start_ms", "event_id")
    rows = rows.withColumn("prior", F.lag("action").over(order)).withColumn("cell", F.least(F.floor(F.col("g") * 12 / cap_s), F.lit(11)))
    rows = rows.withColumn("bins", F.greatest(F.ceil(F.max("onset_s").over(Window.partitionBy(*KEY)) / bin_s), F.lit(1)))
    rows = written(rows.select(*KEY, "action", "prior", "g", "cell", "onset_s", "bins"), "rhythm")
    enough = F.count("g") >= 2
    gap = lambda c: F.when(enough, c).otherwise(0.0)

    def q(p: float) -> Column:
        """Of the session's gaps in order, as percentile() has it, which takes far longer for many small groups."""
        at = (F.size("_g") - 1) * F.lit(p)
        low, high = (F.get("_g", f(at).cast("int")) for f in (F.floor, F.ceil))
        return F.when(F.size("_g") < 2, 0.0).when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    base = rows.groupBy(*KEY).agg(
        F.sort_array(F.collect_list("g")).alias("_g"),
        gap(F.avg("g")).alias("gap_mean"),
        gap(F.stddev_pop("g")).alias("gap_std"),
        gap(F.stddev_pop("g") / (F.avg("g") + 1e-9)).alias("gap_cv"),
        gap(F.min("g")).alias("gap_min"),
        gap(F.avg(F.log1p("g"))).alias("gap_log_mean"),
        gap(F.stddev_pop(F.log1p("g"))).alias("gap_log_std"),
        F.greatest(F.count("g"), F.lit(2)).alias("n_gaps"),
        F.max("onset_s").alias("duration_s"),
        F.coalesce(F.avg(F.when(F.col("prior").isNotNull(), (F.col("prior") == F.col("action")).cast("double"))), F.lit(1.0)).alias("repeat_rate"),
    )
    gaps_of = {"gap50": q(0.5), "gap10": q(0.1), "gap90": q(0.9)}
    names = ["gap50", "gap_mean", "gap_std", "gap_cv", "gap_min", "gap10", "gap90", "gap_log_mean", "gap_log_std", "n_gaps", "duration_s", "repeat_rate"]
    base = base.select(*KEY, *[gaps_of[n].alias(n) if n in gaps_of else n for n in names])
    place = F.least(F.floor(F.col("onset_s") / bin_s), F.col("bins") - 1)
    item = lambda kind, first=None, second=None, number=None: F.struct(
        F.lit(kind).alias("kind"), *[(F.lit(None) if c is None else F.col(c)).cast("string").alias(n) for n, c in (("first", first), ("second", second))], (F.lit(None) if number is None else number).cast("long").alias("number")
    )
    pair, step = F.when(F.col("prior").isNotNull(), item("entropy2", "prior", "action")), F.when(F.col("g").isNotNull(), item("gap_entropy", number=F.col("cell")))
    items = rows.select(*KEY, "bins", F.explode(F.array(item("occupied", number=place), item("entropy1", "action"), pair, step)).alias("s")).filter("s is not null")
    c = items.groupBy(*KEY, "bins", "s").agg(F.count("*").alias("c")).select(*KEY, "bins", "s.kind", "c")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    full = F.col("c")
    counted = c.groupBy(*KEY, "bins").agg(
        F.count(of("occupied", full)).alias("_full"), F.sum(of("occupied", full)).alias("_sum"), F.sum(of("occupied", full * full)).alias("_sq"), F.max(of("occupied", full)).alias("occ_max"),
        *[(F.log(F.sum(of(k, full))) - F.sum(of(k, full * F.log("c"))) / F.sum(of(k, full))).alias(k) for k in ("entropy1", "entropy2", "gap_entropy")],
    )
    mean = F.col("_sum") / F.col("bins")
    spread = F.sqrt(F.greatest(F.col("_sq") / F.col("bins") - mean**2, F.lit(0.0)))
    occupied = (1 - F.col("_full") / F.col("bins")).alias("occ_empty"), mean.alias("occ_mean"), spread.alias("occ_std"), F.col("occ_max").cast("double").alias("occ_max")
    out = base.join(counted.select(*KEY, *occupied, "entropy1", "entropy2", "gap_entropy"), KEY)
    out = out.fillna(0.0, ["entropy1", "entropy2", "gap_entropy"])
    return out.withColumns({c: F.when(F.col("duration_s") > 0, F.col(c)).otherwise(0.0) for c in ("occ_empty", "occ_mean", "occ_std", "occ_max")})


def at_cadence(events: DataFrame, gap: str) -> DataFrame:
    """events with start_ms and end_ms moved so that the gaps between them are those of the column `gap` (seconds, null for the first
    event): each event keeps its duration, the session its start."""
    order = Window.partitionBy(*KEY).orderBy("start_ms", "event_id")
    lasts = F.col("end_ms") - F.col("start_ms")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.min("start_ms").over(until) + F.sum(lasts).over(until) - lasts + F.sum(F.coalesce(F.round(F.col(gap) * 1000), F.lit(0.0)).cast("long")).over(until)
    return events.withColumns({"_start": start, "_lasts": lasts}).withColumns({"start_ms": F.col("_start"), "end_ms": F.col("_start") + F.col("_lasts")}).drop("_start", "_lasts")


def roster(events: DataFrame) -> DataFrame:
    """Sessions with their event and action counts, and how many users hold a session of that id."""
    each = events.groupBy("session_id", "user_id").agg(F.count("*").alias("n_events"), F.countDistinct("action").alias("n_actions"))
    return each.join(each.groupBy("session_id").agg(F.count("*").alias("n_owners")), "session_id")


def statistics(rows: DataFrame, cut: float) -> DataFrame:
    """Caught count, mean, max, mean of the top third, and sum of log odds. rows(user_id, session_id, label, score in 0..1, event_id)."""
    key = [*KEY, "label"]
    p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "event_id"))
    n = F.count("*").over(Window.partitionBy(*key))
    placed = rows.withColumn("top", rank <= F.ceil(n / 3))
    return placed.groupBy(*key).agg(
        F.count(F.when(F.col("score") >= cut, 1)).alias("s1_count"),
        F.avg("score").alias("s2_mean"),
        F.max("score").alias("s3_max"),
        F.avg(F.when(F.col("top"), F.col("score"))).alias("s4_top"),
        F.sum(F.log(p / (1 - p))).alias("s5_logodds"),
        F.count("*").alias("n_events"),
    )


def rank_statistic(rows: DataFrame) -> DataFrame:
    """N2's S5R: per session and label the sum of log odds of the scores' mid-ranks among all rows, as shares kept half a rank from
    0 and 1. rows as for `statistics`."""
    counts = rows.groupBy("score").agg(F.count("*").alias("c"))
    n = counts.agg(F.sum("c").alias("n"))
    share = (F.col("cum_c") - F.col("c") / 2) / F.col("n")
    kept = F.least(F.greatest(share, 0.5 / F.col("n")), 1 - 0.5 / F.col("n"))
    ranks = running_totals(counts, [], "score", ["c"]).crossJoin(F.broadcast(n)).select("score", F.log(kept / (1 - kept)).alias("odds"))
    return rows.join(written(ranks, "ranks"), "score").groupBy(*KEY, "label").agg(F.sum("odds").alias("s5r_ranklogodds"))


def genuine_cut(stats: DataFrame, value: str, alpha: float, by: list[str]) -> DataFrame:
    """With k = floor(alpha N), the k-th largest (from 0) genuine value; a session is flagged iff it lies above.

    Counted from distinct values, so no key's rows meet in one task; k >= N gives no row, which flags all.
    """
    counts = stats.filter("label = 0").groupBy(*by, value).agg(F.count("*").alias("c"))
    n = counts.groupBy(*by).agg(F.sum("c").alias("n")).withColumn("k", F.floor(F.lit(alpha) * F.col("n")))
    cum = running_totals(counts, by, value, ["c"]).join(F.broadcast(n), by) if by else running_totals(counts, by, value, ["c"]).crossJoin(F.broadcast(n))
    above = F.col("n") - F.col("cum_c")
    return cum.filter((above <= F.col("k")) & (F.col("k") < above + F.col("c"))).select(*by, F.col(value).alias("cut"), "n", "k")


def crossfit(stats: DataFrame, value: str, alpha: float) -> DataFrame:
    """The cut from one fold's genuine sessions judges the other fold; counts are pooled."""
    cuts = genuine_cut(stats, value, alpha, ["fold"]).select((1 - F.col("fold")).alias("fold"), "cut")
    judged = stats.join(F.broadcast(cuts), "fold", "left").withColumn("flag", F.coalesce((F.col(value) > F.col("cut")).cast("double"), F.lit(1.0)))
    return judged.agg(
        F.avg(F.when(F.col("label") == 1, F.col("flag"))).alias("caught"), F.avg(F.when(F.col("label") == 0, F.col("flag"))).alias("false_alarm"), F.count("*").alias("n")
    )


def roc(stats: DataFrame, value: str) -> DataFrame:
    """Caught and false-alarm share at every value v with flag iff >= v, and the points that flag all (v = -inf) and none (inf)."""
    counts = stats.groupBy(value).agg(F.count(F.when(F.col("label") == 0, 1)).alias("real"), F.count(F.when(F.col("label") == 1, 1)).alias("fake"))
    whole = counts.agg(F.sum("real").alias("n_real"), F.sum("fake").alias("n_fake"))
    cum = running_totals(counts, [], value, ["real", "fake"]).crossJoin(F.broadcast(whole))
    at = cum.select(
        F.col(value).cast("double").alias("v"),
        F.try_divide(F.col("n_fake") - F.col("cum_fake") + F.col("fake"), F.col("n_fake")).alias("caught"),
        F.try_divide(F.col("n_real") - F.col("cum_real") + F.col("real"), F.col("n_real")).alias("false_alarm"),
    )
    ends = stats.sparkSession.createDataFrame([(float("-inf"), 1.0, 1.0), (float("inf"), 0.0, 0.0)], at.schema)
    return at.unionByName(ends)


def price(points: DataFrame, targets: tuple[float, ...] = (0.5, 0.8, 0.95)) -> DataFrame:
    """Least false-alarm share that reaches each caught share."""
    return points.agg(*[F.min(F.when(F.col("caught") >= t, F.col("false_alarm"))).alias(f"price_{round(100 * t)}") for t in targets])


def count_rule(stats: DataFrame, most: int = 10) -> DataFrame:
    """For k = 1.., sessions flagged by at least k caught events."""
    ks = stats.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("k"))
    by_count = stats.groupBy("label", "s1_count").agg(F.count("*").alias("c"))
    flagged = by_count.crossJoin(F.broadcast(ks)).withColumn("f", F.when(F.col("s1_count") >= F.col("k"), F.col("c")).otherwise(0))
    share = lambda label: F.try_divide(F.sum(F.when(F.col("label") == label, F.col("f"))), F.sum(F.when(F.col("label") == label, F.col("c"))))
    return flagged.groupBy("k").agg(share(0).alias("false_alarm"), share(1).alias("caught"))


def ratio_edges(rows: DataFrame, value: str, n_quantiles: int = 41) -> DataFrame:
    """One row with `edges`: the pooled quantiles, each once, without the two ends; the median if none is left."""
    levels = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    found = exact_quantiles(rows, [], value, [*levels, 0.5])
    once = F.array_distinct(F.slice("q", 1, n_quantiles))
    inner = F.slice(once, 2, F.greatest(F.size(once) - 2, F.lit(0)))
    return found.select(F.when(F.size(inner) > 0, inner).otherwise(F.array(F.col("q")[n_quantiles])).alias("edges"))


def log_ratio(rows: DataFrame, value: str, n_quantiles: int = 41) -> DataFrame:
    """Log likelihood ratio of each bin between ratio_edges(), counts smoothed by one half."""
    edges = ratio_edges(rows, value, n_quantiles)
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(value))))
    counts = placed.groupBy("bin").agg(F.count(F.when(F.col("label") == 1, 1)).alias("f"), F.count(F.when(F.col("label") == 0, 1)).alias("g"))
    whole = counts.agg(F.sum("f").alias("nf"), F.sum("g").alias("ng")).crossJoin(F.broadcast(edges.select((F.size("edges") + 1).alias("b"))))
    share = lambda c, n: (F.col(c) + 0.5) / (F.col(n) + 0.5 * F.col("b"))
    return counts.crossJoin(F.broadcast(whole)).select("bin", F.log(share("f", "nf") / share("g", "ng")).alias("llr"), "f", "g")


def conformal(rows: DataFrame, value: str) -> DataFrame:
    """p = (1 + genuine values at or above) / (1 + genuine values)."""
    counts = rows.groupBy(value).agg(F.count(F.when(F.col("label") == 0, 1)).alias("c"))
    n = counts.agg(F.sum("c").alias("n"))
    cum = running_totals(counts, [], value, ["c"]).crossJoin(F.broadcast(n))
    return rows.join(cum.select(value, ((1 + F.col("n") - F.col("cum_c") + F.col("c")) / (1 + F.col("n"))).alias("p")), value)


def user_spread(flags: DataFrame, per_day: float = 6.0) -> DataFrame:
    """Spread of per-user false-alarm rates, pooled rate, and days between lockouts of the median and the p90 user (null:
    none). flags(user_id, flag)."""
    users = flags.groupBy("user_id").agg(F.avg("flag").alias("r"), F.sum("flag").alias("s"), F.count("*").alias("n"))
    out = users.agg(
        F.count("*").alias("n_users"), F.min("r").alias("low"), F.percentile("r", F.lit(0.5)).alias("median"), F.percentile("r", F.lit(0.9)).alias("p90"),
        F.max("r").alias("high"), (F.sum("s") / F.sum("n")).alias("pooled"),
    )
    days = lambda rate: F.when(F.col(rate) > 0, 1 / (F.col(rate) * per_day))
    return out.withColumn("days_median", days("median")).withColumn("days_p90", days("p90"))


def beta_binomial(flags: DataFrame) -> DataFrame:
    """Mean and overdispersion of per-user rates by moments, weighted by sessions, and the beta's two parameters (null
    where all or no sessions are flagged)."""
    users = flags.groupBy("user_id").agg(F.sum("flag").alias("s"), F.count("*").alias("n"))
    mean = F.sum("s") / F.sum("n")
    m = users.agg(mean.alias("mean"), (F.sum(F.col("s") * F.col("s") / F.col("n")) / F.sum("n") - mean * mean).alias("var"), F.avg("n").alias("size"))
    base = F.col("mean") * (1 - F.col("mean"))
    rho = F.least(F.greatest(F.try_divide(F.col("var") - base / F.col("size"), base * (1 - 1 / F.col("size"))), F.lit(1e-6)), F.lit(0.999))
    m = m.withColumn("rho", F.when(base > 0, rho))
    return m.select("mean", "rho", (F.col("mean") * (1 / F.col("rho") - 1)).alias("alpha"), ((1 - F.col("mean")) * (1 / F.col("rho") - 1)).alias("beta"))


def alarm_curve(rows: DataFrame, grid: list[float]) -> DataFrame:
    """Share of rows with p at or under each level, by label."""
    levels = F.explode(F.array(*map(F.lit, grid))).alias("alpha")
    counted = rows.groupBy("label", "p").agg(F.count("*").alias("c")).select("*", levels)
    return counted.groupBy("label", "alpha").agg((F.sum(F.when(F.col("p") <= F.col("alpha"), F.col("c")).otherwise(0)) / F.sum("c")).alias("share"))


def largest_cut(rows: DataFrame, cap: float, level: float = 0.9, ways: int = 32) -> DataFrame:
    """The largest observed p up to which the 90th percentile of users' rates of p <= cut stays within cap, and how many
    observed values that are; null and 0 if the least one fails.

    rows(user_id, p) of genuine sessions. Each user's rate never falls as the cut rises, so neither does their
    percentile, and a scan over the rising cuts would stop at the same place as this search: each pass tries `ways` cuts between the
    largest that is known to pass and the least that is known to fail, on counts by user and value.
    """
    counts = written(rows.groupBy("user_id", "p").agg(F.count("*").alias("c")), "counts")
    values = written(counts.select("p").filter("p is not null").distinct(), "values")
    passed = failed = None
    while True:
        within = values
        if passed is not None:
            within = within.filter(F.col("p") > passed)
        if failed is not None:
            within = within.filter(F.col("p") < failed)
        edges = within.agg(F.percentile_approx("p", F.array(*[F.lit((i + 1) / ways) for i in range(ways)]), F.lit(100 * ways)).alias("e")).first()["e"]
        if not edges:
            break
        cuts = sorted(set(edges))
        shares = [F.sum(F.when(F.col("p") <= c, F.col("c")).otherwise(0)) / F.sum("c") for c in cuts]
        users = counts.groupBy("user_id").agg(*[s.alias(f"r{i}") for i, s in enumerate(shares)])
        rates = users.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"r{i}").alias("r")) for i in range(len(cuts))])).alias("x")).select("x.i", "x.r")
        top = {r["i"]: r["q"][0] for r in exact_quantiles(rates, ["i"], "r", [level]).collect()}  # a row a cut
        good = [c for i, c in enumerate(cuts) if top[i] <= cap]
        bad = [c for i, c in enumerate(cuts) if top[i] > cap]
        passed = max(good, default=passed)
        failed = min(bad, default=failed)
    n = values.filter(F.lit(False) if passed is None else F.col("p") <= passed)
    return n.agg(F.lit(passed).cast("double").alias("cut"), F.count("*").alias("passed"))
