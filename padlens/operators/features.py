"""Behavioural features of gestures, sessions and sensor windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from padlens.functions.quantiles import exact_quantiles

from padlens.operators.rows import is_correction


def correlation(a: str, b: str) -> Column:
    """Correlation, null where one side is flat."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def distance(dx: Column | str, dy: Column | str) -> Column:
    """Length of a step, to the last bit as SQL's square root of the squares has it; F.hypot is off by one in some rows, which turns means
    and percentiles that lie on a tie of the last digit, and which of two equally large deviations is the largest."""
    dx, dy = (F.col(c) if isinstance(c, str) else c for c in (dx, dy))
    return F.sqrt(dx * dx + dy * dy)


def coalesced(points: DataFrame, key: list[str]) -> DataFrame:
    """of a run of equal times the last row stays."""
    after = F.lead("t_ms").over(Window.partitionBy(*key).orderBy("t_ms", "source_row"))
    return points.withColumn("_after", after).filter("_after is null or _after <> t_ms").drop("_after")


def primitives(points: DataFrame, key: list[str]) -> DataFrame:
    """per segment dt (s), step, length, speed, and the change of speed over the later segment's dt."""
    order = Window.partitionBy(*key).orderBy("t_ms")
    back = lambda c: F.col(c) - F.lag(c).over(order)
    rows = coalesced(points, key).withColumns({"dt": back("t_ms") / 1000.0, "dx": back("x"), "dy": back("y")})
    rows = rows.withColumn("length", distance("dx", "dy")).withColumn("speed", F.col("length") / F.col("dt"))
    return rows.withColumn("accel", (F.col("speed") - F.lag("speed").over(order)) / F.col("dt"))


def _p(value: str, level: float) -> Column:
    return F.coalesce(F.percentile(value, F.lit(level)), F.lit(0.0))


def finger_features(points: DataFrame, key: list[str]) -> DataFrame:
    """the single-finger features of each gesture. Mean speed is length over duration; without movement efficiency is 0."""
    first = Window.partitionBy(*key).orderBy("t_ms")
    last = Window.partitionBy(*key).orderBy(F.desc("t_ms"))
    all_ = Window.partitionBy(*key).orderBy("t_ms").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = primitives(points, key).withColumns(
        {
            "x0": F.first("x").over(all_),
            "y0": F.first("y").over(all_),
            "x1": F.last("x").over(all_),
            "y1": F.last("y").over(all_),
            "_n": F.row_number().over(first),
            "_m": F.row_number().over(last),
        }
    )
    chord = distance(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    cross = (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0"))
    rows = rows.withColumn("dev", F.when(chord > 0, cross / chord).otherwise(0.0))
    moved = F.col("length") > 0
    rows = rows.withColumns(
        {
            "_cos": F.when(moved, F.col("dx") / F.col("length")),
            "_sin": F.when(moved, F.col("dy") / F.col("length")),
            "_late": F.when(F.col("_m") <= 3, F.col("speed")),
            "_early": F.when(F.col("_n").between(3, 7), F.col("accel")),
        }
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n_points"),
        (F.max("t_ms") - F.min("t_ms")).alias("duration_ms"),
        F.first("x0").alias("start_x"),
        F.first("y0").alias("start_y"),
        F.first("x1").alias("end_x"),
        F.first("y1").alias("end_y"),
        zero(F.sqrt(F.avg("_cos") ** 2 + F.avg("_sin") ** 2)).alias("resultant"),
        zero(F.when(F.avg("_cos") ** 2 + F.avg("_sin") ** 2 > 1e-18, F.atan2(F.avg("_sin"), F.avg("_cos")))).alias("mean_direction"),
        *[_p("speed", q / 100).alias(f"v{q}") for q in (20, 50, 80)],
        *[_p("accel", q / 100).alias(f"a{q}") for q in (20, 50, 80)],
        _p("_late", 0.5).alias("late_speed"),
        F.max_by("dev", F.struct(F.abs("dev"), -F.col("t_ms"))).alias("max_dev"),
        *[_p("dev", q / 100).alias(f"dev{q}") for q in (20, 50, 80)],
        zero(F.sum("length")).alias("length"),
        _p("_early", 0.5).alias("early_accel"),
    )
    dx, dy = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    return out.withColumns(
        {
            "displacement": distance(dx, dy),
            "direction": F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.atan2(dy, dx)),
            "efficiency": F.when(F.col("length") > 1e-12, distance(dx, dy) / F.col("length")).otherwise(0.0),
            "mean_speed": F.when(F.col("duration_ms") > 0, F.col("length") / (F.col("duration_ms") / 1000.0)).otherwise(0.0),
        }
    )


def typing_features(keys: DataFrame, pause_ms: int = 500) -> DataFrame:
    """counts, hold, flight, down-down times, bursts cut by pauses between downs, and ways between keys; 34 columns.

    keys(user_id, session_id, event_id, start_ms down, end_ms up or null, action token, x, y optional). A group whose
    input is missing is zero, as has_up and has_xy (every key has a place) tell.
    """
    key = ["user_id", "session_id"]
    order = Window.partitionBy(*key).orderBy("start_ms", "end_ms", "event_id")
    back = lambda c: F.col(c) - F.lag(c).over(order)
    has_xy = {"x", "y"} <= set(keys.columns)
    rows = keys.withColumns(
        {
            "hold": F.col("end_ms") - F.col("start_ms"),
            "flight": F.col("start_ms") - F.lag("end_ms").over(order),
            "step": back("start_ms"),
            "way": F.hypot(back("x"), back("y")) if has_xy else F.lit(None).cast("double"),
        }
    )
    rows = rows.withColumn("pause", F.col("step") > pause_ms)
    rows = rows.withColumn("burst", F.sum(F.when(F.col("pause"), 1).otherwise(0)).over(order))
    size = rows.groupBy(*key, "burst").agg(F.count("*").alias("_size")).groupBy(*key).agg(F.count("*").alias("bursts"), F.avg("_size").alias("burst_mean"), F.max("_size").alias("burst_max"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda c: zero(F.avg(c.cast("double")))

    def spread(value: str) -> list[Column]:
        return [*[_p(value, q / 100).alias(f"{value}{q}") for q in (20, 50, 80)], zero(F.avg(value)).alias(f"{value}_mean")]

    token = F.col("action")
    last = F.coalesce(F.max("end_ms"), F.max("start_ms"))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n_keys"),
        F.count(F.when(token.rlike(r"^\p{L}$"), 1)).alias("n_letters"),
        F.countDistinct(F.lower(token)).alias("n_unique"),
        share(is_correction(token)).alias("correction_ratio"),
        (last - F.min("start_ms")).alias("duration_ms"),
        *spread("hold"),
        zero(F.stddev_pop("hold")).alias("hold_std"),
        *spread("flight"),
        zero(F.stddev_pop("flight")).alias("flight_std"),
        share(F.col("flight") < 0).alias("overlap"),
        *spread("step"),
        zero(F.stddev_pop("step")).alias("step_std"),
        share(F.col("pause")).alias("pause_fraction"),
        *spread("way"),
        zero(F.sum("way")).alias("way_sum"),
        F.max(F.col("end_ms").isNotNull().cast("int")).alias("has_up"),
        ((F.count("x") == F.count("*")).cast("int") if has_xy else F.lit(0)).alias("has_xy"),
    )
    out = out.withColumn("unique_ratio", F.col("n_unique") / F.col("n_keys"))
    out = out.withColumn("key_rate", F.when(F.col("duration_ms") > 0, F.col("n_keys") / (F.col("duration_ms") / 1000.0)).otherwise(0.0))
    return out.join(size, key)


def kinematics(points: DataFrame, key: list[str]) -> DataFrame:
    """duration, path, displacement, efficiency, speeds, accelerations, time steps (ms), pressure and size; 15 columns.

    points(*key, t_ms, source_row, x, y, pressure, size). Without a segment the median step is the duration.
    """
    rows = primitives(points, key)
    order = Window.partitionBy(*key).orderBy("t_ms")
    mean_dt = (F.col("dt") + F.lag("dt").over(order)) / 2
    rows = rows.withColumn("acc", F.abs(F.col("speed") - F.lag("speed").over(order)) / mean_dt)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.groupBy(*key).agg(
        (F.max("t_ms") - F.min("t_ms")).alias("duration_ms"),
        zero(F.sum("length")).alias("path"),
        _p("speed", 0.95).alias("p95_speed"),
        zero(F.max("speed")).alias("max_speed"),
        zero(F.avg("acc")).alias("mean_accel"),
        zero(F.max("acc")).alias("max_accel"),
        (F.percentile("dt", F.lit(0.5)) * 1000).alias("_dt"),
        zero(F.try_divide(F.stddev_pop("dt"), F.avg("dt"))).alias("dt_cv"),
        F.hypot(F.max_by("x", "t_ms") - F.min_by("x", "t_ms"), F.max_by("y", "t_ms") - F.min_by("y", "t_ms")).alias("displacement"),
        *[f(c).alias(f"{c}_{n}") for c in ("pressure", "size") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))],
    )
    return out.withColumns(
        {
            "efficiency": F.when(F.col("path") > 1e-12, F.col("displacement") / F.col("path")).otherwise(1.0),
            "mean_speed": F.when(F.col("duration_ms") > 0, F.col("path") / (F.col("duration_ms") / 1000.0)).otherwise(0.0),
            "median_dt": F.coalesce("_dt", F.col("duration_ms").cast("double")),
        }
    ).drop("_dt")


def channel_statistics(windows: DataFrame) -> DataFrame:
    """per window mean, spread, extremes and quantiles."""
    return windows.groupBy("vec_id").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.percentile("v", F.lit(0.05)).alias("p5"), F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95"), F.count("*").alias("n"),
    )


def concatenated(windows: DataFrame, width: int = 16, hz: int = 100) -> DataFrame:
    """chunks of a window in order as one series with a new time axis."""
    order = Window.partitionBy("vec_id").orderBy("chunk", "j")
    chunks = windows.withColumn("chunk", F.floor(F.col("i") / width).cast("int")).withColumn("j", F.col("i") % width)
    return chunks.withColumn("t_ms", (F.row_number().over(order) - 1).cast("long") * (1000 // hz)).drop("i")


def lag_one_correlation(windows: DataFrame) -> DataFrame:
    """correlation of each window with itself one step back, null where it is flat; the median over windows by label."""
    order = Window.partitionBy("vec_id").orderBy("i")
    rows = windows.withColumn("back", F.lag("v").over(order)).filter("back is not null")
    each = rows.groupBy("label", "vec_id").agg(correlation("v", "back").alias("r"), F.stddev_pop("v").alias("s")).filter("s > 1e-9")
    return each.groupBy("label").agg(F.percentile("r", F.lit(0.5)).alias("r50"), F.count("*").alias("n"))


def window_summaries(windows: DataFrame) -> DataFrame:
    """F19, first part: mean, std, mean absolute step and range of each window."""
    order = Window.partitionBy("vec_id").orderBy("i")
    rows = windows.withColumn("step", F.abs(F.col("v") - F.lag("v").over(order)))
    return rows.groupBy("vec_id", "label").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("step"), (F.max("v") - F.min("v")).alias("range")
    )


def held(windows: DataFrame, width: int) -> DataFrame:
    """zero-order hold to `width` rows: source index floor(p (n - 1) + 0.5) for p on 0..1."""
    size = windows.groupBy("vec_id").agg(F.count("*").alias("n"))
    grid = size.select("vec_id", "n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    at = grid.withColumn("i", F.floor(F.col("k") / (width - 1) * (F.col("n") - 1) + 0.5).cast("int"))
    return at.join(windows.select("vec_id", "i", "v"), ["vec_id", "i"]).select("vec_id", "k", "v")


def linear(windows: DataFrame, width: int) -> DataFrame:
    """linear interpolation to `width` rows; a window of one row is constant."""
    size = windows.groupBy("vec_id").agg(F.count("*").alias("n"))
    grid = size.select("vec_id", "n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    place = grid.withColumn("p", F.col("k") * (F.col("n") - 1) / (width - 1)).withColumn("i", F.greatest(F.least(F.floor("p").cast("int"), (F.col("n") - 2).cast("int")), F.lit(0)))
    order = Window.partitionBy("vec_id").orderBy("i")
    pairs = windows.withColumn("next", F.lead("v").over(order)).select("vec_id", "i", "v", "next")
    return place.join(pairs, ["vec_id", "i"]).select("vec_id", "k", (F.col("v") + (F.col("p") - F.col("i")) * (F.coalesce("next", "v") - F.col("v"))).alias("v"))


def normaliser(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and spread from training rows alone (population form; a scale under 1e-8 is 1), applied to all."""
    fit = rows.filter("pool = 'train'").groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scale = F.when(F.col("_s") < 1e-8, 1.0).otherwise(F.col("_s"))
    return rows.join(fit, by).withColumn("z", (F.col(value) - F.col("_m")) / scale).drop("_m", "_s")


def duration_summary(rows: DataFrame, by: list[str], cap: float | None = None) -> DataFrame:
    """quantiles, mean and maximum of the durations by label, how far the medians are apart, the share of fakes at the cap
    or over it, and of genuine rows over it. The cap of a generator, or (None) the longest genuine duration."""
    real, fake = (F.when(F.col("label") == k, F.col("duration")) for k in (0, 1))
    limit = rows.groupBy(*by).agg((F.max(real) if cap is None else F.lit(cap)).alias("cap"))
    stats = rows.join(limit, by).groupBy(*by).agg(
        *[f(c).alias(f"{n}_{m}") for c, n in ((real, "real"), (fake, "fake")) for f, m in ((F.avg, "mean"), (F.max, "max"))],
        F.avg((fake >= F.col("cap")).cast("double")).alias("fake_at_cap"),
        F.avg((real > F.col("cap")).cast("double")).alias("real_over_cap"),
    )
    for k, n in ((0, "r"), (1, "f")):
        q = exact_quantiles(rows.filter(F.col("label") == k), by, "duration", [0.05, 0.5, 0.95]).withColumnRenamed("q", n)
        stats = stats.join(q, by, "left")
    return stats.select(
        *by, *[F.col(n)[i].alias(f"{m}_{q}") for n, m in (("r", "real"), ("f", "fake")) for i, q in enumerate(("p5", "p50", "p95"))],
        (F.col("f")[1] - F.col("r")[1]).alias("shift"), "fake_at_cap", "real_mean", "real_max", "fake_mean", "fake_max", "real_over_cap",
    )
