"""Pinch, cross-modal, style, coverage and reporting operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from padlens.functions.prefix import running_totals
from padlens.operators.features import correlation, distance, finger_features
from padlens.operators.joins import nearest


def unwrapped(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """rows(span, angle or null where the span is 0) with `turned`: angles from the first valid one on, each step taken to within
    half a turn; between valid frames linear in the frame's number, before and after them the nearest; 0 without any."""
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    step = F.col("angle") - F.last("angle", ignorenulls=True).over(back)
    folded = step - 2 * F.pi() * F.floor((step + F.pi()) / (2 * F.pi()))
    turn = F.when((folded == -F.pi()) & (step > 0), F.pi()).otherwise(folded)
    rows = rows.withColumn("_i", F.row_number().over(order)).withColumn("_turn", F.when(F.col("angle").isNotNull(), F.coalesce(turn, F.col("angle"))))
    valid = F.when(F.col("angle").isNotNull(), F.struct(F.col("_i").alias("i"), F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("u")))
    rows = rows.withColumn("_own", valid)
    rows = rows.withColumn("_a", F.last("_own", ignorenulls=True).over(back)).withColumn("_b", F.first("_own", ignorenulls=True).over(ahead))
    between = F.col("_a.u") + (F.col("_b.u") - F.col("_a.u")) * (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    return rows.withColumn("turned", F.coalesce("_own.u", between, "_a.u", "_b.u", F.lit(0.0))).drop("_i", "_turn", "_own", "_a", "_b")


def pinch_features(frames: DataFrame) -> DataFrame:
    """the 24 single-finger features of the fingers' midpoint (`center_`), and span, its rate, unwrapped angle, angular speed
    and finger paths of two-pointer events; also the mean rate, the median speed and the number of frames.

    frames(event, t_ms, x0, y0, x1, y1), one row for each time at which both pointers touch.
    """
    order = Window.partitionBy("event").orderBy("t_ms")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = frames.withColumn("span", distance(dx, dy)).withColumn("angle", F.when(F.col("span") > 1e-12, F.atan2(dy, dx)))
    back = lambda c: F.col(c) - F.lag(c).over(order)
    rows = unwrapped(rows, order).withColumns(
        {
            "dt": back("t_ms") / 1000.0,
            "dspan": back("span"),
            "turn": back("turned"),
            "len0": distance(back("x0"), back("y0")),
            "len1": distance(back("x1"), back("y1")),
            "lenc": distance(*[(F.col(f"{c}0") + F.col(f"{c}1") - F.lag(f"{c}0").over(order) - F.lag(f"{c}1").over(order)) / 2 for c in "xy"]),
        }
    )
    rows = rows.withColumns({"rate": F.col("dspan") / F.col("dt"), "spin": F.col("turn") / F.col("dt"), "speed0": F.col("len0") / F.col("dt"), "speed1": F.col("len1") / F.col("dt")})
    z = lambda c: F.coalesce(c, F.lit(0.0))
    q = lambda c, k: z(F.percentile(c, F.lit(k / 100)))
    corr = F.when((F.count("speed0") >= 2) & (F.stddev_pop("speed0") > 1e-12) & (F.stddev_pop("speed1") > 1e-12), correlation("speed0", "speed1"))
    out = rows.groupBy("event").agg(
        F.count("*").alias("n_frames"),
        F.min_by("span", "t_ms").alias("span_first"),
        F.max_by("span", "t_ms").alias("span_last"),
        F.min("span").alias("span_min"),
        F.max("span").alias("span_max"),
        F.avg("span").alias("span_mean"),
        F.stddev_pop("span").alias("span_std"),
        z(F.sum(F.abs("dspan"))).alias("span_path"),
        z(F.avg("rate")).alias("span_rate"),
        *[q("rate", k).alias(f"span_rate{k}") for k in (20, 50, 80)],
        z(F.avg(F.abs("rate"))).alias("span_rate_abs"),
        z(F.percentile(F.abs("rate"), F.lit(0.5))).alias("span_speed50"),
        F.min_by("turned", "t_ms").alias("angle_first"),
        F.max_by("turned", "t_ms").alias("angle_last"),
        z(F.sum("turn")).alias("angle_total"),
        z(F.sum(F.abs("turn"))).alias("angle_path"),
        *[q("spin", k).alias(f"angular{k}") for k in (20, 50, 80)],
        z(F.avg(F.abs("spin"))).alias("angular_speed"),
        z(F.sum("len0")).alias("length0"),
        z(F.sum("len1")).alias("length1"),
        z(F.sum("lenc")).alias("length_centre"),
        z(F.when(F.abs(corr) > 1, F.signum(corr)).otherwise(corr)).alias("speed_corr"),
    )
    longer, delta = F.greatest("length0", "length1"), F.col("span_last") - F.col("span_first")
    out = out.withColumns({"length_ratio": F.when(longer > 1e-12, F.least("length0", "length1") / longer).otherwise(0.0), "span_delta": delta, "span_delta_abs": F.abs(delta)})
    middle = frames.select("event", "t_ms", F.lit(0).alias("source_row"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    centre = finger_features(middle, ["event"])
    return out.join(centre.select("event", *[F.col(c).alias(f"center_{c}") for c in centre.columns if c not in ("event", "n_points")]), "event")


def centre_speed(rows: DataFrame) -> DataFrame:
    """F8: speed of the mean of the pointers in contact, valid where time moves. rows(event, t_ms, x, y)."""
    order = Window.partitionBy("event").orderBy("t_ms")
    mean = rows.groupBy("event", "t_ms").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    dt = (F.col("t_ms") - F.lag("t_ms").over(order)) / 1000.0
    speed = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)) / dt
    return mean.withColumn("speed", F.when(dt > 0, speed)).withColumn("mid_ms", F.col("t_ms") - dt * 500.0)


def consistency(touch: DataFrame, sensor: DataFrame) -> DataFrame:
    """how far touch speed and sensor motion go together: path, mean speed, motion, correlation, lag of the peaks.

    touch(event, t_ms, x, y), sensor(event, t_ms, v, sample_id). The speed is interpolated at the sensor's times.
    """
    speed = centre_speed(touch)
    at = nearest(speed.filter("speed is not null").select("event", F.col("mid_ms").alias("t"), F.col("speed").alias("v")), sensor.select("event", F.col("t_ms").cast("double").alias("t"), "sample_id"), ["event"])
    order = Window.partitionBy("event").orderBy("t_ms", "sample_id")
    step = sensor.withColumn("step", F.abs(F.col("v") - F.lag("v").over(order))).filter("step is not null").select("event", "sample_id", "step", "t_ms")
    both = at.select("event", "sample_id", F.col("v").alias("speed")).join(step, ["event", "sample_id"])
    flat = (F.count("*") < 3) | (F.stddev_pop("speed") < 1e-12) | (F.stddev_pop("step") < 1e-12)
    joined = both.groupBy("event").agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("motion_rms"),
        F.when(flat, 0.0).otherwise(F.coalesce(correlation("speed", "step"), F.lit(0.0))).alias("corr"),
        (F.max_by("t_ms", F.struct("step", -F.col("t_ms"))) - F.max_by("t_ms", F.struct("speed", -F.col("t_ms")))).alias("peak_lag_ms"),
    )
    return joined.join(speed.groupBy("event").agg(F.avg("speed").alias("mean_speed"), F.count("*").alias("n_frames")), "event")


def style_distances(rows: DataFrame, names: list[str], others: int = 2000, each: int = 4) -> DataFrame:
    """Per user the median distances to the user's genuine centroid of the fakes (`fake_own`), of the own genuine rows (`real_own`)
    and of other users' genuine rows (`others_own`), that of the own later sessions' rows to the centroid of the earlier half of
    sessions (`sessions_own`, null with one session), the delta others_own - fake_own, and whether the chain
    sessions_own <= fake_own < others_own holds.

    rows(event_id, user_id, session_id, label, pool, *names). Columns are standardised by the train pool's genuine rows. Other
    users are a stated set, so that no pair of all events is formed: of each user `each` rows of least hash, of these
    the `others` of least hash; every user meets that set but for the own rows.
    """
    real = F.col("label") == 0
    fit = rows.filter(real & (F.col("pool") == "train"))
    m = fit.agg(*[F.avg(n).alias(f"_m{n}") for n in names], *[(F.stddev_pop(n) + 1e-9).alias(f"_s{n}") for n in names])
    z = rows.crossJoin(F.broadcast(m)).select("event_id", "user_id", "session_id", "label", *[((F.col(n) - F.col(f"_m{n}")) / F.col(f"_s{n}")).alias(n) for n in names])
    away = lambda p: F.sqrt(sum(((F.col(n) - F.col(f"{p}{n}")) ** 2 for n in names), F.lit(0.0)))
    middle = lambda df, p: df.groupBy("user_id").agg(*[F.avg(n).alias(f"{p}{n}") for n in names])
    median = lambda c: F.percentile(c, F.lit(0.5))
    genuine = z.filter(real)
    centre = middle(genuine, "c")
    own = z.join(centre, "user_id").groupBy("user_id").agg(*[median(F.when(F.col("label") == k, away("c"))).alias(n) for k, n in ((1, "fake_own"), (0, "real_own"))])
    sessions = genuine.select("user_id", "session_id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("session_id")))
    sessions = sessions.withColumn("_early", F.col("_r") <= F.floor(F.count("*").over(Window.partitionBy("user_id")) / 2)).drop("_r")
    placed = genuine.join(sessions, ["user_id", "session_id"])
    later = placed.filter(~F.col("_early")).join(middle(placed.filter("_early"), "e"), "user_id").groupBy("user_id").agg(median(away("e")).alias("sessions_own"))
    hashed = F.sha2(F.col("event_id").cast("string"), 256)
    few = genuine.withColumn("_h", hashed).withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy("_h"))).filter(F.col("_k") <= each)
    few = few.orderBy("_h").limit(others).select(F.col("user_id").alias("_other"), *names)
    foreign = centre.join(F.broadcast(few), F.col("user_id") != F.col("_other")).groupBy("user_id").agg(median(away("c")).alias("others_own"))
    out = own.join(later, "user_id", "left").join(foreign, "user_id", "left")
    chain = (F.col("sessions_own") <= F.col("fake_own")) & (F.col("fake_own") < F.col("others_own"))
    return out.withColumn("delta", F.col("others_own") - F.col("fake_own")).withColumn("chain", F.coalesce(chain, F.lit(False)).cast("int"))


def style_summary(distances: DataFrame) -> DataFrame:
    """Over users with fakes their number, the share of positive deltas and of chains that hold, and the median of each distance."""
    kinds = ["fake_own", "sessions_own", "others_own", "delta"]
    held = distances.filter("delta is not null")
    return held.agg(F.count("*").alias("users"), F.avg((F.col("delta") > 0).cast("double")).alias("share_positive"), F.avg("chain").alias("share_chain"), *[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in kinds])


def reference_overlap(first: DataFrame, second: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the sizes of the intersection and the union of two sets of references (a handful a group)."""
    a = first.groupBy(*by).agg(F.collect_set(value).alias("a"))
    b = second.groupBy(*by).agg(F.collect_set(value).alias("b"))
    e = F.array().cast("array<long>")
    j = a.join(b, by, "full_outer").select(*by, F.coalesce("a", e).alias("a"), F.coalesce("b", e).alias("b"))
    return j.select(*by, F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("either"))


def overlap_histogram(overlap: DataFrame) -> DataFrame:
    """How many groups share how many references, with the mean union of those groups."""
    return overlap.groupBy("shared").agg(F.count("*").alias("groups"), F.avg("either").alias("mean_either"))


def coverage_status(cells: DataFrame, owned: DataFrame, fakes: DataFrame, scored: DataFrame, on: list[str]) -> DataFrame:
    """Scored, declined (owned, fakes exist, none swapped), missing (owned, no scores) or not_owned; never a zero."""
    j = cells
    for name, df in (("owned", owned), ("fakes", fakes), ("scored", scored)):
        j = j.join(df.select(*on).distinct().withColumn(f"_{name}", F.lit(True)), on, "left")
    status = F.when(F.col("_scored"), "scored").when(F.col("_owned").isNull(), "not_owned").when(F.col("_fakes"), "declined").otherwise("missing")
    return j.select(*on, status.alias("status"))


def covered(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Cells whose modality the method changed; joint needs both channels. flags(method, touch, sensor)."""
    fits = F.when(F.col("modality") == "trajectory", F.col("touch")).when(F.col("modality") == "imu", F.col("sensor")).otherwise(F.col("touch") & F.col("sensor"))
    return scores.join(F.broadcast(flags), "method").filter(fits).drop("touch", "sensor")


def corpus_profile(rows: DataFrame) -> DataFrame:
    """events, users and values by action and split, with subtotals. rows(action, pool, user_id, event_id, score)."""
    return rows.rollup("action", "pool").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean")
    )


def background(samples: DataFrame, touches: DataFrame, within_ms: int, width_ms: int, least: int) -> DataFrame:
    """F16: share of sensor samples between gestures, spread during and between, and spread over fixed windows.

    samples(user_id, t, v, sample_id), touches(user_id, t, v).
    """
    near = nearest(touches, samples, ["user_id"]).select("sample_id", F.coalesce(F.col("distance") <= within_ms, F.lit(False)).alias("during"))
    rows = samples.join(near, "sample_id").withColumn("w", F.floor(F.col("t") / width_ms))
    total = rows.groupBy("user_id").agg(
        F.avg((~F.col("during")).cast("double")).alias("between_share"),
        F.stddev_pop(F.when(F.col("during"), F.col("v"))).alias("std_during"),
        F.stddev_pop(F.when(~F.col("during"), F.col("v"))).alias("std_between"),
    )
    wins = rows.groupBy("user_id", "w").agg(F.stddev_pop("v").alias("s"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return total.join(wins.groupBy("user_id").agg(F.percentile("s", F.lit(0.5)).alias("window50"), F.percentile("s", F.lit(0.05)).alias("window5"), F.count("*").alias("windows")), "user_id", "left")


def disjoint_price(stats: DataFrame, value: str, targets: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Over every attainable calibration target, the least cross-fitted false alarm that reaches each caught share.

    stats(fold, label, value). For a target q the cut is the k-th largest (from 0) genuine value of the other fold with
    k = floor(q n), and none, which flags all, for k = n. So a session is flagged from q = (genuine values of the other fold
    at or above its own) / n on; both shares rise with q, and running sums over q give them for all targets at once.
    """
    counts = stats.groupBy("fold", value).agg(F.count(F.when(F.col("label") == 0, 1)).alias("real"), F.count(F.when(F.col("label") == 1, 1)).alias("fake"))
    both = counts.select(F.lit(0).alias("side"), "fold", value, "real", "fake").unionByName(counts.select(F.lit(1).alias("side"), (1 - F.col("fold")).alias("fold"), value, "real", "fake"))
    each = both.groupBy("fold", value).agg(
        F.sum(F.when(F.col("side") == 0, F.col("real")).otherwise(0)).alias("c"), *[F.sum(F.when(F.col("side") == 1, F.col(x)).otherwise(0)).alias(x) for x in ("real", "fake")]
    )  # of each calibrating fold: its genuine sessions, and the other fold's sessions of the same value
    n = each.groupBy("fold").agg(F.sum("c").alias("n"))
    cum = running_totals(each, ["fold"], value, ["c"]).join(F.broadcast(n), "fold")
    steps = cum.select(((F.col("n") - F.col("cum_c") + F.col("c")) / F.col("n")).alias("q"), "real", "fake").groupBy("q").agg(F.sum("real").alias("real"), F.sum("fake").alias("fake"))
    whole = steps.agg(F.sum("real").alias("n_real"), F.sum("fake").alias("n_fake"))
    points = running_totals(steps, [], "q", ["real", "fake"]).crossJoin(F.broadcast(whole))
    caught, alarm = F.col("cum_fake") / F.col("n_fake"), F.col("cum_real") / F.col("n_real")
    return points.agg(*[F.min(F.when(caught >= t - 1e-12, alarm)).alias(f"price_{round(100 * t)}") for t in targets])


def energy_distance(rows: DataFrame, queries: DataFrame, names: list[str], first: str, second: str, block_rows: int = 20_000) -> DataFrame:
    """F19, second part: 2 E|X-Y| - E|X-X'| - E|Y-Y'| over window summaries of two sides, each scaled by its pooled spread.

    rows(side, *names). Each mean is over the pairs of a stated query set with all rows; with queries = rows it is over all
    pairs. The query set goes to the tasks in blocks, so that a broadcast has at most about block_rows short rows.
    """
    scale = rows.agg(*[(F.stddev_pop(n) + 1e-9).alias(f"_{n}") for n in names])
    a = rows.select(F.col("side").alias("s"), *[F.col(n).alias(f"a{n}") for n in names])
    b = queries.crossJoin(F.broadcast(scale)).select(F.col("side").alias("t"), *[F.col(n).alias(f"b{n}") for n in names], *[f"_{n}" for n in names])
    d = F.sqrt(sum((((F.col(f"a{n}") - F.col(f"b{n}")) / F.col(f"_{n}")) ** 2 for n in names), F.lit(0.0)))
    blocks, parts = max(1, -(-queries.count() // block_rows)), []
    for k in range(blocks):
        part = b.filter(F.pmod(F.xxhash64(*[f"b{n}" for n in names]), F.lit(blocks)) == k)
        parts.append(a.join(F.broadcast(part), F.lit(True)).groupBy("s", "t").agg(F.sum(d).alias("d"), F.count("*").alias("n")))
    mean = reduce(DataFrame.unionByName, parts).groupBy("s", "t").agg((F.sum("d") / F.sum("n")).alias("d"))
    between = F.avg(F.when(F.col("s") != F.col("t"), F.col("d")))
    within = [F.max(F.when((F.col("s") == x) & (F.col("t") == x), F.col("d"))) for x in (first, second)]
    return mean.agg((2 * between - within[0] - within[1]).alias("energy"))
