"""Contracts as queries that return the rows that break a rule: rule, key, detail. Empty means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _broken(rows: DataFrame, rules: dict[str, Column], key: str, detail: Column) -> DataFrame:
    """One scan for all rules: each broken rule of a row becomes a row."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select(F.explode(named).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def score_contract(scores: DataFrame, low: float, high: float) -> DataFrame:
    """P10: finite scores within a range, labels 0 or 1, known pools, an action."""
    return _broken(
        scores,
        {
            "score_not_finite": F.col("score").isNull() | F.isnan("score") | F.col("score").isin(float("inf"), float("-inf")),
            "score_out_of_range": ~F.col("score").between(low, high),
            "label_unknown": F.col("label").isNull() | ~F.col("label").isin(0, 1),
            "pool_unknown": F.col("pool").isNull() | ~F.col("pool").isin("train", "val", "test"),
            "action_empty": F.coalesce(F.trim("action"), F.lit("")) == "",
        },
        "event_id",
        F.col("score"),
    )


def topology(keys: DataFrame) -> DataFrame:
    """Numbers within an event start at 0 and rise by one. keys(event, seq)."""
    order = Window.partitionBy("event").orderBy("seq")
    rows = keys.withColumn("_before", F.lag("seq").over(order))
    return _broken(
        rows,
        {"does_not_start_at_zero": F.col("_before").isNull() & (F.col("seq") != 0), "gap_in_numbers": F.col("seq") - F.col("_before") > 1, "repeated_number": F.col("seq") == F.col("_before")},
        "event",
        F.col("seq"),
    )


def class_presence(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups that lack one of the labels."""
    return rows.groupBy(*by).agg(F.countDistinct("label").alias("labels")).filter("labels < 2")


def reference_counts(rows: DataFrame, users: DataFrame, actions: DataFrame, least: int) -> DataFrame:
    """User-action pairs with too few events; pairs without any event count as 0. users and actions are dimensions."""
    have = rows.groupBy("user_id", "action").agg(F.count("*").alias("n"))
    return users.crossJoin(F.broadcast(actions)).join(have, ["user_id", "action"], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)


def competence(cells: DataFrame, least: float = 0.8) -> DataFrame:
    """Cells keep their row and get a mark."""
    return cells.withColumn("status", F.when(F.col("auc") >= least, "competent").otherwise("training_failure"))


def unchanged(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of two tables that differ in a column or lack a partner; null equals null."""
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    j = a.join(b, key, "full_outer")
    differs = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]
    what = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise(F.concat_ws(",", *differs))
    return j.select(key, what.alias("what")).filter("what <> ''")


def changed_share(left: DataFrame, right: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """Per group the share of keys whose value changed."""
    j = left.select(key, by, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key)
    return j.groupBy(by).agg(F.avg((~F.col("_a").eqNullSafe(F.col("_b"))).cast("double")).alias("changed"), F.count("*").alias("n"))


def clock_leak(rows: DataFrame, step_ms: int, least: int = 50) -> DataFrame:
    """Share of sessions whose elapsed times all lie on a grid, by label; flagged if fakes do so far more often.

    rows(unit, label, t_ms).
    """
    unit = rows.groupBy("unit", "label").agg(F.min("t_ms").alias("_t"), F.bool_and(F.col("t_ms") % step_ms == 0).alias("ramp"))
    share = unit.groupBy("label").agg(F.avg(F.col("ramp").cast("double")).alias("share"), F.count("*").alias("n"))
    wide = share.agg(*[F.max(F.when(F.col("label") == k, F.col(c))).alias(f"{n}_{c}") for k, n in ((0, "real"), (1, "fake")) for c in ("share", "n")])
    flag = (F.col("fake_share") > 0.5) & (F.col("fake_share") > 3 * F.col("real_share")) & (F.col("fake_n") >= least) & (F.col("real_n") >= least)
    return wide.withColumn("flagged", flag)


def grid_gaps(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of two dimensions that no row has."""
    on = [*first.columns, *second.columns]
    return first.crossJoin(F.broadcast(second)).join(rows.select(*on).distinct(), on, "left_anti")


def relink(scores: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Score rows without a source row, source rows without a score, repeated ids, and columns that disagree."""
    repeated = scores.groupBy(key).count().filter("count > 1").select(F.col(key), F.lit("repeated").alias("what"))
    return unchanged(scores, source, key, columns).unionByName(repeated)


def roster_hashes(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """An order-free hash of each group's rows: count and sum of row hashes."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("hash"))


def shortfall(demand: DataFrame, supply: DataFrame, by: list[str]) -> DataFrame:
    """Where demand exceeds supply. demand(by, session_id), supply(by)."""
    need = demand.groupBy(*by, "session_id").agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum("c").alias("demand"), F.max("c").alias("largest"))
    have = supply.groupBy(*by).agg(F.count("*").alias("supply"))
    return need.join(have, by, "left").withColumn("supply", F.coalesce("supply", F.lit(0))).filter("supply < demand")


def ownership(rows: DataFrame, owned: str, owner: str) -> DataFrame:
    """Things that more than one owner claims."""
    return rows.groupBy(owned).agg(F.countDistinct(owner).alias("owners")).filter("owners > 1")
