"""Exact quantiles by selecting ranks: no key's values meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from padlens.functions.shared import written

#: Distinct values (over all keys) up to which Spark's own percentile, which holds a key's distinct values, gives the same; parts
#: into which a key's values are cut, twice.
IN_MEMORY, PARTS = 1_000_000, 256


def exact_quantiles(rows: DataFrame, by: list[str], value: str, levels: list[float], weight: Column | None = None, in_memory: int = IN_MEMORY, parts: int = PARTS) -> DataFrame:
    """`*by, q array<double>`: of each key the quantiles at all levels, linear between the two ranks around (n - 1) * level, as
    Spark's percentile has them. Nulls are no values, NaN is the greatest; a key without values has null; with no keys one row.

    weight: how often a row counts (default once). Values are counted first, so ties cost one row.
    """
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).cast("long").alias("_c"))
    counts = written(counts, "values")
    if counts.count() > in_memory:
        return by_rank(counts, by, levels, parts)
    # A row that counts 0 times would end percentile's walk; keys without values stay.
    seen = counts.withColumn("_v", F.when(F.col("_c") > 0, F.col("_v"))).withColumn("_c", F.greatest("_c", F.lit(1).cast("long")))
    return seen.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, levels)), F.col("_c")).alias("q"))


def stepped(edges: DataFrame, column: str, parts: int) -> DataFrame:
    """edges with the distinct ascending values of `column` as `_runs`, arrays of about sqrt(parts) of them, and `_heads`, the first of each."""
    step = max(1, round(parts**0.5))
    found = edges.withColumn(column, F.array_distinct(F.coalesce(column, F.array().cast("array<double>"))))
    starts = F.filter(F.sequence(F.lit(1), F.lit(parts), F.lit(step)), lambda i: i <= F.size(column))
    found = found.withColumn("_runs", F.transform(starts, lambda i: F.slice(column, i, step))).drop(column)
    return found.withColumn("_heads", F.transform("_runs", lambda r: r[0]))


def place(value: Column) -> Column:
    """How many of the values of `stepped` are at or below the value: full runs first, then the value's own run alone."""
    runs = F.size(F.filter("_heads", lambda h: h <= value))
    own = F.size(F.filter(F.get("_runs", runs - 1), lambda e: e <= value))
    return F.when(runs == 0, 0).otherwise((runs - 1) * F.size(F.get("_runs", F.lit(0))) + own)


def by_rank(counts: DataFrame, by: list[str], levels: list[float], parts: int = PARTS, turns: int = 2) -> DataFrame:
    """exact_quantiles of counts(*by, _v, _c) by rank selection.

    A turn cuts each group at approximate quantiles of its own values into `parts` parts and keeps only the parts that hold
    a wanted rank, which then counts from the part's first row. After the last turn the wanted parts, of about
    1 / parts ** turns of a key's values each, are put in order.
    """
    keys = ["_k"]  # all keys as one text, so that null keys meet in joins too
    every = counts.withColumn("_k", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit(""))
    counts = every.filter("_v is not null and _c > 0").select("_k", "_v", "_c")
    sizes = written(counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), "sizes")
    pos = [(F.col("_n") - 1) * F.lit(p) for p in levels]
    ranks = sizes.select(*keys, F.explode(F.array_distinct(F.array(*[f(p).cast("long") for p in pos for f in (F.floor, F.ceil)]))).alias("_r")).withColumn("_at", F.col("_r"))
    group = list(keys)
    cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    for turn in range(turns):
        part = f"_b{turn}"
        edges = counts.groupBy(*group).agg(F.percentile_approx("_v", cuts, F.lit(20 * parts)).alias("_e"))
        edges = written(stepped(edges, "_e", parts), "edges")
        placed = counts.join(edges, group).withColumn(part, place(F.col("_v"))).drop("_runs", "_heads")
        totals = placed.groupBy(*group, part).agg(F.sum("_c").alias("_t"))
        lower = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows
        totals = totals.withColumn("_low", F.coalesce(F.sum("_t").over(lower), F.lit(0)))
        ranks = ranks.join(totals, group).filter((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_low") + F.col("_t")))
        ranks = written(ranks.withColumn("_at", F.col("_at") - F.col("_low")).drop("_low", "_t"), "ranks")
        group.append(part)
        counts = written(placed.join(ranks.select(*group).distinct(), group, "left_semi"), "kept")
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).join(ranks, group).filter((F.col("_at") >= F.col("_upto") - F.col("_c")) & (F.col("_at") < F.col("_upto")))
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))  # two ranks a level at most

    def between(p: Column) -> Column:
        low, high = F.try_element_at("_m", F.floor(p).cast("long")), F.try_element_at("_m", F.ceil(p).cast("long"))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    quantiles = F.when(F.col("_m").isNotNull(), F.array(*map(between, pos)))
    whole = sizes.join(held, keys).select("_k", quantiles.alias("q"))
    groups = every.select("_k", *by).distinct() if by else every.sparkSession.range(1).select(F.lit("").alias("_k"))
    return groups.join(whole, "_k", "left").select(*by, "q")
