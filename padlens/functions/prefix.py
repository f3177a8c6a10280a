"""Running sums that don't gather a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from padlens.functions.shared import written


def running_totals(rows: DataFrame, keys: list[str], order: str, sums: list[str], buckets: int = 64, last: str | None = None) -> DataFrame:
    """rows with `cum_<s>` for each of sums: the total over the key's rows with an order value up to this one, and, if `last` names
    a column, the order value before this one.

    The order values must be distinct within a key. They are cut at approximate quantiles of the whole table, so that
    a key's rows are summed in up to `buckets` tasks; what lies in lower buckets is added from the small table of
    bucket totals. The rows, which callers have aggregated, are written to the shared folder first, as they are read
    three times.
    """
    rows = written(rows, "counts")
    levels = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = rows.agg(F.percentile_approx(order, levels, F.lit(1000)).alias("_edges"))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("_bucket", F.size(F.filter(F.coalesce("_edges", F.array()), lambda e: e <= F.col(order)))).drop("_edges")
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums], F.max(order).alias("_top"))
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_t_{s}").over(below), F.lit(0)).alias(f"_o_{s}") for s in sums], F.max("_top").over(below).alias("_last"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(offsets, [*keys, "_bucket"])
    for s in sums:
        joined = joined.withColumn(f"cum_{s}", F.sum(s).over(local) + F.col(f"_o_{s}"))
    if last:
        joined = joined.withColumn(last, F.coalesce(F.lag(order).over(Window.partitionBy(*keys, "_bucket").orderBy(order)), "_last"))
    return joined.drop("_bucket", "_last", *[f"_o_{s}" for s in sums])
