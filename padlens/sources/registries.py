"""Split, registry and binding files with what is wrong with them, and tables of cell results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POOLS = ("train", "val", "test")
#: Columns of a cell result file.
CELLS = "method string, action string, modality string, detector string, far_at_frr5 double, eer_test double"


def json_rows(spark: SparkSession, path: str, schema: str, needed: list[str], whole_file: bool = False) -> DataFrame:
    """The records of JSON files (a line each, or with whole_file a file each) with `file`, `record` (the text of one that can't be
    read) and `reason`: not_json, a value of another type than the schema's included, or missing:<field>, else null.

    Nothing is dropped: a broken record stays as a row that names its file.
    """
    fields = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("record", T.StringType())])
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "record").option("multiLine", whole_file).json(path)
    reason = F.when(F.col("record").isNotNull(), "not_json")
    for name in needed:
        reason = reason.when(F.col(name).isNull(), f"missing:{name}")
    return rows.withColumns({"file": F.col("_metadata.file_path"), "reason": reason})


def split_users(splits: DataFrame, by: list[str]) -> DataFrame:
    """*by, pool, user_id: a row for each listed user of splits(*by, train_users, val_users, test_users arrays)."""
    pools = F.array(*[F.struct(F.lit(p).alias("pool"), F.col(f"{p}_users").alias("users")) for p in POOLS])
    return splits.select(*by, F.explode(pools).alias("p")).select(*by, "p.pool", F.explode("p.users").alias("user_id"))


def split_faults(users: DataFrame, by: list[str], sizes: dict[str, int] | None = None, known: DataFrame | None = None) -> DataFrame:
    """*by, rule, key: users in several pools, listed twice in one, not among known(*by, user_id), and known users in no pool; and
    pools of another size than `sizes` says. users: `split_users`' rows."""
    key = [*by, "user_id"]
    each = users.groupBy(*by, "user_id", "pool").agg(F.count("*").alias("n"))

    def named(rows: DataFrame, rule: str, key: Column) -> DataFrame:
        return rows.select(*by, F.lit(rule).alias("rule"), key.cast("string").alias("key"))

    out = named(each.filter("n > 1"), "user_twice_in_pool", F.concat_ws("/", "pool", "user_id"))
    several = each.groupBy(*by, "user_id").agg(F.sort_array(F.collect_set("pool")).alias("pools")).filter(F.size("pools") > 1)  # three at most
    out = out.unionByName(named(several, "user_in_several_pools", F.concat_ws("/", F.array_join("pools", "+"), "user_id")))
    if known is not None:
        out = out.unionByName(named(each.join(known, key, "left_anti").dropDuplicates(key), "unknown_user", F.col("user_id")))
        out = out.unionByName(named(known.join(each, key, "left_anti"), "user_in_no_pool", F.col("user_id")))
    if sizes:
        have = each.groupBy(*by, "pool").agg(F.count("*").alias("n"))
        want = users.select(*by).distinct().select(*by, F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), F.lit(k).cast("long").alias("want")) for p, k in sizes.items()])).alias("w")).select(*by, "w.*")
        n = F.coalesce("n", F.lit(0))
        out = out.unionByName(named(want.join(have, [*by, "pool"], "left").filter(n != F.col("want")), "pool_size", F.concat_ws("/", "pool", n)))
    return out


def overlaps(sides: dict[str, DataFrame], on: str) -> DataFrame:
    """`key, sides`: ids that more than one of the named tables holds (a registry of references and an evaluation set, say)."""
    every = None
    for name, rows in sides.items():
        part = rows.select(F.col(on).alias("key"), F.lit(name).alias("side")).distinct()
        every = part if every is None else every.unionByName(part)
    found = every.groupBy("key").agg(F.sort_array(F.collect_set("side")).alias("s")).filter(F.size("s") > 1)  # a name a table
    return found.select("key", F.array_join("s", "+").alias("sides"))


def binding_faults(bindings: DataFrame, registry: DataFrame, on: str, target: str) -> DataFrame:
    """`rule, key`: bindings(on, target) to what the registry(target) doesn't hold, ids bound to several targets, and targets that
    nothing is bound to."""
    named = lambda rows, rule, key: rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    lost = named(bindings.join(registry, target, "left_anti"), "bound_to_nothing", on)
    several = named(bindings.groupBy(on).agg(F.countDistinct(target).alias("n")).filter("n > 1"), "bound_twice", on)
    return lost.unionByName(several).unionByName(named(registry.join(bindings, target, "left_anti"), "never_bound", target))


def write_cells(cells: DataFrame, path: str) -> None:
    """A table of cell results as CSV with a header, in order of its keys."""
    names = [f.name for f in T.StructType.fromDDL(CELLS)]
    cells.select(*names).orderBy(*names[:4]).write.option("header", True).csv(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell results with `reason`: a cell without its names, a rate that is no number or outside of 0 to 1; else null. A rate
    that is empty is a missing cell and stays null."""
    fields = T.StructType.fromDDL(CELLS)
    rows = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields])).option("header", True).csv(path)
    names, rates = [f.name for f in fields][:4], [f.name for f in fields][4:]
    reason = F.when(F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1, "unnamed_cell")
    for r in rates:
        value = F.col(r).try_cast("double")
        reason = reason.when(F.col(r).isNotNull() & ~F.coalesce(value.between(0, 1), F.lit(False)), f"bad:{r}")
    return rows.withColumn("reason", reason).withColumns({r: F.col(r).try_cast("double") for r in rates})
