"""Deterministic splits and samples by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from padlens.functions.prefix import running_totals


def hash_rank_split(rows: DataFrame, keys: list[str], unit: str, seed: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Rank the units of each key by sha256("seed|key...|unit") and cut at floor(train n) and floor(val n)."""
    rank = F.sha2(F.concat_ws("|", F.lit(seed), *keys, unit), 256)
    n = F.count("*").over(Window.partitionBy(*keys))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, unit))
    ranked = rows.withColumn("_n", n).withColumn("_rn", rn)
    first = F.floor(F.lit(train) * F.col("_n"))
    pool = F.when(F.col("_rn") <= first, "train").when(F.col("_rn") <= first + F.floor(F.lit(val) * F.col("_n")), "val").otherwise("test")
    return ranked.withColumn("pool", pool).drop("_n", "_rn")


def little_endian_hash(text: Column) -> Column:
    """The first eight bytes of sha256, as an unsigned little-endian number in a decimal."""
    hexed = F.sha2(text, 256)
    swapped = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def stable_seed(text: Column) -> Column:
    """A seed of 63 bits."""
    return (little_endian_hash(text) % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def meta_pool(rows: DataFrame, first: int = 6) -> DataFrame:
    """Remap pools for a second model: base training rows go, test stays; fake validation users in order fill
    train up to the n-th and then val; real validation rows go by the hash of their id, six in ten to train."""
    users = rows.filter("label = 1 and pool = 'val'").select("user_id").distinct()
    chosen = users.orderBy("user_id").limit(first).withColumn("_u", F.lit(True))
    real = little_endian_hash(F.concat(F.lit("total-meta-real|"), F.col("event_id").cast("string"))) % 10 < 6
    pool = F.when(F.col("pool") == "test", "test").when(F.col("label") == 1, F.when(F.col("_u"), "train").otherwise("val"))
    return rows.filter("pool <> 'train'").join(chosen, "user_id", "left").withColumn("pool", pool.otherwise(F.when(real, "train").otherwise("val"))).drop("_u")


def two_folds(rows: DataFrame, parity: bool = False) -> DataFrame:
    """Users in order, first half 0 and second half 1; or by turns."""
    users = running_totals(rows.select("user_id").distinct().withColumn("one", F.lit(1)), [], "user_id", ["one"])
    rank = F.col("cum_one") - 1
    half = users.agg(F.ceil(F.count("*") / 2).alias("half"))
    fold = rank % 2 if parity else (rank >= F.col("half")).cast("int")
    return rows.join(users.crossJoin(F.broadcast(half)).select("user_id", fold.cast("int").alias("fold")), "user_id")


def mirrored_draw(genuine: DataFrame, fake: DataFrame, replicates: int) -> DataFrame:
    """For each genuine session and replicate, as many fakes of the same user and action as it has events, without
    repeats within a session (all of them if there are fewer).

    Each replicate puts a user's fakes in an order by hash; a session takes neighbours in it from a place of its own, so
    the work is the number of fakes and of drawn rows, never sessions times fakes. Hashes stand for the random generator.
    """
    key = ["rep", "user_id", "action"]
    rep = genuine.sparkSession.range(replicates).select(F.col("id").cast("int").alias("rep"))
    order = Window.partitionBy(*key).orderBy(F.xxhash64("rep", "fake_id"), "fake_id")
    pool = fake.select("user_id", "action", F.col("event_id").alias("fake_id")).crossJoin(F.broadcast(rep)).withColumn("rank", F.row_number().over(order) - 1)
    size = fake.groupBy("user_id", "action").agg(F.count("*").alias("m"))
    need = genuine.groupBy("user_id", "session_id", "action").agg(F.count("*").alias("need")).join(size, ["user_id", "action"]).crossJoin(F.broadcast(rep))
    slots = need.withColumn("slot", F.explode(F.sequence(F.lit(1), F.least("need", "m").cast("int"))))
    place = F.pmod(F.xxhash64("rep", "session_id", "action") % F.lit(1 << 40) + F.col("slot"), F.col("m")).cast("int")
    return slots.withColumn("rank", place).join(pool, [*key, "rank"]).select("rep", "user_id", "session_id", "action", "slot", "fake_id")


def equal_size_sample(rows: DataFrame, key: str, unit: str, seed: str) -> DataFrame:
    """From every key as many rows as the smallest key has, those of least sha256."""
    sizes = rows.groupBy(key).count()
    least = sizes.agg(F.min("count").alias("_least"))
    order = Window.partitionBy(key).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), key, unit), 256), unit)
    return rows.withColumn("_rn", F.row_number().over(order)).crossJoin(F.broadcast(least)).filter("_rn <= _least").drop("_rn", "_least")
