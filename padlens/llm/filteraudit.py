"""Audit of how document filters act on each other, from one table of failing ids per filter."""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlens.llm.common import staged

#: The filters' conditions of failure. E, a text that a smaller doc_id has too, needs the whole table.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SIGNS = 100, 80, 10, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def row_failures(text: Column) -> dict[str, Column]:
    """The conditions that a document's own text decides; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SIGNS),
    }


def failing_ids(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The table of all ids and one table of failing ids for each filter, written: `rid, part, good, toxic`.

    Each row of docs is a document and gets an id of its own, rid, so that repeated rows count each; labels go by
    doc_id (several of one doc_id: the greatest). The texts are read once, into a narrow table; only that is shuffled.
    """
    facts = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        *[fails.alias(f) for f, fails in row_failures(F.col("text")).items()],
    )
    facts = staged(facts, "facts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    first = staged(first, "repeated")  # repeated texts alone: Spark knows the size, and splits a digest of many rows
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    marked = facts.join(first, "digest", "left").join(staged(marks.filter("good + toxic > 0"), "marks"), "doc_id", "left").select(
        "rid",
        "part",
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
        *"ABCD",
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"),
    )
    marked = staged(marked, "marked")
    ids = ["rid", "part", "good", "toxic"]
    return marked.select(ids), {f: staged(marked.filter(f).select(ids), f"fails-{f}") for f in "ABCDE"}


def survivors(ids: DataFrame, fails: dict[str, DataFrame], prefix: str) -> DataFrame:
    """The ids that none of the prefix's filters removes."""
    for f in prefix:
        ids = ids.join(fails[f].select("rid"), "rid", "left_anti")
    return ids


def removed(ids: DataFrame, fails: dict[str, DataFrame], prefix: str, f: str) -> DataFrame:
    """The ids that filter f removes after the prefix."""
    return survivors(ids, fails, prefix).join(fails[f].select("rid"), "rid", "left_semi")


def redundant(fails: dict[str, DataFrame], prefix: str, f: str) -> DataFrame:
    """The ids that fail f and that the prefix has removed: those that its last filter removes, and those before."""
    parts = [removed(fails[f], fails, prefix[:i], g) for i, g in enumerate(prefix)]
    out = parts[0] if parts else fails[f].limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_counts(ids: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """`prefix, filter, part, kept, toxic, good, taken`: for each set of filters as a sorted string, over all ids (filter '')
    and over each filter's failing ids: how many survive the set, how many of these are labelled, and how many the set's last
    filter takes that those before it had left.

    What survives depends on the set and not on its order, so 32 sets stand for the prefixes of all 120 orders. Each is
    a chain of left-anti joins, its last removal a left-semi join, all by rid: the id tables are shuffled once, and the
    exchanges are used again by every set.
    """
    every = ids.withColumn("filter", F.lit(""))
    for f, t in fails.items():
        every = every.unionByName(t.withColumn("filter", F.lit(f)))
    every = staged(every, "relations")
    names = sorted(fails)
    rows = None
    for prefix in ("".join(c) for n in range(len(names) + 1) for c in combinations(names, n)):
        branch = survivors(every, fails, prefix).select(F.lit(prefix).alias("prefix"), "filter", "part", "good", "toxic", F.lit(1).alias("kept"), F.lit(0).alias("taken"))
        if prefix:
            gone = removed(every, fails, prefix[:-1], prefix[-1]).select(F.lit(prefix).alias("prefix"), "filter", "part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(0).alias("kept"), F.lit(1).alias("taken"))
            branch = branch.unionAll(gone)
        rows = branch if rows is None else rows.unionAll(branch)
    return rows.groupBy("prefix", "filter", "part").agg(*[F.sum(c).cast("long").alias(c) for c in ("kept", "good", "toxic", "taken")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`, a row for each part
    (lang; null: empty), order of the five filters and step.

    Null and empty texts are documents without words. A row without doc_id never fails E and makes no other fail it;
    rows of one doc_id and text neither. Texts of any length are read whole; repeated rows count each; other columns are ignored;
    no rows give no rows.
    """
    ids, fails = failing_ids(docs, labels)
    counts = staged(prefix_counts(ids, fails), "prefixes")
    key = F.concat_ws("|", "prefix", "filter")
    lists = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct("kept", "good", "toxic", "taken")))).alias("m"))  # 192 entries at most
    orders = F.lit(["".join(p) for p in permutations(sorted(fails))])
    steps = lists.select("part", "m", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(fails)))).alias("step"))

    def sorted_set(s: Column) -> Column:
        return F.array_join(F.array_sort(F.split(s, "")), "")

    def found(prefix: Column, f: Column, what: str) -> Column:
        return F.coalesce(F.try_element_at("m", F.concat_ws("|", prefix, f))[what], F.lit(0).cast("long"))

    steps = steps.select("*", F.expr("substring(filter_order, step, 1)").alias("f"), sorted_set(F.expr("substring(filter_order, 1, step - 1)")).alias("before"))
    steps = steps.select("*", sorted_set(F.concat("before", "f")).alias("after"), F.replace(F.lit("".join(sorted(fails))), F.col("f")).alias("others"))
    # Redundant: what each filter of the prefix, in sorted order, took of the failing ids.
    taken = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length("before"), F.lit(1))), lambda n: found(F.substring(F.col("before"), F.lit(1), n), F.col("f"), "taken")),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    none = F.lit("")
    out = steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        found(F.col("after"), none, "kept").alias("kept"),
        found(F.col("before"), F.col("f"), "kept").alias("removed"),
        F.when(F.col("step") > 1, taken).otherwise(F.lit(0).cast("long")).alias("redundant"),
        found(F.col("others"), F.col("f"), "kept").alias("unique_fails"),
        found(F.col("before"), F.col("f"), "good").alias("good_lost"),
        found(F.col("before"), F.col("f"), "toxic").alias("toxic_lost"),
        "m",
        "f",
    )
    # Each set of k filters before f comes in k! (n - 1 - k)! of the orders.
    sets = [F.struct(F.lit("".join(c)).alias("p"), F.lit(factorial(n) * factorial(len(fails) - 1 - n)).cast("long").alias("w")) for n in range(len(fails)) for c in combinations(sorted(fails), n)]
    fit = F.filter(F.array(*sets), lambda s: ~F.contains(s["p"], F.col("f")))
    shapley = F.aggregate(F.transform(fit, lambda s: s["w"] * found(s["p"], F.col("f"), "kept")), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.withColumn("shapley", shapley).select("part", "filter_order", "step", *COUNTS)
