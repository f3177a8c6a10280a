"""Stored results held against what their inputs give now.

A claim is `artifact, key, measure, value`: a number that a report, a model or a table of cuts states. A binding is
`artifact, input, fingerprint`: what an artifact was computed from, as a fingerprint of a table or of another artifact's
claims. A claim that its inputs no longer stand for isn't compared: it is stale, and all that rests on its artifact is void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlens.functions.shared import written

#: Both as the audited reports have them: |stored - recomputed| <= ABSOLUTE + RELATIVE * |recomputed|.
ABSOLUTE = RELATIVE = 1e-12
CLAIM = ["artifact", "key", "measure"]


def as_claims(rows: DataFrame, artifact: Column, keys: list[str], values: list[str]) -> DataFrame:
    """One claim for each value column of each row; the key columns' values, joined, name the row."""
    named = rows.select(artifact.alias("artifact"), F.concat_ws("|", *keys).alias("key"), *[F.col(v).cast("double").alias(v) for v in values])
    return named.unpivot(["artifact", "key"], values, "measure", "value")


def fingerprints(rows: DataFrame, name: Column) -> DataFrame:
    """`name, fingerprint`: of each named part of a table an order-free hash: the number of rows and the sum of row hashes."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(name.alias("name")).agg(F.concat_ws(":", F.count("*"), F.sum(row).cast("string")).alias("fingerprint"))


def standing(bindings: DataFrame, current: DataFrame, most_levels: int = 64) -> DataFrame:
    """`artifact, state, cause` of the artifacts that don't stand: stale (an input's fingerprint isn't what it was bound to, or the
    input is gone) or void (it rests on an artifact that doesn't stand). cause: the least input at fault.

    bindings(artifact, input, fingerprint), current(name, fingerprint). Faults spread from artifact to artifact, a level
    a turn, until no new one is met; most_levels guards against a chain longer than any report has.
    """
    now = current.select(F.col("name").alias("input"), F.col("fingerprint").alias("now"))
    bindings = written(bindings.select("artifact", "input", "fingerprint"), "bindings")
    changed = bindings.join(now, "input", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("now")))
    found = written(changed.groupBy("artifact").agg(F.min("input").alias("cause")).withColumn("state", F.lit("stale")), "stale")
    fresh = found
    for _ in range(most_levels):
        hit = bindings.join(fresh.select(F.col("artifact").alias("input")), "input", "left_semi").join(found, "artifact", "left_anti")
        fresh = written(hit.groupBy("artifact").agg(F.min("input").alias("cause")).withColumn("state", F.lit("void")), "void")
        if fresh.isEmpty():
            return found.select("artifact", "state", "cause")
        found = found.unionByName(fresh)
    raise ValueError(f"artifacts rest on each other over {most_levels} levels")


def compare(claims: DataFrame, recomputed: DataFrame, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """`artifact, key, measure, stored, recomputed, verdict`: holds, wrong, orphan (nothing gives it), missing (nothing states it) or
    repeated (stated more than once). Nulls and NaNs equal themselves alone."""
    stated = claims.groupBy(*CLAIM).agg(F.count("*").alias("n"), F.max("value").alias("stored"))
    given = recomputed.select(*CLAIM, F.col("value").alias("recomputed"), F.lit(True).alias("given"))
    both = stated.join(given, CLAIM, "full_outer")
    a, b = F.col("stored"), F.col("recomputed")
    near = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), F.lit(False))
    verdict = F.when(F.col("given").isNull(), "orphan").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(near, "holds").otherwise("wrong")
    return both.select(*CLAIM, "stored", "recomputed", verdict.alias("verdict"))


def audit(claims: DataFrame, recomputed: DataFrame, bindings: DataFrame, current: DataFrame) -> DataFrame:
    """compare()'s rows with `cause`: claims of artifacts that don't stand are stale or void, whatever their values; claims of an
    artifact without any binding are unbound, as nothing says what they rest on."""
    fallen = standing(bindings, current)
    bound = bindings.select("artifact", F.lit(True).alias("bound")).distinct()
    rows = compare(claims, recomputed).join(fallen, "artifact", "left").join(bound, "artifact", "left")
    stands = F.col("verdict").isin("orphan", "missing")
    verdict = F.when(stands, F.col("verdict")).when(F.col("bound").isNull(), "unbound").otherwise(F.coalesce("state", "verdict"))
    return rows.select(*CLAIM, "stored", "recomputed", verdict.alias("verdict"), F.when(~stands, F.col("cause")).alias("cause"))


def holds(audited: DataFrame) -> DataFrame:
    """`artifact, claims, faults, passed`: an artifact passes if every claim holds."""
    fault = (F.col("verdict") != "holds").cast("long")
    return audited.groupBy("artifact").agg(F.count("*").alias("claims"), F.sum(fault).alias("faults"), (F.sum(fault) == 0).alias("passed"))
