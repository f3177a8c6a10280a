"""Real-vs-fake detectors on Spark ML, trained on train rows alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlens.functions.shared import written
from padlens.operators import forest as G
from padlens.operators import metrics as M
from padlens.operators import replicates as V
from padlens.operators import resample as R

KINDS = ("linear_svm", "forest", "boosted", "logistic", "rff_svm")


def balanced(train: DataFrame) -> DataFrame:
    """Class weights n / (2 n_label), as a column `weight`."""
    n = train.groupBy("label").agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    w = n.crossJoin(F.broadcast(total)).select("label", (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return train.join(F.broadcast(w), "label")


def fourier(width: int, count: int = 64, seed: int = 3) -> Callable[..., np.ndarray]:
    """The function that gives of `width` columns of a batch the matrix of random Fourier features, with a fixed seed."""
    random = np.random.default_rng(seed)
    w, b = random.normal(0, width**-0.5, (count, width)), random.uniform(0, 2 * np.pi, count)

    def waves(columns: Iterable[pa.Array]) -> np.ndarray:
        angles = b + sum(np.outer(c.to_numpy(zero_copy_only=False), w[:, j]) for j, c in enumerate(columns))
        if np.isnan(angles).any():
            raise ValueError("a feature is null or NaN")
        return np.cos(angles)

    return waves


def with_fourier(rows: DataFrame, names: list[str], count: int = 64, seed: int = 3) -> DataFrame:
    """Rows with `features`, random Fourier features of standardised columns, for a linear machine in place of a kernel. A batch of
    rows is one matrix: as columns of SQL the cosines are too long for Spark to compile."""
    waves = fourier(len(names), count, seed)

    @F.arrow_udf("array<double>")
    def features(*columns: pa.Array) -> pa.Array:
        each = waves(columns)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * count), pa.array(each.ravel()))

    return rows.withColumn("features", array_to_vector(features(*[F.col(n).cast("double") for n in names])))


def fourier_scored(model: LinearSVCModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with `score`, the margin of a machine fitted on with_fourier(); the features stay in the batch."""
    waves, coefficients, intercept = fourier(len(names), model.numFeatures), model.coefficients.toArray(), model.intercept

    @F.arrow_udf("double")
    def margin(*columns: pa.Array) -> pa.Array:
        return pa.array(waves(columns) @ coefficients + intercept)

    return rows.withColumn("score", margin(*[F.col(n).cast("double") for n in names]))


#: The published sizes: trees of the forest, their depth (None: no limit) and least leaf, rounds, depth and rate of boosting, share of
#: rows each round sees; and those of the session detector's forest.
PUBLISHED = {"trees": 500, "depth": None, "leaf": 2, "rounds": 200, "round_depth": 3, "rate": 0.05, "subsample": 0.9}
SESSION = PUBLISHED | {"trees": 300, "depth": 8}

#: Bins of a column in trees (Spark's default); rows as which the rows of a cell of bins are trained at most.
BINS, SHARES = 32, 4

#: Rows of a part of the training rows of a machine at most.
PART_ROWS = 1 << 18


def detector(kind: str, names: list[str], sizes: dict[str, float | None] = PUBLISHED) -> Pipeline:
    """Assemble, standardise by the training rows, classify. A forest without a limit of depth is none of Spark's, which end at
    30: `run_protocol` grows it."""
    stages: list[Transformer] = [VectorAssembler(inputCols=names, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "forest" and sizes["depth"] is None:
        raise ValueError("Spark's trees need a depth")
    trees = {"numTrees": sizes["trees"], "maxDepth": sizes["depth"], "minInstancesPerNode": sizes["leaf"]}
    boost = {"maxIter": sizes["rounds"], "maxDepth": sizes["round_depth"], "stepSize": sizes["rate"], "subsamplingRate": sizes["subsample"]}
    model = {
        "linear_svm": lambda: LinearSVC(**common, regParam=0.01, maxIter=50),
        "rff_svm": lambda: LinearSVC(**common, regParam=0.01, maxIter=50),
        "forest": lambda: RandomForestClassifier(**common, **trees, featureSubsetStrategy="sqrt", seed=1),
        "boosted": lambda: GBTClassifier(**common, **boost, seed=1),
        "logistic": lambda: LogisticRegression(**common, maxIter=50, regParam=1e-4),
    }[kind]()
    return Pipeline(stages=[*stages, model])


def bin_edges(train: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Of each column the ascending values at which a tree may split: between all values where there are at most `bins`, else at
    approximate quantiles. Two scans; no more than `bins` values a column come to the driver."""
    levels = [i / bins for i in range(1, bins)]
    near = train.agg(*[F.approx_count_distinct(n).alias(f"n{i}") for i, n in enumerate(names)], *[F.percentile_approx(n, levels, 100 * bins).alias(f"q{i}") for i, n in enumerate(names)]).first()
    few = [i for i in range(len(names)) if near[f"n{i}"] <= bins * 5 // 4]  # the count is off by a few parts in a hundred
    own = train.agg(*[F.collect_set(names[i]).alias(f"v{i}") for i in few]).first() if few else None
    out = []
    for i in range(len(names)):
        values = sorted(own[f"v{i}"]) if i in few else []
        if 1 < len(values) <= bins:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:])])
        else:
            out.append(sorted(set(near[f"q{i}"] or [0.0])))
    return out


def cell_shares(coded: DataFrame, codes: list[str], shares: int = SHARES) -> DataFrame:
    """label, *codes, weight: rows of equal label and codes, which no tree can tell apart, as at most `shares` rows of equal weight
    that stand for all of them, so that draws of rows still cut through a cell. Up to `shares` rows stay single rows. Classes are balanced
    by the number of rows."""
    cells = coded.groupBy("label", *codes).agg(F.count("*").alias("_n"))
    cells = written(cells, "cells")
    total = cells.groupBy("label").agg(F.sum("_n").alias("_c"))
    total = total.crossJoin(F.broadcast(total.agg(F.sum("_c").alias("_all"), F.count("*").alias("_k"))))
    weight = F.col("_n") / F.least("_n", F.lit(shares)) * F.col("_all") / (F.col("_k") * F.col("_c"))
    each = F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(shares)).cast("int")))
    return cells.join(F.broadcast(total), "label").withColumn("weight", weight).select("label", *codes, "weight", each.alias("_i")).drop("_i")


def binning(train: DataFrame, names: list[str]) -> Bucketizer:
    """The bins of training rows, as columns `_code_`."""
    splits = [[-float("inf"), *e, float("inf")] for e in bin_edges(train, names)]
    return Bucketizer(inputCols=names, outputCols=[f"_code_{n}" for n in names], splitsArray=splits)


def fit_trees(train: DataFrame, names: list[str], kind: str, sizes: dict[str, float | None] = PUBLISHED) -> PipelineModel:
    """L3, L4: trees see a column only through its bins, so rows are binned first and trained as the weighted cells that they fill.

    Cells are at most BINS to the power of the columns, and usually far fewer, however many rows there are; where every row has a cell of
    its own the training rows are as many as before.
    """
    binned = binning(train, names)
    codes = binned.getOutputCols()
    cells = written(cell_shares(binned.transform(train), codes), "shares")
    trees = detector(kind, codes, sizes).getStages()
    assembled = VectorAssembler(inputCols=codes, outputCol="features")
    model = trees[-1].fit(assembled.transform(cells.repartition(cells.sparkSession.sparkContext.defaultParallelism)))
    return PipelineModel([binned, assembled, model])


def spread(cells: DataFrame) -> DataFrame:
    """Written training rows over all cores, in parts of at most PART_ROWS."""
    return cells.repartition(max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // PART_ROWS)))


def fit_fourier(train: DataFrame, names: list[str], sizes: dict[str, float | None] = PUBLISHED) -> LinearSVCModel:
    """A linear machine on the Fourier features of standardised columns. Rows equal in label and columns are trained as one row of
    their weight together, which leaves the loss as it is."""
    cells = spread(written(cell_shares(train, names, 1), "cells"))
    return detector("rff_svm", names, sizes).getStages()[-1].fit(with_fourier(cells, names).select("label", "weight", "features"))


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """A score that is high for fakes: the margin of a machine, else the probability of label 1."""
    out = model.transform(rows)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("score", vector_to_array(column)[1]).drop("raw_features", "features", "rawPrediction", "probability", "prediction", "weight")


def run_protocol(rows: DataFrame, names: list[str], kind: str, sizes: dict[str, float | None] = PUBLISHED) -> DataFrame:
    """Fit on train, score val and test alone, so that nothing fitted later sees in-sample scores. rows(label, pool, *names)."""
    if kind == "rff_svm":
        m = rows.filter("pool = 'train'").agg(*[F.avg(n).alias(f"_m_{n}") for n in names], *[F.stddev_pop(n).alias(f"_s_{n}") for n in names])
        rows = rows.crossJoin(F.broadcast(m))
        rows = rows.withColumns({n: (F.col(n) - F.col(f"_m_{n}")) / F.when(F.col(f"_s_{n}") < 1e-8, 1.0).otherwise(F.col(f"_s_{n}")) for n in names}).drop(*m.columns)
        model = fit_fourier(rows.filter("pool = 'train'"), names, sizes)
        return fourier_scored(model, rows.filter("pool <> 'train'"), names).select("event_id", "user_id", "action", "label", "pool", "score")
    train = rows.filter("pool = 'train'")
    if kind == "forest" and sizes["depth"] is None:
        return G.forest_scored(binning(train, names), rows, sizes).select("event_id", "user_id", "action", "label", "pool", "score")
    model = fit_trees(train, names, kind, sizes) if kind in ("forest", "boosted") else detector(kind, names, sizes).fit(balanced(train))
    return scored(model, rows.filter("pool <> 'train'")).select("event_id", "user_id", "action", "label", "pool", "score")


def grid_scores(rows: DataFrame, names: list[str], kinds: tuple[str, ...], sizes: dict[str, float | None] = PUBLISHED, parallel: int = 4) -> DataFrame:
    """Scores of val and test rows by a model for each (action, kind): event_id, user_id, action, label, pool, detector, score.

    The actions are few and the driver names a job for each cell; `parallel` cells are fitted at a time, each on the
    cluster, and their scores are written as they come. An action without train rows of both labels has no scores.
    """
    rows = written(rows, "features")
    both = rows.filter("pool = 'train'").groupBy("action").agg(F.countDistinct("label").alias("n")).filter("n = 2")
    cells = [(r["action"], k) for r in both.select("action").orderBy("action").collect() for k in kinds]
    if not cells:
        return rows.limit(0).select("event_id", "user_id", "action", "label", "pool", F.lit("").alias("detector"), F.lit(0.0).alias("score"))

    def one(cell: tuple[str, str]) -> DataFrame:
        action, kind = cell
        out = run_protocol(rows.filter(F.col("action") == action), names, kind, sizes)
        return written(out.select("event_id", "user_id", "action", "label", "pool", F.lit(kind).alias("detector"), "score"), "scores")

    with ThreadPool(min(parallel, len(cells))) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(one), cells))


def cell_table(scores: DataFrame, replicates: int = 2000, seed: str = "l7") -> DataFrame:
    """L7 after the scores: of each (action, detector) the cuts that validation rows give, FAR and FRR of both pools at each cut, the
    test rows' AUC, and the 95 % interval of test FAR and FRR over `replicates` draws of users, genuine users and those of fakes apart.

    scores(event_id, user_id, action, label, pool, detector, score). Test rows have no part in any cut.
    """
    cell = ["action", "detector"]
    scores = written(scores, "scores")
    test = scores.filter("pool = 'test'")
    cuts = written(M.select_cuts(scores.filter("pool = 'val'"), cell).select(*cell, "eer", "frr5"), "cuts")
    out = cuts.join(M.auc(test, cell).select(*cell, "auc"), cell, "left")
    drawn = V.vector_draws(test.select("label", "user_id").distinct(), replicates, seed, ["label"])
    for point in ("eer", "frr5"):
        for pool in ("val", "test"):
            at = M.at_cut(scores.filter(F.col("pool") == pool), cuts, cell, point)
            out = out.join(at.select(*cell, *[F.col(c).alias(f"{pool}_{point}_{c}") for c in ("far", "frr")]), cell, "left")
        bands = R.cut_bands(test, cuts, cell, point, drawn)
        out = out.join(bands.select(*cell, *[F.col(c).alias(f"{point}_{c}") for c in bands.columns if c not in cell]), cell, "left")
    counts = test.groupBy(*cell).agg(F.count(F.when(F.col("label") == 0, 1)).alias("n_real"), F.count(F.when(F.col("label") == 1, 1)).alias("n_fake"))
    return out.join(counts, cell, "left")


def protocol(rows: DataFrame, names: list[str], kinds: tuple[str, ...], sizes: dict[str, float | None] = PUBLISHED, replicates: int = 2000, parallel: int = 4) -> DataFrame:
    """From feature rows to the full table of cells, in one call: grid_scores and cell_table."""
    return cell_table(grid_scores(rows, names, kinds, sizes, parallel), replicates)


def decisions(scores: DataFrame, cuts: DataFrame, cell: list[str]) -> DataFrame:
    """Scores with, at both cuts, the margin (score less cut) and whether the record is rejected; null margins where a
    cell has no cut. Scores or cuts named twice are an error, which Spark raises when the row is met."""
    held = cuts.groupBy(*cell).agg(F.count("*").alias("_n"), *[F.max(p).alias(f"_{p}") for p in ("eer", "frr5")])
    out = scores.join(F.broadcast(held), cell, "left")
    out = out.withColumns({f"margin_{p}": F.when(F.col("_n") > 1, F.raise_error(F.lit("a cell has several cuts")).cast("double")).otherwise(F.col("score") - F.col(f"_{p}")) for p in ("eer", "frr5")})
    return out.withColumns({f"reject_{p}": (F.col(f"margin_{p}") >= 0).cast("int") for p in ("eer", "frr5")}).drop("_n", "_eer", "_frr5")


def fusion_rows(decided: DataFrame, consistency: DataFrame | None, detectors: list[str]) -> tuple[DataFrame, list[str]]:
    """Per sample the score, the margins and the reject flags of each detector side by side, and the consistency
    columns; with the names of all of them. decided: `decisions` with event_id, user_id, action, label, pool, detector.

    A fusion without `consistency__` columns is refused, and so are names that meet twice; samples that lack a detector
    or the consistency row are left out, since a made-up score would be learnt from.
    """
    found = [c for c in (consistency.columns if consistency is not None else []) if c.startswith("consistency__")]
    if not found:
        raise ValueError("the fusion needs consistency__ columns")
    if len(set(detectors)) < len(detectors):
        raise ValueError("a detector is named twice")
    what = ["score", "margin_eer", "margin_frr5", "reject_eer", "reject_frr5"]
    wide = decided.groupBy("event_id", "user_id", "action", "label", "pool").pivot("detector", detectors).agg(*[F.max(c).cast("double").alias(c) for c in what])
    names = [f"{d}_{c}" for d in detectors for c in what] + found
    out = wide.join(consistency.select("event_id", *[F.col(c).cast("double").alias(c) for c in found]), "event_id")
    return out.dropna(subset=names), names
