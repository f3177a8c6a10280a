"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlens.llm.common import slices, staged, texts_of
from padlens.llm.quality import labelled_sample, labelled_texts, remainder

#: Labelled rows that lexicon and trees are fitted on, at most; what they hold bounds the lexicon.
SAMPLE = 20_000
TREES, DEPTH, STEP, BINS, LEAST, SEED = 60, 4, 0.15, 64, 3.0, 11
#: Least score of a text that counts as toxic.
THRESHOLD = 0.3
#: Toxic documents that must hold an entry, how many times likelier they must hold it than others, and by how many
#: standard deviations their number must exceed chance.
SUPPORT, TIMES, SIGMAS = 8, 4.0, 5.0

_WORD = re.compile(r"[^\W_]+(?:[@$*!01345][^\W_]+)*")
#: Forms of the second person in the corpus' languages.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus".split())
#: Signs that stand for letters in obfuscated words, and the letters.
LOOKALIKE = str.maketrans("@$013457", "asoieast")
_OBFUSCATED = re.compile(r"(?<=[^\W\d_])[@$*!0134578]+(?=[^\W\d_])|(?<![^\W_])(?:[^\W\d_][ .*_-]){4}")
NAMES = (
    "words log_words lexicon_words lexicon_share lexicon_weight prefix_words prefix_share prefix_weight lexicon_distinct near_you you_share "
    "capital_letters capital_words exclamations questions signs obfuscated_share digits long_runs repeated word_length folded_hits"
).split()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def entries_of(text: str) -> set[str]:
    """Lexicon candidates of a text: its words, and word starts of four to seven letters marked by a hyphen."""
    words = set(words_of(text))
    return words | {w[:n] + "-" for w in words for n in (4, 5, 6, 7) if len(w) > n}


class Lexicon:
    """Weights of words and of word starts."""

    def __init__(self, weights: dict[str, float]):
        self.words = {k: v for k, v in weights.items() if not k.endswith("-")}
        self.starts = {k[:-1]: v for k, v in weights.items() if k.endswith("-")}
        self.heads = {k[:4] for k in self.starts}


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of one text; all zero for an empty one."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    weight, starts, heads = lexicon.words, lexicon.starts, lexicon.heads
    hits = [(i, w) for i, w in enumerate(words) if w in weight]
    begun = [max(starts.get(w[:k], 0.0) for k in (4, 5, 6, 7) if len(w) > k) for w in words if len(w) > 4 and w[:4] in heads]
    begun = [x for x in begun if x]
    near, n_you = 0, sum(map(YOU.__contains__, words))
    if hits and n_you:
        you = [i for i, w in enumerate(words) if w in YOU]
        at = np.searchsorted(you, [i for i, _ in hits])
        near = sum(min(abs(i - you[j]) for j in {min(k, n_you - 1), max(k - 1, 0)}) <= 5 for (i, _), k in zip(hits, at.tolist()))
    length, raw = len(text), text.split()
    folded = {w for w in raw if not w.isalpha()}
    return [
        float(n), float(np.log1p(n)), float(len(hits)), len(hits) / n, sum(weight[w] for _, w in hits) / n,
        float(len(begun)), len(begun) / n, sum(begun) / n, float(len({w for _, w in hits})),
        near / n, n_you / n,
        sum(map(str.isupper, text)) / length, sum(map(str.isupper, raw)) / n,
        text.count("!") / n, text.count("?") / n, sum(map(text.count, "#$%&*@|")) / length,
        len(_OBFUSCATED.findall(text)) / n, sum(map(text.count, "0123456789")) / length,
        float("!!" in text or "??" in text), sum(map(eq, words, words[1:])) / n, length / n,
        float(sum(w.lower().translate(LOOKALIKE) in weight and w.lower() not in weight for w in folded)),
    ]


def learn_lexicon(known: DataFrame) -> dict[str, float]:
    """Log-odds of the words and word starts that mark toxic rows of known(text, y).

    An entry must be in SUPPORT toxic texts, so there are fewer than the sample's toxic texts have words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            counts = Counter(), Counter()  # documents of label 0 and 1 that hold an entry
            for t, y in zip(texts_of(batch), batch.column("y").to_pylist()):
                counts[y > 0].update(entries_of(t))
            for y, found in enumerate(counts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(np.full(len(found), y, np.int32)), pa.array(list(found.values()), pa.int64())], ["entry", "y", "c"]
                )

    total = known.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).first()
    bad, good = total["bad"] or 0, total["good"] or 0
    if not bad or not good:
        return {}
    each = [F.sum(F.when(F.col("y") == y, F.col("c")).otherwise(0)).alias(name) for y, name in ((1, "a"), (0, "b"))]
    counts = known.select("text", "y").mapInArrow(run, "entry string, y int, c long").groupBy("entry").agg(*each)
    odds = F.log(((F.col("a") + 0.5) / (bad + 1)) / ((F.col("b") + 0.5) / (good + 1)))
    chance = (F.col("a") + F.col("b")) * (bad / (bad + good))
    rows = counts.filter((F.col("a") >= SUPPORT) & (F.col("a") - chance >= SIGMAS * F.sqrt(chance))).withColumn("w", odds)
    rows = rows.filter(F.col("w") >= float(np.log(TIMES)))
    return {r["entry"]: r["w"] for r in rows.collect()}


class Trees:
    """Gradient-boosted trees for the logistic loss on binned features, grown level by level from histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        binned = self._bins(x)
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        margin = np.full(n, self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut = np.full(2**DEPTH - 1, -1), np.full(2**DEPTH - 1, BINS)
            for level in range(DEPTH):
                width, start = 2**level, 2**level - 1
                hist = np.empty((2, d, width, BINS))
                for j in range(d):
                    key = node * BINS + binned[:, j]
                    hist[0, j] = np.bincount(key, g, width * BINS).reshape(width, BINS)
                    hist[1, j] = np.bincount(key, h, width * BINS).reshape(width, BINS)
                left = hist.cumsum(-1)
                whole = left[..., -1:]
                right = whole - left
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[0] ** 2 / (whole[1] + 1)
                gain[(left[1] < LEAST) | (right[1] < LEAST)] = -1
                best = gain.transpose(1, 0, 2).reshape(width, -1).argmax(1)
                j, b = best // BINS, best % BINS
                good = gain[j, np.arange(width), b] > 1e-9
                feature[start : start + width], cut[start : start + width] = np.where(good, j, -1), np.where(good, b, BINS)
                node = 2 * node + (binned[np.arange(n), j[node]] > np.where(good, b, BINS)[node])
            leaf = -STEP * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            margin += leaf[node]
            self.trees.append((np.maximum(feature, 0), cut, leaf))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


class Ladder:
    """Isotonic regression by pooling neighbours that stand in the wrong order, linear between the pools' centres."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of y, sum of x, number
        for a, b in zip(y[order].tolist(), x[order].tolist()):
            pools.append([a, b, 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], last)]
        self.at = np.array([p[1] / p[2] for p in pools])
        self.value = np.array([p[0] / p[2] for p in pools])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Callable[[list[str]], np.ndarray]:
    """A function, to be called in tasks, that scores texts.

    Labels are learned from ids whose remainder isn't 2 alone, from at most `sample` of them, one text each: three
    quarters fit lexicon and trees, one quarter the isotonic calibration. Where the sample lacks one of the labels,
    every score is the share of label 1 in it (0 without rows).
    """
    spark = docs.sparkSession
    chosen = labelled_sample(labels, "toxic", remainder("doc_id", 4) == 2, sample)
    known = staged(labelled_texts(docs, chosen), "labelled")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4))
    lexicon = spark.sparkContext.broadcast(Lexicon(learn_lexicon(known.filter(fold > 0))))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([features(t, lexicon.value) for t in texts_of(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("fold"), x], ["doc_id", "y", "fold", "x"])

    kept = known.select("doc_id", "y", fold.cast("int").alias("fold"), "text")
    kept = kept.mapInArrow(measured, "doc_id long, y int, fold int, x array<double>").collect()  # at most `sample` rows
    kept.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y, fit = (np.array([r[k] for r in kept]) for k in ("x", "y", "fold"))
    fit = fit > 0
    if all(((y == label) & (fit == part)).any() for label in (0, 1) for part in (True, False)):
        trees = Trees(x[fit], y[fit])
        model = (trees, Ladder(trees.margin(x[~fit]), y[~fit]))
    else:
        model = (None, float(y.mean()) if len(y) else 0.0)
    shared = spark.sparkContext.broadcast(model)

    def score(texts: list[str]) -> np.ndarray:
        trees, ladder = shared.value
        if trees is None:
            return np.full(len(texts), ladder)
        margin = trees.margin(np.array([features(t, lexicon.value) for t in texts]))
        # The ladder's ends are flat; a small share of the uncalibrated value keeps the order there.
        return np.clip(0.95 * ladder(margin) + 0.05 / (1 + np.exp(-margin)), 0, 1)

    return score


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text scores below THRESHOLD; one narrow pass after the fit.

    Null and empty texts have zero features; texts of any length are scored whole; equal texts fare alike; no rows give
    no rows.
    """
    score = fitted(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(score(texts_of(batch)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`doc_id, held_out, score, predicted` for each row of docs(doc_id, text); fitted() says what is learned.

    Null and empty texts have zero features; texts of any length are scored whole. Repeated rows score alike. No
    documents give no rows; a null doc_id isn't held out; other columns are ignored.
    """
    judge = fitted(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = judge(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
