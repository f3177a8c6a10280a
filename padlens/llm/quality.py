"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlens.llm.common import buffer_of, mix, run_hashes, slices, texts_of

#: Word buckets, vector length and entries set in an index vector.
BUCKETS, LENGTH, SET = 8192, 32, 4
#: Labelled rows that the network is fitted on, at most: those of least hash of their id.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 12, 128, 0.004, 7

_KIND = np.zeros(256, np.uint8)  # 0 white space and controls, 1 word, 2 sign
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries set in each bucket's index vector."""
    h = mix(np.arange(BUCKETS * SET, dtype=np.uint64) + np.uint64(SEED << 32)).reshape(BUCKETS, SET)
    return (h % np.uint64(LENGTH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


_PLACE, _SIGN = _index_vectors()


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and runs of signs in order, and the n + 1 offsets of each text's."""
    data, offsets = buffer_of(texts)
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts, ends = edge[:-1], edge[1:]
    keep = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    bucket = (run_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.searchsorted(starts, offsets)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vector of each bucket over the whole corpus: the sum of its neighbours' index vectors, unit length.

    Each task adds up its own split and sends at most BUCKETS rows of whole numbers, which Spark sums; the table
    has a fixed size (8192 x 32) at any input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * LENGTH)
        for batch in slices(batches, 1 << 20):
            bucket, at = tokens(texts_of(batch))
            inner = np.ones(max(len(bucket) - 1, 0), bool)
            edges = at[1:-1]
            inner[edges[(edges > 0) & (edges < len(bucket))] - 1] = False
            a, b = bucket[:-1][inner], bucket[1:][inner]
            for x, y in ((a, b), (b, a)):
                for k in range(SET):
                    total += np.bincount(x * LENGTH + _PLACE[y, k], _SIGN[y, k], BUCKETS * LENGTH)
        table = total.reshape(BUCKETS, LENGTH).astype(np.int64)
        seen = np.flatnonzero(table.any(1))
        columns = [pa.array(seen.astype(np.int32)), *(pa.array(table[seen, k]) for k in range(LENGTH))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"v{k}" for k in range(LENGTH))])

    names = [f"v{k}" for k in range(LENGTH)]
    parts = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((BUCKETS, LENGTH), np.float32)
    for row in parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect():
        out[row[0]] = row[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its word vectors, mean product of neighbours, length. Zeros if empty."""
    bucket, at = tokens(texts)
    n = np.diff(at)
    out = np.zeros((len(texts), 2 * LENGTH + 3), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        v = vectors[bucket]
        starts, size = at[full], n[full, None].astype(np.float32)
        mean = np.add.reduceat(v, starts, axis=0) / size
        out[full, :LENGTH] = mean
        out[full, LENGTH : 2 * LENGTH] = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / size - mean**2, 0))
        beside = np.append((v[1:] * v[:-1]).sum(1), 0)
        beside[at[1:][n > 0] - 1] = 0
        out[full, -3] = np.add.reduceat(beside, starts) / size[:, 0]
        same = np.append((bucket[1:] == bucket[:-1]).astype(np.float32), 0)
        same[at[1:][n > 0] - 1] = 0
        out[full, -2] = np.add.reduceat(same, starts) / size[:, 0]
    out[:, -1] = np.log1p(n) / 10
    return out


class Network:
    """Two layers: tanh units, then one logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        random = np.random.default_rng(SEED)
        order = random.permutation(len(x))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = (x - self.mean) / self.scale
        held = len(x) // 5  # for the temperature
        fit, labels = x[held:], y[held:]
        d = x.shape[1]
        self.p = [random.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS if len(fit) else 0):
            for rows in np.array_split(random.permutation(len(fit)), max(1, len(fit) // BATCH)):
                a, t = fit[rows], t + 1
                hidden = np.tanh(a @ self.p[0] + self.p[1])
                error = (1 / (1 + np.exp(-(hidden @ self.p[2] + self.p[3]))) - labels[rows]) / len(rows)
                back = np.outer(error, self.p[2]) * (1 - hidden**2)
                for k, g in enumerate((a.T @ back + 1e-4 * self.p[0], back.sum(0), hidden.T @ error, error.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= RATE * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if held:
            logit, sign = self._logit(x[:held]), 2 * y[:held] - 1
            loss = {t: np.logaddexp(0, -sign * logit / t).mean() for t in np.geomspace(0.25, 8, 61)}
            self.temperature = float(min(loss, key=loss.get))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % of).cast("int")


def labelled_sample(labels: DataFrame, label: str, held: Column, most: int) -> DataFrame:
    """At most `most` rows doc_id, y of the rows to learn from, those of least hash; bounded, so it may be broadcast."""
    rows = labels.filter(f"doc_id is not null and {label} is not null").filter(~held)
    rows = rows.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """`doc_id, y, text` of the ids chosen(doc_id, y), a row each: where an id has several texts, the least."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return known.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`doc_id, held_out, score, predicted` for each row of docs(doc_id, text).

    Labels are learned from ids whose remainder isn't 1 alone, from at most `sample` of them, one text each. Null and
    empty texts get the score of empty features; texts of any length are pooled whole. Repeated rows score alike. Without labelled rows every score comes from an
    untrained network and says nothing; no documents give no rows; a null doc_id isn't held out; other columns
    are ignored.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pooled(texts_of(batch), vectors.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array(list(x.astype(np.float64)))], ["doc_id", "y", "x"]
            )

    chosen = labelled_sample(labels, "quality", remainder("doc_id", 3) == 1, sample)
    known = labelled_texts(docs, chosen).mapInArrow(features, "doc_id long, y int, x array<double>")
    rows = sorted(known.collect(), key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), 2 * LENGTH + 3)
    network = spark.sparkContext.broadcast(Network(x, np.array([r["y"] for r in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            score = network.value.score(pooled(texts_of(batch), vectors.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score)], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
