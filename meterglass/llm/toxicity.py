"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

For each hashed n-gram, the log ratio of its (smoothed) share among toxic and among other labelled texts is taken;
ratios that could well be chance (a small z of the difference in document shares) count as zero. A logistic
regression is then fitted on the presence of the remaining n-grams, each scaled by its ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
#: Labelled texts that the model is fitted on, at most: those with the smallest hash of their id.
MOST_TRAINING_ROWS = 12_000
#: N-grams that the model keeps, at most: those with the largest z.
MOST_FEATURES = 8_192
LEAST_Z = 6.0
#: Of the squared weights: labels err, and a weak penalty would learn the errors by heart.
PENALTY = 1e-3


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, A-Z as a-z and line breaks and tabs as spaces, and the offsets of the texts in them."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = [np.concatenate([data, np.zeros(3, np.uint8)])[at + k].astype(np.uint32) for k in range(4)]
    tail = [x & 0x3F for x in b]
    two, three = (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0xF) << 12 | tail[1] << 6 | tail[2]
    four = (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]
    out = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))
    out = np.where((out >= 65) & (out <= 90), out + 32, out)
    return np.where((out == 9) | (out == 10) | (out == 13), np.uint32(32), out).astype(np.uint32), np.searchsorted(at, offsets)


def grams(points: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram of code points that starts at each place, and whether it lies inside one text."""
    n = points.size - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    h = np.full(n, 2166136261 + order, np.uint32)
    for k in range(order):
        h ^= points[k : k + n]
        h *= np.uint32(16777619)
        h ^= h >> np.uint32(15)
    inside = np.ones(n, bool)
    for e in range(1, order):  # an n-gram that starts up to order - 1 before a text's end would cross it
        at = ends[:-1] - e
        inside[at[(at >= 0) & (at < n)]] = False
    return h & np.uint32(BUCKETS - 1), inside


@dataclass
class Model:
    bias: float
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text: what its distinct kept n-grams add up to."""
        rows = len(offsets) - 1
        total = np.full(rows, self.bias)
        if self.bucket.size and data.size:
            number = np.zeros(BUCKETS, np.int32)
            number[self.bucket] = np.arange(1, self.bucket.size + 1)
            data, offsets = code_points(data, offsets)
            found = []
            for order in ORDERS:
                h, inside = grams(data, offsets[1:], order)
                f = number[h]
                at = np.flatnonzero((f > 0) & inside)
                found.append((np.searchsorted(offsets, at, side="right") - 1) * (self.bucket.size + 1) + f[at])
            row, f = np.divmod(np.unique(np.concatenate(found)), self.bucket.size + 1)
            total += np.bincount(row, self.weight[f - 1], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, usable: Column | None) -> DataFrame:
    """(text, y) of labelled keys: one label a key (the larger, if they differ) and one text (the least), MOST_TRAINING_ROWS at most."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64(key), key).limit(MOST_TRAINING_ROWS)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    known = known.select(F.col(key).alias("_key"), "y")
    return texts.join(known, "_key").groupBy("_key").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", usable: Column | None = None) -> Model:
    """Fits the model on labelled texts; rows for which `usable` (over the labels' columns) isn't true are left out.

    The texts stay with the executors, which count n-grams and pick out the kept ones; to the driver come counts of a
    bounded number of n-grams and, for each of at most MOST_TRAINING_ROWS texts, which of these it has. Without
    labelled texts of both classes, the model is the smoothed share of toxic ones alone.
    """
    rows = common.cut(training_rows(docs, labels, label, key, text, usable))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros((2, BUCKETS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in common.slices(batches, "text"):
            data, offsets = code_points(*common.utf8(batch.column(0)))
            y = batch.column(1).to_numpy()
            total += np.bincount(y, minlength=2)
            found = []
            for order in ORDERS:
                h, inside = grams(data, offsets[1:], order)
                row = np.repeat(np.arange(len(y)), np.diff(offsets))[: h.size]
                found.append(np.unique((row * BUCKETS + h)[inside]))
            row, h = np.divmod(np.unique(np.concatenate(found)), BUCKETS)
            for c in (0, 1):
                has[c] += np.bincount(h[y[row] == c], minlength=BUCKETS)
        at = np.flatnonzero(has.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(has[0, at], total[0])), pa.array(np.append(has[1, at], total[1]))], ["bucket", "clean", "toxic"])

    counts = rows.mapInArrow(counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = common.cut(counts)
    whole = counts.where("bucket = -1").first()
    n0, n1 = (whole["clean"], whole["toxic"]) if whole else (0, 0)
    prior = (n1 + 0.5) / (n0 + n1 + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not n0 or not n1:
        return Model(bias)
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(n0 + n1))
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    kept = counts.where("bucket >= 0").withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "bucket").limit(MOST_FEATURES).toPandas()
    if kept.empty:
        return Model(bias)
    kept = kept.sort_values("bucket")
    bucket = kept["bucket"].to_numpy()
    p, q = kept["toxic"].to_numpy() + 1.0, kept["clean"].to_numpy() + 1.0
    ratio = np.log((p / (n1 + 2)) / (q / (n0 + 2)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS, -1, np.int32)
        number[bucket] = np.arange(bucket.size)
        for batch in common.slices(batches, "text"):
            data, offsets = code_points(*common.utf8(batch.column(0)))
            found = []
            for order in ORDERS:
                h, inside = grams(data, offsets[1:], order)
                at = np.flatnonzero((number[h] >= 0) & inside)
                found.append((np.searchsorted(offsets, at, side="right") - 1) * bucket.size + number[h[at]])
            row, f = np.divmod(np.unique(np.concatenate(found)), bucket.size)
            packed = [f[a:b].astype(np.int16).tobytes() for a, b in zip(*(np.searchsorted(row, np.arange(len(batch)) + k) for k in (0, 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], ["y", "f"])

    sample = rows.mapInArrow(features, "y int, f binary").toPandas()
    lists = [np.frombuffer(f, np.int16) for f in sample["f"]]
    return Model(*logistic(lists, sample["y"].to_numpy().astype(float), ratio), bucket)


def logistic(lists: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY, steps: int = 300) -> tuple[float, np.ndarray]:
    """Bias and weight per n-gram of a logistic regression on presence times ratio, by accelerated gradient descent."""
    size = np.array([len(x) for x in lists])
    col = np.concatenate(lists).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    n = len(lists)
    v = ratio[col]
    forth = lambda w, b: np.bincount(row, v * w[col], minlength=n) + b
    back = lambda d: (np.bincount(col, v * d[row], minlength=ratio.size), d.sum())
    x, x0 = np.ones(ratio.size), 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        x, x0 = back(forth(x, x0) / n)
        norm = float(np.sqrt(x @ x + x0 * x0))
        x, x0 = x / norm, x0 / norm
    rate = 1 / (0.25 * 1.1 * norm + penalty)
    w, b, old_w, old_b = np.zeros(ratio.size), 0.0, np.zeros(ratio.size), 0.0
    for k in range(1, steps + 1):
        m = (k - 1) / (k + 2)
        at_w, at_b = w + m * (w - old_w), b + m * (b - old_b)
        d = (1 / (1 + np.exp(-np.clip(forth(at_w, at_b), -40, 40))) - y) / n
        old_w, old_b, (g, g0) = w, b, back(d)
        w, b = at_w - rate * (g + penalty * at_w), at_b - rate * g0
    return float(b), w * ratio


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 if score >= 0.5); columns of these names are replaced.

    Only the text is looked at, all of it. Null and empty texts get the score of a text without known n-grams.
    """
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: MOST_FEATURES weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            values = sent.value.scores(*common.utf8(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, "score"])

    return docs.mapInArrow(scored, common.plus(docs, "score double")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    """Rows that learning leaves out: the checksum of the key as text is divisible by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
