"""Quality classifier: a Naive Bayes support vector machine (operator 3).

After Wang and Manning ("Baselines and Bigrams", 2012): indicators of hashed n-grams are scaled by the log-count
ratio of the classes, and a linear model with hinge loss is fitted to them by dual coordinate descent (Hsieh et al., 2008).
A sigmoid fitted on rows that the descent doesn't see turns margins into scores.

The n-grams are the character trigrams of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topspin.llm.shared import by_bytes

BITS = 17
FEATURES = 1 << BITS
#: Rows that the model is fitted on at most, those with the smallest hash of the id. More change the scores little.
FIT_ROWS = 6000


def features(text: str | None) -> np.ndarray:
    """The features present in a text, sorted. Null counts as empty, which has none."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    padded = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    hashed = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA6B) + padded[2:] * np.uint32(0xC2B2AE35)
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    present = np.zeros(FEATURES, bool)
    present[hashed >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(present).astype(np.uint32)


def class_counts(labelled: DataFrame) -> np.ndarray:
    """In how many texts of each class a feature is, over all rows ``(text, good)``: row 0 for class 0, row 1 for class 1.

    A task sends one row for each feature that it met; what comes back has at most ``FEATURES`` rows at any size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, FEATURES), np.int64)
        for batch in by_bytes(batches, "text"):
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
                held[good, features(text)] += 1
        met = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(held[0, met]), pa.array(held[1, met])], names=["feature", "bad", "good"])

    found = labelled.select("text", "good").mapInArrow(count, "feature int, bad long, good long")
    found = found.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    counts = np.zeros((2, FEATURES), np.int64)
    counts[:, found.column("feature").to_numpy()] = [found.column("bad").to_numpy(), found.column("good").to_numpy()]
    return counts


def log_count_ratio(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Logarithm of the ratio of the smoothed and normed feature counts of both classes."""
    bad, good = counts + smoothing
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, size: int, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """Weights that minimise ``|w|^2 / 2 + sum costs * hinge``; ``rows`` and ``values`` are sparse vectors."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([v @ v for v in values]) if rows else np.zeros(0)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            if not norms[i]:
                continue
            gradient = signs[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                largest = max(largest, abs(new - alpha[i]) * norms[i])
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


def sigmoid_fit(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid with the least log loss, by Newton's method with Platt's targets; the slope is positive."""
    n = [(good == 0).sum(), (good == 1).sum()]
    target = np.where(good == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        q, e = p * (1 - p), p - target
        h = np.array([[q @ (margins * margins) + 1e-3, q @ margins], [q @ margins, q.sum() + 1e-3]])
        step = np.linalg.solve(h, [e @ margins + 1e-3 * (a - 1), e.sum() + 1e-3 * b])
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass(frozen=True)
class Model:
    weights: bytes
    slope: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        w = np.frombuffer(self.weights, np.float32)
        margins = []
        for t in texts:
            row = features(t)
            margins.append(float(w[row].sum()) / math.sqrt(len(row) or 1) + float(w[-1]))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.array(margins) + self.offset, -700, 700)))


def fit(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray) -> Model:
    """A model of the rows, scaled by ``ratio``; with fewer than two classes it gives the share of good rows (a half if there are none)."""
    size = FEATURES + 1
    share = (good.sum() + 1) / (len(good) + 2)
    if len(set(good.tolist())) < 2:
        return Model(np.zeros(size, np.float32).tobytes(), 1.0, float(np.log(share / (1 - share))))
    last = np.array([size - 1])
    indexes = [np.concatenate([r, last]) for r in rows]
    values = [np.append(ratio[r] / math.sqrt(len(r) or 1), 1.0) for r in rows]
    signs = np.where(good == 1, 1.0, -1.0)
    costs = np.where(good == 1, len(good) / (2 * good.sum()), len(good) / (2 * (len(good) - good.sum())))
    own = np.arange(len(rows)) % 5 != 4
    if len(set(good[own].tolist())) < 2 or own.all():
        own[:] = True
    pick = np.flatnonzero(own)
    w = dual_coordinate_descent([indexes[i] for i in pick], [values[i] for i in pick], signs[pick], costs[pick], size)
    margins = np.array([w[i] @ v for i, v in zip(indexes, values, strict=True)])
    rest = ~own if not own.all() else own
    slope, offset = sigmoid_fit(margins[rest], good[rest])
    weights = w.copy()
    weights[:-1] *= ratio
    return Model(weights.astype(np.float32).tobytes(), slope, offset)


def held_out(id_column: str | Column) -> Column:
    """The fold that nothing is learnt from: the CRC-32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit to the labelled documents outside the held-out fold.

    The class counts behind the ratios are taken over all of them; the descent runs over ``fit_rows`` at most. The sample's
    ids (and nothing else) are broadcast; its features are computed where the documents are, and one task fits. Labels other
    than 0 and 1 and null ids are left out; of several labels for an id the least counts. Of several documents with one id
    all count for the ratios, and the one with the least features is fitted.
    """
    rows = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    rows = rows.groupBy(F.col(id_column).alias("key")).agg(F.min(label_column).cast("int").alias("good"))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(fit_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("good"), pa.array(found, pa.binary())], names=["key", "good", "present"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = pd.concat([pd.DataFrame({"key": [], "good": [], "present": []}), *(b.to_pandas() for b in batches)]).sort_values("key")
        model = fit([np.frombuffer(x, np.uint32) for x in frame["present"]], frame["good"].to_numpy(np.int64), ratio)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights]), pa.array([model.slope]), pa.array([model.offset])], names=["weights", "slope", "offset"])

    texts = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    # shuffled at any size: labels grow with the corpus, and their side of a partition is the small one to hold
    labelled = texts.where(~held_out("key")).join(rows.hint("shuffle_hash"), "key")
    ratio = log_count_ratio(class_counts(labelled))
    kind = texts.schema["key"].dataType.simpleString()
    found = texts.join(F.broadcast(sample), "key").select("key", "good", "text").mapInArrow(extract, f"key {kind}, good int, present binary")
    found = found.groupBy("key", "good").agg(F.min("present").alias("present"))
    first = found.repartition(1).mapInArrow(learn, "weights binary, slope double, offset double").first()
    return Model(bytes(first.weights), first.slope, first.offset)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: more likely good) and ``predicted`` (1 from a half on).

    Only the text goes into a score; null counts as empty. The other columns of ``docs`` stay, but for clashing ones, which the
    results replace. Nothing is shuffled.
    """

    @F.pandas_udf("double")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return docs.withColumn("score", of_text(F.col(text_column).cast("string"))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
