"""Toxicity score by a character n-gram linear classifier with naive Bayes features (operator 4).

A text's features are the hashed character n-grams that it has. Each is scaled by its naive Bayes log-count ratio
between the two labels, and a logistic regression is trained on the scaled features. The classifier is fitted on at
most ``FIT_ROWS`` different labelled documents, chosen by hashes of doc_id and text; scores are made for every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

ORDERS = (3, 4, 5, 6)
#: N-grams are hashed to 2 ** BITS features.
BITS = 18
#: Bound of the labelled documents that the classifier is fitted on.
FIT_ROWS = 12_000
#: Features that are kept by default: those whose presence says most about the label in the fitted documents.
KEPT = 4096
#: Fitted documents of one task.
TASK_ROWS = 1500
SMOOTHING = 1.0
PENALTY = 1e-5
PASSES = 300


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: its code-point n-grams in lower case, spaces at both ends."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), "<u4").astype(np.uint32)
    found, total = [], codes + np.uint32(1)
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            break
        total = total[:len(codes) - order + 1] * np.uint32(0x01000193) + codes[order - 1:]
        if order in ORDERS:
            salted = (total ^ np.uint32(0x9E3779B9 * order & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            salted ^= salted >> np.uint32(13)
            found.append((salted * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    if not found:
        return np.empty(0, np.uint32)
    every = np.sort(np.concatenate(found))
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


@dataclass
class Model:
    """``weights``: of all features, log-count ratio times trained weight, zero where a feature is not kept."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        margin = self.bias + float(self.weights[features(text)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def held_out(key: str) -> Column:
    """True for the rows whose labels are never learned."""
    return F.expr(f"crc32(cast(cast(`{key}` as string) as binary)) % 5 = 0")


def _training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, fit_rows: int) -> DataFrame:
    """label and text of the fitted documents: at most ``fit_rows``, equal rows once, however often a doc_id repeats."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.col(label)).cast("int").alias("label")).where(~F.expr("crc32(cast(cast(id as string) as binary)) % 5 = 0"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    met = given.select("id", "digest").join(F.broadcast(chosen), "id").distinct()
    taken = met.orderBy(F.xxhash64("id"), "id", F.xxhash64("digest"), "digest").limit(fit_rows)
    rows = given.join(F.broadcast(taken), ["id", "digest"])
    rows = rows.groupBy("id", "digest").agg(F.first("label").alias("label"), F.first("text").alias("text"))
    # the rows are bounded, so are their tasks: each of these counts all features once
    return rows.select("label", "text").coalesce(max(1, -(-fit_rows // TASK_ROWS)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label, of one task: two vectors of fixed size."""
    counts, rows = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[int(label > 0), features(text)] += 1
            rows[int(label > 0)] += 1
    if rows.sum():
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[0, at], rows[0]), pa.int64()),
             pa.array(np.append(counts[1, at], rows[1]), pa.int64())], ["feature", "n0", "n1"])


def _kept(kept: np.ndarray):
    """Of each document's features, the positions of kept ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            rows = [found[found >= 0] for found in (place[features(t)] for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))],
                                             ["label", "features"])

    return run


def _regression(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled presence features, by accelerated gradient steps."""
    sizes = np.array([len(r) for r in rows])
    owner, at = np.repeat(np.arange(len(rows)), sizes), np.concatenate(rows).astype(np.int64)
    scale = 1 / np.sqrt(max(1.0, float(np.mean(np.bincount(owner, weights=ratios[at] ** 2, minlength=len(rows))))))
    weights, bias, ahead, ahead_bias = np.zeros(len(ratios)), 0.0, np.zeros(len(ratios)), 0.0
    step = 4.0
    for turn in range(PASSES):
        margin = ahead_bias + scale * np.bincount(owner, weights=(ahead * ratios)[at], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels) / len(rows)
        slope = scale * np.bincount(at, weights=error[owner], minlength=len(ratios)) * ratios + PENALTY * ahead
        new, new_bias = ahead - step * slope, ahead_bias - step * error.sum()
        pull = turn / (turn + 3)
        ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
        weights, bias = new, new_bias
    return scale * weights, bias


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        fit_rows: int = FIT_ROWS, kept_features: int = KEPT) -> Model:
    """Fit on labelled documents outside the held-out fifth; of several labels of a doc_id the highest counts.

    ``fit_rows`` bounds the documents that are learned from, ``kept_features`` the features that get a weight.

    Null texts are empty texts; rows with a null label or key teach nothing. Without labelled documents of both kinds
    the model scores every text as the label that there is (as 0 if there is none).
    """
    rows = saved(_training_rows(docs, labels, text, key, label, fit_rows))
    met = rows.mapInArrow(_counted, "feature int, n0 long, n1 long").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most 2 ** BITS + 1 rows
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[:, met["feature"].to_numpy()] = met["n0"].to_numpy(), met["n1"].to_numpy()
    total, counts = counts[:, -1], counts[:, :-1]
    share = float(total[1] / total.sum()) if total.sum() else 0.0
    if not total.all():
        return Model(np.zeros(1 << BITS), 30.0 if share == 1 else -30.0)
    shares = (counts + SMOOTHING) / (total[:, None] + 2 * SMOOTHING)
    ratios = np.log(shares[1] / shares[0])
    gain = np.abs(shares[1] - shares[0]) * np.abs(ratios)
    kept = np.sort(np.argsort(-gain, kind="stable")[:kept_features])
    # at most fit_rows x kept_features numbers, which as Python's would take ten times the driver's memory
    found = rows.mapInArrow(_kept(kept), "label int, features array<int>").toArrow()
    given = [r.values.to_numpy() for r in found["features"]]
    weights, bias = _regression(given, (found["label"].to_numpy() > 0).astype(float), ratios[kept])
    out = np.zeros(1 << BITS)
    out[kept] = weights * ratios[kept]
    return Model(out, float(bias))


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every row. A null text is empty; other columns are not read.

    A null doc_id counts as not held out. Repeated rows each get their row; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*shared.value)
        for batch in batches:
            scores = [learned.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"),
                        F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").select(
        "*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
