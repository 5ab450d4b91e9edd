"""Bounded, repeatable samples of labelled documents for the two classifiers."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: UTF-8 bytes of labelled text that a classifier is fitted on, at most.
SAMPLE_BYTES = 64 << 20


def fold(doc_id: Column) -> Column:
    """The document's fold: crc32 of its id as text, modulo 5. Fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, seed: int = 11) -> tuple[DataFrame, dict[int, int]]:
    """(y, text, place) of at most `each` labelled documents of either label, never of the held-out fold, and how many usable documents each label has.

    The first `each` ids of a label in the order of a hash, so reruns take the same rows; only ids and counts reach
    the driver. Null labels and ids take no part; an id with both labels may come with either.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    present = usable.filter("y IN (0, 1)").join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen, place = [], F.xxhash64(F.lit(seed), "doc_id").alias("place")
    for value in (0, 1):
        chosen += [(r["doc_id"], value, r["place"]) for r in present.filter(F.col("y") == value).select("doc_id", place).distinct().orderBy("place", "doc_id").limit(each).collect()]
    have = {r["y"]: r["count"] for r in present.groupBy("y").count().collect()}
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int, place long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(wanted), "doc_id").select("y", "text", "place", "doc_id"), have


def fit_in_task(docs: DataFrame, labels: DataFrame, label: str, each: int, train: Callable, most_bytes: int = SAMPLE_BYTES):
    """A model that `train(texts, y, odds)` returns, fitted in one task on the sample; the driver gets the model alone.

    Equal texts count once. Of either label, texts are taken in sample order while they come to at most half of
    `most_bytes` UTF-8 bytes (a text that would pass the bound is left out of the sample, shorter ones after it aren't).
    odds: those of label 1 among all usable labels, over those in the sample.
    """
    texts, have = sample(docs, labels, label, each)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, held, seen = [], [0, 0], set()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                key = hashlib.sha1(data).digest()
                if key in seen or held[y] + len(data) > most_bytes // 2:
                    continue
                seen.add(key)
                held[y] += len(data)
                taken.append((data.decode(), y))
        y = np.array([t[1] for t in taken], float)
        odds = (have.get(1, 0) + 1) / (have.get(0, 0) + 1) / ((y.sum() + 1) / (len(y) - y.sum() + 1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t[0] for t in taken], y, odds))], pa.binary())], ["model"])
        taken.clear()
        tidy()

    made = texts.repartition(1).sortWithinPartitions("place", "doc_id", "y", "text").select("y", "text").mapInArrow(work, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0), 1.0)


def adam(parameters: list[np.ndarray], rate: float):
    """Returns a step function that takes gradients and moves the parameters in place."""
    m, v, t = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], [0]

    def step(gradients: list[np.ndarray]) -> None:
        t[0] += 1
        for p, g, a, b in zip(parameters, gradients, m, v):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9 ** t[0])) / (np.sqrt(b / (1 - 0.999 ** t[0])) + 1e-8)

    return step


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression (last: the constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w
