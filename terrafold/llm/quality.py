"""Quality by attention-based multiple-instance learning.

A document is a bag of passages: runs of PASSAGE words, the last one shorter, over its whole text. A passage is
encoded from measurements of its bytes and words (letters, capitals, digits, symbols, repeated words, word lengths,
sentence marks) by a small tanh layer. A gated attention network, learned from document labels alone, weighs the
passages; the score is a logistic function of the weighted mean of their codes.

Empty, blank and null texts have one passage of zeros and get its score. With no usable labels of both kinds every
score is the labels' share, or 0.5. Rows that repeat, and ties of text, score alike; a null doc_id stays null and is never held out. A
very long text is a bag of many passages, in one block of its own. Other columns of any name are ignored (good_documents keeps them).
An empty table gives an empty result.

The network is fitted in one task on a bounded sample of labelled rows: SAMPLE_EACH documents of either label, SAMPLE_BYTES of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, row_blocks, tidy, utf8
from .training import adam, fit_in_task, fold

#: Labelled documents of either label that the network is fitted on, at most.
SAMPLE_EACH = 2000
PASSAGE = 32
CODE = 24
GATE = 12

_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "high": [*range(128, 256)], "stop": [ord(c) for c in ".?"], "comma": [ord(c) for c in ",;:"],
    "exclaim": [ord("!")], "bar": [ord(c) for c in "|\\/<>{}[]=_~^"], "symbol": [ord(c) for c in "*%&$#@+"], "quote": [ord(c) for c in "\"'()-`"],
}
_CLASS_OF = np.full(256, len(_CLASSES))
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[_bytes] = _k
FEATURES = len(_CLASSES) + 10


def passages(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Measurements of each passage of rows i..j, and each row's bounds among the passages (at least one a row)."""
    words = Words(raw, offsets, i, j)
    counts = np.diff(words.bounds)
    many = np.maximum(1, -(-counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(j - i), many)
    place = np.arange(bounds[-1]) - bounds[row]
    first = words.bounds[row] + place * PASSAGE
    last = np.minimum(first + PASSAGE, words.bounds[row + 1])
    n = (last - first).astype(float)
    out = np.zeros((len(row), FEATURES))
    if not len(words):
        return out, bounds
    safe = np.maximum(n, 1)
    lo, hi = words.starts[np.minimum(first, len(words) - 1)], np.where(n > 0, words.ends[np.maximum(last, 1) - 1], 0)
    hi = np.maximum(hi, lo)
    kind = _CLASS_OF[words.bytes]
    size = np.maximum(hi - lo, 1).astype(float)
    for k in range(len(_CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        out[:, k] = (sums[hi] - sums[lo]) / size

    def mean(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(flags, dtype=float)])
        return (sums[last] - sums[first]) / safe

    hashes, length = words.hashes(), (words.ends - words.starts).astype(float)
    begin = np.zeros(len(words) + 1, bool)
    begin[words.bounds] = True
    for step in (1, 2, 3):
        same = np.zeros(len(words), bool)
        same[step:] = hashes[step:] == hashes[:-step]
        out[:, len(_CLASSES) + step - 1] = mean(same & ~begin[:-1])
    ends = kind[words.ends - 1]
    k = len(_CLASSES) + 3
    out[:, k] = mean(length) / 8
    out[:, k + 1] = np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 8
    out[:, k + 2] = mean((ends >= 4) & (ends <= 9))
    out[:, k + 3] = mean((kind[words.starts] == 0) & (kind[np.minimum(words.starts + 1, len(kind) - 1)] == 0))
    out[:, k + 4] = np.log1p(n) / np.log1p(PASSAGE)
    feeds = np.concatenate([[0], np.cumsum(words.bytes == 10)])
    out[:, k + 5] = (feeds[hi] - feeds[lo]) / safe
    # distinct words of a passage: order its word hashes
    cell = np.repeat(np.arange(len(row)), last - first)
    order = np.lexsort((hashes, cell))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (cell[order][1:] != cell[order][:-1])
    out[:, k + 6] = np.bincount(cell, fresh, len(row)) / safe
    out[n == 0] = 0
    return out, bounds


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    encode: np.ndarray
    encode0: np.ndarray
    look: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    judge: np.ndarray
    judge0: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.encode, self.encode0, self.look, self.gate, self.weigh, self.judge, self.judge0]


def forward(net: Network, x: np.ndarray, bounds: np.ndarray) -> dict:
    """Scores of bags of passages, with what the gradients need; attention sums to 1 within a bag."""
    x = np.clip((x - net.mean) / net.spread, -6, 6)
    code = np.tanh(x @ net.encode + net.encode0)
    look, gate = np.tanh(code @ net.look), 1 / (1 + np.exp(-(code @ net.gate)))
    raw = (look * gate) @ net.weigh
    starts, counts = bounds[:-1], np.diff(bounds)
    e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), counts))
    attention = e / np.repeat(np.add.reduceat(e, starts), counts)
    bag = np.add.reduceat(code * attention[:, None], starts)
    z = bag @ net.judge + net.judge0[0]
    return {"x": x, "code": code, "look": look, "gate": gate, "attention": attention, "bag": bag, "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}


def _gradients(net: Network, made: dict, bounds: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    counts = np.diff(bounds)
    dz = (made["score"] - y) / len(y)
    dbag = np.repeat(dz[:, None] * net.judge, counts, axis=0)
    code, attention, look, gate = made["code"], made["attention"], made["look"], made["gate"]
    dattention = (dbag * code).sum(1)
    mean = np.repeat(np.add.reduceat(dattention * attention, bounds[:-1]), counts)
    draw = attention * (dattention - mean)
    dmix = draw[:, None] * net.weigh
    dlook, dgate = dmix * gate * (1 - look**2), dmix * look * gate * (1 - gate)
    dcode = dbag * attention[:, None] + dlook @ net.look.T + dgate @ net.gate.T
    dpre = dcode * (1 - code**2)
    return [made["x"].T @ dpre, dpre.sum(0), code.T @ dlook, code.T @ dgate, (look * gate).T @ draw, made["bag"].T @ dz, np.array([dz.sum()])]


def train(texts: list[str], y: np.ndarray, odds: float = 1.0, seed: int = 3, epochs: int = 40) -> Network | float:
    """A network, or a constant score where labels are of one kind."""
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    bags: list[np.ndarray] = []
    for i, j in row_blocks(offsets):
        x, bounds = passages(raw, offsets, i, j)
        bags += [x[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    net = Network(
        everything.mean(0), everything.std(0) + 1e-3, rng.normal(0, 0.3, (FEATURES, CODE)), np.zeros(CODE), rng.normal(0, 0.3, (CODE, GATE)), rng.normal(0, 0.3, (CODE, GATE)),
        rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, CODE), np.zeros(1),
    )
    parameters = net.parameters()
    move = adam(parameters, 0.02)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x = np.concatenate([bags[k] for k in pick])
            bounds = np.concatenate([[0], np.cumsum([len(bags[k]) for k in pick])])
            made = forward(net, x, bounds)
            move([g + 1e-4 * p for g, p in zip(_gradients(net, made, bounds, y[pick]), parameters)])
    net.judge0 += np.log(odds)
    return net


def _scored(net: Network, column: pa.Array):
    """(scores, passages, bounds, attention) of each block of a text column's rows."""
    raw, offsets = utf8(column)
    for i, j in row_blocks(offsets):
        x, bounds = passages(raw, offsets, i, j)
        made = forward(net, x, bounds)
        yield np.round(made["score"], 8), bounds, made["attention"]  # equal texts get equal scores wherever they stand


def score_documents(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id, score, and the passage the network looks at most: its number and attention."""
    if isinstance(net, float):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(net).alias("score"), F.lit(0).alias("passage"), F.lit(1.0).alias("attention"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            scores, top, weight = [np.zeros(0)], [np.zeros(0, np.int32)], [np.zeros(0)]
            for score, bounds, attention in _scored(known, batch.column(1)):
                scores.append(score)
                best = np.maximum.reduceat(attention, bounds[:-1])
                hit = np.flatnonzero(attention == np.repeat(best, np.diff(bounds)))
                row = np.searchsorted(bounds, hit, side="right") - 1
                first = np.searchsorted(row, np.arange(len(score)))
                top.append((hit[first] - bounds[:-1]).astype(np.int32))
                weight.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(v)) for v in (scores, top, weight))], ["doc_id", "score", "passage", "attention"])
            tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double, passage int, attention double")


def good_documents(docs: DataFrame, net: Network | float, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; rows stay where they are."""
    if isinstance(net, float):
        return docs.filter(F.lit(net >= threshold))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        scores = np.concatenate([np.zeros(0), *(s for s, *_ in _scored(shared.value, column))])
        tidy()
        return pa.array(scores)

    return docs.filter(score(F.col("text").cast("string")) >= threshold)


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Network | float:
    return fit_in_task(docs, labels, "quality", each, train)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, passage and attention of every document, from a network fitted on the labelled folds."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passage", "attention")
