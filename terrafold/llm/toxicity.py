"""Toxicity by a linear-chain conditional random field over words.

Tokens are words without outer punctuation, A-Z in lower case. Each has a binary tag, toxic or not; a tag's score
comes from hashed features (the word, its first and last letters, the words beside it, its shape) and from the tag before
it. The field is trained on tokens labelled from labelled documents: a word is a toxic token where it stands in a
document labelled toxic and it, its beginning or its ending is many times likelier in those than in others. Marginals come from the
forward-backward recursion; a document's score is a logistic function of how many toxic tokens its marginals expect
and of the largest marginal, fitted on the same sample. Tokens with a marginal of 0.5 or more form the spans.

All documents of a block lie on one line of tokens: a start tag that ignores its predecessor separates them. The line
is cut in lanes of equal length; products of 2x2 steps give each lane its entry values, so the recursion runs
over all lanes at once and is still exact, however long a document is.

The field is fitted in one task on a bounded sample of labelled rows (SAMPLE_EACH documents of either label, SAMPLE_BYTES of
text), each document whole.

Empty, blank and null texts score as documents without toxic tokens. With no usable labels of both kinds every score
is 0. Rows that repeat, and ties of text, score alike; a null doc_id stays null and is never held out. A very long text is a block of
its own. Other columns of any name are ignored (calm_documents keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_HASH_LOWER, Words, mix64, prefix_hash, row_blocks, span_hash, tidy, utf8
from .training import adam, fit_in_task, fold, logistic

#: Labelled documents of either label that the field is fitted on, at most.
SAMPLE_EACH = 1200
BUCKETS = 1 << 18
#: Bytes of a word's beginnings and endings that are features.
HEADS, TAILS = (3, 4, 5, 6), (3, 4)
#: A feature marks toxic tokens if (its toxic documents) * log(how many times likelier it is there) reaches this.
EVIDENCE, TIMES = 18.0, 12.0
LANE = 64
#: Tokens of a training step, at least and at most (a 64th of the sample's in between); documents are never cut.
STEP_TOKENS = 1_024, 16_384
SHAPES = 16


@dataclass
class Field:
    weight: np.ndarray
    shape: np.ndarray
    steps: np.ndarray  # scores of tag pairs: (from, to)
    start: np.ndarray
    document: np.ndarray

    def __getstate__(self):
        return self.__dict__ | {"weight": self.weight.astype(np.float32)}


def tokens(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[Words, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Words, trimmed spans, shape classes, and hashes of rows i..j: a row for the words, one for each beginning and ending (0: none)."""
    words = Words(raw, offsets, i, j)
    starts, ends = words.trimmed()
    prefix = prefix_hash(BYTE_HASH_LOWER[words.bytes])
    size = ends - starts
    hashes = np.zeros((1 + len(HEADS) + len(TAILS), len(words)), np.uint64)
    hashes[0] = span_hash(prefix, starts, ends)
    for k, n in enumerate((*HEADS, *TAILS), 1):
        at = np.flatnonzero(size > n)
        a, b = (starts[at], starts[at] + n) if k <= len(HEADS) else (ends[at] - n, ends[at])
        hashes[k, at] = span_hash(prefix, a, b) ^ np.uint64(k << 40)
    upper = np.concatenate([[0], np.cumsum((words.bytes >= 65) & (words.bytes <= 90))])
    other = np.concatenate([[0], np.cumsum(~ALNUM[words.bytes])])
    shape = np.minimum(upper[ends] - upper[starts], 2) + 3 * (size > 2) + 6 * ((other[words.ends] - other[words.starts]) > 1)
    return words, (starts, ends), shape, hashes


def buckets(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight buckets: a row for each kind of feature, then the word before and the word after; bucket 0 stands for none."""
    own = (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    own[hashes == 0] = 0
    beside = ((hashes[0] ^ np.uint64(0xB5297A4D)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, ((hashes[0] ^ np.uint64(0x68E31DA4)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    before, after = np.zeros_like(own[0]), np.zeros_like(own[0])
    before[1:] = beside[0][:-1]
    before[first] = 0
    after[:-1] = beside[1][1:]
    after[:-1][first[1:]] = 0
    return np.concatenate([own, before[None], after[None]])


def marginals(score: np.ndarray, first: np.ndarray, steps: np.ndarray, start: np.ndarray, lane: int = LANE, forward: bool = False):
    """P(toxic) of every token, and if asked for P(toxic) given the tokens so far: score is the toxic tag's lead, first marks a document's first token."""
    n = len(score)
    if not n:
        return (np.zeros(0), np.zeros(0)) if forward else np.zeros(0)
    width = -(-n // lane)
    e = np.ones(width * lane)
    e[:n] = np.exp(np.clip(score, -30, 30))
    new = np.ones(width * lane, bool)
    new[:n] = first
    e, new = e.reshape(width, lane), new.reshape(width, lane)
    a, s = np.exp(steps), np.exp(start)
    # step(t) maps (not toxic, toxic) weights before t to those at t, with t's own score
    t00, t10 = np.where(new, s[0], a[0, 0]), np.where(new, s[0], a[1, 0])
    t01, t11 = np.where(new, s[1], a[0, 1]) * e, np.where(new, s[1], a[1, 1]) * e

    # each lane's product of steps
    p00, p01, p10, p11 = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(lane):
        m00, m01, m10, m11 = t00[:, t], t01[:, t], t10[:, t], t11[:, t]
        p00, p01, p10, p11 = p00 * m00 + p01 * m10, p00 * m01 + p01 * m11, p10 * m00 + p11 * m10, p10 * m01 + p11 * m11
        scale = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
    p = [x.tolist() for x in (p00, p01, p10, p11)]
    x0, x1, into0, into1 = 0.5, 0.5, [], []
    for a00, a01, a10, a11 in zip(*p):
        into0.append(x0)
        into1.append(x1)
        x0, x1 = x0 * a00 + x1 * a10, x0 * a01 + x1 * a11
        total = x0 + x1
        x0, x1 = x0 / total, x1 / total
    f = np.empty((lane, width))
    x0, x1 = np.array(into0), np.array(into1)
    for t in range(lane):
        x0, x1 = x0 * t00[:, t] + x1 * t10[:, t], x0 * t01[:, t] + x1 * t11[:, t]
        f[t] = x1 / (x0 + x1)
        x0, x1 = 1 - f[t], f[t]
    # backward, with the same steps: b(t) = T(t+1) b(t+1); lane products as above give a lane's b at its start
    b0, b1 = 1.0, 1.0
    out0, out1 = [1.0] * width, [1.0] * width
    for k in range(width - 1, -1, -1):
        out0[k], out1[k] = b0, b1
        a00, a01, a10, a11 = p[0][k], p[1][k], p[2][k], p[3][k]
        b0, b1 = a00 * b0 + a01 * b1, a10 * b0 + a11 * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    b0, b1 = np.array(out0), np.array(out1)
    q = np.empty((width, lane))
    for t in range(lane - 1, -1, -1):
        hit = f[t] * b1
        q[:, t] = hit / (hit + (1 - f[t]) * b0)
        b0, b1 = t00[:, t] * b0 + t01[:, t] * b1, t10[:, t] * b0 + t11[:, t] * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return (q.reshape(-1)[:n], f.T.reshape(-1)[:n]) if forward else q.reshape(-1)[:n]


def _document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: log of 1 + expected toxic tokens, log odds that any is toxic (bounded), share of toxic tokens."""
    sums = np.concatenate([[0], np.cumsum(p)])
    expected = sums[bounds[1:]] - sums[bounds[:-1]]
    logs = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-6)))])
    none = np.minimum(logs[bounds[1:]] - logs[bounds[:-1]], -1e-9)
    any_ = np.clip(np.log(-np.expm1(none)) - none, -12, 12)
    return np.column_stack([np.log1p(np.maximum(expected, 0)), any_, np.sqrt(np.maximum(expected, 0) / np.maximum(np.diff(bounds), 1))])


def _lexicon(documents: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashes of features that mark toxic tokens, sorted."""
    count = [0, 0]
    found: list[list[np.ndarray]] = [[], []]
    seen: set[int] = set()
    for d, t in zip(documents, y.astype(int).tolist()):
        # near copies count once: texts whose smallest hash of three words in a row agrees
        run = mix64(d[0][:-2] * np.uint64(3) + d[0][1:-1] * np.uint64(5) + d[0][2:] * np.uint64(7)) if d.shape[1] > 2 else d[0]
        least = int(run.min()) if len(run) else 0
        if least in seen or not d.size:
            continue
        seen.add(least)
        count[t] += 1
        found[t].append(np.unique(d[d != 0]))
    if not all(found):
        return np.zeros(0, np.uint64)
    values, counts = np.unique(np.concatenate(found[1]), return_counts=True)
    others, other_counts = np.unique(np.concatenate(found[0]), return_counts=True)
    at = np.minimum(np.searchsorted(others, values), len(others) - 1)
    elsewhere = np.where(others[at] == values, other_counts[at], 0)
    ratio = (counts / count[1]) / ((elsewhere + 0.5) / count[0])
    return values[(ratio >= TIMES) & (counts >= 3) & (counts * np.log(np.maximum(ratio, 1)) >= EVIDENCE)]


def train(texts: list[str], y: np.ndarray, odds: float = 1.0, seed: int = 5, epochs: int = 4) -> Field | None:
    if not len(y) or y.min() == y.max():
        return None
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    documents, shapes = [], []
    for i, j in row_blocks(offsets):
        words, _, shape, hashes = tokens(raw, offsets, i, j)
        for r in range(j - i):
            documents.append(hashes[:, words.bounds[r] : words.bounds[r + 1]])
            shapes.append(shape[words.bounds[r] : words.bounds[r + 1]])
    lexicon = _lexicon(documents, y)
    rng = np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for k, t in enumerate(y):
        d, n = documents[k], documents[k].shape[1]
        documents[k] = None
        if n:
            first = np.arange(n) == 0
            rows.append((buckets(d, first).astype(np.int32), shapes[k], np.isin(d, lexicon).any(0) & bool(t), first))
    field = Field(np.zeros(BUCKETS), np.zeros(SHAPES), np.zeros((2, 2)), np.zeros(2), np.zeros(0))
    field.shape[:] = -2.0
    move = adam([field.weight, field.shape, field.steps, field.start], 0.05)
    for _ in range(epochs):
        for some in _steps(rows, rng.permutation(len(rows))):
            own, sh, tag, first = (np.concatenate(x, axis=-1) for x in zip(*some))
            many = max(1.0, len(tag) / 32)
            score = field.weight[own].sum(0) + field.shape[sh]
            p, pairs, starts = _expectations(score, first, field.steps, field.start)
            gap = (p - tag) / many
            tag = tag.astype(int)
            seen = np.zeros((2, 2))
            inner = np.flatnonzero(~first)
            np.add.at(seen, (tag[inner - 1], tag[inner]), 1)
            gradient = np.bincount(own.reshape(-1), np.tile(gap, len(own)), BUCKETS)
            gradient[0] = 0
            move([gradient + 2e-5 * field.weight, np.bincount(sh, gap, SHAPES) + 1e-4 * field.shape, (pairs - seen) / many + 1e-4 * field.steps, (starts - np.bincount(tag[first], minlength=2)) / many + 1e-4 * field.start])
    x = np.concatenate([_document_features(p, words.bounds) for p, words, _ in _tagged(raw, offsets, field)])
    field.document = logistic(x, y)
    field.document[-1] += np.log(odds)
    return field


def _steps(rows: list, order: np.ndarray):
    """Whole documents in the given order, so many a step that they come to its tokens (a longer one alone)."""
    some, held, most = [], 0, min(max(sum(len(r[1]) for r in rows) // 64, STEP_TOKENS[0]), STEP_TOKENS[1])
    for k in order.tolist():
        n = len(rows[k][1])
        if some and held + n > most:
            yield some
            some, held = [], 0
        some.append(rows[k])
        held += n
    if some:
        yield some


def _expectations(score, first, steps, start):
    """Marginals, expected tag pairs and expected start tags."""
    p, forward = marginals(score, first, steps, start, forward=True)
    inner = np.flatnonzero(~first)
    # P(x before y, y) = P(y) P(x before | y), and the latter needs the forward values alone
    into = np.stack([1 - forward[inner - 1], forward[inner - 1]], 1)[:, :, None] * np.exp(steps)
    pairs = into / into.sum(1, keepdims=True) * np.stack([1 - p[inner], p[inner]], 1)[:, None, :]
    at = p[first]
    return p, pairs.sum(0), np.array([np.sum(1 - at), np.sum(at)])


def _tagged(raw: np.ndarray, offsets: np.ndarray, field: Field):
    """Marginals, words and trimmed spans of each block of rows."""
    for i, j in row_blocks(offsets):
        words, spans, shape, hashes = tokens(raw, offsets, i, j)
        first = np.zeros(len(words) + 1, bool)
        first[words.bounds[:-1]] = True
        first = first[:-1]
        score = field.shape[shape]
        if len(words):
            for row in buckets(hashes, first):
                score = score + field.weight[row]
        yield marginals(score, first, field.steps, field.start), words, spans


def _scored(field: Field, column: pa.Array):
    """(scores, marginals, words, spans) of each block of a text column's rows."""
    raw, offsets = utf8(column)
    for p, words, spans in _tagged(raw, offsets, field):
        x = _document_features(p, words.bounds)
        # sums round differently by a text's place in its block: that stays below the digits kept
        yield np.round(1 / (1 + np.exp(-np.clip(x @ field.document[:-1] + field.document[-1], -30, 30))), 8), p, words, spans


def calm_documents(docs: DataFrame, field: Field | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that don't score as toxic; rows stay where they are."""
    if field is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        scores = np.concatenate([np.zeros(0), *(s for s, *_ in _scored(shared.value, column))])
        tidy()
        return pa.array(scores)

    return docs.filter(score(F.col("text").cast("string")) < threshold)


def score_documents(docs: DataFrame, field: Field | None, with_spans: bool = True) -> DataFrame:
    """doc_id, score and, if asked for, spans (first and last code point + 1, highest marginal) of offending words."""
    spans_type = "array<struct<start:int,end:int,probability:double>>"
    if field is None:
        out = docs.select("doc_id", F.lit(0.0).alias("score"))
        return out.withColumn("spans", F.array().cast(spans_type)) if with_spans else out
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for score, p, words, (starts, ends) in _scored(shared.value, batch.column(1)):
                scores.append(score)
                if with_spans:
                    spans += _spans(p, words, starts, ends)
            arrays = [batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            if with_spans:
                arrays.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "spans"][: len(arrays)])
            tidy()

    schema = "doc_id long, score double" + (f", spans {spans_type}" if with_spans else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def _spans(p: np.ndarray, words: Words, starts: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(words.rows) - 1)]
    hits = np.flatnonzero(p >= 0.5)
    if not len(hits):
        return out
    points = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
    rows = np.searchsorted(words.bounds, hits, side="right") - 1
    last = None
    for r, k in zip(rows.tolist(), hits.tolist()):
        base = points[words.rows[r]]
        a, b = int(points[starts[k]] - base), int(points[ends[k]] - base)
        if last == (r, k - 1):
            out[r][-1] |= {"end": b, "probability": max(out[r][-1]["probability"], float(p[k]))}
        else:
            out[r].append({"start": a, "end": b, "probability": float(p[k])})
        last = (r, k)
    return out


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Field | None:
    return fit_in_task(docs, labels, "toxic", each, train)


def toxicity(docs: DataFrame, labels: DataFrame, with_spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document, from a field fitted on the labelled folds."""
    scored = score_documents(docs, fit(docs, labels), with_spans)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["spans"] if with_spans else []))
