"""Approximate nearest neighbours by additive quantisation.

Vectors are scaled to length 1 and approximated by a sum of one word from each of `books` codebooks, all of full dimension.
Codebooks start from k-means on residuals and are refitted by least squares against beam-search codes. Every row is
encoded by beam search and stored with its codes and the squared length of their sum; a query scores codes from
lookup tables (its inner products with all words): 2 <q, x'> - |x'|**2. Of each block of INDEX_BLOCK rows the best
`rerank` distinct vectors are scored exactly, in double precision, on the original vectors, which stand beside their codes;
so only a block's nearest few leave a task. Blocks have that size at most whatever Arrow's batches, the partitions or the
table are, and a neighbour is found if it is among its block's best: recall doesn't fall as the table grows.

Queries run in sets of at most QUERY_BYTES of vectors, each broadcast against all partitions of the index. Equal vectors share
one code and one score and count as one candidate, however many they are; among equal scores the smallest ids win.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of each length are an index of their own
(a cosine needs equal lengths): queries meet candidates of their own length. Codebooks are fitted on a bounded sample, but every
row is indexed. With no vectors the result is empty, a vector alone has no neighbours; rows that repeat a vec_id are candidates of
each other's neighbours, never of their own id, and the least of their vectors (by components) asks for that id. Ties in score go to the smaller id. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BOOKS = 16
WORDS = 256
BEAM = 4
#: Rows that the codebooks are fitted on, at most.
SAMPLE_ROWS = 16_000
#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 32 << 20
#: Rows of a block of the index, at most (fewer if their vectors pass BLOCK_BYTES).
INDEX_BLOCK, BLOCK_BYTES = 16_384, 32 << 20
#: Distinct vectors of a block that are scored exactly.
RERANK = 256


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dimensions)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit vectors and the squared lengths of their sums: each book extends the best `beam` partial sums."""
        codes, sums = [], []
        for at in range(0, len(x), 1024):
            c, s = self._encode(x[at : at + 1024], beam)
            codes.append(c)
            sums.append((s**2).sum(1))
        if not codes:
            return np.zeros((0, len(self.words)), np.uint8), np.zeros(0)
        return np.concatenate(codes), np.concatenate(sums)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        left = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for book in self.words.astype(np.float32):
            far = (left**2).sum(2)[:, :, None] - 2 * (left @ book.T) + (book**2).sum(1)
            flat = far.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            order = np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable")
            best = np.take_along_axis(best, order, 1)
            parent, word = best // len(book), best % len(book)
            left = left[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], x - left[:, 0]


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 9) -> Codebooks:
    """Codebooks of unit vectors: k-means on residuals, then least squares given beam-search codes."""
    rng = np.random.default_rng(seed)
    words = min(words, 256, max(1, len(x)))
    left, made = x.copy(), []
    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(6):
            near = np.argmin((book**2).sum(1) - 2 * (left @ book.T), axis=1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, near, left)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], left[rng.integers(0, len(left), words)])
        near = np.argmin((book**2).sum(1) - 2 * (left @ book.T), axis=1)
        left = left - book[near]
        made.append(book)
    found = Codebooks(np.stack(made))
    for _ in range(rounds):
        codes, _ = found.encode(x)
        gram, right = np.zeros((books, words, books, words)), np.zeros((books, words, x.shape[1]))
        for a in range(books):
            order = np.argsort(codes[:, a], kind="stable")
            used, first = np.unique(codes[order, a], return_index=True)
            right[a, used] = np.add.reduceat(x[order], first)
            for b in range(books):
                gram[a, :, b] = np.bincount(codes[:, a].astype(np.int64) * words + codes[:, b], minlength=words * words).reshape(words, words)
        gram, right = gram.reshape(books * words, -1), right.reshape(books * words, -1)
        # words that few rows use stay near where they are
        gram[np.diag_indices(books * words)] += 0.5
        found = Codebooks(np.linalg.solve(gram, right + 0.5 * found.words.reshape(books * words, -1)).reshape(found.words.shape))
    return found


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dimensions)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding of doubles) that can take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    return rows.filter(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0))


def build_index(rows: DataFrame, books: int = BOOKS, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Codebooks | None, int]:
    """(vec_id, embedding, codes, norm) of every row (of one length), the codebooks, and the vectors' length."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [np.array(batch.column(0).to_pylist(), np.float64) for batch in batches if batch.num_rows]
        if x:
            x = np.concatenate(x)
            made = fit(x / np.linalg.norm(x, axis=1, keepdims=True), books)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Codebooks(made.words.astype(np.float32)))], pa.binary())], ["books"])

    # the sample is one task's: it fits there, and the driver gets the codebooks alone
    got = rows.orderBy(F.xxhash64(F.lit(31), "vec_id"), "vec_id").limit(sample_rows).select("embedding").mapInArrow(train, "books binary").collect()
    if not got:
        return rows.withColumn("codes", F.lit(None).cast("binary")).withColumn("norm", F.lit(None).cast("double")), None, 0
    books_ = pickle.loads(got[0]["books"])
    dimensions = books_.words.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(books_)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimensions)
            codes, norm = shared.value.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float64())], ["vec_id", "embedding", "codes", "norm"])

    return rows.mapInArrow(work, "vec_id long, embedding array<double>, codes binary, norm double"), books_, dimensions


def _merge(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of what is held and what is new, a row a query; equal scores by id, id -1 is none."""
    ids, scores = np.concatenate([best[0], ids], 1), np.concatenate([best[1], scores], 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of exactly so many, the last one shorter."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            batch = batch.slice(part.num_rows)
            held.append(part)
            count += part.num_rows
            if count == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, books: Codebooks, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    n, dimensions = queries.shape
    lengths = np.linalg.norm(queries, axis=1)
    units = queries / lengths[:, None]
    best = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    for batch in _blocks(batches, max(1, min(INDEX_BLOCK, BLOCK_BYTES // (8 * dimensions)))):
        ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dimensions)
        order = np.argsort(ids, kind="stable")
        rows = np.ascontiguousarray(x[order]).view([("", np.float64)] * dimensions).ravel()
        distinct, first, same = np.unique(rows, return_index=True, return_inverse=True)
        # the k + 1 smallest ids of each distinct vector: one of them may be the query's own
        by = np.argsort(same, kind="stable")
        start = np.searchsorted(same[by], np.arange(len(distinct) + 1))
        held = np.full((len(distinct), k + 1), -1, np.int64)
        for c in range(k + 1):
            has = start[:-1] + c < start[1:]
            held[has, c] = ids[order][by[start[:-1][has] + c]]
        x = x[order][first]
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)[order][first]
        norm = batch.column(3).to_numpy()[order][first]
        size = np.linalg.norm(x, axis=1)
        keep = min(rerank, len(x))
        for at in range(0, n, 64):
            q = units[at : at + 64]
            table = np.einsum("qd,mwd->mqw", q, books.words).astype(np.float32)
            score = np.broadcast_to(-norm.astype(np.float32), (len(q), len(x))).copy()
            for m in range(len(table)):
                score += 2 * table[m][:, codes[:, m]]
            near = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
            exact = (x[near] * queries[at : at + 64][:, None, :]).sum(2) / (size[near] * lengths[at : at + 64][:, None])
            found = held[near]
            own = found == query_ids[at : at + 64][:, None, None]
            value = np.where((found < 0) | own, -np.inf, exact[:, :, None])
            part = best[0][at : at + 64], best[1][at : at + 64]
            best[0][at : at + 64], best[1][at : at + 64] = _merge(part, np.where(value == -np.inf, np.iinfo(np.int64).max, found).reshape(len(q), -1), value.reshape(len(q), -1), k)
    some = best[1] > -np.inf
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, some.sum(1))), pa.array(best[0][some]), pa.array(best[1][some])], ["query_id", "vec_id", "score"])


_FOUND = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, books: int = BOOKS, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the k nearest of all other rows for each query row (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    counts = asked.groupBy(F.size("embedding").alias("length")).count().orderBy("length").collect()
    near = None
    for length, count in counts:
        same = F.size("embedding") == length
        part = _nearest(rows.filter(same), asked.filter(same), count, k, books, rerank, sample_rows, query_bytes)
        near = part if near is None else near if part is None else near.unionByName(part)
    if near is None:
        return spark.createDataFrame([], _FOUND)
    ranked = near.selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank", "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)


def _nearest(rows: DataFrame, asked: DataFrame, count: int, k: int, books: int, rerank: int, sample_rows: int, query_bytes: int) -> DataFrame | None:
    """(query_id, vec_id, score) of each partition's best, for vectors of one length."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    index, found, dimensions = build_index(rows, books, sample_rows)
    if found is None:
        return None
    index = scratch.table(index, "index")
    sets = max(1, -(-count * 8 * dimensions // query_bytes))
    parts = []
    for b in range(sets):
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(sets)) == b).orderBy("vec_id").toArrow()
        if not len(some):
            continue
        held = spark.sparkContext.broadcast((some.column("vec_id").to_numpy(), _matrix(some.column("embedding").combine_chunks(), dimensions)))
        part = index.mapInArrow(lambda batches, held=held: _search(batches, *held.value, found, k, rerank), "query_id long, vec_id long, score double")
        # one set's answers are k rows a query and partition; more sets are written one by one
        parts.append(part if sets == 1 else scratch.table(part, f"answers-{b}"))
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    return near
