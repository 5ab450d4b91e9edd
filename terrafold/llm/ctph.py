"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a piece wherever its low k bits are zero, so pieces depend on
content, not position. Each piece becomes one of 64 characters; the block size 2**k is the smallest of at most
MAX_PIECES cuts in the whole text. A fingerprint is "block size:signature:signature at twice the block size".

Fingerprints compare where their block sizes agree or differ by a factor of two: likeness is 1 - edit distance /
longer length of the signatures at the common block size, 0 without a common run of RUN characters
(or of the shorter signature, if that is shorter), 1 for equal fingerprints.

Null texts are empty; empty texts have fingerprint "2::". Equal texts have equal fingerprints. No text is cut, however long.
The next document is that of the next smaller doc_id; rows of one id follow each other by text, rows that repeat are each other's next, and rows
without doc_id, which stay null, come last. A single row is its own next. Other columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, Scratch, default_partitions, prefix_hash, row_blocks, span_hash, utf8

WINDOW = 7
MAX_PIECES = 96
LEAST_BITS = 1
RUN = 4
_CHARACTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each row."""
    out: list[str] = []
    for i, j in row_blocks(offsets):
        data, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        prefix = prefix_hash(BYTE_HASH[data])
        n, many = len(data), j - i
        if n >= WINDOW:
            begin = np.arange(n - WINDOW + 1)
            rolling = span_hash(prefix, begin, begin + WINDOW)
            hit = np.flatnonzero((rolling & np.uint64((1 << LEAST_BITS) - 1)) == 0)
            rolling = rolling[hit]
            low = rolling & (~rolling + np.uint64(1))
            zeros = np.where(low == 0, 63, np.frexp(low.astype(float))[1] - 1)
            row = np.searchsorted(rows, hit, side="right") - 1
            inside = hit + WINDOW <= rows[row + 1]
            hit, zeros, row = hit[inside], zeros[inside], row[inside]
        else:
            hit = zeros = row = np.zeros(0, np.int64)
        counts = np.bincount(row * 64 + zeros, minlength=many * 64).reshape(many, 64)
        above = counts[:, ::-1].cumsum(1)[:, ::-1]  # cuts at each block size
        bits = np.maximum(LEAST_BITS, np.argmax(above <= MAX_PIECES, axis=1))
        signatures = []
        for more in (0, 1):
            keep = zeros >= bits[row] + more
            cuts, of = hit[keep] + WINDOW, row[keep]
            # pieces end at the cuts, and at the end of a row if bytes are left there
            last = np.zeros(many, np.int64)
            last[of] = cuts  # cuts ascend, so the row's last one stays
            rest = np.flatnonzero(rows[1:] > np.maximum(last, rows[:-1]))
            ends, of = np.concatenate([cuts, rows[1:][rest]]), np.concatenate([of, rest])
            order = np.argsort(ends, kind="stable")
            ends, of = ends[order], of[order]
            starts = np.empty_like(ends)
            starts[1:] = ends[:-1]
            starts[:1] = 0
            starts = np.maximum(starts, rows[of])
            text = _CHARACTERS[(span_hash(prefix, starts, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
            at = np.searchsorted(of, np.arange(many + 1))
            signatures.append([text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        out += [f"{1 << k}:{a}:{b}" for k, a, b in zip(bits.tolist(), *signatures)]
    return out


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    x, y = F.split(a, ":"), F.split(b, ":")
    size_x, size_y = x[0].cast("long"), y[0].cast("long")

    def grams(s: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda k: F.substring(s, k, n))

    def alike(s: Column, t: Column) -> Column:
        n = F.least(F.lit(RUN), F.length(s), F.length(t))
        same = 1 - F.levenshtein(s, t) / F.greatest(F.length(s), F.length(t), F.lit(1))
        return F.when((n > 0) & F.arrays_overlap(grams(s, n), grams(t, n)), same).otherwise(0.0)

    return (
        F.when(a == b, 1.0)
        .when(size_x == size_y, F.greatest(alike(x[1], y[1]), alike(x[2], y[2])))
        .when(size_x == 2 * size_y, alike(x[1], y[2]))
        .when(size_y == 2 * size_x, alike(x[2], y[1]))
        .otherwise(0.0)
    )


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


_ROWS = pa.schema(
    [("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "text")]
)
_DDL = "part int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"
DONE, FIRST, LAST = 0, 1, 2


def _rows(part: int, ids: list, texts: list[str], prints: list[str], following: list[str], following_prints: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    raw, offsets = utf8(pa.array(changed, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(ids), pa.int32()),
            pa.array([DONE] * len(ids), pa.int32()),
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(prints, pa.string()),
            pa.array(fingerprints(raw, offsets), pa.string()),
            pa.array(following_prints, pa.string()),
            pa.nulls(len(ids), pa.string()),
        ],
        schema=_ROWS,
    )


def _edge(part: int, kind: int, doc_id, text: str, fingerprint: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "kind": kind, "doc_id": doc_id, "n_chars": len(text), "fingerprint": fingerprint, "text": text}], _ROWS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their next row; its first and last row once more, for the partitions beside it."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for i, j in row_blocks(offsets):
            ids = batch.column(0).slice(i, j - i).to_pylist()
            texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
            prints = fingerprints(raw, offsets[i : j + 1])
            if held is None:
                yield _edge(part, FIRST, ids[0], texts[0], prints[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            if len(ids) > 1:
                yield _rows(part, ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            held = ids[-1], texts[-1], prints[-1]
    if held:
        yield _edge(part, LAST, *held)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield _rows(r["part"], [r["doc_id"]], [r["text"]], [r["fingerprint"]], [r["next_text"]], [r["next_fingerprint"]])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(*utf8(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending doc_id.

    The documents are range-partitioned once. Only a partition's last row needs one of another partition: those
    two rows a partition are kept aside and joined by partition number.
    """
    scratch, n = Scratch(docs.sparkSession), default_partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, F.desc("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions(F.desc("doc_id"), "text")
    rows = scratch.table(ordered.mapInArrow(_scan, _DDL), "rows")
    parts = rows.filter(F.col("kind") == FIRST).selectExpr("part", "coalesce(lead(part) OVER (ORDER BY part), min(part) OVER ()) AS next_part")
    last = rows.filter(F.col("kind") == LAST).join(parts, "part")
    first = rows.filter(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("fingerprint").alias("next_fp"), F.col("text").alias("next_text"))
    ends = last.join(first, "next_part").select("part", "doc_id", "text", "fingerprint", "next_text", F.col("next_fp").alias("next_fingerprint"))
    both = rows.filter(F.col("kind") == DONE).unionByName(ends.mapInArrow(_close, _DDL))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    )
