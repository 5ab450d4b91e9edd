"""Token-ID output by static range asymmetric numeral systems (rANS).

A token file is a Parquet dataset, one row a segment of `segment_tokens` ids or some more (whole documents, in
ascending doc_id order). A segment holds

- one frequency table shared by all its blocks, exact counts scaled to 2**SCALE_BITS;
- blocks of equal length, each coded on its own by LANES interleaved states, so that any block decodes
  without the others;
- checkpoints: for each block its first word in the payload, its states and the crc32 of its ids;
- the documents' ids and lengths, and how many ids of the file's earlier segments come before.

Segments are coded in one pass: a task buffers one segment, never a partition. Written files are rows
of a Spark dataset, so a lost task is written again by Spark's commit protocol.

Null texts are empty documents: just the end id. Rows that repeat keep their copies, ordered by text among
equal ids; a null doc_id sorts first and stays null. A very long text is one document of a segment, whole, in one task's memory
with its ids. Columns other than doc_id and text are ignored, whatever their names. An empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_ids, default_partitions, row_blocks, tidy, tokenizer, utf8

SCALE_BITS = 20
LANES = 64
BLOCK_TOKENS = 1 << 15
SEGMENT_TOKENS = 1 << 20
#: States stay in [LOW, LOW << 32).
LOW = 1 << 31
U32, U64 = np.uint32, np.uint64

FILE_SCHEMA = (
    "part int, segment int, n_docs int, n_tokens long, tokens_before long, doc_ids binary, doc_nulls binary, doc_lengths binary, "
    "symbols binary, frequencies binary, block_tokens int, n_blocks int, checkpoints binary, states binary, payload binary, payload_crc32 long"
)
_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("tokens_before", pa.int64())]
    + [(c, pa.binary()) for c in ("doc_ids", "doc_nulls", "doc_lengths", "symbols", "frequencies")]
    + [("block_tokens", pa.int32()), ("n_blocks", pa.int32())]
    + [(c, pa.binary()) for c in ("checkpoints", "states", "payload")]
    + [("payload_crc32", pa.int64())]
)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**SCALE_BITS, near the counts' shares."""
    total = 1 << SCALE_BITS
    f = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    gap = total - int(f.sum())
    if gap > 0:
        f[np.argmax(counts)] += gap
    for at in np.argsort(-f, kind="stable"):
        if gap >= 0:
            break
        take = min(-gap, int(f[at]) - 1)
        f[at] -= take
        gap += take
    return f.astype(np.uint32)


def encode_segment(ids: np.ndarray) -> dict:
    """Table, checkpoints, states and payload of a segment of at least one id."""
    n = len(ids)
    every = np.bincount(ids)
    symbols = np.flatnonzero(every)
    counts, number = every[symbols], np.zeros(len(every), np.int64)
    number[symbols] = np.arange(len(symbols))
    index = number[ids]
    if len(symbols) > 1 << SCALE_BITS:
        raise ValueError("more distinct ids than the table's scale holds")
    freq = scaled(counts)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    blocks = max(1, -(-n // BLOCK_TOKENS))
    steps = -(-n // (blocks * LANES))
    padded = np.full(blocks * steps * LANES, int(np.argmax(counts)), np.int64)
    padded[:n] = index
    grid = padded.reshape(blocks, steps, LANES)
    f64 = freq.astype(np.uint64)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((blocks, steps, LANES), np.uint32)
    sent = np.zeros((blocks, steps, LANES), bool)
    high = U64(63 - SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        f = f64[s]
        full = state >= (f << high)
        words[:, t] = state.astype(np.uint32)
        sent[:, t] = full
        state = np.where(full, state >> U64(32), state)
        q = state // f
        state = (q << U64(SCALE_BITS)) + (state - q * f) + cum[s]
    at = np.concatenate([[0], np.cumsum(sent.reshape(blocks, -1).sum(1))[:-1]]).astype("<u8")
    size = steps * LANES
    crcs = np.array([crc_ids(ids[b * size : (b + 1) * size].astype("<u4").tobytes()) for b in range(blocks)], "<u8")
    payload = words[sent].astype("<u4").tobytes()
    return {
        "symbols": symbols.astype("<u4").tobytes(), "frequencies": freq.astype("<u4").tobytes(), "block_tokens": size, "n_blocks": blocks,
        "checkpoints": np.stack([at, crcs]).tobytes(), "states": state.astype("<u8").tobytes(), "payload": payload, "payload_crc32": zlib.crc32(payload),
    }


def decode_segment(row: dict, blocks: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks alone; a wrong checksum raises ValueError."""
    n, size, all_blocks = row["n_tokens"], row["block_tokens"], row["n_blocks"]
    blocks = range(all_blocks) if blocks is None else blocks
    if len(blocks) == all_blocks and zlib.crc32(row["payload"]) != row["payload_crc32"]:
        raise ValueError("the payload's checksum is wrong")
    symbols, freq = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["frequencies"], "<u4")
    at, crcs = np.frombuffer(row["checkpoints"], "<u8").reshape(2, all_blocks)
    payload = np.frombuffer(row["payload"], "<u4")
    slots = np.repeat(np.arange(len(symbols), dtype=np.uint32), freq)
    f64 = freq.astype(np.uint64)
    cum = np.cumsum(f64) - f64
    chosen = np.array(blocks)
    state = np.frombuffer(row["states"], "<u8").reshape(all_blocks, LANES)[chosen].astype(np.uint64)
    where = at[chosen].astype(np.int64)
    steps = size // LANES
    out = np.empty((len(chosen), steps, LANES), np.uint32)
    low, mask, top = U64(LOW), U64((1 << SCALE_BITS) - 1), max(len(payload) - 1, 0)
    payload = payload if len(payload) else np.zeros(1, np.uint32)
    for t in range(steps):
        slot = state & mask
        s = slots[slot]
        out[:, t] = s
        state = f64[s] * (state >> U64(SCALE_BITS)) + slot - cum[s]
        need = state < low
        rank = np.cumsum(need, axis=1)
        word = payload[np.minimum(where[:, None] + rank - 1, top)]
        state = np.where(need, (state << U64(32)) | word, state)
        where = where + rank[:, -1]
    ids = symbols[out.reshape(len(chosen), -1)]
    parts = []
    for k, b in enumerate(chosen):
        part = ids[k][: max(0, min(size, n - int(b) * size))]
        if crc_ids(part.astype("<u4").tobytes()) != int(crcs[b]):
            raise ValueError(f"the checksum of block {b} is wrong")
        parts.append(part)
    return np.concatenate(parts)


def _segments(batches: Iterator[pa.RecordBatch], path: str, kind: str, end_id: int, segment_tokens: int) -> Iterator[pa.RecordBatch]:
    part, tokens = TaskContext.get().partitionId(), tokenizer(path, kind)
    ids: list[int | None] = []
    lengths: list[np.ndarray] = []
    data: list[np.ndarray] = []
    held = segment = before = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, segment, before
        row = {
            "part": part, "segment": segment, "n_docs": len(ids), "n_tokens": held, "tokens_before": before,
            "doc_ids": np.array([x or 0 for x in ids], "<i8").tobytes(), "doc_nulls": np.array([x is None for x in ids], np.uint8).tobytes(), "doc_lengths": np.concatenate(lengths).astype("<i8").tobytes(),
        } | encode_segment(np.concatenate(data))
        before, held, segment = before + held, 0, segment + 1
        for x in (ids, lengths, data):
            x.clear()
        return pa.RecordBatch.from_pylist([row], _ARROW)

    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        doc_ids = batch.column(0).to_pylist()
        for i, j in row_blocks(offsets):
            coded, bounds = tokens.encode(raw, offsets, i, j)
            ids += doc_ids[i:j]
            data.append(np.insert(coded, bounds[1:], end_id))
            lengths.append(np.diff(bounds) + 1)
            held += len(data[-1])
            if held >= segment_tokens:
                yield flush()
        tidy()
    if ids:
        yield flush()


def _beginning() -> Column:
    """Texts' beginnings order rows of one id, or without any, as their texts do, so those aren't one range."""
    return F.substring("text", 1, 32)


def encode_documents(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS, partitions: int | None = None) -> DataFrame:
    """Segments of all documents' ids: range-partitioned by doc_id (rows of one id by text), so that (part, segment) ascends with doc_id."""
    n = partitions or default_partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id", _beginning()).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(lambda batches: _segments(batches, path, kind, end_id, segment_tokens), FILE_SCHEMA)


def write_file(docs: DataFrame, to: str, path: str, **options) -> None:
    """Writes a token file; the payload is entropy-coded already, so Parquet's own compression is off."""
    encode_documents(docs, path, **options).write.mode("overwrite").option("compression", "none").parquet(to)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


_DOC_SCHEMA = "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long, ids binary"


def _documents(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            raw = decode_segment(row).astype("<u4").tobytes()
            lengths = np.frombuffer(row["doc_lengths"], "<i8")
            starts = np.cumsum(lengths) - lengths
            parts = [raw[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(parts), row["part"], np.int32)),
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], np.uint8).astype(bool)),
                    pa.array(starts + row["tokens_before"]),
                    pa.array(lengths),
                    pa.array([crc_ids(x) for x in parts], pa.int64()),
                    pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                ],
                ["part", "doc_id", "in_part", "n_tokens", "ids_crc32", "ids"],
            )


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    Segments decode in parallel; a part's first id comes from the segments' length columns alone, a row for each part.
    """
    segments = read_segments(spark, path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    first = parts.selectExpr("part", "sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total AS part_start")
    docs = segments.mapInArrow(lambda batches: _documents(batches, with_ids), _DOC_SCHEMA)
    return docs.join(F.broadcast(first), "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
