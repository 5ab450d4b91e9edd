"""Best-fit packing of documents into fixed-length sequences, by hierarchical residual packing.

1. Documents are tokenised and cut into pieces: only one longer than a sequence is cut, its last piece may be shorter.
2. Pieces are dealt to nodes by hash, so no document or source can crowd one; every node best-fits its pieces,
   longest first, emits the bins that are nearly full and passes all others on.
3. Nodes merge: bins passed on become items, as long as they are full, dealt by hash to `fan_in` times fewer nodes (or more, so
   that a node gets NODE_MOST items at most on average), and are best-fitted again. Rounds end with one node, or once a round saves fewer
   than one bin in SAVING: then what is left can't be combined, as when all pieces are longer than half a sequence.
4. A bin that became an item keeps its contents together: a piece's place is its offset plus those of the bins around it.

Null texts are empty documents: one piece, just the end id. Rows that repeat, and ties of length, are packed as often as they occur,
ties in the order of their hash. A very long text becomes many pieces, none in a task's memory but its own ids. A null doc_id stays null.
Other columns are ignored. An empty table packs to an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_ids, row_blocks, tidy, tokenizer, utf8

LENGTH = 4096
#: Pieces a first-level node gets on average.
NODE_PIECES = 40_000
#: Items a later node gets on average, at most.
NODE_MOST = 400_000
FAN_IN = 8
#: A round that saves fewer than one bin in so many is the last.
SAVING = 1_000
#: Bins with at most this much room left are emitted at once.
SLACK = 8


def pieces(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path, kind)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in row_blocks(offsets):
                ids, bounds = tokens.encode(raw, offsets, i, j)
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                size = np.diff(bounds)
                many = -(-size // length)
                row = np.repeat(np.arange(j - i), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * length
                n = np.minimum(length, size[row] - start)
                first = bounds[row] + start
                crcs = [crc_ids(ids[a:b]) for a, b in zip(first.tolist(), (first + n).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), *(pa.array(v, f.type) for v, f in zip((piece, start, n, crcs), list(schema)[1:]))], schema=schema)
            tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, fill of each bin): items, longest first, go where least room is left.

    Bins are kept by room left; the set of rooms in use is one integer's bits, so the smallest room that
    fits is its lowest bit from the item's size on.
    """
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(length + 1)]
    used, fills = 0, []
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, bin_ = length, len(fills)
            fills.append(0)
        where[item], offset[item] = bin_, fills[bin_]
        fills[bin_] += size
        left = room - size
        if left:
            if not rooms[left]:
                used |= 1 << left
            rooms[left].append(bin_)
    return where, offset, np.array(fills, np.int64)


_PLACED = "id long, bin long, at long, fill long, passed boolean"


def _pack_node(length: int, level: int):
    """Packs one node's items (id, size); a bin's number holds its level, node and place, so it is unique."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        table = table.sort_by("id")
        where, at, fills = best_fit(table.column("size").to_numpy(), length)
        passed = fills < length - SLACK
        return pa.table({"id": table.column("id"), "bin": (level << 58) + (node << 26) + where, "at": at, "fill": fills[where], "passed": passed[where]})

    return work


def pack(spark: SparkSession, sized: DataFrame, length: int = LENGTH, node_pieces: int = NODE_PIECES, fan_in: int = FAN_IN, node_most: int = NODE_MOST, scratch: Scratch | None = None) -> DataFrame:
    """(id, sequence_id, offset) for items (id, size): ids are distinct longs, sizes 1 to length."""
    scratch = scratch or Scratch(spark)
    n = sized.count()
    nodes = max(1, -(-n // node_pieces))
    level = 0

    def packed(items: DataFrame) -> DataFrame:
        node = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(nodes)).alias("node")
        return scratch.table(items.select("id", "size", node).groupBy("node").applyInArrow(_pack_node(length, level), _PLACED), f"packed-{level}")

    base = carried = packed(sized)
    moves: DataFrame | None = None
    while nodes > 1:
        # a row a bin that was passed on
        bins = scratch.table(carried.filter("passed").groupBy("bin").agg(F.first("fill").alias("size")).select(F.col("bin").alias("id"), "size"), f"open-{level}")
        left = bins.count()
        fewer = max(-(-nodes // fan_in), -(-left // node_most))
        if not left or fewer >= nodes:
            break
        level, nodes = level + 1, fewer
        carried = packed(bins)
        step = carried.select(F.col("id").alias("from"), F.col("bin").alias("to"), F.col("at").alias("shift"))
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("from").alias("to"), F.col("to").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(later, "to", "left").select("from", F.coalesce("next", "to").alias("to"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        moves = scratch.table(moves, f"moves-{level}")
        saved = left - carried.select("bin").distinct().count()
        if saved * SAVING < left:
            break
    if moves is None:
        return base.select("id", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    out = base.join(moves, base.bin == moves["from"], "left")
    return out.select("id", F.coalesce("to", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.table(pieces(docs, path, kind, end_id, length).withColumn("id", F.monotonically_increasing_id()), "pieces")
    placed = pack(spark, cut.select("id", F.col("length").alias("size")), length, scratch=scratch)
    return cut.join(placed, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
