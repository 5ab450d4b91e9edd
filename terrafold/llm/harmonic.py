"""Harmonic packing of documents into sequences: classes by reciprocals of the capacity, a fixed number of pieces in a bin of each.

1. Class k holds pieces that fit k times, but not k + 1 times, into a sequence; its bins take exactly k pieces, so a bin needs no
   search: the k-th piece closes it. As documents may be cut, they are cut to lengths that fill bins: the longest of each class down to
   FINEST pieces a bin (capacity // k), below that every length. `cuts` finds, for each length, the fewest such pieces, then those whose
   shortest is longest; what exceeds a sequence is first cut into whole ones.
2. Every task packs the rows it reads, without a shuffle: a class is a counter and at most k - 1 pieces that wait for their bin.
3. At the end of a task the pieces that wait, less than one bin a class, are cut again, to powers of two, and packed by the same rule; the
   classes' last bins are closed at powers of two, where a sequence needs no padding.

So padding is what is lacking between k pieces of one length and the capacity, less than k tokens; a task's last sequences have none.
Rows are only packed with rows of their own task, so tasks lose nothing to each other and a lost one is run again alone. Numbers of sequences
hold the task's number.

Null texts are empty documents: just the end id. Rows that repeat are packed as often as they occur, pieces of one length in the order
of the rows; a very long text is many pieces, in one task's memory with its ids only. A null doc_id stays null.
Other columns are ignored. An empty table packs to an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_ids, row_blocks, tidy, tokenizer, utf8

LENGTH = 4096
#: Classes of up to so many pieces a bin have one length each; shorter pieces have any.
FINEST = 64

_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


@lru_cache
def cuts(capacity: int, powers: bool = False) -> np.ndarray:
    """For each length up to the capacity, the piece to cut off first; what is left is looked up again.

    Lengths allowed: capacity // k for k up to FINEST and everything shorter, or powers of two only. Fewest pieces win, then the
    longest shortest piece, then the longest first one.
    """
    if powers:
        allowed = np.array([1 << b for b in range(capacity.bit_length()) if 1 << b <= capacity])
    else:
        least = max(capacity // FINEST, 1)
        allowed = np.unique([*range(1, least + 1), *(capacity // k for k in range(1, min(FINEST, capacity) + 1))])
    first, pieces, shortest = np.zeros((3, capacity + 1), np.int64)
    shortest[0] = capacity
    for n in range(1, capacity + 1):
        some = allowed[: np.searchsorted(allowed, n, side="right")]
        rest = n - some
        cost = pieces[rest] * (capacity + 1) - np.minimum(shortest[rest], some)
        best = len(some) - 1 - int(np.argmin(cost[::-1]))
        first[n], pieces[n], shortest[n] = some[best], pieces[rest[best]] + 1, min(shortest[rest[best]], some[best])
    return first


def cut(sizes: np.ndarray, capacity: int, powers: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length) of the pieces of items of these sizes, in order."""
    table = cuts(capacity, powers)
    whole = sizes // capacity
    item = np.repeat(np.arange(len(sizes)), whole)
    start = (np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    parts = [(item, start, np.full(len(item), capacity))]
    item, at, left = np.arange(len(sizes)), whole * capacity, sizes - whole * capacity
    while len(item := item[left > 0]):
        at, left = at[left > 0], left[left > 0]
        piece = table[left]
        parts.append((item, at, piece))
        at, left = at + piece, left - piece
    item, start, length = map(np.concatenate, zip(*parts))
    order = np.lexsort((start, item))
    return item[order], start[order], length[order]


class Packer:
    """One task's bins: for each class the pieces that wait, for each piece that is placed a row of the result."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.waiting: dict[int, list[tuple[tuple, np.ndarray]]] = {}

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Packs documents, given by their ids one after the other; rows come out as bins close."""
        sizes = np.diff(bounds)
        doc, start, length = cut(sizes, self.capacity)
        crcs = [crc_ids(ids[a:b]) for a, b in zip((bounds[doc] + start).tolist(), (bounds[doc] + start + length).tolist())]
        order = np.argsort(length, kind="stable")
        groups = np.flatnonzero(np.diff(length[order], prepend=-1))
        rows: list[tuple] = []
        for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(order)]):
            size = int(length[order[a]])
            new = [((doc_ids[doc[p]], int(start[p]), size, crcs[p], int(sizes[doc[p]])), ids[bounds[doc[p]] + start[p] :][:size]) for p in order[a:b].tolist()]
            rows += self._fill(size, new)
        yield self._batch(rows)

    def _fill(self, size: int, new: list[tuple[tuple, np.ndarray]]) -> list[tuple]:
        """Rows of the bins that these pieces of one size complete; the others wait, with their ids."""
        queue = self.waiting.pop(size, []) + new
        k = self.capacity // size
        full = len(queue) // k * k
        rows = [(*piece, self.next_id + i // k, i % k * size) for i, (piece, _) in enumerate(queue[:full])]
        self.next_id += full // k
        if full < len(queue):
            self.waiting[size] = [(piece, ids.copy()) for piece, ids in queue[full:]]
        return rows

    def finish(self) -> Iterator[pa.RecordBatch]:
        """What waits, cut to powers of two; a class's last bin is closed at powers of two."""
        held = [x for size in sorted(self.waiting, reverse=True) for x in self.waiting[size]]
        self.waiting, rows = {}, []
        item, start, length = cut(np.array([piece[2] for piece, _ in held], np.int64), self.capacity, powers=True)
        by_size: dict[int, list] = {}
        for i, s, n in zip(item.tolist(), start.tolist(), length.tolist()):
            (doc_id, at, _, _, total), ids = held[i]
            by_size.setdefault(n, []).append(((doc_id, at + s, n, crc_ids(ids[s : s + n]), total), ids[s : s + n]))
        for size, pieces in by_size.items():
            rows += self._fill(size, pieces)
        for size, queue in self.waiting.items():
            at = 0
            while at < len(queue):
                n = 1 << (len(queue) - at).bit_length() - 1
                rows += [(*piece, self.next_id, i * size) for i, (piece, _) in enumerate(queue[at : at + n])]
                self.next_id, at = self.next_id + 1, at + n
        self.waiting = {}
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)


def pack_documents(docs: DataFrame, path: str, kind: str = "word", end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = tokenizer(path, kind), Packer(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in row_blocks(offsets):
                ids, bounds = tokens.encode(raw, offsets, i, j)
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                yield from packer.add(batch.column(0).slice(i, j - i).to_pylist(), ids, bounds + np.arange(len(bounds)))
            tidy()
        yield from packer.finish()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, ", ".join(f"{f.name} long" for f in _SCHEMA))
