"""Helpers the training-data operators share: shared scratch tables, byte-level word hashing, cached tokenising.

Texts arrive as Arrow string columns. Word operators never build Python strings: they read the UTF-8
buffer as numpy bytes, find words and hash them with prefix sums, a block of rows at a time.
"""

from __future__ import annotations

import atexit
import ctypes
import json
import tempfile
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised helpers take at once (a longer document is a block of its own).
BLOCK_BYTES = 1 << 18
#: Pieces of text a worker's tokenizer may remember before it starts anew (about 30 bytes each).
CACHE_WORDS = 1_200_000

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: scratch tables need a folder that all executors share")
        root = spark.conf.get("terrafold.scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="terrafold-")
            spark.conf.set("terrafold.scratch", root)
    return root


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses nothing that a table holds.

    A table is dropped when its owner says so, otherwise when the driver exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/terrafold-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.base}/{name}")

    def clear(self) -> None:
        try:
            self._remove(self.base)
        except Exception:  # the JVM is gone at exit: the shared folder's owner cleans it
            pass

    def _remove(self, path: str) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
BYTE_HASH_LOWER = BYTE_HASH[LOWER]


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = U64(base & 0xFFFFFFFFFFFFFFFF)
        np.multiply.accumulate(out, out=out)
    return out


_tables: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept per worker for blocks of the usual length."""
    if n > BLOCK_BYTES * 2:
        return powers(_BASE, n), powers(_BASE_INVERSE, n)
    if "pow" not in _tables or len(_tables["pow"]) < n:
        _tables["pow"], _tables["inv"] = powers(_BASE, n), powers(_BASE_INVERSE, n)
    return _tables["pow"][:n], _tables["inv"][:n]


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values weighted by position, and the weights' inverses: any span's hash is a difference."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def span_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = prefix
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets (nulls are empty), without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def tidy() -> None:
    """Gives memory that Arrow and the allocator hold but don't use back to the system, so workers stay as small as what they keep."""
    pa.default_memory_pool().release_unused()
    if "libc" not in _tables:
        try:
            _tables["libc"] = ctypes.CDLL("libc.so.6")
        except OSError:  # another C library: nothing to trim
            _tables["libc"] = None
    if _tables["libc"] is not None:
        _tables["libc"].malloc_trim(0)


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows whose bytes stay within the limit (single longer rows stand alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of rows i..j of a text column: byte spans, row bounds, raw bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int):
        lo, hi = offsets[i], offsets[j]
        self.bytes = raw[lo:hi]
        self.rows = offsets[i : j + 1] - lo
        word = ~SEPARATOR[self.bytes]
        n = len(word)
        new = np.ones(n + 1, bool)
        new[1:-1] = ~word[:-1]
        new[self.rows] = True
        self.starts = np.flatnonzero(word & new[:-1])
        last = np.ones(n, bool)
        last[:-1] = ~word[1:] | new[1:-1]
        self.ends = np.flatnonzero(word & last) + 1
        self.bounds = np.searchsorted(self.starts, self.rows)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        return span_hash(prefix_hash((BYTE_HASH_LOWER if lower else BYTE_HASH)[self.bytes]), self.starts, self.ends)

    def trimmed(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans without leading and trailing ASCII punctuation; a word of nothing else keeps its span."""
        at = np.flatnonzero(ALNUM[self.bytes])
        if not len(at):
            return self.starts, self.ends
        a, b = np.searchsorted(at, self.starts), np.searchsorted(at, self.ends)
        some = b > a
        return np.where(some, at[np.minimum(a, len(at) - 1)], self.starts), np.where(some, at[b - 1] + 1, self.ends)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `size` words; a row of fewer words has its whole sequence as one, an empty row none.

    Returns hashes in row order (not distinct) and the row bounds into them.
    """
    n, counts = len(words), np.diff(bounds)
    weights = powers(_BASE ^ 0x1234_5678_9ABC_DEF0 | 1, size)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total[: n - k] += words[k:] * weights[k] if n > k else 0
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    keep = np.zeros(n, bool)
    full = counts >= size
    keep_until = np.where(full, bounds[:-1] + counts - size + 1, bounds[:-1])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, bounds[:-1][full], 1)
    np.add.at(edge, keep_until[full], -1)
    keep = np.cumsum(edge[:-1]) > 0
    out = np.empty(out_bounds[-1], np.uint64)
    place = np.ones(len(out), bool)
    short = np.flatnonzero((counts > 0) & ~full)
    place[out_bounds[short]] = False
    out[place] = mix64(total[keep] + U64(size))
    for r in short:
        a, b = bounds[r], bounds[r + 1]
        out[out_bounds[r]] = mix64(np.array([np.sum(words[a:b] * weights[: b - a], dtype=np.uint64) + U64(b - a)], np.uint64))[0]
    return out, out_bounds


def crc_ids(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


#: ASCII punctuation, and letters of Latin-1 as the two bytes that end in these.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
ASCII_ALNUM = ALNUM.copy()
ASCII_ALNUM[128:] = False
LATIN_TAIL = np.zeros(256, bool)
LATIN_TAIL[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space other than space and line feed (Unicode's, and the ASCII separators)."""
    odd = (data < 32) & (data != 10)
    found = [np.flatnonzero(odd)]
    n = len(data)
    for lead, follow in ((0xC2, {0x85, 0xA0}), (0xE1, {(0x9A, 0x80)}), (0xE2, {*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)}), (0xE3, {(0x80, 0x80)})):
        at = np.flatnonzero(data == lead)
        if len(at):
            one, two = data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
            hit = np.isin(one, list(follow)) if lead == 0xC2 else np.isin(one.astype(int) * 256 + two, [x * 256 + y for x, y in follow])
            found.append(at[hit])
    return np.concatenate(found)


class HashedTokenizer:
    """Whole texts to ids with the tokenizers library, each distinct piece of text encoded once per worker.

    Both kinds of vocabulary cut text before a space that follows a non-space and precedes one, at a lone
    line feed, and before a word's trailing ASCII punctuation if a letter or digit stands before that. So
    a text's ids are those of such pieces in a row; pieces are found by 64-bit hash (of bytes and length) in a
    bounded cache, and only new ones are encoded.

    - "byte": a word takes the space before it along, a lone line feed is a token of its own. A text with other
      white space, runs of it, or any at its ends is encoded whole.
    - "word": white space is dropped and case folded, so every white space cuts.

    The library maps the text of an added token (such as <|endoftext|>) to that token's one id. A text that holds
    one is encoded whole; pieces are encoded without added tokens, as a piece's key folds case and theirs doesn't.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        self.kind = kind
        self._forget()

    def _forget(self) -> None:
        """No pieces: their hashes in order, where each one's ids start in the pool, and how many they are."""
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Remembers pieces by their hashes, which ascend and are new."""
        ids: list[list[int]] = []
        self.tokenizer.encode_special_tokens = True
        for at in range(0, len(texts), 64):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        self.tokenizer.encode_special_tokens = False
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        place = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, place, self.used + np.cumsum(lengths) - lengths)
        self.count = np.insert(self.count, place, lengths)
        self.keys = np.insert(self.keys, place, keys)
        self.used += len(flat)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where hashes stand among the known ones, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows i..j in one array, and the rows' bounds in it."""
        words = Words(raw, offsets, i, j)
        data, n = words.bytes, len(words)
        odd_rows = self._added_rows(words)
        if self.kind == "byte":
            odd_rows = np.union1d(odd_rows, self._odd_rows(words))
        # a word's core and its trailing punctuation
        keep = np.flatnonzero(~PUNCTUATION[data])
        core = np.searchsorted(keep, words.ends)
        core = np.where(core > 0, keep[np.maximum(core - 1, 0)] + 1, 0) if len(keep) else np.zeros(n, np.int64)
        last = data[np.maximum(core - 1, 0)] if n else np.zeros(0, np.uint8)
        letter = ASCII_ALNUM[last] | (LATIN_TAIL[last] & (data[np.maximum(core - 2, 0)] == 0xC3)) if n else np.zeros(0, bool)
        core = np.where((core > words.starts) & letter, core, words.ends)
        tail = core < words.ends
        place = np.arange(n) + np.cumsum(tail) - tail
        total = n + int(tail.sum())
        starts, ends, form = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, np.uint64)
        starts[place], ends[place] = words.starts, core
        starts[place[tail] + 1], ends[place[tail] + 1] = core[tail], words.ends[tail]
        if self.kind == "byte":  # 0: as it stands, 1: after a space, 2: after a line feed
            form[place] = np.where(data[np.maximum(words.starts - 1, 0)] == 10, 2, 1)
            some = words.bounds[:-1][np.diff(words.bounds) > 0]
            form[place[some]] = 0
        keys = span_hash(prefix_hash((BYTE_HASH if self.kind == "byte" else BYTE_HASH_LOWER)[data]), starts, ends) + form * U64(0x9E3779B97F4A7C15)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        missing = np.flatnonzero(self._places(distinct) < 0)
        if len(missing):
            if len(self.keys) + len(missing) > CACHE_WORDS:
                self._forget()
                missing = np.arange(len(distinct))
            before = ("", " ", "\n")
            texts = []
            for k in where[missing].tolist():
                texts.append(before[int(form[k])] + data[starts[k] : ends[k]].tobytes().decode())
            self._learn(distinct[missing], texts)
        at = self._places(distinct)
        at = at[back]
        count = self.count[at].astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(self.first[at] - cut[:-1], count) + np.arange(cut[-1])
        ids = self.pool[source]
        word_at = np.concatenate([place, [total]])
        bounds = cut[word_at[words.bounds]]
        if len(odd_rows):
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for r in odd_rows.tolist():
                parts[r] = self.whole(data[words.rows[r] : words.rows[r + 1]].tobytes().decode())
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    def _added_rows(self, words: Words) -> np.ndarray:
        """Rows that hold the text of an added token."""
        data, found = words.bytes.tobytes(), []
        for text in self.added:
            at = data.find(text)
            while at >= 0:
                r = int(np.searchsorted(words.rows, at, side="right")) - 1
                if at + len(text) <= words.rows[r + 1]:  # else it reaches into the next row
                    found.append(r)
                    at = data.find(text, int(words.rows[r + 1]))
                else:
                    at = data.find(text, at + 1)
        return np.unique(np.array(found, np.int64))

    def _odd_rows(self, words: Words) -> np.ndarray:
        """Rows with white space other than single spaces and line feeds between words."""
        data, rows = words.bytes, words.rows
        if not len(data):
            return np.zeros(0, np.int64)
        gap = SEPARATOR[data]
        edge = np.zeros(len(data), bool)
        some = rows[:-1] < rows[1:]
        edge[rows[:-1][some]] = True
        edge[rows[1:][some] - 1] = True
        bad = gap & edge
        bad[1:] |= gap[1:] & gap[:-1]
        at = np.concatenate([np.flatnonzero(bad), _odd_space(data)])
        return np.unique(np.searchsorted(rows, at, side="right") - 1)


_tokenizers: dict[tuple[str, str], HashedTokenizer] = {}


def tokenizer(path: str, kind: str) -> HashedTokenizer:
    """This worker's tokenizer for a vocabulary file; it outlives the task."""
    if (path, kind) not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path, kind] = HashedTokenizer(path, kind)
    return _tokenizers[path, kind]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
