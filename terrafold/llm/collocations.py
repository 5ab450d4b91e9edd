"""Phrase collocations by hierarchical pair naming.

Words are named first, then adjacent names: a phrase of k words is the pair of the two phrases of k - 1 words that it begins and
ends with, so a level's phrases are named by pairs of the names below, and a name's two parts are its parents.

1. Texts are read in blocks. A block lists its distinct words, each with its count, and keeps its text as a sequence of numbers
   in that list; -1 stands between pieces of text.
2. Words, or pairs, of all blocks meet by what they are: what occurs `least` times or more is named by its first place (block and number
   in that block's list). Names go back to their blocks; what has none breaks the sequence, as no frequent phrase contains it.
3. A block then replaces adjacent names by the numbers of their pairs, lists those, and so on to the longest phrases wanted.
4. Level by level a phrase takes from its parents what it needs: the counts of its beginnings from the left one, of its endings from the
   right one, so every cut's two sides stand in two arrays; and each parent takes the largest count of the phrases that it is a parent of. A phrase
   inside a longer one is inside one that is a word longer and at least as frequent, so parents alone decide what is subsumed.

A row of a shuffle is a distinct word or pair of a block with its count, never an occurrence; blocks have a bounded size (but for a single longer
document), so a frequent phrase is at most one row a block, and a hot language or source is no key by itself. Nothing but sums leaves
the executors; counts are exact at any size, products are decimals of 38 digits (counts below 10**14).

Null texts have no words; texts without language form a language of their own (`und`), together with those that are marked so. Rows that repeat
count as often as they occur. Very long texts are read whole, as one block, and so are their pieces. Ties in score go to the more frequent phrase,
then to the smaller one in byte order, so ranks are the same whatever the partitioning. Columns other than text and lang are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, row_blocks, tidy, utf8

#: Bytes of text of a block (a longer document is one of its own).
BLOCK_TEXT = 12 << 20
#: Where texts fall into pieces, and where pieces fall into words.
PIECE_ENDS, WORD_GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Groups that a language's phrases are ranked in before the best of all are; a constant, so the last ranking has a bounded size.
RANK_GROUPS = 32

_COUNTED = "block long, sequence binary, lang string, word string, left long, right long, place long, count long"
_COUNTED_ARROW = pa.schema(
    [("block", pa.int64()), ("sequence", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("place", pa.int64()), ("count", pa.int64())]
)
_ROWS = 1 << 16


def _listed(columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _COUNTED_ARROW], schema=_COUNTED_ARROW)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, number of each key, counts)."""
    found, numbers, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return found, numbers.astype(np.int32), counts


def _sequence(numbers: np.ndarray) -> np.ndarray:
    """Numbers with each run of gaps (-1) as one."""
    gap = numbers < 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    return numbers[keep].astype("<i4")


def _words(data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's words in order, the row of each, and whether a new piece (or row) begins at it."""
    gap, end = np.zeros(256, bool), np.zeros(256, bool)
    end[list(PIECE_ENDS)] = True
    gap[list(WORD_GAPS + PIECE_ENDS)] = True
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends_before = np.concatenate([[0], np.cumsum(end[data] | edge[:-1])])  # a row's first byte opens a piece, and so does what follows an end
    lengths = np.diff(np.concatenate([[0], np.cumsum(inside)])[np.append(starts, len(data))])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]]))
    piece = ends_before[starts + 1] if len(starts) else np.zeros(0, np.int64)
    return text, np.searchsorted(rows, starts, side="right") - 1, np.diff(piece, prepend=-1) > 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (lang, text): a row a distinct word of a language, and one with the sequence of their numbers."""
    part, made = TaskContext.get().partitionId(), 0
    texts: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    langs: list[pa.Array] = []
    held = 0

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal texts, lengths, langs, held, made
        number = _place(part, made)
        data = np.concatenate(texts)
        rows = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        lang = pa.chunked_array(langs).combine_chunks().dictionary_encode()
        texts, lengths, langs, held, made = [], [], [], 0, made + 1
        words, row, fresh = _words(data, rows)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, numbers, counts = _distinct(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * max(len(coded.dictionary), 1) + code)
        for at in range(0, len(keys), _ROWS):
            some = keys[at : at + _ROWS]
            of, word = np.divmod(some, len(coded.dictionary))
            yield _listed(
                {
                    "block": pa.array(np.full(len(some), number)), "lang": lang.dictionary.take(pa.array(of)).cast(pa.string()), "word": coded.dictionary.take(pa.array(word)).cast(pa.string()),
                    "place": pa.array(number + np.arange(at, at + len(some))), "count": pa.array(counts[at : at + _ROWS]),
                },
                len(some),
            )
        spaced = np.insert(numbers, np.flatnonzero(fresh), -1)
        if len(keys):
            yield _listed({"block": pa.array([number]), "sequence": pa.array([_sequence(spaced).tobytes()], pa.binary())}, 1)
        tidy()

    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for i, j in row_blocks(offsets, BLOCK_TEXT // 4):
            size = int(offsets[j] - offsets[i])
            if held and held + size > BLOCK_TEXT:
                yield from block()
            texts.append(raw[offsets[i] : offsets[j]].copy())
            lengths.append(np.diff(offsets[i : j + 1]))
            langs.append(batch.column(0).slice(i, j - i))
            held += size
    if texts:
        yield from block()


def _place(part: int, block: int) -> int:
    """A block's first place: 20 bits of partition, 12 of block, 31 for the numbers in its list."""
    if part >= 1 << 20 or block >= 1 << 12:
        raise ValueError("more than 2**20 partitions, or a partition of more than 4096 blocks of text: repartition the documents")
    return part << 43 | block << 31


def _pair_up(key: tuple, blocks: pa.Table, names: pa.Table) -> pa.Table:
    """One block, one level up: its sequence of named pairs, and its distinct pairs of names with their counts."""
    number = key[0].as_py()
    if not blocks.num_rows or not names.num_rows:
        return _COUNTED_ARROW.empty_table()
    old = np.frombuffer(blocks.column("sequence")[0].as_py(), "<i4")
    at = names.column("place").to_numpy() - number
    order = np.argsort(at)
    at, name = at[order], names.column("name").to_numpy()[order]
    renumbered = np.full(int(old.max()) + 2, -1, np.int32)  # the last stands for -1
    renumbered[at] = np.arange(len(at), dtype=np.int32)
    now = renumbered[old]
    both = (now[:-1] >= 0) & (now[1:] >= 0)
    keys, numbers, counts = _distinct(now[:-1][both].astype(np.int64) * len(at) + now[1:][both])
    if not len(keys):
        return _COUNTED_ARROW.empty_table()
    sequence = np.full(len(now), -1, np.int32)
    sequence[:-1][both] = numbers
    left, right = np.divmod(keys, len(at))
    pairs = {"block": pa.array(np.full(len(keys), number)), "left": pa.array(name[left]), "right": pa.array(name[right]), "place": pa.array(number + np.arange(len(keys))), "count": pa.array(counts)}
    whole = {"block": pa.array([number]), "sequence": pa.array([_sequence(sequence).tobytes()], pa.binary())}
    return pa.Table.from_batches([_listed(pairs, len(keys)), _listed(whole, 1)])


def _named(listed: DataFrame, by: list[str], least: int) -> DataFrame:
    """Lists' entries whose totals reach `least`: block, place, name, by, f. An entry whose place is its name stands for all its likes."""
    over = "OVER (PARTITION BY " + ", ".join(by) + ")"
    named = listed.filter("sequence IS NULL").selectExpr("block", "place", *by, f"min(place) {over} AS name", f"sum(count) {over} AS f")
    return named.filter(F.col("f") >= least)


def phrases(scratch: Scratch, docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """([level 1, level 2, ...], words of each lang): a level has a row a phrase of `least` occurrences or more.

    Rows: name, lang, phrase (words joined by spaces), f, begins and ends (counts of its first and last 1, 2, ... words, up to its own), and
    left and right, its parents' names, from level 2 on.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    listed = scratch.table(docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_read, _COUNTED), "blocks-1")
    totals = listed.filter("sequence IS NULL").groupBy("lang").agg(F.sum("count").alias("n"))
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        by = ["lang", "word"] if k == 1 else ["left", "right"]
        if k < longest:  # blocks need the names
            named = scratch.table(_named(listed, by, least), f"names-{k}")
            own = named.filter("name = place").select("name", *by, "f")
        else:
            own = listed.filter("sequence IS NULL").groupBy(*by).agg(F.min("place").alias("name"), F.sum("count").alias("f")).filter(F.col("f") >= least)
        if k == 1:
            level = own.select("name", "lang", F.col("word").alias("phrase"), "f", F.array("f").alias("begins"), F.array("f").alias("ends"))
        else:
            below = levels[-1]
            left = below.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("head"), F.col("begins"))
            right = below.select(F.col("name").alias("right"), F.substring_index("phrase", " ", -1).alias("tail"), F.col("ends"))
            level = own.join(left, "left").join(right, "right").select(
                "name", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f", F.array_append("begins", F.col("f")).alias("begins"), F.array_append("ends", F.col("f")).alias("ends"), "left", "right"
            )
        levels.append(scratch.table(level, f"level-{k}"))
        if k < longest:
            blocks = listed.filter("sequence IS NOT NULL").select("block", "sequence").groupBy("block")
            listed = scratch.table(blocks.cogroup(named.select("block", "place", "name").groupBy("block")).applyInArrow(_pair_up, _COUNTED), f"blocks-{k + 1}")
            scratch.drop(*([f"blocks-{k}"] if k > 1 else []), f"names-{k}")
    return levels, totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, inside: int = 50, scale: int = 1_000_000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's `most` best phrases of 2 to `longest` words.

    a counts the phrase, n all words of the language, l and r the two sides of the cut with the lowest score floor(scale * a * a / (l * r)),
    the earliest of those that tie. Phrases inside a longer one with at least `inside` of 100 of their occurrences go.
    """
    scratch = Scratch(docs.sparkSession)
    levels, totals = phrases(scratch, docs, longest, least)
    wide = lambda c: c.cast("decimal(14,0)")
    found = None
    for k in range(2, longest + 1):
        level = levels[k - 1]
        if k < longest:
            above = levels[k].select("left", "right", "f")
            covered = above.select(F.col("left").alias("name"), "f").unionByName(above.select(F.col("right").alias("name"), "f")).groupBy("name").agg(F.max("f").alias("longer"))
            level = level.join(covered, "name", "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {inside} * f"))
        a, top = F.col("f"), F.lit(scale).cast("decimal(7,0)")

        def side(i: int, a=a, top=top, k=k):
            first, rest = F.col("begins")[i - 1], F.col("ends")[k - i - 1]
            score = F.call_function("div", wide(a) * wide(a) * top, wide(first) * wide(rest))
            return F.struct(score.alias("score"), F.lit(i).alias("cut"), first.alias("l"), rest.alias("r"))

        best = F.array_min(F.array(*(side(i) for i in range(1, k))))
        level = level.select("lang", "phrase", a.alias("a"), best.alias("best")).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
        found = level if found is None else found.unionByName(level)
    order = "ORDER BY score DESC, a DESC, CAST(phrase AS BINARY)"
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    first = found.withColumn("group", group).selectExpr("*", f"row_number() OVER (PARTITION BY lang, group {order}) AS rank").filter(F.col("rank") <= most).drop("group", "rank")
    ranked = first.selectExpr("*", f"row_number() OVER (PARTITION BY lang {order}) AS rank").filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
