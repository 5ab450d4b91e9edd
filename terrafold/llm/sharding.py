"""Sharding by minimax contiguous partition of atomic groups, exact, with bounded state on the driver.

Equal texts are one atomic group; groups stand in the order of their 64-bit text hash. The smallest
capacity that lets a greedy walk fill at most `shards` shards is found by binary search, then shards are
cut there.

The walk needs sums of contiguous groups, not the groups: the driver starts from a histogram over equal
hash ranges (`TOP_BITS`), and whenever a cut may fall inside a range of several groups, only the ranges that
cuts can reach are split further (`STEP_BITS` at a time) by one aggregation. Two walks bound the optimum: one
may cut a range anywhere (not above it), one only between ranges (not below it); once they agree the partition is
optimal. The driver holds at most a few thousand ranges for each shard, whatever the corpus holds.

Null texts have size `overhead` and are one group, apart from empty texts; an empty table gives an empty result.
Rows that repeat are copies of one text, hence one group, and have slots of their own. A null doc_id stays null and takes part like any
other. A very long text counts by its bytes, in one row. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TOP_BITS = 12
STEP_BITS = 8
#: Rows numbered in one task at most, on average.
SLOT_ROWS = 200_000


def text_hash(text: Column) -> Column:
    """A text's place in the order, as an unsigned 64-bit number flipped to signed order."""
    return F.when(text.isNull(), F.lit(-(1 << 63)).cast("long")).otherwise(F.xxhash64(text))


class _Range:
    """Groups whose hashes share the leading bits: sum of sizes, whether it is a single group."""

    __slots__ = ("low", "bits", "size", "single")

    def __init__(self, low: int, bits: int, size: int, single: bool):
        self.low, self.bits, self.size, self.single = low, bits, size, single


def _walk(ranges: list[_Range], ends: list[int], capacity: int, shards: int, inside: bool) -> list[tuple[int, int]] | None:
    """Greedy cuts as (range, words of it before the cut), or None if the shards don't hold all.

    inside: a range of several groups may be cut anywhere, else ranges are whole.
    """
    cuts, done, total = [], 0, ends[-1] if ends else 0
    for _ in range(shards):
        if done >= total:
            break
        reach = done + capacity
        k = bisect_right(ends, reach)
        if k == len(ends):
            done = total
            break
        before = ends[k - 1] if k else 0
        stop = reach if inside and not ranges[k].single else before
        if stop <= done:
            return None
        cuts.append((k, stop - before))
        done = stop
    return cuts if done >= total else None


def _least(ranges: list[_Range], ends: list[int], low: int, high: int, shards: int, inside: bool) -> int:
    while low < high:
        middle = (low + high) // 2
        if _walk(ranges, ends, middle, shards, inside) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first hash of each shard but the first) for groups (h, size), h distinct."""
    top = 64 - TOP_BITS
    offset = F.lit(1 << (TOP_BITS - 1)).cast("long")

    def sums(rows: DataFrame, bits: int) -> list[_Range]:
        part = (F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")).alias("part")
        got = rows.groupBy(part).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        return sorted((_Range(r["lo"], bits, r["size"], r["lo"] == r["hi"]) for r in got), key=lambda x: x.low)

    ranges = sums(groups, TOP_BITS)
    if not ranges:
        return 0, []
    biggest = groups.agg(F.max("size")).first()[0]
    while True:
        ends, run = [], 0
        for x in ranges:
            run += x.size
            ends.append(run)
        floor = max(biggest, -(-run // shards))
        lower = _least(ranges, ends, floor, run, shards, True)
        upper = _least(ranges, ends, lower, run, shards, False)
        cuts = _walk(ranges, ends, upper, shards, False)
        if lower == upper:
            return upper, [ranges[k].low for k, _ in cuts]
        split = {k for k, x in enumerate(ranges) if not x.single and 2 * x.size > lower}  # at most 2 * shards
        if not split:
            # cuts of any capacity in between lie between the early and the late walk
            late, early = _walk(ranges, ends, upper, shards, True), _early(ends, lower, shards)
            for i in range(shards):
                a = early[i] if i < len(early) else len(ranges) - 1
                b = late[i][0] if i < len(late) else len(ranges) - 1
                split.update(k for k in range(min(a, b), max(a, b) + 1) if not ranges[k].single)
        if not split:
            raise AssertionError("the two walks differ, yet no range can be split")
        by_bits: dict[int, list[int]] = {}
        for k in split:
            by_bits.setdefault(ranges[k].bits, []).append(k)
        fine: dict[int, list[_Range]] = {}
        for bits, ks in by_bits.items():
            keys = {ranges[k].low >> (64 - bits): k for k in ks}
            wanted = groups.sparkSession.createDataFrame([(x,) for x in keys], "part long")
            inner = groups.join(F.broadcast(wanted), F.shiftright("h", 64 - bits) == F.col("part"), "left_semi")
            for x in sums(inner, min(64, bits + STEP_BITS)):
                fine.setdefault(keys[x.low >> (64 - bits)], []).append(x)
        ranges = [y for k, x in enumerate(ranges) for y in (fine[k] if k in split else [x])]


def _early(ends: list[int], capacity: int, shards: int) -> list[int]:
    """The earliest ranges in which cuts can fall: every walk steps back to the start of the range it ends in."""
    out, done = [], 0
    for _ in range(shards):
        k = bisect_right(ends, done + capacity)
        done = max(ends[k - 1] if k else 0, done)
        out.append(min(bisect_right(ends, done), len(ends) - 1))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes and overhead), text_crc32, shard, slot of every document.

    Slots count a shard's rows without gaps from 0: rows are dealt to salts by hash, salts get their first
    slot from a small count table, and each is numbered on its own, so no shard is numbered in one task.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = scratch.table(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            text_hash(text).alias("h"),
            F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)).alias("copy"),  # rows without id are told apart by place
        ),
        "rows",
    )
    groups = scratch.table(rows.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    _, firsts = minimax_cuts(groups, shards)
    # the cuts are at most shards - 1 numbers
    shard = sum((F.when(F.col("h") >= F.lit(x), 1).otherwise(0) for x in firsts), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", shard)
    fullest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = max(16, -(-fullest // SLOT_ROWS))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h", "copy"), F.lit(salts)))
    sizes = salted.groupBy("shard", "salt").count()
    first = sizes.selectExpr("shard", "salt", "sum(count) OVER (PARTITION BY shard ORDER BY salt) - count AS first")
    numbered = salted.selectExpr("*", "row_number() OVER (PARTITION BY shard, salt ORDER BY doc_id, h, copy) - 1 AS place")
    return numbered.join(first, ["shard", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))
