"""Mixing sources to target weights: exact block quotas, split by multivariate-hypergeometric draws.

1. A source's documents stand in a random but fixed order, by hash; equal hash ranges cut it into BLOCKS blocks.
2. Weighted targets, in words, are filled to `limit` times a source's size at most; what is above is shared again.
   A target is whole passes over a source plus a part of a pass: the blocks up to the one in which it ends, and in
   that block the documents up to the one that meets the target. So a source's block quota is exact.
3. A binary tree over output shards splits the vector of quotas: each half draws how many blocks of which source it gets
   from the multivariate hypergeometric law, so every shard is a random sample of the mix and quotas stay exact.
4. A source's drawn blocks, permuted by an affine map of their numbers, are dealt to the shards as disjoint runs;
   a shard shuffles its own documents by hash.

Only DataFrame functions touch rows. Sizes, targets and cuts are tables of a row a source; the driver holds block counts of one
group of GROUP sources at a time and a number a group: quotas are split over groups first, then a group's own over its sources,
which is the same law. A source's row reaches its documents by broadcast, if sources are one group, otherwise that of the largest
GROUP sources does and all others (each at most a GROUP-th of the rows) meet theirs in a shuffle.

A null source is a source of its own, last; sources are ordered by code point. Null or blank texts have size 0: they are taken with
their blocks but add no words. Rows that repeat share a hash (of doc_id, null or not, and text), so they are taken alike, and rows that
tie at a cut share what it takes. A very long text may end a target within itself. The documents' columns keep their names and values; the
result's column is `mixed`, or `mixed_2` and so on where that is taken. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, default_partitions

BLOCKS = 4096
#: Sources whose block counts the driver holds at once, and whose rows are broadcast.
GROUP = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Populations that numpy's hypergeometric draws take.
NUMPY_MOST = 10**9


def draw_without_replacement(rng: np.random.Generator, good: int, bad: int, need: int, most: int = NUMPY_MOST) -> int:
    """How many of `need` items drawn from good + bad are good: the hypergeometric law for populations of any size.

    Large populations are thinned: every item is taken with probability need / (good + bad), by two binomial draws. Given how many were
    taken, they are a uniform sample; those too many are put back, or those lacking are drawn from the rest, again without replacement.
    What is lacking is about the root of `need`, so a few rounds lead to draws one by one.
    """
    total = good + bad
    if not 0 <= need <= total:
        raise ValueError(f"{need} of {total} can't be drawn")
    if total < most:
        return int(rng.hypergeometric(good, bad, need)) if total else 0
    if 2 * need > total:  # what stays is a sample too
        return good - draw_without_replacement(rng, good, bad, total - need, most)
    if need <= 64:
        taken = 0
        for k in range(need):
            taken += int(rng.integers(0, total - k)) < good - taken
        return taken
    g, b = int(rng.binomial(good, need / total)), int(rng.binomial(bad, need / total))
    if g + b >= need:
        return g - draw_without_replacement(rng, g, b, g + b - need, most)
    return g + draw_without_replacement(rng, good - g, bad - b, need - g - b, most)


def split_quotas(quotas: list[int], shards: int, seed: int, totals: np.ndarray | None = None) -> np.ndarray:
    """(shard, source) block counts with the quotas as column sums, drawn down a binary tree over the shards.

    totals: the shards' own sums, where they are known; otherwise they are as equal as halving makes them.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(first: int, last: int, counts: np.ndarray) -> None:
        if last - first == 1:
            out[first] = counts
            return
        middle = (first + last) // 2
        pool = int(counts.sum())
        need = pool * (middle - first) // (last - first) if totals is None else int(totals[first:middle].sum())
        left = np.zeros_like(counts)
        for i, c in enumerate(counts.tolist()):  # the law's margins, one source after the other
            pool -= c
            left[i] = draw_without_replacement(rng, c, pool, need)
            need -= int(left[i])
        down(first, middle, left)
        down(middle, last, counts - left)

    if shards:
        down(0, shards, np.array(quotas, np.int64))
    return out


def _ranked(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """Sources with their number in code point order, null last: ranges are numbered each on their own."""
    order = F.when(F.col("source").isNull(), F.unhex(F.lit("01"))).otherwise(F.concat(F.unhex(F.lit("00")), F.col("source").cast("binary")))
    ranges = sources.withColumn("order", order).repartitionByRange("order").withColumn("part", F.spark_partition_id())
    ranges = scratch.table(ranges, "ranges")
    first = ranges.groupBy("part").count().selectExpr("part", "sum(count) OVER (ORDER BY part) - count AS first")  # a row a range
    return ranges.join(first, "part").selectExpr("*", "first + row_number() OVER (PARTITION BY part ORDER BY order) - 1 AS rank").drop("order", "part", "first")


def _targets(scratch: Scratch, sources: DataFrame, weights: tuple[int, ...], share: Fraction, limit: int) -> DataFrame:
    """Sources with target, passes and rest: words wanted are weight times a level, or limit times the size where that is less.

    The level rises round by round to what the sources that are not at their limit share; a round is one sum over
    the sources, and they end when none reaches its limit any more. Exact: the level is a fraction, products are decimals.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = scratch.table(sources.withColumn("weight", weight), "weighted")
    big = lambda x: F.col(x).cast("decimal(20,0)")
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, full = Fraction(0), -1
    while True:
        # both sides stay within 38 digits
        above, under = F.lit(level.numerator).cast("decimal(28,0)") * F.col("weight").cast("decimal(9,0)"), big("size") * F.lit(limit * level.denominator).cast("decimal(17,0)")
        at_limit = above > under
        held, open_, count = sources.agg(F.sum(F.when(at_limit, F.col("size") * limit)), F.sum(F.when(~at_limit, F.col("weight"))), F.count_if(at_limit)).first()
        if count == full or not open_:
            break
        level, full = (total * share - (held or 0)) / open_, count
    # words wanted in units of 1 / denominator
    units = F.lit(level.numerator).cast("decimal(28,0)") * F.col("weight").cast("decimal(9,0)")
    denominator = F.lit(level.denominator).cast("decimal(17,0)")
    passes = F.when(F.col("size") == 0, F.lit(0)).when(at_limit, F.lit(limit)).otherwise(F.floor(units / F.greatest(big("size") * denominator, F.lit(1)))).cast("int")
    target = F.when(at_limit, (F.col("size") * limit).cast("double")).otherwise(units.cast("double") / F.lit(float(level.denominator)))
    over = F.round((units - F.col("passes") * big("size") * denominator) / denominator).cast("long")
    return sources.withColumn("passes", passes).withColumn("target", target).withColumn("rest", F.when(at_limit | (F.col("size") == 0), F.lit(0).cast("long")).otherwise(over))


def mix(docs: DataFrame, shards: int = 16, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), limit: int = 2, seed: int = 17) -> DataFrame:
    """The documents' columns and, last, a struct: size, source_size, target, taken, copies, draws (pass, shard, words, place).

    taken is the words the mix takes of a document. Only the document in which a source's target ends
    can be taken in part; `copies` rounds it to whole copies.
    """
    spark, key = docs.sparkSession, F.col("source").cast("string")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    block = F.shiftright(h, 64 - int(math.log2(BLOCKS))) + BLOCKS // 2
    # the documents' own columns go by number meanwhile: their names may clash
    own = docs.columns
    named = F.coalesce(F.concat(F.lit("="), key), F.lit(""))  # joins on it are plain, null or not
    row = F.struct(named.alias("key"), n_words(F.col("text")).alias("size"), h.alias("h"), block.cast("int").alias("block"))
    sized = docs.select(*(F.col(f"`{c}`").alias(f"own{k}") for k, c in enumerate(own)), row.alias("row"))
    scratch = Scratch(spark)
    rows = scratch.table(sized.select("row.*"), "rows")
    blocks = scratch.table(rows.groupBy("key", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "blocks")
    sources = blocks.groupBy("key").agg(F.sum("words").alias("size"), F.sum("n").alias("n")).withColumn("source", F.expr("CASE WHEN key <> '' THEN substring(key, 2) END"))
    plan = scratch.table(_targets(scratch, _ranked(scratch, sources), weights, share, limit), "plan")
    # the block in which a source's last pass ends: cumulative words by block, BLOCKS rows a source
    ends = blocks.selectExpr("key", "block", "words", "sum(words) OVER (PARTITION BY key ORDER BY block) AS upto").join(plan.select("key", "rest").filter("rest > 0"), "key")
    cut = ends.filter("upto - words < rest AND rest <= upto").select("key", "block", (F.col("rest") - F.col("upto") + F.col("words")).alias("inside"))
    # within that block, the document: its hash, the words before it, the rows that share the hash
    there = rows.join(cut, ["key", "block"]).groupBy("key", "h", "block", "inside").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    upto = there.selectExpr("*", "sum(words) OVER (PARTITION BY key ORDER BY h) AS upto").filter("upto - words < inside AND inside <= upto")
    last = upto.select("key", F.col("block").alias("cut_block"), F.col("h").alias("cut_h"), (F.col("inside") - F.col("upto") + F.col("words")).alias("part"), F.col("words").alias("tied"))
    quota = F.col("passes") * BLOCKS + F.coalesce(F.col("cut_block") + 1, F.lit(0))
    cuts = scratch.table(plan.join(last, "key", "left").select("key", "rank", "n", F.col("size").alias("source_size"), "target", "passes", "cut_h", "part", "tied", quota.cast("long").alias("quota")), "quotas")
    per_source, groups = _bounds(scratch, cuts, shards, seed)
    at = F.col("row.key") == F.col("key")
    if groups <= 1:
        joined = sized.join(F.broadcast(per_source), at)
    else:
        large = per_source.orderBy(F.desc("n"), "key").limit(GROUP)
        others = sized.join(F.broadcast(large.select("key")), at, "left_anti").join(per_source, at)
        joined = sized.join(F.broadcast(large), at).unionByName(others)
    size, hash_ = F.col("row.size"), F.col("row.h")
    # rows that tie at the cut share its part by size
    extra = F.when(F.col("cut_h").isNull() | (hash_ > F.col("cut_h")), F.lit(None)).when(hash_ < F.col("cut_h"), size).otherwise(F.floor(F.col("part") * size / F.greatest("tied", F.lit(1)))).cast("long")
    whole = F.transform(F.sequence(F.lit(1), F.col("passes")), lambda p: F.struct((p - 1).cast("int").alias("pass"), size.alias("words")))
    whole = F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<struct<pass:int,words:bigint>>"))
    both = F.when(extra.isNotNull(), F.concat(whole, F.array(F.struct(F.col("passes").alias("pass"), extra.alias("words"))))).otherwise(whole)

    def draw(x: Column) -> Column:
        number = ((x["pass"].cast("long") * BLOCKS + F.col("row.block")) * F.col("step")) % F.col("quota")
        return F.struct(x["pass"].alias("pass"), F.size(F.filter("bounds", lambda b: b <= number)).alias("shard"), x["words"].alias("words"), F.xxhash64(hash_, x["pass"]).alias("place"))

    taken = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    copies = F.col("passes") + F.when(extra.isNull(), 0).otherwise((2 * extra >= size).cast("int"))
    mixed = F.struct(size.alias("size"), "source_size", "target", taken.alias("taken"), copies.alias("copies"), F.transform(both, draw).alias("draws"))
    name, k = "mixed", 2
    while name in own:
        name, k = f"mixed_{k}", k + 1
    return joined.select(*(F.col(f"own{k}").alias(c) for k, c in enumerate(own)), mixed.alias(name))


def _bounds(scratch: Scratch, cuts: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """Each source's row with its permutation's step and the upper bounds of its shards' runs, and the number of groups."""
    spark = cuts.sparkSession
    number = F.floor(F.col("rank") / GROUP)
    sums = dict(cuts.groupBy(number.alias("g")).agg(F.sum("quota")).orderBy("g").collect())
    over_groups = split_quotas(list(sums.values()), shards, seed)
    parts = []
    for k, g in enumerate(sums):
        some = cuts.filter(number == g).select("key", "rank", "quota").orderBy("rank").collect()
        quotas = [r["quota"] for r in some]
        bounds = np.cumsum(split_quotas(quotas, shards, seed + 1 + g, over_groups[:, k]), axis=0)
        found = [(r["key"], _coprime(r["quota"], seed + 7919 * r["rank"]), bounds[:, i].tolist()) for i, r in enumerate(some)]
        part = spark.createDataFrame(found, "key string, step long, bounds array<long>")
        parts.append(part if len(sums) == 1 else scratch.table(part, f"bounds-{g}"))
    if not parts:
        parts.append(spark.createDataFrame([], "key string, step long, bounds array<long>"))
    bound = parts[0]
    for part in parts[1:]:
        bound = bound.unionByName(part)
    return scratch.table(cuts.join(bound, "key"), "sources"), len(sums)


def _coprime(n: int, seed: int) -> int:
    """A multiplier that permutes 0..n-1 (products stay within 64 bits)."""
    if n < 3:
        return 1
    step = int(np.random.Generator(np.random.PCG64(seed)).integers(1, min(n, 1 << 30)))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def materialise(mixed: DataFrame, shards: int = 16) -> DataFrame:
    """The mix itself: a row a copy, shuffled by hash within its shard.

    A shard is cut in slices by its rows' places; a slice is in one partition, in the order of places. There are at least 64
    slices a shard, and four for each of its shuffle partitions, so tasks are as many as the session asks for.
    """
    name = mixed.columns[-1]
    slices = max(64, -(-4 * default_partitions(mixed.sparkSession) // shards))
    columns = [F.col(f"`{c}`") for c in mixed.columns[:-1]]
    copies = mixed.select(F.struct(*columns).alias("row"), F.explode(F.slice(F.col(f"`{name}`.draws"), 1, F.greatest(F.col(f"`{name}`.copies"), F.lit(0)))).alias("draw"))
    slice_ = F.shiftright((F.shiftright("draw.place", 48) + (1 << 15)) * slices, 16)
    dealt = copies.repartition(F.col("draw.shard"), slice_).sortWithinPartitions("draw.shard", "draw.place")
    taken = "draw" in mixed.columns
    return dealt.select("row.*", *([] if taken else ["draw"]))
