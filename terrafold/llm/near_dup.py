"""MinHash near-duplicates by bottom-k sketches from one hash function.

1. Each document's set is its distinct word shingles, hashed to 64 bits; its sketch is the k smallest hashes.
   Documents of equal sets (by a 128-bit fingerprint and their number) are one class, its smallest doc_id the
   representative; only representatives go on.
2. Inverted lists of retained values generate overlaps. Two sets of the wanted similarity share at least t
   of their retained values, so a representative enters only the lists of its len(sketch) - t + 1 rarest
   values (prefix filtering): a passage that many documents share builds no list unless it is much of a text.
3. The members of a short list all pair, those of a long one with one pivot; a pair's union sketch estimates its
   similarity, pairs clearly below the threshold go, exact Jaccard similarity on full sets confirms the rest. What is
   linked is one component. So a group of near copies costs about one pair a member and list.
4. Long lists whose members are in several components hold documents that may still be linked. Those alone are
   listed again by their full sets: there overlaps are exact, not estimated, so a document with too much text of its
   own enters no list that it shares. Members of different components pair with pivots where lists are long. In the end all
   members of different components are compared by parity maps, a bound on what two sets can share, and those
   that may be similar pair, so no link between different components is left out.

Sets of at most k shingles are their own sketches: for them the lists are exact. For larger sets a pair is
missed only if its sketches share fewer than t values, 4.5 standard deviations below the mean (under 1e-5).

Null or blank texts have empty sets: they link with nothing. Rows that repeat are copies of each other. If a doc_id has
rows of different texts and would represent more than one class, the class of least fingerprint is compared, the others link
with nothing. A row without doc_id is a component of its own (component null, kept). Ties go to the smallest doc_id. A very long text is a
block of its own, its set never cut. Other columns of any name are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, mix64, row_blocks, shingle_hashes, tidy, utf8
from .components import components

SKETCH = 64
SHINGLE_WORDS = 5
#: A retained value in more sets than this is sorted to the back of every prefix, the most frequent last.
COMMON = 4
#: So many common values are told apart by frequency at most (it bounds what is broadcast; order never changes results).
COMMON_VALUES = 200_000
#: Members of a list that all pair at once.
SHORT = 12
PIVOT_ROUNDS = 3
#: Members of a list that one task compares with as many others, in the last round.
LIST_BLOCK = 2_048
#: The largest classes of equal sets, whose representatives are broadcast to their members.
HOT_CLASSES = 10_000
#: Lists are paired completely once that makes at most so many pairs for each of their members.
PAIRS_PER_MEMBER = 8

U64 = np.uint64


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    """(batch, row, sorted distinct shingle hashes) of each row of (doc_id, text) batches."""
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for i, j in row_blocks(offsets):
            words = Words(raw, offsets, i, j)
            hashes, bounds = shingle_hashes(words.hashes(), words.bounds, size)
            for r in range(j - i):
                yield batch, i + r, np.unique(hashes[bounds[r] : bounds[r + 1]])
        tidy()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, k: int = SKETCH, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the full set, and the bottom-k sketch (ascending as unsigned)."""

    def work(batches):
        ids, counts, a, b, sketches = [], [], [], [], []

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), _lists(sketches)],
                ["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
            )
            for x in (ids, counts, a, b, sketches):
                x.clear()
            return batch

        for batch, row, values in _sets(batches, size):
            ids.append(batch.column(0)[row].as_py())
            counts.append(len(values))
            for marks, mark in zip((a, b), _fingerprint(values)):
                marks.append(mark)
            sketches.append(values[:k])
            if len(ids) == 4096:
                yield out()
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>")


def _fingerprint(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return np.sum(mix64(values), dtype=np.uint64), np.sum(mix64(values ^ U64(0x9E3779B97F4A7C15)), dtype=np.uint64)


def full_sets(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, the fingerprint, and the full set as the bytes of sorted 64-bit hashes."""
    names = ["doc_id", "fp1", "fp2", "members"]

    def work(batches):
        ids, marks, sets, held = [], [], [], 0

        def out():
            a, b = np.array(marks, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a), pa.array(b), pa.array(sets, pa.binary())], names)

        for batch, row, values in _sets(batches, size):
            ids.append(batch.column(0)[row].as_py())
            marks.append(_fingerprint(values))
            sets.append(values.tobytes())
            held += len(sets[-1])
            if held >= 1 << 22:
                yield out()
                ids, marks, sets, held = [], [], [], 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp1 long, fp2 long, members binary")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, members) of the wanted sets (doc_id, fp1, fp2), each once."""
    return _nearly(full_sets(only(docs, wanted), size), wanted).join(wanted, ["doc_id", "fp1", "fp2"], "left_semi").select("doc_id", "members").dropDuplicates(["doc_id"])


def sets_to_join(docs: DataFrame, wanted: DataFrame, again: DataFrame, size: int) -> DataFrame:
    """As sets_of, and sets of few other ids, which joins on doc_id drop. Only those of ids that several rows have (again) move."""
    count = again.count()
    if not count:
        return _nearly(full_sets(only(docs, wanted), size), wanted).select("doc_id", "members")
    texts = _marked(only(docs, wanted), "doc_id", again, min(count, MAP_IDS))
    once = _nearly(full_sets(texts.filter("NOT _may"), size), wanted).select("doc_id", "members")
    return once.unionByName(sets_of(texts.filter("_may").select("doc_id", "text"), wanted, size))


def _nearly(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets whose fingerprint is wanted, and few others of those that only() let through."""
    marks = wanted.select(F.col("fp1").alias("doc_id"))
    return _marked(sets, "fp1", marks, min(wanted.count(), MAP_IDS)).filter("_may").drop("_may")


def least_shared(k: int, threshold: float) -> int:
    """Retained values that two larger sets of this similarity share, but for 4.5 standard deviations."""
    return max(1, math.floor(k * (threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / k))))


def _prefixes(common: np.ndarray, order: np.ndarray, k: int, percent: int):
    t = least_shared(k, percent / 100)

    def work(batches):
        for batch in batches:
            ids, counts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            values, bounds = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.asarray(batch.column(2).value_lengths()))])
            if len(common):
                at = np.minimum(np.searchsorted(common, values), len(common) - 1)
                rank = np.where(common[at] == values, order[at], 0)
            else:
                rank = np.zeros(len(values), np.int64)
            out_id, out_n, out_v, out_own = [], [], [], []
            for r in range(len(ids)):
                v, g = values[bounds[r] : bounds[r + 1]], rank[bounds[r] : bounds[r + 1]]
                m = len(v)
                need = -(-percent * m // 100) if counts[r] * 100 <= k * percent else min(t, m)
                take = m - need + 1
                if g.any():
                    v = v[np.argsort(g, kind="stable")]
                out_v.append(v[:take])
                out_id.append(np.full(take, ids[r]))
                out_n.append(np.full(take, counts[r]))
                out_own.append(np.full(take, np.count_nonzero(g == 0), np.int32))
            if out_v:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_v, out_id, out_n, out_own)], ["v", "doc_id", "n", "own"])

    return work


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with both full sets, those with percent of the union shared."""

    def work(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


#: A map of ids has 8 bits for each of at most so many (16 MB; broadcast). More ids are joined instead.
MAP_IDS = 1 << 24


def _marked(docs: DataFrame, key: str, ids: DataFrame, count: int) -> DataFrame:
    """docs with a boolean `_may`: true where the key is among ids (doc_id), and for some few others; texts don't move.

    Ids set bits of a map, sized from their count, which is broadcast. Keys are not null.
    """
    bits = 1 << max(18, (8 * count).bit_length())
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = ids.select(bit("doc_id").alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    at = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = docs.withColumn("_bucket", F.bitmap_bucket_number(bit(key))).join(F.broadcast(maps), "_bucket", "left")
    return there.withColumn("_may", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))).drop("_bucket", "_map")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of documents whose id is among ids, and of few others, which joins on doc_id that follow drop."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    count = ids.count()
    if count > MAP_IDS:
        return known.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return _marked(known, "doc_id", ids, count).filter("_may").select("doc_id", "text")


def among(rows: DataFrame, pairs: DataFrame, count: int) -> DataFrame:
    """The rows whose doc_id is in one of so many pairs (a, b), and few others; rows don't move."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    return _marked(rows, "doc_id", ends, min(2 * count, MAP_IDS)).filter("_may").drop("_may")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets (doc_id, members) are similar enough."""
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    return _similar(pairs.join(x, "a").join(y, "b"), percent)


def estimated(pairs: DataFrame, sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch doesn't rule them out (5 standard deviations)."""
    threshold = percent / 100
    floor = threshold - 5 * math.sqrt(threshold * (1 - threshold) / k)
    left, right = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))
    # sketches ascend as unsigned: flipping the top bit makes signed order agree
    flip = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    union = F.slice(F.array_sort(F.array_union(flip("sa"), flip("sb"))), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, flip("sa")), flip("sb")))
    return pairs.join(left, "a").join(right, "b").filter(shared >= F.least(F.lit(k), F.size(union)) * floor).select("a", "b")


def _common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent values and their counts (v, count), ascending by value; bounded, as it only orders prefixes."""
    top = counts.filter(F.col("count") > COMMON).orderBy(F.desc("count"), "v").limit(COMMON_VALUES).toArrow()
    common, rank = top.column("v").to_numpy(), top.column("count").to_numpy()
    at = np.argsort(common)
    return common[at], rank[at]


def _couple(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _fits(m: str, n: str, percent: int):
    return (F.col(m) * 100 >= F.col(n) * percent) & (F.col(n) * 100 >= F.col(m) * percent)


def _rest(scratch: Scratch, docs: DataFrame, doubtful: DataFrame, parts: DataFrame, percent: int, size: int) -> DataFrame:
    """Components once the doubtful documents' links across components are found, by lists over their full sets."""
    sets = scratch.table(sets_of(docs, doubtful, size), "doubtful-sets")
    common, rank = _common(sets.mapInArrow(_values, "v long").groupBy("v").count())
    posted = sets.mapInArrow(_full_prefixes(common, rank, percent), "v long, doc_id long, n long, own long")
    shared = posted.groupBy("v").agg(F.count("*").alias("members")).filter("members > 1").select("v")
    members = scratch.table(posted.join(shared, "v"), "doubtful-members")
    maps = scratch.table(sets.mapInArrow(_parities, _PARITIES), "parities")
    found = True
    for r in range(1, PIVOT_ROUNDS + 2):
        placed = scratch.table(members.join(parts, members.doc_id == parts.node, "left").select("v", "doc_id", "n", "own", F.coalesce("component", "doc_id").alias("c")), f"placed-{r}")
        order = [F.xxhash64("doc_id", F.lit(r)).alias("h"), F.col("doc_id"), F.col("c"), F.col("n")]
        by = placed.groupBy("v", "c").agg(F.count("*").alias("m"), F.min(F.struct(*([F.col("own")] if r == 1 else []), *order)).alias("p"))
        spread = by.groupBy("v").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("within"), F.min("p").alias("p"), F.count("*").alias("parts")).filter("parts > 1").select("v", "p", "m", "within")
        apart = scratch.table(placed.join(spread, "v"), f"apart-{r}")
        cost = apart.groupBy("v").agg(F.first("m").alias("m"), F.first("within").alias("within")).agg(F.sum((F.col("m") * F.col("m") - F.col("within")) / 2), F.sum("m")).first()
        if not cost[1]:
            break
        last = r > PIVOT_ROUNDS or not found or cost[0] <= PAIRS_PER_MEMBER * cost[1]
        if last:
            # a long list's members are dealt to blocks: each pair of blocks is a join key of its own
            marked = apart.select("v", "doc_id", "n", "c", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("blocks")).join(maps, "doc_id")
            marked = marked.withColumn("mine", F.pmod(F.hash("doc_id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            row, column = ("v", F.col("mine").alias("i"), F.col("other").alias("j")), ("v", F.col("other").alias("i"), F.col("mine").alias("j"))
            x, y = (marked.select(*key, *(F.col(c).alias(c + side) for c in ("doc_id", "n", "c", *_MARKS))) for key, side in ((row, "_x"), (column, "_y")))
            near = (F.col("c_x") < F.col("c_y")) & _fits("n_x", "n_y", percent) & _may_fit(percent)
            new = x.join(y, (x.v == y.v) & (x.i == y.i) & (x.j == y.j) & near).select(*_couple(F.col("doc_id_x"), F.col("doc_id_y")))
        else:
            star = apart.filter((F.col("c") != F.col("p.c")) & _fits("n", "p.n", percent))
            star = star.select(F.col("doc_id").alias("doc_id_x"), F.col("n").alias("n_x"), F.col("p.doc_id").alias("doc_id_y"), F.col("p.n").alias("n_y")).distinct()
            x, y = (maps.select(*(F.col(c).alias(c + side) for c in ("doc_id", *_MARKS))) for side in ("_x", "_y"))
            new = star.join(x, "doc_id_x").join(y, "doc_id_y").filter(_may_fit(percent)).select(*_couple(F.col("doc_id_x"), F.col("doc_id_y")))
        new = scratch.table(new.distinct(), f"pairs-{r}")
        count = new.count()
        links = scratch.table(confirmed(new, among(sets, new, count), percent), f"links-{r}") if count else new
        found = count > 0 and not links.isEmpty()
        if found:
            known = parts.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            parts = scratch.table(components(scratch, known.unionByName(links), f"components-{r}"), f"parts-{r}")
        scratch.drop(f"placed-{r}", f"apart-{r - 1}")
        if last:
            break
        members = apart.select("v", "doc_id", "n", "own")  # lists within one component stay so
    return parts


#: Columns of a set's parity map: bit b is the parity of how many values fall on b. Where sets differ in d values, maps differ in d bits at most.
_MARKS = tuple(f"p{k}" for k in range(16))
_PARITIES = "doc_id long, " + ", ".join(f"{c} long" for c in _MARKS)


def _may_fit(percent: int):
    """Whether sets _x and _y may be similar enough: by their parity maps they differ in so few values."""
    apart_bits = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in _MARKS), F.lit(0))
    return apart_bits * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)


def _parities(batches):
    bits = 64 * len(_MARKS)
    for batch in batches:
        odd = [np.bincount((np.frombuffer(x.as_buffer(), np.uint64) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1 for x in batch.column(1)]
        maps = np.packbits(np.array(odd, np.uint8).reshape(-1, bits), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in maps.T)], ["doc_id", *_MARKS])


def _values(batches):
    for batch in batches:
        for x in batch.column(1):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], ["v"])


def _full_prefixes(common: np.ndarray, order: np.ndarray, percent: int):
    """Rows (v, doc_id, n, own) of each full set's prefix: its rarest values, as many as a similar set can't all lack. own: thousandths that are not common."""

    def work(batches):
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], []]
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(x.as_buffer(), np.int64)
                n = len(values)
                take, own = n - -(-percent * n // 100) + 1, n
                if len(common):
                    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
                    rank = np.where(common[at] == values, order[at], 0)
                    values, own = values[np.argsort(rank, kind="stable")], np.count_nonzero(rank == 0)
                for column, v in zip(rows, (values[:take], np.full(take, doc_id), np.full(take, n), np.full(take, 1000 * own // n))):
                    column.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in rows], ["v", "doc_id", "n", "own"])

    return work


def _sketches(scratch: Scratch, signed: DataFrame, classes: DataFrame, shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, n, sketch) of the nodes, each once. A row alone in its class stays where it is; of other classes only rows move that may be their nodes'."""
    unsure = scratch.table(classes.join(shared.select("class_id", "sets"), "class_id", "left").filter("rows > 1 OR sets > 1").select(F.col("fp1").alias("doc_id")), "unsure")
    count, key = min(unsure.count(), MAP_IDS), ["doc_id", "fp1", "fp2", "n_shingles"]
    signed = _marked(signed, "fp1", unsure, count)
    # the same map takes the same few other nodes
    some = scratch.table(_marked(nodes, "fp1", unsure, count).filter("_may").drop("_may"), "some-nodes")
    moved = _marked(signed.filter("_may").drop("_may"), "doc_id", some, min(some.count(), MAP_IDS)).filter("_may")
    found = moved.groupBy(*key).agg(F.first("sketch").alias("sketch")).join(some, key, "left_semi")
    columns = ("doc_id", F.col("n_shingles").alias("n"), "sketch")
    return signed.filter("NOT _may").select(*columns).unionByName(found.select(*columns))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SKETCH, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (smallest doc_id of its set), component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.table(signatures(docs, k, size), "signatures")
    # sketches are most of that table: rows are grouped and joined without them
    prints = scratch.table(signed.drop("sketch"), "prints")
    known = prints.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(known.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "classes")
    shared = scratch.table(classes.groupBy("class_id").agg(F.count("*").alias("sets"), F.min(F.struct("fp1", "fp2")).alias("least")).filter("sets > 1"), "shared-ids")
    nodes = scratch.table(classes.join(shared, "class_id", "left").filter("least IS NULL OR (fp1 = least.fp1 AND fp2 = least.fp2)").select(F.col("class_id").alias("doc_id"), "fp1", "fp2", "n_shingles"), "nodes")
    sketches = scratch.table(_sketches(scratch, signed.filter("n_shingles > 0 AND doc_id IS NOT NULL"), classes, shared, nodes), "sketches")
    scratch.drop("signatures")

    repeated = scratch.table(sketches.select(F.explode("sketch").alias("v")).groupBy("v").count().filter("count > 1"), "repeated")
    common, rank = _common(repeated)
    # a value of one sketch makes no list: nearly all of those stay where they are
    posted = sketches.mapInArrow(_prefixes(common, rank, k, percent), "v long, doc_id long, n long, own int")
    posted = scratch.table(_marked(posted, "v", repeated.select(F.col("v").alias("doc_id")), min(repeated.count(), MAP_IDS)).filter("_may").drop("_may"), "posted")
    # lists of one member pair with nobody; a long list's pivot is the member with the least text of its own: in a
    # group of edited copies the one that most others are near to
    pivot = F.min(F.struct("own", F.xxhash64("doc_id").alias("h"), "doc_id", "n")).alias("p")
    lists = posted.groupBy("v").agg(F.count("*").alias("m"), pivot).filter("m > 1").select("v", "m", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("pivot_n"))
    members = scratch.table(posted.join(lists, "v"), "members")
    short, long_ = members.filter(F.col("m") <= SHORT).select("v", "doc_id", "n"), members.filter(F.col("m") > SHORT)
    mate = short.select("v", F.col("doc_id").alias("other"), F.col("n").alias("other_n"))
    pairs = short.join(mate, "v").filter((F.col("doc_id") < F.col("other")) & _fits("n", "other_n", percent)).select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
    stars = long_.filter((F.col("doc_id") != F.col("pivot")) & _fits("n", "pivot_n", percent)).select(*_couple(F.col("doc_id"), F.col("pivot")))
    pairs = scratch.table(pairs.unionByName(stars).distinct(), "pairs")
    near = scratch.table(estimated(pairs, among(sketches, pairs, pairs.count()), percent, k), "near")
    scratch.drop("repeated", "posted", "pairs", "sketches")
    marks = nodes.select("doc_id", "fp1", "fp2")
    wanted = scratch.table(marks.join(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi"), "wanted")
    again = scratch.table(prints.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    sets = scratch.table(sets_to_join(docs, wanted, again, size), "sets")
    links = scratch.table(confirmed(near, sets, percent), "links")
    scratch.drop("near", "sets")
    parts = scratch.table(components(scratch, links, "components"), "parts")

    placed = scratch.table(long_.select("v", "doc_id").join(parts, long_.doc_id == parts.node, "left").select("v", "doc_id", F.coalesce("component", "doc_id").alias("c")), "placed")
    open_ = placed.groupBy("v").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("v")
    doubtful = scratch.table(marks.join(placed.join(open_, "v").select("doc_id").distinct(), "doc_id", "left_semi"), "doubtful")
    if not doubtful.isEmpty():
        parts = _rest(scratch, docs, doubtful, parts, percent, size)

    # a class's rows find its component: those of the largest classes by broadcast (any other class holds at most a
    # HOT_CLASSES-th of all rows), all others by a shuffle
    key = ["fp1", "fp2", "n_shingles"]
    linked = marks.join(parts, marks.doc_id == parts.node).select("fp1", "fp2", "component")
    found = scratch.table(classes.join(linked, ["fp1", "fp2"], "left").select(*key, "class_id", "rows", F.coalesce("component", "class_id").alias("component_id")), "found")
    hot = scratch.table(found.filter("rows > 1").orderBy(F.desc("rows"), "fp1", "fp2").limit(HOT_CLASSES).drop("rows"), "hot")
    rows = known.select("doc_id", *key)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(found.drop("rows"), key)
    alone = prints.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    columns = ("doc_id", "n_shingles", "class_id", "component_id")
    out = rows.join(F.broadcast(hot), key).select(*columns).unionByName(cold.select(*columns)).unionByName(alone)
    # of rows that repeat a doc_id every copy stays or goes alike; a null doc_id stays
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80, k: int = SKETCH, size: int = SHINGLE_WORDS) -> DataFrame:
    """The documents, all columns, without near duplicates: of each component the row of smallest doc_id stays.

    Rows of one id and equal text are one document. A row without id, or whose id also has a text of smaller hash, goes by a hash
    of its text from 2**62 on instead; so rows with an id of their own stay before them. Columns `_key`, `_row` are free
    of clashes in the result only.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.columns
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    made = F.shiftright(text, 2).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    several = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("h")).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("h").alias("_least"), F.max("h").alias("most")).filter("_least < most")
    several = scratch.table(several.select(F.col("doc_id").alias("_id"), "_least"), "several")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text")
    keyed = rows.filter("_id IS NOT NULL").join(several, "_id", "left").select("_row", "text", F.when(text != F.col("_least"), made).otherwise(F.col("_id")).alias("_key"))
    # rows without id stay out of the join, where they would be one key
    keyed = keyed.unionByName(rows.filter("_id IS NULL").select("_row", "text", made.alias("_key")))
    found = scratch.table(near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), percent, k, size).select("doc_id", "kept"), "kept")
    # rows of other keys than these stay as they are, and don't move
    touched = scratch.table(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("kept").alias("kept")).filter("rows > 1 OR NOT kept").select("doc_id", "kept"), "touched")
    count = touched.count()
    rows = _marked(keyed, "_key", touched, count) if count <= MAP_IDS else keyed.withColumn("_may", F.lit(True))
    calm = rows.filter("NOT _may").select("_row.*")
    judged = rows.filter("_may").join(touched.withColumnRenamed("doc_id", "_key"), "_key", "left").filter("kept IS NULL OR kept")
    # of rows that repeat, the one of least hash: columns may hold maps, which have no order
    once = judged.filter("kept").groupBy("_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")
    return calm.unionByName(judged.filter("kept IS NULL").select("_row.*")).unionByName(once)
