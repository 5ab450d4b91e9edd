import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import harmonic
from terrafold.llm.common import HashedTokenizer, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def check(rows, docs, length, most_padding):
    """All ids once and in place, sequences gapless and not too full, padding as little as told; returns fills."""
    whole = HashedTokenizer(PATH, "word").whole
    texts = {}
    for doc_id, text in docs:
        texts.setdefault(doc_id, []).append(np.append(whole(text or ""), 2).astype("<u4"))
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = sorted(texts[doc_id], key=lambda x: x.tobytes())
        if len(ids) > 1 and len({x.tobytes() for x in ids}) > 1:
            continue  # several texts of one id: their lengths are checked below
        n = len(ids[0])
        assert all(r["doc_tokens"] == n and r["ids_crc32"] == zlib.crc32(ids[0][r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
        covered = np.zeros(n, int)
        for r in pieces:
            covered[r["start"] : r["start"] + r["length"]] += 1
        assert (covered == len(ids)).all()
    assert sum(r["length"] for r in rows) == sum(len(x) for some in texts.values() for x in some)
    fills = []
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at and n > 0
            at += n
        assert at <= length
        fills.append(at)
    padding = sum(length - f for f in fills if f & (f - 1))
    assert padding <= most_padding * sum(fills)
    return fills


@pytest.mark.parametrize("capacity", [1, 7, 100, 4096])
def test_cuts_use_allowed_lengths_and_fewest_pieces(capacity):
    table = harmonic.cuts(capacity)
    allowed = sorted({*range(1, max(capacity // 64, 1) + 1), *(capacity // k for k in range(1, min(64, capacity) + 1))})
    best = [0]
    for n in range(1, capacity + 1):
        if capacity <= 100:
            best.append(1 + min(best[n - a] for a in allowed if a <= n))
        pieces, left = 0, n
        while left:
            assert table[left] in allowed
            left, pieces = left - table[left], pieces + 1
        assert pieces <= 5 and (capacity > 100 or pieces == best[n])
    item, start, length = harmonic.cut(np.array([0, 3 * capacity + 1, capacity, 1]), capacity)
    for k, size in enumerate((0, 3 * capacity + 1, capacity, 1)):
        own = item == k
        assert length[own].sum() == size and (start[own] == np.cumsum(length[own]) - length[own]).all()


def test_every_bin_of_a_class_takes_the_same_number():
    """A packer without tokens: classes of k pieces close at k, what waits closes at powers of two."""
    rng = random.Random(1)
    packer = harmonic.Packer(100, 5)
    sizes = [rng.randint(1, 260) for _ in range(3000)]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.arange(bounds[-1], dtype="<u4")
    rows = []
    for at in range(0, 3000, 250):
        some = bounds[at : at + 251]
        for batch in packer.add(list(range(at, at + 250)), ids[some[0] : some[-1]], some - some[0]):
            rows += batch.to_pylist()
        assert all(len(queue) < 100 // size for size, queue in packer.waiting.items())
    full = {}
    for r in rows:
        full.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(len(set(v)) == 1 and len(v) == 100 // v[0] for v in full.values()) and min(full) == 5
    waiting = sum(len(q) for q in packer.waiting.values())
    last = [r for batch in packer.finish() for r in batch.to_pylist()]
    assert waiting and not packer.waiting
    bins = {}
    for r in last:
        bins.setdefault(r["sequence_id"], 0)
        bins[r["sequence_id"]] += r["length"]
    assert not set(bins) & set(full)
    assert sum(r["length"] for r in rows + last) == bounds[-1]
    for r in rows + last:
        a = bounds[r["doc_id"]] + r["start"]
        assert r["ids_crc32"] == zlib.crc32(ids[a : a + r["length"]].tobytes()) and r["doc_tokens"] == sizes[r["doc_id"]]


def test_odd_documents(spark, odd_docs, odd_rows):
    rows = harmonic.pack_documents(odd_docs, PATH, length=256).collect()
    check(rows, [(r[0], r[1]) for r in odd_rows], 256, 0.03)


def test_whole_table_has_little_padding_whatever_the_partitions(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    told = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for n in (1, 7):
        rows = harmonic.pack_documents(docs.repartition(n, F.xxhash64("doc_id")), PATH).collect()
        fills = check(rows, told, 4096, 0.005)
        assert len(rows) < 12 * len(told) and max(fills) == 4096


def test_empty_table(no_docs):
    assert harmonic.pack_documents(no_docs, PATH).count() == 0
