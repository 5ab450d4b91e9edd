import random
import zlib

import numpy as np
import pytest

from terrafold.llm import packing
from terrafold.llm.common import HashedTokenizer, vocabulary


def check_places(sizes, places, length):
    """Every item once, no bin too full, no gaps."""
    assert sorted(p["id"] for p in places) == sorted(sizes)
    bins = {}
    for p in places:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], sizes[p["id"]]))
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


def test_best_fit_takes_the_tightest_bin():
    where, at, fills = packing.best_fit(np.array([60, 50, 45, 40, 5]), 100)
    assert where.tolist() == [0, 1, 1, 0, 1] and sorted(fills.tolist()) == [100, 100] and at.tolist() == [0, 0, 50, 60, 95]


@pytest.mark.parametrize("nodes", [10_000, 200, 50])
def test_tree_of_nodes(spark, nodes):
    rng = random.Random(3)
    sizes = {k: min(100, max(1, int(rng.expovariate(1 / 18)))) for k in range(1500)}
    df = spark.createDataFrame(list(sizes.items()), "id long, size long")
    places = packing.pack(spark, df, 100, node_pieces=nodes, fan_in=3).collect()
    used = check_places(sizes, places, 100)
    assert used <= sum(sizes.values()) / 100 * 1.03 + 1


def test_bins_that_cannot_be_combined_end_the_rounds(spark):
    """More than half a sequence each: every bin is underfull and stays so; with a few small items, those still find room."""
    sizes = {k: 51 + k % 30 for k in range(2000)} | {5000 + k: 15 for k in range(200)}
    df = spark.createDataFrame(list(sizes.items()), "id long, size long")
    places = packing.pack(spark, df, 100, node_pieces=100, fan_in=4, node_most=900).collect()
    assert check_places(sizes, places, 100) == 2000


def test_odd_documents(spark, odd_docs, odd_rows):
    rows = packing.pack_documents(odd_docs, vocabulary("word_bpe_49k.json"), length=256).collect()
    whole = HashedTokenizer(vocabulary("word_bpe_49k.json"), "word").whole
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = np.append(whole(text or ""), 1).astype("<u4")
        want += [(str(doc_id), k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sizes = {k: r["length"] for k, r in enumerate(rows)}
    used = check_places(sizes, [{"id": k, "sequence_id": r["sequence_id"], "offset": r["offset"]} for k, r in enumerate(rows)], 256)
    assert used <= sum(sizes.values()) / 256 * 1.02 + 1


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, vocabulary("word_bpe_49k.json")).count() == 0
