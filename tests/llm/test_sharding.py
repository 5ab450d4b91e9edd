import random
import zlib

import pytest

from terrafold.llm import sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, n, run = (low + high) // 2, 1, 0
        for s in sizes:
            if run + s > middle:
                n, run = n + 1, 0
            run += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("seed, n, hot", [(1, 3000, 0), (2, 500, 0), (3, 800, 200_000), (4, 10, 0), (5, 2, 50)])
def test_capacity_is_the_least(spark, seed, n, hot):
    rng = random.Random(seed)
    # clustered hashes, so that ranges hold many groups and must be split more than once
    hashes = sorted({rng.choice((0, 1 << 40, -(1 << 63))) + rng.randrange(1 << rng.choice((12, 20, 44))) for _ in range(n)} | {rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)})
    sizes = [rng.randint(1, 400) for _ in hashes]
    if hot:
        sizes[len(sizes) // 3] = hot
    capacity, firsts = sharding.minimax_cuts(spark.createDataFrame(list(zip(hashes, sizes)), "h long, size long"), 7)
    assert capacity == least_capacity(sizes, 7)
    shards = [sum(h >= f for f in firsts) for h in hashes]
    loads = [sum(s for s, k in zip(sizes, shards) if k == j) for j in range(7)]
    assert max(loads) == capacity and shards == sorted(shards) and len(firsts) <= 6


def test_odd_documents(odd_docs, odd_rows):
    rows = sharding.shard_documents(odd_docs, shards=5, overhead=8).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values()) and set(by) <= set(range(5))
    text = {i: t for i, t, *_ in odd_rows}
    assert len({r["shard"] for r in rows if text[r["doc_id"]] == text[4]}) == 1


def test_empty_table(no_docs):
    assert sharding.shard_documents(no_docs).count() == 0
