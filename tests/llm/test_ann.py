import math
import random

import numpy as np
import pytest
import pyarrow as pa

from terrafold.llm import ann


def brute(vectors, q, k=5):
    ids = np.array([v for v, _ in vectors])
    x = np.array([e for _, e in vectors], float)
    at = {v: e for v, e in vectors}
    c = (x * np.array(at[q])).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(at[q]))
    order = [i for i in np.lexsort((ids, -np.round(c, 12))) if ids[i] != q][:k]
    return [int(ids[i]) for i in order]


def test_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 32))
    vectors = [(k, (centres[k % 30] + 0.7 * rng.normal(size=32)).tolist()) for k in range(1500)]
    vectors += [(5000 + k, vectors[50][1]) for k in range(400)]  # a very common vector
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), rerank=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    wanted = {v: brute(vectors, v) for v, _ in vectors if v % 50 == 0}
    assert set(got) == set(wanted)
    assert got[50] == [5000, 5001, 5002, 5003, 5004] and got[5000] == [50, 5001, 5002, 5003, 5004]
    assert sum(len(set(got[q]) & set(wanted[q])) for q in wanted) >= 0.9 * sum(map(len, wanted.values()))


def test_scores_are_exact_and_odd_vectors_take_no_part(spark):
    rng = random.Random(1)
    good = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(1, 5)]
    odd = [(50, None), (100, [0.0] * 8), (150, [float("nan")] + [1.0] * 7), (200, [None] + [1.0] * 7), (250, [1.0] * 3), (300, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df).collect()
    assert {r["query_id"] for r in rows} == {1, 2, 3, 4} and len(rows) == 12
    at = dict(good)
    for r in rows:
        a, b = at[r["query_id"]], at[r["vec_id"]]
        assert math.isclose(r["score"], sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), abs_tol=1e-12)
    assert ann.nearest(df.filter("vec_id = 100"), df).count() == 0


def test_vectors_of_another_length_meet_their_own_and_one_vector_has_no_neighbour(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8 if k % 3 else 5)], "clash") for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 5 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    same = {n: [(v, e) for v, e, _ in rows if len(e) == n] for n in (5, 8)}
    assert got == {v: brute(same[len(e)], v) for v, e, _ in rows if v % 5 == 0}
    assert ann.nearest(df.filter("vec_id = 5"), df.filter("vec_id = 5")).count() == 0


def test_blocks_have_one_size_whatever_the_batches(spark):
    batches = [pa.RecordBatch.from_pydict({"a": list(range(k))}) for k in (3, 0, 10, 1, 7)]
    assert [b.num_rows for b in ann._blocks(iter(batches), 8)] == [8, 8, 5]
    assert sum((b.column(0).to_pylist() for b in ann._blocks(iter(batches), 8)), []) == sum((b.column(0).to_pylist() for b in batches), [])


def test_recall_where_one_block_holds_thousands(spark):
    """Vectors without clusters, so that neighbours are hard to tell apart: 12000 rows in one block."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 32))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 200 = 0"), sample_rows=3000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 12_000, 200):
        near = [int(v) for v in np.argsort(-(unit @ unit[q]))[:6] if v != q][:5]
        hits += len(got[q] & set(near))
    assert hits >= 0.95 * 5 * 60


def test_encoding_improves_with_beam_and_refit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, fitted = ann.fit(x, 4, 16, rounds=0), ann.fit(x, 4, 16, rounds=2)
    loss = lambda b, beam: float(np.mean([np.sum((v - sum(b.words[m, c] for m, c in enumerate(code))) ** 2) for v, code in zip(x, b.encode(x, beam)[0])]))
    assert loss(plain, 6) <= loss(plain, 1) and loss(fitted, 6) < loss(plain, 6)
    codes, norms = fitted.encode(x)
    assert np.allclose(norms, [np.sum(sum(fitted.words[m, c] for m, c in enumerate(code)) ** 2) for code in codes], atol=1e-4)


def test_repeated_query_ids_ask_with_their_least_vector(spark):
    """Whatever the order and the partitions of the rows."""
    rng = np.random.default_rng(5)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(60, 4)).tolist())] + [(3, [-9.0, 1.0, 0.0, 0.0]), (3, [2.0, 2.0, 2.0, 2.0]), (50, [-9.0, 0.5, 0.0, 0.0])]
    seen = set()
    for n in (1, 2, 5):
        df = spark.createDataFrame(rows[::-1] if n == 2 else rows, "vec_id long, embedding array<double>").repartition(n)
        got = ann.nearest(df, df.filter("vec_id in (3, 50)"), k=3).collect()
        seen.add(tuple(sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in got)))
    assert len(seen) == 1
    least = np.array([-9.0, 1.0, 0.0, 0.0])
    others = {}
    for k, v in rows:
        if k != 3:
            others[k] = max(others.get(k, -2), float(least @ v / np.linalg.norm(least) / np.linalg.norm(v)))
    best = sorted(others.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    found = [(v, s) for q, _, v, s in sorted(seen.pop()) if q == 3]
    assert found[0][0] == 50 and [v for v, _ in best][0] == 50 and found[0][1] == pytest.approx(best[0][1])
