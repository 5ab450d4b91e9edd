import random
import re
from fractions import Fraction

import numpy as np

from terrafold.llm import mixing
from terrafold.llm.common import Scratch


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), limit=2):
    """Words wanted of each source, in plain rounds: what is above the limit is shared again by weight."""
    rest, open_ = sum(sizes) * share, {i: weights[i % len(weights)] for i in range(len(sizes))}
    out = [Fraction(0)] * len(sizes)
    while open_:
        each = rest / sum(open_.values())
        over = [i for i, w in open_.items() if each * w > limit * sizes[i]]
        if not over:
            for i, w in open_.items():
                out[i] = each * w
            break
        for i in over:
            out[i] = Fraction(limit * sizes[i])
            rest -= out[i]
            del open_[i]
    return out


def test_targets_share_what_is_above_the_limit(spark):
    rng = random.Random(1)
    cases = [[100, 100, 100], [10, 1000, 1000], [0, 0], [7], [rng.choice((0, 1, 50, 3000)) * rng.randint(1, 9) for _ in range(200)], [10**12 + k for k in range(7)]]
    for sizes in cases:
        sources = [None if k == len(sizes) - 1 else f"s{k:04d}" + "é" * (k % 2) for k in range(len(sizes))]
        df = spark.createDataFrame(list(zip(sources, sizes)), "source string, size long").repartition(5)
        scratch = Scratch(spark)
        got = sorted(mixing._targets(scratch, mixing._ranked(scratch, df), (5, 2, 1), Fraction(3, 2), 2).collect(), key=lambda r: r["rank"])
        assert [r["source"] for r in got] == sources
        for r, want, size in zip(got, targets(sizes), sizes):
            assert abs(r["target"] - float(want)) <= 1e-9 * max(1, want)
            if size:
                assert r["passes"] == int(want // size) and abs(r["rest"] - (want - r["passes"] * size)) <= Fraction(1, 2)


def test_groups_of_sources_give_the_same_mix_but_for_draws(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(0, 30), rng.choice(["hot", f"s{k % 40}", None])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = {r["doc_id"]: r["mixed"] for r in mixing.mix(docs, shards=4).collect()}
    monkeypatch.setattr(mixing, "GROUP", 7)
    got = {r["doc_id"]: r["mixed"] for r in mixing.mix(docs, shards=4).collect()}
    assert len(got) == 600 and all(got[k][c] == once[k][c] for k in got for c in ("size", "source_size", "target", "taken", "copies"))
    units = [(k, d["pass"], d["shard"]) for k, m in got.items() for d in m["draws"]]
    counts = [sum(s == j for *_, s in units) for j in range(4)]
    assert max(counts) < 1.5 * min(counts)


def test_quotas_split_exactly():
    counts = mixing.split_quotas([1000, 30, 0, 7], 6, 5)
    assert counts.sum(0).tolist() == [1000, 30, 0, 7] and (counts >= 0).all() and max(counts.sum(1)) - min(counts.sum(1)) <= 3
    assert (counts == mixing.split_quotas([1000, 30, 0, 7], 6, 5)).all() and (counts != mixing.split_quotas([1000, 30, 0, 7], 6, 6)).any()
    mean = np.mean([mixing.split_quotas([400, 100], 4, s)[0] for s in range(200)], axis=0)
    assert abs(mean[0] - 100) < 3 and abs(mean[1] - 25) < 3


def test_draws_follow_the_law_at_any_size():
    """Thinned draws have the mean and the spread of numpy's, exactly the same support, and no limit."""
    rng = np.random.default_rng(3)
    for good, bad, need in ((900, 400, 300), (900, 400, 1100), (5000, 20, 4000), (3, 4000, 2000), (70, 70, 70)):
        got = np.array([mixing.draw_without_replacement(rng, good, bad, need, most=0) for _ in range(4000)])
        want = rng.hypergeometric(good, bad, need, 40_000)
        p = good / (good + bad)
        spread = np.sqrt(need * p * (1 - p) * (good + bad - need) / (good + bad - 1))
        assert abs(got.mean() - need * p) < 5 * spread / np.sqrt(len(got)) and 0.93 < got.std() / want.std() < 1.07
        assert got.min() >= max(0, need - bad) and got.max() <= min(good, need)
    exact = np.bincount([mixing.draw_without_replacement(rng, 3, 4, 3, most=0) for _ in range(35_000)], minlength=4) / 35_000
    assert np.abs(exact - np.array([4, 18, 12, 1]) / 35).max() < 0.012  # C(3,g) C(4,3-g) / C(7,3)
    assert mixing.draw_without_replacement(rng, 0, 0, 0) == 0
    n = 10**13
    assert abs(mixing.draw_without_replacement(rng, n, 3 * n, 2 * n) - n // 2) < 10**8


def test_quotas_beyond_a_thousand_million_blocks():
    counts = mixing.split_quotas([163_840_000] * 8 + [10**12, 5], 16, 1)
    assert counts.sum(0).tolist() == [163_840_000] * 8 + [10**12, 5] and counts.min() >= 0
    total = counts.sum(1)
    assert total.max() - total.min() <= 16
    assert np.abs(counts[:, 8] - 10**12 / 16).max() < 2e6 and np.abs(counts[:, 0] - 163_840_000 / 16).max() < 2e4


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_odd_documents(odd_docs, odd_rows):
    got = mixing.mix(odd_docs, shards=4)
    assert got.columns == [*odd_docs.columns, "mixed_2"] and got.filter("mixed = 'clash'").count() == len(odd_rows)
    assert mixing.materialise(got, 4).count() == got.agg({"mixed_2.copies": "sum"}).first()[0]
    rows = got.select("doc_id", "source", "mixed_2.*").collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), size_of(t)) for i, t, *_ in odd_rows)
    sources = sorted({r[3] for r in odd_rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size_of(r[1]) for r in odd_rows if r[3] == s) for s in sources]
    wanted = targets(sizes)
    for s, size, target in zip(sources, sizes, wanted):
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size and abs(r["target"] - float(target)) < 1e-6 for r in own)
        # rows with one id and text tie, so a target that ends in them is met to within their number
        assert abs(sum(r["taken"] for r in own) - target) <= 3
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and sum(d["words"] for d in r["draws"]) == r["taken"] and all(0 <= d["shard"] < 4 for d in r["draws"])
    again = mixing.mix(odd_docs.drop("mixed").repartition(5), shards=4).select("doc_id", "mixed.taken").collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in rows)


def test_copies_come_out(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    mixed = mixing.mix(docs).persist()
    out = mixing.materialise(mixed)
    want = {r["doc_id"]: r["copies"] for r in mixed.select("doc_id", "mixed.copies").collect()}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_rows_need_no_python(spark, tables):
    plan = mixing.mix(spark.read.parquet(f"{tables[0]}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).count() == 0
