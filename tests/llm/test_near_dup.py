import random
import re
import time

import pytest

from terrafold.llm import near_dup

from .conftest import words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    """(n_shingles, component) by id, from all pairs of full sets."""
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
            parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def compare(df, rows, percent):
    got = near_dup.near_duplicates(df, percent=percent).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def test_odd_documents_equal_brute_force(odd_docs, odd_rows):
    compare(odd_docs, [(r[0], r[1]) for r in odd_rows], 85)


def test_table_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    compare(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_a_large_group_of_edited_copies_equals_brute_force(spark, percent):
    """Copies whose edits put most pairs near the threshold, and a passage that all others share."""
    rng = random.Random(percent)
    base, passage = words(rng, 130).split(), words(rng, 40)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage + " " + words(rng, rng.randint(1, 30))) for i in range(80)]
    got = compare(spark.createDataFrame(rows, "doc_id long, text string"), rows, percent)
    assert len({r["component_id"] for r in got}) > 20


def test_hot_classes_long_lists_and_many_ids_take_other_ways_to_the_same_rows(spark, monkeypatch):
    """Few classes broadcast, lists in blocks, ids joined instead of mapped."""
    monkeypatch.setattr(near_dup, "HOT_CLASSES", 2)
    monkeypatch.setattr(near_dup, "LIST_BLOCK", 8)
    monkeypatch.setattr(near_dup, "MAP_IDS", 1)
    monkeypatch.setattr(near_dup, "PIVOT_ROUNDS", 1)
    rng = random.Random(11)
    base = words(rng, 120).split()
    texts = [words(rng, 40) for _ in range(6)]
    rows = [(i, texts[min(5, i % 9)]) for i in range(90)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((200 + i, " ".join(w)))
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows, 85)


def test_an_id_with_two_texts_gives_one_result_whatever_the_order(spark):
    rng = random.Random(3)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " tail"), (None, a)]
    seen = set()
    for k in range(3):
        rng.shuffle(rows)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(k + 1), percent=80).collect()
        seen.add(tuple(sorted(str(tuple(r)) for r in got)))
    assert len(seen) == 1


def test_keep_one_judges_rows_without_ids_and_ids_with_several_texts(spark):
    rng = random.Random(4)
    a, b, c = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(1, a, "x"), (1, a, "y"), (2, a + " tail", "x"), (None, a, "x"), (None, b, "x"), (None, b + " tail", "x"), (5, c, "x"), (5, "other words altogether", "x"), (6, None, None), (None, "", "x")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:9]) for r in kept)
    # of the b pair either may stay: they have no ids
    assert [g for g in got if g[2] != b[:9]] == sorted([(False, 1, a[:9]), (False, 5, c[:9]), (False, 5, "other wor"), (False, 6, ""), (True, 0, "")])
    assert sum(g[2] == b[:9] for g in got) == 1


def test_ids_at_both_ends_of_the_range(spark):
    """Sums of such ids pass 64 bits."""
    rng = random.Random(21)
    bases = [words(rng, 60) for _ in range(6)]
    at = [2**62, 2**63 - 40, -(2**63), -(2**62), -20, 2**40]
    rows = [(at[g] + k, bases[g] + (" tail" if k % 2 else "")) for g in range(6) for k in range(5)]
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows, 85)


def test_keep_one_over_several_groups_without_ids_and_columns_without_order(spark):
    rng = random.Random(22)
    bases = [words(rng, 60) for _ in range(8)]
    rows = [(None if k < 3 else 2**62 + 10 * g + k, b + (" tail" if k % 2 else ""), {"k": k}) for g, b in enumerate(bases) for k in range(3 + g % 2)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more map<string, int>")).collect()
    assert sorted(next(g for g, b in enumerate(bases) if r["text"].startswith(b)) for r in kept) == list(range(8))
    assert all(r["more"]["k"] >= 0 for r in kept)


def shuffled(spark):
    """Bytes of shuffle written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.3)
    spark.range(1).count()  # figures are brought up to date when a task ends
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_sketches_and_values_that_pair_with_nothing_do_not_move(spark):
    """Of a text without near copies its sketch's values are counted, 64 of some 12 bytes; neither its sketch nor its prefix moves."""
    rng = random.Random(23)
    rows = [(i, words(rng, 150)) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " tail") for i in range(20)] + [(3000 + i, rows[i][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()
    docs.count()
    before = shuffled(spark)
    got = near_dup.near_duplicates(docs, percent=85).collect()
    assert shuffled(spark) - before < 1300 * len(rows)  # 1,868 bytes a row when all sketches and prefixes moved
    assert {r["doc_id"] for r in got if not r["kept"]} == {r[0] for r in rows[1500:]}
    docs.unpersist()


def test_ids_that_repeat_among_near_copies(spark):
    """Rows that stand there four times and single rows, near to each other."""
    rng = random.Random(24)
    base = words(rng, 90)
    rows = [(i, base + " " + words(rng, 2)) for i in range(30)] + [(100 + i, words(rng, 50)) for i in range(40)]
    rows += 3 * rows[::3]
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 85)


def test_empty_table(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
