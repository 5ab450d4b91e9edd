import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrafold.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plainly(rows, longest=3, least=10, most=2000, inside=50):
    """The contract read out, over tuples of words."""
    counts, out = {}, []
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        held = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            held.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(held)[:most], 1)]
    return sorted(out)


def run(docs, **how):
    return sorted(map(tuple, collocations.collocations(docs, **how).collect()))


def corpus(rng, n, vocabulary=12):
    words = ["Alpha", "beta", "GAMMA", "ÄRger", "straße", "x", "日本", "no.", "e,f", "new", "york", "city", "end\nline", "tab\tbed", " nb", "\U0001f600"][:vocabulary]
    return [(" ".join(rng.choices(words, weights=[1 + 9 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))) + rng.choice(["", ".", "! ", "  new york city"]), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 5, "inside": 70}, {"longest": 2, "least": 3, "most": 7}, {"longest": 5, "least": 8, "inside": 100}])
def test_equals_brute_force(spark, how, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_TEXT", 2_000)
    rng = random.Random(len(how))
    rows = corpus(rng, 160, 16)
    docs = spark.createDataFrame([(k, t, l, "a", 1) for k, (t, l) in enumerate(rows)], SCHEMA)
    want = plainly(rows, **how)
    assert len(want) > 20
    for n in (1, 5):
        assert run(docs.repartition(n), **how) == want


def test_odd_documents(spark, odd_docs, odd_rows):
    rows = [(r[1], r[2]) for r in odd_rows]
    assert run(odd_docs, least=2) == plainly(rows, least=2)


def test_ties_and_repeated_rows(spark):
    rows = [("a b. c d. e f g", "en")] * 30 + [("", "en"), (None, None), ("é a", "fr")]
    docs = spark.createDataFrame([(1, t, l, "a", 1) for t, l in rows], SCHEMA)
    got = run(docs)
    assert got == plainly(rows) and [g[2] for g in got] == ["a b", "c d", "e f g"]


def test_products_beyond_64_bits(spark):
    """Counts of 10**13: the division stays exact."""
    from pyspark.sql import functions as F

    a, l, r = 9_999_999_999_971, 9_999_999_999_989, 9_999_999_999_973
    wide = lambda v: F.lit(v).cast("decimal(14,0)")
    score = F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))
    assert spark.range(1).select(score.alias("s")).first()["s"] == 1_000_000 * a * a // (l * r)


def test_ranks_are_whole_per_language(spark):
    rng = random.Random(4)
    rows = [(" ".join(f"w{rng.randint(0, 12)}" for _ in range(40)), "en") for _ in range(200)]
    docs = spark.createDataFrame([(k, t, l, "a", 1) for k, (t, l) in enumerate(rows)], SCHEMA)
    got = run(docs, longest=2, least=2, most=50)
    assert [g[1] for g in got] == list(range(1, 51)) and got == plainly(rows, longest=2, least=2, most=50)


def test_empty_table(no_docs):
    assert collocations.collocations(no_docs).count() == 0
