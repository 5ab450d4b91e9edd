import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from terrafold.llm import ctph
from terrafold.llm.common import utf8


def prints(texts, limit=None):
    return ctph.fingerprints(*utf8(pa.array(texts, pa.large_string())))


def test_fingerprints_depend_on_the_text_alone(odd_rows):
    texts = [r[1] or "" for r in odd_rows]
    assert prints(texts) == [prints([t])[0] for t in texts]
    for t, f in zip(texts, prints(texts)):
        size, a, b = f.split(":")
        assert len(a) <= ctph.MAX_PIECES + 1 and len(b) <= len(a) and int(size) >= 2
        assert bool(a) == bool(t)
    assert prints([""]) == ["2::"]


def test_an_edit_changes_few_pieces(odd_rows):
    text = odd_rows[7][1]
    a, b = prints([text, text[:5000] + "something else" + text[5010:]])
    x, y = a.split(":"), b.split(":")
    assert x[0] == y[0] and abs(len(x[1]) - len(y[1])) <= 2 and sum(p != q for p, q in zip(x[1][:3], y[1][:3])) <= 1
    assert x[1][-20:] == y[1][-20:]


def test_likeness(spark):
    rows = [("8:ABCDEFGH:ABCD", "8:ABCDEFGH:ABCD"), ("8:ABCDEFGH:ABCD", "8:ABCDEFXY:ZZZZ"), ("8:ABCDEFGH:ABCD", "16:ABCD:AB"), ("8:ABCDEFGH:ABCD", "32:ABCD:AB"), ("2::", "2::"), ("2::", "2:A:A"), ("8:ABCDEFGH:QRST", "8:AXCXEXGX:UVWX")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(ctph.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, 1.0, 0.0, 1.0, 0.0, 0.0]


def test_comparison_equals_brute_force(odd_docs, odd_rows):
    rows = [(i, t or "") for i, t, *_ in odd_rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))  # null ids come last
    got = sorted(ctph.compare_with_next(odd_docs).collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    assert len(got) == len(rows)
    for k, r in enumerate(got):
        text, following = rows[k][1], rows[(k + 1) % len(rows)][1]
        m = len(text) // 3
        changed = text[: len(text) - m] + following[:m]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (rows[k][0], len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(prints([text, changed]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long_ = next(r for r in got if r["doc_id"] == 7)
    assert long_["near_edited"] > 0.5 > long_["near_next"]


def test_one_and_no_documents(spark, no_docs):
    one = spark.createDataFrame([(1, "abcdefghi")], "doc_id long, text string")
    row = ctph.compare_with_next(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefabc").hexdigest() and row["near_next"] == 1.0
    assert ctph.compare_with_next(no_docs).count() == 0 and ctph.fingerprint_documents(no_docs).count() == 0
