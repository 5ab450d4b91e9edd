import hashlib
import re

import pytest
from pyspark.sql import functions as F

from terrafold.llm import fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text, rate=90, spm=20):
    """The contract read out: slices of code points."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_odd_documents(spark, odd_docs, odd_rows):
    odd = spark.createDataFrame([(900 + k, t, "en", "a", 0) for k, t in enumerate(["<", "<P", "a<S>b", "><M><", "<<<P", "S>", "<S<S", "\r\n x", "\U0001f600" * 9])], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.unionByName(odd, allowMissingColumns=True).withColumns({"fim": F.lit(1), "own0": F.lit(2), "a.b": F.lit(3)})
    made = fim.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "fim_2"]
    got = made.select("doc_id", "text", "fim_2.*", fim.restore(F.col("fim_2.output"), F.col("fim_2.form")).alias("back"), "fim", "own0").collect()
    assert len(got) == docs.count()
    forms = set()
    for r in got:
        assert (r["units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and (r["fim"], r["own0"]) == (1, 2)
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_query_digests(spark, tables):
    from terrafold.llm import queries

    folder, _ = tables
    rows = {r["doc_id"]: r for r in queries.op13_fill_in_middle(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, form, a, b, output = plainly(d["doc_id"], d["text"])
        r = rows[d["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, a, b, sha(output), sha(d["text"] or ""))


@pytest.mark.parametrize("pattern", [r"\w+", r"[^\n]*\n|[^\n]+", r"zz+"])
def test_other_units(pattern):
    text = "  one two\nthree  zzz four\n\nfive "
    units = re.compile(pattern)
    ends = [0, *(m.end() for m in units.finditer(text))]
    assert fim.count_units(units, text) == len(ends) - 1
    for a in range(len(ends)):
        for b in range(a, len(ends)):
            assert fim.find_cuts(units, text, a, b) == (ends[a], ends[b])


def test_no_unit_is_kept():
    """Memory beside the text doesn't depend on the number of units."""
    import tracemalloc

    units, peaks = re.compile(fim.CODE_POINT), []
    for n in (1_000, 300_000):
        text = "ab" * n
        tracemalloc.start()
        assert fim.count_units(units, text) == 2 * n and fim.find_cuts(units, text, n, 2 * n - 1) == (n, 2 * n - 1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 20_000


def test_marks_that_could_be_confused_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<P", "<PX", "<M")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)
    assert fim.Marks("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>").middle == "<|fim_middle|>"


def test_other_marks_and_shares(spark):
    marks = fim.Marks("⟦pre⟧", "⟦suf⟧", "⟦mid⟧")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text ⟦ "), F.col("id")).alias("text"))
    got = fim.fill_in_middle(docs, pattern=r"\w+", marks=marks, rate=50, spm=50).select("*", fim.restore(F.col("fim.output"), F.col("fim.form"), marks).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in got)
    forms = [r["fim"]["form"] for r in got]
    assert 100 < forms.count("plain") < 200 and forms.count("psm") > 40 and forms.count("spm") > 40


def test_empty_table(no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0
