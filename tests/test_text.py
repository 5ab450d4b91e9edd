import pytest
from pyspark.sql import functions as F

from terrafold.functions import text as T


def values(spark, expression, *inputs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("v"))).collect()]


def test_white_space_follows_unicode(spark):
    assert values(spark, T.normalize_whitespace, "\u00a0 a\u2003 b\n", None, "") == ["a b", None, ""]
    assert values(spark, T.normalize_identifier, " 12 / 3 - A ", "12/3") == ["12/3-A", "12/3"]


@pytest.mark.parametrize(
    "text, value, unit",
    [("1200 sq ft", 1200, "sq_ft"), ("1,20,000 sq ft", 20000, "sq_ft"), ("12,345,678 sq ft", 345678, "sq_ft"), ("1,5 acre", 15, "acre"), ("2.5 Hectares", 2.5, "hectare"), ("111.5 m²", 111.5, "sq_m"), ("௧௨ acres", 12, "acre"), ("50 square meters", 50, "sq_m"), ("100 சதுர அடி", 100, "sq_ft")],
)
def test_areas(spark, text, value, unit):
    (got,) = values(spark, T.normalize_area, text)
    assert (got["value"], got["unit"]) == (value, unit)


def test_digits_of_any_script(spark):
    (area, digit_date, no_year) = spark.range(1).select(
        T.normalize_area(F.lit("\u0663\u0665,\u0665 acres")), T.iso_dates(F.lit("\u0968\u0966\u0968\u096a-\u0967-\u096b"))[0], T.iso_dates(F.lit("0000-1-5"))[0]
    ).first()
    assert (area.value, area.unit) == (355.0, "acre")
    assert (digit_date, no_year) == ("2024-01-05", "0000-1-5")


def test_sq_m_is_no_unit(spark):
    assert values(spark, T.normalize_area, "111.5 sq m", "no area", None) == [None, None, None]


def test_dates(spark):
    got = values(spark, T.record_information, "Doc 2020-1-5 and 2021/13/40", "none")
    assert got[0][0]["dates"] == ["2020-01-05", "2021/13/40"] and got[1][0]["dates"] is None


def test_case_folding_is_not_lower_case(spark):
    assert values(spark, T.comparison_text, "Straße:\u200b No – 1") == ["strasse no 1"]
    assert values(spark, T.matching_text, "ﬁeld  ①") == ["field 1"]


def test_labels(spark):
    assert values(spark, lambda c: T.inline_value(c, "Owner"), "Owner Name: X", "owner : Y ", "Co-owner: Z", "Owner") == ["Name: X", "Y", None, None]
    assert values(spark, lambda c: T.inline_value(c, "சர்வே எண்"), "சர்வே எண்: 12/3") == ["12/3"]
    lengths = [len(label) for _, _, label in T.labels_by_length()]
    assert lengths == sorted(lengths, reverse=True)


def test_error_rates(spark):
    df = spark.createDataFrame([("", "", 0), ("", "x", 1), ("abcd", "abxd", 2), ("a b c", "a c", 3)], "r string, h string, k int").orderBy("k")
    assert [r[0] for r in df.select(T.character_error_rate(F.col("r"), F.col("h"))).collect()][:3] == [0.0, 1.0, 0.25]
    assert df.select(T.word_error_rate(F.col("r"), F.col("h"))).collect()[3][0] == pytest.approx(1 / 3)


def test_login_ids_keep_long_numbers(spark):
    df = spark.createDataFrame([("admin", 7), ("VIEWER", 12345678), ("none", 1)], "r string, n long")
    assert [r[0] for r in df.select(T.login_id(F.col("r"), F.col("n"))).collect()] == ["ADM-TN-000007", "VWR-TN-12345678", None]


def test_redaction(spark):
    text = '{"a":{"Api_Token":1,"b":["x","https://s?X-Amz-Signature=1"]},"password":"p","n":2}'
    assert values(spark, T.redact_json, text, "not json", None) == ['{"a":{"b":["x","[redacted]"]},"n":2}', None, None]
    df = spark.sql("SELECT map('k', 'v', 'My_Secret', 's') AS m")
    assert df.select(T.redact_flat(F.col("m"))).first()[0] == {"k": "v"}


def test_small_functions(spark):
    assert values(spark, T.language_list, "tam+eng", "tam+tam", "T", "eng+") == [["tam", "eng"], None, None, None]
    assert values(spark, lambda c: T.storage_key(F.lit("p"), F.lit("f"), c), "a b/c.pdf") == ["projects/p/files/f/a_b_c.pdf"]
    assert values(spark, T.is_login_id, " adm-tn-000001", "ADM-TN-1") == [True, False]
    import uuid

    p = "12345678-1234-5678-1234-567812345678"
    assert values(spark, lambda c: T.issue_target(F.lit(p), c), "k") == [str(uuid.uuid5(uuid.UUID(p), "k"))]


def test_whole_queries_take_texts_of_any_script(spark, tmp_path):
    import hashlib
    import re

    from terrafold.plans import catalog

    texts = ["plain words", "Grün\u00a0ist \u2003 schön", " \u201cquoted\u201d \u2013 dash\n", "\U0001f600 smile", "日本\u3000語 தமிழ்", "", None, "last \u2028 é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    space = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    want = {k: None if t is None else hashlib.md5(re.sub(space, " ", t).strip(" ").encode()).hexdigest() for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["digest"] for r in catalog.normalize_texts(spark, str(tmp_path)).collect()} == want

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rates = {k: None if b is None else distance(a, b) / len(a) for k, (a, b) in enumerate(zip(texts, texts[1:])) if a}
    assert {r["item_id"]: r["cer"] for r in catalog.error_rates_whole(spark, str(tmp_path)).collect()} == rates


def test_empty_references_are_rated(spark, tmp_path):
    """By the rule for them, in the query and in its SQL."""
    import duckdb

    from terrafold.plans import catalog

    texts = ["ab", "", "", "cd", "é日", "é", None, "x", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["cer"] for r in catalog.error_rates(spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0, 3: 1.0, 4: 0.5, 5: None, 6: None, 7: None, 8: None}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert dict(con.sql(catalog.ORACLE["error_rates"]).fetchall()) == got
