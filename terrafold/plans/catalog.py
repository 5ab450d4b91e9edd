"""Registered queries over the synthetic tables, each beside the SQL that gives the same rows.

The tables stand in for land records: orders for documents and records, customers for parcels, line items for candidates
and versions, events for jobs and audit logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geojson as J
from ..functions import geometry as G
from ..functions import overlay
from ..functions import projections as P
from ..functions import raster as R
from ..functions import scores as S
from ..functions import text as T
from ..operators import access, cadastre, dashboard, extraction, features, gis, imagery, jobs, linking, mosaic, paging, projects, rules, scans, shapes, versions
from ..operators.graph import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT p.l_orderkey AS order_id, CAST(p.l_linenumber AS BIGINT) AS line, p.unit_price, p.p_retailprice AS list_price,
       abs(p.unit_price - p.p_retailprice) / greatest(p.unit_price, p.p_retailprice) AS relative_difference,
       CASE WHEN abs(p.unit_price - p.p_retailprice) / greatest(p.unit_price, p.p_retailprice) >= 0.20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) p
WHERE p.unit_price > 0 AND p.p_retailprice > 0 AND abs(p.unit_price - p.p_retailprice) / greatest(p.unit_price, p.p_retailprice) > 0.05
""")
def area_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Line items as linked records, parts as parcels, unit prices as areas."""
    lines = table(spark, d, "lineitem").filter("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("document_area_m2"))
    parcels = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("parcel_area_m2"))
    found = linking.area_mismatches(lines.join(parcels, "l_partkey"))
    return found.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("document_area_m2").alias("unit_price"), F.col("parcel_area_m2").alias("list_price"), "relative_difference", "severity")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.rollup(table(spark, d, "orders"), "o_orderstatus")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X" FROM orders""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.pivoted(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("""
SELECT o.*, c.*, e.* FROM
 (SELECT count(*) AS records, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS pending_records, count(DISTINCT o_custkey) AS parcels_with_records FROM orders) o,
 (SELECT count(*) AS parcels, count(*) FILTER (c_acctbal < 0) AS parcels_in_debt FROM customer) c,
 (SELECT count(*) FILTER (event_type = 'error') AS failed_jobs, count(DISTINCT user_id) AS actors FROM events) e
""")
def dashboard_counters(spark: SparkSession, d: str) -> DataFrame:
    """Three scans for seven counters."""
    return dashboard.counters(
        records=(table(spark, d, "orders"), {"records": F.count("*"), "pending_records": F.count_if(F.col("o_orderstatus").isin("O", "P")), "parcels_with_records": F.count_distinct("o_custkey")}),
        parcels=(table(spark, d, "customer"), {"parcels": F.count("*"), "parcels_in_debt": F.count_if(F.col("c_acctbal") < 0)}),
        jobs=(table(spark, d, "events"), {"failed_jobs": F.count_if(F.col("event_type") == "error"), "actors": F.count_distinct("user_id")}),
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unlinked_records(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return paging.without(table(spark, d, "customer").select("c_custkey", "c_name"), linked, "c_custkey")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 60 OFFSET 120")
def next_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of sixty orders, found from the second one's last row, which the first two give."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    keys, last = {"o_orderdate": "desc", "o_orderkey": "asc"}, None
    for _ in range(2):
        last = paging.page_after(rows, keys, last, 60).agg(F.min_by(F.struct(*keys), F.struct("o_orderdate", -F.col("o_orderkey")))).first()[0]
    return paging.page_after(rows, keys, last and last.asDict(), 60)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    rows = paging.page_with_total(table(spark, d, "orders"), F.desc("o_orderdate"), "o_orderkey", limit=50, offset=50)
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice", "total")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3) AND o_totalprice > 1000
""")
def filtered_page(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    found = paging.filtered(orders, {"o_orderstatus": "O", "o_orderdate": None}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_custkey": [1, 2, 3]}, [F.col("o_totalprice") > 1000, None])
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_brand, p_type <> 'ECONOMY' AS preliminary FROM part WHERE p_name ILIKE '%red%' OR p_name ILIKE '%r_ng%'")
def ilike_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(paging.contains_any("red", "p_name") | paging.contains_any("r_ng", "p_name")).select("p_partkey", "p_name", "p_brand", (F.col("p_type") != "ECONOMY").alias("preliminary"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_name) LIKE '%00012%' OR lower(c_mktsegment) LIKE '%00012%' OR lower(c_mktsegment) LIKE '%house%'")
def directory_search(spark: SparkSession, d: str) -> DataFrame:
    text = paging.contains_any("00012", "c_name", "c_mktsegment", fold="lower") | paging.contains_any("HOUSE", "c_mktsegment", fold="lower")
    return table(spark, d, "customer").filter(text).select("c_custkey", "c_name", "c_mktsegment")


@query("""
WITH a AS (SELECT 0 AS source_rank, 'part' AS kind, CAST(p_partkey AS BIGINT) AS id, p_name AS label FROM part WHERE p_name ILIKE '%blue%' ORDER BY id LIMIT 30),
b AS (SELECT 1, 'supplier', CAST(s_suppkey AS BIGINT), s_name FROM supplier WHERE s_name ILIKE '%1%' ORDER BY s_suppkey LIMIT 30),
c AS (SELECT 2, 'customer', CAST(c_custkey AS BIGINT), c_name FROM customer WHERE c_name ILIKE '%1%' ORDER BY c_custkey LIMIT 30),
u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) ORDER BY source_rank, id LIMIT 30),
n AS (SELECT *, row_number() OVER (PARTITION BY kind, label ORDER BY source_rank, id) AS k FROM u)
SELECT kind, id, label FROM n WHERE k = 1
""")
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Limits come before deduplication, so fewer than 30 rows can come back."""

    def source(name: str, kind: str, key: str, label: str, text: str) -> DataFrame:
        return table(spark, d, name).filter(paging.contains_any(text, label)).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"))

    found = paging.ranked_search([source("part", "part", "p_partkey", "p_name", "blue"), source("supplier", "supplier", "s_suppkey", "s_name", "1"), source("customer", "customer", "c_custkey", "c_name", "1")], 30, ["kind", "label"])
    return found.select("kind", "id", "label")


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('7', '42')")
def json_path_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(k.isin("7", "42")).select("event_id", "user_id", k.cast("long").alias("k"))


_LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events {where}) WHERE n = 1"


@query(_LATEST.format(where=""))
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest(table(spark, d, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query(_LATEST.format(where="WHERE event_type <> 'error'"))
def latest_valid_version(spark: SparkSession, d: str) -> DataFrame:
    """A newer error hides no older valid row."""
    return versions.latest(table(spark, d, "events"), "user_id", F.desc("ts"), F.desc("event_id"), where=F.col("event_type") != "error").select("user_id", "event_id", "event_type", "value")


@query("""
SELECT d.doc_id, d.lang, coalesce(l.v, d.lang) AS value FROM documents d
LEFT JOIN (SELECT doc_id, arg_max('Q' || CAST(quality AS VARCHAR), quality * 2 + toxic) AS v FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
""")
def correction_overlay(spark: SparkSession, d: str) -> DataFrame:
    fixes = table(spark, d, "labels").select("doc_id", F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("corrected_value"), (F.col("quality") * 2 + F.col("toxic")).alias("version"))
    base = table(spark, d, "documents").select("doc_id", "lang", F.col("lang").alias("value"))
    return versions.overlay(base, fixes, "doc_id", "value", "corrected_value", "version").select("doc_id", "lang", "value")


@query("""
SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS version, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 + o_orderkey % 3 WHERE l_partkey <> o_custkey
""")
def current_pointer(spark: SparkSession, d: str) -> DataFrame:
    """Orders point to one of their lines by number; the residual keeps a row from pointing to itself."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    found = versions.pointed(orders, lines, [orders.o_orderkey == lines.l_orderkey, lines.l_linenumber == 1 + orders.o_orderkey % 3, lines.l_partkey != orders.o_custkey])
    return found.select("o_orderkey", F.col("l_linenumber").cast("long").alias("version"), "l_partkey", "l_quantity")


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax"


@query(f"SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS n FROM lineitem) WHERE n = 1")
def first_candidate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("place", F.struct(*_LINE_ORDER.split(", ")))
    return versions.first_candidate(rows, ["l_orderkey"], "place", "l_partkey", "l_quantity")


@query(f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS field, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, {_LINE_ORDER}) - 1 AS BIGINT) AS candidate_index
FROM lineitem
""")
def candidate_index(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers in the fields' canonical order (N, R, A), not in reading order."""
    field = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    rows = versions.numbered(table(spark, d, "lineitem"), "l_orderkey", field, *(F.col(c) for c in _LINE_ORDER.split(", ")))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("field"), F.col("candidate_index").cast("long").alias("candidate_index"))


@query("SELECT o_orderkey, CAST(coalesce(m, 0) + 1 AS BIGINT) AS next_version FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return versions.next_version(table(spark, d, "orders"), lines, "o_orderkey", "l_linenumber").withColumn("next_version", F.col("next_version").cast("long"))


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role FROM conversations")
def next_line_lookahead(spark: SparkSession, d: str) -> DataFrame:
    return versions.with_next(table(spark, d, "conversations"), "conv_id", F.col("turn"), F.col("role"), F.col("text"), column="role", name="next_role").select("conv_id", "turn", "role", "next_role")


@query("""
WITH RECURSIVE w AS (SELECT l_orderkey AS doc, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 30.0 AS DOUBLE) AS d, l_linenumber * 10 AS "left", CAST(l_partkey AS INT) AS region, l_returnflag AS t FROM lineitem),
o AS (SELECT doc, CAST(trunc(d) AS INT) AS top, "left", region, t, row_number() OVER (PARTITION BY doc ORDER BY CAST(trunc(d) AS INT), "left", region, t) AS n FROM w),
r AS (SELECT doc, n, top, "left", region, t, top AS anchor, 0 AS line FROM o WHERE n = 1
  UNION ALL SELECT o.doc, o.n, o.top, o."left", o.region, o.t, CASE WHEN abs(o.top - r.anchor) <= 6 THEN r.anchor ELSE o.top END, CASE WHEN abs(o.top - r.anchor) <= 6 THEN r.line ELSE r.line + 1 END FROM r JOIN o ON o.doc = r.doc AND o.n = r.n + 1)
SELECT CAST(doc AS VARCHAR) AS document_id, line, string_agg(t, ' ' ORDER BY "left", top, region, t) AS text, CAST(count(*) AS INT) AS words FROM r GROUP BY doc, line
""")
def line_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Line items as words of a page: ship day as top, line number as left."""
    day = (F.datediff("l_shipdate", F.lit("1992-01-01")) / 30).cast("int")
    box = F.struct((F.col("l_linenumber") * 10).cast("int").alias("left"), day.alias("top"), F.lit(8).alias("width"), F.lit(12).alias("height"))
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("l_partkey").cast("int").alias("region_number"), F.col("l_returnflag").alias("text"), F.lit(0.9).alias("confidence"), box.alias("box"))
    grouped = extraction.lines(words)
    return grouped.select("document_id", "line", "text", F.size("tokens").alias("words"))


@query(r"""
SELECT o_orderkey, upper(trim(regexp_replace('  ' || o_orderpriority || '  x ', '\s+', ' ', 'g'))) AS plain,
       regexp_replace(trim(regexp_replace(o_orderpriority || ' / ' || CAST(o_custkey AS VARCHAR) || ' - A', '\s+', ' ', 'g')), '\s*([/-])\s*', '\1', 'g') AS identifier
FROM orders
""")
def normalize_identifiers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("o_orderpriority", F.lit(" / "), F.col("o_custkey").cast("string"), F.lit(" - A"))
    plain = F.upper(T.normalize_whitespace(F.concat(F.lit("  "), "o_orderpriority", F.lit("  x "))))
    return table(spark, d, "orders").select("o_orderkey", plain.alias("plain"), T.normalize_identifier(raw).alias("identifier"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')) AS digest FROM documents""")
def normalize_texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents, whatever their script; the SQL spells Unicode's white space out."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("digest"))


_AREA_CASE = "CASE l_linenumber % 5 WHEN 0 THEN 'sq. ft' WHEN 1 THEN 'm2' WHEN 2 THEN 'Acres' WHEN 3 THEN 'hectare' ELSE 'sq m' END"


@query(f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey,
  CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE l_quantity END AS value,
  CASE l_linenumber % 5 WHEN 0 THEN 'sq_ft' WHEN 1 THEN 'sq_m' WHEN 2 THEN 'acre' WHEN 3 THEN 'hectare' ELSE NULL END AS unit,
  CASE l_linenumber % 5 WHEN 0 THEN l_quantity / 10.7639104167::DOUBLE WHEN 1 THEN l_quantity ELSE NULL END AS m2
FROM lineitem
""")
def normalize_area(spark: SparkSession, d: str) -> DataFrame:
    """"sq m" is no unit that the pattern knows."""
    unit = F.expr(_AREA_CASE)
    area = T.normalize_area(F.concat(F.lit("about "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), unit))
    rows = table(spark, d, "lineitem").withColumn("area", area)
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", F.col("area.value").alias("value"), F.col("area.unit").alias("unit"), T.area_m2(F.col("area")).alias("m2"))


@query("""
SELECT o_orderkey, 'Order of ' || strftime(o_orderdate, '%Y/%-m/%-d') || ' and 2023-2-30' AS value, strftime(o_orderdate, '%Y-%m-%d') || '|2023-2-30' AS dates FROM orders
""")
def record_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates that exist are padded, others stay as they stand."""
    raw = F.concat(F.lit("Order  of "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" and 2023-2-30 "))
    entry = T.record_information(raw)[0]
    return table(spark, d, "orders").select("o_orderkey", entry["value"].alias("value"), F.array_join(entry["dates"], "|").alias("dates"))


@query("""
SELECT c_custkey, 'owner_details' AS field_name, c_name AS value, CAST(0 AS BIGINT) AS label_order FROM customer
UNION ALL SELECT c_custkey, 'owner_details', 'Name: ' || c_name, 1 FROM customer
UNION ALL SELECT c_custkey, 'survey_number', CAST(c_custkey AS VARCHAR) || '/' || CAST(c_nationkey AS VARCHAR), 0 FROM customer
""")
def label_value_extract(spark: SparkSession, d: str) -> DataFrame:
    """A label inside another yields a candidate for both."""
    token = lambda text, top, n: F.struct(F.lit(1).alias("page_number"), F.lit(n).alias("region_number"), text.alias("text"), F.lit(0.9).alias("confidence"), F.struct(F.lit(0).alias("left"), F.lit(top).alias("top"), F.lit(100).alias("width"), F.lit(10).alias("height")).alias("box"))
    owner, survey = F.concat(F.lit("Owner Name: "), F.col("c_name")), F.concat(F.lit("Survey No. "), F.col("c_custkey").cast("string"), F.lit(" / "), F.col("c_nationkey").cast("string"))
    words = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.explode(F.array(token(owner, 0, 0), token(survey, 40, 1))).alias("t")).select("document_id", "t.*")
    found = extraction.candidates(words)
    value = F.when(F.col("field_name") == "survey_number", F.col("normalized.text")).otherwise(F.col("original_value"))
    order = F.when(F.col("original_value").startswith("Name: "), 1).otherwise(0).cast("long")
    return found.select(F.col("document_id").cast("long").alias("c_custkey"), "field_name", value.alias("value"), order.alias("label_order"))


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, c.band, round(least(1, greatest(0, 0.75 * c.score + 0.15 + CASE WHEN l_returnflag = 'N' THEN 0.05 ELSE 0.03 END + CASE WHEN l_linestatus = 'F' THEN 0.05 ELSE 0 END)), 9) AS confidence
FROM (SELECT *, 1 - l_discount * 4 AS score, CASE WHEN 1 - l_discount * 4 >= 0.9 THEN 'HIGH' WHEN 1 - l_discount * 4 >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM lineitem) c
""")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    score = 1 - F.col("l_discount") * 4
    made = S.extraction_confidence(score, F.col("l_returnflag") == "N", F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", S.confidence_band(score).alias("band"), F.round(made, 9).alias("confidence"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Line items as candidates: an order is a document, its return flags are fields."""
    none = F.lit(None).cast("double")
    normal = F.struct(F.lit("text").alias("kind"), F.col("l_linestatus").alias("text"), none.alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("array<struct<value:string,dates:array<string>>>").alias("entries"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_returnflag").alias("field_name"), F.col("l_linenumber").alias("candidate_index"), F.col("l_linestatus").alias("original_value"), normal.alias("normalized"),
        F.when(F.col("l_quantity") < 49, 1 - F.col("l_discount") * 3).alias("confidence"), F.lit(1).alias("page_number"),
    )


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag, min(CASE WHEN l_quantity < 49 THEN 1 - l_discount * 3 END) AS least, count(*) FILTER (l_quantity >= 49) AS unknown FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey, min(least) AS least, count(least) AS contributing_fields, count(*) FILTER (unknown > 0 OR least IS NULL) AS unknown_fields, count(*) AS present FROM f GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CASE WHEN unknown_fields = 0 THEN least END AS value,
  CASE WHEN unknown_fields > 0 OR least IS NULL THEN 'UNKNOWN' WHEN least >= 0.9 THEN 'HIGH' WHEN least >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  contributing_fields, CAST(3 - present AS BIGINT) AS missing_fields, unknown_fields FROM g
""")
def confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.confidence_summary(_candidates(spark, d), 3)


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_returnflag AS field_name, count(DISTINCT l_linestatus) AS distinct_values FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(DISTINCT l_linestatus) > 1
""")
def field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return rules.conflicting(_candidates(spark, d)).select("document_id", "field_name", F.col("values").alias("distinct_values"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority NOT SIMILAR TO '[1-3]-[A-Z]+' THEN 'INVALID_FIELD_FORMAT' END AS format_issue, CASE WHEN o_custkey % 10 = 0 THEN 'REQUIRED_FIELD_MISSING' END AS required_issue,
       CASE WHEN substr(o_orderpriority, 1, 1) <> CAST(1 + o_orderkey % 5 AS VARCHAR) THEN 'CROSS_FIELD_MISMATCH' END AS cross_issue FROM orders
""")
def required_format_rules(spark: SparkSession, d: str) -> DataFrame:
    owner = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string")).otherwise("  ")
    cross = rules.fields_agree(F.substring("o_orderpriority", 1, 1), (1 + F.col("o_orderkey") % 5).cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(~T.matches_format(F.col("o_orderpriority"), "[1-3]-[A-Z]+"), "INVALID_FIELD_FORMAT").alias("format_issue"), F.when(T.is_blank(owner), "REQUIRED_FIELD_MISSING").alias("required_issue"),
        cross.alias("cross_issue"),
    )


@query("""
WITH i AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS document_id, 'UNKNOWN_CONFIDENCE' AS code, l_returnflag AS f FROM lineitem WHERE l_quantity >= 49
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'LOW_CONFIDENCE', l_returnflag FROM lineitem WHERE l_quantity < 49 AND 1 - l_discount * 3 < 0.75
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'FIELD_VALUE_CONFLICT', l_returnflag FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(DISTINCT l_linestatus) > 1
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'REQUIRED_FIELD_MISSING', 'N' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')),
p AS (SELECT document_id, count(*) AS n, count(*) FILTER (code = 'REQUIRED_FIELD_MISSING') AS b FROM i GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN n > 0 THEN 'REVIEW_REQUIRED' ELSE 'VALID' END AS status, coalesce(n > 0, false) AS review_required,
  CASE WHEN b > 0 THEN 'HIGH' WHEN n > 0 THEN 'MEDIUM' ELSE 'INFO' END AS severity, coalesce(n, 0) AS issues, coalesce(b, 0) AS blocking_issue_count
FROM orders LEFT JOIN p ON CAST(o_orderkey AS VARCHAR) = document_id
""")
def validation_status(spark: SparkSession, d: str) -> DataFrame:
    policy = rules.Policy(required_fields=("N",))
    documents = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"))
    issues = rules.validate(documents, _candidates(spark, d), policy)
    return rules.report(documents, issues, policy).select("document_id", "status", "review_required", "severity", F.col("issues").cast("long").alias("issues"), F.col("blocking_issue_count").cast("long").alias("blocking_issue_count"))


@query("SELECT lower(p_name) AS identifier, count(DISTINCT p_partkey) AS documents, min(p_partkey) AS first_document FROM part WHERE p_name <> '' GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    evidence = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.lit("survey_number").alias("field_name"), T.matching_text(F.col("p_name"), True).alias("identifier"))
    return linking.duplicate_records(evidence)


def _record_matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Matches, and the parcels they are with."""
    orders, places = table(spark, d, "orders"), F.broadcast(table(spark, d, "nation"))
    parcels = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("parcel_id"), F.lit(1).alias("project_id"), F.col("c_custkey").cast("string").alias("identifier"),
        F.create_map(F.lit("village"), F.col("c_nationkey").cast("string"), F.lit("taluk"), F.col("n_regionkey").cast("string")).alias("admin"), F.abs("c_acctbal").alias("area_m2"),
    )
    identifiers = orders.select(F.col("o_orderkey").alias("record_id"), F.lit(1).alias("project_id"), F.col("o_custkey").cast("string").alias("identifier"))
    entry = lambda name, values: F.struct(F.lit(name).alias("field"), values.alias("values"))
    village = F.when(F.col("o_custkey") % 7 != 0, F.array((F.col("o_orderkey") % 25).cast("string"))).otherwise(F.array().cast("array<string>"))
    admin = orders.select(F.col("o_orderkey").alias("record_id"), F.explode(F.array(entry("village", village), entry("tehsil", F.array((F.col("o_orderkey") % 5).cast("string"))))).alias("e")).select("record_id", "e.*")
    areas = orders.select(F.col("o_orderkey").alias("record_id"), (F.col("o_totalprice") / 50).alias("area_m2"))
    return linking.match_records(identifiers, parcels, admin, areas), parcels


_MATCHED = """m AS (SELECT o_orderkey, c_custkey, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_orderkey % 25 = c_nationkey THEN 1 ELSE 0 END AS v, CASE WHEN o_orderkey % 5 = n_regionkey THEN 1 ELSE 0 END AS t,
  coalesce(o_totalprice > 0 AND abs(c_acctbal) > 0 AND abs(o_totalprice / 50 - abs(c_acctbal)) / greatest(o_totalprice / 50, abs(c_acctbal)) <= 0.05, false) AS ok,
  abs(o_totalprice / 50 - abs(c_acctbal)) / greatest(o_totalprice / 50, abs(c_acctbal)) AS apart
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, coalesce(v, 0) + t AS a, (CASE WHEN v = 0 THEN 1 ELSE 0 END) + (1 - t) AS x FROM m)"""


@query(f"""
WITH {_MATCHED}
SELECT o_orderkey AS record_id, c_custkey AS parcel_id, CAST(a AS BIGINT) AS admin_matches, CAST(x AS BIGINT) AS admin_conflicts, ok AS area_ok,
  CAST(round(least(1, greatest(0, 0.9 + least(a, 2) * 0.03 + CASE WHEN ok THEN 0.03 ELSE 0 END - x * 0.45)), 9) AS DOUBLE) AS confidence,
  CASE WHEN a > 0 AND x = 0 AND 0.9 + least(a, 2) * 0.03 + CASE WHEN ok THEN 0.03 ELSE 0 END >= 0.9500001 THEN 'CONFIRMED' ELSE 'REVIEW_REQUIRED' END AS link_status
FROM s
""")
def record_parcel_match(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records, customers as parcels, nations and regions as administrative names, prices as areas."""
    found, _ = _record_matches(spark, d)
    return found.select("record_id", "parcel_id", F.col("admin_matches").cast("long").alias("admin_matches"), F.col("admin_conflicts").cast("long").alias("admin_conflicts"), "area_ok", F.round("confidence", 9).alias("confidence"), "link_status")


_SUGGESTED = f"""{_MATCHED},
n AS (SELECT *, o_orderkey || ':' || c_custkey || ':' || CASE WHEN o_orderkey % 6 = 1 THEN 2 ELSE 1 END AS link_id,
  CASE WHEN a > 0 AND x = 0 AND 0.9 + least(a, 2) * 0.03 + CASE WHEN ok THEN 0.03 ELSE 0 END >= 0.9500001 THEN 'CONFIRMED' ELSE 'REVIEW_REQUIRED' END AS link_status
  FROM s WHERE o_orderkey % 6 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)"""


def _suggested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run of suggestions: every sixth order is linked already, others were rejected once; not all are valid."""
    matches, parcels = _record_matches(spark, d)
    order, orders = F.col("o_orderkey"), table(spark, d, "orders")
    records = orders.select(order.alias("record_id"), F.when(order % 11 != 0, "VALIDATED").otherwise("REVIEW_REQUIRED").alias("document_status"), F.when(order % 13 != 0, "VALID").otherwise("INVALID").alias("validation_status"))
    links = orders.filter(order % 6 <= 1).select(order.alias("record_id"), F.col("o_custkey").alias("parcel_id"), F.when(order % 6 == 0, "SUGGESTED").otherwise("REJECTED").alias("link_status"))
    field = lambda k, name, value, page: F.struct((order * 10 + k).alias("field_id"), F.lit(name).alias("field_name"), value.cast("string").alias("value"), page.alias("page_number"))
    read = F.array(field(0, "khasra_number", F.col("o_custkey"), F.lit(1)), field(1, "village", F.when(F.col("o_custkey") % 7 != 0, order % 25), F.lit(2)), field(2, "tahsil", order % 5, (order % 2 + 1).cast("int")), field(3, "owner_name", F.col("o_custkey"), F.lit(9)))
    fields = orders.select(order.alias("record_id"), (order % 2).alias("source_id"), F.inline(read))
    return linking.suggest(matches, records, links, linking.contributing_fields(matches, parcels, fields))


@query(f"""
WITH {_SUGGESTED}
SELECT link_id, o_orderkey AS record_id, c_custkey AS parcel_id, link_status, 'EXACT_SURVEY_IDENTIFIER' AS link_method,
  CAST(round(least(1, greatest(0, 0.9 + least(a, 2) * 0.03 + CASE WHEN ok THEN 0.03 ELSE 0 END - x * 0.45)), 9) AS DOUBLE) AS confidence,
  array_to_string(list_filter([CASE WHEN v = 1 THEN 'village' END, CASE WHEN t = 1 THEN 'tehsil' END], lambda f: f IS NOT NULL), '|') AS matching,
  array_to_string(list_filter([CASE WHEN v = 0 THEN 'village' END, CASE WHEN t = 0 THEN 'tehsil' END], lambda f: f IS NOT NULL), '|') AS conflicting, ok AS compatible, round(apart, 9) AS apart FROM n
""")
def link_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Links that a run appends, with what their rationale says."""
    links, _, _ = _suggested(spark, d)
    said = F.from_json("rationale", "match_factors struct<matching_admin_fields:array<string>,conflicting_admin_fields:array<string>,area_compatible:boolean>, area_comparison struct<relative_difference:double>")
    factors = F.col("said.match_factors")
    return links.withColumn("said", said).select(
        "link_id", "record_id", "parcel_id", "link_status", "link_method", F.round("confidence", 9).alias("confidence"), F.array_join(factors["matching_admin_fields"], "|").alias("matching"),
        F.array_join(factors["conflicting_admin_fields"], "|").alias("conflicting"), factors["area_compatible"].alias("compatible"), S.rounded(F.col("said.area_comparison.relative_difference"), 9).alias("apart"),
    )


@query(f"""
WITH {_SUGGESTED}
SELECT link_id AS target_id, 'RECORD_PARCEL_LINK' AS target_type, 'MEDIUM' AS severity, array_to_string(list_sort(list_distinct(['parcel:' || c_custkey, 'document:' || o_orderkey % 2 || ':page:1',
  CASE WHEN v = 1 THEN 'document:' || o_orderkey % 2 || ':page:2' END, CASE WHEN t = 1 THEN 'document:' || o_orderkey % 2 || ':page:' || (o_orderkey % 2 + 1) END])), '|') AS source_refs FROM n WHERE link_status = 'REVIEW_REQUIRED'
""")
def link_review_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Review tasks that a run of suggestions opens, with the pages they rest on."""
    _, tasks, _ = _suggested(spark, d)
    return tasks.select("target_id", "target_type", "severity", F.array_join("source_refs", "|").alias("source_refs"))


@query(f"""
WITH {_SUGGESTED}
SELECT CASE link_status WHEN 'CONFIRMED' THEN 'record_parcel_link.auto_confirmed' ELSE 'record_parcel_link.suggested' END AS action, count(*) AS n, count(DISTINCT o_orderkey) AS records FROM n GROUP BY 1
""")
def link_audit(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows of a run of suggestions, by action."""
    _, _, audit = _suggested(spark, d)
    return audit.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))


@query("""
WITH q AS (SELECT event_id, event_id % 200 AS r, user_id % 4 + CASE WHEN event_id % 50 = 49 THEN -9 ELSE 0 END AS p FROM events),
v AS (SELECT DISTINCT o_orderkey AS r FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 0), t AS (SELECT DISTINCT c_custkey AS p FROM customer),
c AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS p FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 3 = 0), a AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS p FROM lineitem WHERE l_linenumber = 1 UNION SELECT * FROM c),
j AS (SELECT q.*, CASE WHEN v.r IS NULL THEN 'RECORD_NOT_VALID' WHEN t.p IS NULL THEN 'PARCEL_NOT_FOUND' WHEN a.r IS NOT NULL THEN 'EXISTING' WHEN q.r IN (SELECT r FROM c) THEN 'ALREADY_CONFIRMED' END AS st
  FROM q LEFT JOIN v ON q.r = v.r LEFT JOIN t ON q.p = t.p LEFT JOIN a ON q.r = a.r AND q.p = a.p),
f AS (SELECT r, min(event_id) AS first, arg_min(p, event_id) AS first_p FROM j WHERE st IS NULL GROUP BY 1)
SELECT event_id AS request_id, j.r AS record_id, p AS parcel_id, coalesce(st, CASE WHEN first = event_id THEN 'CREATED' WHEN first_p = p THEN 'EXISTING' ELSE 'ALREADY_CONFIRMED' END) AS outcome FROM j LEFT JOIN f ON j.r = f.r
""")
def manual_links(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to link an order to a customer; first lines of orders are suggested links, some second ones confirmed."""
    one, line, supplier = F.lit(1).alias("project_id"), F.col("l_linenumber"), F.col("l_suppkey")
    requests = table(spark, d, "events").select(F.col("event_id").alias("request_id"), one, (F.col("event_id") % 200).alias("record_id"), (F.col("user_id") % 4 + F.when(F.col("event_id") % 50 == 49, -9).otherwise(0)).alias("parcel_id"))
    records = table(spark, d, "orders").select(one, F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") != "P", "VALIDATED").otherwise("FAILED").alias("document_status"), F.when(F.col("o_orderkey") % 11 != 0, "VALID").otherwise("INVALID").alias("validation_status"))
    status = F.when(line == 1, "SUGGESTED").when((line == 2) & (supplier % 3 == 0), "CONFIRMED").otherwise("REJECTED")
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), supplier.alias("parcel_id"), status.alias("link_status"))
    return linking.manual_links(requests, records, table(spark, d, "customer").select(one, F.col("c_custkey").alias("parcel_id")), links)


@query("""
WITH e AS (SELECT user_id, max(event_id) AS k, arg_max(event_type, event_id) AS t FROM events WHERE event_id < 5000 GROUP BY 1), f AS (SELECT user_id, max(event_id) AS k, arg_max(event_type, event_id) AS t FROM events WHERE event_id >= 5000 GROUP BY 1)
SELECT CAST(coalesce(e.user_id, f.user_id) AS VARCHAR) AS issue_key,
  CASE WHEN e.user_id IS NULL OR (f.user_id IS NOT NULL AND e.t <> 'error') THEN f.t ELSE e.t END AS summary,
  CASE WHEN e.user_id IS NULL THEN 'OPEN' WHEN e.t = 'error' THEN 'RESOLVED' ELSE 'OPEN' END AS status,
  CASE WHEN e.user_id IS NULL THEN 'created' WHEN f.user_id IS NULL THEN 'kept' WHEN e.t <> 'error' THEN 'refreshed' ELSE 'left' END AS outcome
FROM e FULL OUTER JOIN f ON e.user_id = f.user_id
""")
def issue_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two runs' findings by user: those of the first half of the events stand, those of the second come in."""
    events = table(spark, d, "events")
    run = lambda where: events.filter(where).groupBy(F.col("user_id").cast("string").alias("issue_key")).agg(F.max_by("event_type", "event_id").alias("summary")).withColumn("severity", F.lit("HIGH"))
    existing = run("event_id < 5000").withColumn("status", F.when(F.col("summary") == "error", "RESOLVED").otherwise("OPEN"))
    return linking.upsert_issues(existing, run("event_id >= 5000")).select("issue_key", "summary", "status", "outcome")


_STEPS = ", ".join(f"({k}, '{name}', '{needs}', '{leads}')" for k, (name, (needs, leads)) in enumerate(jobs.TRANSITIONS.items()))


@query(f"""
WITH RECURSIVE t(k, name, needs, leads) AS (VALUES {_STEPS}), e AS (SELECT user_id, event_id % {len(jobs.TRANSITIONS)} AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'QUEUED' AS status, 0 AS retries, 0 AS illegal FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT s.user_id, e.n, CASE WHEN s.status = needs THEN leads ELSE s.status END, retries + CASE WHEN s.status = needs AND name IN ('retry', 'recover') THEN 1 ELSE 0 END, illegal + CASE WHEN s.status = needs THEN 0 ELSE 1 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1 JOIN t ON t.k = e.k)
SELECT user_id, status, retries AS retry_count, CASE status WHEN 'COMPLETED' THEN 100 WHEN 'PROCESSING' THEN 1 WHEN 'FAILED' THEN 1 ELSE 0 END AS progress, illegal FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
""")
def job_state_fold(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as transitions of one job."""
    kind = F.element_at(F.array(*map(F.lit, jobs.TRANSITIONS)), (F.pmod(F.col("event_id"), F.lit(len(jobs.TRANSITIONS))) + 1).cast("int"))
    return jobs.fold_states(table(spark, d, "events").withColumn("event", kind), "user_id", ["ts", "event_id"], "event")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_id >= 1000) WHERE n = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id < 1000)")
def idempotent_jobs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return jobs.create_or_get(events.filter("event_id < 1000"), events.filter("event_id >= 1000"), ["user_id", "event_type"], "event_id")


@query("SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) AND s_acctbal > 0")
def row_level_security(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as rows, nations as projects: a user belongs to the nations of two regions and holds one permission."""
    members = table(spark, d, "nation").filter("n_regionkey IN (1, 3)").select(F.col("n_nationkey").alias("project_id"), F.lit("u1").alias("user_id"))
    roles = spark.createDataFrame([("u1", "r1")], "user_id string, role_id string")
    granted = access.user_permissions(roles, spark.createDataFrame([("r1",)], "id string"), spark.createDataFrame([("r1", "p1")], "role_id string, permission_id string"), spark.createDataFrame([("p1", "record:read")], "id string, code string"))
    rows = table(spark, d, "supplier").filter("s_acctbal > 0").withColumn("project_id", F.col("s_nationkey"))
    return access.visible(rows, members, granted, "u1", "record:read").select("s_suppkey", "s_name")


@query("""
WITH o AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS document_id, coalesce(n_name, '') AS original_name, c_mktsegment AS status, coalesce(s, '') AS validation_status, coalesce(CAST(q AS VARCHAR), '') AS quantity
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, CAST(arg_min(l_quantity, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON l_orderkey = k
""")
def records_export(spark: SparkSession, d: str) -> DataFrame:
    """Customers as documents, nations as files, the latest order's first line as latest first field."""
    orders = table(spark, d, "orders")
    documents = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.col("c_nationkey").alias("file_id"), F.col("c_mktsegment").alias("status"))
    files = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("original_name"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), F.lit("quantity").alias("field_name"), F.col("l_quantity").cast("long").cast("string").alias("original_value"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("candidate_index"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    owner = orders.select(F.col("o_orderkey").alias("version"), F.col("o_custkey").cast("string").alias("document_id"))
    # only the latest orders' lines have a say, and an order without lines is a latest one too; the orders are hashed, so that lines are dealt once and never sorted
    latest = owner.groupBy("document_id").agg(F.max("version").alias("version"))
    every = lines.join(latest.hint("shuffle_hash"), "version")
    none = spark.createDataFrame([], "extracted_field_id string, version int, corrected_value string").limit(0)  # known to be empty: no field is dealt by its id
    checks = orders.select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return dashboard.records_export(documents, files, every, none, checks, ("quantity",))


@query(f"""
WITH f AS (SELECT l_orderkey AS doc, l_partkey % 2 AS version, l_suppkey % 7 AS field, CAST(l_partkey AS VARCHAR) AS v, l_partkey % 3 AS p, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS i FROM lineitem),
l AS (SELECT *, max(version) OVER (PARTITION BY doc) AS newest FROM f), e AS (SELECT doc, field, arg_min(CASE p WHEN 0 THEN v || '/2' WHEN 1 THEN v || '/1' ELSE v END, i) AS v FROM l WHERE version = newest GROUP BY 1, 2),
w AS (SELECT doc, max(v) FILTER (field = 0) AS survey, coalesce(max(v) FILTER (field = 1), max(v) FILTER (field = 2)) AS parcel, max(v) FILTER (field = 3) AS area, max(v) FILTER (field = 4) AS village, max(v) FILTER (field = 5) AS district FROM e GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, coalesce(c_name, '') AS filename, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'UPLOADED' ELSE 'REVIEW_REQUIRED' END AS workflow_status,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'VALID' ELSE 'INVALID' END AS validation_status,
  CASE WHEN o_orderstatus = 'F' THEN coalesce(survey, '') ELSE '' END AS survey_number, CASE WHEN o_orderstatus = 'F' THEN coalesce(parcel, '') ELSE '' END AS parcel_identifier, CASE WHEN o_orderstatus = 'F' THEN coalesce(area, '') ELSE '' END AS plot_area,
  CASE WHEN o_orderstatus = 'F' THEN coalesce(village, '') ELSE '' END AS village, CASE WHEN o_orderstatus = 'F' THEN coalesce(district, '') ELSE '' END AS district, '{dashboard.EVIDENCE_NOTE}' AS evidence_note
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN w ON doc = o_orderkey
""")
def records_csv(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, customers as files, lines as fields of two readings, two of three corrected once or twice; for a reader of validated records."""
    orders = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "VALIDATED").when(F.col("o_orderstatus") == "O", "UPLOADED").otherwise("REVIEW_REQUIRED")
    documents = orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("file_id"), status.alias("status"))
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("original_name"))
    names = F.array(*map(F.lit, ("survey_number", "parcel_identifier", "cadastral_identifier", "plot_area", "village", "district", "owner_details")))
    index = F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    value = F.col("l_partkey").cast("string")
    fields = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 2).alias("version"), F.element_at(names, (F.col("l_suppkey") % 7 + 1).cast("int")).alias("field_name"),
        value.alias("original_value"), index.alias("candidate_index"), F.concat_ws("-", "l_orderkey", index).alias("id"), (F.col("l_partkey") % 3).alias("p"),
    )
    versions_ = F.when(F.col("p") == 0, F.array(F.lit(1), F.lit(2))).when(F.col("p") == 1, F.array(F.lit(1)))
    fixes = fields.select(F.col("id").alias("extracted_field_id"), "original_value", F.explode(versions_).alias("version")).withColumn("corrected_value", F.concat_ws("/", "original_value", "version")).dropDuplicates(["extracted_field_id", "version"])
    checks = orders.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("document_id"), F.explode(F.array(F.struct(F.lit(1).alias("version"), F.lit("INVALID").alias("status")), F.struct((F.col("o_orderkey") % 2 * -2 + 2).cast("int").alias("version"), F.lit("VALID").alias("status")))).alias("c")).select("document_id", "c.*")
    return dashboard.records_csv(documents, files, fields.drop("p"), fixes, checks, {"record:read"})


@query("""SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 0 THEN '{}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS metadata_json FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10""")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    """Even events carry their number under a sensitive key, which reading drops."""
    props = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"Access_Token"'))).otherwise(F.col("props"))
    logs = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("created_at"), props.alias("metadata_json"))
    return dashboard.audit_page(logs, {"event_type": "click"}, limit=50, offset=10).select(F.col("id").alias("event_id"), "user_id", "event_type", "metadata_json")


@query("""
SELECT c_custkey, sha256(lower(trim(' ' || c_name || ' '))) AS digest,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ADM' WHEN 'BUILDING' THEN 'OFF' WHEN 'FURNITURE' THEN 'REV' WHEN 'HOUSEHOLD' THEN 'SUR' WHEN 'MACHINERY' THEN 'VWR' END || '-TN-' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS login_id
FROM customer
""")
def hashed_identity(spark: SparkSession, d: str) -> DataFrame:
    roles = dict(zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), access.ROLES))
    role = F.lit(None).cast("string")
    for segment, name in roles.items():
        role = F.when(F.col("c_mktsegment") == segment, name.lower()).otherwise(role)
    return table(spark, d, "customer").select("c_custkey", T.identity_digest(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("digest"), T.login_id(role, F.col("c_custkey")).alias("login_id"))


#: DuckDB's levenshtein counts bytes: each pair's characters beyond ASCII become ASCII ones that the pair doesn't use (it has 127 at most).
_RATES = r"""
WITH p AS (SELECT a.item_id, a.text AS r, b.text AS h, list_sort(list_distinct(string_split(a.text || b.text, ''))) AS used FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE length(a.text) > 0),
c AS (SELECT *, list_filter(used, lambda x: unicode(x) > 127) AS wide, list_filter(list_transform(range(1, 128), lambda k: chr(CAST(k AS INTEGER))), lambda x: NOT list_contains(used, x)) AS free FROM p)
SELECT item_id, levenshtein(translate(r, array_to_string(wide, ''), array_to_string(free[1:len(wide)], '')), translate(h, array_to_string(wide, ''), array_to_string(free[1:len(wide)], ''))) / length(r) AS cer FROM c
"""


@query(_RATES.replace(" WHERE length(a.text) > 0", "").replace("SELECT item_id, levenshtein", "SELECT item_id, CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE levenshtein").replace(" AS cer", " END AS cer"))
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text as reference, the next one as hypothesis, in code points; all pairs, those with an empty reference too."""
    return _reference_pairs(spark, d).select("item_id", T.character_error_rate(F.col("text"), F.col("hypothesis")).alias("cer"))


@query(_RATES)
def error_rates_whole(spark: SparkSession, d: str) -> DataFrame:
    """The pairs whose reference has a text."""
    return error_rates(spark, d).join(table(spark, d, "benchmark").filter("length(text) > 0").select("item_id"), "item_id", "left_semi")


def _reference_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis"))
    return a.join(b, "item_id")


@query("""
WITH s AS (SELECT a.item_id, a.text AS r, b.text AS h FROM benchmark a LEFT JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT count(h) AS completed, count(*) - count(h) AS failed, string_agg(DISTINCT CAST(item_id % 3 AS VARCHAR), '|' ORDER BY CAST(item_id % 3 AS VARCHAR)) AS categories,
  sum(item_id % 5) FILTER (h IS NOT NULL) / (4.0::DOUBLE * count(h)) AS field_accuracy FROM s
""")
def benchmark_counts(spark: SparkSession, d: str) -> DataFrame:
    """The rollup without its error rates, which SQL's distances (in bytes) can't give."""
    found = benchmark_rollup(spark, d)
    return found.select("completed", "failed", F.array_join("categories", "|").alias("categories"), "field_accuracy")


@query()
def benchmark_rollup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis"))
    samples = a.join(b, "item_id", "left").select(
        F.col("text").alias("reference"), "hypothesis", (F.col("item_id") % 3).cast("string").alias("category"), F.lit(4).alias("expected_fields"), (F.col("item_id") % 5).alias("matched_fields"),
        F.when(F.col("hypothesis").isNull(), "no result").alias("error"),
    )
    return extraction.benchmark(samples)


@query("""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn FROM labels)
SELECT tp, fp, fn, round(tp / (tp + fp + fn + 1e-7), 9) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-7), 9) AS dice, round(tp / (tp + fp + 1e-7), 9) AS "precision", round(tp / (tp + fn + 1e-7), 9) AS recall FROM c
""")
def segmentation_metrics(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "labels").agg(*R.confusion(F.col("quality") == 1, F.col("toxic") == 1))
    rated = counts.select("tp", "fp", "fn", *R.segmentation_scores(F.col("tp"), F.col("fp"), F.col("fn")))
    return rated.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("iou", "dice", "precision", "recall")))


@query("""
WITH p AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, round(least(1, greatest(0, (l_extendedprice - lo) / (hi - lo))), 9) AS stretched FROM lineitem JOIN p USING (l_returnflag)
""")
def band_stretch(spark: SparkSession, d: str) -> DataFrame:
    pixels = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    return R.band_stretch(pixels, "l_returnflag", "l_extendedprice").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", F.round("stretched", 9).alias("stretched"))


@query("""
WITH h AS (SELECT CAST(floor(l_quantity) AS INTEGER) AS b, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT range AS b, coalesce(n, 0) AS n FROM range(256) LEFT JOIN h ON range = b),
c AS (SELECT b, sum(n) OVER (ORDER BY b) AS w, sum(n * b) OVER (ORDER BY b) AS m, sum(n) OVER () AS tw, sum(n * b) OVER () AS tm FROM a),
v AS (SELECT b, CASE WHEN w > 0 AND tw > w THEN ((tm::DOUBLE * w - m::DOUBLE * tw) ** 2) / (w::DOUBLE * (tw - w)) ELSE -1 END AS v FROM c)
SELECT CAST(b AS BIGINT) AS threshold FROM v ORDER BY v DESC, b LIMIT 1
""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Quantities as levels of one image."""
    bins = table(spark, d, "lineitem").groupBy(F.floor("l_quantity").cast("int").alias("level")).agg(F.count("*").alias("n"))
    return R.otsu(bins)


@query("""
WITH r AS (SELECT s_suppkey, 700 + s_suppkey % 900 AS w, 500 + s_suppkey % 700 AS h FROM supplier),
t AS (SELECT s_suppkey, w, h, y.range AS row_offset, x.range AS column_offset FROM r, range(0, 1200, 512) y, range(0, 1600, 512) x WHERE y.range < h AND x.range < w)
SELECT s_suppkey AS raster_id, CAST(row_offset AS BIGINT) AS row_offset, CAST(column_offset AS BIGINT) AS column_offset, CAST(least(512, w - column_offset) AS BIGINT) AS tile_width, CAST(least(512, h - row_offset) AS BIGINT) AS tile_height,
  CAST(100 + 0.5 * column_offset AS DOUBLE) AS x0, CAST(900 - 0.5 * (row_offset + least(512, h - row_offset)) AS DOUBLE) AS y0, CAST(100 + 0.5 * (column_offset + least(512, w - column_offset)) AS DOUBLE) AS x1, CAST(900 - 0.5 * row_offset AS DOUBLE) AS y1 FROM t
""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    t = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("abcdef", (0.5, 0, 100, 0, -0.5, 900))))
    rasters = table(spark, d, "supplier").select(F.col("s_suppkey").alias("raster_id"), (700 + F.col("s_suppkey") % 900).cast("int").alias("width"), (500 + F.col("s_suppkey") % 700).cast("int").alias("height"), t.alias("transform"))
    cols = ("row_offset", "column_offset", "tile_width", "tile_height")
    return cadastre.tiles(rasters, 512).select("raster_id", *(F.col(c).cast("long").alias(c) for c in cols), "x0", "y0", "x1", "y1")


def _quad(key: Column) -> Column:
    """A small quadrilateral near (78, 11), sized and skewed by a key."""
    x, y = 78 + (key % 100) / 1000, 11 + (key % 77) / 1000
    w, h = 0.001 + (key % 9) / 10000, 0.001 + (key % 7) / 10000
    return F.array(G.point(x, y), G.point(x + w, y + h / 4), G.point(x + w * 0.9, y + h), G.point(x - w / 5, y + h * 0.8), G.point(x, y))


_QUADS = """q AS (SELECT c_custkey AS k, 78 + (c_custkey % 100) / 1000 AS x, 11 + (c_custkey % 77) / 1000 AS y, 0.001 + (c_custkey % 9) / 10000 AS w, 0.001 + (c_custkey % 7) / 10000 AS h FROM customer),
e AS (SELECT k, unnest([[x, y, x + w, y + h / 4], [x + w, y + h / 4, x + w * 0.9, y + h], [x + w * 0.9, y + h, x - w / 5, y + h * 0.8], [x - w / 5, y + h * 0.8, x, y]]) AS s FROM q)"""


@query(f"""
WITH {_QUADS}
SELECT k AS parcel_id, round(abs(sum(s[1] * s[4] - s[3] * s[2])) / 2 * 1e6, 3) AS square_millidegrees, round(abs(sum(radians(s[3] - s[1]) * (2 + sin(radians(s[2])) + sin(radians(s[4]))))) * 6371007.1809 * 6371007.1809 / 2, 1) AS preview_m2 FROM e GROUP BY k
""")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("parcel_id"), _quad(F.col("c_custkey")).alias("ring"))
    return rows.select("parcel_id", F.round(G.planar_area(F.col("ring")) * 1e6, 3).alias("square_millidegrees"), F.round(G.preview_area(F.col("ring")), 1).alias("preview_m2"))


#: A cone through two parallels, in feet, and its constants in SQL.
_CONE = "+proj=lcc +lat_1=10 +lat_2=20 +lat_0=12 +lon_0=78 +x_0=1000 +units=ft"
_CONE_SQL = """k AS (SELECT sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257223563::DOUBLE AS f)), l AS (SELECT e, radians(v) AS lat, v FROM k, (VALUES (10), (12), (20)) AS t(v)),
m AS (SELECT v, e, asinh(tan(lat)) - e * atanh(e * sin(lat)) AS psi, cos(lat) / sqrt(1 - e * e * sin(lat) * sin(lat)) AS r FROM l), c AS (SELECT a.e, (ln(a.r) - ln(b.r)) / (b.psi - a.psi) AS n, a.r AS ra, a.psi AS pa, o.psi AS po FROM m a, m b, m o WHERE a.v = 10 AND b.v = 20 AND o.v = 12),
w AS (SELECT e, n, 6378137.0::DOUBLE * ra / n * exp(n * pa) AS s, po FROM c)"""


@query(f"""
WITH {_QUADS}, {_CONE_SQL},
p AS (SELECT k, list_transform(s, lambda v: radians(v)) AS s FROM e), x AS (SELECT k, w.s * exp(-n * (asinh(tan(p.s[2])) - w.e * atanh(w.e * sin(p.s[2])))) AS r1, n * (p.s[1] - radians(78)) AS a1, w.s * exp(-n * (asinh(tan(p.s[4])) - w.e * atanh(w.e * sin(p.s[4])))) AS r2, n * (p.s[3] - radians(78)) AS a2, w.s * exp(-n * po) AS r0 FROM p, w),
y AS (SELECT k, (r1 * sin(a1) + 1000) AS x1, r0 - r1 * cos(a1) AS y1, (r2 * sin(a2) + 1000) AS x2, r0 - r2 * cos(a2) AS y2 FROM x)
SELECT k AS parcel_id, round(min(x1) / 0.3048, 2) AS west_feet, round(max(y1) / 0.3048, 2) AS north_feet, round(abs(sum((x1 - 1000) * y2 - (x2 - 1000) * y1)) / 2, 1) AS area_m2, true AS returns FROM y GROUP BY k
""")
def projected_areas(spark: SparkSession, d: str) -> DataFrame:
    """Small quadrilaterals on a cone in feet: where they lie, what they measure, and whether they come back to their degrees."""
    rows = spread(table(spark, d, "customer").select("c_custkey")).select(F.col("c_custkey").alias("parcel_id"), F.array(F.array(_quad(F.col("c_custkey")))).alias("degrees")).withColumn("feet", P.from_degrees(F.col("degrees"), F.lit(_CONE)))
    back, points = P.to_degrees(F.col("feet"), F.lit(_CONE)), F.col("feet")[0][0]
    near = F.forall(F.arrays_zip(F.col("degrees")[0][0].alias("p"), back[0][0].alias("q")), lambda v: (F.abs(v["p"]["x"] - v["q"]["x"]) < 1e-10) & (F.abs(v["p"]["y"] - v["q"]["y"]) < 1e-10))
    b = G.bounds(points)
    return rows.select("parcel_id", F.round(b["x0"], 2).alias("west_feet"), F.round(b["y1"], 2).alias("north_feet"), F.round(P.square_metres(F.col("feet"), F.lit(_CONE)), 1).alias("area_m2"), near.alias("returns"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as rectangles on a grid, some reaching into their neighbours."""
    k = F.col("s_suppkey")
    x, y = ((k % 50) * 10).cast("double"), (F.floor(k / 50) * 10).cast("double")
    return table(spark, d, "supplier").select(k.alias("parcel_id"), x.alias("x0"), y.alias("y0"), (x + 8 + k % 5).alias("x1"), (y + 9 + (k % 3)).alias("y1"))


def _box_rings(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("parcel_id", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


#: The outline of the one project that the rectangles are measured against.
_EDGE = [(0.0, 0.0), (490.0, 0.0), (490.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
_BOXES = "b AS (SELECT s_suppkey AS id, (s_suppkey % 50) * 10.0::DOUBLE AS x0, (s_suppkey // 50) * 10.0::DOUBLE AS y0, (s_suppkey % 50) * 10.0::DOUBLE + 8 + s_suppkey % 5 AS x1, (s_suppkey // 50) * 10.0::DOUBLE + 9 + s_suppkey % 3 AS y1 FROM supplier)"


@query(f"""
WITH {_BOXES}, o AS (SELECT l.id AS left_id, r.id AS right_id, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) AS w, (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS h FROM b l JOIN b r ON l.id < r.id AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1)
SELECT left_id, right_id, round(w * h, 6) AS area_m2 FROM o WHERE w * h > 0.01
""")
def parcel_overlap(spark: SparkSession, d: str) -> DataFrame:
    return cadastre.overlaps(_box_rings(spark, d), cell=20.0).withColumn("area_m2", F.round("area_m2", 6))


@query(f"""
WITH {_BOXES}
SELECT id AS shape_id, CASE id % 4 WHEN 0 THEN 'VALID' WHEN 3 THEN 'EMPTY_GEOMETRY' ELSE 'REPAIRED' END AS status,
  CASE id % 4 WHEN 0 THEN (x1 - x0) * (y1 - y0) - (x1 - x0 - 4) * (y1 - y0 - 4) WHEN 1 THEN (x1 - x0) * (y1 - y0) / 2 WHEN 2 THEN 8 ELSE 0 END AS area,
  CAST(CASE id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS outer_rings, CAST(CASE id % 4 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS holes,
  CAST(CASE id % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 0 END AS BIGINT) AS points FROM b
""")
def shape_outline(spark: SparkSession, d: str) -> DataFrame:
    """Frames, bow-ties, steps that cross themselves and lines there and back, as outlines with holes."""
    x0, y0, x1, y1, kind = F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("shape_id") % 4
    bow = F.array(F.array(G.point(x0, y0), G.point(x1, y1), G.point(x1, y0), G.point(x0, y1), G.point(x0, y0)))
    line = F.array(F.array(G.point(x0, y0), G.point(x1, y1), G.point(x0, y0), G.point(x0, y0)))
    rings = F.when(kind == 0, F.col("rings")).when(kind == 1, bow).when(kind == 2, F.array(_steps(x0, y0))).otherwise(line)
    made = shapes.repaired(_frames(spark, d).withColumn("rings", rings))
    holes = F.aggregate("polygons", F.lit(0).cast("long"), lambda n, p: n + F.size(p) - 1)
    points = F.aggregate("polygons", F.lit(0).cast("long"), lambda n, p: n + F.size(F.flatten(p)))
    return made.select("shape_id", "status", F.round("area", 6).alias("area"), F.size("polygons").cast("long").alias("outer_rings"), holes.alias("holes"), points.alias("points"))


def _steps(x: Column, y: Column) -> Column:
    """A ring that crosses itself: two squares of side 2 that touch in a corner."""
    return F.array(*(G.point(x + a, y + b) for a, b in ((0, 0), (2, 0), (2, 4), (4, 4), (4, 2), (0, 2), (0, 0))))


@query("SELECT s_suppkey AS shape_id, CAST(13 AS BIGINT) AS points_before, CAST(5 AS BIGINT) AS points, 100.0::DOUBLE AS area, s_suppkey % 50 * 10.0::DOUBLE AS x0, s_suppkey // 50 * 10.0::DOUBLE AS y0 FROM supplier")
def shape_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as squares side by side whose borders waver by a tenth; simplified as one layer they are plain squares that fit."""
    k = F.col("s_suppkey")
    x, y = (k % 50 * 10).cast("double"), (F.floor(k / 50) * 10).cast("double")
    off = lambda at: F.when(at % 20 == 0, 0.1).otherwise(-0.1)
    points = [(x, y), (x + 3, y + off(y)), (x + 7, y - off(y)), (x + 10, y), (x + 10 + off(x + 10), y + 3), (x + 10 - off(x + 10), y + 7), (x + 10, y + 10), (x + 7, y + 10 - off(y + 10)), (x + 3, y + 10 + off(y + 10)), (x, y + 10), (x - off(x), y + 7), (x + off(x), y + 3), (x, y)]
    layer = table(spark, d, "supplier").select(k.alias("shape_id"), x.alias("x0"), y.alias("y0"), F.array(F.array(F.array(*(G.point(a, b) for a, b in points)))).alias("polygons"))
    made = shapes.simplify_layer(layer.withColumn("points_before", F.size(F.col("polygons")[0][0]).cast("long")), 0.5)
    return made.select("shape_id", "points_before", F.size(F.col("polygons")[0][0]).cast("long").alias("points"), F.round(overlay.polygons_area(F.col("polygons")), 6).alias("area"), "x0", "y0")


#: Unit squares of the frames; SQL counts them.
_FRAME_CELLS = "c AS (SELECT id, x.range AS x, y.range AS y FROM b, range(-5, 600) x, range(-5, 600) y WHERE x.range >= x0 AND x.range < x1 AND y.range >= y0 AND y.range < y1 AND NOT (x.range >= x0 + 2 AND x.range < x1 - 2 AND y.range >= y0 + 2 AND y.range < y1 - 2))"


@query(f"""
WITH {_BOXES}, {_FRAME_CELLS}, n AS (SELECT id, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY id),
p AS (SELECT l.id AS left_id, r.id AS right_id, CAST(count(*) AS DOUBLE) AS common FROM c l JOIN c r ON l.x = r.x AND l.y = r.y AND l.id < r.id GROUP BY 1, 2)
SELECT left_id, right_id, common AS intersection, l.n + r.n - common AS "union", l.n - common AS difference, l.n + r.n - 2 * common AS symmetric_difference
FROM p JOIN n l ON l.id = left_id JOIN n r ON r.id = right_id
""")
def shape_overlay(spark: SparkSession, d: str) -> DataFrame:
    """All four overlays of frames that share an inside, as areas of the polygons that come out."""
    frames = _frames(spark, d).select("shape_id", "rings")
    pairs = shapes.met(frames, frames).filter("left_id < right_id")
    made = pairs.select("left_id", "right_id", *(F.round(overlay.polygons_area(overlay.overlay(how)(F.col("left"), F.col("right"))), 6).alias(how) for how in overlay.RULES))
    return made.filter("intersection > 0")


@query(f"""
WITH {_BOXES}, {_FRAME_CELLS}, s AS (SELECT id + 1000000 AS id, x0 + x.range AS x, y0 + y.range AS y FROM b, range(0, 4) x, range(0, 4) y WHERE id % 50 = 7 AND (x.range < 2) = (y.range < 2)),
a AS (SELECT *, x >= 0 AND x < 490 AND y >= 0 AND y < 20 AS within FROM (SELECT * FROM c UNION ALL SELECT * FROM s)),
i AS (SELECT 'PARCEL_OVERLAP' AS code, l.id AS first_id, r.id AS second_id, CAST(count(*) AS DOUBLE) AS area FROM a l JOIN a r ON l.x = r.x AND l.y = r.y AND l.id < r.id GROUP BY 2, 3
  UNION ALL SELECT 'OUTSIDE_PROJECT_BOUNDARY', id, NULL, count(*) FROM a WHERE NOT within GROUP BY id
  UNION ALL SELECT 'COVERAGE_GAP', NULL, NULL, 9800 - count(DISTINCT (x, y)) FROM a WHERE within HAVING count(DISTINCT (x, y)) < 9800)
SELECT code, 'REVIEW' AS severity, first_id, second_id, area FROM i
UNION ALL SELECT 'INVALID_GEOMETRY', 'ERROR', 2000000 + s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 50 = 9
""")
def shape_topology(spark: SparkSession, d: str) -> DataFrame:
    """Frames, rings that cross themselves (judged as repaired) and lines (invalid) against a project's outline."""
    boxes = _boxes(spark, d)
    k, x0, y0 = F.col("parcel_id"), F.col("x0"), F.col("y0")
    steps = boxes.filter(k % 50 == 7).select((k + 1000000).alias("shape_id"), F.array(_steps(x0, y0)).alias("rings"))
    lines = boxes.filter(k % 50 == 9).select((k + 2000000).alias("shape_id"), F.array(F.array(G.point(x0, y0), G.point(x0 + 3, y0), G.point(x0, y0), G.point(x0, y0))).alias("rings"))
    found = shapes.topology(_frames(spark, d).select("shape_id", "rings").unionByName(steps).unionByName(lines), [_EDGE])
    side = lambda n: F.get("shape_ids", F.lit(n))
    return found.select("code", "severity", side(0).alias("first_id"), side(1).alias("second_id"), F.round("area", 6).alias("area"))


@query(f"""
WITH {_BOXES}, g AS (SELECT x.range AS x, y.range AS y FROM range(-5, 600) x, range(-5, 600) y),
c AS (SELECT DISTINCT x, y FROM g JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)
SELECT CAST(count(*) FILTER (x >= 0 AND x < 490 AND y >= 0 AND y < 20) AS DOUBLE) AS covered_m2, 9800.0::DOUBLE - count(*) FILTER (x >= 0 AND x < 490 AND y >= 0 AND y < 20) AS gap_m2, CAST(count(*) FILTER (NOT (x >= 0 AND x < 490 AND y >= 0 AND y < 20)) AS DOUBLE) AS outside_m2 FROM c
""")
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    """All rectangles have whole coordinates, so SQL can count unit squares."""
    found = cadastre.coverage(_box_rings(spark, d), _EDGE)
    return found.select(*(F.round(c, 6).alias(c) for c in ("covered_m2", "gap_m2", "outside_m2")))


_CELLS = "g AS (SELECT x.range AS x, y.range AS y FROM range(-5, 600) x, range(-5, 600) y), c AS (SELECT id, x, y, x >= 0 AND x < 490 AND y >= 0 AND y < 20 AS within FROM g JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1)"


@query(f"""
WITH {_BOXES}, {_CELLS},
i AS (SELECT 'PARCEL_OVERLAP' AS code, l.id AS first_id, r.id AS second_id, CAST(count(*) AS DOUBLE) AS area_m2 FROM c l JOIN c r ON l.x = r.x AND l.y = r.y AND l.id < r.id GROUP BY 2, 3
  UNION ALL SELECT 'OUTSIDE_PROJECT_BOUNDARY', id, NULL, count(*) FROM c WHERE NOT within GROUP BY id
  UNION ALL SELECT 'COVERAGE_GAP', NULL, NULL, 9800 - count(DISTINCT (x, y)) FROM c WHERE within HAVING count(DISTINCT (x, y)) < 9800)
SELECT code, 'REVIEW' AS severity, first_id, second_id, area_m2 FROM i
UNION ALL SELECT 'INVALID_GEOMETRY', 'ERROR', 1000000 + s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 50 = 7
""")
def topology_issues(spark: SparkSession, d: str) -> DataFrame:
    """The rectangles and some bow ties against a project's outline; whole coordinates let SQL count unit squares."""
    k, at = F.col("s_suppkey"), lambda x, y: G.point(F.lit(float(x)), F.lit(float(y)))
    ties = table(spark, d, "supplier").filter(k % 50 == 7).select((k + 1000000).alias("parcel_id"), F.array(at(0, 0), at(4, 4), at(4, 0), at(0, 4), at(0, 0)).alias("ring"))
    found = cadastre.topology_issues(_box_rings(spark, d).unionByName(ties), _EDGE)
    side = lambda n: F.get("parcel_ids", F.lit(n))
    return found.select("code", "severity", side(0).alias("first_id"), side(1).alias("second_id"), F.round("area_m2", 6).alias("area_m2"))


@query("""
WITH i AS (SELECT event_id, upper(event_type) AS kind, event_id % 3 AS n, event_id % 4 AS s FROM events)
SELECT event_id, kind AS code, CASE s WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INFO' END AS severity, s < 2 AS review_required, 'GEOAI.' || kind AS rule_id,
  CASE WHEN n = 0 THEN 'UNKNOWN' ELSE CAST(event_id + k.range AS VARCHAR) END AS entity_id FROM i, range(0, 2) k WHERE k.range < greatest(n, 1)
""")
def unified_issues(spark: SparkSession, d: str) -> DataFrame:
    """Events as topology issues of no, one or two parcels."""
    n, ids = F.col("event_id") % 3, F.array(F.col("event_id"), F.col("event_id") + 1)
    names = F.element_at(F.array(*map(F.lit, ("error", "REVIEW", "Warning", "INFO"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.upper("event_type").alias("code"), names.alias("severity"), F.slice(ids, F.lit(1), n.cast("int")).alias("parcel_ids"), F.col("event_id").cast("double").alias("area_m2"))
    return cadastre.unified_issues(rows).select(F.col("area_m2").cast("long").alias("event_id"), "code", "severity", "review_required", "rule_id", "entity_id")


@query("""
WITH l AS (SELECT l_orderkey AS record_id, l_orderkey * 10 + l_linenumber AS link_id, CASE l_linenumber % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'SUGGESTED' WHEN 2 THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END AS status,
  CASE WHEN l_partkey % 3 = 0 THEN 'CONFIRMED' WHEN l_partkey % 3 = 1 THEN 'REJECTED' END AS decision FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
j AS (SELECT *, status IN ('SUGGESTED', 'REVIEW_REQUIRED') AS open, bool_or(status = 'CONFIRMED') OVER (PARTITION BY record_id) AS has, min(CASE WHEN decision = 'CONFIRMED' AND status IN ('SUGGESTED', 'REVIEW_REQUIRED') THEN link_id END) OVER (PARTITION BY record_id) AS first FROM l),
k AS (SELECT *, CASE WHEN decision = 'REJECTED' THEN open WHEN decision = 'CONFIRMED' THEN open AND NOT has AND coalesce(first = link_id, false) ELSE false END AS ok FROM j)
SELECT link_id, record_id, CASE WHEN ok THEN decision ELSE status END AS link_status, decision IS NOT NULL AND NOT ok AS refused FROM k
""")
def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as links of a record, part numbers as decisions."""
    line, part = F.col("l_linenumber").cast("long"), F.col("l_partkey") % 3
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    states = F.when(line % 4 == 0, "CONFIRMED").when(line % 4 == 1, "SUGGESTED").when(line % 4 == 2, "REVIEW_REQUIRED").otherwise("REJECTED")
    rows = rows.select(F.col("l_orderkey").alias("record_id"), (F.col("l_orderkey") * 10 + line).alias("link_id"), states.alias("link_status"), F.when(part == 0, "CONFIRMED").when(part == 1, "REJECTED").alias("decision"))
    return linking.resolve_links(rows.drop("decision"), rows.filter("decision IS NOT NULL").select("link_id", "decision"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """The rectangles as frames: a hole begins two units inside."""
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    return _boxes(spark, d).select(F.col("parcel_id").alias("shape_id"), "x0", "y0", "x1", "y1", F.array(G.rectangle(x0, y0, x1, y1), G.rectangle(x0 + 2, y0 + 2, x1 - 2, y1 - 2)).alias("rings"))


_HOLED = f"""{_BOXES}, r AS (SELECT id, 1 AS sign, x0, y0, x1, y1 FROM b UNION ALL SELECT id, -1, x0 + 2, y0 + 2, x1 - 2, y1 - 2 FROM b)"""


@query(f"""
WITH {_BOXES}
SELECT id AS shape_id, CASE id % 3 WHEN 0 THEN 'VALID' WHEN 1 THEN 'REPAIRED' ELSE 'EMPTY_GEOMETRY' END AS status, CASE id % 3 WHEN 0 THEN (x1 - x0) * (y1 - y0) - (x1 - x0 - 4) * (y1 - y0 - 4) WHEN 1 THEN (x1 - x0) * (y1 - y0) / 2 ELSE 0 END AS area,
  CAST(CASE id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS pieces FROM b
""")
def shape_repair(spark: SparkSession, d: str) -> DataFrame:
    """Frames, bow-ties and lines there and back."""
    x0, y0, x1, y1, kind = F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("shape_id") % 3
    bow = F.array(F.array(G.point(x0, y0), G.point(x1, y1), G.point(x1, y0), G.point(x0, y1), G.point(x0, y0)))
    line = F.array(F.array(G.point(x0, y0), G.point(x1, y1), G.point(x0, y0), G.point(x0, y0)))
    given = _frames(spark, d).withColumn("rings", F.when(kind == 0, F.col("rings")).when(kind == 1, bow).otherwise(line))
    return shapes.normalized(given).select("shape_id", "status", F.round("area", 6).alias("area"), F.size("pieces").cast("long").alias("pieces"))


@query(f"""
WITH {_HOLED}, o AS (SELECT l.id AS left_id, r.id AS right_id, sum(l.sign * r.sign * (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0))) AS area
  FROM r l JOIN r ON l.id < r.id AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1 GROUP BY 1, 2)
SELECT left_id, right_id, round(area, 6) AS area FROM o WHERE area > 0.01
""")
def shape_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Frames that reach into each other's sides or holes."""
    return shapes.overlaps(_frames(spark, d), cell=20.0).withColumn("area", F.round("area", 6))


@query(f"""
WITH {_BOXES}
SELECT id AS shape_id, CASE id % 4 WHEN 0 THEN 'VALID' WHEN 3 THEN 'EMPTY_GEOMETRY' ELSE 'REPAIRED' END AS status,
  CASE id % 4 WHEN 0 THEN (x1 - x0) * (y1 - y0) - (x1 - x0 - 4) * (y1 - y0 - 4) WHEN 1 THEN (x1 - x0) * (y1 - y0) / 2 WHEN 2 THEN 8 ELSE 0 END AS area,
  CAST(CASE id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS outer_rings, CAST(CASE id % 4 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS holes,
  CAST(CASE id % 4 WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 0 END AS BIGINT) AS points FROM b
""")
def shape_outline(spark: SparkSession, d: str) -> DataFrame:
    """Frames, bow-ties, steps that cross themselves and lines there and back, as outlines with holes."""
    x0, y0, x1, y1, kind = F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("shape_id") % 4
    bow = F.array(F.array(G.point(x0, y0), G.point(x1, y1), G.point(x1, y0), G.point(x0, y1), G.point(x0, y0)))
    line = F.array(F.array(G.point(x0, y0), G.point(x1, y1), G.point(x0, y0), G.point(x0, y0)))
    rings = F.when(kind == 0, F.col("rings")).when(kind == 1, bow).when(kind == 2, F.array(_steps(x0, y0))).otherwise(line)
    made = shapes.repaired(_frames(spark, d).withColumn("rings", rings))
    holes = F.aggregate("polygons", F.lit(0).cast("long"), lambda n, p: n + F.size(p) - 1)
    points = F.aggregate("polygons", F.lit(0).cast("long"), lambda n, p: n + F.size(F.flatten(p)))
    return made.select("shape_id", "status", F.round("area", 6).alias("area"), F.size("polygons").cast("long").alias("outer_rings"), holes.alias("holes"), points.alias("points"))


def _steps(x: Column, y: Column) -> Column:
    """A ring that crosses itself: two squares of side 2 that touch in a corner."""
    return F.array(*(G.point(x + a, y + b) for a, b in ((0, 0), (2, 0), (2, 4), (4, 4), (4, 2), (0, 2), (0, 0))))


#: Unit squares of the frames; SQL counts them.
_FRAME_CELLS = "c AS (SELECT id, x.range AS x, y.range AS y FROM b, range(-5, 600) x, range(-5, 600) y WHERE x.range >= x0 AND x.range < x1 AND y.range >= y0 AND y.range < y1 AND NOT (x.range >= x0 + 2 AND x.range < x1 - 2 AND y.range >= y0 + 2 AND y.range < y1 - 2))"


@query(f"""
WITH {_BOXES}, {_FRAME_CELLS}, n AS (SELECT id, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY id),
p AS (SELECT l.id AS left_id, r.id AS right_id, CAST(count(*) AS DOUBLE) AS common FROM c l JOIN c r ON l.x = r.x AND l.y = r.y AND l.id < r.id GROUP BY 1, 2)
SELECT left_id, right_id, common AS intersection, l.n + r.n - common AS "union", l.n - common AS difference, l.n + r.n - 2 * common AS symmetric_difference
FROM p JOIN n l ON l.id = left_id JOIN n r ON r.id = right_id
""")
def shape_overlay(spark: SparkSession, d: str) -> DataFrame:
    """All four overlays of frames that share an inside, as areas of the polygons that come out."""
    frames = _frames(spark, d).select("shape_id", "rings")
    pairs = shapes.met(frames, frames).filter("left_id < right_id")
    made = pairs.select("left_id", "right_id", *(F.round(overlay.polygons_area(overlay.overlay(how)(F.col("left"), F.col("right"))), 6).alias(how) for how in overlay.RULES))
    return made.filter("intersection > 0")


@query(f"""
WITH {_BOXES}, {_FRAME_CELLS}, s AS (SELECT id + 1000000 AS id, x0 + x.range AS x, y0 + y.range AS y FROM b, range(0, 4) x, range(0, 4) y WHERE id % 50 = 7 AND (x.range < 2) = (y.range < 2)),
a AS (SELECT *, x >= 0 AND x < 490 AND y >= 0 AND y < 20 AS within FROM (SELECT * FROM c UNION ALL SELECT * FROM s)),
i AS (SELECT 'PARCEL_OVERLAP' AS code, l.id AS first_id, r.id AS second_id, CAST(count(*) AS DOUBLE) AS area FROM a l JOIN a r ON l.x = r.x AND l.y = r.y AND l.id < r.id GROUP BY 2, 3
  UNION ALL SELECT 'OUTSIDE_PROJECT_BOUNDARY', id, NULL, count(*) FROM a WHERE NOT within GROUP BY id
  UNION ALL SELECT 'COVERAGE_GAP', NULL, NULL, 9800 - count(DISTINCT (x, y)) FROM a WHERE within HAVING count(DISTINCT (x, y)) < 9800)
SELECT code, 'REVIEW' AS severity, first_id, second_id, area FROM i
UNION ALL SELECT 'INVALID_GEOMETRY', 'ERROR', 2000000 + s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 50 = 9
""")
def shape_topology(spark: SparkSession, d: str) -> DataFrame:
    """Frames, rings that cross themselves (judged as repaired) and lines (invalid) against a project's outline."""
    boxes = _boxes(spark, d)
    k, x0, y0 = F.col("parcel_id"), F.col("x0"), F.col("y0")
    steps = boxes.filter(k % 50 == 7).select((k + 1000000).alias("shape_id"), F.array(_steps(x0, y0)).alias("rings"))
    lines = boxes.filter(k % 50 == 9).select((k + 2000000).alias("shape_id"), F.array(F.array(G.point(x0, y0), G.point(x0 + 3, y0), G.point(x0, y0), G.point(x0, y0))).alias("rings"))
    found = shapes.topology(_frames(spark, d).select("shape_id", "rings").unionByName(steps).unionByName(lines), [_EDGE])
    side = lambda n: F.get("shape_ids", F.lit(n))
    return found.select("code", "severity", side(0).alias("first_id"), side(1).alias("second_id"), F.round("area", 6).alias("area"))


@query(f"""
WITH {_BOXES}, g AS (SELECT x.range AS x, y.range AS y FROM range(-5, 600) x, range(-5, 600) y),
c AS (SELECT DISTINCT x, y FROM g JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND NOT (x >= x0 + 2 AND x < x1 - 2 AND y >= y0 + 2 AND y < y1 - 2))
SELECT CAST(count(*) FILTER (x >= 0 AND x < 490 AND y >= 0 AND y < 20) AS DOUBLE) AS covered_m2, 9800.0::DOUBLE - count(*) FILTER (x >= 0 AND x < 490 AND y >= 0 AND y < 20) AS gap_m2, CAST(count(*) FILTER (NOT (x >= 0 AND x < 490 AND y >= 0 AND y < 20)) AS DOUBLE) AS outside_m2 FROM c
""")
def shape_union(spark: SparkSession, d: str) -> DataFrame:
    """What the frames' union covers of the project and leaves open, by unit squares in the SQL."""
    return shapes.union_coverage(_frames(spark, d), _EDGE).select(*(F.round(c, 6).alias(c) for c in ("covered_m2", "gap_m2", "outside_m2")))


@query("""
WITH e AS (SELECT event_id, user_id, event_id % 3 AS expected FROM events), j AS (SELECT e.*, CASE WHEN u IS NOT NULL THEN 1 END AS now FROM e LEFT JOIN (SELECT DISTINCT c_custkey AS u FROM customer) ON user_id = u),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, expected = now ORDER BY event_id) AS n FROM j)
SELECT event_id AS edit_id, user_id AS parcel_id, CASE WHEN now IS NULL THEN 'NOT_FOUND' WHEN expected <> now OR n > 1 THEN 'VERSION_CONFLICT' ELSE 'APPLIED' END AS outcome FROM r
""")
def append_version(spark: SparkSession, d: str) -> DataFrame:
    """Customers as parcels at version 1, events as edits that expect version 0, 1 or 2."""
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("parcel_id"), F.lit(1).alias("version"))
    edits = table(spark, d, "events").select(F.col("event_id").alias("edit_id"), F.col("user_id").alias("parcel_id"), (F.col("event_id") % 3).cast("int").alias("expected_version"), F.col("event_id").alias("geometry"))
    new, refused = versions.append_version(current, edits)
    return new.select(F.col("geometry").alias("edit_id"), "parcel_id", F.lit("APPLIED").alias("outcome")).unionByName(refused.select("edit_id", "parcel_id", F.col("reason").alias("outcome")))


@query("""
WITH u AS (SELECT c_custkey AS id, c_name AS login_id, c_mktsegment || '@x' AS email, 'N' || c_nationkey AS full_name FROM customer WHERE c_acctbal > 0),
r AS (SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS roles FROM events GROUP BY 1)
SELECT id, login_id, email, full_name, coalesce(roles, '') AS roles FROM u LEFT JOIN r ON id = user_id WHERE lower(login_id) LIKE '%7%' OR lower(email) LIKE '%7%' OR lower(full_name) LIKE '%7%'
""")
def user_directory(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users (active ones have money), their events' types as roles."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("login_id"), F.concat("c_mktsegment", F.lit("@x")).alias("email"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("full_name"), (F.col("c_acctbal") > 0).alias("is_active"))
    held = table(spark, d, "events").select("user_id", F.col("event_type").alias("role"))
    return access.directory(users, held, "7").withColumn("roles", F.array_join("roles", "|"))


@query("""
SELECT user_id, CASE min(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END) WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'OFFICER' WHEN 2 THEN 'REVIEWER' WHEN 3 THEN 'SURVEYOR' ELSE 'VIEWER' END AS role FROM events GROUP BY 1
""")
def effective_role(spark: SparkSession, d: str) -> DataFrame:
    """Events' types as roles: each user's first in rank."""
    role = F.lit(access.ROLES[-1])
    for kind, name in zip(("signup", "purchase", "error", "click"), access.ROLES):
        role = F.when(F.col("event_type") == kind, name).otherwise(role)
    return access.effective_role(table(spark, d, "events").select("user_id", role.alias("role")))


@query("""
WITH l AS (SELECT o_orderkey AS link_id, o_custkey AS parcel_id, o_totalprice AS document_area FROM orders WHERE o_orderstatus = 'F'), v AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN abs(c_acctbal) ELSE abs(c_acctbal) / 10.7639104167::DOUBLE END AS area FROM customer WHERE c_nationkey <> 3)
SELECT link_id, document_area AS document_area_m2, area AS parcel_area_m2 FROM l JOIN v ON parcel_id = c_custkey
""")
def area_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders as confirmed links, balances as areas in one of two units; nation 3 has no current version."""
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("link_id"), F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("parcel_id"), F.when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("SUGGESTED").alias("link_status"))
    customers, metric = table(spark, d, "customer").withColumn("area", F.abs("c_acctbal")), F.col("c_nationkey") % 2 == 0
    parcels = customers.select(F.col("c_custkey").alias("parcel_id"), F.when(F.col("c_nationkey") == 3, 9).otherwise(2).alias("current_geometry_version"))
    shapes = customers.select(F.col("c_custkey").alias("parcel_id"), F.lit(2).alias("version"), F.when(metric, F.col("area")).alias("area_m2"), F.when(~metric, F.col("area")).alias("area_sqft"))
    areas = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("area_m2"))
    return linking.area_comparisons(links, parcels, shapes, areas)


@query(f"""
WITH {_BOXES}, e AS (SELECT id, (x1 - x0) * (y1 - y0) AS a, CASE WHEN id % 11 = 0 THEN 0 ELSE (x1 - x0 + id % 4 * 0.25) * (y1 - y0) END AS z FROM b)
SELECT id AS parcel_id, CASE WHEN z = 0 THEN 'INVALID' WHEN abs((z - a) / a * 100) > 5 THEN 'REVIEW_REQUIRED' ELSE 'VALID' END AS status, CASE WHEN z = 0 THEN NULL ELSE round((z - a) / a * 100, 6) END AS change_percent FROM e
""")
def edit_validation(spark: SparkSession, d: str) -> DataFrame:
    """Edits widen rectangles by up to three quarters; every eleventh collapses."""
    return cadastre.edited(_edits(spark, d)).select("parcel_id", "status", F.round("change_percent", 6).alias("change_percent"))


@query(f"""
WITH {_BOXES}, e AS (SELECT *, x1 + id % 4 * 0.25 AS xa, id % 11 = 0 AS bad, (x1 - x0) * (y1 - y0) AS before, (x1 + id % 4 * 0.25 - x0) * (y1 - y0) AS after FROM b),
i AS (SELECT id, 'INVALID_EDIT_GEOMETRY' AS code, NULL AS other, NULL AS area FROM e WHERE bad
  UNION ALL SELECT id, 'SIGNIFICANT_AREA_CHANGE', NULL, after - before FROM e WHERE NOT bad AND (after - before) / before * 100 > 5
  UNION ALL SELECT id, 'OUTSIDE_PROJECT_BOUNDARY', NULL, after - greatest(0, least(xa, 490) - x0) * greatest(0, least(y1, 20) - y0) FROM e WHERE NOT bad AND after - greatest(0, least(xa, 490) - x0) * greatest(0, least(y1, 20) - y0) > 0.01
  UNION ALL SELECT e.id, 'NEIGHBOUR_OVERLAP', b.id, (least(xa, b.x1) - greatest(e.x0, b.x0)) * (least(e.y1, b.y1) - greatest(e.y0, b.y0)) FROM e JOIN b ON b.id <> e.id AND NOT bad AND greatest(e.x0, b.x0) < least(xa, b.x1) AND greatest(e.y0, b.y0) < least(e.y1, b.y1)
    WHERE (least(xa, b.x1) - greatest(e.x0, b.x0)) * (least(e.y1, b.y1) - greatest(e.y0, b.y0)) > 0.01)
SELECT id AS parcel_id, code, CASE code WHEN 'INVALID_EDIT_GEOMETRY' THEN 'ERROR' ELSE 'REVIEW' END AS severity, other AS neighbour_id, CAST(round(area, 6) AS DOUBLE) AS area_m2 FROM i
""")
def edit_issues(spark: SparkSession, d: str) -> DataFrame:
    """The same edits against the boundary of one project and the parcels beside them."""
    edge = G.rectangle(*(F.lit(v) for v in (0.0, 0.0, 490.0, 20.0)))
    boundaries = spark.range(1).select(F.lit(1).alias("project_id"), edge.alias("ring"))
    neighbours = _edits(spark, d).select("parcel_id", F.col("before").alias("ring"))
    return cadastre.edit_issues(_edits(spark, d).withColumn("project_id", F.lit(1)), boundaries, neighbours, cell=20.0).withColumn("area_m2", F.round("area_m2", 6))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    wide = F.when(F.col("parcel_id") % 11 == 0, F.col("x0")).otherwise(F.col("x1") + F.col("parcel_id") % 4 * 0.25)
    return _boxes(spark, d).select("parcel_id", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("before"), G.rectangle(F.col("x0"), F.col("y0"), wide, F.col("y1")).alias("after"))


@query("""
SELECT s_suppkey AS parcel_id, CASE s_suppkey % 5 WHEN 0 THEN 'GNSS_SURVEY' WHEN 1 THEN 'FMB_IMPORT' WHEN 2 THEN 'CADASTRAL_IMPORT' WHEN 3 THEN 'MANUAL_DRAWING' ELSE 'AI_VISIBLE_BOUNDARY' END AS source,
  CASE WHEN s_suppkey % 5 = 4 AND s_suppkey % 3 = 0 THEN 'EVIDENCE_REQUIRED' WHEN s_suppkey % 5 = 4 AND s_suppkey % 3 = 1 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'TOO_FEW_POINTS' END AS refusal,
  CASE WHEN s_suppkey % 5 = 4 AND s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 4 AND s_suppkey % 3 = 1 THEN 'NOT_DETERMINED' WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'DRAFT' END AS status FROM supplier
""")
def parcel_acquisition(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    source = F.element_at(F.array(*map(F.lit, cadastre.SOURCES)), (k % 5 + 1).cast("int"))
    points = F.when(k % 7 == 0, F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(1), F.lit(1)), G.point(F.lit(0), F.lit(0)))).otherwise(G.rectangle(F.lit(0), F.lit(0), F.lit(10), F.lit(5)))
    rows = table(spark, d, "supplier").select(
        k.alias("parcel_id"), source.alias("source"), F.when(k % 2 == 0, "EPSG:32644").alias("source_crs"), F.lit(None).cast("string").alias("coordinate_space"), F.lit(0.8).alias("confidence"),
        F.when(k % 3 == 1, "NO_VISIBLE_EVIDENCE").when(k % 3 == 2, "VISIBLE_FENCE").alias("evidence_type"), points.alias("ring"),
    )
    return cadastre.acquire(rows).select("parcel_id", "source", "refusal", "status")


@query()
def vectorize_mask(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8x8 masks of probabilities."""
    masks = table(spark, d, "embeddings").select(F.col("vec_id").alias("mask_id"), F.transform("embedding", lambda v: v * 4).alias("values"))
    return cadastre.vectorize(masks, 8)


@query("""
WITH RECURSIVE v AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT (vec_id % 40) * 8 + i % 8 AS x, (vec_id // 40) * 8 + i // 8 AS y, CAST(v AS DOUBLE) AS v FROM v WHERE CAST(v AS DOUBLE) >= 0.2), k AS (SELECT x, y, y * 4294967296 + x AS k, v FROM p),
n AS (SELECT a.k, b.k AS other FROM k a JOIN (VALUES (-1), (0), (1)) AS dx(d) ON true JOIN (VALUES (-1), (0), (1)) AS dy(d) ON true JOIN k b ON b.x = a.x + dx.d AND b.y = a.y + dy.d WHERE a.k <> b.k),
r AS (SELECT k AS here, k AS first FROM k UNION SELECT n.other, r.first FROM r JOIN n ON n.k = r.here AND n.other > r.first), c AS (SELECT here, min(first) AS component FROM r GROUP BY here),
s AS (SELECT k.k, count(*) AS sides FROM k JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS d(x, y) ON true LEFT JOIN k o ON o.x = k.x + d.x AND o.y = k.y + d.y WHERE o.k IS NULL GROUP BY 1)
SELECT component, count(*) AS pixels, round(avg(v), 6) AS confidence, CAST(count(*) AS DOUBLE) AS area, CAST(sum(coalesce(sides, 0)) AS DOUBLE) AS outline FROM c JOIN k ON k.k = c.here LEFT JOIN s ON s.k = k.k GROUP BY component
""")
def mosaic_components(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as tiles of 8 x 8 pixels of one raster, forty a row: components over seams, and what their polygons measure."""
    k = F.col("vec_id")
    tiles = table(spark, d, "embeddings").select(F.lit(1).alias("raster_id"), (k % 40 * 8).alias("x0"), (F.floor(k / 40) * 8).alias("y0"), F.lit(8).alias("width"), F.col("embedding").alias("values"))
    found = mosaic.vectorize(tiles, threshold=0.2)
    length = F.aggregate(overlay.all_rings(F.col("polygons")), F.lit(0.0), lambda total, ring: total + G.planar_length(ring))
    return found.select("component", "pixels", F.round("confidence", 6).alias("confidence"), overlay.polygons_area(F.col("polygons")).alias("area"), length.alias("outline"))


@query("""
WITH v AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id // 25 AS raster_id, (vec_id % 5 * 8 + i % 8) // 2 AS x, (vec_id % 25 // 5 * 8 + i // 8) // 2 AS y, CAST(v AS DOUBLE) AS v FROM v), c AS (SELECT raster_id, x, y, avg(v) AS v FROM p GROUP BY ALL),
e AS (SELECT raster_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c GROUP BY 1), s AS (SELECT c.*, least(255, greatest(0, (v - lo) * 255.0 / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END))) AS s FROM c JOIN e USING (raster_id))
SELECT raster_id, CAST(20 AS BIGINT) AS width, CAST(20 AS BIGINT) AS height, count(*) AS cells, CAST(sum(CAST(floor(s) AS BIGINT)) AS BIGINT) AS levels, CAST(sum(CAST(floor(s) AS BIGINT) * (y * 20 + x)) AS BIGINT) AS weighed FROM s GROUP BY 1
""")
def preview_levels(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 25 vectors as rasters of 40 x 40 pixels in tiles of 8 x 8, shown in 20 x 20 cells."""
    tiles, rasters = _preview_tiles(spark, d)
    cells = imagery.display_levels(imagery.preview_cells(tiles, rasters, 20))
    return cells.groupBy("raster_id", "width", "height").agg(F.count("*").alias("cells"), F.sum("level").alias("levels"), F.sum(F.col("level") * (F.col("y") * 20 + F.col("x"))).alias("weighed"))


def _preview_tiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("vec_id")
    tiles = table(spark, d, "embeddings").select(F.floor(k / 25).alias("raster_id"), F.lit(1).alias("band"), (k % 5 * 8).alias("x0"), (F.floor(k % 25 / 5) * 8).alias("y0"), F.lit(8).alias("width"), F.col("embedding").alias("values"))
    return tiles, tiles.select("raster_id").distinct().select("raster_id", F.lit(40).alias("width"), F.lit(40).alias("height"), F.lit(None).cast("double").alias("nodata"))


@query()
def preview_overlays(spark: SparkSession, d: str) -> DataFrame:
    """The same rasters as pictures, with the outlines of their components over 0.2 on them."""
    tiles, rasters = _preview_tiles(spark, d)
    found = mosaic.vectorize(tiles.drop("band"), threshold=0.2).select("raster_id", F.row_number().over(Window.partitionBy("raster_id").orderBy("component")).alias("number"), "polygons")
    return imagery.overlays(tiles, rasters, found, 20)


@query()
def prepared_scans(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 25 vectors as scanned pages of 40 x 40 levels: contrast, median, rotation against the skew and threshold, line by line."""
    k, width = F.col("vec_id"), 8
    tiles = table(spark, d, "embeddings").select(F.floor(k / 25).alias("image_id"), F.floor(k % 25 / 5).alias("ty"), (k % 5).alias("tx"), F.posexplode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i", "line"), "embedding")
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 300 + 128))).cast("int")
    parts = tiles.select("image_id", (F.col("ty") * width + F.col("line")).alias("row"), "tx", F.transform(F.slice("embedding", F.col("line") * width + 1, F.lit(width)), level).alias("part"))
    pages = parts.groupBy("image_id", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tx", "part"))), lambda p: p["part"])).alias("levels"))
    made, seen = scans.prepared(pages, threshold=True)
    dark = F.aggregate("levels", F.lit(0), lambda n, v: n + F.when(v == 0, 1).otherwise(0))
    return made.join(seen, "image_id").select("image_id", "row", F.size("levels").alias("width"), dark.alias("dark"), F.round("degrees", 6).alias("degrees"))


_ECCENTRIC = "(298.257223563 * 2 - 1) / (298.257223563 * 298.257223563::DOUBLE)"


@query(f"""
WITH k AS (SELECT c_custkey AS id, 78 + (c_custkey % 100) / 1000::DOUBLE AS x, 11 + (c_custkey % 77) / 1000::DOUBLE AS y, 0.001::DOUBLE + (c_custkey % 9) / 10000::DOUBLE AS w, 0.001::DOUBLE + (c_custkey % 7) / 10000::DOUBLE AS h FROM customer),
c AS (SELECT id, unnest([{{'i': 0, 'x': x, 'y': y}}, {{'i': 1, 'x': x + w, 'y': y + h / 4}}, {{'i': 2, 'x': x + w * 0.9::DOUBLE, 'y': y + h}}, {{'i': 3, 'x': x - w / 5, 'y': y + h * 0.8::DOUBLE}}, {{'i': 4, 'x': x, 'y': y}}]) AS p FROM k),
g AS (SELECT id, p.i AS i, radians(p.x) AS lon, radians(p.y) AS lat, sin(radians(p.y)) AS s, {_ECCENTRIC} AS e2 FROM c),
v AS (SELECT id, i, lon, (1 - e2) * (s / (1 - e2 * s * s) + atanh(sqrt(e2) * s) / sqrt(e2)) AS q, 6378137 / sqrt(1 - e2 * s * s) AS n, cos(lat) AS c, s, e2 FROM g),
t AS (SELECT id, i, lon, q, n * c * cos(lon) AS px, n * c * sin(lon) AS py, n * (1 - e2) * s AS pz FROM v),
e AS (SELECT *, lead(lon) OVER r AS lon1, lead(q) OVER r AS q1, first_value(q) OVER r AS q0, sqrt(pow(lead(px) OVER r - px, 2) + pow(lead(py) OVER r - py, 2) + pow(lead(pz) OVER r - pz, 2)) AS chord FROM t WINDOW r AS (PARTITION BY id ORDER BY i))
SELECT id AS parcel_id, round(abs(sum((lon1 - lon) * ((q + q1) / 2 - q0))) * pow(6378137::DOUBLE, 2) / 2, 2) AS area_m2, round(sum(chord + pow(chord, 3) / (24 * pow(6371000::DOUBLE, 2))), 2) AS length_m FROM e WHERE i < 4 GROUP BY id
""")
def geodesic_area(spark: SparkSession, d: str) -> DataFrame:
    """Small parcels: the SQL takes their edges as chords of the ellipsoid, lengthened to arcs, and as single bands of equal-area heights."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("parcel_id"), _quad(F.col("c_custkey")).alias("ring"), F.lit(4326).alias("code"))
    return rows.select("parcel_id", F.round(G.area_square_metres(F.col("ring"), F.col("code")), 2).alias("area_m2"), F.round(G.length_metres(F.col("ring"), F.col("code")), 2).alias("length_m"))


@query(f"""
WITH {_BOXES}, p AS (SELECT id, (x1 - x0) * (y1 - y0) AS a, (y1 - y0) * greatest(0, x1 - x0 - id % 4) AS c, id % 4 AS s FROM b)
SELECT id AS parcel_id, a AS reference_area, a AS candidate_area, nullif(c, 0) AS overlap_area, 2 * a - 2 * c AS symmetric_difference, 0.0::DOUBLE AS change_percent, CAST(s AS DOUBLE) AS hausdorff FROM p
""")
def parcel_comparison(spark: SparkSession, d: str) -> DataFrame:
    shifted = F.transform("reference", lambda p: F.struct((p["x"] + F.col("parcel_id") % 4).alias("x"), p["y"].alias("y")))
    rows = _boxes(spark, d).select("parcel_id", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("reference")).withColumn("candidate", shifted)
    return cadastre.compare(rows).drop("reference", "candidate")


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'UNSUPPORTED_ACTION' WHEN user_id % 5 = 0 THEN 'ALREADY_RESOLVED' WHEN event_id % 7 = 0 AND user_id % 3 = 1 THEN 'BLOCKING_ISSUES'
  WHEN event_id % 7 <> 0 AND event_type = 'error' THEN 'REASON_REQUIRED' WHEN event_id % 7 = 1 AND user_id % 2 = 0 THEN 'CORRECTION_REQUIRED' WHEN event_id % 7 = 3 AND user_id % 2 = 0 THEN 'JOB_REQUIRED' WHEN event_id % 7 = 5 AND user_id % 2 = 0 THEN 'ASSIGNEE_REQUIRED' END AS refusal,
  CASE WHEN user_id % 5 = 0 THEN 'RESOLVED' WHEN event_id % 7 = 0 AND user_id % 3 <> 1 THEN 'RESOLVED' WHEN event_id % 7 = 2 AND event_type <> 'error' THEN 'RESOLVED' WHEN event_id % 7 = 3 AND event_type <> 'error' AND user_id % 2 = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS status_after FROM events
""")
def review_actions(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions on review tasks."""
    names = F.array(*map(F.lit, [*jobs.REVIEW_ACTIONS, "PUBLISH"]))
    odd = F.col("user_id") % 2 == 1
    rows = table(spark, d, "events").select(
        "event_id", F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("action"), F.when(F.col("user_id") % 5 == 0, "RESOLVED").otherwise("OPEN").alias("status"), F.when(F.col("event_type") != "error", "because").otherwise(" ").alias("reason"),
        F.when(odd, "c1").alias("correction_reference"), F.when(odd, "p1").alias("reprocess_job_project"), F.lit("p1").alias("project_id"), F.when(odd, "u2").alias("assignee_id"), (F.col("user_id") % 3 % 2).alias("blocking_issue_count"),
    )
    return jobs.review_outcomes(rows).select("event_id", "refusal", "status_after")


_SEARCHED = """
docs AS (SELECT o_orderkey AS document_id, 'P' || o_custkey || '/' AS name, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS status, o_orderdate AS updated_at FROM orders),
f AS (SELECT l_orderkey * 100 + l_linenumber AS field_id, l_orderkey AS document_id, CASE WHEN l_linenumber % 2 = 0 THEN 'survey_number' ELSE 'village' END AS field_name, l_linenumber AS candidate_index, 'P' || l_partkey || '/' || l_suppkey AS original_value
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
x AS (SELECT field_id, version, CASE WHEN document_id % 2 = 0 THEN 'P1' || version || '/' ELSE 'Q' || original_value END AS corrected_value FROM f, (SELECT 1 AS version UNION ALL SELECT 2) WHERE candidate_index < 3)"""


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as documents, customers as parcels, order lines as fields, the first two lines of an order corrected twice."""
    status = F.when(F.col("o_orderstatus") == "F", "VALIDATED").otherwise("REVIEW_REQUIRED")
    documents = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("P"), F.col("o_custkey").cast("string"), F.lit("/")).alias("name"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))
    parcels = table(spark, d, "customer").select(F.col("c_custkey").alias("parcel_id"), F.concat(F.lit("P"), F.col("c_custkey").cast("string"), F.lit("/")).alias("external_identifier"), F.lit("DRAFT").alias("status"), F.when(F.col("c_acctbal") > 0, "VERIFIED").alias("verification_status"), F.col("c_acctbal").alias("updated_at"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"))
    fields = lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("field_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") % 2 == 0, "survey_number").otherwise("village").alias("field_name"),
        F.col("l_linenumber").alias("candidate_index"), F.concat(F.lit("P"), F.col("part").cast("string"), F.lit("/"), F.col("supplier").cast("string")).alias("original_value"),
    )
    twice = fields.filter("candidate_index < 3").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    value = F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("P1"), F.col("version").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("Q"), "original_value"))
    said = twice.select("field_id", "version", value.alias("corrected_value"))
    return documents, parcels, fields, said


@query(f"""
WITH {_SEARCHED},
a AS (SELECT 'DOCUMENT' AS kind, document_id AS id, CAST(NULL AS BIGINT) AS evidence_id, name AS title, 'Document source' AS subtitle, status, name AS matched_value, status <> 'VALIDATED' AS preliminary FROM docs WHERE name ILIKE '%p11/%' ORDER BY updated_at DESC, document_id LIMIT 60),
b AS (SELECT 'PARCEL', c_custkey, CAST(NULL AS BIGINT), 'P' || c_custkey || '/', 'Parcel identifier', 'DRAFT', 'P' || c_custkey || '/', NOT (c_acctbal > 0) FROM customer WHERE 'P' || c_custkey || '/' ILIKE '%p11/%' ORDER BY c_acctbal DESC, c_custkey LIMIT 60),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM (SELECT * FROM b LIMIT (SELECT 60 - count(*) FROM a))),
c0 AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, candidate_index, field_id) AS r FROM f JOIN docs USING (document_id) WHERE original_value ILIKE '%p11/%'),
c1 AS (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY r) AS n FROM c0 WHERE r <= 60 - (SELECT count(*) FROM ab)),
c AS (SELECT 'FIELD', document_id, field_id, CASE field_name WHEN 'village' THEN 'Village' ELSE 'Survey Number' END || ': ' || original_value, name, status, original_value, status <> 'VALIDATED' FROM c1 WHERE n = 1),
d0 AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, version DESC, field_id) AS r FROM x JOIN f USING (field_id) JOIN docs USING (document_id) WHERE corrected_value ILIKE '%p11/%'),
d1 AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY r) AS n FROM d0 WHERE r <= 60 - (SELECT count(*) FROM ab) - (SELECT count(*) FROM c) AND field_id NOT IN (SELECT field_id FROM c1 WHERE n = 1)),
e AS (SELECT 'FIELD', document_id, field_id, CASE field_name WHEN 'village' THEN 'Village' ELSE 'Survey Number' END || ': ' || corrected_value, name || ' · human correction v' || version, status, corrected_value, status <> 'VALIDATED' FROM d1 WHERE n = 1)
SELECT * FROM ab UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e
""")
def project_search(spark: SparkSession, d: str) -> DataFrame:
    """Four sources within sixty hits; copies of a field leave room for corrections."""
    return projects.search(*_searched(spark, d), "P11/", limit=60)


_SHOWN = """
n AS (SELECT n_nationkey FROM nation UNION ALL SELECT 25), docs AS (SELECT o_orderkey % 25 AS project_id, o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'PROCESSING' END AS status FROM orders),
k AS (SELECT l_orderkey % 25 AS project_id, l_orderkey AS document_id, CASE l_partkey % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END AS status FROM lineitem),
t AS (SELECT user_id % 25 AS project_id, CASE WHEN event_id % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, CASE WHEN event_type IN ('click', 'error') THEN 'GIS' ELSE 'DOCUMENT' END AS queue, CASE event_id % 4 WHEN 0 THEN 'RECORD_PARCEL_LINK' WHEN 1 THEN 'VALIDATION_ISSUE' WHEN 2 THEN 'DOCUMENT' END AS target,
  CASE event_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, user_id AS assignee FROM events),
p AS (SELECT c_custkey % 25 AS project_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'REVIEW_REQUIRED' ELSE 'DRAFT' END AS status FROM customer),
j AS (SELECT p_partkey % 25 AS project_id, CASE p_size % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'PARCEL_IMPORT' ELSE 'OTHER' END AS job_type FROM part),
s AS (SELECT s_suppkey % 25 AS project_id, s_suppkey % 5 AS kind FROM supplier),
u AS (SELECT project_id, string_agg(status || '=' || n, '|' ORDER BY status) AS seen, any_value(kind) AS kind FROM (
  SELECT project_id, status, count(*) AS n, 'd' AS kind FROM docs GROUP BY 1, 2 UNION ALL SELECT project_id, status, count(*), 'p' FROM p GROUP BY 1, 2 UNION ALL SELECT project_id, status, count(*), 'k' FROM k GROUP BY 1, 2 UNION ALL SELECT project_id, status, count(*), 'j' FROM j GROUP BY 1, 2) GROUP BY project_id, kind)"""
_KINDS = "IMAGERY", "GEOAI_JOB", "BUILDING", "ROAD", "LAND_USE"


def _shown(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations as projects, and one more (25) that has nothing."""
    rest = lambda c: (F.col(c) % 25).cast("long").alias("project_id")

    def pick(c: str, by: int, *names: str | None) -> Column:
        return F.element_at(F.array(*(F.lit(n).cast("string") for n in names)), (F.col(c) % by + 1).cast("int"))

    status = F.when(F.col("o_orderstatus") == "F", "VALIDATED").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").otherwise("PROCESSING")
    queue = F.when(F.col("event_type").isin("click", "error"), "GIS").otherwise("DOCUMENT")
    return {
        "projects": table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id")).union(spark.range(25, 26)),
        "documents": table(spark, d, "orders").select(rest("o_orderkey"), F.col("o_orderkey").alias("document_id"), status.alias("status")),
        "links": table(spark, d, "lineitem").select(rest("l_orderkey"), F.col("l_orderkey").alias("document_id"), pick("l_partkey", 3, "CONFIRMED", "REVIEW_REQUIRED", "REJECTED").alias("link_status")),
        "tasks": table(spark, d, "events").select(
            rest("user_id"), pick("event_id", 3, "CLOSED", "OPEN", "OPEN").alias("status"), queue.alias("queue_type"), pick("event_id", 4, "RECORD_PARCEL_LINK", "VALIDATION_ISSUE", "DOCUMENT", None).alias("target_type"),
            pick("event_id", 5, "HIGH", "MEDIUM", "LOW", "LOW", "LOW").alias("severity"), F.col("user_id").alias("assignee_id"),
        ),
        "parcels": table(spark, d, "customer").select(rest("c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "REVIEW_REQUIRED").otherwise("DRAFT").alias("status")),
        "jobs": table(spark, d, "part").select(rest("p_partkey"), pick("p_size", 4, "QUEUED", "PROCESSING", "FAILED", "COMPLETED").alias("status"), pick("p_partkey", 2, "PARCEL_IMPORT", "OTHER").alias("job_type")),
        "assets": table(spark, d, "supplier").select(rest("s_suppkey"), pick("s_suppkey", 5, *_KINDS).alias("kind")),
    }


def _as_text(rows: DataFrame) -> DataFrame:
    """Statuses as status=n|... in place of arrays."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("=", s["status"], s["n"].cast("string"))), "|")
    return rows.select(*(line(c).alias(c) if c.endswith("_statuses") else F.col(c) for c in rows.columns))


def _counted(source: str, **conditions: str) -> str:
    return ", ".join(f"(SELECT count(*) FROM {source} WHERE {source}.project_id = n_nationkey AND ({c})) AS {name}" for name, c in conditions.items())


def _seen(**kinds: str) -> str:
    return ", ".join(f"coalesce((SELECT seen FROM u WHERE u.project_id = n_nationkey AND kind = '{k}'), '') AS {name}_statuses" for name, k in kinds.items())


_SURE = "document_id IN (SELECT document_id FROM k WHERE k.status = 'CONFIRMED')"


@query(f"""
WITH {_SHOWN}
SELECT CAST(n_nationkey AS BIGINT) AS project_id, {_counted("docs", documents="true", validated_records="status = 'VALIDATED'", unlinked_validated_records=f"status = 'VALIDATED' AND NOT {_SURE}", review_required_documents="status = 'REVIEW_REQUIRED'")},
 {_counted("t", open_reviews="status = 'OPEN'", document_reviews="status = 'OPEN' AND queue = 'DOCUMENT' AND target NOT IN ('RECORD_PARCEL_LINK', 'VALIDATION_ISSUE')", gis_reviews="status = 'OPEN' AND queue = 'GIS'", link_reviews="status = 'OPEN' AND target = 'RECORD_PARCEL_LINK'", high_reviews="status = 'OPEN' AND severity = 'HIGH'", medium_reviews="status = 'OPEN' AND severity = 'MEDIUM'", assigned_to_me="status = 'OPEN' AND assignee = 7", validation_issues="status = 'OPEN' AND target = 'VALIDATION_ISSUE'")},
 {_counted("p", parcels="true", parcels_needing_review="status = 'REVIEW_REQUIRED'")}, {_counted("k", links="true", ambiguous_links="status = 'REVIEW_REQUIRED'")},
 (SELECT count(DISTINCT document_id) FROM k WHERE k.project_id = n_nationkey AND k.status = 'CONFIRMED') AS confirmed_records,
 {_counted("j", jobs="true", active_jobs="status IN ('QUEUED', 'PROCESSING')", failed_jobs="status = 'FAILED'", retryable_failed_jobs="status = 'FAILED' AND job_type = 'PARCEL_IMPORT'")},
 {_counted("s", **{f"{kind.lower()}_assets": f"kind = {k}" for k, kind in enumerate(_KINDS)})}, {_seen(document="d", parcel="p", link="k", job="j")}
FROM n
""")
def project_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """The dashboards of all projects, as user 7 sees them."""
    return _as_text(projects.dashboard(**_shown(spark, d), me=7))


@query(f"""
WITH {_SHOWN}, c AS (SELECT user_id % 25 AS project_id FROM events)
SELECT CAST(n_nationkey AS BIGINT) AS project_id, {_counted("p", members="true")}, {_counted("docs", files="true")}, {_counted("j", jobs="true")}, {_counted("c", audit_events="true")}, {_seen(file="d", job="j")} FROM n
""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    """Customers as members, documents as files, events as audit rows."""
    t = _shown(spark, d)
    return _as_text(projects.summary(t["projects"], t["parcels"], t["documents"], t["jobs"], t["tasks"]))


@query(f"""
WITH {_SHOWN}
SELECT project_id, 'UPLOADED' AS stage, count(*) AS n FROM docs WHERE status = 'PROCESSING' GROUP BY 1
UNION ALL SELECT project_id, status, count(*) FROM j WHERE status IN ('QUEUED', 'PROCESSING', 'FAILED') GROUP BY 1, 2
""")
def project_stages(spark: SparkSession, d: str) -> DataFrame:
    """Documents in processing as files just uploaded."""
    t = _shown(spark, d)
    return projects.stages(t["documents"].withColumn("status", F.when(F.col("status") == "PROCESSING", "UPLOADED").otherwise(F.col("status"))), t["jobs"])


_RUN = """
WITH e AS (SELECT l_orderkey AS document_id, l_linenumber AS k, 'P-' || l_partkey AS identifier FROM lineitem),
dup AS (SELECT 'duplicate-record:' || identifier AS issue_key, 'HIGH' AS severity, 'Potential duplicate record: ' || count(DISTINCT document_id) || ' validated documents share identifier ' || identifier || '.' AS summary FROM e GROUP BY identifier HAVING count(DISTINCT document_id) >= 2),
a AS (SELECT o_orderkey, abs(o_totalprice - abs(c_acctbal)) / greatest(o_totalprice, abs(c_acctbal)) AS r FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0 AND c_acctbal <> 0),
mis AS (SELECT 'area-mismatch:' || o_orderkey AS issue_key, CASE WHEN r >= 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM a WHERE r > 0.05),
found AS (SELECT issue_key, severity, summary FROM dup UNION ALL SELECT issue_key, severity, NULL FROM mis),
old AS (SELECT 'area-mismatch:' || o_orderkey AS issue_key, 'LOW' AS severity, 'old' AS summary, CASE WHEN o_orderkey % 2 = 0 THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM orders WHERE o_custkey % 7 = 0
  UNION ALL SELECT 'duplicate-record:P-' || p_partkey, 'LOW', 'old', 'OPEN' FROM part WHERE p_partkey % 5 = 0),
older AS (SELECT 'duplicate-record:P-' || p_partkey AS issue_key, 'INFO' AS severity, 'older' AS summary, 'RESOLVED' AS status FROM part WHERE p_partkey % 10 = 0),
i AS (SELECT issue_key, CASE WHEN o.status IS NULL OR (o.status = 'OPEN' AND f.severity IS NOT NULL) THEN f.severity ELSE o.severity END AS severity, CASE WHEN o.status IS NULL OR (o.status = 'OPEN' AND f.severity IS NOT NULL) THEN f.summary ELSE o.summary END AS summary,
  coalesce(o.status, 'OPEN') AS status, CASE WHEN o.status IS NULL THEN 'created' WHEN f.severity IS NULL THEN 'kept' WHEN o.status = 'OPEN' THEN 'refreshed' ELSE 'left' END AS outcome FROM old o FULL JOIN found f USING (issue_key)
  UNION ALL SELECT issue_key, severity, summary, status, 'kept' FROM older)"""


@query(f"{_RUN} SELECT issue_key, severity, status, outcome, CASE WHEN issue_key LIKE 'dup%' THEN summary END AS duplicate_summary FROM i")
def validation_run(spark: SparkSession, d: str) -> DataFrame:
    """Part numbers as identifiers that orders share, prices against balances as areas, and issues of two earlier runs."""
    issues = _validation_run(spark, d)
    return issues.select("issue_key", "severity", "status", "outcome", F.when(F.col("issue_key").startswith("dup"), F.col("summary")).alias("duplicate_summary"))


@query(f"""{_RUN} SELECT count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'refreshed') AS refreshed, count(*) FILTER (status = 'OPEN') AS open_issues, count(*) FILTER (status = 'OPEN' AND issue_key LIKE 'dup%') AS duplicate_records,
  count(*) FILTER (status = 'OPEN' AND issue_key LIKE 'area%') AS area_mismatches FROM i""")
def validation_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return projects.run_counters(_validation_run(spark, d))


def _validation_run(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))
    evidence = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit("survey_number").alias("field_name"), F.col("l_linenumber").alias("candidate_index"), part.alias("identifier"), part.alias("value"))
    orders = table(spark, d, "orders")
    balances = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.abs("c_acctbal").alias("parcel_area_m2"))
    areas = orders.select("o_custkey", F.col("o_orderkey").alias("link_id"), F.col("o_totalprice").alias("document_area_m2")).join(balances, "o_custkey")

    def earlier(rows: DataFrame, prefix: str, key: str, severity: str, summary: str, status: Column, at: int) -> DataFrame:
        return rows.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("issue_key"), F.lit(severity).alias("severity"), F.lit(summary).alias("summary"), status.alias("status"), F.lit(at).alias("created_at"))

    resolved = F.when(F.col("o_orderkey") % 2 == 0, "OPEN").otherwise("RESOLVED")
    parts = table(spark, d, "part")
    existing = earlier(orders.filter("o_custkey % 7 = 0"), "area-mismatch:", "o_orderkey", "LOW", "old", resolved, 2)
    existing = existing.unionByName(earlier(parts.filter("p_partkey % 5 = 0"), "duplicate-record:P-", "p_partkey", "LOW", "old", F.lit("OPEN"), 2))
    existing = existing.unionByName(earlier(parts.filter("p_partkey % 10 = 0"), "duplicate-record:P-", "p_partkey", "INFO", "older", F.lit("RESOLVED"), 1))
    return projects.validation_run(evidence, areas, existing)


_FEATURE_SOURCE = "CASE k % 4 WHEN 0 THEN 'EXISTING_GIS' WHEN 1 THEN 'MANUAL_DRAWN' WHEN 2 THEN 'AI_CANDIDATE' ELSE 'SATELLITE' END"
_DRAFTED = "CASE WHEN refusal IS NULL THEN CASE WHEN k % 2 = 0 THEN 'WORLD' WHEN k % 3 = 0 THEN 'PIXEL' ELSE 'LOCAL' END END AS coordinate_space, CASE WHEN refusal IS NULL THEN 'DRAFT' END AS status, CASE WHEN refusal IS NULL AND source = 'AI_CANDIDATE' THEN 'AI_PRELIMINARY' END AS ai_status"


def _sketched(spark: SparkSession, d: str, kind: str, names: list[str]) -> DataFrame:
    """Suppliers as features: a source, a class, and whether a system is declared (even ones are in metres)."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("feature_id"), F.expr(_FEATURE_SOURCE.replace("k %", "s_suppkey %")).alias("source"), F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias(kind),
        F.when(k % 2 == 0, "EPSG:32644").alias("source_crs"), F.when(k % 3 == 0, "PIXEL").otherwise("SKETCH").alias("coordinate_space"),
    )


@query(f"""
WITH b AS (SELECT s_suppkey AS k, s_suppkey % 7 AS g FROM supplier), c AS (SELECT *, {_FEATURE_SOURCE} AS source, CASE k % 5 WHEN 0 THEN 'ROAD' WHEN 1 THEN 'PATHWAY' WHEN 2 THEN 'ACCESS_CORRIDOR' WHEN 3 THEN 'ROAD' ELSE 'RAILWAY' END AS road_class FROM b),
r AS (SELECT *, CASE WHEN k % 4 = 3 THEN 'UNKNOWN_SOURCE' WHEN k % 5 = 4 THEN 'UNKNOWN_CLASS' WHEN g = 1 THEN 'MULTILINE_NOT_ALLOWED' WHEN g = 2 THEN 'TOO_FEW_POINTS' WHEN g = 4 THEN 'NOT_A_ROAD_GEOMETRY' WHEN g = 5 THEN 'INVALID_SURFACE' WHEN g = 6 THEN 'EMPTY_GEOMETRY' END AS refusal FROM c)
SELECT k AS feature_id, source, road_class, refusal, {_DRAFTED}, CASE WHEN refusal IS NULL THEN CASE WHEN g = 0 THEN 'LINE' ELSE 'SURFACE' END END AS geometry_kind,
  CAST(CASE WHEN refusal IS NULL AND k % 2 = 0 THEN CASE WHEN g = 0 THEN 5.0 * (k + 1) ELSE 2.0 * (k + 9) END END AS DOUBLE) AS length_m FROM r
""")
def road_features(spark: SparkSession, d: str) -> DataFrame:
    """Lines, doubled lines, points, surfaces (declared, undeclared, crossing themselves) and nothing, by supplier number."""
    k, zero = F.col("feature_id"), F.lit(0)
    line, tie = F.array(G.point(zero, zero), G.point((k + 1) * 3, (k + 1) * 4)), F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))))
    shapes = [("LineString", F.array(line)), ("MultiLineString", F.array(line, line)), ("LineString", F.array(F.array(G.point(zero, zero), G.point(zero, zero)))), *[("Polygon", F.array(G.rectangle(zero, zero, k + 1, F.lit(8))))] * 2, ("Polygon", F.array(tie)), ("LineString", F.filter(F.array(line), lambda _: F.lit(False)))]
    kind, parts = F.lit(None).cast("string"), F.lit(None)
    for g, (name, shape) in enumerate(shapes):
        kind, parts = F.when(k % 7 == g, name).otherwise(kind), F.when(k % 7 == g, shape).otherwise(parts)
    rows = _sketched(spark, d, "road_class", ["ROAD", "PATHWAY", "ACCESS_CORRIDOR", "ROAD", "RAILWAY"]).withColumn("kind", kind).withColumn("parts", parts).withColumn("road_surface", (k % 7).isin(3, 5))
    return features.roads(rows).select("feature_id", "source", "road_class", "refusal", "coordinate_space", "status", "ai_status", "geometry_kind", "length_m")


@query(f"""
WITH b AS (SELECT s_suppkey AS k FROM supplier), c AS (SELECT *, {_FEATURE_SOURCE} AS source, CASE k % 3 WHEN 0 THEN 'VACANT' WHEN 1 THEN 'WATERBODY' ELSE 'AGRICULTURAL' END AS land_use_class FROM b),
r AS (SELECT *, CASE WHEN k % 4 = 3 THEN 'UNKNOWN_SOURCE' WHEN k % 5 = 4 THEN 'NOT_A_POLYGON' END AS refusal FROM c), m AS (SELECT *, CASE WHEN refusal IS NULL AND k % 2 = 0 THEN 8.0 * (k + 1) * CASE WHEN k % 5 = 1 THEN 2 ELSE 1 END END AS area_m2 FROM r)
SELECT k AS feature_id, source, land_use_class, refusal, {_DRAFTED}, CAST(area_m2 AS DOUBLE) AS area_m2, area_m2 * 10.7639104167::DOUBLE AS area_sqft FROM m
""")
def land_use_features(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles, pairs of them, and lines that can't be land use."""
    k, zero = F.col("feature_id"), F.lit(0)
    one, other = G.rectangle(zero, zero, k + 1, F.lit(8)), G.rectangle(zero, F.lit(20), k + 1, F.lit(28))
    rows = _sketched(spark, d, "land_use_class", ["VACANT", "WATERBODY", "AGRICULTURAL"])
    rows = rows.withColumn("kind", F.when(k % 5 == 4, "LineString").when(k % 5 == 1, "MultiPolygon").otherwise("Polygon")).withColumn("parts", F.when(k % 5 == 1, F.array(one, other)).otherwise(F.array(one)))
    return features.land_use(rows, allow_multipolygon=True).select("feature_id", "source", "land_use_class", "refusal", "coordinate_space", "status", "ai_status", "area_m2", "area_sqft")


def _json_ring(*points: tuple[str, str]) -> str:
    """SQL for a ring of a GeoJSON text, from SQL for its coordinates."""
    return "'[' || " + " || ',' || ".join(f"'[' || ({x}) || ',' || ({y}) || ']'" for x, y in points) + " || ']'"


def _json_box(x0: str, y0: str, x1: str, y1: str) -> str:
    return _json_ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


#: Payloads by k % 5, in SQL that Spark and others read alike: a frame, two parts, a bow-tie, bare coordinates, a line.
_PAYLOADS = f"""CASE k % 5 WHEN 0 THEN '{{"type":"Polygon","coordinates":[' || {_json_box("0", "0", "k + 5", "8")} || ',' || {_json_box("1", "1", "3", "3")} || ']}}'
  WHEN 1 THEN '{{"type":"Feature","properties":{{"source_crs":"EPSG:32644","notes":["n"]}},"geometry":{{"type":"MultiPolygon","coordinates":[[' || {_json_box("0", "0", "k + 1", "8")} || '],[' || {_json_box("0", "20", "k + 1", "28")} || ']]}}}}'
  WHEN 2 THEN '{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"source_crs":"EPSG:32644"}},"geometry":{{"type":"Polygon","coordinates":[' || {_json_ring(("0", "0"), ("k + 1", "8"), ("k + 1", "0"), ("0", "8"), ("0", "0"))} || ']}}}}]}}'
  WHEN 3 THEN '{{"coordinates":[' || {_json_box("0", "0", "k + 1", "8")} || '],"coordinate_space":"LOCAL"}}' ELSE '{{"type":"LineString","coordinates":' || {_json_ring(("0", "0"), ("k", "1"))} || '}}' END"""
_D = lambda v: f"CAST({v} AS DOUBLE)"


def _payloads(spark: SparkSession, d: str, kind: str, names: tuple[str, ...]) -> DataFrame:
    """Suppliers as features with payloads; every seventh has no source that is known."""
    k = F.col("k")
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS k").withColumn("payload", F.expr(_PAYLOADS))
    return rows.select(k.alias("feature_id"), F.when(k % 7 == 6, "HEARSAY").when(k % 7 == 5, "AI_CANDIDATE").otherwise("EXISTING_GIS").alias("source"), F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias(kind), "payload", F.when(k % 10 == 0, "EPSG:32644").alias("source_crs"))


@query(f"""
WITH b AS (SELECT s_suppkey AS k, s_suppkey % 5 AS g FROM supplier), r AS (SELECT *, CASE WHEN k % 7 = 6 THEN 'UNKNOWN_SOURCE' WHEN g = 4 THEN 'NOT_A_POLYGON' END AS refusal FROM b),
m AS (SELECT *, CAST(CASE WHEN refusal IS NULL THEN CASE WHEN g = 0 AND k % 10 = 0 THEN 8.0 * (k + 5) - 4 WHEN g = 1 THEN 16.0 * (k + 1) WHEN g = 2 THEN 4.0 * (k + 1) END END AS DOUBLE) AS area_m2 FROM r)
SELECT k AS feature_id, CASE k % 2 WHEN 0 THEN 'VACANT' ELSE 'WATERBODY' END AS land_use_class, refusal, CASE WHEN refusal IS NULL THEN g = 2 ELSE false END AS repaired, CASE WHEN refusal IS NULL THEN CASE WHEN g IN (1, 2) OR k % 10 = 0 THEN 'WORLD' ELSE 'LOCAL' END END AS coordinate_space,
  CASE WHEN refusal IS NULL AND k % 7 = 5 THEN 'AI_PRELIMINARY' END AS ai_status, area_m2, area_m2 * 10.7639104167::DOUBLE AS area_sqft,
  CASE WHEN refusal IS NULL THEN CASE g WHEN 0 THEN '{{"type":"Polygon","coordinates":[' || {_json_box(_D(0), _D(0), _D("k + 5"), _D(8))} || ',' || {_json_box(_D(1), _D(1), _D(3), _D(3))} || ']}}'
    WHEN 1 THEN '{{"type":"MultiPolygon","coordinates":[[' || {_json_box(_D(0), _D(0), _D("k + 1"), _D(8))} || '],[' || {_json_box(_D(0), _D(20), _D("k + 1"), _D(28))} || ']]}}'
    WHEN 2 THEN '{{"type":"MultiPolygon","coordinates":[[' || {_json_ring((_D(0), _D(0)), ("(k + 1) / 2.0::DOUBLE", _D(4)), (_D(0), _D(8)), (_D(0), _D(0)))} || '],[' || {_json_ring(("(k + 1) / 2.0::DOUBLE", _D(4)), (_D("k + 1"), _D(0)), (_D("k + 1"), _D(8)), ("(k + 1) / 2.0::DOUBLE", _D(4)))} || ']]}}'
    ELSE '{{"type":"Polygon","coordinates":[' || {_json_box(_D(0), _D(0), _D("k + 1"), _D(8))} || ']}}' END END AS geometry FROM m
""")
def gis_land_use(spark: SparkSession, d: str) -> DataFrame:
    """GeoJSON payloads of several shapes: holes are taken off, parts add up, a bow-tie is repaired, and the geometry is written again."""
    found = gis.land_use(_payloads(spark, d, "land_use_class", ("VACANT", "WATERBODY")), allow_multipolygon=True)
    return found.select("feature_id", "land_use_class", "refusal", "repaired", "coordinate_space", "ai_status", F.round("area_m2", 6).alias("area_m2"), "area_sqft", J.text(F.col("geometry")).alias("geometry"))


@query("""
WITH b AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 6)
SELECT k AS feature_id, CASE k % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'MultiLineString' ELSE 'Polygon' END AS kind, CASE k % 3 WHEN 2 THEN 'SURFACE' ELSE 'LINE' END AS geometry_kind,
  CAST(CASE k % 3 WHEN 0 THEN k + 1 WHEN 1 THEN 2 * (k + 1) ELSE 2 * (k + 9) + 12 END AS DOUBLE) AS length_m, 'EPSG:4326' AS export_crs, 'EPSG:32644' AS source_crs, CAST(CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 10 END AS BIGINT) AS points, 81.0::DOUBLE AS first_lon, 0.0::DOUBLE AS first_lat
FROM b
""")
def gis_road_exports(spark: SparkSession, d: str) -> DataFrame:
    """Lines, doubled lines and declared surfaces with a hole from where a zone's meridian meets the equator, as collections in degrees."""
    line, box = lambda x: _json_ring((x, "0"), (x, "k + 1")), _json_box("500000", "0", "500008", "k + 1")
    body = f"""CASE k % 3 WHEN 0 THEN '{{"type":"LineString","coordinates":' || {line("500000")} || '}}' WHEN 1 THEN '{{"type":"MultiLineString","coordinates":[' || {line("500000")} || ',' || {line("500004")} || ']}}'
      ELSE '{{"type":"Polygon","coordinates":[' || {box} || ',' || {_json_box("500002", "0.25", "500006", "2.25")} || ']}}' END"""
    rows = table(spark, d, "supplier").selectExpr("s_suppkey AS k").withColumn("payload", F.expr(f"""'{{"type":"Feature","properties":{{"road_surface":' || (k % 3 = 2) || '}},"geometry":' || {body} || '}}'"""))
    roads = rows.select(F.col("k").alias("feature_id"), F.when(F.col("k") % 7 == 6, "HEARSAY").otherwise("EXISTING_GIS").alias("source"), F.lit("ROAD").alias("road_class"), "payload", F.lit("EPSG:32644").alias("source_crs"))
    out = gis.collections(gis.roads(roads, allow_multiline=True))
    get, points = lambda path: F.get_json_object("value", path), F.flatten(J.rings(F.col("geometry")))
    return J.read(out, "value", "LineString").select(
        "feature_id", F.col("geometry.kind").alias("kind"), get("$.features[0].properties.geometry_kind").alias("geometry_kind"), F.round(get("$.features[0].properties.length_m").cast("double"), 6).alias("length_m"), get("$.metadata.export_crs").alias("export_crs"),
        get("$.metadata.source_crs").alias("source_crs"), F.size(points).cast("long").alias("points"), F.round(points[0]["x"], 6).alias("first_lon"), F.abs(F.round(points[0]["y"], 6)).alias("first_lat"),
    )


@query()
def building_features(spark: SparkSession, d: str) -> DataFrame:
    """The components of vectorize_mask at half a metre a pixel, of half a square metre at least."""
    return features.buildings(vectorize_mask(spark, d), (0.5, 0.0, 500000.0, 0.0, -0.5, 1400000.0), "EPSG:32644", min_area=0.5).drop("ring")


@query("SELECT c_custkey AS id, upper(c_name) AS login_id FROM customer WHERE upper(c_name) = 'CUSTOMER#000000007' OR c_custkey % 10 = 3")
def sign_in_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers as accounts; every tenth has the name looked for as its e-mail."""
    email = F.when(F.col("c_custkey") % 10 == 3, "cUSTOMER#000000007").otherwise(F.concat("c_name", F.lit("@x")))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("login_id"), email.alias("email"))
    return access.sign_in_user(users, " Customer#000000007 ").select("id", "login_id")


@query("""
WITH u AS (SELECT user_id, max(event_type) AS full_name, count(*) % 2 = 0 AS is_active FROM events GROUP BY 1)
SELECT user_id, c_mktsegment AS role, c_acctbal AS created_at, 'U' || user_id AS login_id, full_name, is_active FROM customer JOIN u ON user_id = c_custkey WHERE c_nationkey % 3 = 1 AND is_active
""")
def project_members(spark: SparkSession, d: str) -> DataFrame:
    """Customers as members of three projects, users of events as accounts."""
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 3).alias("project_id"), F.col("c_mktsegment").alias("role"), F.col("c_acctbal").alias("created_at"))
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_type").alias("full_name"), (F.count("*") % 2 == 0).alias("is_active")).withColumn("login_id", F.concat(F.lit("U"), F.col("id").cast("string")))
    return access.project_members(members, users, 1, active=True)


def _job_status() -> Column:
    return F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "QUEUED").when(F.col("event_type") == "view", "PROCESSING").otherwise("COMPLETED")


@query("""
SELECT user_id * 10 + event_id % 10 AS document_id, event_id AS job_id, CASE event_type WHEN 'click' THEN 'QUEUED' ELSE 'PROCESSING' END AS status FROM events WHERE event_type IN ('click', 'view')
QUALIFY row_number() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY event_id * 7 % 100 DESC, event_id DESC) = 1
""")
def active_document_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Events as jobs, ten documents a user."""
    events = table(spark, d, "events")
    details = events.select(F.col("event_id").alias("job_id"), (F.col("user_id") * 10 + F.col("event_id") % 10).alias("document_id"), (F.col("event_id") * 7 % 100).alias("created_at"))
    return jobs.active_document_jobs(details, events.select(F.col("event_id").alias("job_id"), _job_status().alias("status")))


@query("""
WITH q AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN -event_id - 1 ELSE event_id % 700 END AS k, event_type IN ('click', 'view') AS again FROM events),
o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'UPLOADED' WHEN 'O' THEN 'FAILED' ELSE 'VALIDATED' END AS status FROM orders), r AS (SELECT l_orderkey AS k, max(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT c_custkey AS job, c_custkey * 3 AS k, 'document:' || c_custkey * 3 || ':ocr:' || (1 + c_nationkey % 4) AS key, c_nationkey % 3 = 0 AS runs FROM customer),
j AS (SELECT q.*, CAST(coalesce(v, 0) + 1 AS BIGINT) AS version, 'document:' || q.k || ':ocr:' || (coalesce(v, 0) + 1) AS key, o.status, r.v, b.job AS running FROM q LEFT JOIN o ON q.k = o.k LEFT JOIN r ON q.k = r.k LEFT JOIN b ON q.k = b.k AND b.runs),
x AS (SELECT j.*, b.job AS keyed, CASE WHEN status IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN running IS NOT NULL THEN 'ACTIVE' WHEN NOT again AND status = 'VALIDATED' THEN 'NOT_QUEUEABLE' WHEN again AND v IS NULL THEN 'NO_EARLIER_RESULT' WHEN b.job IS NOT NULL THEN 'EXISTING' END AS refused
  FROM j LEFT JOIN b ON j.key = b.key),
y AS (SELECT *, coalesce(refused, CASE WHEN event_id = min(CASE WHEN refused IS NULL THEN event_id END) OVER (PARTITION BY k) THEN 'QUEUED' ELSE 'ACTIVE' END) AS outcome FROM x)
SELECT event_id AS request_id, k AS document_id, outcome, CASE outcome WHEN 'ACTIVE' THEN running WHEN 'EXISTING' THEN keyed END AS job_id, CASE WHEN outcome IN ('QUEUED', 'EXISTING') THEN version END AS version, CASE WHEN outcome IN ('QUEUED', 'EXISTING') THEN key END AS key FROM y
""")
def queue_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to read orders, customers as jobs there are."""
    number, again = F.col("event_id"), F.col("event_type").isin("click", "view")
    requests = table(spark, d, "events").select(number.alias("request_id"), F.when(number % 13 == 0, -number - 1).otherwise(number % 700).alias("document_id"), again.alias("reprocess"))
    documents = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "UPLOADED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("VALIDATED").alias("status"))
    results = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version"))
    job, document, nation = F.col("c_custkey").alias("job_id"), F.col("c_custkey") * 3, F.col("c_nationkey")
    details = table(spark, d, "customer").select(job, document.alias("document_id"), F.col("c_acctbal").alias("created_at"))
    key = F.concat(F.lit("document:"), document.cast("string"), F.lit(":ocr:"), (1 + nation % 4).cast("string"))
    known = table(spark, d, "customer").select(job, F.when(nation % 3 == 0, "QUEUED").otherwise("COMPLETED").alias("status"), key.alias("idempotency_key"))
    return jobs.queue_documents(requests, documents, results, details, known).withColumn("version", F.col("version").cast("long"))


@query("SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, event_type AS action, event_id AS actor_id FROM events WHERE event_type <> 'error'")
def task_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as audit rows of review tasks, one task a user; errors are about something else."""
    logs = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", "review_task").otherwise("document").alias("target_type"), F.col("user_id").alias("target_id"), F.col("event_type").alias("action"),
        F.col("event_id").alias("actor_id"), F.col("ts").alias("created_at"),
    )
    return jobs.task_history(logs).select("task_id", F.col("position").cast("long").alias("position"), "action", "actor_id")


@query("""
SELECT c_custkey AS project_id, 0 AS position, 'Failed jobs' AS label, CAST(c_nationkey % 3 AS BIGINT) AS n FROM customer WHERE c_nationkey % 3 > 0
UNION ALL SELECT c_custkey, 1, 'Documents requiring review', CAST(c_nationkey % 2 AS BIGINT) FROM customer WHERE c_nationkey % 2 > 0
UNION ALL SELECT c_custkey, 2, 'Validation issues', CAST(c_nationkey AS BIGINT) FROM customer WHERE c_acctbal > 0 AND c_nationkey > 0
""")
def attention_list(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects, numbers of their nation as counters."""
    nation = F.col("c_nationkey")
    counts = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), (nation % 3).alias("failed"), (nation % 2).alias("waiting"), F.when(F.col("c_acctbal") > 0, nation).alias("issues"))
    return dashboard.attention(counts, {"failed": "Failed jobs", "waiting": "Documents requiring review", "issues": "Validation issues"}, ["project_id"])


@query("""
WITH i AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS a, CASE event_id % 3 WHEN 0 THEN user_id WHEN 2 THEN event_id % 7 END AS b FROM events)
SELECT event_id, a AS concerns FROM i WHERE a IS NOT NULL UNION SELECT event_id, b FROM i WHERE b IS NOT NULL
""")
def parcel_issues(spark: SparkSession, d: str) -> DataFrame:
    """Events as topology issues of one or two users."""
    number, user = F.col("event_id"), F.col("user_id")
    issues = table(spark, d, "events").select("event_id", F.when(number % 5 > 0, user).alias("parcel_id"), F.when(number % 3 == 0, user).when(number % 3 == 2, number % 7).alias("related_parcel_id"))
    return cadastre.issues_by_parcel(issues).select("event_id", "concerns")


@query("""
WITH e AS (SELECT o_orderkey, f, o_orderstatus FROM orders, (VALUES ('A'), ('N')) v(f)), c AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem)
SELECT o_orderkey AS sample_id, CAST(2 AS BIGINT) AS expected_fields, count(l_orderkey) AS matched_fields FROM e LEFT JOIN c ON l_orderkey = o_orderkey AND l_returnflag = f AND l_linestatus = o_orderstatus GROUP BY 1
""")
def expected_matches(spark: SparkSession, d: str) -> DataFrame:
    """Orders as samples that expect their status in two fields, lines as candidates in other spellings."""
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.explode(F.array(F.lit("A"), F.lit("N"))).alias("field_name"), F.concat("o_orderstatus", F.lit(" Stra\u00dfe")).alias("value"))
    status = F.col("l_linestatus")
    candidates = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_returnflag").alias("field_name"), F.concat(F.lit("\u00a0 "), F.lower(status), F.lit("  STRASSE")).alias("original_value"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(status, F.lit("\tstrasse "))).alias("normalized_value"),
    )
    return extraction.field_accuracy(extraction.expected_matches(expected, candidates))


@query("""
SELECT l_orderkey || ':' || l_linenumber AS link_id, abs(u - p_retailprice) / greatest(u, p_retailprice) AS relative_difference
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS u, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) WHERE u > 0 AND p_retailprice > 0 AND abs(u - p_retailprice) / greatest(u, p_retailprice) > 0.05
ORDER BY relative_difference DESC, link_id LIMIT 100
""")
def mismatch_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The hundred largest differences between unit and list prices, a top-k report."""
    lines = table(spark, d, "lineitem").filter("l_quantity > 0").select("l_partkey", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("link_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("document_area_m2"))
    found = linking.area_mismatches(lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("parcel_area_m2")), "l_partkey"))
    return paging.page(found, F.desc("relative_difference"), "link_id", limit=100).select("link_id", "relative_difference")


@query("""
WITH m AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN list_transform(embedding, lambda v: abs(v::DOUBLE)) WHEN 1 THEN list_transform(embedding, lambda v: abs(v::DOUBLE) * 400) WHEN 2 THEN list_transform(embedding, lambda v: v::DOUBLE * 400)
  WHEN 3 THEN list_append(list_transform(embedding, lambda v: abs(v::DOUBLE)), 'inf'::DOUBLE) ELSE list_transform(embedding, lambda v: v::DOUBLE / 100) END AS v FROM embeddings),
r AS (SELECT vec_id, v, CASE WHEN v IS NULL OR len(v) = 0 THEN 'NO_VALUES' WHEN list_bool_or(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x))) THEN 'NON_FINITE' WHEN list_max(v) > 1 AND (list_max(v) > 255 OR list_min(v) < 0) THEN 'OUT_OF_RANGE' WHEN list_min(v) < 0 THEN 'NEGATIVE' END AS refusal FROM m)
SELECT vec_id AS mask_id, refusal, CASE WHEN refusal IS NULL THEN CAST(len(list_filter(v, lambda x: x / CASE WHEN list_max(v) > 1 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END >= 0.1::DOUBLE)) AS BIGINT) END AS pixels FROM r
""")
def mask_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as masks: fractions, 8-bit values, signed and infinite ones."""
    kind, raw = F.col("vec_id") % 5, F.col("embedding").cast("array<double>")
    size = F.transform(raw, F.abs)
    wide = F.transform(size, lambda v: v * 400)
    values = F.when(kind == 0, size).when(kind == 1, wide).when(kind == 2, F.transform(raw, lambda v: v * 400)).when(kind == 3, F.concat(size, F.array(F.lit(float("inf"))))).otherwise(F.transform(raw, lambda v: v / 100))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("mask_id"), values.alias("values"))
    inside = F.size(F.filter(R.probabilities(F.col("values")), lambda p: p >= 0.1)).cast("long")
    refusal = R.mask_refusal(F.col("values"))
    return rows.select("mask_id", refusal.alias("refusal"), F.when(refusal.isNull(), inside).alias("pixels"))
