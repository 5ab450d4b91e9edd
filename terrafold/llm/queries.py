"""Queries of the training-data operators over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, ctph, fim, harmonic, licenses, mixing, near_dup, packing, quality, rans, sharding, toxicity
from .common import Scratch, vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as a rANS file and read back."""
    to = f"{Scratch(spark).base}/token_file"
    rans.write_file(table(spark, sf_dir, "documents"), to, vocabulary("byte_bpe_50k.json"), kind="byte", end_id=2)
    return rans.read_documents(spark, to, with_ids=False)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License passages in all documents: matched coverage and spans."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), kind="word", end_id=1, length=4096)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    return ctph.compare_with_next(table(spark, sf_dir, "documents"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts stay together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24, overhead=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a weighted mix of the sources takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *(f"mixed.{c}" for c in ("size", "source_size", "target", "taken", "copies", "draws")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 85 of 100 five-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations of two and three words."""
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, most=2000, inside=50)


def op12_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, by harmonic classes."""
    return harmonic.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), kind="word", end_id=2, length=4096)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-the-middle examples, and their texts rebuilt from those, as digests."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", F.col("fim.units").alias("n"), form.alias("form"), "fim.prefix_chars", "fim.middle_chars", digest(output).alias("output_sha256"), digest(fim.restore(output, form)).alias("restored_sha256")
    )


_COLLOCATIONS_SQL = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), listed AS (
    SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), word AS (
    SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS nr FROM listed
), run AS (
    SELECT lang, w1, lead(w1) OVER (PARTITION BY id ORDER BY nr) AS w2, lead(w1, 2) OVER (PARTITION BY id ORDER BY nr) AS w3 FROM word
), f AS (
    SELECT lang, w1 AS p, 1 AS k, count(*) AS f FROM run GROUP BY lang, w1
    UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM run WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM run WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
), total AS (
    SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), candidate AS (
    SELECT lang, p, k, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cut AS (
    SELECT c.lang, c.p, c.k, c.a, t.c AS cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
    FROM candidate c JOIN (VALUES (1), (2)) AS t(c) ON t.c < c.k
    JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.w[1:t.c], ' ') JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.w[t.c + 1:], ' ')
), scored AS (
    SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), longer AS (
    SELECT lang, p, max(a) AS a FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS p, a FROM candidate WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidate WHERE k = 3) GROUP BY lang, p
), kept AS (
    SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.p = s.p WHERE o.a IS NULL OR s.k = 3 OR 100 * o.a < 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

_FILL_IN_MIDDLE_SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), ranks AS (
    SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS share, ('0x' || h[25:32])::BIGINT % 100 AS spm FROM drawn
), parts AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR share >= 90 THEN 'plain' WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form,
        substring(text, 1, least(a, b)) AS p, substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substring(text, greatest(a, b) + 1) AS s FROM ranks
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(a, b)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (greatest(a, b) - least(a, b))::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_rans, op2_nearest, op3_licenses, op4_pack, op5_fingerprints, op6_shard, op7_toxicity, op8_mix, op9_quality, op10_near_duplicates, op11_collocations, op12_harmonic_pack, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": _COLLOCATIONS_SQL, "op13_fill_in_middle": _FILL_IN_MIDDLE_SQL}
