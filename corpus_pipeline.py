"""A corpus pipeline of five stages, each over all that the stage before kept.

Toxic documents go, then those of low quality, then near duplicates but one of each group; the rest is
mixed to its sources' target weights, repeats included, and packed into sequences. All stages but the last return
the columns of `documents`; the last returns the pieces with their places.

Rows without text stay in a filtering stage if the models keep an empty text; rows that repeat share every
decision until near-dedup leaves one of them; rows with a null doc_id are judged by their texts like all others, mixed by text, and packed
with a null id. Further columns are dropped, so their names can't clash; very long texts are processed whole; an empty table passes through
as an empty one. Near-dedup takes the similarity that this library's near-duplicate stages take unless told otherwise, 0.8;
the query op10_near_duplicates takes 0.85.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import mixing, near_dup, packing, quality, toxicity
from terrafold.llm.common import Scratch, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field doesn't score as toxic; every row is judged by its own text, with or without an id."""
    return toxicity.calm_documents(docs.select(*COLUMNS), toxicity.fit(docs, _labels(spark, sf_dir)), 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores as good; every row is judged by its own text, with or without an id."""
    return quality.good_documents(docs.select(*COLUMNS), quality.fit(docs, _labels(spark, sf_dir)), 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (80 of 100 shingles), the one with the smallest doc_id.

    Rows of one id and equal text are one document and stay once. Rows without id, and rows whose id has further texts
    (all but the one of least hash), are told apart by a hash of their text; within a group a row with an id of its own stays
    before them.
    """
    return near_dup.keep_one(docs.select(*COLUMNS), percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every copy that it takes, shuffled within shards."""
    return mixing.materialise(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Models, exact sets and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each result written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k > 0:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
