"""A training-data pipeline over documents: rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, mixing with the number of each copy beside them.  Rows that a stage drops are gone for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltmill.llm import exact_dedup, mixing, ngram_join, piece_codec, quality_rules
from voltmill.llm.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.annotate(docs, only_kept=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word Jaccard links of 0.75 or more the document with the least doc_id."""
    return ngram_join.keep_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target weight takes it; copy numbers its rows."""
    return mixing.repeat_rows(docs, copy="copy")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that is left; each copy has its own merge-dropout."""
    return piece_codec.encode_documents(docs, keep=("doc_id", "lang", "source"), copy="copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("source_mixing", mix),
    ("piece_codec", pieces),
]

#: Mixing and merge-dropout draw keyed random numbers that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else cut(docs)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
