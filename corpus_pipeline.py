"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes every stage's result as Parquet into the shared folder
and reads it again.  All stages but the last return the columns of
``documents``:

1. quality: rejected documents go;
2. near_dedup: one document of each SimHash component stays;
3. decontaminate: documents that hold a benchmark window go;
4. secrets: confirmed secrets are replaced inside the text, all rows stay;
5. pack: pieces of power-of-two length, one row each.

SQL cannot express the hashed ratio, the fingerprints, the forest or the
tokeniser, so there is no ORACLE_SQL; tests hold the pipeline against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import packing, quality, secrets, simhash, winnow
from basketry.llm.queries import packed_rows, query
from basketry.session import stage
from basketry.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs, shingle_words=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.keep_clean(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_rows(packing.pack(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    return run(spark, sf_dir)
