"""A corpus from raw documents to packed sequences, by five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it to the shared folder and reads it again for the next stage, and
then deletes what that stage was made of. No stage but the last changes the
columns of ``documents``.

Defined results: null texts count as empty and equal empty ones; rows that
repeat a doc_id and text are one; extra columns, whatever their names, are
carried to the last stage; without labelled rows nothing is rejected; empty
tables give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixloom.llm import exact_dedup, mixing, packing, quality_gam, simhash_dedup
from helixloom.llm.common import TABLES, as_written, drop_stored, stored, table
from helixloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, fitted on ``labels``, rejects."""
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the row with the least doc_id stays."""
    return simhash_dedup.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in an order that interleaves sources by target weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; their ids follow the order of the mix."""
    return packing.pack(as_written(docs), tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

# A fitted classifier, fingerprints and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), len(TABLES)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_stored(spark, since)
    return docs
