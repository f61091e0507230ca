"""Bounded labelled samples for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on, on the driver.
MAX_ROWS = 20_000


def fold(modulus: int, held: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``held``; a null
    doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents that are not
    held out: those whose doc_id hashes lowest. A document labelled both ways
    counts as 0; of texts that share a doc_id the least counts, so that which
    rows are kept doesn't depend on the order of tasks. The label side is
    bounded, so it is broadcast and texts that aren't chosen are dropped where
    they are read."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    chosen = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")
