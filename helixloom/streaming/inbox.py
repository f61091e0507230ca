"""Sequence files audited as they arrive; an extension of the batch audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixloom.operators import audit, decompose
from helixloom.sources import files


def arrivals(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """New files of a folder as (path, content, file_sha256, text)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)
    return raw.select("path", "content", F.sha2("content", 256).alias("file_sha256"), F.col("content").cast("string").alias("text"))


def audit_inbox(spark: SparkSession, folder: str, results: str, checkpoint: str, refs: DataFrame | None = None, **options) -> StreamingQuery:
    """Findings of new files and what was rejected, each batch written under
    its own number so that a batch run twice replaces itself.

    A file that comes again under another name is not audited again: the
    stream's state keeps the hash of every content that it has seen, 64 letters
    each. With ``refs`` (ref, seq) the whole audit is made of each record, with
    the file's own features as labels and the ``options`` of that audit;
    without, the checks of whole sequences."""

    def each(batch: DataFrame, number: int) -> None:
        found, rejected = files.records(batch)
        if refs is None:
            rows = audit.record_findings(found.select(F.col("path").alias("record"), "seq"))
        else:
            batch = batch.persist()
            labels = files.claims(batch).select(F.col("path").alias("record"), F.col("label").alias("claim"), F.lower("kind").alias("kind"), "start", "end", "strand")
            texts = found.select(F.col("path").alias("record"), "seq", (F.col("topology") == "circular").alias("circular"))
            _, rows, verdicts = decompose.audited(texts, refs, labels, **options)
            verdicts.write.mode("overwrite").parquet(f"{results}/verdicts/batch={number}")
        rows = rows.unionByName(rejected.select(F.col("path").alias("record"), F.col("reason").alias("category"), F.lit("FAIL").alias("status")))
        rows.write.mode("overwrite").parquet(f"{results}/batch={number}" if refs is None else f"{results}/findings/batch={number}")
        batch.unpersist()

    once = arrivals(spark, folder).dropDuplicates(["file_sha256"])
    return once.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
