"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made by :func:`stored` in this process, oldest first.
TABLES: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where a local session names none (tests, a laptop), a temporary folder is
    set once and used instead; on a cluster that is an error, as executors
    would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not current.isDefined():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixloom-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts
    the lineage, survives lost executors, and allows column pruning."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    TABLES.append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def as_written(df: DataFrame) -> DataFrame:
    """A table read from the files of one write, in the order in which its
    partitions and rows were written; Spark deals files out by size. Frames
    that don't come from files are in their partitions' order already."""
    try:  # Spark's own column, even if the table has one of that name
        at = df.metadataColumn("_metadata")
    except AnalysisException as none:
        if "_metadata" in str(none):
            return df
        raise
    name = at.getField("file_name")
    number = F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long")
    # the table's columns in one struct, so that none can clash with the order's
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(number, name, at.getField("row_index")).alias("order"))
    return placed.repartitionByRange("order").sortWithinPartitions("order").select("row.*")


def drop_stored(spark: SparkSession, since: int) -> None:
    """Deletes the folders made after the first ``since``, but for the newest,
    which holds what has been made of the others."""
    for folder in TABLES[since:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del TABLES[since:-1]


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
