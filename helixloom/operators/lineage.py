"""Cuts long plans by tables in the session's shared folder, and deals rows
out over as many tasks as they need."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a packed table below ``spark.checkpoint.dir``, worked out once (a
    checkpoint lies there unpacked, after two runs of its last stage); only a
    local session that names no folder gets a temporary one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixloom-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that one task sorts or groups, some 100 MB there.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows``, some ``n``, dealt out by ``key``: a task's share doesn't grow
    with them. Spark alone goes by packed bytes, of which short rows have few."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-n // TASK_ROWS)), key)
