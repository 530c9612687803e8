"""Interim tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset local mode takes a folder of its own, and a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rallyframe.interim.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rallyframe-')}"
        spark.conf.set("rallyframe.interim.dir", base)
    return base.rstrip("/")


#: Bytes of a table's files that one task takes after a shuffle of its rows.
TASK_BYTES = 8 << 20


def tasks_for(spark: SparkSession, path: str) -> int:
    """Tasks for a shuffle of a table's rows: more for larger files, so that a task's memory doesn't grow with the table; the session's number at least."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def stored(df: DataFrame, name: str = "interim") -> DataFrame:
    """Write a frame as a table and read it back: the lineage ends there, so a lost executor only reads it again."""
    path = f"{_shared(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
