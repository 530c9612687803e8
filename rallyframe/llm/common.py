"""What the training-data operators share: shared-folder tables, columns by role, Arrow helpers.

Conventions of the subpackage
-----------------------------
* An operator takes a DataFrame plus the names of its id and text columns and reads no other
  column, so extra columns, whatever their names, never clash with the operator's own.
* A null text counts as the empty text unless an operator says otherwise.
* Rows are never dropped for being large, repeated or frequent.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.  Where it is unset, local mode takes a folder of its own; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rallyframe-")
        spark.conf.set("rallyframe.local.dir", base)
        base = f"file://{base}"
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table cuts the lineage: a lost executor re-reads it instead of repeating the work above it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one; what is written there is listed for :func:`discard`."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def mark() -> int:
    """The number of interim folders so far."""
    return len(_written)


def discard(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Delete the interim folders made since ``mark()`` gave ``since``, but those that ``but`` reads."""
    needed = but.inputFiles()
    left = []
    for path in _written[since:]:
        name = path.rpartition("/")[2]
        if any(f"/{name}/" in f for f in needed):
            left.append(path)
        else:
            remove(spark, path)
    _written[since:] = left


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _base(spark: SparkSession) -> str:
    return spark.conf.get("rallyframe.shared.dir", None) or _remember(spark)


def _remember(spark: SparkSession) -> str:
    base = shared_dir(spark)
    spark.conf.set("rallyframe.shared.dir", base)
    return base


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty), under the fixed names ``doc_id`` and ``text``."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch, text_at: int, most: int = 4 << 20):
    """Consecutive parts of an Arrow batch whose texts have about ``most`` bytes, so a task's lists stay small; a longer text is a part alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0))
    part = np.cumsum(size) // most
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def parts_of(batches, text_at: int, most: int = 4 << 20):
    """The batches of a task in slices of a few MB of text."""
    for batch in batches:
        yield from slices(batch, text_at, most)


_holder: dict = {}


def hold_cache(name, clear) -> None:
    """Only one operator's cache lives in a Python worker: when another begins to fill its own, the last one is cleared, and
    what it took goes back to the machine (a worker lives as long as its executor, and freed memory would stay with it)."""
    if _holder.get("name") != name:
        if "clear" in _holder:
            _holder["clear"]()
            give_back()
        _holder.update(name=name, clear=clear)


def give_back() -> None:
    """Return freed memory to the machine, where the C library knows how to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
