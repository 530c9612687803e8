"""Matches kept from exports and sheets: a keyed merge with precedence by column, turned sheets and a queue of what is to be read again.

An export is official: its score and day hold, and hold again when it is corrected.  A sheet brings sets and details and
fills what the export lacks; it is read once, unless it is forced, still queued, or the export's score has moved since.
A forced sheet's score holds until the export's moves.  Applying a batch again changes nothing, not even a version.

Batches: ``season``, ``competition``, ``code``, ``source`` (export or sheet), ``read_at``, ``team_a``, ``team_b``, ``day``, ``hall``, ``score``
(sets of A and B with a stroke between), ``sets`` (array<struct<a, b>>).  Of several rows of a key and source the last read holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rallyframe.functions.names import with_swaps
from rallyframe.functions.scalars import score_pair

KEY = ["season", "competition", "code"]
SETS = "array<struct<a:int,b:int>>"
CONTENT = {
    "team_a": "string", "team_b": "string", "day": "date", "hall": "string", "score": "string", "score_export": "string", "score_sheet": "string", "sets": SETS, "details": "boolean", "turned": "boolean", "status": "string",
}
STATE = ", ".join(["season string", "competition string", "code string", *(f"{k} {t}" for k, t in CONTENT.items()), "version long"])
_ROW = ("team_a", "team_b", "day", "hall", "score", "sets")


def no_matches(spark: SparkSession) -> DataFrame:
    """The state before any batch."""
    return spark.createDataFrame([], STATE)


def _mirrored(score: Column) -> Column:
    """A score from the other side; a text without a stroke stays."""
    parts = F.split(score, "/")
    return F.when(F.size(parts) == 2, F.concat_ws("/", parts[1], parts[0])).otherwise(score)


def merge_batch(known: DataFrame, batch: DataFrame, force: bool = False) -> DataFrame:
    """The state after a batch; rows of keys that are null never meet.  One shuffle brings a key's rows together.

    ``status``: ``queued`` (a sheet is to be read, for the first time or again), ``parsed``, or ``conflict`` (read, with another score
    than the export's).  ``turned``: the sheet named the teams the other way round.
    """
    last = F.row_number().over(Window.partitionBy(*KEY, "source").orderBy(F.desc("read_at"), F.desc("score"), F.desc("hall")))
    new = batch.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in KEY))).withColumn("_n", last).where("_n = 1")
    row = F.struct(*(F.col(k).cast(SETS if k == "sets" else CONTENT[k]).alias(k) for k in _ROW))
    old = F.struct(*CONTENT, "version")
    none = lambda of: F.lit(None).cast(of)
    row_type, old_type = "struct<" + ",".join(f"{k}:{CONTENT[k]}" for k in _ROW) + ">", "struct<" + ",".join(f"{k}:{t}" for k, t in CONTENT.items()) + ",version:bigint>"
    tagged = known.select(*KEY, old.alias("k"), none(row_type).alias("e"), none(row_type).alias("s")).unionByName(
        new.select(*KEY, none(old_type).alias("k"), F.when(F.col("source") == "export", row).alias("e"), F.when(F.col("source") == "sheet", row).alias("s"))
    )
    one = tagged.groupBy(*KEY).agg(*(F.first(c, ignorenulls=True).alias(c) for c in "kes"))
    official = F.col("k").isNotNull() | F.col("e").isNotNull()
    first = lambda c: F.coalesce(f"k.{c}", f"e.{c}")
    pair = score_pair(F.coalesce("e.score", "k.score_export"))
    named = one.select("*", first("team_a").alias("name_a"), first("team_b").alias("name_b"), F.col("s.team_a").alias("sheet_a"), F.col("s.team_b").alias("sheet_b"), F.col("s.score").alias("sheet_score"), pair["a"].alias("sets_a"), pair["b"].alias("sets_b"))
    known_names = with_swaps(named, "name_a", "name_b", "sheet_a", "sheet_b", "sheet_score", "sets_a", "sets_b")
    turned = official & F.coalesce("swapped", F.lit(False))
    moved = F.col("e.score").isNotNull() & F.col("k.score_export").isNotNull() & (F.col("e.score") != F.col("k.score_export"))
    had = F.coalesce("k.details", F.lit(False))
    reads = F.col("s").isNotNull() & (F.lit(force) | ~had | F.coalesce(F.col("k.status") == "queued", F.lit(False)) | F.coalesce(moved, F.lit(False)))
    r = known_names.withColumn("_turned", turned).withColumn("_moved", F.coalesce(moved, F.lit(False))).withColumn("_reads", reads)
    sheet_score = F.when(F.col("_turned"), _mirrored(F.col("s.score"))).otherwise(F.col("s.score"))
    sheet_sets = F.when(F.col("_turned"), F.transform("s.sets", lambda x: F.struct(x["b"].alias("a"), x["a"].alias("b")))).otherwise(F.col("s.sets"))
    r = r.withColumn("_sheet_score", sheet_score).withColumn("_sheet_sets", sheet_sets)
    score_export = F.coalesce("e.score", "k.score_export")
    score_sheet = F.when(F.col("_reads"), F.coalesce("_sheet_score", "k.score_sheet")).otherwise(F.col("k.score_sheet"))
    fresh = F.col("e.score").isNotNull() & ~F.col("e.score").eqNullSafe(F.col("k.score_export"))
    forced = F.lit(force) & F.col("_reads") & F.col("_sheet_score").isNotNull()
    score = F.when(forced, F.col("_sheet_score")).when(fresh, F.col("e.score")).otherwise(F.coalesce("k.score", score_export, score_sheet))
    details = F.coalesce("k.details", F.lit(False)) | (F.col("_reads") & (F.coalesce(F.size("_sheet_sets"), F.lit(0)) > 0))
    r = r.withColumn("_export", score_export).withColumn("_sheet", score_sheet).withColumn("_details", details)
    read_status = F.when(F.coalesce(F.col("_export") != F.col("_sheet"), F.lit(False)), "conflict").otherwise("parsed")
    status = F.when(F.col("_reads") & F.col("_details"), read_status).when(F.col("_moved"), "queued").otherwise(F.coalesce("k.status", F.lit("queued")))
    in_order = lambda c: F.coalesce(*(F.col(f"{x}.{c}") for x in ("e", "k"))) if not force else F.coalesce(F.when(F.col("_reads"), F.col(f"s.{c}")), F.col(f"e.{c}"), F.col(f"k.{c}"))
    out = r.select(
        *KEY, "k", F.coalesce("k.team_a", "e.team_a", "s.team_a").alias("team_a"), F.coalesce("k.team_b", "e.team_b", "s.team_b").alias("team_b"),
        F.coalesce(in_order("day"), F.when(F.col("_reads"), F.col("s.day"))).alias("day"), F.coalesce(in_order("hall"), F.when(F.col("_reads"), F.col("s.hall"))).alias("hall"), score.alias("score"), F.col("_export").alias("score_export"),
        F.col("_sheet").alias("score_sheet"), F.when(F.col("_reads"), F.coalesce("_sheet_sets", "k.sets")).otherwise(F.col("k.sets")).alias("sets"), F.col("_details").alias("details"),
        F.when(F.col("_reads"), F.col("_turned")).otherwise(F.coalesce("k.turned", F.lit(False))).alias("turned"), status.alias("status"),
    )
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"k.{c}")) for c in CONTENT))
    version = F.when(F.col("k").isNull(), F.lit(1)).when(same, F.col("k.version")).otherwise(F.col("k.version") + 1).cast("long")
    return out.withColumn("version", version).select(*KEY, *CONTENT, "version")


def queue(state: DataFrame) -> DataFrame:
    """The matches whose sheet is to be read."""
    return state.where("status = 'queued'").select(*KEY, "version")


def keep_matches(stream: DataFrame, folder: str, checkpoint: str, force: bool = False) -> StreamingQuery:
    """Follow a stream of batches into ``folder``: each micro-batch writes the state after it as a table of its own number.

    A batch that is repeated after a failure starts from the state before it and writes the same table again.
    """
    spark = stream.sparkSession
    path_of = lambda n: f"{folder}/state-{n:08d}"

    def each(batch: DataFrame, batch_id: int) -> None:
        numbers = [n for n in _complete(spark, folder) if n < batch_id]
        known = spark.read.schema(STATE).parquet(path_of(max(numbers))) if numbers else no_matches(spark)
        merge_batch(known, batch, force).write.mode("overwrite").parquet(path_of(batch_id))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the states that were written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-*/_SUCCESS")) or []
    return [int(f.getPath().getParent().getName().removeprefix("state-")) for f in found]


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the last batch."""
    numbers = _complete(spark, folder)
    return spark.read.schema(STATE).parquet(f"{folder}/state-{max(numbers):08d}") if numbers else no_matches(spark)
