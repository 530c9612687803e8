"""Relational primitives that have a shape of their own: keyed merges, set operations, guarded SQL, browsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by spaces with nulls left out, contain the text in any case."""
    pattern = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(F.concat_ws(" ", *columns).ilike(f"%{pattern}%"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, update: bool = True) -> DataFrame:
    """Last-wins merge on null-safe keys: of new rows the one of greatest ``order`` holds; without ``update`` old rows stay."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.desc("_new") if update else F.asc("_new")
    w = Window.partitionBy(*keys).orderBy(first, F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_for_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the keys in ``new`` go, the new ones come; null keys match each other."""
    touched = new.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, (old[k].eqNullSafe(touched[k]) for k in keys))
    return old.join(touched, same, "left_anti").unionByName(new)


def new_only(rows: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose natural key isn't known, the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(known.select(*keys).distinct(), keys, "left_anti")


def merge_by_priority(rows: DataFrame, keys: list[str], priority: str, columns: list[str]) -> DataFrame:
    """One row per key: each column from the source of highest priority (smallest number) that has it."""
    return rows.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in columns))


def on_either(facts: DataFrame, pairs: tuple[tuple[str, Column], ...], ids: DataFrame, id_col: str) -> DataFrame:
    """Facts joined to ids through any of several (tag, column): an unpivot and one equi-join instead of an OR in the join."""
    tagged = F.explode(F.array(*(F.struct(F.lit(t).alias("via"), c.cast("long").alias(id_col)) for t, c in pairs))).alias("t")
    return facts.select("*", tagged).select(*facts.columns, "t.*").join(ids, id_col)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def browse(df: DataFrame, columns: list[str], where: str = "true", order: list[str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    out = df.where(F.expr(where))
    return (out.orderBy(*order) if order else out).select(*columns).offset(offset).limit(limit)


def read_only_sql(spark: SparkSession, text: str, limit: int = 1000) -> DataFrame:
    """A SELECT over registered views; anything that isn't a query is refused on its parsed plan, and the result is limited."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if any(word in plan.getClass().getName() for word in ("command", "Command", "Insert", "Create", "Drop", "Delete", "Update", "Merge")):
        raise ValueError("only queries are allowed")
    return spark.sql(text).limit(limit)


def columns_of(df: DataFrame) -> DataFrame:
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
