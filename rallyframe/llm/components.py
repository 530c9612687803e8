"""Connected components of a graph kept in tables: hooking to the least neighbour, pointer jumping, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import materialise


def roots(parent: DataFrame, how: str | None = None) -> DataFrame:
    """(id, root) from (id, root) where a root may itself have one; the distance halves in each pass.  ``how``: a hint for the joins."""
    while True:
        up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
        up = up.hint(how) if how else up
        jumped = materialise(parent.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jump")
        parent = jumped.select("id", "root")
        if jumped.where("moved").limit(1).count() == 0:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id that is not the least of its component; edges are (a, b) with a < b.

    Each round hooks every id to its least smaller neighbour and contracts the forest, so the number
    of rounds and of jumps in them grows with the logarithm of the component's size.
    """
    edges = materialise(edges.select("a", "b").distinct(), "edges")
    found = None
    while edges.limit(1).count():
        step = roots(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")))
        found = step if found is None else materialise(relabel(found, step, "root").unionByName(step), "roots")
        ends = relabel(relabel(edges, step, "a"), step, "b")
        edges = materialise(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def relabel(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its root where ``labels`` has one."""
    named = labels.select(F.col("id").alias(column), F.col("root").alias("_root"))
    return df.join(named, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")
