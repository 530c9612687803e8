"""Pages of players, teams, clubs, territories, pools and competitions: blocks of figures, one row per figure.

A page is the union of its blocks, each an aggregate of its own: (id, block, item, metric, value), so one
scan of a block serves the pages of all entities, and a page is read with a filter on its id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block(name: str, figures: DataFrame, id_col: str, metrics: list[str], item_col: str | None = None) -> DataFrame:
    """The figures of one block in long form; ``item`` is null for totals."""
    item = F.col(item_col).cast("string") if item_col else F.lit(None).cast("string")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return figures.select(F.col(id_col).cast("string").alias("id"), F.lit(name).alias("block"), item.alias("item"), each.alias("m")).select("id", "block", "item", "m.*")


def page(*blocks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, blocks)


def coaches(staff: DataFrame) -> DataFrame:
    """Coaches (roles EA and EB) by name and licence: matches, teams, seasons, matches won.  Null licences are one of their own."""
    n = staff.where(F.col("role").isin("EA", "EB")).groupBy("name", "licence")
    return n.agg(F.countDistinct("match_id").alias("matches"), F.countDistinct("team_id").alias("teams"), F.countDistinct("season").alias("seasons"), F.countDistinct(F.when(F.col("won"), F.struct("match_id", "team_id"))).alias("wins"))
