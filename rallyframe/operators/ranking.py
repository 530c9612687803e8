"""The ranking engine: any entity by any metric of its rollup, with exact ranks and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metrics by entity.  A rate orders players and teams by number of wins, as specified.
METRICS = {
    "players": {"matches": "matches", "wins": "wins", "win_rate": "wins", "points": "points", "serves": "serves", "longest_run": "longest_run"},
    "teams": {"matches": "matches", "wins": "wins", "win_rate": "wins", "points": "points", "set_ratio": "set_ratio", "point_ratio": "point_ratio"},
    "clubs": {"matches": "matches", "wins": "wins", "win_rate": "rate", "players": "players"},
}
IDS = {"players": ["player_id"], "teams": ["team_id", "season", "competition"], "clubs": ["club_id"]}


@dataclass(frozen=True)
class Ranking:
    entity: str
    metric: str
    least_matches: int = 0
    ascending: bool = False
    page: int = 1
    page_size: int = 20


def rank_by(rollup: DataFrame, r: Ranking) -> DataFrame:
    """One page: rank, the ids, the metric's value, and how many rows pass in all."""
    column = METRICS[r.entity][r.metric]
    ids = IDS[r.entity]
    rows = rollup.where(F.col("matches") >= r.least_matches).select(*ids, F.col(column).cast("double").alias("value"), "matches")
    first = (r.page - 1) * r.page_size
    order = [F.col("value").asc_nulls_last() if r.ascending else F.col("value").desc_nulls_last(), F.desc("matches"), *ids]
    # the page is cut first (a top-k without a full sort), then numbered
    page = rows.orderBy(*order).offset(first).limit(r.page_size)
    numbered = page.withColumn("rank", (F.lit(first) + F.row_number().over(Window.orderBy(*order))).cast("long"))
    return numbered.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row
