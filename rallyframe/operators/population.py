"""Licences by season, retention, and activity by territory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.leaders import pct


def licence_history(appearances: DataFrame) -> DataFrame:
    """Per player and season: new, continued (played the season before) or resumed after a gap of seasons."""
    seasons = appearances.select("season").where("season is not null").distinct()
    index = seasons.withColumn("n", F.row_number().over(Window.orderBy("season")).cast("long"))  # a few rows
    active = appearances.select("player_id", "season").where("season is not null").distinct().join(F.broadcast(index), "season")
    w = Window.partitionBy("player_id").orderBy("n")
    gap = F.col("n") - F.lag("n").over(w) - 1
    kind = F.when(gap.isNull(), "new").when(gap == 0, "continued").otherwise("resumed")
    return active.select("player_id", "season", kind.alias("licence"), F.first("season").over(w).alias("first_season"), F.coalesce(gap, F.lit(0)).alias("seasons_away"))


def licence_report(history: DataFrame) -> DataFrame:
    n = history.groupBy("season").agg(
        F.count(F.lit(1)).alias("licences"),
        *(F.count_if(F.col("licence") == k).alias(k) for k in ("new", "continued", "resumed")),
    )
    return n.select("*", *(pct(F.col(k), F.col("licences")).alias(f"{k}_pct") for k in ("new", "continued", "resumed")))


def retention(history: DataFrame) -> DataFrame:
    """Per pair of consecutive seasons: who stayed, left and arrived."""
    a = history.select("player_id", "season")
    seasons = a.select("season").distinct()
    w = Window.orderBy("season")
    pairs = seasons.select("season", F.lead("season").over(w).alias("next")).where("next is not null")  # a few rows
    before = a.join(F.broadcast(pairs), "season")
    after = a.select("player_id", F.col("season").alias("next"), F.lit(1).alias("here")).join(F.broadcast(pairs), "next")
    both = before.withColumn("there", F.lit(1)).join(after, ["player_id", "season", "next"], "full")
    counted = both.groupBy("season", "next").agg(
        F.count_if(F.col("there").isNotNull() & F.col("here").isNotNull()).alias("stayed"),
        F.count_if(F.col("here").isNull()).alias("left"),
        F.count_if(F.col("there").isNull()).alias("arrived"),
    )
    return counted.withColumn("retention_pct", pct(F.col("stayed"), F.col("stayed") + F.col("left")))


def territory(sides: DataFrame, appearances: DataFrame, teams: DataFrame, clubs: DataFrame) -> DataFrame:
    """Nation, region and club in one frame: teams, matches touching the scope and distinct players, by grouping sets over the bridge."""
    place = teams.join(clubs, "club_id").select("team_id", "club_id", "league_id")
    m = sides.where("played").join(place, "team_id").rollup("league_id", "club_id").agg(F.countDistinct("match_id").alias("matches"), F.countDistinct("team_id").alias("teams"))
    p = appearances.where("played").join(place, "team_id").rollup("league_id", "club_id").agg(F.countDistinct("player_id").alias("players"))
    same = F.col("m.league_id").eqNullSafe(F.col("p.league_id")) & F.col("m.club_id").eqNullSafe(F.col("p.club_id"))
    scope = F.when(F.col("m.league_id").isNull(), "nation").when(F.col("m.club_id").isNull(), "region").otherwise("club")
    return m.alias("m").join(p.alias("p"), same).select(scope.alias("scope"), "m.league_id", "m.club_id", "teams", "matches", "players")
