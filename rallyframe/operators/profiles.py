"""Profiles and reports of players, teams, clubs, referees, seasons: each block is one DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.leaders import pct


def player_stats(appearances: DataFrame) -> DataFrame:
    """Totals of each player; a draw counts neither as win nor as defeat."""
    a = appearances.where("played")
    n = a.groupBy("player_id").agg(
        F.countDistinct("match_id").alias("matches"), F.countDistinct("team_id").alias("teams"), F.countDistinct("season").alias("seasons"),
        F.count_if("captain").alias("captaincies"), F.count_if("libero").alias("liberos"),
        F.count_if(F.col("sets_for") > F.col("sets_against")).alias("wins"), F.count_if(F.col("sets_for") < F.col("sets_against")).alias("defeats"),
    )
    return n.withColumn("rate", pct(F.col("wins"), F.col("matches")))


def shirts(appearances: DataFrame) -> DataFrame:
    return appearances.where("played").groupBy("player_id", "shirt").agg(F.count(F.lit(1)).alias("times"))


def roster(appearances: DataFrame) -> DataFrame:
    """Players of each team and season: matches, captaincies, libero appearances, and the greatest shirt number as text."""
    return appearances.where("played").groupBy("team_id", "season", "player_id").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if("captain").alias("captaincies"), F.count_if("libero").alias("liberos"), F.max(F.col("shirt").cast("string")).alias("shirt")
    )


def referee_stats(matches: DataFrame) -> DataFrame:
    return matches.where("played").groupBy("referee_id").agg(F.countDistinct("match_id").alias("matches"), F.countDistinct("season").alias("seasons"), F.countDistinct("competition").alias("competitions"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def matches_by_month(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.count(F.lit(1)).alias("matches"), F.count_if("played").alias("played"))


def season_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("competition").alias("competitions"), F.count_if("played").alias("played"), F.count_if("forfeit").alias("forfeits"))


def team_mates(appearances: DataFrame, player_ids: list[int] | None = None) -> DataFrame:
    """With whom the asked players (all, if none are named) shared a side, and how often: the asked are filtered first, so the join stays narrow."""
    a = appearances.where("played").select("match_id", "side", "player_id")
    mine = a.where(F.col("player_id").isin(*player_ids) if player_ids else F.lit(True)).select("match_id", "side", F.col("player_id").alias("asked"))
    both = a.join(mine, ["match_id", "side"]).where("player_id <> asked")
    return both.groupBy("asked", "player_id").agg(F.count(F.lit(1)).alias("matches"))


def opponents(appearances: DataFrame, sides: DataFrame, player_ids: list[int] | None = None) -> DataFrame:
    """The teams that the asked players (all, if none are named) met, and how often they won."""
    asked = F.col("player_id").isin(*player_ids) if player_ids else F.lit(True)
    mine = appearances.where(F.col("played") & asked).select("match_id", "side", "player_id")
    met = mine.join(sides.select("match_id", "side", "opponent_id", "sets_for", "sets_against"), ["match_id", "side"])
    return met.groupBy("player_id", "opponent_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("sets_for") > F.col("sets_against")).alias("wins"))


def team_form(sides: DataFrame, last: int = 5) -> DataFrame:
    """Record, home and away wins, and the last results of each team over all competitions, newest first."""
    s = sides.where("played")
    won = F.col("sets_for") > F.col("sets_against")
    w = Window.partitionBy("team_id").orderBy(F.desc("day"), F.desc("match_id"))
    rows = s.withColumn("n", F.row_number().over(w)).withColumn("mark", F.when(won, "V").otherwise("D"))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= last, F.struct("n", "mark")))), lambda x: x["mark"]), "")
    return rows.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(won).alias("wins"), F.count_if(won & (F.col("side") == "A")).alias("home_wins"), F.count_if(won & (F.col("side") == "B")).alias("away_wins"), marks.alias("last")
    )


def club_report(sides: DataFrame, appearances: DataFrame, teams: DataFrame) -> DataFrame:
    """Club by season: teams, matches, wins, players."""
    t = teams.select("team_id", "club_id")
    m = sides.where("played").join(t, "team_id").groupBy("club_id", "season").agg(F.countDistinct("team_id").alias("teams"), F.count(F.lit(1)).alias("matches"), F.count_if(F.col("sets_for") > F.col("sets_against")).alias("wins"))
    p = appearances.where("played").join(t, "team_id").groupBy("club_id", "season").agg(F.countDistinct("player_id").alias("players"))
    return m.join(p, ["club_id", "season"], "left").fillna(0, ["players"])


def competition_report(matches: DataFrame) -> DataFrame:
    m = matches.groupBy("season", "competition").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if("played").alias("played"), F.count_if("forfeit").alias("forfeits"),
        F.sum(F.when(F.col("played"), F.col("sets_a") + F.col("sets_b"))).alias("sets"), F.sum(F.when(F.col("played"), F.col("points_a") + F.col("points_b"))).alias("points"),
        F.count_if(F.col("played") & (F.col("sets_a") + F.col("sets_b") == 5)).alias("five_sets"),
    )
    return m.withColumn("points_per_set", F.coalesce(F.round(F.try_divide(F.col("points").cast("double"), F.col("sets")), 2), F.lit(0.0).cast("double")))


def club_levels(sides: DataFrame, teams: DataFrame) -> DataFrame:
    """Club evolution: each season's best level (least competition number), its change against the season before, and the label of the move."""
    level = 6 - F.substring("competition", 1, 1).cast("int")
    s = sides.where("played").join(teams.select("team_id", "club_id"), "team_id").groupBy("club_id", "season").agg(F.avg(level).alias("mean_level"), F.max(level).alias("best_level"))
    w = Window.partitionBy("club_id").orderBy("season")
    gap = F.col("season") - F.lag("season").over(w)
    change = F.round("mean_level", 3) - F.lag(F.round("mean_level", 3)).over(w)
    move = F.when(change.isNull(), "new").when(gap > 1, "back").when(change >= 0.05, "up").when(change <= -0.05, "down").otherwise("same")
    return s.select("club_id", "season", "best_level", F.round("mean_level", 3).alias("mean_level"), F.round(change, 3).alias("change"), move.alias("move"))


def dashboard(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, rows): one count each, in one frame."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(k).alias("entity"), F.count(F.lit(1)).alias("rows")) for k, df in tables.items()))


def global_search(text: str, **entities: tuple[DataFrame, str, str]) -> DataFrame:
    """(entity, id, name) of everything whose name contains the text in any case; each entity gives (frame, id, name)."""
    parts = [df.where(F.contains(F.lower(F.col(name)), F.lit(text.lower()))).select(F.lit(k).alias("entity"), F.col(i).cast("long").alias("id"), F.col(name).alias("name")) for k, (df, i, name) in entities.items()]
    return reduce(DataFrame.unionByName, parts)


def player_summary_of_sides(appearances: DataFrame) -> DataFrame:
    """Per (match, side): players, points, serves, longest run."""
    return appearances.groupBy("match_id", "side").agg(F.count(F.lit(1)).alias("players"), F.sum("points").alias("points"), F.sum("serves").alias("serves"), F.max("longest_run").alias("longest_run"))


def best_past_level(appearances: DataFrame) -> DataFrame:
    """For each (player, match): the best level before it, if strictly above the match's own."""
    level = (6 - F.substring("competition", 1, 1).cast("int")).cast("long")
    w = Window.partitionBy("player_id").orderBy("day", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = appearances.where("played").withColumn("level", level).withColumn("best", F.max("level").over(w))
    return rows.where("best > level").select("player_id", "match_id", "level", "best")


def oldest_possible(appearances: DataFrame, age_of_competition: dict[str, int]) -> DataFrame:
    """Latest year of birth that a player's youth competitions allow: the greatest season end less age limit."""
    table = F.create_map(*(F.lit(x) for kv in age_of_competition.items() for x in kv))
    year = F.col("season") + 1 - F.try_element_at(table, F.col("competition"))
    return appearances.where("played").groupBy("player_id").agg(F.max(year).alias("born_from")).where("born_from is not null")
