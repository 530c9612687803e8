"""Leaderboards: the best players, teams, clubs, referees, matches and sets.

Each takes the contest views and returns a small ranked DataFrame; every order ends with an id, so
ties are decided alike everywhere.  A limit is part of each report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Matches a rate needs.
LEAST_MATCHES = 5


def pct(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; 0 for no whole."""
    return F.coalesce(F.round(F.try_divide(F.lit(100.0).cast("double") * part, whole), 1), F.lit(0.0).cast("double"))


def _won() -> Column:
    return F.col("sets_for") > F.col("sets_against")


def _lost() -> Column:
    return F.col("sets_for") < F.col("sets_against")


def players_by_matches(appearances: DataFrame, limit: int = 10) -> DataFrame:
    n = appearances.where("played").groupBy("player_id").agg(F.countDistinct("match_id").alias("matches"))
    return n.orderBy(F.desc("matches"), "player_id").limit(limit)


def _player_results(appearances: DataFrame) -> DataFrame:
    return appearances.where("played").groupBy("player_id").agg(
        F.countDistinct("match_id").alias("matches"), F.count_if(_won()).alias("wins"), F.count_if(_lost()).alias("defeats")
    )


def players_by_wins(appearances: DataFrame, limit: int = 10) -> DataFrame:
    r = _player_results(appearances).withColumn("rate", pct(F.col("wins"), F.col("matches")))
    return r.orderBy(F.desc("wins"), "player_id").limit(limit).drop("defeats")


def players_by_rate(appearances: DataFrame, limit: int = 10, least: int = LEAST_MATCHES) -> DataFrame:
    r = _player_results(appearances).where(F.col("matches") >= least)
    exact = F.col("wins").cast("double") / F.col("matches")
    return r.orderBy(exact.desc(), F.desc("wins"), "player_id").limit(limit).select("player_id", "matches", "wins", pct(F.col("wins"), F.col("matches")).alias("rate"))


def players_by_defeats(appearances: DataFrame, limit: int = 10) -> DataFrame:
    r = _player_results(appearances).withColumn("rate", pct(F.col("defeats"), F.col("matches")))
    return r.orderBy(F.desc("defeats"), "player_id").limit(limit).drop("wins")


def match_points_records(appearances: DataFrame, limit: int = 10) -> DataFrame:
    return appearances.where("played and points > 0").select("player_id", "match_id", "day", "points").orderBy(F.desc("points"), "match_id", "player_id").limit(limit)


def players_by_flag(appearances: DataFrame, flag: str, limit: int = 10) -> DataFrame:
    """Most appearances as captain or libero."""
    return appearances.where(F.col("played") & F.col(flag)).groupBy("player_id").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "player_id").limit(limit)


def most_loyal(appearances: DataFrame, limit: int = 10) -> DataFrame:
    n = appearances.where("played").groupBy("player_id", "team_id").agg(F.countDistinct("match_id").alias("matches"))
    return n.orderBy(F.desc("matches"), "player_id", "team_id").limit(limit)


def top_scorers(appearances: DataFrame, limit: int = 10) -> DataFrame:
    r = appearances.where("played and points > 0").groupBy("player_id").agg(F.sum("points").alias("points"), F.countDistinct("match_id").alias("matches"))
    return r.orderBy(F.desc("points"), "player_id").limit(limit).withColumn("per_match", F.round(F.col("points") / F.greatest(F.lit(1), F.col("matches")), 2))


def top_servers(appearances: DataFrame, limit: int = 10) -> DataFrame:
    r = appearances.where("played and serves > 0").groupBy("player_id").agg(F.sum("serves").alias("serves"), F.max("longest_run").alias("longest_run"), F.countDistinct("match_id").alias("matches"))
    return r.orderBy(F.desc("serves"), "player_id").limit(limit).withColumn("per_match", F.round(F.col("serves") / F.greatest(F.lit(1), F.col("matches")), 2))


def win_streaks(appearances: DataFrame, limit: int = 10, candidates: int = 50, least: int = 3) -> DataFrame:
    """Record and current runs of wins of the most capped players: a loss starts a new island."""
    played = appearances.where("played")
    capped = played.groupBy("player_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "player_id").limit(candidates)
    rows = played.join(F.broadcast(capped.select("player_id")), "player_id")  # at most ``candidates`` rows
    w = Window.partitionBy("player_id").orderBy("day", "match_id")
    islands = rows.withColumn("won", _won()).withColumn("island", F.sum((~F.col("won")).cast("int")).over(w))
    runs = islands.groupBy("player_id", "island").agg(F.count_if("won").alias("run"))
    last = Window.partitionBy("player_id").orderBy(F.desc("island"))
    each = (
        runs.withColumn("current", F.first("run").over(last))
        .groupBy("player_id")
        .agg(F.max("run").alias("record"), F.max("current").alias("current"))
    )
    totals = rows.groupBy("player_id").agg(F.count(F.lit(1)).alias("matches"))
    return each.join(totals, "player_id").where(F.col("record") >= least).orderBy(F.desc("record"), F.desc("current"), "player_id").limit(limit)


def current_streaks(appearances: DataFrame, limit: int = 10, least: int = 2) -> DataFrame:
    """Running streaks among the 50 of :func:`win_streaks`."""
    return win_streaks(appearances, 50).where(F.col("current") >= least).orderBy(F.desc("current"), F.desc("record"), "player_id").limit(limit)


def _with_sets(matches: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    return sets.join(matches.where("played").select("match_id", "day", *columns), "match_id")


def closest_matches(matches: DataFrame, limit: int = 10) -> DataFrame:
    m = matches.where("played and not forfeit and points_a > 0 and points_b > 0")
    gap = F.abs(F.col("points_a") - F.col("points_b"))
    return m.select("match_id", "day", "points_a", "points_b", gap.alias("gap")).orderBy("gap", (F.col("points_a") + F.col("points_b")).desc(), "match_id").limit(limit)


def highest_sets(matches: DataFrame, sets: DataFrame, limit: int = 10) -> DataFrame:
    s = _with_sets(matches, sets).where("score_a >= 25 or score_b >= 25 or (number = 5 and (score_a >= 15 or score_b >= 15))")
    s = s.select("match_id", F.col("number").cast("long").alias("number"), "score_a", "score_b", (F.col("score_a") + F.col("score_b")).alias("total"), F.abs(F.col("score_a") - F.col("score_b")).alias("gap"))
    return s.orderBy(F.desc("total"), "gap", "match_id", "number").limit(limit)


def widest_sets(matches: DataFrame, sets: DataFrame, limit: int = 10) -> DataFrame:
    s = _with_sets(matches, sets, "team_a", "team_b").select(
        "match_id",
        F.col("number").cast("long").alias("number"),
        F.abs(F.col("score_a") - F.col("score_b")).alias("gap"),
        F.when(F.col("score_a") > F.col("score_b"), F.col("team_a")).otherwise(F.col("team_b")).alias("dominant"),
    )
    return s.orderBy(F.desc("gap"), "match_id", "number").limit(limit)


def comebacks(matches: DataFrame, sets: DataFrame, limit: int = 10) -> DataFrame:
    """Five-set matches by the largest set deficit that the winner made up; a drawn set counts for B."""
    five = matches.where("played and not forfeit and sets_a + sets_b = 5")
    w = Window.partitionBy("match_id").orderBy("number")
    step = F.when(F.col("score_a") > F.col("score_b"), 1).otherwise(-1)
    lead = sets.withColumn("lead", F.sum(step).over(w)).groupBy("match_id").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    both = five.join(lead, "match_id")
    a = F.col("sets_a") > F.col("sets_b")
    made_up = F.when(a, F.greatest(F.lit(0), -F.col("low"))).otherwise(F.greatest(F.lit(0), F.col("high")))
    out = both.select("match_id", "day", F.when(a, F.col("team_a")).otherwise(F.col("team_b")).alias("winner"), made_up.cast("long").alias("deficit"))
    return out.where("deficit >= 1").orderBy(F.desc("deficit"), "day", "match_id").limit(limit)


def longest_matches(matches: DataFrame, limit: int = 10, candidates: int = 100) -> DataFrame:
    """The matches of most points, then among these the longest."""
    m = matches.where("played and minutes is not null").select("match_id", "day", (F.col("points_a") + F.col("points_b")).alias("points"), "minutes")
    return m.orderBy(F.desc("points"), "match_id").limit(candidates).orderBy(F.desc("minutes"), F.desc("points"), "match_id").limit(limit)


def most_points_matches(matches: DataFrame, limit: int = 10) -> DataFrame:
    m = matches.where("played and minutes is not null")
    return m.select("match_id", "day", (F.col("points_a") + F.col("points_b")).alias("points")).orderBy(F.desc("points"), "match_id").limit(limit)


def teams_by_rate(sides: DataFrame, limit: int = 10, least: int = LEAST_MATCHES) -> DataFrame:
    r = sides.where("played").groupBy("team_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(_won()).alias("wins")).where(F.col("matches") >= least)
    return r.withColumn("rate", pct(F.col("wins"), F.col("matches"))).orderBy(F.desc("rate"), F.desc("wins"), "team_id").limit(limit)


def teams_by_score(sides: DataFrame, lost_sets: int, limit: int = 10) -> DataFrame:
    """Wins 3-0 (clean sheets) or 3-2 (tie-breaks)."""
    won = sides.where(F.col("played") & (F.col("sets_for") == 3) & (F.col("sets_against") == lost_sets))
    return won.groupBy("team_id").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "team_id").limit(limit)


def clubs_by_wins(sides: DataFrame, teams: DataFrame, limit: int = 10) -> DataFrame:
    by_team = sides.where("played").groupBy("team_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(_won()).alias("wins"))
    r = by_team.join(teams, "team_id").groupBy("club_id").agg(F.sum("matches").alias("matches"), F.sum("wins").alias("wins"))
    return r.withColumn("rate", pct(F.col("wins"), F.col("matches"))).orderBy(F.desc("wins"), "club_id").limit(limit)


def referees_by_matches(matches: DataFrame, limit: int = 10) -> DataFrame:
    n = matches.where("played").groupBy("referee_id").agg(F.countDistinct("match_id").alias("matches"))
    return n.orderBy(F.desc("matches"), "referee_id").limit(limit)


def as_documents(boards: dict[str, DataFrame]) -> DataFrame:
    """All boards as (board, place, json), one row per line: a report in one frame."""
    out = None
    for name, df in boards.items():
        line = df.select(F.lit(name).alias("board"), F.to_json(F.struct(*df.columns)).alias("line"))
        out = line if out is None else out.unionByName(line)
    return out


def filter_options(matches: DataFrame) -> DataFrame:
    """(option, value): the distinct seasons and competitions of played matches."""
    pairs = F.explode(F.array(F.struct(F.lit("season").alias("option"), F.col("season").cast("string").alias("value")), F.struct(F.lit("competition").alias("option"), F.col("competition").alias("value"))))
    return matches.where("played").select(pairs.alias("p")).select("p.*").where("value is not null").distinct()


def signature(matches: DataFrame) -> DataFrame:
    """Count and latest day of the played matches: a stored result is stale when either changed."""
    return matches.where("played").agg(F.count(F.lit(1)).alias("matches"), F.max("day").alias("latest"))


def content_version(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and version (by groups): the sum of 60-bit digests of all rows, whatever their order; any edit in place moves it.

    Columns count in the order of their names, null apart from the empty text.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(rows.columns)))
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("version"))


class StoredResults:
    """Results kept by key and content version under a shared folder; a result is computed when its version is new.

    A folder counts once Spark has marked it complete, so a run that broke off is repeated.  ``computed`` counts the runs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.computed = spark, folder.rstrip("/"), 0

    def _complete(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def get(self, key: str, inputs: list[DataFrame], compute: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``compute`` over ``inputs``, whose contents are the version; the key names the filter."""
        versions = [content_version(df).first() for df in inputs]
        name = hashlib.sha256(repr((key, [(r["rows"], r["version"]) for r in versions])).encode()).hexdigest()[:32]
        path = f"{self.folder}/{name}"
        if not self._complete(path):
            self.computed += 1
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


#: Boards of a report: id, figure, and whether the smallest comes first.
BOARDS = {
    "c01_players_by_matches": ("player_id", "matches", False), "c02_players_by_wins": ("player_id", "wins", False), "c03_players_by_rate": ("player_id", "rate", False), "c04_match_points_records": ("player_id", "points", False),
    "c05_players_by_defeats": ("player_id", "defeats", False), "c06_captaincies": ("player_id", "times", False), "c07_libero_appearances": ("player_id", "times", False), "c08_most_loyal": ("player_id", "matches", False),
    "c09_top_scorers": ("player_id", "points", False), "c10_top_servers": ("player_id", "serves", False), "c11_win_streaks": ("player_id", "record", False), "c12_current_streaks": ("player_id", "current", False),
    "c13_closest_matches": ("match_id", "gap", True), "c14_highest_sets": ("match_id", "total", False), "c15_widest_sets": ("match_id", "gap", False), "c16_comebacks": ("match_id", "deficit", False),
    "c17_longest_matches": ("match_id", "minutes", False), "c18_most_points_matches": ("match_id", "points", False), "c19_teams_by_rate": ("team_id", "rate", False), "c20_clean_sheets": ("team_id", "times", False),
    "c21_tie_break_wins": ("team_id", "times", False), "c22_clubs_by_wins": ("club_id", "wins", False), "c23_referees_by_matches": ("referee_id", "matches", False),
}


def whole_report(boards: dict[str, DataFrame]) -> DataFrame:
    """All boards in one frame: board, place, id, figure; a board has at most some rows, so places are numbered within it."""
    lines = []
    for name, df in boards.items():
        key, figure, least = BOARDS[name]
        value = F.col(figure).cast("double")
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(value.asc() if least else value.desc(), key)).cast("long")
        lines.append(df.select(F.lit(name).alias("board"), place.alias("place"), F.col(key).cast("long").alias("id"), value.alias("figure")))
    return reduce(DataFrame.unionByName, lines)
