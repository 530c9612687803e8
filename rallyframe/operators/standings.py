"""League standings: award of points, ranking, evolution by match-day, form, cross table.

Input rows are (match, side) as in ``Contest.sides``.  Ties are ranked by first appearance (first
match id, then side), which is what a stable sort of the matches' teams gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.sources.views import sides_of

KEY = ["season", "competition"]
COUNTERS = ("points", "matches", "wins", "defeats", "w30", "w31", "w32", "d23", "d13", "d03", "forfeits", "sets_for", "sets_against", "points_for", "points_against")


def counts_as_played() -> Column:
    return F.col("played") & ((F.col("sets_for") > 0) | (F.col("sets_against") > 0) | F.col("forfeit"))


def awards(sides: DataFrame, keep: tuple[str, ...] = ("season", "competition", "day", "round")) -> DataFrame:
    """Each (match, side) row with what it adds to its team's line, and the columns of ``keep``."""
    by, side = F.col("forfeit_by"), F.lower("side")
    mine = F.coalesce((by == "both") | (by == side), F.lit(False))
    gift = F.coalesce(by.isNotNull() & ~mine, F.lit(False))
    sf, sa = F.col("sets_for"), F.col("sets_against")
    won = gift | (by.isNull() & (sf > sa))
    lost = mine | (by.isNull() & (sf < sa))
    normal = by.isNull()
    points = (
        F.when(mine, -1)
        .when(gift, 3)
        .when(won & (sf == 3) & (sa == 2), 2)
        .when(won, 3)
        .when(lost & (sa == 3) & (sf == 2), 1)
        .otherwise(0)
    )
    count = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    given = F.when(F.col("points_for") > 0, F.col("points_for")).when(gift, 75).otherwise(0)
    taken = F.when(F.col("points_against") > 0, F.col("points_against")).when(mine, 75).otherwise(0)
    return sides.where(counts_as_played()).select(
        "match_id", "side", "team_id", *keep,
        points.alias("points"),
        F.lit(1).alias("matches"),
        count(won).alias("wins"),
        count(lost).alias("defeats"),
        count(gift | (normal & (sf == 3) & (sa == 0))).alias("w30"),
        count(normal & (sf == 3) & (sa == 1)).alias("w31"),
        count(normal & (sf == 3) & (sa == 2)).alias("w32"),
        count(normal & (sa == 3) & (sf == 2)).alias("d23"),
        count(normal & (sa == 3) & (sf == 1)).alias("d13"),
        count(mine | (normal & (sa == 3) & (sf == 0))).alias("d03"),
        count(mine).alias("forfeits"),
        F.when(gift, 3).when(mine, 0).otherwise(sf).alias("sets_for"),
        F.when(mine, 3).when(gift, 0).otherwise(sa).alias("sets_against"),
        F.when(normal, F.col("points_for")).otherwise(given).alias("points_for"),
        F.when(normal, F.col("points_against")).otherwise(taken).alias("points_against"),
        F.when(won, "V").when(lost, "D").alias("result"),
    )


def ratio(won: Column, lost: Column) -> Column:
    """Won by lost, without end if none was lost, 0 if nothing was won either."""
    return F.when(lost > 0, won.cast("double") / lost).when(won > 0, F.lit(float("inf"))).otherwise(F.lit(0.0).cast("double"))


def ranked(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank`` within the keys."""
    w = Window.partitionBy(*keys).orderBy(
        F.desc("points"), ratio(F.col("sets_for"), F.col("sets_against")).desc(), ratio(F.col("points_for"), F.col("points_against")).desc(), "first_match", "first_side"
    )
    return lines.withColumn("rank", F.row_number().over(w).cast("long"))


def standings(sides: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One line per team and group of ``keys``, with its rank."""
    keys = keys or KEY
    first = F.min(F.struct("match_id", "side")).alias("first")
    lines = awards(sides, tuple(keys)).groupBy(*keys, "team_id").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTERS), first)
    lines = lines.withColumn("first_match", F.col("first.match_id")).withColumn("first_side", F.col("first.side"))
    return ranked(lines, keys).select(*keys, "team_id", *COUNTERS, "rank")


def round_key(round_: Column, day: Column) -> Column:
    """The match-day's name: its round, else its date, else "Inconnue"."""
    return F.coalesce(F.when(round_ != "", round_), day.cast("string"), F.lit("Inconnue"))


def round_order(name: Column) -> Column:
    """Sort key: named by a number first, by the first number found (a date sorts by its year), then by name."""
    number = F.regexp_extract(name, r"(\d+)", 1).try_cast("long")
    return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), name.alias("name"))


def evolution(sides: DataFrame) -> DataFrame:
    """Standings after each match-day, cumulatively: one aggregate per (team, day), then running sums over the grid of days."""
    rows = awards(sides).withColumn("name", round_key(F.col("round"), F.col("day")))
    each = rows.groupBy(*KEY, "name", "team_id").agg(
        *(F.sum(c).cast("long").alias(c) for c in COUNTERS), F.min(F.struct("match_id", "side")).alias("first")
    )
    days = rows.groupBy(*KEY, "name").agg(F.max("day").alias("day"))
    days = days.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(round_order(F.col("name")))).cast("long"))
    begun = each.join(days, [*KEY, "name"]).groupBy(*KEY, "team_id").agg(F.min("place").alias("begin"))
    # each team from its first day on: the grid holds (teams x days) of one competition
    grid = begun.join(days, KEY).where("place >= begin").drop("begin")
    filled = grid.join(each, [*KEY, "name", "team_id"], "left")
    w = Window.partitionBy(*KEY, "team_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = filled.select(
        *KEY, "name", "day", "place", "team_id", *(F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(c) for c in COUNTERS), F.first("first", ignorenulls=True).over(w).alias("first")
    )
    summed = summed.withColumn("first_match", F.col("first.match_id")).withColumn("first_side", F.col("first.side"))
    return ranked(summed, [*KEY, "place"]).select(*KEY, "place", "name", "day", "team_id", "points", "matches", "sets_for", "sets_against", "rank")


def form(sides: DataFrame, last: int = 5) -> DataFrame:
    """Each team's last results, oldest first, as a string of V and D, and its number of results."""
    w = Window.partitionBy(*KEY, "team_id").orderBy(F.desc("day"), F.desc("match_id"))
    rows = awards(sides).where("result is not null").withColumn("n", F.row_number().over(w))
    results = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("n") <= last, F.struct("n", "result"))))), lambda x: x["result"]), "")
    return rows.groupBy(*KEY, "team_id").agg(F.count(F.lit(1)).alias("results"), results.alias("form"))


def cross_table(matches: DataFrame) -> DataFrame:
    """(host, guest) cells: the played match if there are several, else the latest."""
    w = Window.partitionBy(*KEY, "team_a", "team_b").orderBy(F.desc("played"), F.desc("day"), F.desc("match_id"))
    cell = matches.withColumn("n", F.row_number().over(w)).where("n = 1")
    status = F.when(F.col("forfeit"), "forfeit").when(F.col("played"), "played").otherwise("no result")
    return cell.select(*KEY, F.col("team_a").alias("host"), F.col("team_b").alias("guest"), "match_id", status.alias("status"), F.when(F.col("played"), F.concat_ws("-", "sets_a", "sets_b")).alias("score"))


def cell_points(matches: DataFrame) -> DataFrame:
    """The cells of the cross table with what they gave to host and guest, by the awards of the standings, and a badge.

    A forfeit takes a point from who forfeits and gives the other three; a double one takes a point from both.  Badges:
    2F and F for forfeits, else the score's kind (3-0, 3-1, 3-2 as ``large``, ``clear``, ``close``).  No points without a result.
    """
    cells = cross_table(matches)
    given = awards(sides_of(matches), keep=()).groupBy("match_id").agg(*(F.max(F.when(F.col("side") == k, F.col("points"))).cast("long").alias(name) for k, name in (("A", "host_points"), ("B", "guest_points"))))
    by = matches.select("match_id", "forfeit_by", F.abs(F.col("sets_a") - F.col("sets_b")).alias("_apart"))
    kind = F.when(F.col("_apart") == 3, "large").when(F.col("_apart") == 2, "clear").when(F.col("_apart") == 1, "close")
    badge = F.when(F.col("forfeit_by") == "both", "2F").when(F.col("status") == "forfeit", "F").when(F.col("status") == "played", kind)
    return cells.join(given, "match_id", "left").join(by, "match_id").select(*cells.columns, "host_points", "guest_points", badge.alias("badge"))


def score_distribution(matches: DataFrame) -> DataFrame:
    """Per competition and season: how often each score, and the share of home wins."""
    m = matches.where("played").withColumn("score", F.concat_ws("-", "sets_a", "sets_b"))
    n = m.groupBy(*KEY, "score").agg(F.count(F.lit(1)).alias("times"), F.count_if(F.col("sets_a") > F.col("sets_b")).alias("home"))
    total = m.groupBy(*KEY).agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("sets_a") > F.col("sets_b")).alias("home_wins"))
    share = F.round(100 * F.col("home_wins").cast("double") / F.col("matches"), 1)
    return n.drop("home").join(total, KEY).select(*KEY, "score", "times", share.alias("home_win_pct"))


def bracket(lines: DataFrame) -> DataFrame:
    """Quarter-finals of each group's first eight: seeds 1-8, 4-5, 3-6, 2-7, with the slot that each winner goes to."""
    top = lines.where("rank <= 8").select(*KEY, "rank", "team_id")
    pair = F.when(F.col("rank") > 4, 9 - F.col("rank")).otherwise(F.col("rank"))
    slot = F.element_at(F.create_map(*(F.lit(x) for kv in ((1, 1), (4, 2), (3, 3), (2, 4)) for x in kv)), pair.cast("int"))
    each = top.withColumn("quarter", slot)
    joined = each.groupBy(*KEY, "quarter").agg(F.min_by("team_id", "rank").alias("high_seed"), F.max_by("team_id", "rank").alias("low_seed"), F.count(F.lit(1)).alias("n"))
    return joined.where("n = 2").select(*KEY, F.col("quarter").cast("long").alias("quarter"), "high_seed", "low_seed", F.ceil(F.col("quarter") / 2).cast("long").alias("semi"))
