"""Contest views: the domain's tables derived from the supplied star schema, and the same as SQL.

Every view is a plain DataFrame plan over Parquet scans, so filters and column pruning reach the files.
``BASE_SQL`` defines the same views for DuckDB; the two are compared by the correctness gate.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.sources.storage import tasks_for

ROLES = ("passeur", "pointu", "central", "receptionneur", "libero")


class Contest:
    """Matches, sets, players and events of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> int:
        return tasks_for(self.spark, f"{self.sf_dir}/lineitem.parquet")

    def by_match(self, lines: DataFrame) -> DataFrame:
        """Lines with those of a match in one task: what follows by match, side and player needs no shuffle of its own."""
        return lines.repartition(self.tasks, "match_id")

    @cached_property
    def leagues(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("league_id"), F.col("r_name").alias("league"))

    @cached_property
    def clubs(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("club_id"), F.col("n_name").alias("club"), F.col("n_regionkey").cast("long").alias("league_id")
        )

    @cached_property
    def teams(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("team"), F.col("s_nationkey").cast("long").alias("club_id"))

    @cached_property
    def players(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("player"), F.col("p_brand").alias("brand"))

    @cached_property
    def referees(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("referee_id"), F.col("c_name").alias("referee"))

    @cached_property
    def fixtures(self) -> DataFrame:
        """One row per match before its sets are counted."""
        o, key = self.table("orders"), F.col("o_orderkey")
        forfeit = (F.col("o_orderstatus") == "P") & (F.pmod(key, F.lit(10)) == 0)
        kind = F.pmod(F.floor(key / 10), F.lit(3))
        return o.select(
            key.alias("match_id"),
            F.year("o_orderdate").alias("season"),
            F.col("o_orderpriority").alias("competition"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.pmod(F.col("o_custkey"), F.lit(100)).alias("team_a"),
            F.pmod(F.pmod(F.col("o_custkey"), F.lit(100)) + 1 + F.pmod(key, F.lit(99)), F.lit(100)).alias("team_b"),
            F.col("o_custkey").alias("referee_id"),
            F.when(F.pmod(key, F.lit(17)) != 0, F.concat(F.lit("J"), F.month("o_orderdate").cast("string"))).alias("round"),
            forfeit.alias("forfeit"),
            F.when(forfeit & (kind == 0), "a").when(forfeit & (kind == 1), "b").when(forfeit, "both").alias("forfeit_by"),
        )

    @cached_property
    def sets(self) -> DataFrame:
        """match_id, number, score_a, score_b, minutes: lines in order until a side has won three."""
        return self._sets.join(self.fixtures.where("not forfeit").select("match_id"), "match_id", "left_semi")

    @cached_property
    def _sets(self) -> DataFrame:
        """The same of forfeits too."""
        order = Window.partitionBy("match_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        a_won, loser = F.pmod(F.col("l_partkey"), F.lit(2)) == 0, F.pmod(F.col("l_suppkey"), F.lit(24))
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("match_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.col("l_quantity").cast("int").alias("quantity")
        )
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        return (
            self.by_match(lines).withColumn("number", F.row_number().over(order))
            .withColumn("a_before", F.coalesce(F.sum(a_won.cast("int")).over(before), F.lit(0)))
            .withColumn("b_before", F.coalesce(F.sum((~a_won).cast("int")).over(before), F.lit(0)))
            .where("a_before < 3 and b_before < 3")
            .select(
                "match_id",
                "number",
                F.when(a_won, 25).otherwise(loser).cast("int").alias("score_a"),
                F.when(a_won, loser).otherwise(25).cast("int").alias("score_b"),
                (15 + F.pmod("quantity", F.lit(20))).cast("int").alias("minutes"),
            )
        )

    @cached_property
    def matches(self) -> DataFrame:
        """Fixtures with sets and points of both sides; a forfeit counts as played, 3-0, 0-3 or 0-0."""
        counted = self._sets.groupBy("match_id").agg(
            F.count_if(F.col("score_a") > F.col("score_b")).cast("int").alias("sa"),
            F.count_if(F.col("score_b") > F.col("score_a")).cast("int").alias("sb"),
            F.sum("score_a").alias("points_a"),
            F.sum("score_b").alias("points_b"),
            F.sum("minutes").alias("minutes"),
        )
        both = self.fixtures.join(counted, "match_id", "left")
        # a forfeit has no sets
        both = both.withColumns({k: F.when(~F.col("forfeit"), F.col(k)) for k in ("sa", "sb", "points_a", "points_b", "minutes")})
        by = F.col("forfeit_by")
        return (
            both.withColumn("sets_a", F.when(by == "b", 3).when(by.isNotNull(), 0).otherwise(F.coalesce("sa", F.lit(0))).cast("int"))
            .withColumn("sets_b", F.when(by == "a", 3).when(by.isNotNull(), 0).otherwise(F.coalesce("sb", F.lit(0))).cast("int"))
            .withColumn("points_a", F.coalesce("points_a", F.lit(0)))
            .withColumn("points_b", F.coalesce("points_b", F.lit(0)))
            .withColumn("played", F.col("forfeit") | (F.greatest("sets_a", "sets_b") == 3))
            .drop("sa", "sb")
        )

    @cached_property
    def sides(self) -> DataFrame:
        """Two rows per match, one per team: what joins on either team use instead of an OR."""
        return sides_of(self.matches)

    @cached_property
    def appearances(self) -> DataFrame:
        """One row per (match, player) with the player's figures in that match."""
        li = self.by_match(self.table("lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("player_id"), "l_suppkey", "l_quantity", "l_linenumber"))
        each = li.groupBy("match_id", "player_id").agg(
            F.when(F.pmod(F.min("l_suppkey"), F.lit(2)) == 0, "A").otherwise("B").alias("side"),
            F.sum(F.col("l_quantity").cast("long")).alias("points"),
            F.sum(F.col("l_linenumber").cast("long")).alias("serves"),
            F.count(F.lit(1)).alias("runs"),
            F.max("l_linenumber").cast("long").alias("longest_run"),
            F.pmod(F.min("l_suppkey"), F.lit(100)).alias("confidence"),
        )
        w = Window.partitionBy("match_id", "side")
        roles = F.array(*map(F.lit, ROLES))
        ranked = (
            each.withColumn("captain", F.col("player_id") == F.min("player_id").over(w))
            .withColumn("libero", F.col("player_id") == F.max("player_id").over(w))
            .withColumn("role", F.element_at(roles, (F.pmod("player_id", F.lit(5)) + 1).cast("int")))
            .withColumn("shirt", (F.pmod("player_id", F.lit(99)) + 1).cast("long"))
        )
        matches = self.matches.select("match_id", "season", "competition", "day", "played", "team_a", "team_b", "sets_a", "sets_b")
        a = F.col("side") == "A"
        return ranked.join(matches, "match_id").select(
            *ranked.columns,
            "season",
            "competition",
            "day",
            "played",
            F.when(a, F.col("team_a")).otherwise(F.col("team_b")).alias("team_id"),
            F.when(a, F.col("sets_a")).otherwise(F.col("sets_b")).alias("sets_for"),
            F.when(a, F.col("sets_b")).otherwise(F.col("sets_a")).alias("sets_against"),
        )

    @cached_property
    def rallies(self) -> DataFrame:
        """Points, time-outs and substitutions: one "set" per user of ``events``, in time order."""
        e = self.table("events")
        kind = F.col("event_type")
        return e.select(
            F.col("user_id").alias("set_id"),
            "ts",
            "event_id",
            F.when(kind.isin("click", "purchase"), "A").when(kind == "view", "B").alias("scored_by"),
            F.when(kind == "error", "timeout").when(kind == "signup", "substitution").otherwise("point").alias("kind"),
            F.when(F.pmod("event_id", F.lit(2)) == 0, "A").otherwise("B").alias("called_by"),
        )


def divisions_of(matches: DataFrame) -> DataFrame:
    """season, competition, gender, category, level of each division (invented attributes, the documents' spellings)."""
    n = F.col("season") + F.substring("competition", 1, 1).cast("int")
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    return matches.select("season", "competition").distinct().select(
        "season", "competition", of(("MASCULIN", "F", "Mixte", "M", "FEMININ"), n).alias("gender"), of(("SENIOR", "M18", "M15"), n * 2).alias("category"), of(("N2", "N3", "PRENAT", "REGIONAL", "R2", "D1", "DEP", "LOISIR", "autre"), n * 5).alias("level")
    )


def departments_of(clubs: DataFrame) -> DataFrame:
    """The clubs with their department: two digits of the club's number, as text."""
    return clubs.withColumn("department", F.lpad((F.pmod("club_id", F.lit(9)) + 1).cast("string"), 2, "0"))


def sides_of(matches: DataFrame) -> DataFrame:
    """Unpivot of matches to (match, side): one pass, no join."""
    pair = F.array(
        F.struct(F.lit("A").alias("side"), F.col("team_a").alias("team_id"), F.col("team_b").alias("opponent_id"), F.col("sets_a").alias("sets_for"), F.col("sets_b").alias("sets_against"), F.col("points_a").alias("points_for"), F.col("points_b").alias("points_against")),
        F.struct(F.lit("B").alias("side"), F.col("team_b").alias("team_id"), F.col("team_a").alias("opponent_id"), F.col("sets_b").alias("sets_for"), F.col("sets_a").alias("sets_against"), F.col("points_b").alias("points_for"), F.col("points_a").alias("points_against")),
    )
    keep = [c for c in ("match_id", "season", "competition", "day", "round", "forfeit", "forfeit_by", "played") if c in matches.columns]
    return matches.select(*keep, F.explode(pair).alias("s")).select(*keep, "s.*")


#: The same views for DuckDB, as the WITH clause that oracle queries begin with.
BASE_SQL = """
WITH leagues AS (SELECT CAST(r_regionkey AS BIGINT) league_id, r_name league FROM region),
clubs AS (SELECT CAST(n_nationkey AS BIGINT) club_id, n_name club, CAST(n_regionkey AS BIGINT) league_id FROM nation),
teams AS (SELECT s_suppkey team_id, s_name team, CAST(s_nationkey AS BIGINT) club_id FROM supplier),
players AS (SELECT p_partkey player_id, p_name player, p_brand brand FROM part),
referees AS (SELECT c_custkey referee_id, c_name referee FROM customer),
fixtures AS (
  SELECT o_orderkey match_id, CAST(year(o_orderdate) AS INTEGER) season, o_orderpriority competition, CAST(o_orderdate AS DATE) AS day,
    o_custkey % 100 team_a, (o_custkey % 100 + 1 + o_orderkey % 99) % 100 team_b, o_custkey referee_id,
    CASE WHEN o_orderkey % 17 <> 0 THEN 'J' || CAST(month(o_orderdate) AS VARCHAR) END AS round,
    (o_orderstatus = 'P' AND o_orderkey % 10 = 0) forfeit,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN CASE (o_orderkey // 10) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'both' END END forfeit_by
  FROM orders),
lines AS (
  SELECT l_orderkey match_id, l_partkey % 2 = 0 a_won, CAST(l_suppkey % 24 AS INTEGER) loser, 15 + CAST(l_quantity AS INTEGER) % 20 AS minutes,
    row_number() OVER w AS number,
    coalesce(sum(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) a_before,
    coalesce(sum(CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b_before
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)),
sets AS (
  SELECT match_id, number, CASE WHEN a_won THEN 25 ELSE loser END score_a, CASE WHEN a_won THEN loser ELSE 25 END score_b, minutes
  FROM lines JOIN (SELECT match_id FROM fixtures WHERE NOT forfeit) USING (match_id) WHERE a_before < 3 AND b_before < 3),
counted AS (
  SELECT match_id, sum(CASE WHEN score_a > score_b THEN 1 ELSE 0 END) sa, sum(CASE WHEN score_b > score_a THEN 1 ELSE 0 END) sb,
    sum(score_a) pa, sum(score_b) pb, sum(minutes) AS minutes FROM sets GROUP BY match_id),
matches0 AS (
  SELECT f.*, CAST(CASE WHEN forfeit_by = 'b' THEN 3 WHEN forfeit_by IS NOT NULL THEN 0 ELSE coalesce(sa, 0) END AS INTEGER) sets_a,
    CAST(CASE WHEN forfeit_by = 'a' THEN 3 WHEN forfeit_by IS NOT NULL THEN 0 ELSE coalesce(sb, 0) END AS INTEGER) sets_b,
    CAST(coalesce(pa, 0) AS BIGINT) points_a, CAST(coalesce(pb, 0) AS BIGINT) points_b, CAST(minutes AS BIGINT) AS minutes
  FROM fixtures f LEFT JOIN counted USING (match_id)),
matches AS (SELECT *, forfeit OR greatest(sets_a, sets_b) = 3 AS played FROM matches0),
sides AS (
  SELECT match_id, season, competition, day, round, forfeit, forfeit_by, played, 'A' side, team_a team_id, team_b opponent_id,
    sets_a sets_for, sets_b sets_against, points_a points_for, points_b points_against FROM matches
  UNION ALL
  SELECT match_id, season, competition, day, round, forfeit, forfeit_by, played, 'B', team_b, team_a, sets_b, sets_a, points_b, points_a FROM matches),
each_player AS (
  SELECT l_orderkey match_id, l_partkey player_id, CASE WHEN min(l_suppkey) % 2 = 0 THEN 'A' ELSE 'B' END side,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) points, CAST(sum(l_linenumber) AS BIGINT) serves, count(*) runs,
    CAST(max(l_linenumber) AS BIGINT) longest_run, min(l_suppkey) % 100 confidence
  FROM lineitem GROUP BY l_orderkey, l_partkey),
appearances AS (
  SELECT e.*, player_id = min(player_id) OVER (PARTITION BY match_id, side) captain, player_id = max(player_id) OVER (PARTITION BY match_id, side) libero,
    ['passeur', 'pointu', 'central', 'receptionneur', 'libero'][player_id % 5 + 1] AS role, player_id % 99 + 1 shirt,
    season, competition, day, played, CASE WHEN side = 'A' THEN team_a ELSE team_b END team_id,
    CASE WHEN side = 'A' THEN sets_a ELSE sets_b END sets_for, CASE WHEN side = 'A' THEN sets_b ELSE sets_a END sets_against
  FROM each_player e JOIN matches USING (match_id)),
rallies AS (
  SELECT user_id set_id, ts, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'A' WHEN event_type = 'view' THEN 'B' END scored_by,
    CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'signup' THEN 'substitution' ELSE 'point' END kind,
    CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END called_by FROM events)
"""
