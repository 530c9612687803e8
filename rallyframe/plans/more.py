"""Queries over relational primitives, profiles, roles, quality rules, names, places and windows."""

from pyspark.sql import functions as F

from rallyframe.functions import geo
from rallyframe.functions import names as nm
from rallyframe.functions import scalars as sc
from rallyframe.operators import profiles as pf
from rallyframe.operators import quality as qu
from rallyframe.operators import relational as rl
from rallyframe.operators import roles as ro
from rallyframe.operators import rollups as ru
from rallyframe.plans.registry import ORACLES, query
from rallyframe.plans.tables import _TEAMS
from rallyframe.sources.storage import stored
from rallyframe.streaming import incremental as inc

# ---------------------------------------------------------------- relational primitives
query(
    "a1_page",
    lambda c: rl.page(c.players, [F.col("player_id")], 3, 50),
    "SELECT * FROM players ORDER BY player_id LIMIT 50 OFFSET 100",
)
query("a4_search", lambda c: rl.search(c.players, "RING", "player", "brand"), "SELECT * FROM players WHERE concat_ws(' ', player, brand) ILIKE '%ring%'")
query(
    "a7_self_join_names",
    lambda c: c.matches.where("forfeit").join(c.teams.select(F.col("team_id").alias("team_a"), F.col("team").alias("name_a")), "team_a", "left").join(c.teams.select(F.col("team_id").alias("team_b"), F.col("team").alias("name_b")), "team_b", "left").select("match_id", "name_a", "name_b"),
    "SELECT match_id, a.team name_a, b.team name_b FROM matches LEFT JOIN teams a ON a.team_id = team_a LEFT JOIN teams b ON b.team_id = team_b WHERE forfeit",
)
query(
    "a8_join_on_either_side",
    lambda c: rl.on_either(c.matches.where("played").select("match_id", "team_a", "team_b"), (("A", F.col("team_a")), ("B", F.col("team_b"))), c.teams.where("club_id = 3"), "team_id").select("match_id", "via", "team_id", "team"),
    "SELECT match_id, CASE WHEN team_a = team_id THEN 'A' ELSE 'B' END via, team_id, team FROM matches JOIN teams ON team_id = team_a OR team_id = team_b WHERE played AND club_id = 3",
)
query(
    "a9_semi_join",
    lambda c: c.sides.where("played").join(c.teams.where("club_id < 5"), "team_id", "left_semi").select("match_id").distinct(),
    "SELECT match_id FROM matches WHERE played AND (team_a IN (SELECT team_id FROM teams WHERE club_id < 5) OR team_b IN (SELECT team_id FROM teams WHERE club_id < 5))",
)
query(
    "a10_set_operations",
    lambda c: _season(c, 1996).intersect(_season(c, 1997)).withColumn("set", F.lit("both")).unionByName(_season(c, 1996).exceptAll(_season(c, 1997)).withColumn("set", F.lit("first only"))),
    """, p AS (SELECT DISTINCT player_id FROM appearances WHERE season = 1996 AND played), q AS (SELECT DISTINCT player_id FROM appearances WHERE season = 1997 AND played)
SELECT player_id, 'both' AS "set" FROM (SELECT * FROM p INTERSECT SELECT * FROM q) UNION ALL SELECT player_id, 'first only' FROM (SELECT * FROM p EXCEPT SELECT * FROM q)""",
)


def _season(c, year):
    return c.appearances.where((F.col("season") == year) & F.col("played")).select("player_id").distinct()


query(
    "a16_nulls_last",
    lambda c: c.matches.orderBy(F.col("round").desc_nulls_last(), F.col("forfeit_by").asc_nulls_last(), "match_id").limit(40).select("match_id", "round", "forfeit_by"),
    "SELECT match_id, round, forfeit_by FROM matches ORDER BY round DESC NULLS LAST, forfeit_by ASC NULLS LAST, match_id LIMIT 40",
)
query(
    "a18_count_over_subquery",
    lambda c: c.sides.where("played").groupBy("team_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").agg(F.count(F.lit(1)).alias("teams")),
    "SELECT count(*) teams FROM (SELECT team_id FROM sides WHERE played GROUP BY 1 HAVING count(*) >= 20)",
)
query(
    "a21_upsert",
    lambda c: rl.upsert(
        c.matches.select("match_id", "sets_a", F.lit(1).alias("version")),
        c.matches.where("match_id % 3 = 0").select("match_id", (F.col("sets_a") + 10).alias("sets_a"), F.lit(2).alias("version")).unionByName(c.matches.where("match_id % 5 = 0").select((-F.col("match_id") - 1).alias("match_id"), "sets_a", F.lit(3).alias("version"))),
        ["match_id"],
        "version",
    ),
    """SELECT match_id, CASE WHEN match_id % 3 = 0 THEN sets_a + 10 ELSE sets_a END sets_a, CASE WHEN match_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM matches
UNION ALL SELECT -match_id - 1, sets_a, 3 FROM matches WHERE match_id % 5 = 0""",
)
query(
    "a22_replace_for_key",
    lambda c: rl.replace_for_keys(c.appearances.select("match_id", "player_id", "points"), c.appearances.where("match_id % 4 = 0").select("match_id", "player_id", (F.col("points") * 2).alias("points")).where("points > 50"), ["match_id"]),
    """, nw AS (SELECT match_id, player_id, points * 2 points FROM appearances WHERE match_id % 4 = 0 AND points * 2 > 50)
SELECT match_id, player_id, points FROM appearances WHERE match_id NOT IN (SELECT match_id FROM nw) UNION ALL SELECT * FROM nw""",
)
query(
    "a26_insert_new_only",
    lambda c: rl.new_only(c.appearances.select("player_id", "match_id"), c.appearances.where("season < 1998").select("player_id").where("player_id % 2 = 0"), ["player_id"], ["match_id"]),
    "SELECT player_id, min(match_id) match_id FROM appearances WHERE player_id NOT IN (SELECT player_id FROM appearances WHERE season < 1998 AND player_id % 2 = 0) GROUP BY 1",
)
query(
    "a27_exists",
    lambda c: c.teams.join(c.sides.where("forfeit").select("team_id", F.lit(True).alias("forfeits")).distinct(), "team_id", "left").select("team_id", F.coalesce("forfeits", F.lit(False)).alias("has_forfeit")),
    "SELECT team_id, EXISTS (SELECT 1 FROM sides WHERE sides.team_id = teams.team_id AND forfeit) has_forfeit FROM teams",
)
query("a25_row_counts", lambda c: rl.row_counts({k: c.table(k) for k in ("nation", "orders", "lineitem")}), "SELECT 'nation' AS \"table\", count(*) AS \"rows\" FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")


def _sql(c):
    c.matches.createOrReplaceTempView("contest_matches")
    return rl.read_only_sql(c.spark, "WITH m AS (SELECT season, sets_a FROM contest_matches WHERE played) SELECT season, count(*) matches, sum(sets_a) sets_a FROM m GROUP BY season")


query("a23_read_only_sql", _sql, "SELECT season, count(*) matches, CAST(sum(sets_a) AS BIGINT) sets_a FROM matches WHERE played GROUP BY season")

# ---------------------------------------------------------------- profiles
query(
    "j1_player_stats",
    lambda c: pf.player_stats(c.appearances),
    """, t AS (SELECT player_id, count(DISTINCT match_id) matches, count(DISTINCT team_id) teams, count(DISTINCT season) seasons, count(*) FILTER (captain) captaincies, count(*) FILTER (libero) liberos,
  count(*) FILTER (sets_for > sets_against) wins, count(*) FILTER (sets_for < sets_against) defeats FROM appearances WHERE played GROUP BY 1)
SELECT *, round(CAST(100 AS DOUBLE) * wins / matches, 1) rate FROM t""",
)
query("j2_shirts", lambda c: pf.shirts(c.appearances), "SELECT player_id, shirt, count(*) times FROM appearances WHERE played GROUP BY 1, 2")
query(
    "j3_oldest_possible",
    lambda c: pf.oldest_possible(c.appearances, {"1-URGENT": 15, "2-HIGH": 18, "3-MEDIUM": 21}),
    """SELECT player_id, max(season + 1 - CASE competition WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 18 ELSE 21 END) born_from FROM appearances
WHERE played AND competition IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""",
)
query(
    "j4_roster",
    lambda c: pf.roster(c.appearances),
    "SELECT team_id, season, player_id, count(*) matches, count(*) FILTER (captain) captaincies, count(*) FILTER (libero) liberos, max(CAST(shirt AS VARCHAR)) shirt FROM appearances WHERE played GROUP BY 1, 2, 3",
)
query(
    "j5_referee_stats",
    lambda c: pf.referee_stats(c.matches),
    "SELECT referee_id, count(DISTINCT match_id) matches, count(DISTINCT season) seasons, count(DISTINCT competition) competitions, min(day) first_day, max(day) last_day FROM matches WHERE played GROUP BY 1",
)
query(
    "j7_matches_by_month",
    lambda c: pf.matches_by_month(c.matches),
    "SELECT CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, count(*) matches, count(*) FILTER (played) played FROM matches GROUP BY 1, 2",
)
query(
    "j8_team_mates",
    lambda c: pf.team_mates(c.appearances),
    "SELECT m.player_id asked, a.player_id, count(*) matches FROM appearances a JOIN appearances m ON a.match_id = m.match_id AND a.side = m.side AND a.player_id <> m.player_id WHERE a.played GROUP BY 1, 2",
)
query(
    "j8_opponents",
    lambda c: pf.opponents(c.appearances, c.sides),
    "SELECT player_id, opponent_id, count(*) matches, count(*) FILTER (s.sets_for > s.sets_against) wins FROM appearances a JOIN sides s ON a.match_id = s.match_id AND a.side = s.side WHERE a.played GROUP BY 1, 2",
)
query(
    "j9_team_form",
    lambda c: pf.team_form(c.sides),
    """, n AS (SELECT *, sets_for > sets_against won, row_number() OVER (PARTITION BY team_id ORDER BY day DESC, match_id DESC) AS n FROM sides WHERE played)
SELECT team_id, count(*) matches, count(*) FILTER (won) wins, count(*) FILTER (won AND side = 'A') home_wins, count(*) FILTER (won AND side = 'B') away_wins,
  string_agg(CASE WHEN won THEN 'V' ELSE 'D' END, '' ORDER BY n) FILTER (n <= 5) AS last FROM n GROUP BY 1""",
)
query(
    "j10_club_report",
    lambda c: pf.club_report(c.sides, c.appearances, c.teams),
    """, m AS (SELECT club_id, season, count(DISTINCT team_id) teams, count(*) matches, count(*) FILTER (sets_for > sets_against) wins FROM sides JOIN teams USING (team_id) WHERE played GROUP BY 1, 2),
p AS (SELECT club_id, season, count(DISTINCT player_id) players FROM appearances JOIN teams USING (team_id) WHERE played GROUP BY 1, 2)
SELECT m.*, coalesce(players, 0) players FROM m LEFT JOIN p USING (club_id, season)""",
)
query(
    "j10_competition_report",
    lambda c: pf.competition_report(c.matches),
    """, t AS (SELECT season, competition, count(*) matches, count(*) FILTER (played) played, count(*) FILTER (forfeit) forfeits, CAST(sum(CASE WHEN played THEN sets_a + sets_b END) AS BIGINT) sets,
  CAST(sum(CASE WHEN played THEN points_a + points_b END) AS BIGINT) points, count(*) FILTER (played AND sets_a + sets_b = 5) five_sets FROM matches GROUP BY 1, 2)
SELECT *, CASE WHEN coalesce(sets, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(points AS DOUBLE) / sets, 2) END points_per_set FROM t""",
)
query(
    "j11_club_levels",
    lambda c: pf.club_levels(c.sides, c.teams),
    """, t AS (SELECT club_id, season, avg(6 - CAST(substr(competition, 1, 1) AS INTEGER)) ml, max(6 - CAST(substr(competition, 1, 1) AS INTEGER)) best_level FROM sides JOIN teams USING (team_id) WHERE played GROUP BY 1, 2),
u AS (SELECT *, round(ml, 3) - lag(round(ml, 3)) OVER w ch, season - lag(season) OVER w gap FROM t WINDOW w AS (PARTITION BY club_id ORDER BY season))
SELECT club_id, season, best_level, round(ml, 3) mean_level, round(ch, 3) AS change, CASE WHEN ch IS NULL THEN 'new' WHEN gap > 1 THEN 'back' WHEN ch >= 0.05 THEN 'up' WHEN ch <= -0.05 THEN 'down' ELSE 'same' END AS move FROM u""",
)
query(
    "j13_global_search",
    lambda c: pf.global_search("Ring", player=(c.players, "player_id", "player"), club=(c.clubs, "club_id", "club"), league=(c.leagues, "league_id", "league")),
    "SELECT 'player' entity, player_id id, player AS name FROM players WHERE player ILIKE '%ring%' UNION ALL SELECT 'club', club_id, club FROM clubs WHERE club ILIKE '%ring%' UNION ALL SELECT 'league', league_id, league FROM leagues WHERE league ILIKE '%ring%'",
)
query(
    "j14_dashboard",
    lambda c: pf.dashboard({"matches": c.matches, "players": c.players, "teams": c.teams}),
    "SELECT 'matches' entity, count(*) AS \"rows\" FROM matches UNION ALL SELECT 'players', count(*) FROM players UNION ALL SELECT 'teams', count(*) FROM teams",
)
query(
    "j15_best_past_level",
    lambda c: pf.best_past_level(c.appearances),
    """, l AS (SELECT player_id, match_id, 6 - CAST(substr(competition, 1, 1) AS BIGINT) AS level, max(6 - CAST(substr(competition, 1, 1) AS BIGINT)) OVER (PARTITION BY player_id ORDER BY day, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best FROM appearances WHERE played)
SELECT * FROM l WHERE best > level""",
)
query(
    "j16_side_summary",
    lambda c: pf.player_summary_of_sides(c.appearances),
    "SELECT match_id, side, count(*) players, CAST(sum(points) AS BIGINT) points, CAST(sum(serves) AS BIGINT) serves, max(longest_run) longest_run FROM appearances GROUP BY 1, 2",
)
query(
    "j20_season_counts",
    lambda c: pf.season_counts(c.matches),
    "SELECT season, count(*) matches, count(DISTINCT competition) competitions, count(*) FILTER (played) played, count(*) FILTER (forfeit) forfeits FROM matches GROUP BY 1",
)

# ---------------------------------------------------------------- roles
_FORMATIONS = """,
fo AS (SELECT l_orderkey match_id, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END side, CAST(l_linenumber AS BIGINT) set_number, l_partkey % 6 + 1 AS "position", l_partkey player_id,
  l_partkey % 11 = 0 libero, CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END swaps FROM lineitem),
sc0 AS (SELECT match_id, side, player_id, 'libero' AS role, CAST(40 AS DOUBLE) score FROM fo WHERE libero
  UNION ALL SELECT match_id, side, player_id, 'central', swaps * CAST(5.5 AS DOUBLE) FROM fo WHERE NOT libero AND swaps > 0
  UNION ALL SELECT match_id, side, player_id, 'passeur', CAST(1.8 AS DOUBLE) FROM fo WHERE NOT libero AND "position" = 1
  UNION ALL SELECT match_id, side, player_id, 'pointu', CAST(1.8 AS DOUBLE) FROM fo WHERE NOT libero AND "position" = 4
  UNION ALL SELECT match_id, side, player_id, 'receptionneur', CAST(1 AS DOUBLE) FROM fo WHERE NOT libero),
ev AS (SELECT match_id, side, player_id, role, sum(score) score FROM sc0 GROUP BY 1, 2, 3, 4)
"""


def _formations(c):
    """Starters for the role operators: a line of an order is a starter of a set."""
    k = F.col("l_partkey")
    lines = c.by_match(c.table("lineitem").select(F.col("l_orderkey").alias("match_id"), "l_suppkey", "l_linenumber", "l_partkey", "l_quantity"))
    return lines.select(
        "match_id",
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "A").otherwise("B").alias("side"),
        F.col("l_linenumber").cast("long").alias("set_number"),
        (F.pmod(k, F.lit(6)) + 1).alias("position"),
        k.alias("player_id"),
        (F.pmod(k, F.lit(11)) == 0).alias("libero"),
        F.when(F.col("l_quantity") > 40, 1).otherwise(0).alias("swaps"),
    )


query("h1_role_evidence", lambda c: ro.evidence(_formations(c)), _FORMATIONS + "SELECT * FROM ev")
query(
    "h1_opposite_pairs",
    lambda c: ro.opposite_pairs(_formations(c)),
    _FORMATIONS
    + """SELECT a.match_id, a.side, least(a.player_id, b.player_id) player_1, greatest(a.player_id, b.player_id) player_2, count(*) sets FROM fo a JOIN fo b ON a.match_id = b.match_id AND a.side = b.side AND a.set_number = b.set_number
AND a."position" + 3 = b."position" GROUP BY 1, 2, 3, 4""",
)
_SOLVED = (
    _FORMATIONS
    + """,
sh AS (SELECT *, sum(score) OVER (PARTITION BY match_id, side, player_id) total, greatest(CAST(0.01 AS DOUBLE), round(score / sum(score) OVER (PARTITION BY match_id, side, player_id), 6)) AS share FROM ev),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, side, player_id ORDER BY share DESC, role) AS n FROM sh),
tw AS (SELECT match_id, side, player_id, max(role) FILTER (n = 1) AS role, max(share) FILTER (n = 1) AS share, coalesce(max(share) FILTER (n = 2), 0) AS second, max(total) total FROM rk GROUP BY 1, 2, 3),
be AS (SELECT match_id, side, player_id, role, round(share, 4) AS share, round(CAST(0.35 AS DOUBLE) * share + CAST(0.30 AS DOUBLE) * (share - second) + CAST(0.35 AS DOUBLE) * least(CAST(1 AS DOUBLE), total / 10), 3) confidence FROM tw)
"""
)
query("h2_role_beliefs", lambda c: ro.beliefs(_formations(c)), _SOLVED + "SELECT * FROM be")
query(
    "h5_role_priors",
    lambda c: ro.priors(ro.beliefs(_formations(c))),
    _SOLVED
    + """, w AS (SELECT player_id, role, sum(CAST(round(greatest(CAST(0.5 AS DOUBLE), confidence) * 1000) AS BIGINT)) w FROM be GROUP BY 1, 2)
SELECT player_id, role, round(CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY player_id), 4) AS share FROM w""",
)


def _diffused(c):
    return ro.diffuse(ro.evidence(_formations(c)), 3, lambda df: stored(df, "beliefs"), c.tasks)[0]


def _pass(n: int) -> str:
    """One pass of the diffusion: beliefs ``be{n}`` from the evidence and the players' priors by ``be{n - 1}``."""
    return f""",
w{n} AS MATERIALIZED (SELECT player_id, role, sum(CAST(round(greatest(CAST(0.5 AS DOUBLE), confidence) * 1000) AS BIGINT)) w FROM be{n - 1} GROUP BY 1, 2),
pr{n} AS MATERIALIZED (SELECT player_id, role, round(CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY player_id), 4) AS share FROM w{n}),
al{n} AS (SELECT match_id, side, player_id, role, score FROM ev UNION ALL SELECT match_id, side, player_id, role, share * CAST(2.4 AS DOUBLE) FROM (SELECT DISTINCT match_id, side, player_id FROM ev) JOIN pr{n} USING (player_id)),
ev{n} AS (SELECT match_id, side, player_id, role, sum(score) score FROM al{n} GROUP BY 1, 2, 3, 4),
sh{n} AS (SELECT *, sum(score) OVER (PARTITION BY match_id, side, player_id) total, greatest(CAST(0.01 AS DOUBLE), round(score / sum(score) OVER (PARTITION BY match_id, side, player_id), 6)) AS share FROM ev{n}),
rk{n} AS (SELECT *, row_number() OVER (PARTITION BY match_id, side, player_id ORDER BY share DESC, role) AS n FROM sh{n}),
tw{n} AS (SELECT match_id, side, player_id, max(role) FILTER (n = 1) AS role, max(share) FILTER (n = 1) AS share, coalesce(max(share) FILTER (n = 2), 0) AS second, max(total) total FROM rk{n} GROUP BY 1, 2, 3),
be{n} AS MATERIALIZED (SELECT match_id, side, player_id, role, round(share, 4) AS share, round(CAST(0.35 AS DOUBLE) * share + CAST(0.30 AS DOUBLE) * (share - second) + CAST(0.35 AS DOUBLE) * least(CAST(1 AS DOUBLE), total / 10), 3) confidence FROM tw{n}),
ch{n} AS MATERIALIZED (SELECT count(*) AS n FROM be{n} a JOIN be{n - 1} b USING (match_id, side, player_id) WHERE a.role <> b.role)
"""


query(
    "h4_role_diffusion",
    _diffused,
    _SOLVED
    + ", be0 AS MATERIALIZED (SELECT * FROM be)"
    + "".join(map(_pass, (1, 2, 3)))
    + """, held AS MATERIALIZED (SELECT CASE WHEN ch1.n = 0 THEN 0 WHEN ch2.n = 0 THEN 1 WHEN ch3.n = 0 THEN 2 ELSE 3 END AS k FROM ch1, ch2, ch3)
"""
    + " UNION ALL ".join(f"SELECT be{k}.* FROM be{k}, held WHERE k = {k}" for k in range(4)),
)
query(
    "h6_role_metrics",
    lambda c: ro.role_metrics(ro.beliefs(_formations(c))).drop("mean_confidence"),
    _SOLVED + "SELECT role, count(*) beliefs, count(*) FILTER (confidence >= 0.75) certain, count(*) FILTER (confidence >= 0.5 AND confidence < 0.75) likely, count(*) FILTER (confidence < 0.5) weak FROM be GROUP BY 1",
)
query(
    "h8_plausible_roles",
    lambda c: ro.plausible_roles(c.appearances),
    """, n AS (SELECT team_id, player_id, role, count(*) AS n FROM appearances WHERE played GROUP BY 1, 2, 3),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY team_id, player_id) AS share, max(n) OVER (PARTITION BY team_id, player_id) / sum(n) OVER (PARTITION BY team_id, player_id) top FROM n)
SELECT team_id, player_id, role, round(share, 3) AS share FROM s WHERE share >= 0.30 OR share >= greatest(0.18, 0.62 * top)""",
)

# ---------------------------------------------------------------- quality rules
_SETS = "[{'a': 25, 'b': 18}, {'a': 20, 'b': 25}, {'a': 25, 'b': 11}, {'a': 25, 'b': 13}]"


def _imported(c):
    """Imported rows with faults that depend on the order's key."""
    k = F.col("o_orderkey")
    m = lambda n: F.pmod(k, F.lit(n))
    sets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((25, 18), (20, 25), (25, 11), (25, 13))))
    return c.table("orders").select(
        k.alias("match_id"),
        F.lit("1998-1999").alias("season"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(m(5) == 0, "9:5").when(m(5) == 1, "25:00").when(m(5) == 2, "20:30").when(m(5) == 3, "soir").alias("hour"),
        F.when(m(3) == 0, " 0692345").when(m(3) == 1, "12A").otherwise("0381234").alias("club_code"),
        F.when(m(4) == 0, "3/1").when(m(4) == 1, "4/0").when(m(4) == 2, "0/0").alias("score"),
        F.when(m(2) == 0, sets).otherwise(F.filter(sets, lambda s: F.lit(False))).alias("sets"),
        F.lit(False).alias("forfeit"),
        F.lit(None).cast("string").alias("winner"),
        F.lit("X").alias("team_a"),
        F.lit("Y").alias("team_b"),
        (m(7) == 0).alias("played"),
        F.when(m(6) == 0, "1h25").when(m(6) == 1, "5 min").alias("duration"),
        F.array(F.lit(25), F.lit(20), F.lit(22), F.lit(23)).alias("set_minutes"),
    )


_CHECKED = """
WITH b AS (SELECT o_orderkey match_id, CAST(o_orderdate AS DATE) AS day, o_orderkey k FROM orders),
i AS (
  SELECT match_id, 'date-season' AS rule, 'corrected' AS action FROM b WHERE year(day) <> CASE WHEN month(day) >= 8 THEN 1998 ELSE 1999 END AND NOT (month(day) = 2 AND day(day) = 29)
  UNION ALL SELECT match_id, 'date-season', 'removed' FROM b WHERE month(day) = 2 AND day(day) = 29
  UNION ALL SELECT match_id, 'hour-format', CASE WHEN k % 5 = 0 THEN 'corrected' ELSE 'removed' END FROM b WHERE k % 5 IN (0, 1, 3)
  UNION ALL SELECT match_id, 'club-code-format', CASE WHEN k % 3 = 0 THEN 'corrected' ELSE 'removed' END FROM b WHERE k % 3 IN (0, 1)
  UNION ALL SELECT match_id, 'score-sets', CASE k % 4 WHEN 2 THEN 'corrected' ELSE 'removed' END FROM b WHERE k % 4 IN (1, 2)
  UNION ALL SELECT match_id, 'winner-inference', 'corrected' FROM b WHERE k % 2 = 0
  UNION ALL SELECT match_id, 'played-sync', 'corrected' FROM b WHERE (k % 2 = 0) <> (k % 7 = 0)
  UNION ALL SELECT match_id, 'duration-range', 'corrected' FROM b WHERE k % 6 = 1)
"""
query("l5_found_issues", lambda c: qu.issue_rows(qu.check(_imported(c)), "match_id").select("match_id", "rule", "action"), _CHECKED + "SELECT * FROM i", base=False)
query("l8_issue_summary", lambda c: qu.issue_summary(qu.check(_imported(c))), _CHECKED + "SELECT rule, action, count(*) issues FROM i GROUP BY 1, 2", base=False)
query(
    "l9_audit",
    lambda c: qu.audit(qu.check(_imported(c))),
    _CHECKED + "SELECT (SELECT count(*) FROM b) matches, count(DISTINCT match_id) with_issues, count(*) FILTER (action = 'corrected') corrected, count(*) FILTER (action = 'removed') removed FROM i",
    base=False,
)
query(
    "l7_diagnostics",
    lambda c: qu.diagnostics(c.matches, c.sets),
    """, p AS (SELECT match_id, count(*) AS n, count(*) FILTER (greatest(score_a, score_b) < 15 OR abs(score_a - score_b) < 2) odd FROM sets GROUP BY 1)
SELECT match_id, 'odd-score' diagnostic FROM p WHERE odd > 0 UNION ALL SELECT match_id, 'unfinished' FROM matches JOIN p USING (match_id) WHERE NOT played""",
)
query(
    "l10_merge_sources",
    lambda c: rl.merge_by_priority(
        c.matches.select("match_id", F.lit(1).alias("p"), F.when(F.pmod("match_id", F.lit(3)) > 0, F.concat_ws("/", "sets_a", "sets_b")).alias("score"), F.lit(None).cast("string").alias("hall")).unionByName(
            c.matches.where("match_id % 2 = 0").select("match_id", F.lit(2).alias("p"), F.lit("3/2").alias("score"), F.lit("hall").alias("hall"))
        ),
        ["match_id"],
        "p",
        ["score", "hall"],
    ),
    "SELECT match_id, CASE WHEN match_id % 3 > 0 THEN sets_a || '/' || sets_b WHEN match_id % 2 = 0 THEN '3/2' END score, CASE WHEN match_id % 2 = 0 THEN 'hall' END hall FROM matches",
)

# ---------------------------------------------------------------- scalars: inputs by key, answers stated by hand
_LABELS = (
    # name, gender, age, division, level
    ("Régionale 1 Féminine", "FEMININ", "SENIOR", "1", "R1"),
    ("NATIONALE 2 MASCULINE", "MASCULIN", "SENIOR", "2", "N2"),
    ("Championnat M18 Féminin Poule 3", "FEMININ", "M18", None, "DEP"),
    ("Départementale 3 mixte", "MIXTE", "SENIOR", "3", "D3"),
    ("Pré-Nationale Masculine", "MASCULIN", "SENIOR", None, "PRENAT"),
    ("Coupe de France cadettes", None, "M18", None, "JEUNES CDF"),
    ("Loisir 4x4", None, None, None, "LOISIR"),
    ("Élite Avenir M", "MASCULIN", "SENIOR", None, "ELITE AVENIR"),
    ("Tournoi U11 régional", None, "M11", None, "JEUNES REGIONAL"),
    ("LIGUE A Masculine", "MASCULIN", "SENIOR", None, "PRO A"),
)


def _values(rows, names):
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({k}, {', '.join(map(text, r))})" for k, r in enumerate(rows)) + f") v(k, {', '.join(names)})"


def _cycled(c, values):
    """Each order's key with one of the values by its remainder."""
    pick = F.element_at(F.array(*map(F.lit, values)), (F.pmod("o_orderkey", F.lit(len(values))) + 1).cast("int"))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), pick.alias("v"))


query(
    "k2_k6_competition_labels",
    lambda c: sc.per_text(_cycled(c, [r[0] for r in _LABELS]), "v", gender=sc.gender, age=sc.age_category, division=sc.division, level=sc.level).drop("v"),
    f"SELECT o_orderkey id, gender, age, division, level FROM orders JOIN {_values(_LABELS, ('name', 'gender', 'age', 'division', 'level'))} ON k = o_orderkey % {len(_LABELS)}",
    base=False,
)
_SCORES = (("3/1", "3/1", None, "true"), (" 3 - 2", "3/2", None, "true"), ("P-3", "P/3", "a", "true"), ("3/P", "3/P", "b", "true"), ("p/p", "P/P", "both", "true"), ("0/0", "0/0", None, "false"), ("abc", None, None, "false"), ("3/", None, None, "false"))
query(
    "k8_k10_scores",
    lambda c: _cycled(c, [r[0] for r in _SCORES]).select("id", sc.set_score(F.col("v")).alias("score"), sc.forfeit_of(F.col("v")).alias("forfeit"), sc.score_says_played(F.col("v")).cast("string").alias("played")),
    f"SELECT o_orderkey id, score, forfeit, played FROM orders JOIN {_values(_SCORES, ('raw', 'score', 'forfeit', 'played'))} ON k = o_orderkey % {len(_SCORES)}",
    base=False,
)
_CODES = (
    ("BQXA", "BQX", "ALLER"), ("BQXR", "BQX", "RETOUR"), ("KLM", "KLM", None), ("TSMA", "TSMA", None), ("TSFA", "TSFA", None), ("DMMA", "DMM", "ALLER"), ("D2FA", "D2F", "ALLER"), ("TSFR", "TSF", "RETOUR"),
    ("XYZA", "XYZ", "ALLER"), ("AB", "AB", None), ("QQQB", "QQQB", None), ("AAR", "AAR", None),
)
query(
    "k14_pool_codes",
    lambda c: _cycled(c, [r[0] for r in _CODES]).select("id", sc.pool_code(F.col("v")).alias("p")).select("id", "p.code", "p.leg"),
    f"SELECT o_orderkey id, code, leg FROM orders JOIN {_values(_CODES, ('raw', 'code', 'leg'))} ON k = o_orderkey % {len(_CODES)}",
    base=False,
)
_DATES = (("05/09/2024", "2024-09-05"), ("5-9-2024", "2024-09-05"), ("2024-02-30", None), ("2024-12-01", "2024-12-01"), ("", None), ("01.02.2024", None))
query(
    "k15_dates",
    lambda c: _cycled(c, [r[0] for r in _DATES]).select("id", sc.french_date(F.col("v")).cast("string").alias("day")),
    f"SELECT o_orderkey id, day FROM orders JOIN {_values(_DATES, ('raw', 'day'))} ON k = o_orderkey % {len(_DATES)}",
    base=False,
)
_TIMES = (("1h25", "85.0"), ("1:05", "65.0"), ("85 min", "85.0"), ("90", "90.0"), ("x", None), ("2h", "120.0"))
query(
    "g6_durations",
    lambda c: _cycled(c, [r[0] for r in _TIMES]).select("id", sc.minutes(F.col("v")).cast("string").alias("minutes")),
    f"SELECT o_orderkey id, mm AS minutes FROM orders JOIN {_values(_TIMES, ('raw', 'mm'))} ON k = o_orderkey % {len(_TIMES)}",
    base=False,
)
_CLUBS = (
    ("Saint-Malo V.B. 3", "ST MALO V B", "ST MALO V B"), ("REDON VBC", "REDON VBC", "REDON"), ("Quimper Volley-Ball", "QUIMPER VOLLEY BALL", "QUIMPER"), ("STE ANNE  VOLLEY", "ST ANNE VOLLEY", "ST ANNE"),
    ("Évreux AVB", "EVREUX AVB", "EVREUX"), ("Nantes", "NANTES", "NANTES"), ("L'Oise (VB)", "L OISE VB", "L OISE"), ("sainte luce 12", "ST LUCE 12", "ST LUCE 12"), ("Dol, VC", "DOL VC", "DOL"), ("V", "V", "V"), ("", "", ""),
)
query(
    "i11_club_names",
    lambda c: _cycled(c, [r[0] for r in _CLUBS]).select("id", nm.club_name(F.col("v")).alias("name"), nm.core_name(F.col("v")).alias("core")),
    f"SELECT o_orderkey id, name, core FROM orders JOIN {_values(_CLUBS, ('raw', 'name', 'core'))} ON k = o_orderkey % {len(_CLUBS)}",
    base=False,
)
query(
    "i12_matched_names",
    lambda c: nm.match_clubs(c.teams.select(F.upper("team").alias("name")), c.teams.select(F.concat("team", F.lit(" VB")).alias("club"))),
    # names of this table have no accents, marks, team numbers or endings of their own, so their cores are their upper-case forms
    "SELECT DISTINCT upper(a.team) AS name, b.team || ' VB' club FROM teams a, teams b WHERE levenshtein(upper(a.team), upper(b.team)) <= 2",
)
query(
    "i7_distances",
    lambda c: c.table("customer").select(F.col("c_custkey").alias("id"), F.round(geo.haversine_km(45 + F.pmod("c_custkey", F.lit(50)) / 10.0, F.col("c_nationkey") / 5.0, F.lit(48.85), F.lit(2.35)), 6).alias("km")),
    """SELECT c_custkey id, round(2 * 6371 * asin(sqrt(pow(sin(radians(48.85 - (45 + c_custkey % 50 / CAST(10 AS DOUBLE))) / 2), 2)
  + cos(radians(45 + c_custkey % 50 / CAST(10 AS DOUBLE))) * cos(radians(48.85)) * pow(sin(radians(2.35 - c_nationkey / CAST(5 AS DOUBLE)) / 2), 2))), 6) km FROM customer""",
    base=False,
)

# ---------------------------------------------------------------- incremental rollups and windows over events
query(
    "f8_incremental_equals_full",
    lambda c: inc.apply_matches(ru.team_seasons(c.sides.where("match_id % 10 <> 3")), c.matches, c.matches.where("match_id % 10 = 3")),
    _TEAMS + "SELECT * FROM ts",
)


def _refreshed(c):
    """Rollups of nine tenths of the matches, after a batch of the last tenth."""
    columns = ("match_id", *ru.PLAYER_KEY, "role", "day", "played", "sets_for", "sets_against", "points", "serves", "runs", "longest_run", "confidence")
    keep = lambda df: stored(df, "rollups")
    appearances, matches = keep(c.appearances.select(*columns).repartition("player_id")), keep(c.matches)
    old = inc.build(appearances.where("match_id % 10 <> 3"), matches.where("match_id % 10 <> 3"), c.teams, keep)
    return inc.refresh(old, appearances, matches, c.teams, matches.where("match_id % 10 = 3"), store=keep)


query("f8_players_incremental", lambda c: _refreshed(c).players, ORACLES["f2_player_seasons"], base=False)
query("f8_careers_incremental", lambda c: _refreshed(c).careers, ORACLES["f3_player_careers"], base=False)
query("f8_clubs_incremental", lambda c: _refreshed(c).clubs, ORACLES["f6_club_rollup"], base=False)
query(
    "l13_tumbling_windows",
    lambda c: inc.tumbling(c.table("events")),
    """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) cents FROM events GROUP BY 1, 2, 3""",
    base=False,
)
query(
    "l13_sliding_windows",
    lambda c: inc.sliding(c.table("events"), "1 hour", "30 minutes"),
    """, h AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) t0, * FROM events), x AS (SELECT t0 AS st, * FROM h UNION ALL SELECT t0 - INTERVAL 30 MINUTE, * FROM h)
SELECT st AS start, st + INTERVAL 1 HOUR AS "end", event_type, count(*) events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) cents FROM x GROUP BY 1, 2, 3""",
)
query(
    "l13_sessions",
    lambda c: inc.sessions(c.table("events"), "2 hours"),
    """, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) sn FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) events FROM s GROUP BY user_id, sn""",
)
