"""Queries over standings, rollups, rankings, population and points."""

from pyspark.sql import functions as F

from rallyframe.operators import points as pt
from rallyframe.operators import population as pop
from rallyframe.operators import rollups as ru
from rallyframe.operators import standings as st
from rallyframe.operators.filters import MatchFilter, filtered
from rallyframe.operators.ranking import Ranking, rank_by
from rallyframe.plans.registry import query
from rallyframe.sources.views import departments_of, divisions_of

# ---------------------------------------------------------------- the shared filter
query(
    "b1_filtered_by_season_and_days",
    lambda c: filtered(c.matches, MatchFilter(seasons=(1996, 1997), season=1998, first_day="1998-06-30", last_day="1996-02-01")).select("match_id", "season", "day"),
    "SELECT match_id, season, day FROM matches WHERE played AND season IN (1996, 1997, 1998) AND day BETWEEN DATE '1996-02-01' AND DATE '1998-06-30'",
)
query(
    "b2_filtered_by_league",
    lambda c: filtered(c.matches, MatchFilter(league_id=2, competition="1-URGENT"), c.sides, c.teams, c.clubs).select("match_id", "team_a", "team_b"),
    """SELECT match_id, team_a, team_b FROM matches WHERE played AND competition = '1-URGENT' AND match_id IN
    (SELECT match_id FROM sides JOIN teams USING (team_id) JOIN clubs USING (club_id) WHERE league_id = 2)""",
)
query(
    "b3_filtered_by_club",
    lambda c: filtered(c.matches, MatchFilter(club_id=7), c.sides, c.teams, c.clubs).groupBy("season").agg(F.count(F.lit(1)).alias("matches")),
    "SELECT season, count(*) matches FROM matches WHERE played AND match_id IN (SELECT match_id FROM sides JOIN teams USING (team_id) WHERE club_id = 7) GROUP BY 1",
)

_DIVISIONS = """, dv AS (SELECT season, competition, ['MASCULIN', 'F', 'Mixte', 'M', 'FEMININ'][n % 5 + 1] gender, ['SENIOR', 'M18', 'M15'][2 * n % 3 + 1] category, ['N2', 'N3', 'PRENAT', 'REGIONAL', 'R2', 'D1', 'DEP', 'LOISIR', 'autre'][5 * n % 9 + 1] AS level
  FROM (SELECT DISTINCT season, competition, season + CAST(substr(competition, 1, 1) AS INTEGER) n FROM matches)),
md AS (SELECT matches.match_id, season, competition, gender, category, dv.level FROM matches JOIN dv USING (season, competition) WHERE played)
"""


def _in_division(**conditions):
    """Ids of the matches that pass conditions on their division."""
    return lambda c: filtered(c.matches, MatchFilter(**conditions), divisions=divisions_of(c.matches)).select("match_id")


query("b4_filtered_by_gender", _in_division(gender="homme"), _DIVISIONS + "SELECT match_id FROM md WHERE upper(gender) IN ('M', 'MASCULIN', 'HOMME')")
query("b5_filtered_by_mixed_gender", _in_division(gender="X"), _DIVISIONS + "SELECT match_id FROM md WHERE upper(gender) LIKE '%MIXTE%'")
query("b6_filtered_by_category", _in_division(category="M18"), _DIVISIONS + "SELECT match_id FROM md WHERE category = 'M18'")
query("b7_filtered_by_level", _in_division(level="regional"), _DIVISIONS + "SELECT match_id FROM md WHERE upper(level) = 'REGIONAL'")
query("b8_filtered_by_level_range", _in_division(least_level="D1", most_level="N3"), _DIVISIONS + "SELECT match_id FROM md WHERE level IN ('N3', 'PRENAT', 'REGIONAL', 'R2', 'D1', 'DEP')")
query("b9_filtered_by_open_level", _in_division(least_level="PRENAT", gender="F"), _DIVISIONS + "SELECT match_id FROM md WHERE level IN ('N2', 'N3', 'PRENAT') AND upper(gender) IN ('F', 'FEMININ', 'FEMME')")
query(
    "b10_filtered_by_department",
    lambda c: filtered(c.matches, MatchFilter(department="03", season=1997), c.sides, c.teams, departments_of(c.clubs)).select("match_id"),
    "SELECT match_id FROM matches WHERE played AND season = 1997 AND match_id IN (SELECT match_id FROM sides JOIN teams USING (team_id) WHERE club_id % 9 + 1 = 3)",
)
query(
    "b11_filtered_by_echelon",
    lambda c: filtered(c.matches.join(divisions_of(c.matches), ["season", "competition"]).withColumn("competition", F.col("level")), MatchFilter(echelon="REGIONAL")).select("match_id"),
    _DIVISIONS + "SELECT match_id FROM md WHERE level LIKE '%REGION%' OR level LIKE '%PRE_NAT%' OR level LIKE '%PRE NAT%'",
)

# ---------------------------------------------------------------- standings
_AWARDS = """,
o AS (
  SELECT *, coalesce(forfeit_by = 'both' OR forfeit_by = lower(side), false) mine,
    forfeit_by IS NOT NULL AND NOT coalesce(forfeit_by = 'both' OR forfeit_by = lower(side), false) gift
  FROM sides WHERE played AND (sets_for > 0 OR sets_against > 0 OR forfeit)),
aw AS (
  SELECT match_id, season, competition, day, round, side, team_id,
    CASE WHEN mine THEN -1 WHEN gift THEN 3 WHEN sets_for > sets_against AND sets_for = 3 AND sets_against = 2 THEN 2 WHEN sets_for > sets_against THEN 3
      WHEN sets_for = 2 AND sets_against = 3 THEN 1 ELSE 0 END points,
    CASE WHEN gift OR (NOT mine AND sets_for > sets_against) THEN 1 ELSE 0 END wins,
    CASE WHEN mine OR (NOT gift AND sets_for < sets_against) THEN 1 ELSE 0 END defeats,
    CASE WHEN gift OR (NOT mine AND sets_for = 3 AND sets_against = 0) THEN 1 ELSE 0 END w30,
    CASE WHEN forfeit_by IS NULL AND sets_for = 3 AND sets_against = 1 THEN 1 ELSE 0 END w31,
    CASE WHEN forfeit_by IS NULL AND sets_for = 3 AND sets_against = 2 THEN 1 ELSE 0 END w32,
    CASE WHEN forfeit_by IS NULL AND sets_for = 2 AND sets_against = 3 THEN 1 ELSE 0 END d23,
    CASE WHEN forfeit_by IS NULL AND sets_for = 1 AND sets_against = 3 THEN 1 ELSE 0 END d13,
    CASE WHEN mine OR (NOT gift AND sets_for = 0 AND sets_against = 3) THEN 1 ELSE 0 END d03,
    CASE WHEN mine THEN 1 ELSE 0 END forfeits,
    CASE WHEN gift THEN 3 WHEN mine THEN 0 ELSE sets_for END sets_for,
    CASE WHEN mine THEN 3 WHEN gift THEN 0 ELSE sets_against END sets_against,
    CASE WHEN forfeit_by IS NULL OR points_for > 0 THEN points_for WHEN gift THEN 75 ELSE 0 END points_for,
    CASE WHEN forfeit_by IS NULL OR points_against > 0 THEN points_against WHEN mine THEN 75 ELSE 0 END points_against,
    CASE WHEN gift OR (NOT mine AND sets_for > sets_against) THEN 'V' WHEN mine OR sets_for < sets_against THEN 'D' END result
  FROM o)
"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


_COUNTERS = [c for c in st.COUNTERS if c != "matches"]
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) {c}" for c in _COUNTERS)
_LINES = (
    _AWARDS
    + f""", ln AS (SELECT season, competition, team_id, count(*) matches, {_SUMS}, min(match_id * 2 + CASE WHEN side = 'A' THEN 0 ELSE 1 END) AS seen FROM aw GROUP BY 1, 2, 3),
table_ AS (SELECT season, competition, team_id, matches, {", ".join(_COUNTERS)},
  row_number() OVER (PARTITION BY season, competition ORDER BY points DESC, {_ratio("sets_for", "sets_against")} DESC, {_ratio("points_for", "points_against")} DESC, seen) AS rank FROM ln)
"""
)
query("e1_standings", lambda c: st.standings(c.sides), _LINES + "SELECT * FROM table_")
query(
    "e5_evolution",
    lambda c: st.evolution(c.sides),
    _AWARDS
    + f""", nm AS (SELECT *, coalesce(round, CAST(day AS VARCHAR), 'Inconnue') AS name FROM aw),
days AS (SELECT season, competition, name, max(day) AS day, row_number() OVER (PARTITION BY season, competition ORDER BY
    CASE WHEN regexp_extract(name, '(\\d+)', 1) = '' THEN 1 ELSE 0 END, coalesce(TRY_CAST(regexp_extract(name, '(\\d+)', 1) AS BIGINT), 0), name) place FROM nm GROUP BY 1, 2, 3),
each AS (SELECT season, competition, name, team_id, sum(points) points, count(*) matches, sum(sets_for) sets_for, sum(sets_against) sets_against,
    sum(points_for) points_for, sum(points_against) points_against, min(match_id * 2 + CASE WHEN side = 'A' THEN 0 ELSE 1 END) AS seen FROM nm GROUP BY 1, 2, 3, 4),
ep AS (SELECT e.*, place FROM each e JOIN days USING (season, competition, name)),
grid AS (SELECT b.season, b.competition, b.team_id, d.place, d.name, d.day FROM (SELECT season, competition, team_id, min(place) AS p0 FROM ep GROUP BY 1, 2, 3) b
    JOIN days d ON b.season = d.season AND b.competition = d.competition AND d.place >= b.p0),
cum AS (SELECT g.season, g.competition, g.team_id, g.place, g.name, g.day,
    {", ".join(f"CAST(sum(coalesce(e.{c}, 0)) OVER w AS BIGINT) {c}" for c in ("points", "matches", "sets_for", "sets_against", "points_for", "points_against"))},
    first_value(e.seen IGNORE NULLS) OVER w AS seen
    FROM grid g LEFT JOIN ep e USING (season, competition, team_id, place) WINDOW w AS (PARTITION BY g.season, g.competition, g.team_id ORDER BY g.place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT season, competition, place, name, day, team_id, points, matches, sets_for, sets_against,
  row_number() OVER (PARTITION BY season, competition, place ORDER BY points DESC, {_ratio("sets_for", "sets_against")} DESC, {_ratio("points_for", "points_against")} DESC, seen) AS rank FROM cum""",
)
query(
    "e7_form",
    lambda c: st.form(c.sides),
    _AWARDS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY season, competition, team_id ORDER BY day DESC, match_id DESC) AS n FROM aw WHERE result IS NOT NULL)
SELECT season, competition, team_id, count(*) results, string_agg(result, '' ORDER BY n DESC) FILTER (n <= 5) form FROM n GROUP BY 1, 2, 3""",
)
query(
    "e9_standings_by_month",
    lambda c: st.standings(c.sides.withColumn("month", F.month("day")), ["season", "competition", "month"]).select("season", "competition", F.col("month").cast("long").alias("month"), "team_id", "points", "rank"),
    _AWARDS
    + f""", ln AS (SELECT season, competition, CAST(month(day) AS BIGINT) AS month, team_id, CAST(sum(points) AS BIGINT) points, sum(sets_for) sf, sum(sets_against) sa, sum(points_for) pf, sum(points_against) pa,
  min(match_id * 2 + CASE WHEN side = 'A' THEN 0 ELSE 1 END) AS seen FROM aw GROUP BY 1, 2, 3, 4)
SELECT season, competition, month, team_id, points, row_number() OVER (PARTITION BY season, competition, month ORDER BY points DESC, {_ratio("sf", "sa")} DESC, {_ratio("pf", "pa")} DESC, seen) AS rank FROM ln""",
)
query(
    "e11_cell_points",
    lambda c: st.cell_points(c.matches),
    """, n AS (SELECT *, row_number() OVER (PARTITION BY season, competition, team_a, team_b ORDER BY played DESC, day DESC, match_id DESC) AS n FROM matches),
p AS (SELECT *, CASE WHEN forfeit THEN 'forfeit' WHEN played THEN 'played' ELSE 'no result' END status, played AND (sets_a > 0 OR sets_b > 0 OR forfeit) counts FROM n WHERE n = 1)
SELECT season, competition, team_a AS host, team_b guest, match_id, status, CASE WHEN played THEN sets_a || '-' || sets_b END score,
  CASE WHEN counts THEN CAST(CASE WHEN forfeit_by IN ('both', 'a') THEN -1 WHEN forfeit_by = 'b' THEN 3 WHEN sets_a = 3 AND sets_b = 2 THEN 2 WHEN sets_a > sets_b THEN 3 WHEN sets_b = 3 AND sets_a = 2 THEN 1 ELSE 0 END AS BIGINT) END host_points,
  CASE WHEN counts THEN CAST(CASE WHEN forfeit_by IN ('both', 'b') THEN -1 WHEN forfeit_by = 'a' THEN 3 WHEN sets_b = 3 AND sets_a = 2 THEN 2 WHEN sets_b > sets_a THEN 3 WHEN sets_a = 3 AND sets_b = 2 THEN 1 ELSE 0 END AS BIGINT) END guest_points,
  CASE WHEN forfeit_by = 'both' THEN '2F' WHEN status = 'forfeit' THEN 'F' WHEN status = 'played' THEN CASE abs(sets_a - sets_b) WHEN 3 THEN 'large' WHEN 2 THEN 'clear' WHEN 1 THEN 'close' END END badge FROM p""",
)
query(
    "e11_cross_table",
    lambda c: st.cross_table(c.matches),
    """, n AS (SELECT *, row_number() OVER (PARTITION BY season, competition, team_a, team_b ORDER BY played DESC, day DESC, match_id DESC) AS n FROM matches)
SELECT season, competition, team_a AS host, team_b guest, match_id, CASE WHEN forfeit THEN 'forfeit' WHEN played THEN 'played' ELSE 'no result' END status,
  CASE WHEN played THEN sets_a || '-' || sets_b END score FROM n WHERE n = 1""",
)
query(
    "e11_score_distribution",
    lambda c: st.score_distribution(c.matches),
    """, t AS (SELECT season, competition, count(*) matches, count(*) FILTER (sets_a > sets_b) home FROM matches WHERE played GROUP BY 1, 2)
SELECT season, competition, sets_a || '-' || sets_b score, count(*) times, round(CAST(100 AS DOUBLE) * any_value(home) / any_value(t.matches), 1) home_win_pct
FROM matches JOIN t USING (season, competition) WHERE played GROUP BY 1, 2, 3""",
)
query(
    "e12_bracket",
    lambda c: st.bracket(st.standings(c.sides)),
    _LINES
    + """, q AS (SELECT season, competition, rank, team_id, CASE least(rank, 9 - rank) WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS quarter FROM table_ WHERE rank <= 8)
SELECT season, competition, CAST(quarter AS BIGINT) AS quarter, arg_min(team_id, rank) high_seed, arg_max(team_id, rank) low_seed, CAST(ceil(quarter / 2) AS BIGINT) AS semi
FROM q GROUP BY season, competition, quarter HAVING count(*) = 2""",
)

# ---------------------------------------------------------------- rollups
_SEASONS = """,
base AS (SELECT * FROM appearances WHERE played),
rl AS (SELECT player_id, season, competition, team_id, role, count(*) AS n FROM base GROUP BY 1, 2, 3, 4, 5),
rm AS (SELECT player_id, season, competition, team_id, sum(n) rn, max(n) rx, arg_min(role, (-n, role)) AS role FROM rl GROUP BY 1, 2, 3, 4),
sm AS (SELECT player_id, season, competition, team_id, count(*) matches, count(*) FILTER (sets_for > sets_against) wins, count(*) FILTER (NOT sets_for > sets_against) defeats,
  CAST(sum(CASE WHEN runs > 0 THEN runs ELSE greatest(1, sets_for + sets_against) END) AS BIGINT) sets, CAST(sum(points) AS BIGINT) points, CAST(sum(serves) AS BIGINT) serves,
  CAST(sum(runs) AS BIGINT) runs, max(longest_run) longest_run, avg(CASE WHEN confidence > 0 THEN CAST(confidence AS DOUBLE) / 100 END) mc FROM base GROUP BY 1, 2, 3, 4),
ps AS (SELECT player_id, season, competition, team_id, matches, wins, defeats, sets, points, serves, runs, longest_run,
  CASE WHEN runs > 0 THEN round(CAST(serves AS DOUBLE) / runs, 2) ELSE CAST(0 AS DOUBLE) END serves_per_run, role,
  round(CAST(0.40 AS DOUBLE) * coalesce(mc, CAST(0.5 AS DOUBLE)) + CAST(0.40 AS DOUBLE) * rx / rn + CAST(0.20 AS DOUBLE) * least(CAST(1 AS DOUBLE), rn / CAST(6 AS DOUBLE)), 3) role_confidence
  FROM sm JOIN rm USING (player_id, season, competition, team_id))
"""
query("f2_player_seasons", lambda c: ru.player_seasons(c.appearances), _SEASONS + "SELECT * FROM ps")
query(
    "f3_player_careers",
    lambda c: ru.careers_of(c.appearances),
    _SEASONS
    + """, dy AS (SELECT player_id, min(day) first_day, max(day) last_day, max(points) best_match_points FROM appearances WHERE played GROUP BY 1)
SELECT ps.player_id, CAST(sum(matches) AS BIGINT) matches, CAST(sum(wins) AS BIGINT) wins, CAST(sum(defeats) AS BIGINT) defeats, CAST(sum(points) AS BIGINT) points, CAST(sum(serves) AS BIGINT) serves,
  max(longest_run) longest_run, count(DISTINCT season) seasons, count(DISTINCT team_id) clubs, max(points) best_season_points, round(CAST(sum(CAST(round(role_confidence * 1000) AS BIGINT) * matches) AS DOUBLE) / sum(matches) / 1000, 3) role_confidence,
  any_value(first_day) first_day, any_value(last_day) last_day, any_value(best_match_points) best_match_points FROM ps JOIN dy USING (player_id) GROUP BY ps.player_id""",
)
_TEAMS = """,
oc AS (SELECT *, coalesce(forfeit_by = 'both' OR forfeit_by = lower(side), false) mine,
  forfeit_by IS NOT NULL AND NOT coalesce(forfeit_by = 'both' OR forfeit_by = lower(side), false) gift FROM sides WHERE played),
ow AS (SELECT *, gift OR (NOT mine AND sets_for > sets_against) won FROM oc),
s1 AS (SELECT *, CASE WHEN won <> lag(won) OVER w THEN 1 ELSE 0 END ch FROM ow WINDOW w AS (PARTITION BY team_id, season, competition ORDER BY day, match_id)),
s2 AS (SELECT *, sum(ch) OVER (PARTITION BY team_id, season, competition ORDER BY day, match_id) island FROM s1),
s3 AS (SELECT team_id, season, competition, island, count(*) AS n, any_value(won) won FROM s2 GROUP BY 1, 2, 3, 4),
sk AS (SELECT team_id, season, competition, coalesce(max(CASE WHEN won THEN n END), 0) longest_streak, arg_max(CASE WHEN won THEN n ELSE -n END, island) current_streak FROM s3 GROUP BY 1, 2, 3),
tl AS (SELECT team_id, season, competition, count(*) matches, count(*) FILTER (won) wins, count(*) FILTER (NOT won) defeats, count(*) FILTER (won AND side = 'A') home_wins,
  count(*) FILTER (won AND side = 'B') away_wins, count(*) FILTER (mine) forfeits,
  CAST(sum(CASE WHEN mine THEN -1 WHEN gift THEN 3 WHEN sets_for = 3 AND sets_against <= 1 THEN 3 WHEN sets_for = 3 AND sets_against = 2 THEN 2 WHEN sets_for = 2 AND sets_against = 3 THEN 1 ELSE 0 END) AS BIGINT) points,
  CAST(sum(CASE WHEN gift THEN 3 WHEN mine THEN 0 ELSE sets_for END) AS BIGINT) sets_for, CAST(sum(CASE WHEN mine THEN 3 WHEN gift THEN 0 ELSE sets_against END) AS BIGINT) sets_against,
  CAST(sum(CASE WHEN forfeit_by IS NULL THEN points_for ELSE 0 END) AS BIGINT) points_for, CAST(sum(CASE WHEN forfeit_by IS NULL THEN points_against ELSE 0 END) AS BIGINT) points_against FROM ow GROUP BY 1, 2, 3),
tr AS (SELECT *, CASE WHEN sets_against > 0 THEN round(CAST(sets_for AS DOUBLE) / sets_against, 3) ELSE CAST(sets_for AS DOUBLE) END set_ratio,
  CASE WHEN points_against > 0 THEN round(CAST(points_for AS DOUBLE) / points_against, 3) ELSE CAST(0 AS DOUBLE) END point_ratio FROM tl),
ts AS (SELECT tr.*, longest_streak, current_streak,
  row_number() OVER (PARTITION BY season, competition ORDER BY points DESC, set_ratio DESC, point_ratio DESC, wins DESC, sets_for DESC, points_for DESC, team_id) AS rank FROM tr JOIN sk USING (team_id, season, competition))
"""
query("f4_team_seasons", lambda c: ru.team_seasons(c.sides), _TEAMS + "SELECT * FROM ts")
query(
    "f6_club_rollup",
    lambda c: ru.club_rollup(ru.team_seasons(c.sides), c.teams, ru.player_seasons(c.appearances)),
    _TEAMS
    + """, tc AS (SELECT * FROM ts JOIN (SELECT team_id, club_id FROM teams) USING (team_id)), pc AS (SELECT * FROM appearances JOIN (SELECT team_id, club_id FROM teams) USING (team_id) WHERE played),
cs AS (SELECT club_id, season, CAST(sum(matches) AS BIGINT) matches, CAST(sum(wins) AS BIGINT) wins, CAST(sum(defeats) AS BIGINT) defeats, CAST(sum(points) AS BIGINT) points FROM tc GROUP BY GROUPING SETS ((club_id, season), (club_id))),
pp AS (SELECT club_id, season, count(DISTINCT player_id) players FROM pc GROUP BY GROUPING SETS ((club_id, season), (club_id)))
SELECT cs.*, coalesce(players, 0) players, CASE WHEN matches > 0 THEN round(CAST(100 AS DOUBLE) * wins / matches, 1) ELSE CAST(0 AS DOUBLE) END rate
FROM cs LEFT JOIN pp ON cs.club_id = pp.club_id AND cs.season IS NOT DISTINCT FROM pp.season""",
)

# ---------------------------------------------------------------- rankings
query(
    "d1_rank_players",
    lambda c: rank_by(ru.careers_of(c.appearances), Ranking("players", "points", least_matches=5, page=2)),
    """, p AS (SELECT player_id, CAST(sum(points) AS DOUBLE) AS value, count(*) matches FROM appearances WHERE played GROUP BY 1 HAVING count(*) >= 5)
SELECT player_id, value, matches, row_number() OVER (ORDER BY value DESC, matches DESC, player_id) AS rank, (SELECT count(*) FROM p) total FROM p ORDER BY rank LIMIT 20 OFFSET 20""",
)
query(
    "d2_rank_teams",
    lambda c: rank_by(ru.team_seasons(c.sides), Ranking("teams", "win_rate", page_size=50)),
    _TEAMS
    + """SELECT team_id, season, competition, CAST(wins AS DOUBLE) AS value, matches, row_number() OVER (ORDER BY wins DESC, matches DESC, team_id, season, competition) AS rank,
  (SELECT count(*) FROM ts) total FROM ts ORDER BY rank LIMIT 50""",
)
query(
    "d3_rank_clubs",
    lambda c: rank_by(ru.club_rollup(ru.team_seasons(c.sides), c.teams, ru.player_seasons(c.appearances)).where("season is null"), Ranking("clubs", "win_rate", ascending=True)),
    """, c AS (SELECT club_id, count(*) matches, count(*) FILTER (sets_for > sets_against) wins FROM sides JOIN teams USING (team_id) WHERE played GROUP BY 1),
v AS (SELECT club_id, round(CAST(100 AS DOUBLE) * wins / matches, 1) AS value, matches FROM c)
SELECT club_id, value, matches, row_number() OVER (ORDER BY value, matches DESC, club_id) AS rank, (SELECT count(*) FROM v) total FROM v ORDER BY rank LIMIT 20""",
)

# ---------------------------------------------------------------- population
_LICENCES = """,
sx AS (SELECT season, row_number() OVER (ORDER BY season) AS n FROM (SELECT DISTINCT season FROM appearances)),
ac AS (SELECT DISTINCT player_id, season FROM appearances),
lg AS (SELECT player_id, season, n - lag(n) OVER (PARTITION BY player_id ORDER BY n) - 1 gap, first_value(season) OVER (PARTITION BY player_id ORDER BY n) first_season FROM ac JOIN sx USING (season)),
lh AS (SELECT player_id, season, CASE WHEN gap IS NULL THEN 'new' WHEN gap = 0 THEN 'continued' ELSE 'resumed' END licence, first_season, coalesce(gap, 0) seasons_away FROM lg)
"""
query("i1_licence_history", lambda c: pop.licence_history(c.appearances), _LICENCES + "SELECT * FROM lh")
query(
    "i2_licence_report",
    lambda c: pop.licence_report(pop.licence_history(c.appearances)),
    _LICENCES
    + """, t AS (SELECT season, count(*) licences, count(*) FILTER (licence = 'new') AS "new", count(*) FILTER (licence = 'continued') continued, count(*) FILTER (licence = 'resumed') resumed FROM lh GROUP BY 1)
SELECT *, round(CAST(100 AS DOUBLE) * "new" / licences, 1) new_pct, round(CAST(100 AS DOUBLE) * continued / licences, 1) continued_pct, round(CAST(100 AS DOUBLE) * resumed / licences, 1) resumed_pct FROM t""",
)
query(
    "i3_retention",
    lambda c: pop.retention(pop.licence_history(c.appearances)),
    _LICENCES
    + """, pr AS (SELECT season, lead(season) OVER (ORDER BY season) nx FROM sx),
b AS (SELECT player_id, season, nx FROM ac JOIN pr USING (season) WHERE nx IS NOT NULL), a AS (SELECT ac.player_id, pr.season, ac.season nx FROM ac JOIN pr ON ac.season = pr.nx),
j AS (SELECT coalesce(b.season, a.season) season, coalesce(b.nx, a.nx) AS next, b.player_id bp, a.player_id ap FROM b FULL JOIN a ON b.player_id = a.player_id AND b.season = a.season)
SELECT season, next, count(*) FILTER (bp IS NOT NULL AND ap IS NOT NULL) stayed, count(*) FILTER (ap IS NULL) AS "left", count(*) FILTER (bp IS NULL) arrived,
  CASE WHEN count(bp) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * count(*) FILTER (bp IS NOT NULL AND ap IS NOT NULL) / count(bp), 1) END retention_pct FROM j GROUP BY 1, 2""",
)
query(
    "i4_territory",
    lambda c: pop.territory(c.sides, c.appearances, c.teams, c.clubs),
    """, pl AS (SELECT team_id, club_id, league_id FROM teams JOIN clubs USING (club_id)),
m AS (SELECT league_id, club_id, count(DISTINCT match_id) matches, count(DISTINCT team_id) teams FROM sides JOIN pl USING (team_id) WHERE played GROUP BY ROLLUP (league_id, club_id)),
p AS (SELECT league_id, club_id, count(DISTINCT player_id) players FROM appearances JOIN pl USING (team_id) WHERE played GROUP BY ROLLUP (league_id, club_id))
SELECT CASE WHEN m.league_id IS NULL THEN 'nation' WHEN m.club_id IS NULL THEN 'region' ELSE 'club' END AS scope, m.league_id, m.club_id, teams, matches, players
FROM m JOIN p ON m.league_id IS NOT DISTINCT FROM p.league_id AND m.club_id IS NOT DISTINCT FROM p.club_id""",
)

# ---------------------------------------------------------------- points
_LINES_OF_SETS = """,
tm AS (SELECT set_id, ts, event_id, kind, scored_by, called_by,
  CAST(sum(CASE WHEN scored_by = 'A' THEN 1 ELSE 0 END) OVER w AS BIGINT) score_a, CAST(sum(CASE WHEN scored_by = 'B' THEN 1 ELSE 0 END) OVER w AS BIGINT) score_b,
  coalesce(last_value(scored_by IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'A') server
  FROM rallies WINDOW w AS (PARTITION BY set_id ORDER BY ts, event_id)),
po AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY ts, event_id) x, score_a - score_b y FROM tm WHERE kind = 'point')
"""


def _points(c):
    return pt.points_only(pt.timeline(c.rallies))


query("g2_timeline", lambda c: pt.timeline(c.rallies).drop("ts"), _LINES_OF_SETS + "SELECT set_id, event_id, kind, scored_by, called_by, score_a, score_b, server FROM tm")
query(
    "g7_serve_runs",
    lambda c: pt.serve_runs(_points(c)),
    _LINES_OF_SETS
    + """, ch AS (SELECT *, CASE WHEN server <> lag(server) OVER (PARTITION BY set_id ORDER BY ts, event_id) THEN 1 ELSE 0 END ch FROM po),
rn AS (SELECT *, sum(ch) OVER (PARTITION BY set_id ORDER BY ts, event_id) AS run FROM ch), rg AS (SELECT set_id, server, run, count(*) AS n FROM rn GROUP BY 1, 2, 3)
SELECT set_id, server AS side, count(*) runs, max(n) longest, CAST(sum(n) AS BIGINT) serves FROM rg GROUP BY 1, 2""",
)
query(
    "g7_score_states",
    lambda c: pt.score_states(_points(c)),
    _LINES_OF_SETS
    + """, bf AS (SELECT *, score_a - CASE WHEN scored_by = 'A' THEN 1 ELSE 0 END ba, score_b - CASE WHEN scored_by = 'B' THEN 1 ELSE 0 END bb FROM po)
SELECT set_id, CASE WHEN ba < bb THEN 'behind' WHEN ba = bb THEN 'level' ELSE 'ahead' END AS state, count(*) points, count(*) FILTER (scored_by = 'A') won,
  count(*) FILTER (greatest(ba, bb) >= 20) money_points, count(*) FILTER (greatest(ba, bb) >= 20 AND scored_by = 'A') money_won FROM bf GROUP BY 1, 2""",
)
query(
    "g10_phases",
    lambda c: pt.phases(_points(c)),
    _LINES_OF_SETS
    + """, sd AS (SELECT set_id, s.side, server = s.side serving, scored_by = s.side won FROM po, (VALUES ('A'), ('B')) s(side)),
n AS (SELECT set_id, side, count(*) FILTER (serving) serves, count(*) FILTER (serving AND won) breaks, count(*) FILTER (NOT serving) receptions, count(*) FILTER (NOT serving AND won) side_outs FROM sd GROUP BY 1, 2)
SELECT *, CASE WHEN serves = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * breaks / serves, 1) END break_pct,
  CASE WHEN receptions = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * side_outs / receptions, 1) END side_out_pct FROM n""",
)
query(
    "g13_momentum",
    lambda c: pt.momentum(_points(c)),
    _LINES_OF_SETS + "SELECT set_id, x, y, scored_by winner, CASE WHEN server = scored_by THEN 'break' ELSE 'side_out' END phase, server FROM po",
)
query(
    "g13_largest_leads",
    lambda c: pt.largest_leads(_points(c)),
    _LINES_OF_SETS
    + """, q AS (SELECT *, sign(y) AS sg, CASE WHEN scored_by <> lag(scored_by) OVER w THEN 1 ELSE 0 END ot FROM po WINDOW w AS (PARTITION BY set_id ORDER BY ts, event_id)),
r AS (SELECT *, last_value(CASE WHEN sg <> 0 THEN sg END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) bf, sum(ot) OVER w AS run FROM q WINDOW w AS (PARTITION BY set_id ORDER BY ts, event_id)),
lr AS (SELECT set_id, max(n) longest_run FROM (SELECT set_id, run, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT r.set_id, CAST(greatest(0, max(y)) AS BIGINT) lead_a, CAST(greatest(0, -min(y)) AS BIGINT) lead_b, count(*) FILTER (sg <> 0 AND bf = -sg) changes, any_value(longest_run) longest_run
FROM r JOIN lr ON r.set_id = lr.set_id GROUP BY r.set_id""",
)
_DECISIONS = (
    _LINES_OF_SETS
    + """,
ev AS (SELECT *, sum(CASE WHEN kind = 'point' THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY ts, event_id) AS pos, sum(CASE WHEN kind = 'point' THEN 1 ELSE 0 END) OVER (PARTITION BY set_id) AS n FROM tm),
e1 AS (SELECT *, CAST(greatest(4, least(12, round_even(greatest(1, n) * CAST(0.18 AS DOUBLE), 0))) AS BIGINT) AS w FROM ev WHERE kind <> 'point' AND n > 0),
e2 AS (SELECT set_id, event_id, kind, called_by AS side, pos, n, w, greatest(0, pos - w) f, least(n, pos + w) t FROM e1),
e3 AS (SELECT e2.*, pos - f AS nb, t - pos AS na, CASE WHEN side = 'A' THEN 1 ELSE -1 END AS sg,
  coalesce(CASE WHEN side = 'A' THEN p0.score_a ELSE p0.score_b END, 0) s0, coalesce(CASE WHEN side = 'A' THEN p1.score_a ELSE p1.score_b END, 0) s1, coalesce(CASE WHEN side = 'A' THEN p2.score_a ELSE p2.score_b END, 0) s2,
  coalesce(p0.y, 0) y0, coalesce(p1.y, 0) y1, coalesce(p2.y, 0) y2
  FROM e2 LEFT JOIN po p0 ON p0.set_id = e2.set_id AND p0.x = f LEFT JOIN po p1 ON p1.set_id = e2.set_id AND p1.x = pos LEFT JOIN po p2 ON p2.set_id = e2.set_id AND p2.x = t),
e4 AS (SELECT *, coalesce(CAST(s1 - s0 AS DOUBLE) / nullif(nb, 0), CAST(0.5 AS DOUBLE)) b, coalesce(CAST(s2 - s1 AS DOUBLE) / nullif(na, 0), CAST(0.5 AS DOUBLE)) a,
  CAST(sg * (y1 - y0) AS DOUBLE) / greatest(1, nb) sb, CAST(sg * (y2 - y1) AS DOUBLE) / greatest(1, na) sa, sg * (y2 - y1) swing,
  greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - abs(y1) / CAST(10 AS DOUBLE))) cl, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(pos AS DOUBLE) / n)) pg,
  greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(nb + na AS DOUBLE) / (w * 2))) cv FROM e3),
e5 AS (SELECT *, (a - b) * 72 + (sa - sb) * 42 + swing / greatest(CAST(2 AS DOUBLE), w * CAST(0.8 AS DOUBLE)) * 24 AS raw FROM e4),
e6 AS (SELECT *, greatest(CAST(-100 AS DOUBLE), least(CAST(100 AS DOUBLE), raw * (CAST(0.75 AS DOUBLE) + CAST(0.35 AS DOUBLE) * cl + CAST(0.25 AS DOUBLE) * pg) * (CAST(0.55 AS DOUBLE) + CAST(0.45 AS DOUBLE) * cv))) sc FROM e5),
di AS (SELECT set_id, event_id, kind, side, CAST(pos AS BIGINT) x, CAST(nb AS BIGINT) n_before, CAST(na AS BIGINT) n_after, round(b, 3) AS before, round(a, 3) AS after, round(sa - sb, 3) slope_change, CAST(swing AS BIGINT) swing,
  round(sc, 1) impact, CASE WHEN sc >= 12 THEN 'positive' WHEN sc <= -12 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN abs(sc) >= 65 THEN 'strong' WHEN abs(sc) >= 38 THEN 'moderate' WHEN abs(sc) >= 18 THEN 'light' ELSE 'faint' END AS strength, round((CAST(0.45 AS DOUBLE) + CAST(0.55 AS DOUBLE) * cv) * 100, 1) confidence FROM e6)
"""
)
query("g14_decisions", lambda c: pt.decisions(pt.timeline(c.rallies)), _DECISIONS + "SELECT * FROM di")
query(
    "g15_decision_summary",
    lambda c: pt.decision_summary(pt.decisions(pt.timeline(c.rallies))),
    _DECISIONS
    + """, te AS (SELECT side, kind, label, CAST(round(impact * 10) AS BIGINT) t FROM di),
ag AS (SELECT side, kind, count(*) decisions, CAST(sum(t) AS BIGINT) total, max(t) best, min(t) worst, count(*) FILTER (label = 'positive') positive, count(*) FILTER (label = 'neutral') neutral, count(*) FILTER (label = 'negative') negative FROM te GROUP BY 1, 2)
SELECT *, best - worst AS spread, round(CAST(total AS DOUBLE) / decisions, 1) AS mean FROM ag""",
)
query(
    "g4_score_as_of",
    lambda c: pt.server_at(_points(c), c.rallies.where("kind = 'timeout'").select("set_id", F.col("ts").alias("at"), F.col("event_id").alias("moment_id"))),
    _LINES_OF_SETS
    + """SELECT m.set_id, m.event_id moment_id, p.server, p.score_a, p.score_b FROM (SELECT * FROM tm WHERE kind = 'timeout') m ASOF LEFT JOIN po p ON m.set_id = p.set_id AND m.ts >= p.ts""",
)
