"""Leaderboard queries."""

from rallyframe.operators import leaders as ld
from rallyframe.plans.registry import ORACLES, PLANS, query
from rallyframe.sources.storage import stored
from rallyframe.sources.views import Contest

_RESULTS = """,
r AS (SELECT player_id, count(DISTINCT match_id) matches, count(*) FILTER (sets_for > sets_against) wins, count(*) FILTER (sets_for < sets_against) defeats
  FROM appearances WHERE played GROUP BY player_id)
"""


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * {a} / {b}, 1) END"


query(
    "c01_players_by_matches",
    lambda c: ld.players_by_matches(c.appearances),
    "SELECT player_id, count(DISTINCT match_id) matches FROM appearances WHERE played GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
query("c02_players_by_wins", lambda c: ld.players_by_wins(c.appearances), _RESULTS + f"SELECT player_id, matches, wins, {_pct('wins', 'matches')} rate FROM r ORDER BY wins DESC, player_id LIMIT 10")
query(
    "c03_players_by_rate",
    lambda c: ld.players_by_rate(c.appearances),
    _RESULTS + f"SELECT player_id, matches, wins, {_pct('wins', 'matches')} rate FROM r WHERE matches >= 5 ORDER BY CAST(wins AS DOUBLE) / matches DESC, wins DESC, player_id LIMIT 10",
)
query(
    "c04_match_points_records",
    lambda c: ld.match_points_records(c.appearances),
    "SELECT player_id, match_id, day, points FROM appearances WHERE played AND points > 0 ORDER BY points DESC, match_id, player_id LIMIT 10",
)
query(
    "c05_players_by_defeats",
    lambda c: ld.players_by_defeats(c.appearances),
    _RESULTS + f"SELECT player_id, matches, defeats, {_pct('defeats', 'matches')} rate FROM r ORDER BY defeats DESC, player_id LIMIT 10",
)
for _n, _flag in (("c06_captaincies", "captain"), ("c07_libero_appearances", "libero")):
    query(
        _n,
        lambda c, flag=_flag: ld.players_by_flag(c.appearances, flag),
        f"SELECT player_id, count(*) times FROM appearances WHERE played AND {_flag} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    )
query(
    "c08_most_loyal",
    lambda c: ld.most_loyal(c.appearances),
    "SELECT player_id, team_id, count(DISTINCT match_id) matches FROM appearances WHERE played GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10",
)
query(
    "c09_top_scorers",
    lambda c: ld.top_scorers(c.appearances),
    """SELECT player_id, CAST(sum(points) AS BIGINT) points, count(DISTINCT match_id) matches, round(CAST(sum(points) AS DOUBLE) / count(DISTINCT match_id), 2) per_match
    FROM appearances WHERE played AND points > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
query(
    "c10_top_servers",
    lambda c: ld.top_servers(c.appearances),
    """SELECT player_id, CAST(sum(serves) AS BIGINT) serves, max(longest_run) longest_run, count(DISTINCT match_id) matches,
    round(CAST(sum(serves) AS DOUBLE) / count(DISTINCT match_id), 2) per_match FROM appearances WHERE played AND serves > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
_STREAKS = """,
capped AS (SELECT player_id FROM appearances WHERE played GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50),
x AS (SELECT a.player_id, day, match_id, sets_for > sets_against won FROM appearances a JOIN capped USING (player_id) WHERE played),
y AS (SELECT *, sum(CASE WHEN won THEN 0 ELSE 1 END) OVER (PARTITION BY player_id ORDER BY day, match_id) island FROM x),
runs AS (SELECT player_id, island, count(*) FILTER (won) AS run FROM y GROUP BY 1, 2),
streaks AS (SELECT player_id, max(run) record, arg_max(run, island) AS current, (SELECT count(*) FROM x WHERE x.player_id = runs.player_id) matches FROM runs GROUP BY 1)
"""
query("c11_win_streaks", lambda c: ld.win_streaks(c.appearances), _STREAKS + "SELECT * FROM streaks WHERE record >= 3 ORDER BY record DESC, current DESC, player_id LIMIT 10")
query("c12_current_streaks", lambda c: ld.current_streaks(c.appearances), _STREAKS + "SELECT * FROM streaks WHERE record >= 3 AND current >= 2 ORDER BY current DESC, record DESC, player_id LIMIT 10")
query(
    "c13_closest_matches",
    lambda c: ld.closest_matches(c.matches),
    """SELECT match_id, day, points_a, points_b, abs(points_a - points_b) gap FROM matches WHERE played AND NOT forfeit AND points_a > 0 AND points_b > 0
    ORDER BY gap, points_a + points_b DESC, match_id LIMIT 10""",
)
query(
    "c14_highest_sets",
    lambda c: ld.highest_sets(c.matches, c.sets),
    """SELECT match_id, number, score_a, score_b, score_a + score_b total, abs(score_a - score_b) gap FROM sets JOIN (SELECT match_id FROM matches WHERE played) USING (match_id)
    WHERE score_a >= 25 OR score_b >= 25 OR (number = 5 AND (score_a >= 15 OR score_b >= 15)) ORDER BY total DESC, gap, match_id, number LIMIT 10""",
)
query(
    "c15_widest_sets",
    lambda c: ld.widest_sets(c.matches, c.sets),
    """SELECT match_id, number, abs(score_a - score_b) gap, CASE WHEN score_a > score_b THEN team_a ELSE team_b END dominant
    FROM sets JOIN (SELECT match_id, team_a, team_b FROM matches WHERE played) USING (match_id) ORDER BY gap DESC, match_id, number LIMIT 10""",
)
query(
    "c16_comebacks",
    lambda c: ld.comebacks(c.matches, c.sets),
    """,
l AS (SELECT match_id, sum(CASE WHEN score_a > score_b THEN 1 ELSE -1 END) OVER (PARTITION BY match_id ORDER BY number) AS lead FROM sets),
g AS (SELECT match_id, min(lead) low, max(lead) high FROM l GROUP BY 1),
d AS (SELECT match_id, day, CASE WHEN sets_a > sets_b THEN team_a ELSE team_b END winner,
  CAST(CASE WHEN sets_a > sets_b THEN greatest(0, -low) ELSE greatest(0, high) END AS BIGINT) deficit
  FROM matches JOIN g USING (match_id) WHERE played AND NOT forfeit AND sets_a + sets_b = 5)
SELECT * FROM d WHERE deficit >= 1 ORDER BY deficit DESC, day, match_id LIMIT 10""",
)
query(
    "c17_longest_matches",
    lambda c: ld.longest_matches(c.matches),
    """, t AS (SELECT match_id, day, points_a + points_b points, minutes FROM matches WHERE played AND minutes IS NOT NULL ORDER BY points DESC, match_id LIMIT 100)
SELECT * FROM t ORDER BY minutes DESC, points DESC, match_id LIMIT 10""",
)
query(
    "c18_most_points_matches",
    lambda c: ld.most_points_matches(c.matches),
    "SELECT match_id, day, points_a + points_b points FROM matches WHERE played AND minutes IS NOT NULL ORDER BY points DESC, match_id LIMIT 10",
)
query(
    "c19_teams_by_rate",
    lambda c: ld.teams_by_rate(c.sides),
    f""", t AS (SELECT team_id, count(*) matches, count(*) FILTER (sets_for > sets_against) wins FROM sides WHERE played GROUP BY 1 HAVING count(*) >= 5)
SELECT *, {_pct("wins", "matches")} rate FROM t ORDER BY rate DESC, wins DESC, team_id LIMIT 10""",
)
for _n, _lost in (("c20_clean_sheets", 0), ("c21_tie_break_wins", 2)):
    query(
        _n,
        lambda c, lost=_lost: ld.teams_by_score(c.sides, lost),
        f"SELECT team_id, count(*) times FROM sides WHERE played AND sets_for = 3 AND sets_against = {_lost} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    )
query(
    "c22_clubs_by_wins",
    lambda c: ld.clubs_by_wins(c.sides, c.teams),
    f""", t AS (SELECT club_id, count(*) matches, count(*) FILTER (sets_for > sets_against) wins FROM sides JOIN teams USING (team_id) WHERE played GROUP BY 1)
SELECT *, {_pct("wins", "matches")} rate FROM t ORDER BY wins DESC, club_id LIMIT 10""",
)
query(
    "c23_referees_by_matches",
    lambda c: ld.referees_by_matches(c.matches),
    "SELECT referee_id, count(DISTINCT match_id) matches FROM matches WHERE played GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
query(
    "c24_report_document",
    lambda c: ld.as_documents({"matches": ld.players_by_matches(c.appearances), "loyal": ld.most_loyal(c.appearances), "referees": ld.referees_by_matches(c.matches)}),
    """,
a AS (SELECT player_id, count(DISTINCT match_id) matches FROM appearances WHERE played GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
b AS (SELECT player_id, team_id, count(DISTINCT match_id) matches FROM appearances WHERE played GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10),
c AS (SELECT referee_id, count(DISTINCT match_id) matches FROM matches WHERE played GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'matches' board, '{"player_id":' || player_id || ',"matches":' || matches || '}' line FROM a
UNION ALL SELECT 'loyal', '{"player_id":' || player_id || ',"team_id":' || team_id || ',"matches":' || matches || '}' FROM b
UNION ALL SELECT 'referees', '{"referee_id":' || referee_id || ',"matches":' || matches || '}' FROM c""",
)
query(
    "c25_filter_options",
    lambda c: ld.filter_options(c.matches),
    "SELECT DISTINCT 'season' AS option, CAST(season AS VARCHAR) AS value FROM matches WHERE played UNION SELECT DISTINCT 'competition', competition FROM matches WHERE played",
)
query("c26_signature", lambda c: ld.signature(c.matches), "SELECT count(*) matches, max(day) latest FROM matches WHERE played")


_VERSIONED = ("match_id", "season", "day", "team_a", "team_b", "sets_a", "sets_b", "points_a", "points_b", "forfeit", "played")
query(
    "c26_content_versions",
    lambda c: ld.content_version(c.matches.select(*_VERSIONED), "season"),
    "SELECT season, count(*) AS rows, CAST(sum(CAST(CAST('0x' || md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '\\N')" for k in sorted(_VERSIONED)) + "))[1:15] AS BIGINT) AS HUGEINT)) AS VARCHAR) AS version FROM matches GROUP BY season",
)


def _board_sql(name: str) -> str:
    key, figure, least = ld.BOARDS[name]
    value = f"CAST({figure} AS DOUBLE)"
    return f"SELECT '{name}' AS board, row_number() OVER (ORDER BY {value} {'ASC' if least else 'DESC'}, {key}) AS place, CAST({key} AS BIGINT) AS id, {value} AS figure FROM ({ORACLES[name]})"


def _report(c):
    """All boards over views that are worked out once and stored."""
    kept = Contest(c.spark, c.sf_dir)
    kept.matches = stored(c.matches, "matches")
    kept.sets = stored(c.sets, "sets")
    kept.appearances = stored(c.appearances.where("played").select("match_id", "player_id", "team_id", "day", "played", "points", "serves", "longest_run", "captain", "libero", "sets_for", "sets_against"), "appearances")
    return ld.whole_report({name: PLANS[name](kept) for name in ld.BOARDS})


query("c24_whole_report", _report, " UNION ALL ".join(map(_board_sql, ld.BOARDS)), base=False)
