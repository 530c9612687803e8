"""Queries over service sheets, coaches and pages."""

from pyspark.sql import functions as F

from rallyframe.operators import pages as pg
from rallyframe.operators import service as sv
from rallyframe.plans.registry import query
from rallyframe.plans.tables import _LINES_OF_SETS
from rallyframe.sources.sheets import lineups, service_sheets, staff
from rallyframe.sources.storage import stored

#: The turns straight from the points: what the operators must find again from the sheets.
_TURNS = (
    _LINES_OF_SETS
    + """,
fin AS (SELECT set_id, CASE WHEN arg_max(y, x) > 0 THEN 'A' ELSE 'B' END winner FROM po GROUP BY 1 HAVING arg_max(y, x) <> 0),
kp AS (SELECT po.*, winner FROM po JOIN fin USING (set_id) QUALIFY x <= max(x) FILTER (scored_by = winner) OVER (PARTITION BY po.set_id)),
rc AS (SELECT *, CASE WHEN server <> lag(server) OVER (PARTITION BY set_id ORDER BY x) THEN 1 ELSE 0 END cg FROM kp),
rr AS (SELECT *, sum(cg) OVER (PARTITION BY set_id ORDER BY x) AS run FROM rc),
tu AS (SELECT set_id, run, server AS side, winner, min(x) x0, max(x) x1, max(score_a) ea, max(score_b) eb, max(CASE WHEN server = 'A' THEN score_a ELSE score_b END) score,
  min(score_a - CASE WHEN scored_by = 'A' THEN 1 ELSE 0 END) a0, min(score_b - CASE WHEN scored_by = 'B' THEN 1 ELSE 0 END) b0, max(x) = max(max(x)) OVER (PARTITION BY set_id) AS final FROM rr GROUP BY 1, 2, 3, 4),
so AS (SELECT set_id, side, run, score FROM tu UNION ALL SELECT set_id, winner, run + 1, CASE WHEN winner = 'A' THEN ea ELSE eb END FROM tu WHERE final AND side <> winner),
sn AS (SELECT *, row_number() OVER (PARTITION BY set_id, side ORDER BY run) - 1 AS turn FROM so),
tn AS (SELECT tu.set_id, CAST(run AS BIGINT) AS n, tu.side, (row_number() OVER (PARTITION BY tu.set_id, tu.side ORDER BY run) - 1 + CASE WHEN tu.side = 'B' THEN 1 ELSE 0 END) % 6 + 1 AS "position",
  a0 score_a, b0 score_b, ea end_a, eb end_b, CASE WHEN side = 'A' THEN ea - a0 ELSE eb - b0 END points, final AND side = winner wins_set FROM tu)
"""
)
_SERVED = (
    _TURNS
    + """,
sb AS (SELECT set_id, called_by AS side, event_id % 6 + 1 AS "position", score_a + score_b AS happened, event_id, CAST(event_id % 80 + 10 AS VARCHAR) entrant FROM tm WHERE kind = 'substitution'),
sd AS (SELECT tn.set_id, tn.n, tn.side, tn."position", any_value(score_a) score_a, any_value(score_b) score_b, any_value(points) points, any_value(wins_set) wins_set,
  coalesce(arg_max(entrant, (happened, event_id)), CAST(tn."position" AS VARCHAR)) player
  FROM tn LEFT JOIN sb ON sb.set_id = tn.set_id AND sb.side = tn.side AND sb."position" = tn."position" AND happened <= score_a + score_b GROUP BY 1, 2, 3, 4)
"""
)


def _turns(c):
    return sv.service_turns(service_sheets(c.rallies))


def _served(c):
    return sv.servers(_turns(c), lineups(c.rallies))


query("g1_service_order", lambda c: sv.service_order(service_sheets(c.rallies)), _TURNS + """SELECT set_id, side, turn, (turn + CASE WHEN side = 'B' THEN 1 ELSE 0 END) % 6 + 1 AS "position", score FROM sn""")
query("g2_service_turns", _turns, _TURNS + "SELECT * FROM tn")
query("g5_servers", _served, _SERVED + "SELECT sd.set_id, sd.n, sd.side, sd.\"position\", sd.score_a, sd.score_b, tn.end_a, tn.end_b, sd.points, sd.wins_set, player FROM sd JOIN tn ON sd.set_id = tn.set_id AND sd.n = tn.n")
query(
    "f1_server_figures",
    lambda c: sv.server_figures(_served(c)),
    _SERVED
    + """SELECT set_id, side, player, count(*) turns, CAST(sum(points) AS BIGINT) points, count(*) FILTER (points > 0) breaking_turns, max(points) longest,
  CAST(sum(points + CASE WHEN wins_set THEN 0 ELSE 1 END) AS BIGINT) rallies, count(*) FILTER (wins_set) set_wins, round(CAST(sum(points) AS DOUBLE) / count(*), 2) points_per_turn FROM sd GROUP BY 1, 2, 3""",
)
query("g7_rotation_figures", lambda c: sv.rotation_figures(_turns(c)), _TURNS + 'SELECT set_id, side, "position", count(*) turns, CAST(sum(points) AS BIGINT) won, count(*) FILTER (NOT wins_set) lost FROM tn GROUP BY 1, 2, 3')
query(
    "g10_side_outs",
    lambda c: sv.side_outs(_turns(c)),
    _TURNS
    + """, sr AS (SELECT set_id, s.side, tn.side = s.side serving, points + CASE WHEN wins_set THEN 0 ELSE 1 END rl, points, wins_set FROM tn, (VALUES ('A'), ('B')) s(side)),
ag AS (SELECT set_id, side, CAST(sum(CASE WHEN serving THEN rl ELSE 0 END) AS BIGINT) served, CAST(sum(CASE WHEN serving THEN points ELSE 0 END) AS BIGINT) breaks,
  CAST(sum(CASE WHEN serving THEN 0 ELSE rl END) AS BIGINT) received, count(*) FILTER (NOT serving AND NOT wins_set) won, count(*) FILTER (NOT serving AND NOT wins_set AND points = 0) at_once FROM sr GROUP BY 1, 2)
SELECT *, CASE WHEN received = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * won / received, 1) END side_out_pct FROM ag""",
)
query(
    "j6_coaches",
    lambda c: pg.coaches(staff(c.sides, c.table("customer"))),
    """, st AS (SELECT match_id, season, team_id, sets_for > sets_against won, CASE r WHEN 'EA' THEN team_id + 1 ELSE (team_id * 7 + season) % 100 + 1 END person FROM sides, (VALUES ('EA'), ('EB')) v(r) WHERE played)
SELECT c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 11 AS VARCHAR) END licence, count(DISTINCT match_id) matches, count(DISTINCT team_id) teams, count(DISTINCT season) seasons,
  count(DISTINCT CASE WHEN won THEN (match_id, team_id) END) wins FROM st JOIN customer ON c_custkey = person GROUP BY c_name, c_custkey""",
)


def _page(name, blocks):
    """Blocks: (name, plan of the figures, SQL of the same, id column, metrics, item column or None)."""
    select = "SELECT CAST({i} AS VARCHAR) AS id, '{b}' AS block, {t} AS item, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({s}) {b}"
    text = " UNION ALL ".join(select.format(i=i, b=b, t=f"CAST({item} AS VARCHAR)" if item else "CAST(NULL AS VARCHAR)", m=m, s=sql) for b, _, sql, i, metrics, item in blocks for m in metrics)
    query(name, lambda c: pg.page(*(pg.block(b, plan(c), i, metrics, item) for b, plan, _, i, metrics, item in blocks)), text)


_won = "count_if(sets_for > sets_against)"
_n = "count(1)"


def _of(rows, *keys, **figures):
    """Figures (SQL aggregates by name) of the rows by keys."""
    return lambda c: rows(c).groupBy(*keys).agg(*(F.expr(e).alias(k) for k, e in figures.items()))


_played = lambda c: c.appearances.where("played")


def _by_player(c):
    """The played appearances, worked out once for all blocks of a page and stored by player, so that a block's sums need little shuffling."""
    if not hasattr(c, "stored_by_player"):
        c.stored_by_player = stored(_played(c).select("player_id", "season", "team_id", "role", "shirt", "points", "captain", "libero", "sets_for", "sets_against").repartition("player_id"), "appearances")
    return c.stored_by_player


_sides = lambda c: c.sides.where("played")
_placed = lambda c: _sides(c).join(c.teams.join(c.clubs, "club_id"), "team_id")
_people = lambda c: _played(c).join(c.teams.join(c.clubs, "club_id"), "team_id")
_WON = "count(*) FILTER (sets_for > sets_against) wins"
_PLACED = "sides JOIN teams USING (team_id) JOIN clubs USING (club_id) WHERE played"
_PEOPLE = "appearances JOIN teams USING (team_id) JOIN clubs USING (club_id) WHERE played"

_page("j2_player_page", [
    ("totals", _of(_by_player, "player_id", matches=_n, wins=_won, captaincies="count_if(captain)", liberos="count_if(libero)", points="sum(points)", best="max(points)"), f"SELECT player_id, count(*) matches, {_WON}, count(*) FILTER (captain) captaincies, count(*) FILTER (libero) liberos, sum(points) points, max(points) best FROM appearances WHERE played GROUP BY 1", "player_id", ["matches", "wins", "captaincies", "liberos", "points", "best"], None),
    ("seasons", _of(_by_player, "player_id", "season", matches=_n, wins=_won, points="sum(points)", teams="count(DISTINCT team_id)"), f"SELECT player_id, season, count(*) matches, {_WON}, sum(points) points, count(DISTINCT team_id) teams FROM appearances WHERE played GROUP BY 1, 2", "player_id", ["matches", "wins", "points", "teams"], "season"),
    ("roles", _of(_by_player, "player_id", "role", matches=_n), "SELECT player_id, role, count(*) matches FROM appearances WHERE played GROUP BY 1, 2", "player_id", ["matches"], "role"),
    ("shirts", _of(_by_player, "player_id", "shirt", matches=_n), "SELECT player_id, shirt, count(*) matches FROM appearances WHERE played GROUP BY 1, 2", "player_id", ["matches"], "shirt"),
])
_page("j17_team_page", [
    ("totals", _of(_sides, "team_id", matches=_n, wins=_won, home="count_if(side = 'A')", sets_for="sum(sets_for)", sets_against="sum(sets_against)", forfeits="count_if(forfeit)"), f"SELECT team_id, count(*) matches, {_WON}, count(*) FILTER (side = 'A') home, sum(sets_for) sets_for, sum(sets_against) sets_against, count(*) FILTER (forfeit) forfeits FROM sides WHERE played GROUP BY 1", "team_id", ["matches", "wins", "home", "sets_for", "sets_against", "forfeits"], None),
    ("seasons", _of(_sides, "team_id", "season", matches=_n, wins=_won, competitions="count(DISTINCT competition)"), f"SELECT team_id, season, count(*) matches, {_WON}, count(DISTINCT competition) competitions FROM sides WHERE played GROUP BY 1, 2", "team_id", ["matches", "wins", "competitions"], "season"),
    ("opponents", _of(_sides, "team_id", "opponent_id", matches=_n, wins=_won), f"SELECT team_id, opponent_id, count(*) matches, {_WON} FROM sides WHERE played GROUP BY 1, 2", "team_id", ["matches", "wins"], "opponent_id"),
    ("roster", _of(_played, "team_id", "player_id", matches=_n, points="sum(points)"), "SELECT team_id, player_id, count(*) matches, sum(points) points FROM appearances WHERE played GROUP BY 1, 2", "team_id", ["matches", "points"], "player_id"),
])
_page("j21_club_page", [
    ("teams", _of(_placed, "club_id", "team_id", matches=_n, wins=_won), f"SELECT club_id, team_id, count(*) matches, {_WON} FROM {_PLACED} GROUP BY 1, 2", "club_id", ["matches", "wins"], "team_id"),
    ("seasons", _of(_placed, "club_id", "season", matches=_n, wins=_won, teams="count(DISTINCT team_id)", competitions="count(DISTINCT competition)"), f"SELECT club_id, season, count(*) matches, {_WON}, count(DISTINCT team_id) teams, count(DISTINCT competition) competitions FROM {_PLACED} GROUP BY 1, 2", "club_id", ["matches", "wins", "teams", "competitions"], "season"),
    ("players", _of(_people, "club_id", "season", players="count(DISTINCT player_id)"), f"SELECT club_id, season, count(DISTINCT player_id) players FROM {_PEOPLE} GROUP BY 1, 2", "club_id", ["players"], "season"),
])
_page("j18_territory_page", [
    ("totals", _of(_placed, "league_id", clubs="count(DISTINCT club_id)", teams="count(DISTINCT team_id)", matches="count(DISTINCT match_id)"), f"SELECT league_id, count(DISTINCT club_id) clubs, count(DISTINCT team_id) teams, count(DISTINCT match_id) matches FROM {_PLACED} GROUP BY 1", "league_id", ["clubs", "teams", "matches"], None),
    ("players", _of(_people, "league_id", "season", players="count(DISTINCT player_id)"), f"SELECT league_id, season, count(DISTINCT player_id) players FROM {_PEOPLE} GROUP BY 1, 2", "league_id", ["players"], "season"),
    ("clubs", _of(_placed, "league_id", "club_id", matches=_n, wins=_won), f"SELECT league_id, club_id, count(*) matches, {_WON} FROM {_PLACED} GROUP BY 1, 2", "league_id", ["matches", "wins"], "club_id"),
])
_pool = lambda rows: lambda c: rows(c).withColumn("pool", F.concat_ws(" ", "season", "competition"))
_POOL = "CAST(season AS VARCHAR) || ' ' || competition pool"
_page("j19_pool_page", [
    ("calendar", _of(_pool(lambda c: c.matches), "pool", matches=_n, played="count_if(played)", forfeits="count_if(forfeit)", match_days="count(DISTINCT day)"), f"SELECT {_POOL}, count(*) matches, count(*) FILTER (played) played, count(*) FILTER (forfeit) forfeits, count(DISTINCT day) match_days FROM matches GROUP BY 1", "pool", ["matches", "played", "forfeits", "match_days"], None),
    ("teams", _of(_pool(_sides), "pool", "team_id", matches=_n, wins=_won, points_for="sum(points_for)", points_against="sum(points_against)"), f"SELECT {_POOL}, team_id, count(*) matches, {_WON}, sum(points_for) points_for, sum(points_against) points_against FROM sides WHERE played GROUP BY 1, 2", "pool", ["matches", "wins", "points_for", "points_against"], "team_id"),
    ("scores", _of(_pool(lambda c: c.matches.where("played").withColumn("score", F.concat_ws("-", F.greatest("sets_a", "sets_b"), F.least("sets_a", "sets_b")))), "pool", "score", matches=_n), f"SELECT {_POOL}, CAST(greatest(sets_a, sets_b) AS VARCHAR) || '-' || CAST(least(sets_a, sets_b) AS VARCHAR) score, count(*) matches FROM matches WHERE played GROUP BY 1, 2", "pool", ["matches"], "score"),
])
_page("j12_competition_cards", [
    ("card", _of(lambda c: _placed(c), "competition", matches="count(DISTINCT match_id)", teams="count(DISTINCT team_id)", clubs="count(DISTINCT club_id)", leagues="count(DISTINCT league_id)", first_season="min(season)", last_season="max(season)"), f"SELECT competition, count(DISTINCT match_id) matches, count(DISTINCT team_id) teams, count(DISTINCT club_id) clubs, count(DISTINCT league_id) leagues, min(season) first_season, max(season) last_season FROM {_PLACED} GROUP BY 1", "competition", ["matches", "teams", "clubs", "leagues", "first_season", "last_season"], None),
    ("seasons", _of(lambda c: c.matches, "competition", "season", matches=_n, played="count_if(played)"), "SELECT competition, season, count(*) matches, count(*) FILTER (played) played FROM matches GROUP BY 1, 2", "competition", ["matches", "played"], "season"),
])
