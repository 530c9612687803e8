"""Queries over presence on court, positions and rally figures, with their SQL."""

from rallyframe.operators import court as co
from rallyframe.operators import service as sv
from rallyframe.plans.registry import query
from rallyframe.plans.sheets import _TURNS
from rallyframe.sources.sheets import court_sides, service_sheets, set_context

_COURT = (
    _TURNS
    + """,
sh AS (SELECT set_id, max(ea) score_a, max(eb) score_b, set_id // 5 match_id, set_id % 5 + 1 number, set_id % 20 + 15 AS minutes FROM tu GROUP BY set_id),
c0 AS (SELECT tm.set_id, called_by AS side, event_id % 6 + 1 AS pos, tm.score_a, tm.score_b, tm.score_a + tm.score_b AS happened, event_id,
  row_number() OVER (PARTITION BY tm.set_id, called_by, event_id % 6 ORDER BY ts, event_id) k FROM tm WHERE kind = 'substitution'),
c1 AS (SELECT *, CAST(CASE WHEN k % 2 = 1 THEN pos * 10 + event_id % 10 ELSE pos END AS VARCHAR) entrant FROM c0),
c2 AS (SELECT *, coalesce(lag(entrant) OVER (PARTITION BY set_id, side, pos ORDER BY k), CAST(pos AS VARCHAR)) leaver FROM c1),
cs AS (SELECT c2.* FROM c2 JOIN sh USING (set_id) WHERE happened <= sh.score_a + sh.score_b),
sl AS (SELECT set_id, side, CAST(p AS VARCHAR) player FROM sh, (VALUES ('A'), ('B')) s(side), range(1, 7) r(p)),
ev AS (SELECT set_id, side, player, 1 kind, CAST(-1 AS BIGINT) happened, CAST(0 AS BIGINT) a, CAST(0 AS BIGINT) b FROM sl
  UNION ALL SELECT set_id, side, entrant, 1, happened, score_a, score_b FROM cs UNION ALL SELECT set_id, side, leaver, 0, happened, score_a, score_b FROM cs),
ef AS (SELECT * FROM (SELECT *, kind <> coalesce(lag(kind) OVER (PARTITION BY set_id, side, player ORDER BY happened, kind, a, b), 0) moved FROM ev) WHERE moved),
s0 AS (SELECT ef.*, coalesce(lead(a) OVER w, score_a) to_a, coalesce(lead(b) OVER w, score_b) to_b FROM ef JOIN sh USING (set_id) WINDOW w AS (PARTITION BY set_id, side, player ORDER BY happened, kind, a, b)),
st AS (SELECT set_id, side, player, row_number() OVER (PARTITION BY set_id, side, player ORDER BY happened, a, b) stint, a from_a, b from_b, to_a, to_b,
  CASE WHEN side = 'A' THEN to_a - a ELSE to_b - b END won, CASE WHEN side = 'A' THEN to_b - b ELSE to_a - a END lost FROM s0 WHERE kind = 1)
"""
)
_STANDING = (
    _COURT
    + """,
sx AS (SELECT set_id, side, player, stint, from_a + from_b AS lo, to_a + to_b AS hi FROM st WHERE from_a + from_b < to_a + to_b),
cu AS (SELECT set_id, side, player, stint, lo AS x FROM sx UNION SELECT set_id, side, player, stint, hi FROM sx
  UNION SELECT sx.set_id, sx.side, player, stint, happened FROM sx JOIN cs ON cs.set_id = sx.set_id AND cs.side = sx.side AND happened > lo AND happened < hi),
sg AS (SELECT * FROM (SELECT set_id, side, player, x from_x, lead(x) OVER (PARTITION BY set_id, side, player, stint ORDER BY x) to_x FROM cu) WHERE to_x IS NOT NULL),
oc AS (SELECT sg.set_id, sg.side, sg.player, from_x, to_x, p, coalesce(arg_max(entrant, (happened, event_id)), CAST(p AS VARCHAR)) who
  FROM sg CROSS JOIN range(1, 7) r(p) LEFT JOIN cs ON cs.set_id = sg.set_id AND cs.side = sg.side AND pos = p AND happened <= from_x GROUP BY sg.set_id, sg.side, sg.player, from_x, to_x, p),
sd AS (SELECT set_id, side, player, from_x, to_x, min(p) FILTER (who = player) AS "position" FROM oc GROUP BY ALL)
"""
)
_RALLIES = (
    _STANDING
    + """,
ty AS (SELECT tn.set_id, tn.n, tn.side, any_value(tn."position") pos, any_value(tn.score_a + tn.score_b) began, coalesce(arg_max(entrant, (happened, event_id)), CAST(any_value(tn."position") AS VARCHAR)) served_by
  FROM tn LEFT JOIN cs ON cs.set_id = tn.set_id AND cs.side = tn.side AND cs.pos = tn."position" AND happened <= tn.score_a + tn.score_b GROUP BY 1, 2, 3),
tz AS (SELECT *, coalesce(last_value(CASE WHEN side = 'A' THEN pos END IGNORE NULLS) OVER w, 1) turned_a, coalesce(last_value(CASE WHEN side = 'B' THEN pos END IGNORE NULLS) OVER w, 1) turned_b
  FROM ty WINDOW w AS (PARTITION BY set_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ra AS (SELECT rr.set_id, x, rr.score_a - CASE WHEN scored_by = 'A' THEN 1 ELSE 0 END a, rr.score_b - CASE WHEN scored_by = 'B' THEN 1 ELSE 0 END b, server, scored_by, served_by, turned_a, turned_b
  FROM rr JOIN tz ON tz.set_id = rr.set_id AND tz.n = rr.run),
wi AS (SELECT *, CASE WHEN score_a > score_b THEN 'A' WHEN score_b > score_a THEN 'B' END winner FROM sh),
ms AS (SELECT *, CASE WHEN greatest(wa, wb) IN (2, 3) THEN greatest(wa, wb) ELSE 3 END need FROM (
  SELECT *, count(*) FILTER (winner = 'A') OVER (PARTITION BY match_id) wa, count(*) FILTER (winner = 'B') OVER (PARTITION BY match_id) wb,
    count(*) FILTER (winner = 'A') OVER (PARTITION BY match_id ORDER BY number, set_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before_a,
    count(*) FILTER (winner = 'B') OVER (PARTITION BY match_id ORDER BY number, set_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before_b FROM wi)),
pr AS (SELECT match_id, ra.set_id, x, number, sd.side, player, server = scored_by on_serve, CASE WHEN sd.side = 'A' THEN a ELSE b END mine, CASE WHEN sd.side = 'A' THEN b ELSE a END theirs,
    scored_by = sd.side won, server <> sd.side received, server = sd.side AND server = scored_by AND served_by = player serving,
    ("position" - CASE WHEN sd.side = 'A' THEN turned_a ELSE turned_b END + 6) % 6 + 1 AS zone,
    CASE WHEN sd.side = 'A' THEN before_b ELSE before_a END + 1 >= need match_theirs, CASE WHEN sd.side = 'A' THEN before_a ELSE before_b END + 1 >= need match_mine
  FROM ra JOIN sd ON sd.set_id = ra.set_id AND a + b >= from_x AND a + b < to_x JOIN ms ON ms.set_id = ra.set_id),
pl AS (SELECT *, greatest(mine, theirs) >= CASE WHEN number = 5 THEN 12 ELSE 20 END money, theirs >= CASE WHEN number = 5 THEN 14 ELSE 24 END AND theirs > mine against,
  mine >= CASE WHEN number = 5 THEN 14 ELSE 24 END AND mine > theirs chance FROM pr)
"""
)


def _inputs(c):
    """Court sides and sets of matches."""
    sheets = service_sheets(c.rallies)
    return court_sides(c.rallies, sheets), set_context(sheets)


def _player_rallies(c):
    sides, sets = _inputs(c)
    return co.player_rallies(sv.service_turns(sets), sides, sets)


query("g3_stints", lambda c: co.stint_rows(co.presence(*_inputs(c))), _COURT + "SELECT * FROM st")
query("g5_positions", lambda c: co.standing(co.presence(*_inputs(c))), _STANDING + "SELECT * FROM sd")
query(
    "f1_player_matches",
    lambda c: co.player_matches(*_inputs(c)),
    _COURT
    + """,
kt AS (SELECT set_id, side, entrant player, 1 kind, happened FROM cs UNION ALL SELECT set_id, side, leaver, 0, happened FROM cs),
kl AS (SELECT *, lag(kind) OVER (PARTITION BY set_id, side, player ORDER BY happened, kind) before FROM kt),
kc AS (SELECT set_id, side, player, count(*) FILTER (kind = 1) entries, count(*) FILTER (kind = 0) exits, count(*) FILTER (before = 1 AND kind = 0) in_outs, count(*) FILTER (before = 0 AND kind = 1) out_ins FROM kl GROUP BY ALL),
wi AS (SELECT *, CASE WHEN score_a > score_b THEN 'A' WHEN score_b > score_a THEN 'B' END winner FROM sh),
po2 AS (SELECT set_id, side, player, sum(won) won, sum(lost) lost, arg_max((to_a, to_b), stint) last_at FROM st GROUP BY ALL),
ep AS (SELECT match_id, po2.set_id, po2.side, po2.player, sl.player IS NOT NULL starter, coalesce(entries, 0) entries, coalesce(exits, 0) exits, coalesce(in_outs, 0) in_outs, coalesce(out_ins, 0) out_ins,
    won, lost, last_at = (score_a, score_b) finished, winner, CAST(round(minutes * CASE WHEN score_a + score_b > 0 THEN CAST(won + lost AS DOUBLE) / (score_a + score_b) ELSE 1 END * 1000000) AS BIGINT) AS spent
  FROM po2 JOIN wi USING (set_id) LEFT JOIN sl USING (set_id, side, player) LEFT JOIN kc USING (set_id, side, player)),
tt AS (SELECT match_id, count(*) AS sets, CAST(sum(score_a) AS BIGINT) total_a, CAST(sum(score_b) AS BIGINT) total_b FROM sh GROUP BY 1),
ag AS (SELECT match_id, side, player, count(*) sets_played, count(*) FILTER (winner = side) sets_won, count(*) FILTER (winner <> side) sets_lost, count(*) FILTER (starter) started, count(*) FILTER (finished) finished,
    CAST(sum(entries) AS BIGINT) entries, CAST(sum(exits) AS BIGINT) exits, CAST(sum(in_outs) AS BIGINT) in_outs, CAST(sum(out_ins) AS BIGINT) out_ins, CAST(sum(won) AS BIGINT) won_on, CAST(sum(lost) AS BIGINT) lost_on, round(CAST(sum(spent) AS DOUBLE) / 1000000, 1) AS minutes
  FROM ep WHERE starter OR entries > 0 GROUP BY 1, 2, 3),
fi AS (SELECT *, won_on + lost_on AS points_on, greatest(0, total_a + total_b - won_on - lost_on) AS points_off, greatest(0, CASE WHEN side = 'A' THEN total_a ELSE total_b END - won_on) AS won_off FROM ag JOIN tt USING (match_id)),
fr AS (SELECT *, CASE WHEN points_on > 0 THEN round(CAST(won_on AS DOUBLE) / points_on, 3) ELSE CAST(0 AS DOUBLE) END rate_on, CASE WHEN points_off > 0 THEN round(CAST(won_off AS DOUBLE) / points_off, 3) END rate_off FROM fi)
SELECT match_id, side, player, sets_played, sets_won, sets_lost, started, finished, entries, exits, in_outs, out_ins, points_on, won_on, lost_on, won_on - lost_on AS plus_minus, points_off, won_off, rate_on, rate_off,
  round(rate_on - rate_off, 3) AS difference, CASE WHEN total_a + total_b > 0 THEN round(CAST(points_on AS DOUBLE) / (total_a + total_b), 3) ELSE CAST(0 AS DOUBLE) END presence, minutes, started = sets AND exits = 0 AS whole_match FROM fr""",
)
query(
    "g7_player_zones",
    lambda c: co.zone_figures(_player_rallies(c)),
    _RALLIES + "SELECT match_id, side, player, zone, count(*) played, count(*) FILTER (won) won, count(*) FILTER (NOT won) lost, round(CAST(count(*) FILTER (won) AS DOUBLE) / count(*), 3) rate FROM pl WHERE zone IS NOT NULL GROUP BY 1, 2, 3, 4",
)
query(
    "g7_player_clutch",
    lambda c: co.clutch_figures(_player_rallies(c)),
    _RALLIES
    + ", sv AS (SELECT *, sum(CASE WHEN saved THEN 0 ELSE 1 END) OVER (PARTITION BY set_id, side, player ORDER BY x) AS run FROM (SELECT *, against AND serving AND won saved FROM pl WHERE on_serve)),\n"
    + "sr AS (SELECT match_id, set_id, side, player, run, count(*) saves, count(*) FILTER (match_theirs) match_saves FROM sv WHERE saved GROUP BY ALL),\n"
    + "sm AS (SELECT match_id, side, player, max(saves) most_saves, max(match_saves) most_match_saves FROM sr GROUP BY ALL),\n"
    + "cl AS (SELECT match_id, side, player, "
    + ", ".join(f"count(*) FILTER ({rule}) {name}_played, count(*) FILTER (({rule}) AND won) {name}_won" for name, rule in co.STATES.items())
    + " FROM pl GROUP BY 1, 2, 3)\nSELECT cl.*, coalesce(most_saves, 0) most_saves, coalesce(most_match_saves, 0) most_match_saves FROM cl LEFT JOIN sm USING (match_id, side, player)",
)
