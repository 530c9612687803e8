"""Queries over presence on court, remaining scalars, swaps, markers and coaches."""

from pyspark.sql import functions as F

from rallyframe.functions import geo
from rallyframe.functions import names as nm
from rallyframe.functions import scalars as sc
from rallyframe.operators import points as pt
from rallyframe.operators import relational as rl
from rallyframe.plans.more import _cycled, _values
from rallyframe.plans.registry import query
from rallyframe.plans.tables import _LINES_OF_SETS, _points

_PRESENCE = (
    _LINES_OF_SETS
    + """,
pe AS (SELECT *, sum(CASE WHEN kind = 'point' THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY ts, event_id) pos, sum(CASE WHEN kind = 'point' THEN 1 ELSE 0 END) OVER (PARTITION BY set_id) AS n FROM tm),
st AS (SELECT set_id, called_by AS side, event_id % 6 + 1 slot, pos, event_id player_id, n, 1 later FROM pe WHERE kind = 'substitution'
  UNION ALL SELECT set_id, s.side, g.slot, 0, -g.slot, n, 0 FROM (SELECT set_id, max(n) AS n FROM pe GROUP BY 1), (VALUES ('A'), ('B')) s(side), (SELECT unnest(range(1, 7)) slot) g),
sp AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY set_id, side, slot ORDER BY pos, later, player_id), n) fin FROM st),
iv AS (SELECT sp.set_id, side, slot, player_id, CAST(pos AS BIGINT) from_x, CAST(fin AS BIGINT) to_x,
  coalesce(CASE WHEN side = 'A' THEN q.score_a ELSE q.score_b END, 0) - coalesce(CASE WHEN side = 'A' THEN p.score_a ELSE p.score_b END, 0) won,
  coalesce(CASE WHEN side = 'A' THEN q.score_b ELSE q.score_a END, 0) - coalesce(CASE WHEN side = 'A' THEN p.score_b ELSE p.score_a END, 0) lost
  FROM sp LEFT JOIN po p ON p.set_id = sp.set_id AND p.x = pos LEFT JOIN po q ON q.set_id = sp.set_id AND q.x = fin)
"""
)


def _presence(c):
    return pt.presence(pt.timeline(c.rallies))


query("g3_presence", lambda c: _presence(c), _PRESENCE + "SELECT * FROM iv")
query(
    "g8_on_court",
    lambda c: pt.on_court(_presence(c)),
    _PRESENCE + "SELECT set_id, side, player_id, count(*) intervals, CAST(sum(to_x - from_x) AS BIGINT) points, CAST(sum(won - lost) AS BIGINT) plus_minus FROM iv GROUP BY 1, 2, 3",
)
query(
    "g11_slot_stats",
    lambda c: pt.slot_stats(_presence(c)),
    _PRESENCE
    + """, bp AS (SELECT side, slot, player_id, count(*) AS n, sum(to_x - from_x) points FROM iv GROUP BY 1, 2, 3)
SELECT side, slot, CAST(sum(n) AS BIGINT) appearances, CAST(sum(points) AS BIGINT) points, arg_max(player_id, (points, -player_id)) dominant FROM bp GROUP BY 1, 2""",
)
query(
    "g12_face_to_face",
    lambda c: pt.face_to_face(pt.phases(_points(c))),
    _LINES_OF_SETS
    + """, sd AS (SELECT set_id, s.side, server = s.side serving, scored_by = s.side won FROM po, (VALUES ('A'), ('B')) s(side)),
n AS (SELECT set_id, side, count(*) FILTER (serving) serves, count(*) FILTER (serving AND won) breaks, count(*) FILTER (NOT serving) receptions, count(*) FILTER (NOT serving AND won) side_outs FROM sd GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN serves = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * breaks / serves, 1) END break_pct, CASE WHEN receptions = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(100 AS DOUBLE) * side_outs / receptions, 1) END side_out_pct FROM n),
l AS (SELECT set_id, side, u.k AS metric, u.v AS value FROM f, LATERAL (VALUES ('serves', CAST(serves AS DOUBLE)), ('breaks', CAST(breaks AS DOUBLE)), ('receptions', CAST(receptions AS DOUBLE)), ('side_outs', CAST(side_outs AS DOUBLE)), ('break_pct', break_pct), ('side_out_pct', side_out_pct)) u(k, v))
SELECT set_id, metric, max(value) FILTER (side = 'A') a, max(value) FILTER (side = 'B') b FROM l GROUP BY 1, 2""",
)
query(
    "g17_score_path",
    lambda c: c.sides.where("played").select("season", "team_id", "match_id", "day", "side", F.when(F.col("sets_for") > F.col("sets_against"), 1).otherwise(-1).alias("step")).transform(_running),
    "SELECT season, team_id, match_id, day, side, CAST(sum(CASE WHEN sets_for > sets_against THEN 1 ELSE -1 END) OVER (PARTITION BY season, team_id ORDER BY day, match_id, side) AS BIGINT) balance FROM sides WHERE played",
)


def _running(df):
    from pyspark.sql import Window

    return df.select("season", "team_id", "match_id", "day", "side", F.sum("step").over(Window.partitionBy("season", "team_id").orderBy("day", "match_id", "side")).alias("balance"))


def _cases(name, rows, names, plan):
    """A query over the orders' keys whose inputs are the first value of each row and whose answers are the others."""
    answers = ", ".join(names)
    query(name, lambda c: plan(_cycled(c, [r[0] for r in rows])), f"SELECT o_orderkey id, {answers} FROM orders JOIN {_values(rows, ('raw', *names))} ON k = o_orderkey % {len(rows)}", base=False)


_text = lambda c: F.when(c.isNotNull(), c.cast("string"))
_cases("k1_plain_upper", (("Élan  d'Or ", "ELAN D'OR"), ("ça va", "CA VA"), ("", "")), ("u",), lambda d: d.select("id", sc.plain_upper(F.col("v")).alias("u")))
_cases(
    "k4_ages",
    (("U13 filles", "true", "13", "2012", "13"), ("Cadets", "true", "18", "2007", "18"), ("Seniors", "false", None, None, None)),
    ("youth", "age_limit", "born", "oldest"),
    lambda d: d.select("id", sc.is_youth(F.col("v")).cast("string").alias("youth"), _text(sc.age_limit(F.col("v"))).alias("age_limit"), _text(sc.earliest_birth_year(F.col("v"), F.lit(2025))).alias("born"), _text(sc.oldest_age(sc.earliest_birth_year(F.col("v"), F.lit(2025)), 2025)).alias("oldest")),
)
_cases(
    "k7_level_ranks",
    (
        ("R1", "9", "REGIONAL"), ("Élite", "15", "NATIONAL"), ("d4", "1", "DEPARTEMENTAL"), ("Loisir", "0", "LOISIR"), ("??", None, None), ("Départementale 2", "3", "DEPARTEMENTAL"), ("régionale 3", "7", "REGIONAL"),
        ("Nationale 2", "12", "NATIONAL"), ("Ligue A", "17", "NATIONAL"), ("Pré-nationale", "10", "REGIONAL"), ("pre-regional", "6", "DEPARTEMENTAL"), ("Accession N3", "10", "REGIONAL"), ("Coupe de France", "18", "NATIONAL"), ("", None, None),
    ),
    ("lr", "echelon"),
    lambda d: d.select("id", _text(sc.level_rank(F.col("v"))).alias("lr"), sc.echelon_of(sc.level_rank(F.col("v"))).alias("echelon")),
)
_cases(
    "k9_resolved_scores",
    (("3-1|3/1|", "3/1", "export", "false"), ("3-1|3/2|", "3/1", "export", "true"), ("|P/3|", "P/3", "pdf", "false"), ("||3/0", "3/0", None, "false"), ("x|y|z", None, None, "false")),
    ("score", "origin", "conflict"),
    lambda d: d.select("id", sc.resolved_score(*(F.split("v", r"\|")[k] for k in range(3))).alias("r")).select("id", "r.score", F.col("r.source").alias("origin"), F.col("r.conflict").cast("string").alias("conflict")),
)
_cases("k11_shirts", (("007", "7"), ("0", "0"), ("12", "12"), (" 05", "5")), ("shirt",), lambda d: d.select("id", sc.shirt_number(F.col("v")).alias("shirt")))
_cases("k13_season_ends", (("2024-2025", "2025"), ("24/25", "2025"), ("99-00", "2100"), ("saison 2023", "2023"), ("x", None)), ("ends",), lambda d: d.select("id", _text(sc.season_end(F.col("v"))).alias("ends")))
_cases(
    "k16_set_lists",
    (("25-18,16-25", '[{"a":25,"b":18},{"a":16,"b":25}]'), ("25/23, x", '[{"a":25,"b":23}]'), ("", "[]")),
    ("sets",),
    lambda d: d.select("id", F.to_json(sc.set_list(F.col("v"))).alias("sets")),
)
_cases(
    "k17_competition_names",
    (("Régionale 2 Masculine Poule A", "MASCULIN", "SENIOR", "R2", "2", "CHAMPIONNAT", "POULE"), ("Coupe de France M15 Féminine Finale", "FEMININ", "M15", "JEUNES CDF", None, "COUPE", "FINALE"), ("Tournoi loisir mixte brassage", "MIXTE", None, "LOISIR", None, "TOURNOI", "BRASSAGE")),
    ("gender", "age", "level", "division", "kind", "phase"),
    lambda d: d.select("id", sc.competition_info(F.col("v")).alias("i")).select("id", "i.gender", "i.age", "i.level", "i.division", "i.kind", "i.phase"),
)
_cases(
    "k18_youth_pools",
    (("CYB", "M18", "CMX", "Y"), ("BGC", "M13", "BFX", "G"), ("CC", "M18", "CMX", None), ("ZZ", None, None, "Z")),
    ("age", "division", "zone"),
    lambda d: d.select("id", sc.youth_pool(F.col("v")).alias("y")).select("id", "y.age", "y.division", "y.zone"),
)
_cases(
    "i9_departments",
    (("73110 VAL GELON", "73"), ("23 rue X, 20250 CORTE", "2B"), ("97400 ST DENIS", "974"), ("GRENOBLE", None)),
    ("department",),
    lambda d: d.select("id", geo.department_of_address(F.col("v")).alias("department")),
)
_cases(
    "i13_swapped_sides",
    (("OISE 2|OISE 5|OISE 5|OISE 2", "true"), ("NANTES VB|REDON|NANTES VOLLEY|X", "false"), ("NANTES VB|REDON|REDON VC|X", "true"), ("A|B||", "false"), ("|||", "false"), ("NIORT|SETE|NIORT|SETE", "false")),
    ("inverted",),
    lambda d: nm.with_swaps(d.select("id", *(F.nullif(F.split("v", r"\|")[k], F.lit("")).alias(c) for k, c in enumerate("abxy"))), *"abxy").select("id", F.col("swapped").cast("string").alias("inverted")),
)
query(
    "i8_outliers",
    lambda c: geo.outliers(
        c.table("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").cast("string").alias("department"), (45 + F.pmod("c_custkey", F.lit(40)) / 10.0).alias("lat"), F.lit(4.0).alias("lon")),
        c.clubs.select(F.col("club_id").cast("string").alias("department"), (45 + F.col("club_id") / 10.0).alias("lat"), F.lit(4.0).alias("lon")),
    ).select("entity_id", "department"),
    """SELECT c_custkey entity_id, CAST(c_nationkey AS VARCHAR) department FROM customer
WHERE abs((45 + c_custkey % 40 / CAST(10 AS DOUBLE)) - (45 + c_nationkey / CAST(10 AS DOUBLE))) * pi() / 180 * 6371 > 120""",
    base=False,
)
query(
    "i10_markers",
    lambda c: c.clubs.select("league_id", F.lit("club").alias("kind"), F.col("club_id").alias("id"), F.col("club").alias("name")).unionByName(
        c.teams.join(c.clubs.select("club_id", "league_id"), "club_id").select("league_id", F.lit("team").alias("kind"), F.col("team_id").alias("id"), F.col("team").alias("name"))
    ),
    "SELECT league_id, 'club' kind, club_id id, club AS name FROM clubs UNION ALL SELECT league_id, 'team', team_id, team FROM teams JOIN clubs USING (club_id)",
)
query("a24_browse", lambda c: rl.browse(c.players, ["player_id", "player"], "brand = 'Brand#2'", ["player_id"], 10, 5), "SELECT player_id, player FROM players WHERE brand = 'Brand#2' ORDER BY player_id LIMIT 10 OFFSET 5")
