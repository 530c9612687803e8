"""Queries over level moves, brackets, sanctions, sides, status and rebuilt rollups."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions import names as nm
from rallyframe.operators import incidents as inc
from rallyframe.operators import movements as mv
from rallyframe.operators import points as pt
from rallyframe.operators import roles as ro
from rallyframe.operators import rollups as ru
from rallyframe.operators import standings as st
from rallyframe.plans.extra import _cases, _text
from rallyframe.plans.more import _SOLVED, _formations
from rallyframe.plans.registry import query
from rallyframe.plans.tables import _LINES, _LINES_OF_SETS, _SEASONS

# ---------------------------------------------------------------- levels


def _entries(c) -> DataFrame:
    """Teams' levels by season (invented: that of the season's first match); three series a club, and some seasons left out."""
    level = F.min_by(6 - F.substring("competition", 1, 1).cast("int"), F.struct("day", "match_id"))
    each = c.sides.where("played and (team_id + season) % 4 <> 0").groupBy("team_id", "season").agg(level.cast("double").alias("level"))
    return each.join(c.teams.select("team_id", "club_id"), "team_id").select("club_id", F.pmod("team_id", F.lit(3)).alias("series"), "season", "level", (F.col("team_id") % 10 == 9).alias("leisure"))


_MOVES = """,
en AS (SELECT club_id, team_id % 3 series, season, CAST(arg_min(6 - CAST(substr(competition, 1, 1) AS INTEGER), (day, match_id)) AS DOUBLE) AS level, team_id % 10 = 9 leisure
  FROM sides JOIN teams USING (team_id) WHERE played AND (team_id + season) % 4 <> 0 GROUP BY club_id, team_id, season),
se AS (SELECT club_id, season, lead(season) OVER (PARTITION BY club_id ORDER BY season) nx, max(season) OVER (PARTITION BY club_id) lt FROM (SELECT DISTINCT club_id, season FROM en)),
pa AS (SELECT club_id, season season_from, nx season_to, false cumulative FROM se WHERE nx IS NOT NULL UNION ALL SELECT club_id, season, lt, true FROM se WHERE nx < lt),
bl AS (SELECT club_id, series, season, max(level) AS level FROM en WHERE NOT leisure GROUP BY 1, 2, 3),
bo AS (SELECT pa.*, series FROM pa JOIN bl ON bl.club_id = pa.club_id AND bl.season IN (season_from, season_to) GROUP BY ALL),
mo AS (SELECT bo.*, f.level level_from, t.level level_to,
  CASE WHEN f.level IS NULL THEN 'new' WHEN t.level IS NULL THEN 'stopped' WHEN t.level - f.level >= 0.8 THEN 'promotion' WHEN t.level - f.level <= -0.8 THEN 'relegation' ELSE 'stable' END AS status,
  CAST(round_even(t.level - f.level, 0) AS BIGINT) steps
  FROM bo LEFT JOIN bl f ON f.club_id = bo.club_id AND f.series = bo.series AND f.season = season_from LEFT JOIN bl t ON t.club_id = bo.club_id AND t.series = bo.series AND t.season = season_to)
"""
query("j11_level_moves", lambda c: mv.level_moves(_entries(c)), _MOVES + "SELECT * FROM mo")
query(
    "j11_periods",
    lambda c: mv.period_counts(mv.level_moves(_entries(c))),
    _MOVES + "SELECT club_id, season_from, season_to, cumulative, count(*) series, count(*) FILTER (status = 'promotion') promotions, count(*) FILTER (status = 'relegation') relegations FROM mo GROUP BY 1, 2, 3, 4",
)

#: Labels of own choice that a team may have had, by its number and the season.
_LABELS = ("DEP", "D1", "D2", "D4", "PREREG", "R1", "REGIONAL", "R3", "PRENAT", "N2", "N1", "ELITE", "PRO A", "LOISIR", "CDF", "JEUNES DEP")


_LADDER = """, en AS (SELECT DISTINCT club_id, team_id, season, [{labels}][CAST((club_id * 3 + (team_id % 4) * (season % 3)) % {n} AS BIGINT) + 1] AS label FROM sides JOIN teams USING (team_id) WHERE played),
al AS (SELECT * FROM (VALUES {rungs}) v(label, rung)),
h0 AS (SELECT club_id, list(DISTINCT rung) FILTER (rung IS NOT NULL) hs FROM en LEFT JOIN al USING (label) GROUP BY 1),
h AS (SELECT club_id, coalesce(hs, []) hs FROM h0),
f1 AS (SELECT club_id, list_contains(hs, 'LOISIR') loisir, list_contains(hs, 'D4') d4, list_contains(hs, 'D3') d3a, list_contains(hs, 'D2') d2a, list_contains(hs, 'D1') d1a, list_contains(hs, 'DEP') dep, list_contains(hs, 'PREREG') prereg,
  list_contains(hs, 'R4') r4, list_contains(hs, 'R3') r3, list_contains(hs, 'R2') r2, list_contains(hs, 'R1') r1, list_contains(hs, 'REGIONAL') reg, list_contains(hs, 'PRENAT') prenat, list_contains(hs, 'N3') n3a, list_contains(hs, 'N2') n2a,
  list_contains(hs, 'N1') n1, list_contains(hs, 'ELITE') elite, list_contains(hs, 'PRO B') pbx, list_contains(hs, 'PRO A') pa FROM h),
f2 AS (SELECT *, d1a OR (d2a AND prereg AND NOT dep) d1, pbx OR pa pb FROM f1),
f3 AS (SELECT *, d2a OR (d3a AND (d1 OR prereg)) d2, n1 OR elite OR pb top FROM f2),
f4 AS (SELECT *, d3a OR (d4 AND (d2 OR d1 OR prereg)) d3, n2a OR top n2 FROM f3),
st AS (SELECT club_id, unnest(range(16)) k, unnest([loisir, d4, d3, d2, d1 OR dep, prereg, r4, r3, r2, r1 OR reg, prenat, n3a OR n2, n2, top, pb, pa]) there,
  unnest(['LOISIR', 'D4', 'D3', 'D2', 'D1', 'PREREG', 'R4', 'R3', 'R2', 'R1', 'PRENAT', 'N3', 'N2', 'ELITE', 'PRO B', 'PRO A']) rung,
  unnest(['Loisir', 'D4', 'D3', 'D2', CASE WHEN d1 AND dep THEN 'D1 / Dép' WHEN d1 THEN 'D1' ELSE 'Dép' END, 'Préreg', 'R4', 'R3', 'R2', CASE WHEN r1 AND reg THEN 'R1 / Régionale' WHEN r1 THEN 'R1' ELSE 'Régionale' END, 'Prénat', 'N3', 'N2',
    CASE WHEN n1 AND elite THEN 'Élite / N1' WHEN n1 THEN 'N1' ELSE 'Élite' END, 'Pro B', 'Pro A']) AS label FROM f4),
s1 AS (SELECT club_id, k, rung, label, count(*) OVER (PARTITION BY club_id) AS total FROM st WHERE there),
s2 AS (SELECT club_id, k, rung, label FROM s1 UNION ALL SELECT club_id, 9, 'R1', 'Régionale' FROM s1 WHERE total = 1 AND k BETWEEN 1 AND 5 UNION ALL SELECT club_id, -1, 'D1', 'Dép' FROM s1 WHERE total = 1 AND k NOT BETWEEN 1 AND 5
  UNION ALL SELECT club_id, k, rung, label FROM h, (VALUES (4, 'D1', 'Dép'), (9, 'R1', 'Régionale')) v(k, rung, label) WHERE club_id NOT IN (SELECT club_id FROM s1)),
ld AS (SELECT club_id, row_number() OVER (PARTITION BY club_id ORDER BY k) - 1 AS rank, rung, label FROM s2)
""".format(labels=", ".join(f"'{x}'" for x in _LABELS), n=len(_LABELS), rungs=", ".join(f"('{x}', '{k}')" for k, (_, xs) in mv.RUNGS.items() for x in xs))


def _club_levels(c):
    """club_id, team_id, season, label: one of own labels by club, team and season."""
    which = F.pmod(F.col("club_id") * 3 + F.pmod("team_id", F.lit(4)) * F.pmod("season", F.lit(3)), F.lit(len(_LABELS)))
    each = c.sides.where("played").join(c.teams.select("team_id", "club_id"), "team_id").select("club_id", "team_id", "season").distinct()
    return each.withColumn("label", F.element_at(F.array(*map(F.lit, _LABELS)), (which + 1).cast("int")))


query("j11_ladder", lambda c: mv.ladder(_club_levels(c), "club_id"), _LADDER + "SELECT * FROM ld")
query(
    "j11_on_ladder",
    lambda c: mv.on_ladder(_club_levels(c), "club_id"),
    _LADDER + "SELECT en.*, rank, ld.label AS step FROM en LEFT JOIN al USING (label) LEFT JOIN ld ON ld.club_id = en.club_id AND ld.rung = CASE al.rung WHEN 'DEP' THEN 'D1' WHEN 'REGIONAL' THEN 'R1' WHEN 'N1' THEN 'ELITE' ELSE al.rung END",
)

# ---------------------------------------------------------------- brackets
#: Twelve matches of ranks 1 to 8: (odd season, n, first, second, stage, half); in odd seasons the lower rank always wins.
_DRAW = (
    (0, 1, 1, 8, "quarter", "upper"), (0, 2, 4, 5, "quarter", "upper"), (0, 3, 3, 6, "quarter", "lower"), (0, 4, 2, 7, "quarter", "lower"),
    (0, 5, 1, 4, "semi", "upper"), (0, 6, 2, 3, "semi", "lower"), (0, 7, 8, 5, "consolation", "upper"), (0, 8, 7, 6, "consolation", "lower"),
    (0, 9, 1, 2, "final", None), (0, 10, 4, 3, "bronze", None), (0, 11, 5, 6, "place_5_6", None), (0, 12, 8, 7, "place_7_8", None),
    (1, 1, 1, 8, "quarter", "lower"), (1, 2, 4, 5, "quarter", "lower"), (1, 3, 3, 6, "quarter", "upper"), (1, 4, 2, 7, "quarter", "upper"),
    (1, 5, 1, 4, "consolation", "lower"), (1, 6, 2, 3, "consolation", "upper"), (1, 7, 7, 6, "semi", "upper"), (1, 8, 8, 5, "semi", "lower"),
    (1, 9, 4, 3, "place_5_6", None), (1, 10, 1, 2, "place_7_8", None), (1, 11, 5, 6, "bronze", None), (1, 12, 7, 8, "final", None),
)


def _knock_outs(c) -> DataFrame:
    """A knock-out of each competition's first eight (invented results)."""
    top = st.standings(c.sides).where("rank <= 8").groupBy("season", "competition").agg(F.array_sort(F.collect_list(F.struct("rank", "team_id"))).alias("t")).where("size(t) = 8")
    draw = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("odd", "n", "one", "two"), row))) for row in _DRAW))).alias("d")
    rows = top.select("season", "competition", "t", draw).where("d.odd = season % 2")
    team = lambda k: F.element_at("t", F.col(f"d.{k}"))["team_id"]
    first = (F.col("d.one") < F.col("d.two")) == (F.col("d.odd") == 0)
    return rows.select("season", "competition", F.col("d.n").alias("n"), team("one").alias("team_a"), team("two").alias("team_b"), F.when(first, 3).otherwise(1).alias("sets_a"), F.when(first, 1).otherwise(3).alias("sets_b"), F.lit(True).alias("played"))


_draw_sql = ", ".join(f"({o}, {n}, {a}, {b}, '{s}', {'NULL' if h is None else repr(h)})" for o, n, a, b, s, h in _DRAW)
query(
    "e12_bracket_flow",
    lambda c: mv.bracket_flow(_knock_outs(c)),
    _LINES
    + f""", tp AS (SELECT season, competition, rank, team_id FROM table_ WHERE rank <= 8 QUALIFY count(*) OVER (PARTITION BY season, competition) = 8),
dr AS (SELECT a.season, a.competition, CAST(n AS BIGINT) AS n, stage, half, a.team_id team_a, b.team_id team_b, (one < two) = (odd = 0) AS f
  FROM (VALUES {_draw_sql}) d(odd, n, one, two, stage, half) JOIN tp a ON a.rank = one AND a.season % 2 = odd JOIN tp b ON b.rank = two AND b.season = a.season AND b.competition = a.competition)
SELECT season, competition, n, stage, half, team_a, team_b, CASE WHEN f THEN team_a ELSE team_b END winner, CASE WHEN f THEN team_b ELSE team_a END loser FROM dr""",
)

# ---------------------------------------------------------------- sanctions, sides, status


def _sanctions(c) -> DataFrame:
    """Time-outs taken for sanctions of one of twelve shirts (invented); some without a score."""
    known = F.col("event_id") % 7 != 0
    kind = F.when(F.col("event_id") % 3 == 0, "yellow").otherwise("red")
    return pt.timeline(c.rallies).where("kind = 'timeout'").select(
        F.col("set_id").alias("match_id"), F.col("called_by").alias("side"), (F.pmod("event_id", F.lit(12)) + 1).alias("shirt"), kind.alias("kind"),
        (F.pmod("event_id", F.lit(5)) + 1).alias("set_number"), F.when(known, F.col("score_a")).alias("score_a"), F.when(known, F.col("score_b")).alias("score_b"), "event_id",
    )


def _sheet(c) -> DataFrame:
    """Shirts 1 to 10 of both sides."""
    sides = c.rallies.select(F.col("set_id").alias("match_id")).distinct().select("match_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"))
    return sides.select("match_id", "side", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("shirt")).withColumn("player_id", F.col("shirt") * 2 + (F.col("side") == "B").cast("long"))


query(
    "g9_sanctions",
    lambda c: inc.sanctions_of(_sanctions(c), _sheet(c)),
    _LINES_OF_SETS
    + """SELECT set_id match_id, (event_id % 12 + 1) * 2 + CASE WHEN called_by = 'B' THEN 1 ELSE 0 END player_id, count(*) AS n,
  string_agg(CASE WHEN event_id % 3 = 0 THEN 'yellow' ELSE 'red' END || ' (set ' || (event_id % 5 + 1) || CASE WHEN event_id % 7 <> 0 THEN ', ' || score_a || '-' || score_b ELSE '' END || ')', '; ' ORDER BY event_id) sanctions
FROM tm WHERE kind = 'timeout' AND event_id % 12 < 10 GROUP BY 1, 2""",
)

_part = lambda k: F.nullif(F.split("v", r"\|")[k], F.lit(""))
_cases(
    "i14_sides",
    (
        ("B|1|2|1|3|4|3|X|X|Y", "B"), ("|1|2|1|3|4|9|X|X|Y", "A"), ("|1|2|2|3|4|9|X|X|Y", "B"), ("|1|2|9|3|4|4|X|X|Y", "B"), ("|1|2|9|3|4|3|X|Y|Z", "A"),
        ("|1|2|9||||Élan Vif|AS ELAN-VIF 2|Rive", "A"), ("|1|2|9||||A.S. Rive Sud Volley|Pont|rive sud", "B"), ("|1|2|9||||Lac Bleu Volley|Grand Lac VB|Port", "A"),
        ("|1|2|9||||Lac Bleu Volley|Vent|Club du Bleu Pré", "B"), ("|1|2|9||||Lac Bleu|Lac Noir|Bleu Noir", None), ("|1|2|9||||Lac Bleu Vert|Lac|Port", "A"),
        ("|1|2|9||||Vallon Haut Est|Haut Pré|Port", None), ("|1|2|9|||||X|Y", None), ("|1|2|9||||12 de VB|Nord|Sud", None), ("|||||||||", None),
    ),
    ("placed",),
    lambda d: nm.with_side(d.select("id", *(_part(k).alias(n) for k, n in enumerate(("side", "team_a", "team_b", "team_id", "club_a", "club_b", "club_id", "name", "name_a", "name_b"))))).select("id", F.col("side").alias("placed")),
)


def _synced(d: DataFrame) -> DataFrame:
    names = ("score_export", "score_pdf", "score", "forfeit", "winner", "sets_a", "sets_b", "has_details", "source", "played", "has_sets")
    kinds = {"forfeit": "boolean", "sets_a": "int", "sets_b": "int", "has_details": "boolean", "played": "boolean", "has_sets": "boolean"}
    rows = d.select("id", F.lit("Nord").alias("team_a"), F.lit("Sud").alias("team_b"), *(_part(k).cast(kinds.get(n, "string")).alias(n) for k, n in enumerate(names)))
    out = inc.synced(rows)
    return out.select("id", "score", "winner", _text(F.col("sets_a")).alias("won_a"), _text(F.col("sets_b")).alias("won_b"), _text(F.col("played")).alias("was_played"), F.col("source").alias("origin"), _text(F.col("has_details")).alias("details"), _text(F.col("changed")).alias("differs"))


_cases(
    "l11_synced_status",
    (
        ("3/1||3/1|false|Nord|3|1|false|export|true|false", "3/1", "Nord", "3", "1", "true", "export", "false", "false"),
        ("3-1||||||||||", "3/1", "Nord", "3", "1", "true", "pdf", None, "true"),
        ("1/3|3/1|3/1|false|Nord|3|1|true|pdf|true|false", "1/3", "Sud", "1", "3", "true", "pdf", "true", "true"),
        ("|2/3|2/3|false|Nord|2|3|true|pdf|true|false", "2/3", "Nord", "2", "3", "true", "pdf", "true", "false"),
        ("P/3|||true|||||||", "0/3", None, "0", "3", "true", "pdf", None, "true"),
        ("||0/3|true|Sud|0|3|false|export|true|false", "0/3", "Sud", "0", "3", "true", "export", "false", "false"),
        ("|||false||||true|pdf|true|false", None, None, None, None, "false", None, "false", "true"),
        ("0/0||0/0|false||0|0|false|export|false|false", "0/0", None, "0", "0", "false", None, "false", "true"),
        ("|||false||||false||true|true", None, None, None, None, "true", None, "false", "false"),
        ("|||false|Sud|||true||true|false", None, "Sud", None, None, "true", "pdf", "true", "true"),
        ("x|y|z|false||||false||false|false", None, None, None, None, "false", None, "false", "true"),
    ),
    ("score", "winner", "won_a", "won_b", "was_played", "origin", "details", "differs"),
    _synced,
)

# ---------------------------------------------------------------- roles written back
query(
    "h7_rebuilt_seasons",
    lambda c: ru.player_seasons(ro.with_roles(c.appearances, ro.beliefs(_formations(c)))),
    _SOLVED
    + """, ob AS (SELECT match_id, player_id, arg_max(role, (confidence, side)) AS role, max(confidence) confidence FROM be GROUP BY 1, 2),
na AS (SELECT a.* REPLACE (coalesce(ob.role, a.role) AS role, coalesce(CAST(round(ob.confidence * 100) AS BIGINT), a.confidence) AS confidence) FROM appearances a LEFT JOIN ob USING (match_id, player_id))
"""
    + _SEASONS.replace("FROM appearances", "FROM na")
    + "SELECT * FROM ps",
)


def _challenges(c):
    """Cross pools of each competition's first eight teams: who wins a semi hangs on the season, and so does the order of the finals."""
    first = c.sides.where("played").select("season", "competition", "team_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("season", "competition").orderBy("team_id"))).where("r <= 8")
    eight = first.groupBy("season", "competition").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "team_id"))), lambda x: x["team_id"]).alias("t")).where("size(t) = 8")
    wins = lambda n: F.when((F.col("season") + n) % 3 == 0, 0).otherwise(1)  # noqa: E731  whether the second team of semi n wins
    of = lambda n, lost: F.get("t", 2 * n + (1 - wins(n) if lost else wins(n)))
    semi = [F.struct(F.lit("A").alias("pool"), F.lit(f"A{n}").alias("code"), F.lit(n).alias("n"), F.get("t", F.lit(2 * n)).alias("team_a"), F.get("t", F.lit(2 * n + 1)).alias("team_b"), (3 - 3 * wins(n)).alias("sets_a"), (3 * wins(n)).alias("sets_b")) for n in range(4)]
    order = lambda k: F.concat(F.lit("B"), F.pmod(F.col("season") + k, F.lit(4)).cast("string"))
    final = [F.struct(F.lit("B").alias("pool"), order(k).alias("code"), F.lit(4 + k).alias("n"), of(2 * (k // 2), k % 2 == 1).alias("team_a"), of(2 * (k // 2) + 1, k % 2 == 1).alias("team_b"), F.lit(3).alias("sets_a"), F.lit(1).alias("sets_b")) for k in range(4)]
    rows = eight.select("season", "competition", F.explode(F.array(*semi, *final)).alias("m")).select("season", "competition", "m.*")
    return rows.select("season", "competition", "pool", "code", F.col("n").cast("long").alias("match_id"), "team_a", "team_b", "sets_a", "sets_b", F.lit(True).alias("played"))


query(
    "e12_challenge_bracket",
    lambda c: mv.challenge_bracket(_challenges(c)),
    """, ei AS (SELECT season, competition FROM (SELECT DISTINCT season, competition, team_id FROM sides WHERE played) GROUP BY 1, 2 HAVING count(*) >= 8),
fi AS (SELECT season, competition, k, (season + 2 * k) % 4 AS code FROM ei, (VALUES (0), (1)) v(k))
SELECT season, competition, CASE WHEN row_number() OVER (PARTITION BY season, competition ORDER BY code) = 1 THEN 'lower' ELSE 'upper' END half, CAST(2 * k AS BIGINT) semi_1, CAST(2 * k + 1 AS BIGINT) semi_2, CAST(4 + 2 * k AS BIGINT) AS final, CAST(5 + 2 * k AS BIGINT) bronze FROM fi""",
)
