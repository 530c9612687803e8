"""Rules of the operators on small inputs with answers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rallyframe.functions import geo
from rallyframe.functions import names as nm
from rallyframe.functions import scalars as sc
from rallyframe.operators import leaders as ld
from rallyframe.operators import points as pt
from rallyframe.operators import quality as qu
from rallyframe.operators import relational as rl
from rallyframe.operators import roles as ro
from rallyframe.operators import rollups as ru
from rallyframe.operators import standings as st
from rallyframe.operators.filters import MatchFilter, echelon_is, filtered, gender_is
from rallyframe.sources import exports as ex
from rallyframe.sources.views import sides_of
from rallyframe.streaming import incremental as inc

MATCH = "match_id long, season int, competition string, day date, round string, team_a long, team_b long, sets_a int, sets_b int, points_a long, points_b long, forfeit boolean, forfeit_by string, played boolean"


def match(i, a, b, sa, sb, pa=0, pb=0, day=1, by=None, played=True, round_="J1"):
    return (i, 2024, "R1", dt.date(2024, 10, day), round_, a, b, sa, sb, pa, pb, by is not None, by, played)


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "v string").select(make(F.col("v")).alias("r")).collect()[0]["r"]


def table_of(df):
    return {r["team_id"]: r for r in df.collect()}


def test_points_by_score(spark):
    rows = [match(1, 1, 2, 3, 0, 75, 50), match(2, 3, 4, 3, 1, 100, 80), match(3, 5, 6, 3, 2, 110, 105), match(4, 7, 8, 2, 0, 50, 30), match(5, 9, 10, 1, 1, 40, 40), match(6, 11, 12, 0, 0, played=False)]
    t = table_of(st.standings(sides_of(spark.createDataFrame(rows, MATCH))))
    assert {k: t[k]["points"] for k in t} == {1: 3, 2: 0, 3: 3, 4: 0, 5: 2, 6: 1, 7: 3, 8: 0, 9: 0, 10: 0}
    assert (t[9]["matches"], t[9]["wins"], t[9]["defeats"]) == (1, 0, 0)
    assert (t[7]["w30"], t[7]["wins"], t[5]["w32"], t[6]["d23"]) == (0, 1, 1, 1)


def test_forfeits(spark):
    rows = [match(1, 1, 2, 0, 3, by="a"), match(2, 3, 4, 3, 0, by="b"), match(3, 5, 6, 0, 0, by="both")]
    t = table_of(st.standings(sides_of(spark.createDataFrame(rows, MATCH))))
    line = lambda k: tuple(t[k][c] for c in ("points", "wins", "defeats", "forfeits", "sets_for", "sets_against", "points_for", "points_against"))
    assert line(1) == line(4) == (-1, 0, 1, 1, 0, 3, 0, 75)
    assert line(2) == line(3) == (3, 1, 0, 0, 3, 0, 75, 0)
    assert line(5) == line(6) == (-1, 0, 1, 1, 0, 3, 0, 75)


def test_rank_order_and_ties(spark):
    rows = [match(1, 1, 2, 3, 0, 75, 60), match(2, 3, 4, 3, 0, 75, 50), match(3, 5, 6, 3, 1, 100, 60), match(4, 8, 7, 3, 0, 75, 50)]
    t = table_of(st.standings(sides_of(spark.createDataFrame(rows, MATCH))))
    assert [k for k, _ in sorted(t.items(), key=lambda x: x[1]["rank"])][:4] == [3, 8, 1, 5]  # 3 and 8 tie: first match first


def test_evolution_orders_rounds_and_dates(spark):
    rows = [match(1, 1, 2, 3, 0, 75, 60, round_="J2"), match(2, 1, 2, 0, 3, 60, 75, day=2, round_="J10"), match(3, 1, 2, 3, 0, 75, 60, day=3, round_=None)]
    got = st.evolution(sides_of(spark.createDataFrame(rows, MATCH))).where("team_id = 1").orderBy("place").collect()
    assert [(r["name"], r["points"], r["matches"]) for r in got] == [("J2", 3, 1), ("J10", 3, 2), ("2024-10-03", 6, 3)]
    assert st.standings(sides_of(spark.createDataFrame([], MATCH))).count() == 0


def test_team_rollup_differs_from_standings_as_said(spark):
    rows = [match(1, 1, 2, 2, 0, 50, 30), match(2, 1, 2, 1, 1, 40, 40, day=2), match(3, 1, 2, 3, 0, by="b", day=3), match(4, 1, 2, 3, 0, 75, 1, day=4)]
    t = table_of(ru.team_seasons(sides_of(spark.createDataFrame(rows, MATCH))))
    assert (t[1]["points"], t[1]["wins"], t[1]["defeats"], t[1]["longest_streak"], t[1]["current_streak"]) == (6, 3, 1, 2, 2)
    assert (t[2]["defeats"], t[2]["current_streak"], t[1]["points_for"]) == (4, -4, 165)


def test_incremental_is_idempotent(spark):
    rows = [match(k, k % 5 + 1, (k + 1 + k % 3) % 5 + 6, 3, k % 3, 75, 60, day=k % 27 + 1) for k in range(40)]
    m = spark.createDataFrame(rows, MATCH)
    full = sorted(map(tuple, ru.team_seasons(sides_of(m)).collect()))
    batch = m.where("match_id >= 30")
    once = inc.apply_matches(ru.team_seasons(sides_of(m.where("match_id < 30"))), m, batch)
    assert sorted(map(tuple, once.collect())) == full == sorted(map(tuple, inc.apply_matches(once, m, batch).collect()))


def test_stream_of_matches(spark, tmp_path):
    m = spark.createDataFrame([match(k, 1, 2, 3, 0) for k in range(10)], MATCH)
    m.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = inc.follow_matches(stream, lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(n for _, n in seen) == 10


def test_stream_windows(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    q = inc.tumbling(stream, "1 day").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(events) FROM tumbled").collect()[0][0] == e.count()


def test_comeback_and_longest(spark):
    m = spark.createDataFrame([match(1, 1, 2, 3, 2, 110, 105), match(2, 3, 4, 2, 3, 100, 101)], MATCH).withColumn("minutes", F.lit(90))
    sets = spark.createDataFrame([(1, k, a, 25 - a) for k, a in enumerate((10, 10, 20, 20, 20), 1)] + [(2, k, a, 25 - a) for k, a in enumerate((20, 10, 20, 10, 10), 1)], "match_id long, number int, score_a int, score_b int")
    got = {r["match_id"]: (r["winner"], r["deficit"]) for r in ld.comebacks(m, sets).collect()}
    assert got == {1: (1, 2), 2: (4, 1)}


def test_timeline_and_phases(spark):
    marks = "AABBAT"
    rows = [(1, k, {"A": "click", "B": "view", "T": "error"}[x]) for k, x in enumerate(marks)]
    r = spark.createDataFrame(rows, "set_id long, event_id long, t string").withColumn("ts", F.col("event_id"))
    r = r.withColumn("scored_by", F.when(F.col("t") == "click", "A").when(F.col("t") == "view", "B")).withColumn("kind", F.when(F.col("t") == "error", "timeout").otherwise("point")).withColumn("called_by", F.lit("A"))
    lines = pt.timeline(r)
    assert [(x["score_a"], x["score_b"], x["server"]) for x in lines.orderBy("event_id").collect()] == [(1, 0, "A"), (2, 0, "A"), (2, 1, "A"), (2, 2, "B"), (3, 2, "B"), (3, 2, "A")]
    got = {x["side"]: (x["serves"], x["breaks"], x["receptions"], x["side_outs"]) for x in pt.phases(pt.points_only(lines)).collect()}
    assert got == {"A": (3, 2, 2, 1), "B": (2, 1, 3, 1)}


def test_filter(spark):
    m = spark.createDataFrame([match(1, 1, 2, 3, 0, day=1), match(2, 3, 4, 3, 0, day=20), match(3, 1, 4, 0, 0, played=False)], MATCH)
    ids = lambda f: {r["match_id"] for r in filtered(m, f).collect()}
    assert ids(MatchFilter()) == {1, 2}
    assert ids(MatchFilter(first_day="2024-10-10", last_day="2024-10-01")) == {1}
    assert ids(MatchFilter(season=2023)) == set()
    e = spark.createDataFrame([("PRE_NATIONALE",), ("Loisir",), (None,)], "v string")
    assert [r[0] for r in e.select(echelon_is(F.col("v"), "NATIONAL")).collect()] == [True, False, False]
    assert e.where(gender_is(F.lit("Homme"), "M")).count() == 3


@pytest.mark.parametrize(("make", "pairs"), [
    (sc.plain_upper, [(" Élan  d'Or ", "ELAN D'OR"), (None, "")]),
    (sc.gender, [("Seniors M", "MASCULIN"), ("Dames", "FEMININ"), ("mixte", "MIXTE"), ("x", None)]),
    (sc.age_category, [("U8", "M9"), ("M 20", "M21"), ("benjamines", "M13"), ("Vétérans", "VETERAN"), ("U25", "SENIOR"), ("?", None)]),
    (sc.division, [("R1M", "1"), ("NM2", None), ("D1F", "1"), ("2FA", "2"), ("Départementale 4x4", None), ("CHAMPIONNAT MASCULINS 2", "2"), ("M13 poule 2", None)]),
    (sc.level, [("Accession Nationale 3", "PRENAT"), ("PRO", "PRO"), ("Elite régionale", "REGIONAL"), ("R4", "R4"), ("Nationale", "NATIONAL"), ("rien", "DEP"), ("brassage R1", "LOISIR")]),
    (sc.shirt_number, [("007", "7"), ("00", "0"), ("12", "12")]),
    (lambda c: sc.season_end(c), [("2024-2025", 2025), ("24/25", 2025), ("99-00", 2100), ("saison 2023", 2023), ("x", None)]),
    (lambda c: sc.youth_pool(c)["division"], [("CYQ", "CMX"), ("BFA", "BFX"), ("ZZ", None), ("C", None)]),
    (lambda c: F.to_json(sc.set_list(c)), [("25-18, 16/25,x", '[{"a":25,"b":18},{"a":16,"b":25}]'), (None, "[]")]),
    (sc.match_pool, [("KLM012", "KLM"), ("AB", "AB")]),
    (geo.department_of_postcode, [("69400", "69"), ("20100", "2A"), ("20600", "2B"), ("97400", "974"), ("6", None)]),
    (geo.department_of_club_code, [("0015372", "01"), ("0622126", "62"), ("02A5803", "2A"), ("2020001", "2B"), ("9744926", "974")]),
    (nm.core_name, [("ASUL Lyon VB", "ASUL LYON"), ("E. Forezienne V.B", "E FOREZIENNE V B")]),
])
def test_scalars(spark, make, pairs):
    for text, want in pairs:
        assert one(spark, text, make) == want, text


def test_same_club_and_swapped(spark):
    pairs = [("NANTES OUEST VB", "Nantes Ouest Volley", True), ("AS REDON", "AS REDON VB", True), ("PONTCHATEAUX", "PONTCHATEAU", True), ("NIORT", "SETE", False), ("AAAAAA", "BBBBBB", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(nm.same_club(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    rows = [("OISE 2", "OISE 5", "OISE 5", "OISE 2", None, None, None, True), ("A VB", "REDON", "REDON VOLLEY", "X", None, None, None, True), ("A", "B", None, None, None, None, None, False), ("AAAA", "BBBB", "CCCC", "DDDD", "3/1", 1, 3, True)]
    df = spark.createDataFrame(rows, "a string, b string, x string, y string, score string, sa int, sb int, want boolean")
    assert nm.with_swaps(df, "a", "b", "x", "y", "score", "sa", "sb").where("swapped <> want").count() == 0
    m = nm.match_clubs(df.select(F.lit("PONTCHATEAUX VB").alias("name")), spark.createDataFrame([("Pontchâteau",), ("Pontivy",)], "club string"))
    assert [r["club"] for r in m.collect()] == ["Pontchâteau"]


def test_places(spark):
    assert abs(one(spark, "0", lambda c: geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(45.7640), F.lit(4.8357))) - 391.5) < 1
    e = spark.createDataFrame([(1, "69", "LYON", 45.0, 4.0), (2, "69", "LYON", None, None), (3, "38", "X", None, None), (4, "00", "Y", None, None)], "entity_id long, department string, city string, lat double, lon double")
    cities = spark.createDataFrame([("LYON", 45.76, 4.83)], "city string, lat double, lon double")
    centres = spark.createDataFrame([("69", 45.9, 4.6), ("38", 45.2, 5.6)], "department string, lat double, lon double")
    got = {r["entity_id"]: r["source"] for r in geo.resolve_places(e, cities, centres).collect()}
    assert got == {1: "own", 2: "city", 3: "department", 4: None}
    far = spark.createDataFrame([(9, "69", 50.0, 4.6), (8, "69", 45.8, 4.6)], "entity_id long, department string, lat double, lon double")
    assert [r["entity_id"] for r in geo.outliers(far, centres).collect()] == [9]


def test_quality_rules(spark):
    schema = "season string, day date, hour string, club_code string, score string, sets array<struct<a:int,b:int>>, forfeit boolean, winner string, team_a string, team_b string, played boolean, duration string, set_minutes array<int>"
    rows = [
        ("2024-2025", dt.date(2023, 9, 1), "9:05", "1234567", "3/0", [(25, 1), (1, 25), (25, 2), (25, 3)], False, None, "X", "Y", False, "5 min", [20, 21]),
        ("2024-2025", dt.date(2024, 9, 1), "20:00", "12", "0/0", [], False, None, "X", "Y", True, None, []),
        ("2024-2025", dt.date(2024, 2, 29), None, None, None, [], False, None, "X", "Y", False, None, []),
    ]
    df = spark.createDataFrame(rows, schema)
    a, b, c = qu.check(df).collect()
    assert (a["day"], a["hour"], a["score"], a["winner"], a["played"], a["duration"]) == (dt.date(2024, 9, 1), "09:05", "3/1", "X", True, "0h41")
    assert (b["club_code"], b["score"], b["played"]) == (None, None, False)
    assert c["day"] is None and [i["action"] for i in c["issues"]] == ["removed"]
    kept = qu.check(df, policy="report").collect()[0]
    assert kept["score"] == "3/0" and len(kept["issues"]) == len(a["issues"])


def test_exports(spark, tmp_path):
    lines = ["Entité;Jo;Match;Date;Heure;EQA_no;EQA_nom;EQB_no;EQB_nom;Set;Score;Total;Salle", "LILR;01;EMA001;05/10/2024;20:30;0691;Sa&#238;nt &amp; Co;0692;Élan;3/1;25-18,20-25,25-11,25-13;95-67;Halle", "LILR;01;EMA002;05/10/2024;20:30;1;A;2;B;P/3;;;H", "short;line", "LILR;01;EMA003;x;;1;xxxxx;2;B;;;;H", "LILR;02;EMA004;06/10/2024;;1;C;2;D;0/0;;;H"]
    (tmp_path / "e.csv").write_bytes("\n".join(lines).encode("latin-1"))
    got = {r["match_code"]: r for r in ex.parse(ex.read_lines(spark, str(tmp_path / "e.csv")), "2024-2025").collect()}
    assert set(got) == {"EMA001", "EMA002", "EMA004"}
    r = got["EMA001"]
    assert (r["team_a"], r["team_b"], r["score"], r["winner"], r["pool"], len(r["sets"]), r["day"]) == ("Saînt & Co", "Élan", "3/1", "Saînt & Co", "EMA", 4, dt.date(2024, 10, 5))
    assert (got["EMA002"]["score"], got["EMA002"]["forfeit_by"], got["EMA002"]["winner"]) == ("0/3", "a", "B")
    assert not got["EMA004"]["played"] and got["EMA004"]["score"] is None


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k long, v string, t int")
    new = spark.createDataFrame([(None, "m", 2), (2, "b", 2), (2, "c", 3)], "k long, v string, t int")
    assert sorted(map(str, (r["v"] for r in rl.upsert(old, new, ["k"], "t").collect()))) == ["a", "c", "m"]
    assert sorted(r["v"] for r in rl.upsert(old, new, ["k"], "t", update=False).collect()) == ["a", "c", "n"]
    assert sorted(r["v"] for r in rl.replace_for_keys(old, new, ["k"]).collect()) == ["a", "b", "c", "m"]
    spark.range(3).createOrReplaceTempView("three")
    assert rl.read_only_sql(spark, "SELECT id FROM three").count() == 3
    for text in ("DROP VIEW three", "INSERT INTO three VALUES (1)", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(ValueError):
            rl.read_only_sql(spark, text)
    assert rl.search(spark.createDataFrame([("50% off", None), ("x", "y")], "a string, b string"), "0% O", "a", "b").count() == 1


def test_roles_converge(spark):
    rows = [(m, "A", s, p, p + 10, p == 3 and m == 1, 0) for m in range(4) for s in (1, 2) for p in range(1, 7)]
    f = spark.createDataFrame(rows, "match_id long, side string, set_number long, position long, player_id long, libero boolean, swaps int")
    beliefs, passes = ro.diffuse(ro.evidence(f), 5, lambda df: df.cache())
    got = {(r["match_id"], r["player_id"]): r["role"] for r in beliefs.collect()}
    assert got[(0, 11)] == "passeur" and got[(0, 14)] == "pointu" and got[(1, 13)] == "libero" and passes <= 5
    assert {(r["player_1"], r["player_2"]) for r in ro.opposite_pairs(f).collect()} == {(11, 14), (12, 15), (13, 16)}


def test_filter_by_division_and_department(spark):
    m = spark.createDataFrame([match(1, 1, 2, 3, 0, day=1), match(2, 3, 4, 3, 0, day=20)], MATCH)
    first = m.select("season", "competition").first()
    divisions = spark.createDataFrame([(first[0], first[1], "Masculin", "M18", "prenat")], "season int, competition string, gender string, category string, level string")
    ids = lambda **f: {r["match_id"] for r in filtered(m, MatchFilter(**f), divisions=divisions).collect()}
    assert ids(gender="M") == ids(category="M18") == ids(level="PRENAT") == ids(least_level="R1", most_level="n3") == {1, 2}
    assert ids(gender="F") == ids(category="M15") == ids(least_level="N3") == ids(most_level="R1", gender="homme") == set()
    assert ids(least_level="unheard of") == {1, 2}
    from rallyframe.sources.views import sides_of

    teams = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (4, 9)], "team_id long, club_id long")
    clubs = spark.createDataFrame([(7, "01"), (8, "02"), (9, None)], "club_id long, department string")
    assert {r["match_id"] for r in filtered(m, MatchFilter(department="02"), sides_of(m), teams, clubs).collect()} == {1}
