"""Level moves, brackets, sanctions, sides and status on inputs worked out by hand."""

from pyspark.sql import functions as F

from rallyframe.functions import names as nm
from rallyframe.operators import incidents as inc
from rallyframe.operators import movements as mv
from rallyframe.operators import roles as ro

ENTRY = "club_id long, series string, season int, level double, leisure boolean"
GAME = "season int, competition string, n int, team_a long, team_b long, sets_a int, sets_b int, played boolean"


def test_level_moves(spark):
    rows = [
        (1, "one", 2020, 3.0, False), (1, "one", 2020, 4.0, False), (1, "one", 2021, 4.9, False), (1, "one", 2022, 4.5, False),
        (1, "two", 2020, 2.0, False), (1, "two", 2022, 1.1, None), (1, "fun", 2020, 0.0, True), (1, "fun", 2021, 9.0, True), (2, "only", 2020, 1.0, False),
    ]
    moves = mv.level_moves(spark.createDataFrame(rows, ENTRY))
    got = {(r["series"], r["season_from"], r["season_to"], r["cumulative"]): (r["status"], r["steps"]) for r in moves.collect()}
    assert got == {
        ("one", 2020, 2021, False): ("promotion", 1), ("one", 2021, 2022, False): ("stable", 0), ("one", 2020, 2022, True): ("stable", 0),
        ("two", 2020, 2021, False): ("stopped", None), ("two", 2021, 2022, False): ("new", None), ("two", 2020, 2022, True): ("relegation", -1),
    }
    counts = {(r["season_from"], r["season_to"]): (r["series"], r["promotions"], r["relegations"]) for r in mv.period_counts(moves).collect()}
    assert counts == {(2020, 2021): (2, 1, 0), (2021, 2022): (2, 0, 0), (2020, 2022): (2, 0, 1)}
    assert mv.level_moves(spark.createDataFrame([], ENTRY)).count() == 0


def flow(spark, games):
    rows = [(2024, "cup", n, a, b, sa, sb, played) for n, (a, b, sa, sb, played) in enumerate(games, 1)]
    return {r["n"]: (r["stage"], r["half"], r["winner"]) for r in mv.bracket_flow(spark.createDataFrame(rows, GAME)).collect()}


def test_bracket_follows_the_teams(spark):
    won, lost = (3, 0, True), (1, 3, True)
    games = [(1, 2, *won), (3, 4, *won), (5, 6, *lost), (7, 8, *lost), (2, 6, *won), (1, 6, *won), (3, 8, *lost), (4, 7, *won), (1, 8, *won), (6, 3, *won), (4, 2, *won), (5, 7, *won)]
    got = flow(spark, games)
    # match 5 has a loser and a winner of quarters: it counts as the first semi, and match 7 as the third
    assert [got[k][0] for k in range(1, 9)] == ["quarter"] * 4 + ["semi", "semi", "semi", "consolation"]
    assert got[5][1:] == ("upper", 2) and got[6][1:] == ("lower", 1) and got[7][1] is None
    straight = [(1, 2, *won), (3, 4, *won), (5, 6, *lost), (7, 8, *lost), (8, 3, *won), (5, 2, *won), (6, 1, *won), (4, 7, *won), (8, 6, *won), (3, 1, *won), (5, 4, *won), (2, 7, *won)]
    got = flow(spark, straight)
    assert [got[k][:2] for k in range(1, 13)] == [
        ("quarter", "lower"), ("quarter", "upper"), ("quarter", "lower"), ("quarter", "upper"), ("semi", "upper"), ("consolation", "lower"), ("semi", "lower"), ("consolation", "upper"),
        ("final", None), ("bronze", None), ("place_5_6", None), ("place_7_8", None),
    ]


def test_bracket_not_yet_played(spark):
    games = [(1, 2, 0, 0, False), (3, 4, 0, 0, False), (5, 6, 0, 0, False), (7, 8, 0, 0, False)] + [(None, None, 0, 0, False)] * 8
    got = flow(spark, games)
    assert [got[k][:2] for k in range(1, 5)] == [("quarter", "upper")] * 2 + [("quarter", "lower")] * 2
    assert all(got[k][0] is None and got[k][2] is None for k in range(9, 13))
    assert flow(spark, games[:11]) == {}


def test_sanctions(spark):
    s = spark.createDataFrame(
        [(1, "A", 7, "red", 2, 10, 11, 2), (1, "A", 7, "yellow", 1, 3, None, 1), (1, "B", 7, "red", 1, 0, 0, 3), (1, "A", None, "red", 1, 0, 0, 4)],
        "match_id long, side string, shirt int, kind string, set_number int, score_a int, score_b int, event_id long",
    )
    p = spark.createDataFrame([(1, "A", 7, 70), (1, "A", 8, 80), (1, "B", 9, 90)], "match_id long, side string, shirt int, player_id long")
    assert [tuple(r) for r in inc.sanctions_of(s, p).collect()] == [(1, 70, 2, "yellow (set 1); red (set 2, 10-11)")]


def test_side_keeps_other_columns(spark):
    cols = "side string, team_a int, team_b int, team_id int, club_a int, club_b int, club_id int, name string, name_a string, name_b string, share_a int"
    df = nm.with_side(spark.createDataFrame([(None, 1, 2, 2, None, None, None, None, None, None, 5), (None,) * 11], cols))
    assert [(r["side"], r["share_a"]) for r in df.orderBy(F.desc("share_a")).collect()] == [("B", 5), (None, None)]


def test_synced_twice_changes_nothing(spark):
    cols = "score_export string, score_pdf string, score string, forfeit boolean, winner string, team_a string, team_b string, sets_a int, sets_b int, has_details boolean, source string, played boolean, has_sets boolean"
    rows = [("3-0", "3/1", None, False, "Sud", "Nord", "Sud", None, None, None, None, None, None), ("P/3", None, None, True, None, "Nord", "Sud", None, None, None, "", None, None), (None,) * 13]
    once = inc.synced(spark.createDataFrame(rows, cols))
    assert [r["winner"] for r in once.where("score = '3/0'").collect()] == ["Nord"]
    assert inc.synced(once.drop("changed")).where("changed").count() == 0


def test_beliefs_replace_roles(spark):
    a = spark.createDataFrame([(1, 10, "A", "central", 40), (1, 11, "A", "libero", 50), (2, 10, "B", None, None)], "match_id long, player_id long, side string, role string, confidence long")
    b = spark.createDataFrame([(1, "A", 10, "passeur", 0.61), (1, "B", 10, "pointu", 0.6), (2, "A", 10, "pointu", 0.5), (2, "B", 10, "passeur", 0.5)], "match_id long, side string, player_id long, role string, confidence double")
    got = {(r["match_id"], r["player_id"]): (r["role"], r["confidence"]) for r in ro.with_roles(a, b).collect()}
    assert got == {(1, 10): ("passeur", 61), (1, 11): ("libero", 50), (2, 10): ("passeur", 50)}
