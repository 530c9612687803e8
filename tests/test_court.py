"""Presence, positions and rally figures on sets written by hand."""

import pytest

from rallyframe.operators import court as co
from rallyframe.operators import service as sv

SIDES = "set_id long, side string, formation array<string>, changes array<struct<at:long,event_id:long,position:long,entrant:string,leaver:string,score_a:long,score_b:long>>"
SETS = "set_id long, match_id long, number long, minutes long, score_a long, score_b long"


def change(entrant, leaver, a, b, position=1, n=1):
    return (a + b, n, position, entrant, leaver, a, b)


@pytest.fixture(scope="module")
def match(spark):
    """Two sets: 07 starts, goes, comes back; then comes in twice from the bench, and goes once."""
    sides = [
        (1, "A", ["07", "2", "3", "4", "5", "6"], [change("12", "7", 9, 9), change("7", "12", 14, 16, n=2)]),
        (2, "A", ["12", "2", "3", "4", "8", "6"], [change("7", "12", 4, 6), change("12", "7", 8, 8, n=2), change("7", "12", 19, 17, n=3)]),
        (1, "B", None, None),
        (2, "B", ["1", None, None, None, None, None], []),
    ]
    sets = [(1, 9, 1, 25, 25, 20), (2, 9, 2, 20, 25, 18)]
    return spark.createDataFrame(sides, SIDES), spark.createDataFrame(sets, SETS)


def test_stints_are_a_state_machine(match):
    rows = {(r["set_id"], r["player"]): r for r in co.presence(*match).where("side = 'A'").collect()}
    assert [tuple(s) for s in rows[1, "7"]["stints"]] == [(0, 0, 9, 9), (14, 16, 25, 20)]
    assert [tuple(s) for s in rows[1, "12"]["stints"]] == [(9, 9, 14, 16)]
    assert [tuple(s) for s in rows[2, "7"]["stints"]] == [(4, 6, 8, 8), (19, 17, 25, 18)]
    assert [rows[2, "7"][c] for c in ("starter", "entries", "exits", "in_outs", "out_ins", "finished")] == [False, 2, 1, 1, 1, True]
    assert [tuple(s) for s in rows[1, "2"]["stints"]] == [(0, 0, 25, 20)]


def test_players_of_a_match(match):
    got = {r["player"]: r for r in co.player_matches(*match).where("side = 'A'").collect()}
    star = got["7"]
    on = (9 + 11 + 4 + 6, 9 + 4 + 2 + 1)
    assert (star["won_on"], star["lost_on"], star["plus_minus"]) == (*on, on[0] - on[1])
    assert (star["points_off"], star["won_off"]) == (88 - sum(on), 50 - on[0])
    assert star["rate_on"] == round(on[0] / sum(on), 3) and star["difference"] == round(star["rate_on"] - star["rate_off"], 3)
    assert star["minutes"] == round(25 * 33 / 45 + 20 * 13 / 43, 1) and star["presence"] == round(46 / 88, 3)
    assert (star["sets_played"], star["sets_won"], star["started"], star["finished"], star["whole_match"]) == (2, 2, 1, 2, False)
    assert got["2"]["whole_match"] and got["2"]["rate_off"] is None and got["2"]["difference"] is None


def test_going_out_comes_before_coming_in(spark):
    """At one score a player goes and another comes at two positions; who comes in twice or goes while away changes nothing."""
    sides = [(1, "A", list("123456"), [change("9", "1", 5, 5, n=2), change("1", "9", 5, 5, n=1), change("9", "2", 7, 5, 2, 3), change("9", "2", 8, 5, 2, 4)])]
    sets = spark.createDataFrame([(1, 1, 1, None, 15, 9)], SETS)
    rows = {r["player"]: [tuple(s) for s in r["stints"]] for r in co.presence(spark.createDataFrame(sides, SIDES), sets).collect()}
    assert rows["1"] == [(0, 0, 5, 5), (5, 5, 15, 9)] and rows["9"] == [(5, 5, 15, 9)] and rows["2"] == [(0, 0, 7, 5)]


def test_position_of_a_player(match):
    sides, sets = match
    at = {(r["set_id"], r["player"], r["from_x"]): (r["to_x"], r["position"]) for r in co.standing(co.presence(sides, sets)).where("side = 'A'").collect()}
    assert at[1, "7", 0] == (18, 1) and at[1, "7", 30] == (45, 1) and at[1, "12", 18] == (30, 1)
    assert at[2, "8", 0][1] == 5 and at[2, "8", 10] == (16, 5) and at[2, "7", 36] == (43, 1)


@pytest.fixture(scope="module")
def rescue(spark):
    """A is 19-24 down, saves a set ball on reception and four on serve from position 1, and wins 26-24."""
    sheets = spark.createDataFrame(
        [(1, "A", 26, 24, {1: [19, 26]}, {1: [24]}, 5, 1, 30)],
        "set_id long, service_initial string, score_a int, score_b int, services_a map<int,array<int>>, services_b map<int,array<int>>, match_id long, number long, minutes long",
    )
    sides = spark.createDataFrame([(1, "A", ["7", "2", "3", "4", "5", "6"], None), (1, "B", ["1", "2", "3", "4", "5", "6"], None)], SIDES)
    return sv.service_turns(sheets), sides, sheets.selectExpr("set_id", "match_id", "number", "minutes", "cast(score_a as long) score_a", "cast(score_b as long) score_b")


def test_clutch(rescue):
    turns = [(r["side"], r["score_a"], r["score_b"], r["points"], r["wins_set"]) for r in rescue[0].orderBy("n").collect()]
    assert turns == [("A", 0, 0, 19, False), ("B", 19, 1, 23, False), ("A", 20, 24, 6, True)]
    got = {(r["side"], r["player"]): r for r in co.clutch_figures(co.player_rallies(*rescue)).collect()}
    seven = got["A", "7"]
    # 24-19 to 24-23 against: the first ends B's turn, the others are on the player's own serve
    assert (seven["set_balls_against_played"], seven["set_balls_against_won"]) == (5, 5)
    assert (seven["most_saves"], seven["set_balls_played"], seven["set_balls_won"]) == (4, 1, 1)
    assert seven["money_played"] == 11 and seven["level_played"] == 3 and seven["ahead_won"] == 18 + 1
    assert got["A", "4"]["most_saves"] == 0 and got["B", "1"]["set_balls_played"] == 5 and got["B", "1"]["set_balls_won"] == 0
    assert seven["received_played"] == 24 and seven["received_won"] == 1


def test_zones_turn_with_the_server(rescue):
    got = {(r["side"], r["player"], r["zone"]): (r["played"], r["won"]) for r in co.zone_figures(co.player_rallies(*rescue)).collect()}
    assert got["A", "7", 1] == (50, 26) and got["A", "2", 2] == (50, 26) and got["B", "1", 1] == (50, 24)
    assert {z for s, p, z in got if s == "A"} == {1, 2, 3, 4, 5, 6}


def test_money_time_of_the_fifth_set(spark):
    sheets = spark.createDataFrame(
        [(k, "A", 15, 12, {1: [15]}, {2: [12]}, 3, k, None) for k in (4, 5)],
        "set_id long, service_initial string, score_a int, score_b int, services_a map<int,array<int>>, services_b map<int,array<int>>, match_id long, number long, minutes long",
    )
    sides = spark.createDataFrame([(k, "A", list("123456"), None) for k in (4, 5)], SIDES)
    rows = co.player_rallies(sv.service_turns(sheets), sides, sheets.selectExpr("set_id", "match_id", "number", "minutes", "score_a", "score_b"))
    money = {r[0]: r[1] for r in rows.where("player = '1'").groupBy("set_id").agg({"money": "count"}).collect()}
    assert set(money) == {4, 5}
    assert rows.where("money and set_id = 4").count() == 0 and rows.where("money and set_id = 5").count() > 0


def test_empty_inputs(spark):
    sides, sets = spark.createDataFrame([], SIDES), spark.createDataFrame([], SETS)
    assert co.presence(sides, sets).count() == co.player_matches(sides, sets).count() == 0
