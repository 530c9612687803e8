"""Service sheets by hand: order, turns, servers, side-outs."""

import pytest

from rallyframe.operators import service as sv

SHEETS = "set_id long, service_initial string, score_a int, score_b int, services_a map<int,array<int>>, services_b map<int,array<int>>"
# B serves second, from position 2; A wins 8-4, at first on serve, then by side-out
ON_SERVE = (1, "A", 8, 4, {1: [2], 2: [5], 3: [8]}, {2: [1], 3: [4]})
BY_SIDE_OUT = (2, "B", 4, 2, {2: [1], 3: [3], 4: [4]}, {1: [0], 2: [2], 3: [2]})


@pytest.fixture(scope="module")
def sheets(spark):
    odd = [(3, None, 25, 20, {1: [3]}, {}), (4, "A", None, None, None, None), (5, "A", 3, 3, {1: [1], 2: [3]}, {2: [2]})]
    return spark.createDataFrame([ON_SERVE, BY_SIDE_OUT, *odd], SHEETS)


def test_positions_come_round(spark):
    df = spark.createDataFrame([(1, "B", 30, 28, {1: [9, 20], 2: [1, 12], 3: [3]}, {1: [2, 11], 2: [4]})], SHEETS)
    got = {(r["side"], r["turn"]): (r["position"], r["score"]) for r in sv.service_order(df).collect()}
    assert [got["A", k] for k in range(5)] == [(2, 1), (3, 3), (1, 9), (2, 12), (1, 20)]
    assert [got["B", k] for k in range(3)] == [(1, 2), (2, 4), (1, 11)]


def test_turns_and_the_winning_one(sheets):
    rows = {}
    for r in sv.service_turns(sheets).orderBy("n").collect():
        rows.setdefault(r["set_id"], []).append((r["side"], r["position"], r["score_a"], r["score_b"], r["end_a"], r["end_b"], r["points"], r["wins_set"]))
    assert rows[1] == [("A", 1, 0, 0, 2, 1, 2, False), ("B", 2, 2, 1, 3, 1, 0, False), ("A", 2, 3, 1, 5, 2, 2, False), ("B", 3, 5, 2, 6, 4, 2, False), ("A", 3, 6, 4, 8, 4, 2, True)]
    assert [r[0] for r in rows[2]] == ["B", "A", "B", "A", "B"] and not any(r[-1] for r in rows[2]) and rows[2][-1][4:6] == (4, 2)
    assert 3 not in rows and 4 not in rows and [r[0] for r in rows[5]] == ["A", "B", "A"]


def test_who_serves_follows_the_changes(spark, sheets):
    lineups = spark.createDataFrame(
        [(1, "A", ["a1", "a2", "a3", "a4", "a5", "a6"], [(4, 1, 2, "x"), (3, 2, 2, "early"), (11, 3, 3, "late")]), (1, "B", None, None)],
        "set_id long, side string, formation array<string>, changes array<struct<at:long,event_id:long,position:long,entrant:string>>",
    )
    got = {r["n"]: r["player"] for r in sv.servers(sv.service_turns(sheets.where("set_id = 1")), lineups).collect()}
    assert got == {0: "a1", 1: None, 2: "x", 3: None, 4: "a3"}


def test_side_outs_count_the_lost_rally(sheets):
    got = {r["side"]: r for r in sv.side_outs(sv.service_turns(sheets.where("set_id = 1"))).collect()}
    assert (got["A"]["served"], got["A"]["breaks"], got["A"]["received"], got["A"]["won"], got["A"]["at_once"]) == (8, 6, 4, 2, 1)
    assert (got["B"]["served"], got["B"]["received"], got["B"]["won"], got["B"]["side_out_pct"]) == (4, 8, 2, 25.0)
    figures = {r["position"]: (r["won"], r["lost"]) for r in sv.rotation_figures(sv.service_turns(sheets.where("set_id = 1"))).where("side = 'A'").collect()}
    assert figures == {1: (2, 1), 2: (2, 1), 3: (2, 0)}


def test_empty_sheets(spark):
    none = spark.createDataFrame([], SHEETS)
    assert sv.service_turns(none).count() == sv.side_outs(sv.service_turns(none)).count() == 0
