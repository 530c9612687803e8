"""Places by falling exactness and the markers of a map, by hand."""

import math

import pytest

from rallyframe.functions import geo
from rallyframe.operators import places as pl

ENTITY = "entity_id long, lat double, lon double, city string, address string, department string"


@pytest.fixture(scope="module")
def tables(spark):
    cities = spark.createDataFrame([("OAKHAM", 45.5, 3.5)], "city string, lat double, lon double")
    centres = spark.createDataFrame([("03", 46.0, 4.0), ("2A", 41.9, 8.9)], "department string, lat double, lon double")
    return cities, centres


def test_falling_exactness(spark, tables):
    rows = [
        (1, 44.0, 2.0, "Oakham", None, "03"), (2, 0.0, 0.0, "10200 oakham", None, None), (3, 91.0, 2.0, None, None, " 3"), (4, None, 2.0, "20100 Sartene", None, None),
        (5, None, None, "nowhere", "2 lane 03100 x", None), (6, None, None, None, None, "99"), (7, None, None, "  ", "", ""), (12, None, None, "OAKHAM", None, "03"),
    ]
    got = {r["entity_id"]: (r["source"], r["lat"], r["lon"]) for r in geo.resolve_places(spark.createDataFrame(rows, ENTITY), *tables).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "own", 2: "city", 3: "department", 4: "department", 5: "department", 6: None, 7: None, 12: "city"}
    assert got[1][1:] == (44.0, 2.0)
    # a nudge of (id % 5 - 2) * 0.0008 degrees at id * 47 degrees, and of 0.004 + id % 7 * 0.002 at id * 37
    assert got[12][1:] == pytest.approx((45.5, 3.5))
    assert got[3][1:] == pytest.approx((46 + math.sin(math.radians(111)) * 0.01, 4 + math.cos(math.radians(111)) * 0.01))


def test_markers_by_scope(spark, tables):
    place = "lat double, lon double, city string, address string, department string"
    clubs = spark.createDataFrame([(1, "north", 10, 50.0, 2.0, None, None, None), (2, "south", 20, None, None, "Oakham", None, None), (3, "lost", 20, None, None, None, None, None)], f"club_id long, club string, league_id long, {place}")
    halls = spark.createDataFrame([(7, "big hall", 1, 50.1, 179.9, None, None, None), (8, "bare hall", 2, None, None, None, None, None)], f"hall_id long, hall string, club_id long, {place}")
    matches = spark.createDataFrame([(100, 2024, "x", 7, 1), (101, 2024, "y", 8, 2), (102, 2023, "x", None, 1), (103, 2023, "x", None, 3)], "match_id long, season int, competition string, hall_id long, club_id long")
    ask = lambda **s: {(r["kind"], r["entity_id"]) for r in pl.markers(clubs, halls, matches, *tables, pl.MapScope(**s)).collect()}
    assert ask() == {("club", 1), ("club", 2), ("hall", 7), ("match", 100), ("match", 101), ("match", 102)}
    assert ask(club_id=1) == {("club", 1), ("hall", 7)} and ask(club_id=1, kinds=("match",)) == {("match", 100), ("match", 102)}
    assert ask(season=2024, competition="y") == {("club", 2), ("match", 101)}
    assert ask(box=(50.0, 179.0, 51.0, -179.0)) == {("hall", 7), ("match", 100)}
    assert ask(text="OAK") == {("club", 2), ("match", 101)} and ask(league_id=20) == {("club", 2), ("match", 101)}
    at = {(r["kind"], r["entity_id"]): r["source"] for r in pl.markers(clubs, halls, matches, *tables).collect()}
    assert at["match", 101] == "city" and at["match", 102] == "own"
    assert pl.markers(clubs.limit(0), halls.limit(0), matches.limit(0), *tables).count() == 0
