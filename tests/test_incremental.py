"""Rollups down the chain after batches, and stored results by content."""

import datetime

import pytest

from rallyframe.operators import leaders as ld
from rallyframe.streaming import incremental as inc

MATCH = "match_id long, season int, competition string, day date, round string, forfeit boolean, forfeit_by string, played boolean, team_a long, team_b long, sets_a int, sets_b int, points_a long, points_b long"
APPEARANCE = "match_id long, player_id long, side string, points long, serves long, runs long, longest_run long, confidence long, captain boolean, libero boolean, role string, season int, competition string, day date, played boolean, team_id long, sets_for int, sets_against int"


def match(k, a, b, sets=(3, 1)):
    return (k, 2020 + k % 2, "c", datetime.date(2020, 1, k), None, False, None, True, a, b, *sets, 90, 80)


def player(k, p, team, sets=(3, 1), points=5):
    return (k, p, "A", points, 4, 2, 3, 50, False, False, "central", 2020 + k % 2, "c", datetime.date(2020, 1, k), True, team, *sets)


@pytest.mark.parametrize("batch", [(4,), (2, 3), (1, 2, 3, 4, 5)])
def test_a_batch_equals_building_anew_and_again_changes_nothing(spark, batch):
    matches = [match(k, 1 + k % 3, 1 + (k + 1) % 3) for k in range(1, 6)]
    people = [player(k, p, 1 + k % 3) for k in range(1, 6) for p in (10 + k % 2, 20)]
    teams = spark.createDataFrame([(1, "x", 7), (2, "y", 7), (3, "z", 8)], "team_id long, team string, club_id long")
    # match 2 was played otherwise before: player 99 stood in it, and leaves with the batch
    before = [x for x in people if x[0] not in batch] + ([player(2, 99, 3)] if 2 in batch else [])
    old = inc.build(spark.createDataFrame(before, APPEARANCE), spark.createDataFrame([m for m in matches if m[0] not in batch] or matches[:0], MATCH), teams)
    m, a = spark.createDataFrame(matches, MATCH), spark.createDataFrame(people, APPEARANCE)
    former = spark.createDataFrame([player(2, 99, 3)], APPEARANCE) if 2 in batch else None
    new = m.where(m.match_id.isin(*batch))
    once = inc.refresh(old, a, m, teams, new, former)
    twice = inc.refresh(once, a, m, teams, new)
    whole = inc.build(a, m, teams)
    for name in ("teams", "players", "careers", "clubs"):
        rows = lambda r: sorted(map(repr, getattr(r, name).select(*getattr(whole, name).columns).collect()))  # noqa: E731, B023
        assert rows(once) == rows(whole), name
        if len(batch) == 1:
            assert rows(twice) == rows(whole), name


def test_results_are_computed_once_per_content(spark, tmp_path):
    rows = [(1, "a", 2.0), (2, None, 3.0), (3, "c", None)]
    df = lambda r: spark.createDataFrame(r, "id long, name string, x double")
    kept = ld.StoredResults(spark, f"file://{tmp_path}/results")
    ask = lambda frame, key="all": kept.get(key, [frame], lambda: frame.groupBy("name").count()).count()
    assert ask(df(rows)) == ask(df(rows[::-1]).repartition(3)) == 3 and kept.computed == 1
    # an edit in place keeps number and ids, yet moves the version; another filter is another result
    assert ask(df([(1, "a", 2.0), (2, None, 3.5), (3, "c", None)])) == 3 and kept.computed == 2
    assert ask(df(rows), "season") == 3 and kept.computed == 3 and ask(df(rows)) == 3 and kept.computed == 3
    assert ld.content_version(df([])).collect()[0]["version"] == "0"
    assert ld.content_version(df([(1, None, None)])).first() != ld.content_version(df([(1, "", None)])).first()
