"""What hangs on the amount of work: views stored once, one shuffle of a match's lines, tasks by the size of a table."""

import pytest
from pyspark.sql import functions as F

from rallyframe import plans
from rallyframe.functions import names as nm
from rallyframe.operators import roles as ro
from rallyframe.sources import storage
from rallyframe.sources.views import Contest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c24_whole_report", "f8_careers_incremental", "f8_players_incremental", "f8_clubs_incremental", "h4_role_diffusion", "j2_player_page", "l10_merged_batches", "l10_batches_applied_twice"])
def test_lines_are_read_once_and_stored(spark, sf_dir, name):
    """The result reads stored tables: no block, batch, board or pass works the lines of all matches out again."""
    assert not [f for f in plans.QUERIES[name](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_appearances_shuffle_lines_and_fixtures_only(spark, sf_dir):
    plan = _plan(Contest(spark, sf_dir).appearances)
    assert plan.count("Exchange hashpartitioning") <= 3  # lines for the players, lines for the sets, fixtures


def test_careers_read_appearances_once(spark, sf_dir):
    plan = _plan(plans.QUERIES["f3_player_careers"](spark, sf_dir))
    assert plan.count("lineitem.parquet") <= 2 and plan.count("Exchange hashpartitioning") <= 5  # with one for the distinct seasons and teams


def test_tasks_grow_with_the_files(spark, sf_dir, monkeypatch):
    few = Contest(spark, sf_dir).tasks
    monkeypatch.setattr(storage, "TASK_BYTES", 1 << 12)
    many = Contest(spark, sf_dir)
    assert many.tasks > few and many.appearances.rdd.getNumPartitions() == many.tasks


def test_normal_forms_only_where_exact_names_are_open(spark):
    rows = [("Redon VBC", "Nantes", "NANTES", "redon vbc", True), ("Redon VBC", "Nantes", "Redon", "Nante", False), ("Redon VBC", "Nantes", "Nante", "Redon VB", True), ("A", "B", "A", "A", False)]
    df = nm.with_swaps(spark.createDataFrame(rows, "a string, b string, x string, y string, want boolean"), "a", "b", "x", "y")
    assert [r for r in df.collect() if r["swapped"] != r["want"]] == []
    assert "_exact" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.where(F.col("swapped").isNull()).count() == 0


@pytest.mark.parametrize("name", ["h2_role_beliefs", "h7_rebuilt_seasons"])
def test_beliefs_are_summed_by_hash(spark, sf_dir, name):
    """No sort and no window of a player's roles; only the matches' own lines are sorted for their sets."""
    plan = _plan(plans.QUERIES[name](spark, sf_dir))
    assert "max_by" not in plan and "row_number" not in plan


def test_of_equal_shares_the_first_role_by_name(spark):
    rows = [(1, "A", 7, "pointu", 1.8), (1, "A", 7, "passeur", 1.8), (1, "B", 7, "libero", 3.0), (2, "A", 9, "central", 0.0), (2, "A", 9, "libero", 5.0)]
    got = {tuple(r) for r in ro.solve(spark.createDataFrame(rows, "match_id long, side string, player_id long, role string, score double")).collect()}
    assert got == {(1, "A", 7, "passeur", 0.5, 0.301), (1, "B", 7, "libero", 1.0, 0.755), (2, "A", 9, "libero", 1.0, 0.822)}
