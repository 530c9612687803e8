"""Roundings at a half, as SQL has them."""

import pytest

from rallyframe.operators import points as pt


def test_impacts_at_a_half_are_rounded_as_sql_does(spark):
    """6.449999999999999 times ten is 64.5: the set from a larger table whose impact was 6.4 here and 6.5 in SQL."""
    kinds, rows = {"A": ("A", "point"), "B": ("B", "point"), "t": (None, "timeout"), "s": (None, "substitution")}, []
    for k, c in enumerate("BABABAsBsABBsBsABAAAtAsAsAsAAstAAtAtsABsstAAABAtAAAA"):
        rows.append((1, k, k, *kinds[c], "B" if k == 29 else "A"))
    lines = pt.timeline(spark.createDataFrame(rows, "set_id long, ts long, event_id long, scored_by string, kind string, called_by string"))
    impacts = {x["event_id"]: x["impact"] for x in pt.decisions(lines).collect()}
    assert impacts[29] == pytest.approx(6.5) and impacts[30] == pytest.approx(-6.5)
