"""The keyed merge of exports and sheets by hand, and followed as a stream."""

import datetime

import pytest

from rallyframe.streaming import imports as im

BATCH = "season string, competition string, code string, source string, read_at long, team_a string, team_b string, day date, hall string, score string, sets array<struct<a:int,b:int>>"
DAY = datetime.date(2024, 3, 9)


def row(code, source, at=1, a="NORTH VB", b="SOUTH VB", day=DAY, hall=None, score=None, sets=None):
    return ("2024", "c", code, source, at, a, b, day, hall, score, sets)


def state(spark, *batches, force=()):
    known = im.no_matches(spark)
    for n, rows in enumerate(batches):
        known = im.merge_batch(known, spark.createDataFrame(rows, BATCH), n in force)
    return {r["code"]: r for r in known.collect()}


EXPORT = row("m1", "export", score="3/1", day=None, hall="big hall")
SHEET = row("m1", "sheet", 2, "SOUTH VB", "NORTH VB", hall="small hall", score="1/3", sets=[(20, 25), (25, 23), (18, 25), (10, 25)])


def test_a_swapped_sheet_is_turned_and_fills_gaps(spark):
    got = state(spark, [EXPORT], [SHEET])["m1"]
    assert (got["team_a"], got["score"], got["score_export"], got["score_sheet"]) == ("NORTH VB", "3/1", "3/1", "3/1")
    assert got["sets"][0] == (25, 20) and got["turned"] and got["details"] and got["status"] == "parsed" and got["version"] == 2
    assert got["day"] == DAY and got["hall"] == "big hall"


@pytest.mark.parametrize("force", [(), (0, 1, 2, 3)])
def test_a_batch_again_changes_nothing(spark, force):
    once = state(spark, [EXPORT, row("m2", "sheet", score="0/3")], [SHEET], force=force)
    assert state(spark, [EXPORT, row("m2", "sheet", score="0/3")], [SHEET], [SHEET], [SHEET], force=force) == once
    together = state(spark, [EXPORT, SHEET, SHEET, row("m1", "sheet", 1, score="9/9")])
    assert together["m1"]["score"] == "3/1" and together["m1"]["sets"] == once["m1"]["sets"]
    assert state(spark, [EXPORT, SHEET], [EXPORT, SHEET]) == state(spark, [EXPORT, SHEET])


def test_a_read_sheet_is_read_again_only_when_forced_or_queued(spark):
    other = row("m1", "sheet", 3, score="3/2", sets=[(1, 2)])
    assert state(spark, [EXPORT], [SHEET], [other])["m1"]["score_sheet"] == "3/1"
    forced = state(spark, [EXPORT], [SHEET], [other], force=(2,))["m1"]
    assert (forced["score"], forced["score_sheet"], forced["status"], forced["sets"]) == ("3/2", "3/2", "conflict", [(1, 2)])
    # what was forced holds against the same export, not against a corrected one
    assert state(spark, [EXPORT], [SHEET], [other], [EXPORT], force=(2,))["m1"]["score"] == "3/2"
    moved = state(spark, [EXPORT], [SHEET], [row("m1", "export", 4, score="3/2")])["m1"]
    assert (moved["score"], moved["status"], moved["score_sheet"]) == ("3/2", "queued", "3/1")
    again = state(spark, [EXPORT], [SHEET], [row("m1", "export", 4, score="3/2")], [other])["m1"]
    assert (again["status"], again["score_sheet"], again["sets"]) == ("parsed", "3/2", [(1, 2)])


def test_odd_batches(spark):
    assert state(spark, []) == {}
    got = state(spark, [row(None, "export", score="3/0"), row("m3", "export", a=None, b=None), row("m4", "sheet", score="odd", sets=[])])
    assert set(got) == {"m3", "m4"} and got["m3"]["status"] == got["m4"]["status"] == "queued" and got["m4"]["score"] == "odd"


def test_a_stream_of_batches(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/states"
    for rows in ([EXPORT, row("m2", "export", score="0/3")], [SHEET]):
        spark.createDataFrame(rows, BATCH).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        im.keep_matches(stream, folder, f"file://{tmp_path}/checkpoint").awaitTermination(120)
    got = {r["code"]: r for r in im.latest(spark, folder).collect()}
    assert got["m1"]["sets"][0] == (25, 20) and got["m2"]["status"] == "queued"
    assert [r["code"] for r in im.queue(im.latest(spark, folder)).collect()] == ["m2"]
