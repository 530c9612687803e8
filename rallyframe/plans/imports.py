"""Queries over the import of exports and sheets, with their SQL."""

from pyspark.sql import functions as F

from rallyframe.plans.registry import query
from rallyframe.sources.storage import stored
from rallyframe.streaming import imports as im


def _batches(c):
    """Exports of all played matches, then sheets of two thirds of them (some named the other way round, some of another score, some of
    matches without an export), then corrected exports of some."""
    names = c.teams.select("team_id", "team")
    played = stored(c.matches.where("played and not forfeit").select("match_id", "season", "competition", "day", "team_a", "team_b", "sets_a", "sets_b"), "played")  # read by all batches
    m = played.join(names.withColumnsRenamed({"team_id": "team_a", "team": "name_a"}), "team_a").join(names.withColumnsRenamed({"team_id": "team_b", "team": "name_b"}), "team_b")
    k, score = F.col("match_id"), lambda a, b: F.concat_ws("/", a, b)
    key = (F.col("season").cast("string").alias("season"), "competition", k.cast("string").alias("code"))
    row = lambda source, at, a, b, day, hall, points, sets: m.select(*key, F.lit(source).alias("source"), F.lit(at).alias("read_at"), a.alias("team_a"), b.alias("team_b"), day.alias("day"), hall.alias("hall"), points.alias("score"), sets.cast(im.SETS).alias("sets"), k.alias("match_id"))
    none, a, b = F.lit(None).cast("string"), F.col("sets_a"), F.col("sets_b")
    export = row("export", 1, F.col("name_a"), F.col("name_b"), F.when(k % 5 != 0, F.col("day")), F.when(k % 2 == 0, F.lit("hall")), score(a, b), F.lit(None)).where("match_id % 7 <> 0")
    swap = k % 4 == 0
    x, y = F.when(k % 9 == 0, 3).otherwise(a), F.when(k % 9 == 0, 0).otherwise(b)
    one = F.array(F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b")))
    sheet = row("sheet", 2, F.when(swap, F.col("name_b")).otherwise(F.col("name_a")), F.when(swap, F.col("name_a")).otherwise(F.col("name_b")), F.col("day"), F.lit("from sheet"), F.when(swap, score(y, x)).otherwise(score(x, y)), one).where("match_id % 3 > 0 or match_id % 9 = 0")
    late = row("export", 3, F.col("name_a"), F.col("name_b"), F.col("day"), none, F.lit("3/2"), F.lit(None)).where("match_id % 10 = 1 and match_id % 7 <> 0")
    return [df.drop("match_id") for df in (export, sheet, late)]


def _state(c, again: bool = False):
    state = im.no_matches(c.spark)
    for batch in _batches(c):
        for _ in range(2 if again else 1):
            state = im.merge_batch(state, batch)
    return state


_SHOWN = "season, competition, code, team_a, team_b, day, hall, score, score_export, score_sheet, details, turned, status, version"
_IMPORTS = """,
im AS (SELECT m.*, a.team name_a, b.team name_b, match_id % 7 <> 0 ex, match_id % 3 > 0 OR match_id % 9 = 0 sh, match_id % 10 = 1 AND match_id % 7 <> 0 late, sets_a || '/' || sets_b own, CASE WHEN match_id % 9 = 0 THEN '3/0' ELSE sets_a || '/' || sets_b END on_sheet,
    CASE WHEN match_id % 9 = 0 THEN '0/3' ELSE sets_b || '/' || sets_a END other_way, match_id % 4 = 0 swap FROM matches m JOIN teams a ON a.team_id = team_a JOIN teams b ON b.team_id = team_b WHERE played AND NOT forfeit),
i1 AS (SELECT *, CASE WHEN late THEN '3/2' WHEN ex THEN own END score_export, CASE WHEN sh THEN CASE WHEN swap AND NOT ex THEN other_way ELSE on_sheet END END score_sheet, late AND own <> '3/2' moved FROM im WHERE ex OR sh),
i2 AS (SELECT CAST(season AS VARCHAR) season, competition, CAST(match_id AS VARCHAR) code, CASE WHEN swap AND NOT ex THEN name_b ELSE name_a END team_a, CASE WHEN swap AND NOT ex THEN name_a ELSE name_b END team_b,
    CASE WHEN ex AND (match_id % 5 <> 0 OR late) OR sh THEN day END AS day, CASE WHEN ex AND match_id % 2 = 0 THEN 'hall' WHEN sh THEN 'from sheet' END hall, coalesce(score_export, score_sheet) score, score_export, score_sheet, sh details, sh AND swap AND ex turned,
    CASE WHEN NOT sh OR moved THEN 'queued' WHEN ex AND own <> on_sheet THEN 'conflict' ELSE 'parsed' END status,
    CAST(1 + CASE WHEN ex AND sh THEN 1 ELSE 0 END + CASE WHEN late AND (own <> '3/2' OR (match_id % 5 = 0 AND NOT sh)) THEN 1 ELSE 0 END AS BIGINT) version FROM i1)
"""
query("l10_merged_batches", lambda c: _state(c).selectExpr(*_SHOWN.split(", ")), _IMPORTS + f"SELECT {_SHOWN} FROM i2")
query("l10_batches_applied_twice", lambda c: _state(c, again=True).selectExpr(*_SHOWN.split(", ")), _IMPORTS + f"SELECT {_SHOWN} FROM i2")
query("l10_queue", lambda c: im.queue(_state(c)), _IMPORTS + "SELECT season, competition, code, version FROM i2 WHERE status = 'queued'")
