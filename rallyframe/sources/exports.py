"""Match exports: semicolon-separated Latin-1 lines with HTML entities, read by Spark and typed by expressions."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import scalars as sc

#: The columns of an export line, in order.
COLUMNS = (
    "entity", "round", "match_code", "day", "hour", "club_a", "team_a", "club_b", "team_b", "score", "set_scores", "total", "hall",
)
LEAST_FIELDS = 13
#: Team names that stand for no team.
PLACEHOLDERS = ("xxxxx", "xxxx", "xxx", "exempt", ".", "-", "aucun", "aucune")
#: Entities that exports hold, with numeric ones beside.
ENTITIES = ("amp", "lt", "gt", "quot", "apos", "nbsp", "eacute", "egrave", "ecirc", "agrave", "acirc", "ocirc", "icirc", "ucirc", "ugrave", "ccedil", "euml", "iuml", "Eacute", "Egrave", "Agrave", "Ccedil")


def unescape(c: Column) -> Column:
    """HTML entities as characters; a numeric one of decimal digits as its code point (below 256)."""
    for name in ENTITIES[1:]:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(html.unescape(f"&{name};")))
    for code in (38, 39, 34, *range(192, 256)):
        c = F.replace(c, F.lit(f"&#{code};"), F.lit(chr(code)))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines of export files as text; the header line (it names its first columns) is left out, blank lines too."""
    raw = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("line string").csv(path)
    return raw.where(F.trim("line") != "")


def parse(lines: DataFrame, season: str, header_word: str = "entit") -> DataFrame:
    """One typed row per match line; short lines, headers and placeholder teams are left out.

    A forfeit ("P" in the score) becomes 0/3, 3/0 or 0/0; 0/0 without one means not played.
    """
    fields = F.split(unescape(F.col("line")), ";")
    rows = lines.where(F.size(F.split("line", ";")) >= LEAST_FIELDS).where(~F.lower("line").startswith(header_word)).select(fields.alias("f"))
    value = lambda k: F.nullif(F.trim(F.col("f")[k]), F.lit(""))
    r = rows.select(*(value(k).alias(name) for k, name in enumerate(COLUMNS)))
    placeholder = lambda c: F.coalesce(F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.lit(False))
    r = r.where(~(placeholder(F.col("team_a")) | placeholder(F.col("team_b")) | (F.col("team_a").isNull() & F.col("team_b").isNull())))
    by = sc.forfeit_of(F.col("score"))
    pair = sc.score_pair(F.col("score"))
    sets = sc.set_list(F.col("set_scores"))
    a = F.when(by == "b", 3).when(by.isNotNull(), 0).otherwise(pair["a"])
    b = F.when(by == "a", 3).when(by.isNotNull(), 0).otherwise(pair["b"])
    played = by.isNotNull() | F.coalesce(a + b > 0, F.lit(False)) | (F.size(sets) > 0)
    return r.select(
        F.lit(season).alias("season"), "entity", "round", "match_code", sc.match_pool(F.col("match_code")).alias("pool"),
        sc.french_date(F.col("day")).alias("day"), "hour", F.col("club_a").alias("club_code"), "team_a", "club_b", "team_b",
        F.when(played, F.concat_ws("/", a.cast("string"), b.cast("string"))).alias("score"), sets.alias("sets"), by.isNotNull().alias("forfeit"), by.alias("forfeit_by"),
        F.when(a > b, F.col("team_a")).when(b > a, F.col("team_b")).alias("winner"), played.alias("played"), "hall",
    )


def merge_sources(export: DataFrame, sheet: DataFrame, keys: list[str]) -> DataFrame:
    """Export and sheet rows of one match as one: the export's score is official, the sheet fills what the export lacks.

    Both have the keys, ``score``, ``day``, ``hour``, ``hall``, ``winner``; the sheet's own score is kept beside.
    """
    e, s = export.alias("e"), sheet.alias("s")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = e.join(s, on, "full")
    first = lambda c: F.coalesce(f"e.{c}", f"s.{c}").alias(c)
    resolved = sc.resolved_score(F.col("e.score"), F.col("s.score"), F.lit(None).cast("string"))
    return both.select(*map(first, keys), *map(first, ("day", "hour", "hall", "winner")), resolved["score"].alias("score"), F.col("s.score").alias("score_sheet"), resolved["conflict"].alias("conflict"))
