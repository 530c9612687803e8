"""Plausibility rules over imported matches: each rule is a column of found issues, corrections are columns too.

A rule takes the frame's columns and gives (issue or null, corrected value); rules run in order in one
projection, without a shuffle.  Policies: ``auto`` applies corrections, ``report`` only records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import scalars as sc

ISSUE = "struct<rule:string,field:string,action:string,old:string,new:string>"
#: Months from which a season's first year counts; limits of a duration in minutes.
FIRST_MONTH, SHORTEST, LONGEST = 8, 20, 240


@dataclass(frozen=True)
class Rule:
    """``apply`` gives the field's corrected value and the action ("corrected", "removed") or null, as columns."""

    name: str
    field: str
    apply: Callable[[], tuple[Column, Column]]


def _date_in_season() -> tuple[Column, Column]:
    end = sc.season_end(F.col("season"))
    year = F.when(F.month("day") >= FIRST_MONTH, end - 1).otherwise(end)
    moved = F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(F.month("day").cast("string"), 2, "0"), F.lpad(F.dayofmonth("day").cast("string"), 2, "0")), "yyyy-MM-dd")
    wrong = F.col("day").isNotNull() & year.isNotNull() & (F.year("day") != year)
    return F.when(wrong, moved).otherwise(F.col("day")), F.when(wrong, F.when(moved.isNull(), "removed").otherwise("corrected"))


def _hour() -> tuple[Column, Column]:
    raw = F.trim("hour")
    h, m = (F.regexp_extract(raw, r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*$", k).try_cast("int") for k in (1, 2))
    good = (h <= 23) & (m <= 59)
    fixed = F.when(good, F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0")))
    given = F.coalesce(raw != "", F.lit(False))
    action = F.when(~given, None).when(fixed.isNull(), "removed").when(fixed != raw, "corrected")
    return F.when(given, fixed).otherwise(F.col("hour")), action


def _club_code() -> tuple[Column, Column]:
    raw = F.col("club_code")
    clean = F.trim(raw)
    good = clean.rlike(r"^\d{7}$")
    given = F.coalesce(raw != "", F.lit(False))
    return F.when(~given, raw).when(good, clean), F.when(~given, None).when(~good, "removed").when(clean != raw, "corrected")


#: What several rules read, worked out once per row before them.
HELPERS = {
    "_wins_a": ("sets", lambda: F.size(F.filter("sets", lambda s: s["a"] > s["b"]))),
    "_wins_b": ("sets", lambda: F.size(F.filter("sets", lambda s: s["b"] > s["a"]))),
    "_said": ("score", lambda: sc.set_score(F.col("score"))),
    "_said_pair": ("score", lambda: sc.score_pair(F.col("score"))),
    "_minutes": ("duration", lambda: sc.minutes(F.col("duration"))),
}


def set_wins() -> tuple[Column, Column]:
    return F.col("_wins_a"), F.col("_wins_b")


def _says_played() -> Column:
    pair = F.col("_said_pair")
    return F.coalesce(F.contains(F.col("_said"), F.lit("P")) | (pair["a"] + pair["b"] > 0), F.lit(False))


def _score() -> tuple[Column, Column]:
    a, b = set_wins()
    some = F.coalesce(F.size("sets") > 0, F.lit(False))
    derived = F.when(some, F.concat_ws("/", a.cast("string"), b.cast("string")))
    said, pair = F.col("_said"), F.col("_said_pair")
    numbers = said.rlike(r"^\d+/\d+$")
    range_ = F.coalesce(numbers & ((pair["a"] > 3) | (pair["b"] > 3)), F.lit(False))
    differs = F.coalesce(numbers & ~F.col("forfeit") & (derived != said), F.lit(False))
    missing = some & F.col("score").isNull()
    wrong = range_ | differs | missing
    nothing = ~wrong & F.col("score").isNotNull() & ~_says_played() & ~F.col("forfeit")
    fixed = F.when(wrong, derived).when(nothing, None).otherwise(F.col("score"))
    return fixed, F.when(wrong & derived.isNotNull(), "corrected").when(wrong | nothing, "removed")


def _winner() -> tuple[Column, Column]:
    a, b = set_wins()
    found = F.when(F.col("winner").isNull() & ~F.col("forfeit") & (F.size("sets") > 0), F.when(a > b, F.col("team_a")).when(b > a, F.col("team_b")))
    return F.coalesce("winner", found), F.when(found.isNotNull(), "corrected")


def _played() -> tuple[Column, Column]:
    """A score out of range counts for nothing unless the sets speak."""
    a, b = set_wins()
    pair = F.col("_said_pair")
    said = _says_played() & F.coalesce((pair["a"] <= 3) & (pair["b"] <= 3), F.lit(False))
    should = F.col("forfeit") | said | F.coalesce(a + b > 0, F.lit(False))
    return should, F.when(should != F.col("played"), "corrected")


def _duration() -> tuple[Column, Column]:
    m = F.col("_minutes")
    total = F.aggregate("set_minutes", F.lit(0.0).cast("double"), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    good = lambda c: F.coalesce(c.between(SHORTEST, LONGEST), F.lit(False))
    given = F.coalesce(F.trim("duration") != "", F.lit(False))
    text = F.concat(F.floor(total / 60).cast("string"), F.lit("h"), F.lpad(F.pmod(total, F.lit(60.0)).cast("int").cast("string"), 2, "0"))
    fixed = F.when(~given | good(m), F.col("duration")).when(good(total), text)
    return fixed, F.when(given & ~good(m), F.when(good(total), "corrected").otherwise("removed"))


#: The rules that a frame's columns allow, in order; a new rule is one more entry.
RULES = (
    Rule("date-season", "day", _date_in_season),
    Rule("hour-format", "hour", _hour),
    Rule("club-code-format", "club_code", _club_code),
    Rule("score-sets", "score", _score),
    Rule("winner-inference", "winner", _winner),
    Rule("played-sync", "played", _played),
    Rule("duration-range", "duration", _duration),
)


def check(matches: DataFrame, rules: tuple[Rule, ...] = RULES, policy: str = "auto") -> DataFrame:
    """``matches`` with the corrections (policy ``auto``) and ``issues``, the array of what was found.

    Every rule reads the columns as imported, so all of them are one projection of plain size.
    """
    rules = tuple(r for r in rules if r.field in matches.columns)
    fixed, found = {}, []
    for rule in rules:
        value, action = rule.apply()
        issue = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.field).alias("field"), action.alias("action"), F.col(rule.field).cast("string").alias("old"), value.cast("string").alias("new"))
        found.append(issue)
        if policy == "auto":
            fixed[rule.field] = value
    issues = F.filter(F.array(*found), lambda i: i["action"].isNotNull()) if found else F.array().cast(f"array<{ISSUE}>")
    helped = matches.withColumns({name: make() for name, (source, make) in HELPERS.items() if source in matches.columns})
    return helped.select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in matches.columns), issues.alias("issues"))


def issue_rows(checked: DataFrame, *keep: str) -> DataFrame:
    """One row per issue.  The outer explode keeps the rules out of an inferred filter, where they would be worked out again."""
    return checked.select(*keep, F.explode_outer("issues").alias("i")).where("i.rule is not null").select(*keep, "i.*")


def issue_summary(checked: DataFrame) -> DataFrame:
    """How many issues by rule and action."""
    return issue_rows(checked).groupBy("rule", "action").agg(F.count(F.lit(1)).alias("issues"))


def audit(checked: DataFrame) -> DataFrame:
    """One row: matches, those with issues, and issues by action."""
    actions = lambda a: F.sum(F.size(F.filter("issues", lambda i: i["action"] == a)))
    return checked.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.size("issues") > 0).alias("with_issues"), actions("corrected").alias("corrected"), actions("removed").alias("removed"))


def diagnostics(matches: DataFrame, sets: DataFrame) -> DataFrame:
    """Validation of stored matches against their sets: missing sets, wrong set counts, impossible scores."""
    per = sets.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("score_a") > F.col("score_b")).alias("a"),
        F.count_if(F.col("score_b") > F.col("score_a")).alias("b"),
        F.count_if((F.greatest("score_a", "score_b") < 15) | (F.abs(F.col("score_a") - F.col("score_b")) < 2)).alias("odd"),
    )
    m = matches.join(per, "match_id", "left")
    test = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    normal = F.col("played") & ~F.col("forfeit")
    found = F.array_compact(
        F.array(
            test(normal & F.col("n").isNull(), "no-sets"),
            test(normal & ((F.col("a") != F.col("sets_a")) | (F.col("b") != F.col("sets_b"))), "sets-differ"),
            test(F.col("n") > 5, "too-many-sets"),
            test(F.col("odd") > 0, "odd-score"),
            test(F.col("team_a") == F.col("team_b"), "same-team"),
            test(~F.col("played") & (F.col("n") > 0), "unfinished"),
        )
    )
    return m.select("match_id", F.explode(found).alias("diagnostic"))
