"""The match filter that all statistics share: plain predicates, and semi-joins for what hangs on teams."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.scalars import LEVEL_RANKS

#: How a level label belongs to an echelon, by parts of the upper-case label.
ECHELONS = {
    "NATIONAL": ("ELITE", "NATIONAL", "PRO"),
    "REGIONAL": ("REGION", "PRE_NAT", "PRE NAT"),
    "DEPARTEMENTAL": ("DEPART", "LOISIR"),
}
#: The spellings of each gender.
GENDERS = {"M": ("M", "MASCULIN", "HOMME"), "F": ("F", "FEMININ", "FEMME"), "X": ("MIXTE", "X")}


@dataclass(frozen=True)
class MatchFilter:
    seasons: tuple[int, ...] = ()
    season: int | None = None
    first_day: str | None = None
    last_day: str | None = None
    competition: str | None = None
    echelon: str | None = None
    club_id: int | None = None
    league_id: int | None = None
    department: str | None = None
    gender: str | None = None
    category: str | None = None
    level: str | None = None
    least_level: str | None = None
    most_level: str | None = None
    team_ids: tuple[int, ...] = field(default=())

    def days(self) -> tuple[str | None, str | None]:
        """The range, in order even if given the wrong way round."""
        a, b = self.first_day, self.last_day
        return (b, a) if a and b and a > b else (a, b)


def echelon_is(label: Column, echelon: str) -> Column:
    """Whether a level label belongs to the echelon; a pre-national label belongs to two, as the parts say."""
    found = F.lit(False)
    for part in ECHELONS[echelon]:
        found = found | F.contains(F.upper(label), F.lit(part))
    return F.coalesce(found, F.lit(False))


def gender_is(label: Column, wanted: str) -> Column:
    """Whether a gender label is the wanted one in any spelling; of mixed ones it is enough to say so."""
    for key, names in GENDERS.items():
        if wanted.strip().upper() in names:
            return F.contains(F.upper(label), F.lit("MIXTE")) if key == "X" else F.upper(label).isin(*names)
    return label == wanted


def level_between(label: Column, least: str | None, most: str | None) -> Column:
    """Whether a level label ranks within the bounds, both included.  An unknown bound bounds nothing; unknown labels stay
    only where no bound is known, and so does everything where the bounds leave no level."""
    low, high = (LEVEL_RANKS.get(x.upper()) if x else None for x in (least, most))
    within = [k for k, rank in LEVEL_RANKS.items() if (low is None or rank >= low) and (high is None or rank <= high)]
    return F.lit(True) if (low is None and high is None) or not within else F.upper(label).isin(*within)


def division_conditions(f: MatchFilter) -> list[Column]:
    """The conditions on a division (``gender``, ``category``, ``level``) that the filter sets."""
    out = []
    if f.gender:
        out.append(gender_is(F.col("gender"), f.gender))
    if f.category:
        out.append(F.col("category") == f.category)
    if f.level:
        out.append(F.upper("level") == f.level.upper())
    if f.least_level or f.most_level:
        out.append(level_between(F.col("level"), f.least_level, f.most_level))
    return out


def filtered(matches: DataFrame, f: MatchFilter, sides: DataFrame | None = None, teams: DataFrame | None = None, clubs: DataFrame | None = None, divisions: DataFrame | None = None) -> DataFrame:
    """Played matches that pass; a condition that isn't set costs no join.

    ``divisions``: season, competition, gender, category, level, one row a division; matches of unknown divisions pass no
    condition on them.
    """
    out = matches.where("played")
    seasons = sorted({*f.seasons, *([f.season] if f.season is not None else [])})
    if seasons:
        out = out.where(F.col("season").isin(*seasons))
    first, last = f.days()
    if first:
        out = out.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col("day") <= F.lit(last).cast("date"))
    if f.competition:
        out = out.where(F.col("competition") == f.competition)
    if f.echelon:
        out = out.where(echelon_is(F.col("competition"), f.echelon))
    conditions = division_conditions(f)
    if conditions:
        out = out.join(divisions.where(reduce(lambda a, b: a & b, conditions)), ["season", "competition"], "left_semi")
    if f.club_id is not None or f.league_id is not None or f.department is not None or f.team_ids:
        scope = teams
        if f.club_id is not None:
            scope = scope.where(F.col("club_id") == f.club_id)
        if f.league_id is not None:
            scope = scope.join(clubs.where(F.col("league_id") == f.league_id), "club_id", "left_semi")
        if f.department is not None:
            scope = scope.join(clubs.where(F.col("department") == f.department), "club_id", "left_semi")
        if f.team_ids:
            scope = scope.where(F.col("team_id").isin(*f.team_ids))
        touched = sides.join(scope, "team_id", "left_semi").select("match_id")
        out = out.join(touched, "match_id", "left_semi")
    return out
