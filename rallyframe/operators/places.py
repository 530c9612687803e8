"""Markers of a map: clubs, halls and matches with their places, by scope and bounding box."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import geo

#: What a marker has beside its place.
FIELDS = ("kind", "entity_id", "name", "club_id", "league_id", "competition", "season")
PLACE = ("lat", "lon", "city", "address", "department")


@dataclass(frozen=True)
class MapScope:
    """Which markers are asked for; a condition that isn't set holds for all.

    box: south, west, north, east (a box over the date line has west > east).
    """

    kinds: tuple[str, ...] = ()
    club_id: int | None = None
    league_id: int | None = None
    competition: str | None = None
    season: int | None = None
    departments: tuple[str, ...] = ()
    text: str | None = None
    box: tuple[float, float, float, float] | None = None

    def wanted(self) -> tuple[str, ...]:
        """The kinds: those named; on a club's page its club and halls, lest matches flood the map; else all."""
        return self.kinds or (("club", "hall") if self.club_id is not None else ("club", "hall", "match"))


def map_entities(clubs: DataFrame, halls: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per club, hall and match.  A match stands in its hall where that has any place, else at the host club's seat.

    Clubs: club_id, club, league_id and the columns of PLACE.  Halls: hall_id, hall, club_id and PLACE.  Matches: match_id,
    season, competition, hall_id (null: unknown), club_id (host's).
    """
    null = F.lit(None)
    c = clubs.select(F.lit("club").alias("kind"), F.col("club_id").alias("entity_id"), F.col("club").alias("name"), "club_id", "league_id", null.cast("string").alias("competition"), null.cast("int").alias("season"), *PLACE)
    leagues = clubs.select("club_id", "league_id")
    h = halls.join(leagues, "club_id", "left").select(F.lit("hall").alias("kind"), F.col("hall_id").alias("entity_id"), F.col("hall").alias("name"), "club_id", "league_id", null.cast("string").alias("competition"), null.cast("int").alias("season"), *PLACE)
    there = geo.valid_place(F.col("lat"), F.col("lon")) | F.col("city").isNotNull() | F.col("address").isNotNull() | F.col("department").isNotNull()
    hall = halls.where(there).select("hall_id", F.col("hall").alias("name"), F.struct(*PLACE).alias("in_hall"))
    seat = clubs.select("club_id", "league_id", F.struct(*PLACE).alias("at_seat"))
    m = matches.join(hall, "hall_id", "left").join(seat, "club_id", "left").withColumn("p", F.coalesce("in_hall", "at_seat"))
    m = m.select(F.lit("match").alias("kind"), F.col("match_id").alias("entity_id"), "name", "club_id", "league_id", "competition", "season", *(F.col(f"p.{k}").alias(k) for k in PLACE))
    return c.unionByName(h).unionByName(m)


def markers(clubs: DataFrame, halls: DataFrame, matches: DataFrame, cities: DataFrame, centres: DataFrame, scope: MapScope = MapScope()) -> DataFrame:
    """The markers of a scope: FIELDS, department, lat, lon, source.  What has no place has no marker.

    With a competition or season, clubs and halls are those of clubs that host in it.
    """
    if scope.competition is not None:
        matches = matches.where(F.col("competition") == scope.competition)
    if scope.season is not None:
        matches = matches.where(F.col("season") == scope.season)
    each = map_entities(clubs, halls, matches).where(F.col("kind").isin(*scope.wanted()))
    if scope.competition is not None or scope.season is not None:
        hosts = matches.select("club_id").distinct()
        each = each.where("kind = 'match'").unionByName(each.where("kind <> 'match'").join(hosts, "club_id", "left_semi").select(*each.columns))
    if scope.club_id is not None:
        each = each.where(F.col("club_id") == scope.club_id)
    if scope.league_id is not None:
        each = each.where(F.col("league_id") == scope.league_id)
    if scope.text:
        each = each.where(F.contains(F.lower(F.concat_ws(" ", "name", "city")), F.lit(scope.text.lower())))
    found = geo.resolve_places(each, cities, centres).where("source is not null")
    if scope.departments:
        found = found.where(F.col("department").isin(*(d.strip().upper().zfill(2) for d in scope.departments)))
    if scope.box:
        south, west, north, east = scope.box
        across = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
        found = found.where(F.col("lat").between(south, north) & across)
    return found.select(*FIELDS, "department", "lat", "lon", "source")
