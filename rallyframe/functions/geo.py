"""Distances, department codes and coordinate fallbacks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: How far from its department's centre a place may lie, in km.
REACH_KM, REACH_KM_973 = 120.0, 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def department_of_postcode(c: Column) -> Column:
    code = F.trim(c)
    corsica = F.when(F.coalesce(F.substring(code, 1, 5).try_cast("int"), F.lit(0)) < 20200, "2A").otherwise("2B")
    return F.when(F.length(code) < 2, None).when(code.startswith("97"), F.when(F.length(code) >= 3, F.substring(code, 1, 3))).when(code.startswith("20"), corsica).otherwise(F.substring(code, 1, 2))


def department_of_club_code(c: Column) -> Column:
    """From the first three characters of a club's code of seven."""
    p = F.substring(F.upper(F.trim(c)), 1, 3)
    return (
        F.when(F.length(p) < 3, None)
        .when(p.isin("02A", "201"), "2A")
        .when(p.isin("02B", "202"), "2B")
        .when(p.rlike("^9[78]"), p)
        .when(p.rlike(r"^0\d\d"), F.substring(p, 2, 2))
        .when(p.rlike(r"^\d\d"), F.substring(p, 1, 2))
    )


def department_of_address(*texts: Column) -> Column:
    """The department of the first five-digit number in the texts, in order."""
    return F.coalesce(*(department_of_postcode(F.nullif(F.regexp_extract(t, r"\b(\d{5})\b", 1), F.lit(""))) for t in texts))


def near_centre(lat: Column, lon: Column, department: Column, centre_lat: Column, centre_lon: Column, reach: float = REACH_KM) -> Column:
    """Whether a place lies near its department's centre, and its distance; true and 0 where either is unknown."""
    d = haversine_km(lat, lon, centre_lat, centre_lon)
    limit = F.when(department == "973", REACH_KM_973).otherwise(reach)
    return F.struct(F.coalesce(d <= limit, F.lit(True)).alias("inside"), F.coalesce(d, F.lit(0.0).cast("double")).alias("km"))


def jittered(entity_id: Column, lat: Column, lon: Column) -> Column:
    """A department's centre moved by 400 m to 2 km, always alike for one id, so that markers don't cover each other."""
    return _moved(entity_id, lat, lon, 37, F.lit(0.004) + F.pmod(entity_id, F.lit(7)) * 0.002)


def nudged(entity_id: Column, lat: Column, lon: Column) -> Column:
    """A city's place moved by at most 180 m, always alike for one id."""
    return _moved(entity_id, lat, lon, 47, (F.pmod(entity_id, F.lit(5)) - 2) * 0.0008)


def _moved(entity_id: Column, lat: Column, lon: Column, step: int, radius: Column) -> Column:
    angle = F.radians(F.pmod(entity_id * step, F.lit(360)).cast("double"))
    return F.struct((lat + F.sin(angle) * radius).alias("lat"), (lon + F.cos(angle) * radius).alias("lon"))


def valid_place(lat: Column, lon: Column) -> Column:
    """Whether coordinates are some: both known, within the globe, not 0 and 0."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ((lat != 0) | (lon != 0)), F.lit(False))


def city_name(c: Column) -> Column:
    """A city's name in capitals, without a postcode before it."""
    return F.trim(F.regexp_replace(F.trim(F.upper(c)), r"^[0-9]{5}\s*", ""))


def resolve_places(entities: DataFrame, cities: DataFrame, centres: DataFrame) -> DataFrame:
    """The entities with ``lat``, ``lon`` and ``source``, by falling exactness: their own coordinates where valid, their city's,
    nudged, their department's centre, jittered; null without any.

    Entities: ``entity_id``, ``lat``, ``lon``, ``city`` (with or without postcode), ``department``, ``address`` if known, and others.  A
    department not given is that of the postcode in city or address; one of one digit has a nought before it.  Both
    fall-backs are looked up in one pass over the entities.
    """
    named = F.upper(F.trim("department"))
    department = F.coalesce(F.nullif(F.when(named.rlike("^[0-9]$"), F.lpad(named, 2, "0")).otherwise(named), F.lit("")), department_of_address(*(F.col(k) for k in ("city", "address") if k in entities.columns)))
    e = entities.withColumn("department", department).withColumn("_city", F.nullif(city_name(F.col("city")), F.lit("")))
    e = e.join(cities.select(F.upper("city").alias("_city"), F.col("lat").alias("_city_lat"), F.col("lon").alias("_city_lon")), "_city", "left")
    e = e.join(centres.select("department", F.col("lat").alias("_centre_lat"), F.col("lon").alias("_centre_lon")), "department", "left")
    place = lambda lat, lon, source: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.lit(source).alias("source"))
    near, centre = nudged(F.col("entity_id"), F.col("_city_lat"), F.col("_city_lon")), jittered(F.col("entity_id"), F.col("_centre_lat"), F.col("_centre_lon"))
    own = valid_place(F.col("lat"), F.col("lon"))
    found = F.when(own, place(F.col("lat"), F.col("lon"), "own")).when(F.col("_city_lat").isNotNull(), place(near["lat"], near["lon"], "city")).when(F.col("_centre_lat").isNotNull(), place(centre["lat"], centre["lon"], "department"))
    return e.withColumn("_p", found).withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon"), "source": F.col("_p.source")}).select(*entities.columns, "source")


def outliers(places: DataFrame, centres: DataFrame, reach: float = REACH_KM) -> DataFrame:
    """Places too far from their department's centre, farthest first."""
    c = centres.select("department", F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"))
    check = near_centre(F.col("lat"), F.col("lon"), F.col("department"), F.col("centre_lat"), F.col("centre_lon"), reach)
    return places.join(c, "department").withColumn("check", check).where("not check.inside").select("entity_id", "department", F.round("check.km", 3).alias("km")).orderBy(F.desc("km"), "entity_id")
