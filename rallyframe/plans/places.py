"""Queries over places and map markers, with their SQL."""

from pyspark.sql import functions as F

from rallyframe.operators import places as pl
from rallyframe.plans.registry import query


def _club_seats(c):
    """Clubs with what is known of their seats: coordinates, a city with postcode, an address, a department, or nothing."""
    k = F.col("club_id")
    return c.clubs.select(
        "club_id", "club", "league_id", F.when(k % 5 == 0, 40 + k / 2.0).when(k % 5 == 4, 0.0).alias("lat"), F.when(k % 5 == 0, k / 4.0).when(k % 5 == 4, 0.0).alias("lon"),
        F.when(k % 5 == 1, F.concat(F.lit("1"), F.lpad((k % 3).cast("string"), 1, "0"), F.lit("100 town "), (k % 4).cast("string"))).alias("city"),
        F.when(k % 5 == 2, F.concat(F.lit("1 road, 1"), (k % 3).cast("string"), F.lit("200 elsewhere"))).alias("address"), F.when(k % 5 == 4, (k % 9 + 1).cast("string")).alias("department"),
    )


def _halls(c):
    """A hall per team: some with coordinates, some with a city of the table, some with nothing."""
    k = F.col("team_id")
    return c.teams.select(
        k.alias("hall_id"), F.concat(F.lit("hall of "), "team").alias("hall"), "club_id", F.when(k % 4 == 0, 45 + k / 50.0).alias("lat"), F.when(k % 4 == 0, 2 + k / 100.0).alias("lon"),
        F.when(k % 4 == 1, F.concat(F.lit("Town "), (k % 6).cast("string"))).alias("city"), F.lit(None).cast("string").alias("address"), F.when(k % 4 == 2, F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("department"),
    )


def _inputs(c):
    host = c.teams.select(F.col("team_id").alias("team_a"), "club_id")
    matches = c.matches.where("played").join(host, "team_a").select("match_id", "season", "competition", F.when(F.col("match_id") % 11 != 0, F.col("team_a")).alias("hall_id"), "club_id")
    cities = c.clubs.where("club_id < 4").select(F.concat(F.lit("TOWN "), F.col("club_id").cast("string")).alias("city"), (46 + F.col("club_id") / 10.0).alias("lat"), (3 + F.col("club_id") / 8.0).alias("lon"))
    centres = c.clubs.where("club_id < 16").select(F.lpad((F.col("club_id") + 1).cast("string"), 2, "0").alias("department"), (44 + F.col("club_id") / 5.0).alias("lat"), (1 + F.col("club_id") / 5.0).alias("lon"))
    return _club_seats(c), _halls(c), matches, cities, centres


_MARKERS = """,
cb AS (SELECT club_id k, club, league_id, CASE WHEN club_id % 5 = 0 THEN 40 + club_id / 2.0 WHEN club_id % 5 = 4 THEN 0 END::DOUBLE lat, CASE WHEN club_id % 5 = 0 THEN club_id / 4.0 WHEN club_id % 5 = 4 THEN 0 END::DOUBLE lon,
  CASE WHEN club_id % 5 = 1 THEN '1' || club_id % 3 || '100 town ' || club_id % 4 END city, CASE WHEN club_id % 5 = 2 THEN '1 road, 1' || club_id % 3 || '200 elsewhere' END address, CASE WHEN club_id % 5 = 4 THEN CAST(club_id % 9 + 1 AS VARCHAR) END department FROM clubs),
hl AS (SELECT team_id hall_id, 'hall of ' || team hall, club_id k, CASE WHEN team_id % 4 = 0 THEN 45 + team_id / 50.0 END::DOUBLE lat, CASE WHEN team_id % 4 = 0 THEN 2 + team_id / 100.0 END::DOUBLE lon,
  CASE WHEN team_id % 4 = 1 THEN 'Town ' || team_id % 6 END city, CAST(NULL AS VARCHAR) address, CASE WHEN team_id % 4 = 2 THEN lpad(CAST(team_id % 12 + 1 AS VARCHAR), 2, '0') END department FROM teams),
en AS (
  SELECT 'club' kind, k entity_id, club AS name, k club_id, league_id, CAST(NULL AS VARCHAR) competition, CAST(NULL AS INTEGER) season, lat, lon, city, address, department FROM cb
  UNION ALL SELECT 'hall', hall_id, hall, hl.k, league_id, NULL, NULL, hl.lat, hl.lon, hl.city, hl.address, hl.department FROM hl JOIN cb USING (k)
  UNION ALL SELECT 'match', match_id, hall, t.club_id, cb.league_id, competition, season, CASE WHEN hall IS NULL THEN cb.lat ELSE h.lat END, CASE WHEN hall IS NULL THEN cb.lon ELSE h.lon END, CASE WHEN hall IS NULL THEN cb.city ELSE h.city END,
    CASE WHEN hall IS NULL THEN cb.address ELSE h.address END, CASE WHEN hall IS NULL THEN cb.department ELSE h.department END
  FROM matches m JOIN teams t ON t.team_id = team_a JOIN cb ON cb.k = t.club_id LEFT JOIN (SELECT * FROM hl WHERE hall_id % 4 < 3) h ON h.hall_id = team_a AND m.match_id % 11 <> 0 WHERE played),
dp AS (SELECT * REPLACE (coalesce(CASE WHEN length(department) = 1 THEN '0' || department ELSE department END, nullif(substr(regexp_extract(coalesce(city, address), '\\b(\\d{5})\\b', 1), 1, 2), '')) AS department), trim(regexp_replace(upper(city), '^[0-9]{5}\\s*', '')) cn FROM en),
ci AS (SELECT 'TOWN ' || club_id cn, 46 + club_id / CAST(10 AS DOUBLE) cla, 3 + club_id / CAST(8 AS DOUBLE) clo FROM clubs WHERE club_id < 4),
ce AS (SELECT lpad(CAST(club_id + 1 AS VARCHAR), 2, '0') department, 44 + club_id / CAST(5 AS DOUBLE) dla, 1 + club_id / CAST(5 AS DOUBLE) dlo FROM clubs WHERE club_id < 16),
mk AS (SELECT kind, entity_id, name, club_id, league_id, competition, season, department,
  CASE WHEN own THEN lat WHEN cla IS NOT NULL THEN cla + sin(radians(entity_id * 47 % 360)) * (entity_id % 5 - 2) * 0.0008 ELSE dla + sin(radians(entity_id * 37 % 360)) * (0.004 + entity_id % 7 * 0.002) END lat,
  CASE WHEN own THEN lon WHEN cla IS NOT NULL THEN clo + cos(radians(entity_id * 47 % 360)) * (entity_id % 5 - 2) * 0.0008 ELSE dlo + cos(radians(entity_id * 37 % 360)) * (0.004 + entity_id % 7 * 0.002) END lon,
  CASE WHEN own THEN 'own' WHEN cla IS NOT NULL THEN 'city' ELSE 'department' END source
  FROM (SELECT *, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND (lat <> 0 OR lon <> 0), false) own FROM dp LEFT JOIN ci USING (cn) LEFT JOIN ce USING (department)) WHERE own OR cla IS NOT NULL OR dla IS NOT NULL)
"""
_SHOWN = "SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM mk"


def _markers(c, scope=pl.MapScope()):
    found = pl.markers(*_inputs(c), scope)
    return found.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


query("i6_places", _markers, _MARKERS + _SHOWN)
query("i10_markers_of_a_league", lambda c: _markers(c, pl.MapScope(league_id=2, season=1996)), _MARKERS + _SHOWN + " WHERE league_id = 2 AND (season = 1996 OR kind <> 'match' AND club_id IN (SELECT club_id FROM matches JOIN teams ON team_id = team_a WHERE played AND season = 1996))")
query("i10_markers_in_a_box", lambda c: _markers(c, pl.MapScope(kinds=("match", "club"), box=(44.5, 2.0, 46.2, 4.0))), _MARKERS + _SHOWN + " WHERE kind IN ('match', 'club') AND lat BETWEEN 44.5 AND 46.2 AND lon BETWEEN 2 AND 4")
query("i10_markers_of_departments", lambda c: _markers(c, pl.MapScope(departments=("3", " 10"), text="HALL")), _MARKERS + _SHOWN + " WHERE department IN ('03', '10') AND name ILIKE '%hall%'")
