"""Rollups kept up to date from a stream of imported matches, and windows over the event stream.

A batch of matches touches some keys; those keys' rows are rebuilt from all their matches, so applying
a batch again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rallyframe.operators.relational import replace_for_keys
from rallyframe.operators.rollups import PLAYER_KEY, career_days, club_rollup, player_careers, player_seasons, team_seasons
from rallyframe.sources.views import sides_of


def touched_groups(batch: DataFrame) -> DataFrame:
    """The (season, competition) groups that a batch of matches touches: ranks within them may change."""
    return batch.select("season", "competition").distinct()


def apply_matches(rollup: DataFrame, matches: DataFrame, batch: DataFrame) -> DataFrame:
    """The team rollup after a batch: lines of touched groups rebuilt from all their matches, the others as they were."""
    again = matches.join(touched_groups(batch), ["season", "competition"], "left_semi")
    return replace_for_keys(rollup, team_seasons(sides_of(again)).select(*rollup.columns), ["season", "competition"])


@dataclass(frozen=True)
class Rollups:
    """The chain: team and player lines by season, careers and clubs, each built from the one before."""

    teams: DataFrame
    players: DataFrame
    careers: DataFrame
    clubs: DataFrame


def build(appearances: DataFrame, matches: DataFrame, teams: DataFrame, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> Rollups:
    """All rollups from all matches; ``store`` may keep the player lines, which careers and clubs are built from."""
    lines, people = team_seasons(sides_of(matches)), store(player_seasons(appearances))
    return Rollups(lines, people, player_careers(people, career_days(appearances)), club_rollup(lines, teams, people))


def _replaced(old: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of touched keys go, whether or not the new rows still have the key."""
    same = reduce(lambda a, b: a & b, (old[k].eqNullSafe(touched[k]) for k in keys))
    return old.join(touched, same, "left_anti").unionByName(new.select(*old.columns))


def refresh(rollups: Rollups, appearances: DataFrame, matches: DataFrame, teams: DataFrame, batch: DataFrame, former: DataFrame | None = None, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> Rollups:
    """The rollups after a batch of matches, of which only what hangs on them is built anew.

    ``appearances`` and ``matches`` hold the batch already; ``former``: the appearances that its matches had before, so that
    players taken out of a match are touched too.  Touched keys travel down the chain: player lines of who plays in the
    batch, careers of those players, clubs of those teams.  ``store`` may keep interim tables.
    """
    now = appearances.join(batch.select("match_id").distinct(), "match_id", "left_semi")
    both = now if former is None else now.unionByName(former.select(*now.columns))
    keys = store(both.select(*PLAYER_KEY).distinct())
    match = reduce(lambda a, b: a & b, (appearances[k].eqNullSafe(keys[k]) for k in PLAYER_KEY))
    lines = apply_matches(rollups.teams, matches, batch)
    players = store(_replaced(rollups.players, player_seasons(appearances.join(keys, match, "left_semi")), keys, PLAYER_KEY))
    people = store(keys.select("player_id").distinct())
    careers = player_careers(players.join(people, "player_id", "left_semi"), career_days(appearances.join(people, "player_id", "left_semi")))
    sides = sides_of(batch).select("team_id").union(keys.select("team_id")).distinct()
    clubs = store(teams.join(sides, "team_id", "left_semi").select("club_id").distinct())
    members = teams.join(clubs, "club_id", "left_semi")
    return Rollups(lines, players, _replaced(rollups.careers, careers, people, ["player_id"]), _replaced(rollups.clubs, club_rollup(lines, members, players), clubs, ["club_id"]))


def follow_matches(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``store(batch, batch_id)`` for each micro-batch, each match once (last row of its id); the batch id makes a repeat detectable."""

    def each(batch: DataFrame, batch_id: int) -> None:
        store(batch.dropDuplicates(["match_id"]), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value by type in tumbling windows; on a stream, rows later than ``late`` are left out."""
    return _counted(events, F.window("ts", size), late)


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _counted(events, F.window("ts", size, slide), late)


def _counted(events: DataFrame, window, late: str) -> DataFrame:
    e = events.withWatermark("ts", late)
    n = e.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return n.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events without a pause as long as the gap."""
    e = events.withWatermark("ts", late)
    n = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return n.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
