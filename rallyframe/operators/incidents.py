"""Facts about single matches: players' sanctions and the status that follows from all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import scalars as sc


def sanctions_of(sanctions: DataFrame, players: DataFrame) -> DataFrame:
    """Per (match, player): the sanctions of the shirt on that side, in order, as "kind (set n, a-b)".

    ``sanctions``: match_id, side, shirt, kind, set_number, score_a, score_b, event_id; ``players``: match_id, side,
    shirt, player_id.  Without both scores the score is left out; players without sanctions give no row.
    """
    score = F.when(F.col("score_a").isNotNull() & F.col("score_b").isNotNull(), F.concat(F.lit(", "), "score_a", F.lit("-"), "score_b")).otherwise("")
    text = F.concat("kind", F.lit(" (set "), "set_number", score, F.lit(")"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("text")))), lambda s: s["text"])
    return sanctions.join(players, ["match_id", "side", "shirt"]).groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, "; ").alias("sanctions"))


SYNCED = ["score_export", "score_pdf", "score", "sets_a", "sets_b", "winner", "played", "source", "has_details"]


def synced(matches: DataFrame) -> DataFrame:
    """Score, sets, winner, played flag, source and details of each match made to agree, and ``changed`` if any was not.

    The export's score holds before the sheet's and that before the stored one; a forfeit's P counts as 0.  The
    winner follows the export only and never a forfeit.  A match without any evidence has no source and no
    details; one with details or sets but without a source is the sheet's.  ``has_sets``: whether it has set scores.
    """
    col = F.col
    forfeit, details = F.coalesce("forfeit", F.lit(False)), F.coalesce("has_details", F.lit(False))

    def scored(given: Column) -> Column:
        effective = F.coalesce(given["export"], given["pdf"], given["old"])
        shown = F.when(forfeit, sc.set_score(effective, True)).otherwise(effective)
        return F.struct(given["export"].alias("export"), given["pdf"].alias("pdf"), shown.alias("score"), sc.score_pair(effective).alias("pair"), (given["export"].isNotNull() & ~forfeit).alias("said"))

    def decided(g: Column) -> Column:
        a, b = g["pair"]["a"], g["pair"]["b"]
        winner = F.coalesce(F.when(g["said"] & (a > b), col("team_a")), F.when(g["said"] & (b > a), col("team_b")), "winner")
        return F.struct(g["export"].alias("score_export"), g["pdf"].alias("score_pdf"), g["score"].alias("score"), F.coalesce(a, "sets_a").alias("sets_a"), F.coalesce(b, "sets_b").alias("sets_b"), winner.alias("winner"))

    def status(d: Column) -> Column:
        is_played = sc.played(forfeit, d["winner"], d["score"], d["sets_a"], d["sets_b"]) | F.coalesce("has_sets", F.lit(False))
        return F.struct(*(d[c].alias(c) for c in SYNCED[:6]), is_played.alias("played"))

    def complete(v: Column) -> Column:
        counted = F.coalesce(v["sets_a"], F.lit(0)) + F.coalesce(v["sets_b"], F.lit(0)) > 0
        source = F.when(v["played"], F.when((F.coalesce("source", F.lit("")) == "") & (details | counted), "pdf").otherwise(col("source")))
        has_details = F.when(~v["played"] & details, False).otherwise(col("has_details"))
        return F.struct(*(v[c].alias(c) for c in SYNCED[:7]), source.alias("source"), has_details.alias("has_details"))

    given = F.struct(*(sc.set_score(col(c)).alias(k) for c, k in (("score_export", "export"), ("score_pdf", "pdf"), ("score", "old"))))
    held = given
    for step in (scored, decided, status, complete):
        held = _let(held, step)
    old = F.struct(*(col(c).alias(c) for c in SYNCED))
    rows = matches.withColumn("_new", _let(held, lambda v: F.struct(v.alias("v"), (~v.eqNullSafe(old)).alias("changed"))))
    others = [c for c in matches.columns if c not in SYNCED]
    return rows.select(*others, *(col(f"_new.v.{c}").alias(c) for c in SYNCED), col("_new.changed").alias("changed"))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: a filter on the result doesn't write the value into each of its uses."""
    return F.transform(F.array(value), then)[0]
