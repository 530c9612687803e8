"""Service sheets: from each position's list of scores to ordered turns, servers and side-out figures.

A sheet is one row per set: ``set_id``, ``service_initial`` (A or B), ``score_a``, ``score_b`` and, per side,
``services_a`` and ``services_b``: map<int, array<int>> of the side's score each time a position's turn ended.
Line-ups are one row per (set, side): ``formation`` (six players) and ``changes`` (who came in, where, at what
sum of the scores).  Everything is column expressions and windows within a set; no set is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def service_order(sheets: DataFrame) -> DataFrame:
    """set_id, side, turn (from 0), position, score: each side's turns in the order in which they were served.

    The positions come round in order, from 1 for the side that serves first and from 2, with 1 last, for the
    other; a position's n-th score belongs to the n-th round.  Null or empty maps give no rows.
    """
    return _order(sheets)


def _order(sheets: DataFrame, *keep: str) -> DataFrame:
    """The turns in order, with further columns of the sheet: one pass over it."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"services_{k.lower()}").alias("services")) for k in "AB"))).alias("s")
    each = sheets.select("set_id", "service_initial", *keep, sides).select("set_id", (F.col("service_initial") == F.col("s.side")).alias("first"), *keep, "s.side", F.explode("s.services").alias("position", "scores"))
    placed = each.select("set_id", "side", *keep, "position", F.when(F.col("first"), F.col("position")).otherwise(F.pmod(F.col("position") - 2, F.lit(6))).alias("place"), F.posexplode("scores").alias("round", "score"))
    w = Window.partitionBy("set_id", "side").orderBy("round", "place")
    return placed.select("set_id", "side", (F.row_number().over(w) - 1).cast("long").alias("turn"), F.col("position").cast("long").alias("position"), F.col("score").cast("long").alias("score"), *keep)


def service_turns(sheets: DataFrame) -> DataFrame:
    """set_id, n (from 0), side, position, score_a, score_b (at the start), end_a, end_b, points, wins_set.

    Turns alternate, beginning with the side that serves first, and end where the side to serve has none left.  A
    turn ends with a point for the other side.  The winner's last score is that of the victory: it is a turn only
    if the set was won on serve, and then gives the other side no point.  Sets without a first server or turns give none.
    """
    winner = F.when(F.col("score_a") > F.col("score_b"), "A").when(F.col("score_b") > F.col("score_a"), "B")
    known = sheets.where(F.col("service_initial").isin("A", "B")).withColumn("winner", winner).withColumn("won_at", F.greatest("score_a", "score_b").cast("long"))
    own = Window.partitionBy("set_id", "side")
    rows = _order(known, "service_initial", "winner", "won_at").withColumn("victory", (F.col("side") == F.col("winner")) & (F.col("turn") == F.max("turn").over(own)))
    rows = rows.withColumn("victory", F.coalesce("victory", F.lit(False))).withColumn("first", F.col("side") == F.col("service_initial"))
    whole = Window.partitionBy("set_id")
    count = lambda c: F.sum(c.cast("long")).over(whole)
    rows = rows.withColumn("limit", F.least(2 * count(F.col("first") & ~F.col("victory")), 2 * count(~F.col("first") & ~F.col("victory")) + 1))
    rows = rows.withColumn("n", 2 * F.col("turn") + (~F.col("first")).cast("long"))
    kept = rows.where(F.col("victory") | (F.col("n") < F.col("limit")))
    # the victory comes behind all turns, whatever its own number
    kept = kept.withColumn("n", F.when(F.col("victory"), F.col("limit")).otherwise(F.col("n")))
    order = Window.partitionBy("set_id").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    mine = lambda side: F.coalesce(F.greatest(  # noqa: E731  a side's score: that of its last turn, and one for each turn of the other that ended since
        F.max(F.when(F.col("side") == side, F.col("score"))).over(before), F.lit(0)), F.lit(0))
    last_side = F.lag("side").over(order)
    with_scores = kept.select("*", mine("A").alias("a"), mine("B").alias("b"), last_side.alias("before"))
    score = lambda side, c: F.col(c) + F.when(F.col("before") != side, 1).otherwise(0)
    out = with_scores.withColumn("sa", score("A", "a")).withColumn("sb", score("B", "b"))
    serving = F.when(F.col("side") == "A", F.col("sa")).otherwise(F.col("sb"))
    out = out.where(~F.col("victory") | (serving < F.col("won_at")))
    lost = F.when(F.col("victory"), 0).otherwise(1)
    a = F.col("side") == "A"
    return out.select(
        "set_id", "n", "side", "position", F.col("sa").alias("score_a"), F.col("sb").alias("score_b"),
        F.when(a, F.col("score")).otherwise(F.col("sa") + lost).alias("end_a"), F.when(a, F.col("sb") + lost).otherwise(F.col("score")).alias("end_b"),
        (F.col("score") - serving).alias("points"), F.col("victory").alias("wins_set"),
    )


def player_at(position: Column, at: Column, formation: Column, changes: Column) -> Column:
    """Who stands at a position when the scores sum up to ``at``: the last to come in there until then, else the starter.

    ``changes``: array<struct<at, event_id, position, entrant>>; null without a formation.
    """
    done = F.filter(F.array_sort(changes), lambda c: (c["position"] == position) & (c["at"] <= at))
    return F.when(formation.isNotNull(), F.coalesce(F.try_element_at(done, F.lit(-1))["entrant"], F.try_element_at(formation, position.cast("int"))))


def position_of(player: Column, at: Column, formation: Column, changes: Column) -> Column:
    """The position (1 to 6) at which a player stands when the scores sum up to ``at``, the smallest of several; null where at none."""
    there = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda p: player_at(p, at, formation, changes).eqNullSafe(player))
    found = F.array_position(there, F.lit(True))
    return F.when(player.isNotNull() & (found > 0), found)


def servers(turns: DataFrame, lineups: DataFrame) -> DataFrame:
    """The turns with ``player``: who served them."""
    both = turns.join(lineups, ["set_id", "side"], "left")
    return both.select(*turns.columns, player_at(F.col("position"), F.col("score_a") + F.col("score_b"), F.col("formation"), F.col("changes")).alias("player"))


def server_figures(served: DataFrame) -> DataFrame:
    """Per (set, side, player): turns, points on serve, turns with a point, the longest and average run, rallies served, sets won on serve."""
    n = served.groupBy("set_id", "side", "player").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("points").alias("points"), F.count_if(F.col("points") > 0).alias("breaking_turns"), F.max("points").alias("longest"),
        F.sum(F.col("points") + (~F.col("wins_set")).cast("long")).alias("rallies"), F.count_if("wins_set").alias("set_wins"),
    )
    return n.withColumn("points_per_turn", F.round(F.col("points").cast("double") / F.col("turns"), 2))


def rotation_figures(turns: DataFrame) -> DataFrame:
    """Per (set, side, position): turns, points, and points of the other side while the position served."""
    return turns.groupBy("set_id", "side", "position").agg(F.count(F.lit(1)).alias("turns"), F.sum("points").alias("won"), F.count_if(~F.col("wins_set")).alias("lost"))


def side_outs(turns: DataFrame) -> DataFrame:
    """Per (set, side): rallies served and points of them; rallies received and those won, with the rate, and those won at once.

    A turn of n points is n + 1 rallies, the last of them lost, but for the turn that wins the set.
    """
    rallies = F.col("points") + (~F.col("wins_set")).cast("long")
    both = F.array(
        F.struct(F.col("side").alias("of"), rallies.alias("served"), F.col("points").alias("breaks"), F.lit(0).cast("long").alias("received"), F.lit(0).cast("long").alias("won"), F.lit(0).cast("long").alias("at_once")),
        F.struct(F.when(F.col("side") == "A", "B").otherwise("A").alias("of"), F.lit(0).cast("long").alias("served"), F.lit(0).cast("long").alias("breaks"), rallies.alias("received"), (~F.col("wins_set")).cast("long").alias("won"), ((F.col("points") == 0) & ~F.col("wins_set")).cast("long").alias("at_once")),
    )
    each = turns.select("set_id", F.explode(both).alias("r")).select("set_id", "r.*")
    n = each.groupBy("set_id", F.col("of").alias("side")).agg(*(F.sum(c).alias(c) for c in ("served", "breaks", "received", "won", "at_once")))
    return n.withColumn("side_out_pct", F.coalesce(F.round(F.try_divide(100 * F.col("won").cast("double"), F.col("received")), 1), F.lit(0.0)))
