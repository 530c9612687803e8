"""Point-level reconstruction: timelines, runs, phases, momentum, coach decisions, all as window plans per set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_set():
    """A set's events in time order."""
    return Window.partitionBy("set_id").orderBy("ts", "event_id")


def timeline(rallies: DataFrame) -> DataFrame:
    """Every event of a set with the score after it; the rally's server is the winner of the one before (A at the start)."""
    a = F.sum((F.col("scored_by") == "A").cast("int")).over(in_set())
    b = F.sum((F.col("scored_by") == "B").cast("int")).over(in_set())
    before = in_set().rowsBetween(Window.unboundedPreceding, -1)
    server = F.coalesce(F.last("scored_by", ignorenulls=True).over(before), F.lit("A"))
    return rallies.select(
        "set_id", "ts", "event_id", "kind", "scored_by", "called_by", F.coalesce(a, F.lit(0)).alias("score_a"), F.coalesce(b, F.lit(0)).alias("score_b"), server.alias("server")
    )


def points_only(lines: DataFrame) -> DataFrame:
    """Points numbered from 1 in each set, with the lead y of A."""
    w = in_set()
    return lines.where("kind = 'point'").withColumn("x", F.row_number().over(w).cast("long")).withColumn("y", F.col("score_a") - F.col("score_b"))


def phases(points: DataFrame) -> DataFrame:
    """Per set and side: points on own serve (break) and on reception (side-out), with attempts and rates."""
    side = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side")
    each = points.select("set_id", "server", "scored_by", side)
    serving = F.col("server") == F.col("side")
    won = F.col("scored_by") == F.col("side")
    n = each.groupBy("set_id", "side").agg(
        F.count_if(serving).alias("serves"),
        F.count_if(serving & won).alias("breaks"),
        F.count_if(~serving).alias("receptions"),
        F.count_if(~serving & won).alias("side_outs"),
    )
    rate = lambda a, b: F.round(F.try_divide(100 * F.col(a).cast("double"), F.col(b)), 1)
    return n.select("*", F.coalesce(rate("breaks", "serves"), F.lit(0.0).cast("double")).alias("break_pct"), F.coalesce(rate("side_outs", "receptions"), F.lit(0.0).cast("double")).alias("side_out_pct"))


def serve_runs(points: DataFrame) -> DataFrame:
    """Per set and side: serve runs and the longest; a run ends when the serve changes."""
    changed = F.coalesce((F.col("server") != F.lag("server").over(in_set())).cast("int"), F.lit(0))
    runs = points.withColumn("changed", changed).withColumn("run", F.sum("changed").over(in_set())).groupBy("set_id", "server", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("set_id", F.col("server").alias("side")).agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"), F.sum("n").alias("serves"))


def score_states(points: DataFrame, money_time: int = 20) -> DataFrame:
    """Points won by A when behind, level and ahead, and from the score that decides sets."""
    before_a = F.col("score_a") - (F.col("scored_by") == "A").cast("int")
    before_b = F.col("score_b") - (F.col("scored_by") == "B").cast("int")
    state = F.when(before_a < before_b, "behind").when(before_a == before_b, "level").otherwise("ahead")
    return (
        points.withColumn("state", state)
        .withColumn("money", (F.greatest(before_a, before_b) >= money_time))
        .groupBy("set_id", "state")
        .agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("scored_by") == "A").alias("won"), F.count_if("money").alias("money_points"), F.count_if(F.col("money") & (F.col("scored_by") == "A")).alias("money_won"))
    )


def momentum(points: DataFrame) -> DataFrame:
    phase = F.when(F.col("server") == F.col("scored_by"), "break").otherwise("side_out")
    return points.select("set_id", "x", F.col("y").cast("long").alias("y"), F.col("scored_by").alias("winner"), phase.alias("phase"), "server")


def largest_leads(points: DataFrame) -> DataFrame:
    """Largest lead of each side, lead changes and the longest scoring run in a set."""
    w = in_set()
    sign = F.signum("y")
    other = F.coalesce((F.col("scored_by") != F.lag("scored_by").over(w)).cast("int"), F.lit(0))
    rows = points.withColumn("sign", sign).withColumn("before", F.last(F.when(sign != 0, sign), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("other", other)
    rows = rows.withColumn("run", F.sum("other").over(w))
    runs = rows.groupBy("set_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("set_id").agg(F.max("n").alias("longest_run"))
    leads = rows.groupBy("set_id").agg(
        F.greatest(F.lit(0), F.max("y")).cast("long").alias("lead_a"),
        F.greatest(F.lit(0), -F.min("y")).cast("long").alias("lead_b"),
        F.count_if((F.col("sign") != 0) & (F.col("before") == -F.col("sign"))).alias("changes"),
    )
    return leads.join(runs, "set_id")


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _places(c: Column, n: int) -> Column:
    """A double to ``n`` places as SQL engines round it: the scaled value to the nearest whole number.

    ``round`` with places reads the shortest decimal of the double instead, so 6.449999999999999 becomes 6.4 and not 6.5.
    """
    scale = float(10**n)
    return F.round(c * scale) / scale


def decisions(lines: DataFrame) -> DataFrame:
    """Impact of each time-out and substitution on its side, from the points in a window before and after it.

    The window is 18 % of the set's points, at least 4 and at most 12; a side without points in it counts as
    winning half.  The score weighs the change of the share won (72), of the slope of the lead (42) and the swing
    of the lead (24), more in close and late sets, less where the window is cut; it is clamped to 100.  From 12
    on it is positive or negative; its strength changes at 18, 38 and 65.

    Points before and after an event are counted by differences of running counts, so an event costs lookups by
    an equi-join on (set, point number) and no range join.
    """
    total = Window.partitionBy("set_id")
    at = F.sum((F.col("kind") == "point").cast("int")).over(in_set())
    rows = lines.withColumn("at", F.coalesce(at, F.lit(0))).withColumn("n", F.sum((F.col("kind") == "point").cast("int")).over(total))
    size = _clamp(F.rint(F.greatest(F.lit(1), F.col("n")) * F.lit(0.18)), 4, 12).cast("long")
    events = rows.where("kind <> 'point' and n > 0").withColumn("w", size).select(
        "set_id", "event_id", "kind", "n", "w", F.col("called_by").alias("side"), "at", F.greatest(F.lit(0), F.col("at") - F.col("w")).alias("from_x"), F.least(F.col("n"), F.col("at") + F.col("w")).alias("to_x")
    )
    won = rows.where("kind = 'point'").select("set_id", F.col("at").alias("x"), "score_a", "score_b")
    look = lambda name: won.select("set_id", F.col("x").alias(name), F.col("score_a").alias(f"{name}_a"), F.col("score_b").alias(f"{name}_b"))
    out = events
    for name in ("from_x", "at", "to_x"):
        out = out.join(look(name), ["set_id", name], "left").fillna(0, [f"{name}_a", f"{name}_b"])
    mine = lambda x: F.when(F.col("side") == "A", F.col(f"{x}_a")).otherwise(F.col(f"{x}_b"))
    lead = lambda x: F.when(F.col("side") == "A", F.col(f"{x}_a") - F.col(f"{x}_b")).otherwise(F.col(f"{x}_b") - F.col(f"{x}_a"))
    n_before, n_after = F.col("at") - F.col("from_x"), F.col("to_x") - F.col("at")
    rate = lambda hi, lo, n: F.coalesce(F.try_divide((mine(hi) - mine(lo)).cast("double"), n), F.lit(0.5))
    slope = lambda hi, lo, n: (lead(hi) - lead(lo)).cast("double") / F.greatest(F.lit(1), n)
    out = out.withColumns({
        "n_before": n_before, "n_after": n_after, "before": rate("at", "from_x", n_before), "after": rate("to_x", "at", n_after),
        "slope_before": slope("at", "from_x", n_before), "slope_after": slope("to_x", "at", n_after), "swing": lead("to_x") - lead("at"),
        "close": _clamp(1 - F.abs(lead("at")) / F.lit(10.0), 0.0, 1.0), "progress": _clamp(F.col("at").cast("double") / F.col("n"), 0.0, 1.0),
        "coverage": _clamp((n_before + n_after).cast("double") / (F.col("w") * 2), 0.0, 1.0),
    })
    raw = (F.col("after") - F.col("before")) * 72 + (F.col("slope_after") - F.col("slope_before")) * 42 + F.col("swing") / F.greatest(F.lit(2.0), F.col("w") * F.lit(0.8)) * 24
    score = _clamp(raw * (F.lit(0.75) + F.lit(0.35) * F.col("close") + F.lit(0.25) * F.col("progress")) * (F.lit(0.55) + F.lit(0.45) * F.col("coverage")), -100.0, 100.0)
    out = out.withColumn("score", score)
    size = F.abs("score")
    return out.select(
        "set_id", "event_id", "kind", "side", F.col("at").cast("long").alias("x"), F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after"),
        _places(F.col("before"), 3).alias("before"), _places(F.col("after"), 3).alias("after"), _places(F.col("slope_after") - F.col("slope_before"), 3).alias("slope_change"), F.col("swing").cast("long").alias("swing"),
        _places(F.col("score"), 1).alias("impact"), F.when(F.col("score") >= 12, "positive").when(F.col("score") <= -12, "negative").otherwise("neutral").alias("label"),
        F.when(size >= 65, "strong").when(size >= 38, "moderate").when(size >= 18, "light").otherwise("faint").alias("strength"), _places((F.lit(0.45) + F.lit(0.55) * F.col("coverage")) * 100, 1).alias("confidence"),
    )


def decision_summary(impacts: DataFrame) -> DataFrame:
    """Per side and kind: decisions, their impacts in tenths (sum, best, worst, spread) and how many of each label."""
    tenths = F.round(F.col("impact") * 10).cast("long")
    n = impacts.groupBy("side", "kind").agg(
        F.count(F.lit(1)).alias("decisions"), F.sum(tenths).alias("total"), F.max(tenths).alias("best"), F.min(tenths).alias("worst"),
        *(F.count_if(F.col("label") == label).alias(label) for label in ("positive", "neutral", "negative")),
    )
    return n.withColumn("spread", F.col("best") - F.col("worst")).withColumn("mean", F.round(F.col("total").cast("double") / F.col("decisions"), 1))


def server_at(points: DataFrame, moments: DataFrame) -> DataFrame:
    """As-of lookup: for each (set_id, at), the last point at or before it, by one union and a running last value."""
    p = points.select("set_id", F.col("ts").alias("t"), F.lit(0).alias("asked"), F.struct("server", "score_a", "score_b").alias("v"), F.lit(None).cast("long").alias("moment_id"))
    m = moments.select("set_id", F.col("at").alias("t"), F.lit(1).alias("asked"), F.lit(None).cast("struct<server:string,score_a:bigint,score_b:bigint>").alias("v"), "moment_id")
    p = p.withColumn("v", F.col("v").cast("struct<server:string,score_a:bigint,score_b:bigint>"))
    w = Window.partitionBy("set_id").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(m).withColumn("last", F.last("v", ignorenulls=True).over(w))
    return both.where("asked = 1").select("set_id", "moment_id", F.col("last.server").alias("server"), F.col("last.score_a").alias("score_a"), F.col("last.score_b").alias("score_b"))


def presence(lines: DataFrame) -> DataFrame:
    """Who was on court when: intervals of point numbers per (set, side, slot), with points won and lost meanwhile.

    A slot begins with its starter (player 0 minus the slot); a substitution of the side replaces the
    slot ``event_id % 6 + 1`` by the player ``event_id``.  Points are differences of running scores,
    looked up by equal (set, point number).
    """
    at = F.coalesce(F.sum((F.col("kind") == "point").cast("int")).over(in_set()), F.lit(0))
    rows = lines.withColumn("at", at).withColumn("n", F.sum((F.col("kind") == "point").cast("int")).over(Window.partitionBy("set_id")))
    subs = rows.where("kind = 'substitution'").select("set_id", F.col("called_by").alias("side"), (F.pmod("event_id", F.lit(6)) + 1).alias("slot"), "at", F.col("event_id").alias("player_id"), "n", F.lit(1).alias("later"))
    sets = rows.groupBy("set_id").agg(F.max("n").alias("n"))
    slots = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("slot")
    starters = sets.select("set_id", "n", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side")).select("set_id", "n", "side", slots)
    starters = starters.select("set_id", "side", "slot", F.lit(0).cast("long").alias("at"), (-F.col("slot")).alias("player_id"), "n", F.lit(0).alias("later"))
    w = Window.partitionBy("set_id", "side", "slot").orderBy("at", "later", "player_id")
    spans = subs.unionByName(starters).withColumn("to_x", F.coalesce(F.lead("at").over(w), F.col("n"))).withColumnRenamed("at", "from_x")
    score = rows.where("kind = 'point'").select("set_id", F.col("at").alias("x"), "score_a", "score_b")
    for name in ("from_x", "to_x"):
        there = score.select("set_id", F.col("x").alias(name), F.col("score_a").alias(f"{name}_a"), F.col("score_b").alias(f"{name}_b"))
        spans = spans.join(there, ["set_id", name], "left").fillna(0, [f"{name}_a", f"{name}_b"])
    a, b = F.col("to_x_a") - F.col("from_x_a"), F.col("to_x_b") - F.col("from_x_b")
    mine = F.col("side") == "A"
    return spans.select("set_id", "side", "slot", "player_id", "from_x", "to_x", F.when(mine, a).otherwise(b).alias("won"), F.when(mine, b).otherwise(a).alias("lost"))


def on_court(intervals: DataFrame) -> DataFrame:
    """Per player of a set: intervals, points played, plus-minus on court."""
    return intervals.groupBy("set_id", "side", "player_id").agg(
        F.count(F.lit(1)).alias("intervals"), F.sum(F.col("to_x") - F.col("from_x")).alias("points"), F.sum(F.col("won") - F.col("lost")).alias("plus_minus")
    )


def slot_stats(intervals: DataFrame) -> DataFrame:
    """Per (side, slot): appearances, points, and the player with most points there."""
    played = F.col("to_x") - F.col("from_x")
    by_player = intervals.groupBy("side", "slot", "player_id").agg(F.count(F.lit(1)).alias("n"), F.sum(played).alias("points"))
    return by_player.groupBy("side", "slot").agg(F.sum("n").alias("appearances"), F.sum("points").alias("points"), F.max_by("player_id", F.struct("points", -F.col("player_id"))).alias("dominant"))


def face_to_face(phase_rows: DataFrame) -> DataFrame:
    """Comparison rows of a set: metric, A, B, in long form."""
    metrics = ("serves", "breaks", "receptions", "side_outs", "break_pct", "side_out_pct")
    long = phase_rows.select("set_id", "side", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("set_id", "side", "m.*")
    return long.groupBy("set_id", "metric").agg(F.max(F.when(F.col("side") == "A", F.col("value"))).alias("a"), F.max(F.when(F.col("side") == "B", F.col("value"))).alias("b"))
