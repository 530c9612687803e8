"""Players on court: presence as a state machine, positions, and figures rally by rally.

Court sides are one row per (set, side): ``formation`` (array of six shirts, null without one) and ``changes``
(array<struct<at, event_id, position, entrant, leaver, score_a, score_b>>; ``at``: the sum of both scores).
Sets of matches are one row per set: ``set_id``, ``match_id``, ``number``, ``minutes``, ``score_a``, ``score_b``.

A set's changes are bounded by the rules of the game, so a side's are one array and a player's presence is one
fold over it.  Rallies meet the players on court by equal (set, side, bucket of eight rallies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.scalars import shirt_number
from rallyframe.operators.service import position_of, servers

#: The score from which every point counts double in the mind, and the target, by kind of set.
MONEY, MONEY_LAST, TARGET, TARGET_LAST = 20, 12, 25, 15
BUCKET = 8
STINT = "struct<from_a:bigint,from_b:bigint,to_a:bigint,to_b:bigint>"


def _plain(sides: DataFrame) -> DataFrame:
    """Shirts without leading zeros, no null changes; null scores of a change count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    change = lambda c: F.struct(
        (zero(c["score_a"]) + zero(c["score_b"])).alias("at"), c["event_id"].alias("event_id"), c["position"].cast("long").alias("position"), shirt_number(c["entrant"]).alias("entrant"),
        shirt_number(c["leaver"]).alias("leaver"), zero(c["score_a"]).alias("score_a"), zero(c["score_b"]).alias("score_b"),
    )
    changes = F.array_sort(F.coalesce(F.transform("changes", change), F.array().cast("array<struct<at:bigint,event_id:bigint,position:bigint,entrant:string,leaver:string,score_a:bigint,score_b:bigint>>")))
    return sides.select("set_id", "side", F.transform("formation", shirt_number).alias("formation"), changes.alias("changes"))


def _events(player: Column) -> Column:
    """A player's own changes in order: at one sum of scores, going out comes before coming in."""
    two = lambda c: F.filter(
        F.array(*(F.struct(c["at"].alias("at"), F.lit(k).alias("kind"), c["score_a"].alias("a"), c["score_b"].alias("b"), c[who].alias("who")) for k, who in enumerate(("leaver", "entrant")))),
        lambda e: e["who"] == player,
    )
    return F.array_sort(F.flatten(F.transform("changes", two)))


def _stints(events: Column, starter: Column, end_a: Column, end_b: Column) -> Column:
    """The fold: on court or not, since which score, and the stints so far; who is on court at the end leaves with it."""
    zero = F.lit(0).cast("long")
    state = lambda on, a, b, done: F.struct(on.alias("on"), a.cast("long").alias("a"), b.cast("long").alias("b"), done.alias("done"))
    stint = lambda s, a, b: F.struct(s["a"].alias("from_a"), s["b"].alias("from_b"), a.cast("long").alias("to_a"), b.cast("long").alias("to_b"))

    def step(s, e):
        out = state(F.lit(False), zero, zero, F.array_append(s["done"], stint(s, e["a"], e["b"])))
        return F.when(s["on"] & (e["kind"] == 0), out).when(~s["on"] & (e["kind"] == 1), state(F.lit(True), e["a"], e["b"], s["done"])).otherwise(s)

    start = state(starter, zero, zero, F.array().cast(f"array<{STINT}>"))
    return F.aggregate(events, start, step, lambda s: F.when(s["on"], F.array_append(s["done"], stint(s, end_a, end_b))).otherwise(s["done"]))


def presence(sides: DataFrame, sets: DataFrame) -> DataFrame:
    """Per (set, side, player): starter, entries, exits, in_outs, out_ins, finished, and ``stints`` (array of from and to scores).

    Players are those who start, come in or go out.  Coming in twice or going out while away changes nothing.  Null
    shirts are nobody.  Without a formation nobody starts.  Side and set must be known; a set without a score ends 0-0.
    """
    known = _plain(sides).join(sets.select("set_id", F.coalesce("score_a", F.lit(0)).cast("long").alias("end_a"), F.coalesce("score_b", F.lit(0)).cast("long").alias("end_b")), "set_id")
    everyone = F.array_distinct(F.concat(F.coalesce("formation", F.array().cast("array<string>")), F.transform("changes", lambda c: c["entrant"]), F.transform("changes", lambda c: c["leaver"])))
    each = known.select("*", F.explode(F.array_compact(everyone)).alias("player"))
    each = each.withColumn("events", _events(F.col("player"))).withColumn("starter", F.coalesce(F.array_contains("formation", F.col("player")), F.lit(False)))
    pairs = lambda first, then: F.size(F.filter(F.transform("events", lambda e, i: F.struct(e["kind"].alias("now"), F.when(i > 0, F.get("events", i - 1)["kind"]).alias("before"))), lambda p: (p["before"] == first) & (p["now"] == then)))
    kinds = lambda k: F.size(F.filter("events", lambda e: e["kind"] == k))
    stints = _stints(F.col("events"), F.col("starter"), F.col("end_a"), F.col("end_b"))
    out = each.select(
        "set_id", "side", "player", "starter", kinds(1).alias("entries"), kinds(0).alias("exits"), pairs(1, 0).alias("in_outs"), pairs(0, 1).alias("out_ins"),
        stints.alias("stints"), "formation", "changes", "end_a", "end_b",
    )
    last = F.try_element_at("stints", F.lit(-1))
    return out.withColumn("finished", F.coalesce((last["to_a"] == F.col("end_a")) & (last["to_b"] == F.col("end_b")), F.lit(False)))


def stint_rows(present: DataFrame) -> DataFrame:
    """set_id, side, player, stint (from 1), from and to scores, points won and lost meanwhile."""
    s = present.select("set_id", "side", "player", F.posexplode("stints").alias("stint", "s")).select("set_id", "side", "player", (F.col("stint") + 1).cast("long").alias("stint"), "s.*")
    a, b, mine = F.col("to_a") - F.col("from_a"), F.col("to_b") - F.col("from_b"), F.col("side") == "A"
    return s.select("*", F.when(mine, a).otherwise(b).alias("won"), F.when(mine, b).otherwise(a).alias("lost"))


def standing(present: DataFrame) -> DataFrame:
    """set_id, side, player, from_x, to_x, position: where a player stands between which sums of scores.

    A stint is cut where the side changes anyone, as only there a position can change.
    """
    s = present.select("set_id", "side", "player", "formation", "changes", F.explode("stints").alias("s"))
    s = s.select("*", (F.col("s.from_a") + F.col("s.from_b")).alias("from_x"), (F.col("s.to_a") + F.col("s.to_b")).alias("to_x")).where("from_x < to_x")
    inner = F.filter(F.transform("changes", lambda c: c["at"]), lambda at: (at > F.col("from_x")) & (at < F.col("to_x")))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("from_x", "to_x"), inner)))
    parts = F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda x, i: F.struct(x.alias("from_x"), F.get(cuts, i + 1).alias("to_x")))
    each = s.select("set_id", "side", "player", "formation", "changes", F.explode(parts).alias("p")).select("set_id", "side", "player", "formation", "changes", "p.*")
    return each.select("set_id", "side", "player", "from_x", "to_x", position_of(F.col("player"), F.col("from_x"), F.col("formation"), F.col("changes")).cast("long").alias("position"))


def rallies(turns: DataFrame, sides: DataFrame) -> DataFrame:
    """One row per rally of the turns: set_id, n, k, at, a, b (scores before), server, scored_by, on_serve (a point of the turn), served_by, turned_a, turned_b.

    ``turned``: the position that the side serves from, or served from last (1 before its first turn).
    """
    order = Window.partitionBy("set_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda side: F.coalesce(F.last(F.when(F.col("side") == side, F.col("position")), ignorenulls=True).over(order), F.lit(1))
    served = servers(turns.withColumn("turned_a", last("A")).withColumn("turned_b", last("B")), _plain(sides))
    n = F.col("points") + (~F.col("wins_set")).cast("long")
    each = served.where(n > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k"))
    a, before = F.col("side") == "A", F.col("k") - 1
    on_serve = F.col("k") <= F.col("points")
    out = each.select(
        "set_id", "n", "k", (F.col("score_a") + F.when(a, before).otherwise(0)).alias("a"), (F.col("score_b") + F.when(a, 0).otherwise(before)).alias("b"), F.col("side").alias("server"),
        F.when(on_serve == a, "A").otherwise("B").alias("scored_by"), on_serve.alias("on_serve"), F.col("player").alias("served_by"), "turned_a", "turned_b",
    )
    return out.withColumn("at", F.col("a") + F.col("b"))


def match_state(sets: DataFrame) -> DataFrame:
    """The sets with winner, need (sets that win the match: the larger count if 2 or 3, else 3) and sets won before by A and B."""
    winner = F.when(F.col("score_a") > F.col("score_b"), "A").when(F.col("score_b") > F.col("score_a"), "B")
    whole = Window.partitionBy("match_id")
    before = whole.orderBy("number", "set_id").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda side, w: F.coalesce(F.sum((F.col("winner") == side).cast("long")).over(w), F.lit(0))
    known = sets.withColumn("winner", winner)
    most = F.greatest(count("A", whole), count("B", whole))
    return known.select("*", F.when(most.isin(2, 3), most).otherwise(3).alias("need"), count("A", before).alias("before_a"), count("B", before).alias("before_b"))


def player_rallies(turns: DataFrame, sides: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per rally and player on court, with the zone in which the player stood and what was at stake."""
    spans = standing(presence(sides, sets))
    spread = spans.select("*", F.explode(F.sequence(F.expr(f"from_x div {BUCKET}"), F.expr(f"(to_x - 1) div {BUCKET}"))).alias("bucket"))
    each = rallies(turns, sides).withColumn("bucket", F.expr(f"at div {BUCKET}"))
    state = match_state(sets).select("set_id", "match_id", "number", "need", "before_a", "before_b")
    met = each.join(spread, ["set_id", "bucket"]).where("at >= from_x and at < to_x").join(state, "set_id")
    own = F.col("side") == "A"
    pick = lambda x, y: F.when(own, F.col(x)).otherwise(F.col(y))
    rows = met.select(
        "match_id", "set_id", "number", "side", "player", "n", "k", "on_serve", pick("a", "b").alias("mine"), pick("b", "a").alias("theirs"), (F.col("scored_by") == F.col("side")).alias("won"),
        (F.col("server") != F.col("side")).alias("received"), ((F.col("server") == F.col("side")) & F.col("on_serve") & F.col("served_by").eqNullSafe(F.col("player"))).alias("serving"),
        F.when(F.col("position").isNotNull(), F.pmod(F.col("position") - pick("turned_a", "turned_b"), F.lit(6)) + 1).alias("zone"),
        (pick("before_b", "before_a") + 1 >= F.col("need")).alias("match_theirs"), (pick("before_a", "before_b") + 1 >= F.col("need")).alias("match_mine"),
    )
    last = F.col("number") == 5
    ball = lambda x, y: (F.col(x) >= F.when(last, TARGET_LAST).otherwise(TARGET) - 1) & (F.col(x) > F.col(y))
    return rows.select("*", (F.greatest("mine", "theirs") >= F.when(last, MONEY_LAST).otherwise(MONEY)).alias("money"), ball("theirs", "mine").alias("against"), ball("mine", "theirs").alias("chance"))


def zone_figures(rows: DataFrame) -> DataFrame:
    """Per (match, side, player, zone 1 to 6): points played, won, lost and the rate."""
    n = rows.where("zone is not null").groupBy("match_id", "side", "player", "zone").agg(F.count(F.lit(1)).alias("played"), F.count_if("won").alias("won"), F.count_if(~F.col("won")).alias("lost"))
    return n.withColumn("rate", F.round(F.col("won").cast("double") / F.col("played"), 3))


STATES = {
    "level": "mine = theirs", "ahead": "mine > theirs", "behind": "mine < theirs", "money": "money", "received": "received",
    "set_balls_against": "against", "match_balls_against": "against and match_theirs", "set_balls": "chance", "match_balls": "chance and match_mine",
}


def clutch_figures(rows: DataFrame) -> DataFrame:
    """Per (match, side, player): points played and won in each state of the score, and the longest run of set and match balls that the player's own serve saved.

    A run lasts while points are won on serve, all with the player serving and the other side one point from the set.
    """
    counts = [c for name, rule in STATES.items() for c in (F.count_if(F.expr(rule)).alias(f"{name}_played"), F.count_if(F.expr(f"({rule}) and won")).alias(f"{name}_won"))]
    n = rows.groupBy("match_id", "side", "player").agg(*counts)
    saved = F.col("against") & F.col("serving") & F.col("won")
    order = Window.partitionBy("set_id", "side", "player").orderBy("n", "k")
    runs = rows.where("on_serve").withColumn("saved", saved).withColumn("run", F.sum((~F.col("saved")).cast("long")).over(order)).where("saved")
    longest = runs.groupBy("match_id", "set_id", "side", "player", "run").agg(F.count(F.lit(1)).alias("saves"), F.count_if("match_theirs").alias("match_saves"))
    best = longest.groupBy("match_id", "side", "player").agg(F.max("saves").alias("most_saves"), F.max("match_saves").alias("most_match_saves"))
    return n.join(best, ["match_id", "side", "player"], "left").fillna(0, ["most_saves", "most_match_saves"])


def player_matches(sides: DataFrame, sets: DataFrame) -> DataFrame:
    """Per (match, side, player): sets, entries and exits, points with and without the player on court, time on court.

    ``difference``: the rate of points won on court less that off court, null if never off court.
    """
    state = match_state(sets)
    totals = state.groupBy("match_id").agg(F.count(F.lit(1)).alias("sets"), F.sum("score_a").alias("total_a"), F.sum("score_b").alias("total_b"))
    present = presence(sides, sets)
    mine = F.col("side") == "A"
    sum_of = lambda f: F.aggregate("stints", F.lit(0).cast("long"), f)
    of_a, of_b = sum_of(lambda n, s: n + s["to_a"] - s["from_a"]), sum_of(lambda n, s: n + s["to_b"] - s["from_b"])
    each = present.withColumn("won", F.when(mine, of_a).otherwise(of_b)).withColumn("lost", F.when(mine, of_b).otherwise(of_a))
    each = each.join(state.select("set_id", "match_id", "winner", "minutes"), "set_id").where(F.col("starter") | (F.col("entries") > 0))
    share = F.coalesce(F.try_divide((F.col("won") + F.col("lost")).cast("double"), F.col("end_a") + F.col("end_b")), F.lit(1.0).cast("double"))
    n = each.groupBy("match_id", "side", "player").agg(
        F.count(F.lit(1)).alias("sets_played"), F.count_if(F.col("winner") == F.col("side")).alias("sets_won"), F.count_if((F.col("winner") != F.col("side"))).alias("sets_lost"),
        F.count_if("starter").alias("started"), F.count_if("finished").alias("finished"),
        *(F.sum(c).alias(c) for c in ("entries", "exits", "in_outs", "out_ins", "won", "lost")), F.round(F.sum(F.round(F.col("minutes") * share * 1_000_000).cast("long")).cast("double") / 1_000_000, 1).alias("minutes"),
    ).join(totals, "match_id")
    own = F.when(mine, F.col("total_a")).otherwise(F.col("total_b"))
    n = n.withColumn("points_on", F.col("won") + F.col("lost")).withColumn("points_off", F.greatest(F.lit(0), F.col("total_a") + F.col("total_b") - F.col("points_on"))).withColumn("won_off", F.greatest(F.lit(0), own - F.col("won")))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 3)
    n = n.withColumn("rate_on", F.coalesce(rate("won", "points_on"), F.lit(0.0).cast("double"))).withColumn("rate_off", rate("won_off", "points_off"))
    return n.select(
        "match_id", "side", "player", "sets_played", "sets_won", "sets_lost", "started", "finished", "entries", "exits", "in_outs", "out_ins", "points_on", F.col("won").alias("won_on"), F.col("lost").alias("lost_on"),
        (F.col("won") - F.col("lost")).alias("plus_minus"), "points_off", "won_off", "rate_on", "rate_off", F.round(F.col("rate_on") - F.col("rate_off"), 3).alias("difference"),
        F.coalesce(F.round(F.try_divide(F.col("points_on").cast("double"), F.col("total_a") + F.col("total_b")), 3), F.lit(0.0).cast("double")).alias("presence"), "minutes",
        ((F.col("started") == F.col("sets")) & (F.col("exits") == 0)).alias("whole_match"),
    )
