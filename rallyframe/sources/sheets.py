"""Service sheets, line-ups and team staff derived from the supplied tables (invented contents, the documents' shapes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.points import in_set, points_only, timeline


def service_sheets(rallies: DataFrame) -> DataFrame:
    """One sheet per decided set: its points until the winner's last, each serve run an entry of the server's next position.

    Every step is dealt by set, so the events are shuffled once.
    """
    whole = Window.partitionBy("set_id")
    lead = F.max_by("y", "x").over(whole)
    rows = points_only(timeline(rallies)).withColumn("winner", F.when(lead > 0, "A").when(lead < 0, "B")).where("winner is not null")
    rows = rows.withColumn("until", F.max(F.when(F.col("scored_by") == F.col("winner"), F.col("x"))).over(whole)).where("x <= until")
    rows = rows.withColumn("changed", F.coalesce((F.col("server") != F.lag("server").over(in_set())).cast("int"), F.lit(0))).withColumn("run", F.sum("changed").over(in_set()))
    own = F.when(F.col("server") == "A", F.col("score_a")).otherwise(F.col("score_b"))
    ends = [F.max(c).over(whole).alias(f"end_{c[-1]}") for c in ("score_a", "score_b")]
    turns = rows.select("*", *ends, F.max("run").over(whole).alias("last")).groupBy("set_id", "run", F.col("server").alias("side")).agg(F.max(own).alias("score"), *(F.first(c).alias(c) for c in ("winner", "last", "end_a", "end_b")))
    # a set won on reception: the winner's score of the victory is an entry of its next position
    received = F.struct((F.col("run") + 1).alias("run"), F.col("winner").alias("side"), F.when(F.col("winner") == "A", F.col("end_a")).otherwise(F.col("end_b")).alias("score"))
    mine = F.struct("run", "side", "score")
    entries = F.explode(F.when((F.col("run") == F.col("last")) & (F.col("side") != F.col("winner")), F.array(mine, received)).otherwise(F.array(mine)))
    each = turns.select("set_id", "end_a", "end_b", entries.alias("e")).select("set_id", "end_a", "end_b", "e.*")
    turn = F.row_number().over(Window.partitionBy("set_id", "side").orderBy("run")) - 1
    placed = each.withColumn("turn", turn).withColumn("position", (F.pmod(F.col("turn") + (F.col("side") == "B").cast("int"), F.lit(6)) + 1).cast("int"))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("turn", "score"))), lambda t: t["score"].cast("int"))
    lists = placed.groupBy("set_id", "side", "position").agg(scores.alias("scores"), F.first("end_a").alias("end_a"), F.first("end_b").alias("end_b"))
    entry = lambda side: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("position", "scores"))))).alias(f"services_{side.lower()}")
    return lists.groupBy("set_id").agg(F.first("end_a").alias("score_a"), F.first("end_b").alias("score_b"), F.lit("A").alias("service_initial"), entry("A"), entry("B"))


def set_context(sheets: DataFrame) -> DataFrame:
    """The sheets as sets of matches: match_id, number (1 to 5) and minutes."""
    return sheets.select("*", F.expr("set_id div 5").alias("match_id"), (F.pmod("set_id", F.lit(5)) + 1).alias("number"), (F.pmod("set_id", F.lit(20)) + 15).alias("minutes"))


def court_sides(rallies: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per (set, side) of the sheets: starters 1 to 6 and the changes until the end, with scores and who left.

    At each position a bench player of that position and the starter come in by turns.
    """
    here = Window.partitionBy("set_id", "called_by", "position").orderBy("ts", "event_id")
    position = F.pmod("event_id", F.lit(6)) + 1
    subs = timeline(rallies).where("kind = 'substitution'").withColumn("position", position).withColumn("k", F.row_number().over(here))
    entrant = F.when(F.col("k") % 2 == 1, F.col("position") * 10 + F.pmod("event_id", F.lit(10))).otherwise(F.col("position")).cast("string")
    subs = subs.withColumn("entrant", entrant).withColumn("leaver", F.coalesce(F.lag("entrant").over(here), F.col("position").cast("string")))
    change = F.struct((F.col("score_a") + F.col("score_b")).alias("at"), "event_id", "position", "entrant", "leaver", "score_a", "score_b")
    made = subs.groupBy("set_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("called_by") == k, change))).alias(k) for k in "AB"))
    formation = F.array(*(F.lit(str(k)) for k in range(1, 7))).alias("formation")
    sides = sheets.select("set_id", (F.col("score_a") + F.col("score_b")).alias("until")).join(made, "set_id", "left")
    within = lambda k: F.filter(F.col(k), lambda c: c["at"] <= F.col("until")).alias("changes")
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), within(k)) for k in "AB"))).alias("s")
    return sides.select("set_id", both).select("set_id", "s.side", formation, "s.changes")


def lineups(rallies: DataFrame) -> DataFrame:
    """Per (set, side): starters 1 to 6 and the substitutions, each of a new player at a position."""
    lines = timeline(rallies)
    change = F.struct((F.col("score_a") + F.col("score_b")).alias("at"), "event_id", (F.pmod("event_id", F.lit(6)) + 1).alias("position"), (F.pmod("event_id", F.lit(80)) + 10).cast("string").alias("entrant"))
    made = lines.where("kind = 'substitution'").groupBy("set_id", F.col("called_by").alias("side")).agg(F.collect_list(change).alias("changes"))
    sides = lines.select("set_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side")).distinct()
    formation = F.array(*(F.lit(str(k)) for k in range(1, 7)))
    return sides.join(made, ["set_id", "side"], "left").select("set_id", "side", formation.alias("formation"), "changes")


def role_sides(rallies: DataFrame) -> DataFrame:
    """Per set and side: match_id, side, number, formation, changes, liberos.

    Shirts 11 to 16 start, turned by one place in sets of odd number.  Of substitutions every fourth is a double change of
    two players across from each other; time-outs stand for swaps with the libero, 17.
    """
    number, event = F.pmod("set_id", F.lit(5)) + 1, F.col("event_id")
    turn = F.pmod(F.col("number"), F.lit(2))
    start = lambda position: (F.pmod(position - 1 + turn, F.lit(6)) + 11).cast("string")
    formation = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long")), start)
    lines = timeline(rallies).withColumn("number", number)
    double = F.pmod(event, F.lit(4)) == 0
    net, across = F.pmod(event, F.lit(3)) + 2, F.pmod(F.pmod(event, F.lit(3)) + 4, F.lit(6)) + 1
    one = lambda position, entrant, leaver: F.struct((F.col("score_a") + F.col("score_b")).alias("at"), "event_id", position.cast("long").alias("position"), entrant.cast("string").alias("entrant"), leaver.cast("string").alias("leaver"), "score_a", "score_b")
    single, which = F.pmod(event, F.lit(6)) + 1, F.pmod(F.expr("event_id div 3"), F.lit(3))
    back = F.element_at(F.array(F.lit(1), F.lit(5), F.lit(6)), (which + 1).cast("int"))
    swap = F.when(F.pmod(event, F.lit(3)) == 0, one(back, F.lit("17"), start(back))).when(F.pmod(event, F.lit(3)) == 1, one(which + 2, start(which + 2), F.lit("17"))).otherwise(one(which + 2, F.lit("17"), start(which + 2)))
    subs = F.when(double, F.array(one(net, F.pmod(event, F.lit(5)) + 20, start(net)), one(across, F.pmod(event, F.lit(5)) + 30, start(across)))).otherwise(F.array(one(single, F.pmod(event, F.lit(9)) + 40, start(single))))
    made = lines.where("kind <> 'point'").withColumn("of", F.when(F.col("kind") == "substitution", subs).otherwise(F.array(swap)))
    gathered = made.groupBy("set_id").agg(*(F.array_sort(F.flatten(F.collect_list(F.when(F.col("called_by") == k, F.col("of"))))).alias(k) for k in "AB"))
    sides = rallies.select("set_id").distinct().join(gathered, "set_id", "left").withColumn("number", number)
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(k).alias("changes")) for k in "AB"))).alias("s")
    return sides.select(F.expr("set_id div 5").alias("match_id"), "number", formation.alias("formation"), F.array(F.lit("17")).alias("liberos"), both).select("match_id", "s.side", "number", "formation", "s.changes", "liberos")


def staff(sides: DataFrame, people: DataFrame) -> DataFrame:
    """match_id, season, team_id, won, role (EA, EB: coaches; K: others), name, licence (null for some)."""
    of = F.array(
        F.struct(F.lit("EA").alias("role"), (F.col("team_id") + 1).alias("person")),
        F.struct(F.lit("EB").alias("role"), (F.pmod(F.col("team_id") * 7 + F.col("season"), F.lit(100)) + 1).alias("person")),
        F.struct(F.lit("K").alias("role"), (F.pmod(F.col("team_id") * 3, F.lit(100)) + 1).alias("person")),
    )
    each = sides.where("played").select("match_id", "season", "team_id", (F.col("sets_for") > F.col("sets_against")).alias("won"), F.explode(of).alias("p")).select("match_id", "season", "team_id", "won", "p.*")
    named = people.select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") * 11).cast("string")).alias("licence"))
    return each.join(named, "person").drop("person")
