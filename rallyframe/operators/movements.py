"""How teams move: between levels from season to season, and through a knock-out bracket of twelve matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.standings import KEY

#: Fixed value: the least change of level that counts as a promotion (up) or a relegation (down).
STEP = 0.8


def season_pairs(entries: DataFrame) -> DataFrame:
    """Each club's pairs of seasons to compare: every season with its next, and every earlier one with the last (cumulative)."""
    club = Window.partitionBy("club_id")
    seasons = entries.select("club_id", "season").distinct()
    seasons = seasons.withColumn("next", F.lead("season").over(club.orderBy("season"))).withColumn("last", F.max("season").over(club)).where("next is not null")
    step = F.struct(F.col("next").alias("season_to"), F.lit(False).alias("cumulative"))
    whole = F.when(F.col("next") < F.col("last"), F.struct(F.col("last").alias("season_to"), F.lit(True).alias("cumulative")))
    return seasons.select("club_id", F.col("season").alias("season_from"), F.explode(F.array_compact(F.array(step, whole))).alias("p")).select("club_id", "season_from", "p.*")


def level_moves(entries: DataFrame) -> DataFrame:
    """What each series of a club's teams did between two seasons: promotion, relegation, stable, new or stopped.

    ``entries``: club_id, series, season, level, leisure.  Of a series the best level of a season counts; leisure
    teams make no moves, but their seasons are the club's too.  Both ends are laid under each other and
    aggregated by pair and series, so there is no outer join.
    """
    best = entries.where(~F.coalesce("leisure", F.lit(False))).groupBy("club_id", "series", "season").agg(F.max("level").alias("level"))
    pairs = season_pairs(entries)
    none = F.lit(None).cast("double")
    begin = best.withColumnRenamed("season", "season_from").join(pairs, ["club_id", "season_from"]).withColumn("level_from", F.col("level").cast("double")).withColumn("level_to", none)
    end = best.withColumnRenamed("season", "season_to").join(pairs, ["club_id", "season_to"]).withColumn("level_from", none).withColumn("level_to", F.col("level").cast("double"))
    keys = ["club_id", "season_from", "season_to", "cumulative", "series"]
    both = begin.select(*keys, "level_from", "level_to").unionByName(end.select(*keys, "level_from", "level_to")).groupBy(*keys).agg(F.max("level_from").alias("level_from"), F.max("level_to").alias("level_to"))
    change = F.col("level_to") - F.col("level_from")
    status = F.when(F.col("level_from").isNull(), "new").when(F.col("level_to").isNull(), "stopped").when(change >= STEP, "promotion").when(change <= -STEP, "relegation").otherwise("stable")
    return both.select("*", status.alias("status"), F.rint(change).cast("long").alias("steps"))


def period_counts(moves: DataFrame) -> DataFrame:
    """Per pair of seasons: series compared, promotions and relegations."""
    status = F.col("status")
    return moves.groupBy("club_id", "season_from", "season_to", "cumulative").agg(
        F.count(F.lit(1)).alias("series"), F.count_if(status == "promotion").alias("promotions"), F.count_if(status == "relegation").alias("relegations")
    )


#: The rungs of a ladder from below, with their labels, and the level labels that stand on each.
RUNGS = {
    "LOISIR": ("Loisir", ("LOISIR", "BRASSAGE")), "D4": ("D4", ("D4",)), "D3": ("D3", ("D3",)), "D2": ("D2", ("D2",)), "D1": ("D1", ("D1",)), "DEP": ("Dép", ("DEP", "JEUNES DEP")), "PREREG": ("Préreg", ("PREREG",)),
    "R4": ("R4", ("R4",)), "R3": ("R3", ("R3",)), "R2": ("R2", ("R2",)), "R1": ("R1", ("R1",)), "REGIONAL": ("Régionale", ("REGIONAL", "JEUNES REGIONAL")), "PRENAT": ("Prénat", ("PRENAT",)),
    "N3": ("N3", ("N3",)), "N2": ("N2", ("N2", "NATIONAL")), "ELITE": ("Élite", ("ELITE", "ELITE AVENIR", "JEUNES ELITE")), "N1": ("N1", ("N1",)), "PRO B": ("Pro B", ("PRO B", "PRO")), "PRO A": ("Pro A", ("PRO A",)),
}


def rung(label: Column) -> Column:
    """The rung on which a level label stands; null for cups and unknown labels."""
    out = F.lit(None).cast("string")
    for key, (_, labels) in RUNGS.items():
        out = F.when(label.isin(*labels), key).otherwise(out)
    return out


def ladder(entries: DataFrame, *scope: str) -> DataFrame:
    """Per scope (a club, a territory): rank (from 0), rung and label of the levels that its entries know over all seasons.

    A rung between two that occur is there too: D1 under a pre-regional level, D2 under D1, D3 under D2, and every
    national one below the highest.  Names that changed over the years share a rung: D1 and "Dép", R1 and "Régionale",
    N1 and "Élite".  A ladder has two rungs at least: the department's and the region's, unless others occur.

    The scale is one aggregate per scope, of at most as many values as there are rungs; cups count for nothing.
    """
    known = entries.groupBy(*scope).agg(F.collect_set(rung(F.col("label"))).alias("has"))
    has = lambda *keys: F.arrays_overlap("has", F.array(*map(F.lit, keys)))
    plus = lambda df, key, when: df.withColumn("has", F.when(when, F.array_union("has", F.array(F.lit(key)))).otherwise(F.col("has")))
    known = plus(known, "D1", has("D2") & has("PREREG") & ~has("DEP"))
    known = plus(known, "D2", has("D3") & has("D1", "PREREG"))
    known = plus(known, "D3", has("D4") & has("D2", "D1", "PREREG"))
    known = plus(known, "PRO B", has("PRO A"))
    top = has("PRO A", "PRO B")
    known = plus(known, "ELITE", top & ~has("ELITE", "N1"))
    known = plus(known, "N2", top | has("ELITE", "N1"))
    known = plus(known, "N3", has("N2"))
    step = lambda when, key, label: F.when(when, F.struct(F.lit(key).alias("rung"), label.alias("label")))
    one = lambda key: step(has(key), key, F.lit(RUNGS[key][0]))
    two = lambda new, old, key: step(has(new, old), key, F.when(has(new) & has(old), f"{RUNGS[new][0]} / {RUNGS[old][0]}").when(has(new), RUNGS[new][0]).otherwise(RUNGS[old][0]))
    rungs = [one("LOISIR"), one("D4"), one("D3"), one("D2"), two("D1", "DEP", "D1"), one("PREREG"), one("R4"), one("R3"), one("R2"), two("R1", "REGIONAL", "R1"), one("PRENAT"), one("N3"), one("N2"), two("ELITE", "N1", "ELITE"), one("PRO B"), one("PRO A")]
    steps = known.withColumn("steps", F.array_compact(F.array(*rungs)))
    department, region = (F.struct(F.lit(key).alias("rung"), F.lit(RUNGS[of][0]).alias("label")) for key, of in (("D1", "DEP"), ("R1", "REGIONAL")))
    lone = F.col("steps")[0]["rung"].isin("D4", "D3", "D2", "D1", "PREREG")
    filled = F.when(F.size("steps") == 0, F.array(department, region)).when((F.size("steps") == 1) & lone, F.concat("steps", F.array(region))).when(F.size("steps") == 1, F.concat(F.array(department), "steps")).otherwise(F.col("steps"))
    return steps.select(*scope, F.posexplode(filled).alias("rank", "s")).select(*scope, F.col("rank").cast("long").alias("rank"), "s.rung", "s.label")


#: Rungs that share one step of a ladder.
_SHARED = {"DEP": "D1", "REGIONAL": "R1", "N1": "ELITE"}


def on_ladder(entries: DataFrame, *scope: str) -> DataFrame:
    """The entries with ``rank`` and ``step`` (label) on their scope's ladder; null for cups and unknown labels."""
    key = rung(F.col("label"))
    for old, shared in _SHARED.items():
        key = F.when(rung(F.col("label")) == old, shared).otherwise(key)
    steps = ladder(entries, *scope).withColumnRenamed("label", "step")
    return entries.withColumn("rung", key).join(steps, [*scope, "rung"], "left").drop("rung")


def _among(teams: Column, *asked: str) -> Column:
    """Whether all of the asked columns' teams are in the array; unknown teams are not."""
    found = F.lit(True)
    for c in asked:
        found = found & F.coalesce(F.array_contains(teams, F.col(c)), F.lit(False))
    return found


def bracket_flow(matches: DataFrame) -> DataFrame:
    """Stage and half of the twelve matches of a knock-out: quarter, semi, consolation, final, bronze, place_5_6, place_7_8.

    ``matches``: season, competition, n (1 to 12, four a round), team_a, team_b, sets_a, sets_b, played.  Stages
    follow from where the two teams come from: winners of quarters meet in semis, losers in consolations, and so
    on; a second-round match of mixed origin is a semi, a third-round one has no stage.  The first semi is the upper half, and a
    quarter belongs to the semi that its winner plays; if that doesn't give two quarters a half, the first two are the upper.
    Competitions without twelve matches give nothing.  The windows hold one competition's twelve rows.
    """
    group = Window.partitionBy(*KEY)
    won_by_a = F.col("sets_a") > F.col("sets_b")
    rows = matches.where("n between 1 and 12").withColumn("_all", F.count(F.lit(1)).over(group)).where("_all = 12")
    rows = rows.withColumn("round", F.ceil(F.col("n") / 4).cast("int")).withColumns({
        "winner": F.when(F.col("played"), F.when(won_by_a, F.col("team_a")).otherwise(F.col("team_b"))),
        "loser": F.when(F.col("played"), F.when(won_by_a, F.col("team_b")).otherwise(F.col("team_a"))),
    })
    those = lambda test, c: F.collect_set(F.when(test, F.col(c))).over(group)
    rows = rows.withColumns({"_qw": those(F.col("round") == 1, "winner"), "_ql": those(F.col("round") == 1, "loser")})
    losers = _among(F.col("_ql"), "team_a", "team_b") & ~_among(F.col("_qw"), "team_a", "team_b")
    rows = rows.withColumn("stage", F.when(F.col("round") == 1, "quarter").when((F.col("round") == 2) & losers, "consolation").when(F.col("round") == 2, "semi"))
    semi, consolation = F.col("stage") == "semi", F.col("stage") == "consolation"
    rows = rows.withColumns({f"_{s}{w[0]}": those(test, w) for s, test in (("s", semi), ("c", consolation)) for w in ("winner", "loser")})
    ends = (("final", "_sw"), ("bronze", "_sl"), ("place_5_6", "_cw"), ("place_7_8", "_cl"))
    last = F.coalesce(*(F.when(_among(F.col(c), "team_a", "team_b"), stage) for stage, c in ends))
    rows = rows.withColumn("stage", F.when(F.col("round") == 3, last).otherwise(F.col("stage")))
    rows = rows.withColumn("_semi", F.when(semi, F.row_number().over(Window.partitionBy(*KEY, "stage").orderBy("n"))))
    teams_of = lambda k: F.flatten(F.collect_list(F.when(F.col("_semi") == k, F.array("team_a", "team_b"))).over(group))
    rows = rows.withColumns({"_upper": teams_of(1), "_lower": teams_of(2)})
    quarter = F.col("stage") == "quarter"
    rows = rows.withColumn("half", F.when(quarter & _among(F.col("_lower"), "winner"), "lower").when(quarter & _among(F.col("_upper"), "winner"), "upper"))
    rows = rows.withColumn("_known", F.sum((F.col("half") == "upper").cast("int")).over(group))
    rows = rows.withColumn("half", F.when(quarter & (F.coalesce("_known", F.lit(0)) != 2), F.when(F.col("n") <= 2, "upper").otherwise("lower")).otherwise(F.col("half")))
    rows = rows.withColumns({"_ul": those(F.col("half") == "upper", "loser"), "_ll": those(F.col("half") == "lower", "loser")})
    half = (
        F.when(quarter, F.col("half")).when(F.col("_semi") == 1, "upper").when(F.col("_semi") == 2, "lower")
        .when(consolation & _among(F.col("_ul"), "team_a", "team_b"), "upper").when(consolation & _among(F.col("_ll"), "team_a", "team_b"), "lower")
    )
    return rows.select(*KEY, F.col("n").cast("long").alias("n"), "stage", half.alias("half"), "team_a", "team_b", "winner", "loser")


def challenge_bracket(matches: DataFrame) -> DataFrame:
    """The two small brackets of a challenge: half, semi_1, semi_2, final, bronze (ids of matches; bronze null if there is none).

    ``matches``: season, competition, pool, code, match_id, team_a, team_b, sets_a, sets_b, played.  Of a competition's two cross
    pools the one of lower code holds the semis, the other the finals.  A final is a match of two semis' winners, its
    bronze match the first of those semis' losers alone.  The half of the final of lower code is ``lower`` (places 5 to 8), the
    other ``upper``.  Competitions without two pools, or without two finals, give nothing.

    Teams flow by equi-joins on the team; no competition is gathered.
    """
    place = Window.partitionBy(*KEY).orderBy("pool")
    pools = matches.select(*KEY, "pool").distinct().withColumn("k", F.row_number().over(place)).withColumn("pools", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).where("pools = 2")
    m = matches.join(pools, [*KEY, "pool"]).withColumn("team", F.explode(F.array("team_a", "team_b")))
    a_won = F.col("sets_a") > F.col("sets_b")
    winner = F.when(a_won, F.col("team_a")).otherwise(F.col("team_b"))
    semis = m.where("k = 1 and played and team = team_a").select(*KEY, F.struct("code", F.col("match_id").alias("semi"), F.when(a_won, F.col("team_b")).otherwise(F.col("team_a")).alias("loser")).alias("s"), winner.alias("team"))
    last = m.where("k = 2").select(*KEY, "code", "match_id", "team")
    feeds = last.join(semis, [*KEY, "team"]).groupBy(*KEY, F.col("code").alias("final_code"), F.col("match_id").alias("final"))
    finals = feeds.agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("one"), F.max("s").alias("two")).where("n = 2")
    lost = finals.select(*KEY, "final", F.explode(F.array("one.loser", "two.loser")).alias("team"))
    alone = lost.join(last, [*KEY, "team"]).where("match_id <> final").groupBy(*KEY, "final", "code", "match_id").agg(F.countDistinct("team").alias("n")).where("n = 2")
    bronze = alone.groupBy(*KEY, "final").agg(F.min(F.struct("code", "match_id")).alias("b"))
    both = finals.join(bronze, [*KEY, "final"], "left")
    both = both.withColumn("halves", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).where("halves = 2").withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("final_code", "final")))
    return both.select(*KEY, F.when(F.col("k") == 1, "lower").otherwise("upper").alias("half"), F.col("one.semi").alias("semi_1"), F.col("two.semi").alias("semi_2"), "final", F.col("b.match_id").alias("bronze"))
