"""Player roles: evidence in formations, a scored belief per (match, side, player), and its diffusion over matches.

Beliefs start from evidence counts; each pass adds the player's other matches as a prior and scores
anew, until no main role changes.  A pass is one aggregate and one join; passes are written as tables,
so the plan doesn't grow, and the driver sees only the number of changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a prior weighs against evidence, the least weight of a belief, the least share of a role.
PRIOR_WEIGHT, LEAST_CONFIDENCE, FLOOR = 2.4, 0.5, 0.01
#: The roles, by name.
ROLES = ("central", "libero", "passeur", "pointu", "receptionneur")
KEY = ["match_id", "side", "player_id"]


def opposite(position: Column) -> Column:
    """The position across the court: 1-4, 2-5, 3-6."""
    return F.pmod(position + 2, F.lit(6)) + 1


def evidence(formations: DataFrame) -> DataFrame:
    """(match, side, player, role, score) from starting positions: row of ``formations`` is one set's starter.

    Columns: match_id, side, set_number, position (1 to 6), player_id, libero, swaps (with the libero).
    A libero scores 40; a player whom the libero replaces 5.5 a swap as middle; position 1 scores 1.8
    as setter and its opposite 1.8 as opposite; other starters 1 as receivers.
    """
    each = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("role"), F.col(k).alias("score"))) for k in ROLES)))
    return _scored(formations).select(*KEY, F.explode(each).alias("r")).select(*KEY, "r.role", "r.score")


def _scored(formations: DataFrame) -> DataFrame:
    """The evidence with a column per role, null without any: numbers only, so lines are summed by hash and not sorted."""
    plain, d = ~F.col("libero"), lambda x: F.lit(x).cast("double")
    rules = {
        "central": F.when(plain & (F.col("swaps") > 0), (F.col("swaps") * 5.5).cast("double")), "libero": F.when(F.col("libero"), d(40.0)), "passeur": F.when(plain & (F.col("position") == 1), d(1.8)),
        "pointu": F.when(plain & (F.col("position") == opposite(F.lit(1))), d(1.8)), "receptionneur": F.when(plain, d(1.0)),
    }
    return formations.groupBy(*KEY).agg(*(F.sum(rules[k]).alias(k) for k in ROLES))


def opposite_pairs(formations: DataFrame) -> DataFrame:
    """How often two players of a side start across from each other: a join on (match, side, set, axis), two rows a side."""
    f = formations.withColumn("axis", F.pmod("position", F.lit(3)))
    a, b = f.where("position <= 3").alias("a"), f.where("position > 3").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("match_id", "side", "set_number", "axis")]
    pair = a.join(b, on).select("a.match_id", "a.side", F.least("a.player_id", "b.player_id").alias("player_1"), F.greatest("a.player_id", "b.player_id").alias("player_2"))
    return pair.groupBy("match_id", "side", "player_1", "player_2").agg(F.count(F.lit(1)).alias("sets"))


def solve(scores: DataFrame, priors: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Belief of each (match, side, player): main role, its share, and a confidence from share, margin and volume.

    ``tasks``: over how many tasks scores and priors meet, a match in one of them.
    """
    s = scores
    if priors is not None:
        ids = scores.select(*KEY).distinct()
        ids = ids.repartition(tasks, "player_id") if tasks else ids
        extra = ids.join(priors, "player_id").select(*KEY, "role", (F.col("share") * PRIOR_WEIGHT).alias("score"))
        s = scores.unionByName(extra)
        s = s.repartition(tasks, "match_id") if tasks else s
    return _believed(s.groupBy(*KEY).agg(*(F.sum(F.when(F.col("role") == k, F.col("score"))).alias(k) for k in ROLES)))


def beliefs(formations: DataFrame) -> DataFrame:
    """:func:`solve` of the :func:`evidence` of formations, in one pass over them."""
    return _believed(_scored(formations))


def _believed(scored: DataFrame) -> DataFrame:
    """The beliefs of players with a score per role (null: none); of equal shares the first role by name."""
    s = scored.where(F.coalesce(*ROLES).isNotNull())
    s = s.withColumn("total", reduce(lambda a, b: a + b, (F.coalesce(k, F.lit(0.0).cast("double")) for k in ROLES)))
    s = s.withColumns({k: F.when(F.col(k).isNotNull(), F.greatest(F.lit(FLOOR).cast("double"), F.round(F.col(k) / F.col("total"), 6))) for k in ROLES})
    s = s.withColumn("share", F.greatest(*ROLES))
    s = s.withColumn("role", F.coalesce(*(F.when(F.col(k) == F.col("share"), F.lit(k)) for k in ROLES)))
    s = s.withColumn("second", F.coalesce(F.greatest(*(F.when(F.col("role") != k, F.col(k)) for k in ROLES)), F.lit(0.0).cast("double")))
    margin, volume = F.col("share") - F.col("second"), F.least(F.lit(1.0).cast("double"), F.col("total") / 10)
    return s.select(*KEY, "role", F.round("share", 4).alias("share"), F.round(0.35 * F.col("share") + 0.30 * margin + 0.35 * volume, 3).alias("confidence"))


def priors(beliefs: DataFrame) -> DataFrame:
    """Each player's distribution over roles, beliefs weighted by confidence."""
    weighted = beliefs.groupBy("player_id", "role").agg(F.sum(F.round(F.greatest(F.lit(LEAST_CONFIDENCE), F.col("confidence")) * 1000).cast("long")).alias("w"))
    return weighted.withColumn("share", F.round(F.col("w").cast("double") / F.sum("w").over(Window.partitionBy("player_id")), 4)).drop("w")


def diffuse(scores: DataFrame, passes: int = 5, write=None, tasks: int | None = None) -> tuple[DataFrame, int]:
    """Beliefs after passes with priors until no main role changes, and the number of passes.

    ``write`` stores a frame and reads it back (a table in shared storage); a checkpoint by default.
    On convergence the beliefs of the pass before hold.
    """
    write = write or (lambda df: df.checkpoint())
    scores = write(scores)
    beliefs = write(solve(scores.repartition(tasks, "match_id") if tasks else scores))
    for n in range(1, passes + 1):
        after = write(solve(scores, priors(beliefs), tasks))
        before = beliefs.select(*KEY, F.col("role").alias("was"))
        before = before.repartition(tasks, *KEY) if tasks else before
        changed = after.join(before, KEY).where("role <> was").count()
        if changed == 0:
            return beliefs, n
        beliefs = after
    return beliefs, passes


def with_roles(appearances: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Appearances with the believed role and its confidence (whole per cent), where there is a belief.

    A player believed on both sides of a match has the more confident belief, of equal ones that of side B.  Sides are A and
    B, believed roles those of ``ROLES``.
    """
    # numbers only, so that a match's beliefs are brought together by hash and not sorted
    of = lambda side: [F.max(F.when(F.col("side") == side, c)).alias(f"_{k}{side}") for k, c in (("r", F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))), ("c", F.col("confidence")))]
    b = F.col("_rB").isNotNull() & (F.col("_rA").isNull() | F.col("_cA").isNull() | F.coalesce(F.col("_cB") >= F.col("_cA"), F.lit(False)))
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.when(b, F.col("_rB")).otherwise(F.col("_rA")).cast("int"))
    one = beliefs.groupBy("match_id", "player_id").agg(*of("A"), *of("B")).select("match_id", "player_id", F.struct(name.alias("role"), F.when(b, F.col("_cB")).otherwise(F.col("_cA")).alias("confidence")).alias("_b"))
    new = {"role": F.coalesce("_b.role", "role"), "confidence": F.coalesce(F.round(F.col("_b.confidence") * 100).cast("long"), "confidence")}
    return appearances.join(one, ["match_id", "player_id"], "left").withColumns(new).select(*appearances.columns)


def role_metrics(beliefs: DataFrame) -> DataFrame:
    """Per role: beliefs, mean confidence, how many are certain (0.75), likely (0.50) or weak."""
    c = F.col("confidence")
    return beliefs.groupBy("role").agg(
        F.count(F.lit(1)).alias("beliefs"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.count_if(c >= 0.75).alias("certain"), F.count_if((c >= 0.5) & (c < 0.75)).alias("likely"), F.count_if(c < 0.5).alias("weak")
    )


def plausible_roles(appearances: DataFrame) -> DataFrame:
    """Each (team, player)'s roles that are plausible: share at least 0.30, or at least 0.18 and 0.62 of the main role's."""
    n = appearances.where("played").groupBy("team_id", "player_id", "role").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("team_id", "player_id")
    share = n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("top", F.max("n").over(w) / F.sum("n").over(w))
    return share.where((F.col("share") >= 0.30) | (F.col("share") >= F.greatest(F.lit(0.18), 0.62 * F.col("top")))).select("team_id", "player_id", "role", F.round("share", 3).alias("share"))
