"""Club names: normal form, core name, fuzzy equality, and whether two sides are swapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.scalars import bare

#: Endings that say only that a club plays volleyball.
ENDINGS = ("VOLLEY ?BALL", "VOLLEY", "VB", "AVB", "VBC", "VC")

#: Words that don't tell teams apart.
COMMON_WORDS = ("LE", "LA", "LES", "DE", "DES", "DU", "D", "L", "ET", "VOLLEY", "BALL", "VOLLEYBALL", "VB", "CFC", "ASS", "ASSO", "ASSOCIATION")


def team_words(c: Column) -> Column:
    """A team name's letters and digits in upper case without accents, words parted by one space; null: empty."""
    return F.trim(F.regexp_replace(F.upper(bare(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def team_tokens(words: Column) -> Column:
    """The telling words of :func:`team_words`: of two characters or more, no number, no common word."""
    return F.array_distinct(F.filter(F.split(words, " "), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\p{Nd}+$") & ~w.isin(*COMMON_WORDS)))


def with_side(df: DataFrame) -> DataFrame:
    """``df`` with ``side`` filled in: on which side of a match a player of a team (``team_id``, ``club_id``, ``name``) was.

    The match has ``team_a``, ``club_a``, ``name_a`` and the same of b.  In this order decide: a side already known, equal
    teams, equal clubs, one name within the other (without spaces), the greater share of the team's telling words
    if it is a half or more.  If nothing decides the side stays null.
    """
    ends = {"n": "name", "a": "name_a", "b": "name_b"}
    rows = df.withColumns({f"_{k}": team_words(F.col(c)) for k, c in ends.items()})
    rows = rows.withColumns({f"_{k}_all": F.replace(F.col(f"_{k}"), F.lit(" "), F.lit("")) for k in ends} | {f"_{k}_words": team_tokens(F.col(f"_{k}")) for k in ends})
    own, filled = F.col("_n_all"), lambda c: F.col(c) != ""
    within = lambda k: filled("_n_all") & filled(f"_{k}_all") & (F.contains(F.col(f"_{k}_all"), own) | F.contains(own, F.col(f"_{k}_all")))
    share = lambda k: F.coalesce(F.try_divide(F.size(F.array_intersect("_n_words", f"_{k}_words")).cast("double"), F.size("_n_words")), F.lit(0.0))
    rows = rows.withColumns({"_share_a": share("a"), "_share_b": share("b")})
    found = (
        F.when(F.coalesce("side", F.lit("")) != "", F.col("side"))
        .when(F.col("team_a") == F.col("team_id"), "A").when(F.col("team_b") == F.col("team_id"), "B")
        .when(F.col("club_a") == F.col("club_id"), "A").when(F.col("club_b") == F.col("club_id"), "B")
        .when(within("a"), "A").when(within("b"), "B")
        .when((F.col("_share_a") > F.col("_share_b")) & (F.col("_share_a") >= 0.5), "A")
        .when((F.col("_share_b") > F.col("_share_a")) & (F.col("_share_b") >= 0.5), "B")
    )
    return rows.withColumn("side", found).select(*df.columns)


def club_name(c: Column) -> Column:
    """Upper case without accents and punctuation, a final team number dropped, SAINT(E) and STE as ST."""
    n = F.regexp_replace(bare(F.upper(F.trim(c))), r"[.\-/'\",;:()]+", " ")
    n = F.regexp_replace(F.trim(n), r"\s+\d$", "")
    n = F.regexp_replace(n, r"\b(SAINTE?|STE)\b", "ST")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def core_name(c: Column) -> Column:
    n = club_name(c)
    for ending in ENDINGS:
        n = F.regexp_replace(n, rf"\s+{ending}$", "")
    return F.trim(n)


def same_club(a: Column, b: Column) -> Column:
    """Equal names; equal cores; one the other's beginning but for a volleyball ending; or cores within two edits."""
    return _same(club_name(a), core_name(a), club_name(b), core_name(b))


def _same(na: Column, ca: Column, nb: Column, cb: Column) -> Column:
    """As :func:`same_club`, of names and cores worked out before."""
    longer, shorter = F.when(F.length(na) > F.length(nb), na).otherwise(nb), F.when(F.length(na) > F.length(nb), nb).otherwise(na)
    rest = F.trim(longer.substr(F.length(shorter) + 1, F.length(longer)))
    begins = (F.length(shorter) >= 5) & longer.startswith(shorter) & ((rest == "") | rest.rlike(f"^({'|'.join(ENDINGS)})$"))
    near = (F.abs(F.length(ca) - F.length(cb)) <= 2) & (F.length(ca) >= 6) & F.levenshtein(ca, cb, 2).between(0, 2)
    return (na == nb) | ((ca == cb) & (F.length(ca) >= 4)) | begins | near


def with_swaps(df: DataFrame, a: str, b: str, other_a: str, other_b: str, score: str | None = None, sets_a: str | None = None, sets_b: str | None = None) -> DataFrame:
    """Adds ``swapped``: whether a sheet names the sides the other way round.

    Exact names decide first, then fuzzy ones, then a gap of 3 in edit distance, then the score.  Each
    name's normal form and core is worked out once, in a projection below.
    """
    sides = {"a": a, "b": b, "x": other_a, "y": other_b}
    up = df.withColumns({f"_{k}": F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))) for k, c in sides.items()})
    one = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    there = lambda p, q: (F.col(f"_{p}") != "") & (F.col(f"_{q}") != "")
    equal = lambda p, q: one(there(p, q) & (F.col(f"_{p}") == F.col(f"_{q}")))
    alike = lambda p, q: one(there(p, q) & _same(*(F.col(f"_{k}_{what}") for k in (p, q) for what in ("name", "core"))))
    far = lambda p, q: F.levenshtein(F.col(f"_{p}_name"), F.col(f"_{q}_name"))
    up = up.withColumn("_exact", equal("x", "a") + equal("y", "b") - equal("x", "b") - equal("y", "a"))
    named = ((F.col("_a") != "") | (F.col("_b") != "")) & ((F.col("_x") != "") | (F.col("_y") != ""))
    # normal forms take many patterns: only where both sides are named and exact names leave it open
    unsure = lambda c: F.when(named & (F.col("_exact") == 0), c)
    up = up.withColumns({f"_{k}_name": unsure(club_name(F.col(f"_{k}"))) for k in sides} | {f"_{k}_core": unsure(core_name(F.col(f"_{k}"))) for k in sides})
    up = up.withColumns({
        "_fuzzy": alike("x", "a") + alike("y", "b") - alike("x", "b") - alike("y", "a"),
        "_gap": far("x", "a") + far("y", "b") - far("x", "b") - far("y", "a"),
    })
    by_score = F.lit(False)
    if score:
        sa, sb = (F.regexp_extract(F.col(score), r"^\s*(\d+)\s*/\s*(\d+)\s*$", k).try_cast("int") for k in (1, 2))
        by_score = F.coalesce((sa != sb) & (F.col(sets_a) == sb) & (F.col(sets_b) == sa), F.lit(False))
    exact, fuzzy, gap = F.col("_exact"), F.col("_fuzzy"), F.col("_gap")
    swapped = F.when(~named, False).when(exact > 0, False).when(exact < 0, True).when(fuzzy > 0, False).when(fuzzy < 0, True).when(gap >= 3, True).when(gap <= -3, False).otherwise(by_score)
    return up.select(*df.columns, swapped.alias("swapped"))


def match_clubs(names: DataFrame, clubs: DataFrame, name_col: str = "name", club_col: str = "club") -> DataFrame:
    """(name, club) pairs that denote the same club, as :func:`same_club` has it.

    Pairs meet by keys that prove them, never by a cross join: equal names, one less a volleyball ending the other; equal
    cores of four letters or more; cores of one length equal but for one letter that each lacks, or for two places in which
    they differ; cores of lengths one or two apart equal when the longer lacks one letter more (only here a distance is
    measured).  Many alike names thus cost little more than their pairs.
    """

    def known(df: DataFrame, column: str, name: str) -> DataFrame:
        # short rows that become many keys: a number of tasks is asked for, as few bytes would be put into one
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = df.select(F.col(column).alias(name)).repartition(tasks, name).distinct().withColumn("full", club_name(F.col(name))).withColumn("core", core_name(F.col(name)))
        return each.withColumn("size", F.length("core"))

    left, right = known(names, name_col, "name"), known(clubs, club_col, "club")
    # lengths of the other side's cores: few, whatever the number of names
    sizes = lambda df: df.select(F.col("size").alias("other")).distinct()
    left_keys = left.select("name", F.explode(_equal_keys(F.col("full"), F.col("core"))).alias("k"))
    right_keys = right.select("club", F.explode(_equal_keys(F.col("full"), F.col("core"))).alias("k"))
    # a short core on the left is near to nothing
    near_by, more = F.abs(F.col("size") - F.col("other")) <= 2, F.col("size") - F.col("other")
    left_near, right_near = left.where("size >= 6").join(F.broadcast(sizes(right)), near_by), right.join(F.broadcast(sizes(left.where("size >= 6"))), near_by)
    left_keys = left_keys.unionByName(left_near.select("name", F.explode(_near_keys(F.col("core"), more, more)).alias("k")))
    right_keys = right_keys.unionByName(right_near.select("club", F.explode(_near_keys(F.col("core"), more, -more)).alias("k")))
    a, b = left_keys.select("name", "k.*").alias("a"), right_keys.select("club", "k.*").alias("b")
    kind, at = F.col("a.kind"), lambda side, n: F.col(f"{side}.note").substr(n, 1)
    proven = (
        F.when(kind == "name", (F.col("a.note") == "") | (F.col("b.note") == ""))
        .when(kind == "two", (at("a", 1) != at("b", 1)) & (at("a", 2) != at("b", 2)))
        .when(kind.isin("1", "-1"), F.levenshtein(F.col("a.note"), F.col("b.note"), 2).between(0, 2))
        .otherwise(True)
    )
    return a.join(b, (kind == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & proven).select("name", "club").distinct()


def _key(kind: str | Column, key: Column, note: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key"), (F.lit("") if note is None else note).alias("note"))


def _equal_keys(full: Column, core: Column) -> Column:
    """A name itself, what is left of it without an ending (noted), and its core."""
    endings = tuple(e for ending in ENDINGS for e in ((ending.replace(" ?", ""), ending.replace(" ?", " ")) if "?" in ending else (ending,)))
    cut = [F.rtrim(full.substr(F.lit(1), F.length(full) - len(e))) for e in endings]
    shorter = [F.when(full.endswith(e) & (F.length(c) >= 5), _key("name", c, F.lit(e))) for e, c in zip(endings, cut)]
    return F.array_compact(F.array(_key("name", full), *shorter, F.when(F.length(core) >= 4, _key("core", core))))


def _near_keys(core: Column, more: Column, kind: Column) -> Column:
    """Keys under which a core meets those within two edits that have ``more`` letters less; ``kind`` is that number seen from the left side.

    Of one length: a letter left out (``one``), or two whose places are part of the key and which are noted (``two``).  Else
    the longer core lacks two letters, the shorter one a letter if it is one shorter, none if two.
    """
    places, length = F.sequence(F.lit(1), F.length(core)), kind.cast("string")
    without = lambda c, k: F.concat(c.substr(F.lit(1), k - 1), c.substr(k + 1, F.length(c)))
    pairs = F.flatten(F.transform(places, lambda k: F.transform(F.filter(places, lambda j: j > k), lambda j: F.struct(k.alias("k"), j.alias("j")))))
    less_two = lambda p: without(without(core, p["j"]), p["k"])
    one, two = F.array_distinct(F.transform(places, lambda k: without(core, k))), F.array_distinct(F.transform(pairs, less_two))
    apart = F.transform(pairs, lambda p: _key("two", F.concat_ws(",", p["k"].cast("string"), p["j"].cast("string"), less_two(p)), F.concat(core.substr(p["k"], F.lit(1)), core.substr(p["j"], F.lit(1)))))
    return (
        F.when(more == 0, F.concat(F.transform(one, lambda x: _key("one", x)), apart))
        .when(more == 1, F.transform(two, lambda x: _key(length, x, core)))
        .when(more == -1, F.transform(one, lambda x: _key(length, x, core)))
        .when(more == 2, F.transform(two, lambda x: _key(length, x)))
        .otherwise(F.array(_key(length, core)))
    )
