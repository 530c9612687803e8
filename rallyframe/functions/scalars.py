"""Normalising functions on columns: text, gender, age category, division, level, scores, dates, codes.

All are built-in Spark expressions, so they stay inside generated code.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- text


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def bare(c: Column) -> Column:
    """Without accents (letters that carry marks, and combining marks)."""
    return F.regexp_replace(F.translate(c, ACCENTED, BARE), r"\p{Mn}", "")


def plain_upper(c: Column) -> Column:
    """Without accents, white space collapsed and trimmed, upper case; null: empty."""
    return F.upper(F.trim(F.regexp_replace(bare(F.coalesce(c, F.lit(""))), r"\s+", " ")))


def per_text(df: DataFrame, column: str, **rules) -> DataFrame:
    """``df`` with a column for each rule of the text in ``column``; each different text is looked at once.

    Texts are names of which there are far fewer than rows; a null text takes what the rules give for null.
    """
    texts = df.select(F.col(column).alias("_text")).distinct().select("_text", *(rule(F.col("_text")).alias(name) for name, rule in rules.items()))
    return df.join(texts, F.col(column).eqNullSafe(F.col("_text")), "left").drop("_text")


def shirt_number(c: Column) -> Column:
    """A shirt number without leading zeros; "0" stays."""
    t = F.trim(c)
    return F.when(t.rlike("^0+$"), "0").otherwise(F.regexp_replace(t, "^0+", ""))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100 * part.cast("double") / whole).otherwise(F.lit(0.0).cast("double"))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(default))


def safe_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(default).cast("double"))


def first_rule(rules: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first rule that holds: ordered rules as one expression."""
    (test, value), *rest = rules
    out = F.when(test, value)
    for test, value in rest:
        out = out.when(test, value)
    return out.otherwise(otherwise)


# ---------------------------------------------------------------- gender, age, division (the rules' patterns are fixed values)


def gender(c: Column) -> Column:
    return _gender(plain_upper(c))


def _gender(u: Column) -> Column:
    return first_rule(
        [
            (u.rlike("MASC|HOMME") | u.rlike(r"\bM\b") & ~u.rlike("FEM|DAME|MIXTE"), "MASCULIN"),
            (u.rlike("FEM|DAME"), "FEMININ"),
            (u.rlike("MIXTE"), "MIXTE"),
            (u.rlike(r"\bF\b"), "FEMININ"),
        ]
    )


#: Oldest age of each numbered category, and the older names of the categories.
AGE_STEPS = (9, 11, 13, 15, 18, 21)
AGE_WORDS = (("CADET", "M18"), ("MINIME", "M15"), ("BENJAMIN", "M13"), ("POUSSIN", "M11"), ("PUPILLE|BABY", "M9"), ("ESPOIR|JUNIOR", "M21"), ("JEUNE", "JEUNES"))
ADULT_WORDS = "REGIONAL|NATIONAL|ELITE|DEPARTEMENTAL|PRO A|PRO B|LIGUE A|LIGUE B"


def age_category(c: Column, senior_by_default: bool = False) -> Column:
    """M9 to M21, JEUNES, SENIOR, VETERAN, or null."""
    return _age_category(plain_upper(c), senior_by_default)


def _age_category(u: Column, senior_by_default: bool) -> Column:
    n = F.regexp_extract(u, r"\b[MU]\s*([0-9]{1,2})(?:[MFG]|\b)", 1).try_cast("int")
    stepped = reduce(lambda out, a: out.when(n <= a, f"M{a}"), AGE_STEPS[1:], F.when(n <= AGE_STEPS[0], f"M{AGE_STEPS[0]}")).otherwise("SENIOR")
    last = "SENIOR" if senior_by_default else None
    return first_rule(
        [(u.contains("SENIOR"), "SENIOR"), (u.contains("VETERAN"), "VETERAN"), (n.isNotNull(), stepped), *((u.rlike(w), v) for w, v in AGE_WORDS), (u.rlike(ADULT_WORDS), "SENIOR")], last
    )


def is_youth(c: Column) -> Column:
    return F.coalesce(age_category(c).isin(*(f"M{a}" for a in AGE_STEPS), "JEUNES"), F.lit(False))


def age_limit(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(age_category(c), F.lit("")), r"^M(\d+)$", 1).try_cast("int")


def earliest_birth_year(category: Column, season_end: Column) -> Column:
    return season_end - age_limit(category)


def oldest_age(birth_year: Column, reference_year: int) -> Column:
    return F.when(birth_year.isNotNull(), F.greatest(F.lit(0), F.lit(reference_year) - birth_year))


def division(c: Column, youth: bool = False) -> Column:
    """Division number 1 to 4 of a competition's name or pool code, or null."""
    return _division(F.regexp_replace(plain_upper(c), r"\b[46]\s*X\s*[46]\b", " "), youth)


def _division(u: Column, youth: bool) -> Column:
    young = F.lit(youth) | u.rlike(r"\b(M[0-9]{1,2}|JEUNES?|CADET(TE)?S?|MINIMES?|BENJAMINE?S?|POUSSINE?S?|JUNIORS?|ESPOIRS?)\b")
    found = lambda pattern: F.nullif(F.regexp_extract(u, pattern, 1), F.lit(""))
    adult = F.coalesce(found(r"^[A-Z]?([1-4])[MF]"), found(r"\b([1-4])\s*$"))
    return F.coalesce(
        found(r"\b(?:PRE)?(?:NATIONAL|REGIONAL|DEPARTEMENTAL)(?:E|ES|AUX)?\s+([1-4])\b"),
        found(r"\b[RND]([1-4])\b"),
        F.when(~young, adult),
    )


# ---------------------------------------------------------------- level

#: Rank of each level label, 0 the lowest.
LEVEL_RANKS = {
    "LOISIR": 0, "BRASSAGE": 0, "D4": 1, "D3": 2, "D2": 3, "D1": 4, "DEP": 4, "JEUNES DEP": 4, "JEUNES CDF": 5, "PREREG": 6,
    "R4": 7, "R3": 7, "R2": 8, "R1": 9, "REGIONAL": 9, "JEUNES REGIONAL": 9, "PRENAT": 10, "N3": 11, "N2": 12, "NATIONAL": 12, "N1": 15,
    "ELITE AVENIR": 14, "ELITE": 15, "JEUNES ELITE": 15, "PRO": 16, "PRO B": 16, "PRO A": 17, "CDF": 18, "CDF ASSIS": 18,
}


def level(*parts: Column) -> Column:
    """The level label of a competition's texts, by ordered rules: the first that holds."""
    return _level(plain_upper(F.concat_ws(" ", *parts)), "DEP")


def _level(u: Column, otherwise: str | None) -> Column:
    has = lambda p: u.rlike(p)
    youth = has(r"\b(M(9|1[1-9]|2[01])|U(9|1[1-9]|2[01])|JEUNES?|CADET(TE)?S?|MINIMES?|BENJAMINE?S?|POUSSINE?S?)\b")
    regional, departmental = has(r"REGION|\bR[1-4]\b"), has(r"DEPART|\bD[1-4]\b|\bDEP\b")
    lower = regional | departmental
    cup, leisure = has(r"COUPE DE FRANCE|\bCDF\b"), has(r"LOISIR|BRASSAGE|DETENTE")
    pre_nat = has(r"PRE[ _-]?NAT|ACCESSION (A LA )?(N3|NATIONAL)")
    pre_reg = has(r"PRE[ _-]?REG|ACCESSION (A LA )?REGION")
    nth = lambda letter, word, k: has(rf"\b{letter}{k}\b|{word}[A-Z]*\s+{k}\b")
    top = ~lower & ~has("ACCESSION") & ~pre_nat
    return first_rule(
        [
            (cup & has("ASSIS"), "CDF ASSIS"),
            (cup & youth, "JEUNES CDF"),
            (cup, "CDF"),
            (leisure, "LOISIR"),
            (has(r"\bPRO A\b|\bLIGUE A\b|\bLA[MF]\b"), "PRO A"),
            (has(r"\bPRO B\b|\bLIGUE B\b|\bLB[MF]\b"), "PRO B"),
            (has(r"\bPRO\b") & ~lower, "PRO"),
            (has("ELITE") & youth, "JEUNES ELITE"),
            (has("ELITE") & ~lower & has("AVENIR"), "ELITE AVENIR"),
            (has("ELITE") & ~lower, "ELITE"),
            *((top & nth("N", "NATIONAL", k), f"N{k}") for k in (1, 2, 3)),
            (pre_nat, "PRENAT"),
            (pre_reg, "PREREG"),
            (regional & youth, "JEUNES REGIONAL"),
            *((nth("R", "REGIONAL", k), f"R{k}") for k in (1, 2, 3, 4)),
            (regional, "REGIONAL"),
            (departmental & youth, "JEUNES DEP"),
            *((nth("D", "DEPARTEMENTAL", k), f"D{k}") for k in (1, 2, 3, 4)),
            (departmental, "DEP"),
            (has("NATIONAL"), "NATIONAL"),
        ],
        otherwise,
    )


def level_rank(label: Column) -> Column:
    """The rank of a level however it is spelled: a label's own, else that of the label that the rules find; null if none holds."""
    table = F.create_map(*(F.lit(x) for kv in LEVEL_RANKS.items() for x in kv))
    u = plain_upper(label)
    return F.coalesce(F.try_element_at(table, u), F.try_element_at(table, F.coalesce(_level(u, None), F.lit(""))))


def echelon_of(rank: Column) -> Column:
    return F.when(rank >= 11, "NATIONAL").when(rank >= 7, "REGIONAL").when(rank >= 1, "DEPARTEMENTAL").when(rank == 0, "LOISIR")


# ---------------------------------------------------------------- scores


def set_score(c: Column, forfeit_as_zero: bool = False) -> Column:
    """A set score as "A/B", P for a forfeit; null if it is none."""
    u = F.upper(F.replace(F.trim(c), F.lit("-"), F.lit("/")))
    a, b = F.regexp_extract(u, r"^\s*(\d+|P)\s*/\s*(\d+|P)\s*$", 1), F.regexp_extract(u, r"^\s*(\d+|P)\s*/\s*(\d+|P)\s*$", 2)
    if forfeit_as_zero:
        a, b = F.when(a == "P", "0").otherwise(a), F.when(b == "P", "0").otherwise(b)
    return F.when(a != "", F.concat_ws("/", a, b))


def forfeit_of(c: Column) -> Column:
    """Which side forfeits: a, b, both, or null."""
    s = set_score(c)
    a, b = s.startswith("P/"), s.endswith("/P")
    return F.when(a & b, "both").when(a, "a").when(b, "b")


def score_pair(c: Column) -> Column:
    s = F.split(set_score(c, True), "/")
    return F.when(s.isNotNull(), F.struct(s[0].cast("int").alias("a"), s[1].cast("int").alias("b")))


def score_says_played(c: Column) -> Column:
    p = score_pair(c)
    return F.coalesce(forfeit_of(c).isNotNull() | (p["a"] + p["b"] > 0), F.lit(False))


def resolved_score(export: Column, sheet: Column, legacy: Column) -> Column:
    """The score that holds (export before sheet before legacy), its source, and whether export and sheet differ."""
    e, s, old = set_score(export), set_score(sheet), set_score(legacy)
    conflict = F.coalesce(e != s, F.lit(False))
    shown = F.when(conflict, F.format_string("Scrape %s · PDF %s", e, s)).otherwise(F.coalesce(e, s, old))
    return F.struct(
        F.coalesce(e, s, old).alias("score"), shown.alias("shown"), F.when(e.isNotNull(), "export").when(s.isNotNull(), "pdf").alias("source"), conflict.alias("conflict")
    )


def played(forfeit: Column, winner: Column, score: Column, sets_a: Column, sets_b: Column) -> Column:
    """Whether any evidence says that the match was played."""
    any_ = F.coalesce(forfeit, F.lit(False)) | F.coalesce(F.trim(winner) != "", F.lit(False)) | score_says_played(score)
    return any_ | (F.coalesce(sets_a, F.lit(0)) + F.coalesce(sets_b, F.lit(0)) > 0)


def set_list(c: Column) -> Column:
    """"25-18,16-25" as an array of structs a, b; parts that are no score are left out."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda p: p.rlike(r"^\s*\d+\s*[-/]\s*\d+\s*$"))
    number = lambda p, k: F.regexp_extract(p, r"^\s*(\d+)\s*[-/]\s*(\d+)", k).cast("int")
    return F.transform(parts, lambda p: F.struct(number(p, 1).alias("a"), number(p, 2).alias("b")))


def minutes(c: Column) -> Column:
    """A duration ("1h25", "1:25", "85 min", "85") in minutes."""
    t = F.lower(F.trim(c))
    h = F.regexp_extract(t, r"^(\d+)\s*[h:]\s*(\d*)", 1)
    m = F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d+)\s*[h:]\s*(\d*)", 2), F.lit("")), F.lit("0"))
    whole = F.nullif(F.regexp_extract(t, r"^(\d+)\s*(?:min|mn|')?\s*$", 1), F.lit(""))
    return F.when(h != "", h.cast("double") * 60 + m.cast("double")).otherwise(whole.cast("double"))


# ---------------------------------------------------------------- dates, seasons, codes


def french_date(c: Column) -> Column:
    """JJ/MM/AAAA, JJ-MM-AAAA or AAAA-MM-JJ."""
    t = F.replace(F.trim(c), F.lit("/"), F.lit("-"))
    return F.coalesce(F.when(t.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(t, "d-M-yyyy")), F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d")))


def season_end(c: Column) -> Column:
    """Last year of a season's code: "2024-2025", "24/25", or its first four digits."""
    long = F.regexp_extract(c, r"(\d{4})\s*[-/]\s*(\d{4})", 2).try_cast("int")
    a, b = (F.regexp_extract(c, r"^\s*(\d{2})\s*[-/]\s*(\d{2})\s*$", k).try_cast("int") for k in (1, 2))
    digits = F.substring(F.regexp_replace(c, r"\D", ""), 1, 4)
    return F.coalesce(long, F.when(b < a, 2100 + b).otherwise(2000 + b), F.when(F.length(digits) == 4, digits.try_cast("int")))


def pool_code(c: Column) -> Column:
    """A pool's code without the mark of its leg, and the leg (ALLER, RETOUR or null)."""
    u = F.upper(c)
    base, end, before = u.substr(F.lit(1), F.length(u) - 1), F.right(u, F.lit(1)), F.left(F.right(u, F.lit(2)), F.lit(1))
    leg = F.when(F.length(u) < 4, None).when(end == "R", "RETOUR").when((end == "A") & (~before.isin("M", "F") | u.rlike("^(DS|DF|DM|D1|D2|D3)")), "ALLER")
    return F.struct(F.when(leg.isNull(), c).otherwise(base).alias("code"), leg.alias("leg"))


def match_pool(c: Column) -> Column:
    """The pool's code in a match code (what precedes its three last digits)."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(.+?)\d{3}$", 1), F.lit("")), F.substring(c, 1, 3))


#: First letter of a youth pool's code to age category; second letters of each gender.
YOUTH_LETTERS = {"B": "M13", "C": "M18", "J": "M21", "M": "M15", "R": "M18"}
YOUTH_MEN, YOUTH_WOMEN = "MXYZ", "FGHI"


def youth_pool(c: Column) -> Column:
    """Age category, division code and zone of a youth pool's code."""
    u = F.upper(c)
    first, second = F.substring(u, 1, 1), F.substring(u, 2, 1)
    known = F.length(u) >= 2
    men, women = F.contains(F.lit(YOUTH_MEN), second), F.contains(F.lit(YOUTH_WOMEN), second)
    age = F.try_element_at(F.create_map(*(F.lit(x) for kv in YOUTH_LETTERS.items() for x in kv)), first)
    div = F.when(known & age.isNotNull(), F.concat(first, F.when(women, "F").otherwise("M"), F.lit("X")))
    return F.struct(age.alias("age"), div.alias("division"), F.when(known & (men | women), second).alias("zone"))


def competition_info(name: Column) -> Column:
    """Gender, age category, level, division, kind and phase read from a competition's name."""
    u = plain_upper(name)
    kind = F.when(u.rlike("COUPE|CDF"), "COUPE").when(u.rlike("TOURNOI"), "TOURNOI").when(u.rlike("PLAY-? ?OFF|BARRAGE"), "BARRAGE").otherwise("CHAMPIONNAT")
    phase = F.when(u.rlike("FINALE|FINAL"), "FINALE").when(u.rlike("PLAY-? ?OFF"), "PLAYOFF").when(u.rlike("PLAY-? ?DOWN"), "PLAYDOWN").when(u.rlike("BRASSAGE"), "BRASSAGE").otherwise("POULE")
    return F.struct(gender(name).alias("gender"), age_category(name).alias("age"), level(name).alias("level"), division(name).alias("division"), kind.alias("kind"), phase.alias("phase"))
