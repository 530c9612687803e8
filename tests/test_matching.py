"""Club matching against the plain test of all pairs."""

import random
import re

from pyspark.sql import functions as F

from rallyframe.functions import names as nm


def _edited(r, word):
    for _ in range(r.randint(0, 3)):
        k, c = r.randint(0, len(word)), r.choice("AB0N#")
        word = r.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]])
    return word


def test_matched_clubs_are_all_pairs_of_the_same_club(spark):
    r = random.Random(3)
    words = ["NANTES", "REDON", "PARIS VOLLEY", "AABBAA", "ABABAB", "BABABA", "ABCDE", "ABCDEF", "QUIMPER", "SUPPLIER#000000012", ""]
    ends = ["", " VB", "VB", " VBC", " VOLLEY BALL", " VOLLEYBALL", " VC", " VOLLEY", " 2"]
    names, clubs = ([(x,) for x in sorted({_edited(r, r.choice(words)) + r.choice(ends) for _ in range(200)})] for _ in "ab")
    names, clubs = spark.createDataFrame(names, "name string"), spark.createDataFrame(clubs, "club string")
    found = [tuple(x) for x in nm.match_clubs(names, clubs).collect()]
    plain = names.crossJoin(clubs).where(nm.same_club(F.col("name"), F.col("club"))).collect()
    assert len(found) == len(set(found)) and set(found) == set(map(tuple, plain))


def test_no_pair_of_names_is_tried_by_patterns(spark):
    names = spark.range(10).select(F.concat(F.lit("SUPPLIER#"), "id").alias("name"))
    plan = nm.match_clubs(names, names.withColumnRenamed("name", "club"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and re.search("regexp_replace|rlike", line, re.I)]
