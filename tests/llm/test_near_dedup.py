"""Operator 7 against all pairs, by brute force."""

import random
import re

import pytest

from rallyframe.llm import near_dedup as nd
from rallyframe.llm.common import table
from rallyframe.llm.components import components
from rallyframe.llm.near_dedup import keep_first, near_dedup


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """doc_id -> (set size, component) by union of all linked pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    holders: dict = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    done = set()
    for i in ids:
        for j in {j for s in sets[i] for j in holders[s] if j > i}:
            if (i, j) not in done:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", 1, b"") for i, t in rows], "doc_id long, text string, same string, n int, sig binary").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(docs).collect()}
    want = brute(rows)
    assert got == want
    return want


def test_supplied_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = check(spark, rows)
    assert any(i != c for i, (_, c) in want.items())


def test_edits_chains_and_strangers(spark):
    random.seed(5)
    words = [f"w{k}" for k in range(3000)]
    rows, at = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three")], 10
    base = random.choices(words, k=120)
    for k in range(60):  # a chain: each has a word changed against the one before
        base[(k * 7) % 120] = random.choice(words)
        rows.append((at, " ".join(base)))
        at += 1
    passage = random.choices(words, k=60)
    for _ in range(40):  # strangers with a common passage
        rows.append((at, " ".join(random.choices(words, k=80) + passage)))
        at += 1
    long = random.choices(words, k=20000)
    rows += [(at, " ".join(long)), (at + 1, " ".join(long[:18000])), (at + 2, " ".join(long)), (at + 3, "x" * 50000)]
    want = check(spark, rows)
    assert want[10 + 59][1] == 10


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Near the similarity on both sides of it, with buckets cut into small blocks."""
    monkeypatch.setattr(nd, "LISTED", 2)
    monkeypatch.setattr(nd, "BLOCK", 7)
    random.seed(8)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for group in range(3):
        base = random.choices(words, k=100)
        for k in range(40):
            mine = list(base)
            for _ in range(random.randrange(1, 9)):
                mine[random.randrange(100)] = random.choice(words)
            rows.append((group * 100 + k, " ".join(mine)))
    random.shuffle(rows)
    check(spark, rows)


def test_repeated_null_and_empty(spark):
    schema = "doc_id long, text string"
    assert near_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (9, "A b c d e f")]
    got = sorted(map(tuple, near_dedup(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (None, 1, None, True), (9, 2, 7, False)], key=str)
    kept = keep_first(spark.createDataFrame(rows, schema)).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == [7, 7]


def test_repeated_ids_of_different_texts(spark):
    """Every row's links count, and rows of one id are one document: against all pairs of rows."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for group in range(12):
        x, y = ([word() for _ in range(60)] for _ in range(2))
        near = [*y[:30], word(), *y[30:]]
        at = 100 * group
        rows += [(at + 5, " ".join(x)), (at + 5, " ".join(y)), (at + 7, " ".join(near))]
        if group % 3 == 0:
            rows += [(at + 3, " ".join([*x[1:], word()])), (at + 5, "")]
    sets = [shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for k in range(j):
            both = len(sets[j] & sets[k])
            if both and 100 * both >= 75 * (len(sets[j]) + len(sets[k]) - both):
                a, b = sorted((find(rows[j][0]), find(rows[k][0])))
                root[b] = a
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("n_shingles > 0").collect()
    assert len(got) == sum(map(bool, sets))
    for r in got:
        assert r["component_id"] == find(r["doc_id"]), r


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (8, 9)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 60), (29, 50)], []])
def test_components(spark, edges):
    root: dict = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in root.items() if i != r}


def test_against_sql(spark, sf_dir):
    from oracle import compare, connection

    from rallyframe.llm.queries import ORACLES, QUERIES

    name = "op7_minhash_dedup"
    assert compare(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name]) is None
