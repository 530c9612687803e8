"""Operators 12 and 13 against plain Python over all phrases and all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rallyframe.llm import components, spelling
from rallyframe.llm import phrases as P
from rallyframe.llm.common import materialise, table
from rallyframe.llm.spelling import near_pairs, runs, slipped, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * found[p[i : i + k]]}
        lines = []
        for p, a in found.items():
            if p not in inside:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                lines.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(lines)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


ODD = [
    (None, None),
    ("en", None),
    ("en", ""),
    ("und", "the same words\tthe same words. the\nsame words"),
    (None, "the same words the same words"),
    ("xx", "a a a a a a a a a"),
    ("xx", "É É É é,é É\x1cÉ É É   É"),
    ("yy", "q r s t " * 40_000),
    ("yy", "q.r s,t q r" * 10),
]


@pytest.mark.parametrize("dense", [P.MOST_DENSE, 3])
def test_phrases_are_those_of_plain_python(spark, sf_dir, dense):
    rows = [(r["lang"], r["text"]) for r in table(spark, sf_dir, "documents").select("lang", "text").collect()] + ODD * 2
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as key", "text as word", "2 as a", "lang as phrase").repartition(7)
    got = sorted(map(tuple, P.top_phrases(df, top=50, least=6, most_dense=dense).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == plain_phrases(rows, 6, 50)


def test_phrases_of_an_empty_table(spark):
    assert P.top_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_score_passes_64_bits(spark):
    big = 9_000_000_000_000_000
    rows = spark.createDataFrame([(2, b"\0\0\0\1\0\0\0\2", big)], "size int, key binary, a long")
    words = spark.createDataFrame([("en", b"x", b"\0\0\0\1", big + 1), ("en", b"y", b"\0\0\0\2", big + 2)], "lang string, word binary, key binary, a long")
    got = P._scored(rows, words, spark.createDataFrame([("en", 3 * big)], "lang string, n long"), 4, 80).first()
    assert got["score"] == 2_000_000 * big // (2 * big + 3) and got["phrase"] == "x y"


def test_radix_order_is_the_lexical_one():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 5, 4000).astype(np.uint64) << np.uint64(40), rng.integers(0, 1 << 63, 4000).astype(np.uint64) % np.uint64(70_000)]
    order = P.radix_order(columns)
    assert (order == np.lexsort((columns[1], columns[0]))).all()
    keys, n = P.run_lengths(columns)
    assert n.sum() == 4000 and len({*zip(*(k.tolist() for k in keys))}) == len(n)


def plain_spelling(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}

    def one(a, b):
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]

    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def test_spelling_variants_are_those_of_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [
        (None, "Wörtern wörtern WÖrtern wörter wörter wörter wörtér wörtér wörtér " * 3),
        (-5, None),
        (7, ""),
        (8, "banana " * 50_000 + "bananas " * 20 + "banan " * 3 + "bananana " * 3 + "anana " * 3 + "nbanana " * 3),
        (8, "banana " * 7),
        (9, "aaaaa " * 40 + "aaaaaa " * 20 + "aaaaaaa " * 10 + "aaaaaaaa " * 5 + "aaaabaaa " * 3),
        (10, "xĀyyyyyy×zz " * 4 + "ÿþÀABC " * 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as size").repartition(5)
    got = spelling_variants(df).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_spelling(rows)


def test_spelling_of_an_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_join_of_words_is_a_broadcast(spark, tmp_path):
    """Small files of words give many keys: however small a table looks, it is not sent through the driver."""
    rows = [("houses", 9), ("house", 50), ("horses", 4), ("mouse", 3)]
    words = spark.createDataFrame(rows, "word string, n long")
    parent = spark.createDataFrame([("houses", "house"), ("house", "mouse")], "id string, root string")
    docs = spark.createDataFrame([(1, " ".join(w for w, n in rows for _ in range(n)))], "doc_id long, text string")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    steps = {"pairs": near_pairs(words), "variants": spelling_variants(docs)}
    plans = {k: df._jdf.queryExecution().executedPlan().toString() for k, df in steps.items()}
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans.values()), plans
    seen = []

    def kept(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(components, "materialise", kept)
        m.setattr(spelling, "materialise", kept)
        assert {tuple(r) for r in components.roots(parent, "merge").collect()} == {("houses", "mouse"), ("house", "mouse")}
        assert {r["word"]: r["root"] for r in spelling_variants(docs).collect()} == dict.fromkeys(("houses", "house", "horses", "mouse"), "house")
    assert len(seen) >= 5 and not any("Broadcast" in p for p in seen), seen


def test_runs_and_slips():
    assert runs("AbÉc, dāe 1ß") == [b"ab\xc9c", b"d", b"e", b"\xdf"]
    some = [(i, w) for i in range(400) for w in (b"\xe9tude", b"houses") if zlib.crc32(f"{i}:{w.decode('latin-1')}".encode()) % 97 == 0]
    assert some
    for i, w in some:
        at = zlib.crc32(f"{i}:{w.decode('latin-1')}".encode()) % len(w)
        assert slipped(str(i), w) == w[:at] + w[at + 1 :]
