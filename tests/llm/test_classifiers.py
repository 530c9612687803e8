"""Operators 2 and 4: held-out accuracy, deobfuscation against brute force, defined cases."""

import itertools
from collections import Counter

import numpy as np
import pytest

from rallyframe.llm import quality as qu
from rallyframe.llm import toxicity as tx
from rallyframe.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize(("operator", "column", "least"), [(tx.toxicity, "toxic", 0.85), (qu.quality, "quality", 0.95)])
def test_held_out_accuracy(spark, operator, column, least):
    labels = table(spark, SF, "labels")
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = operator(table(spark, SF, "documents"), labels, column).collect()
    held = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert auc(*zip(*held)) >= least
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def model():
    words = Counter({"idiot": 40, "moron": 40, "trash": 40, "loser": 30, "the": 200, "and": 150, "there": 60, "stone": 30, "rest": 40})
    return tx.CharacterModel(*tx.word_counts_to_rows(words))


@pytest.mark.parametrize(("text", "word"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("10ser", "loser"), ("the", "the"), ("and***", "and")])
def test_restored(model, text, word):
    assert word in tx.words_of_token(text, model)


def test_spaced_letters(model):
    assert "moron" in tx.spaced_words("so m o r o n ok", model)
    assert tx.spaced_words("a a a a a a", model) == []


def test_viterbi_is_the_best_reading(model):
    """Against every path through the lattice."""
    for text in ("1d10t", "m0r0n", "tr@sh!", "l0o0ser", "th3r3"):
        def cost(path):
            total, a, b = 0.0, 0, 0
            for piece, extra in path:
                total += extra
                for c in piece:
                    z = 0 if c == " " else tx._INDEX.get(c, 1)
                    if z == 0 and b == 0:
                        continue
                    total += float(model.cost[a, b, z])
                    a, b = (0, 0) if z == 0 else (b, z)
            return total + (float(model.cost[a, b, 0]) if b else 0.0)

        best = min(itertools.product(*tx.slots(text)), key=cost)
        read = tx.restore(text, model)
        assert abs(cost(best) - min(cost(p) for p in itertools.product(*tx.slots(text)) if "".join(x for x, _ in p) == read)) < 1e-6


@pytest.mark.parametrize(("operator", "column"), [(tx.toxicity, "toxic"), (qu.quality, "quality")])
def test_defined_cases(spark, operator, column):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "x" * 100_000, 0.5), (3, "same words again", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    one = spark.createDataFrame([(1, 1), (3, 1), (5, None)], f"doc_id long, {column} int")
    for labels, score in ((none, 0.0), (one, 1.0)):
        rows = operator(docs, labels, column).collect()
        assert len(rows) == 5 and all(abs(r["score"] - score) < 1e-6 for r in rows)
    both = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (5, 1), (2, 1)], f"doc_id long, {column} int")
    assert operator(docs, both, column).count() == 5
    assert operator(spark.createDataFrame([], docs.schema), both, column).count() == 0


def test_reject_keeps_columns(spark):
    docs = table(spark, SF, "documents")
    kept = tx.reject_toxic(docs, table(spark, SF, "labels"))
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in tx.toxicity(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_quality_scores_from_the_stated_moments(spark):
    """Every score again in numpy: Mahalanobis log densities of the classes, solved directly, and the logistic curve."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stats = qu.document_statistics(docs).cache()
    scorer = qu.train_scorer(stats, labels)
    x = {r["doc_id"]: np.array(r["x"]) for r in stats.collect()}
    learned = {r["doc_id"]: r["label"] for r in qu.training_labels(labels, "quality").collect() if r["doc_id"] in x}
    model = scorer.model
    by = [np.stack([x[i] for i, y in learned.items() if y == c]) for c in (0, 1)]
    covs = [np.cov(m.T, bias=True) for m in by]
    pooled = sum(len(m) * c for m, c in zip(by, covs)) / len(learned)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    assert np.allclose(scale, model.scale)
    fits = []
    for a, b in qu.SHRINKAGES:
        logs = []
        for m, c in zip(by, covs):
            z = ((1 - a) * c + a * pooled) / np.outer(scale, scale)
            z = (1 - b) * z + b * max(np.trace(z) / qu.D, 1e-3) * np.eye(qu.D)
            d = (np.stack(list(x.values())) - m.mean(0)) / scale
            logs.append(-0.5 * (d * np.linalg.solve(z, d.T).T).sum(1) - 0.5 * np.linalg.slogdet(z)[1])
        diff = logs[1] - logs[0] + np.log(len(by[1]) / len(by[0]))
        fits.append(1 / (1 + np.exp(-(scorer.slope * np.sign(diff) * np.log1p(np.abs(diff)) + scorer.shift))))
    got = {r["doc_id"]: r["score"] for r in qu.quality(docs, labels).collect()}
    mine = np.array([got[i] for i in x])
    assert min(np.abs(f - mine).max() for f in fits) < 1e-6


def test_toxicity_scores_again_from_the_plain_reading(spark):
    """Every score again without caches or batches: restored words token by token, their features counted, weights summed."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scorer = tx.train_scorer(docs, labels)
    got = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, labels).collect()}
    index = {g: k for g, k in scorer.index.items()}
    for r in docs.select("doc_id", "text").collect():
        low, counts = (r["text"] or "").lower(), Counter()
        for word in [w for t in low.split() for w in tx.words_of_token(t, scorer.model)] + tx.spaced_words(low, scorer.model):
            counts.update(index[g] for g in tx.grams(word) if g in index)
        total = scorer.bias + sum(scorer.weights[k] * np.log1p(n) for k, n in counts.items())
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-total))) < 1e-6
