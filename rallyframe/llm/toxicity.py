"""Operator 2: toxicity after noisy-channel deobfuscation.

1. A character trigram model is counted over the plain words of all documents (at most one row per
   trigram of a fixed alphabet and task; the sum is bounded by the alphabet).
2. Disguised stretches (leetspeak, letters spaced or dotted apart, letters repeated) become character
   lattices; Viterbi finds the reading that is best under the character model plus the channel's
   costs.  Plain words read as themselves.
3. The restored words are scored: prefixes and whole words that labelled toxic documents hold more
   often than others are the features of a regularised logistic model.

The classifier learns from at most ``SAMPLE`` labelled rows of each class, those of smallest hash of
the id, with weights that restore the classes' shares.  Ids, languages and sources are no inputs.

Defined cases: null and empty texts get the score of a text without evidence; repeated rows are scored
each; without labels of both classes every score is the share of label 1 (0.0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import hold_cache, id_text, materialise, parts_of
from rallyframe.llm.words import held_out, logistic, training_labels

#: Labelled rows of each class that the classifier learns from, at most.
SAMPLE = 10_000
#: Grams kept as features, at most, and the documents that must hold one.
FEATURES, LEAST_DOCS = 2048, 4
THRESHOLD = 0.3
#: A worker forgets its tokens between two texts once it knows so many (about 50 MB).
MOST_TOKENS = 400_000

#: The model's alphabet: 0 is the end of a word, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SIZE = len(LETTERS) + 2
#: What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i",
}
#: Costs in nats: a symbol for a letter, an inserted symbol, a letter repeated, a space taken out of a spaced word.
SWAP, INSERTED, REPEATED, JOINED = 0.7, 4.5, 0.5, 0.1

CODE = np.zeros(0x250, np.int64)
for _k, _c in enumerate(LETTERS):
    CODE[ord(_c)] = _k + 2
_INDEX = {c: k + 2 for k, c in enumerate(LETTERS)}

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*]{1,2}[^\s.\-_*]){3,}(?!\S)")
_RUN = re.compile(r"(.)\1\1")
_MIXED = re.compile(r"[^\W\d_]")
_LEETED = re.compile("[" + re.escape("".join(LEET)) + "]")
_INNER = re.compile(r"[^\W_][.\-_*]+[^\W_]")
#: Marks around a token that no reading needs.
EDGE = ".,;:?!\"'()[]{}<>*%&#~^`/\\|-_=»«"


def word_counts_to_rows(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(trigram code, count) of the words, with two ends before and one behind each."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "".join(f"  {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(points < len(CODE), CODE[np.minimum(points, len(CODE) - 1)], 0)
    code = np.where((code == 0) & (points != 32), 1, code)
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter((len(w) + 3 for w in words), np.int64, len(words)))
    tri = (code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:]
    inside = ~((points[1:-1] == 32) & (points[2:] == 32)) & ~((code[:-2] != 0) & (code[1:-1] == 0))
    total = np.bincount(tri[inside], weights=weight[2:][inside], minlength=1)
    at = np.flatnonzero(total)
    return at, total[at].astype(np.int64)


def character_counts(docs: DataFrame) -> DataFrame:
    """(tri, n): trigrams of the plain words of all documents."""

    def plain(seen: Counter) -> Counter:
        words: Counter = Counter()
        for token, n in seen.items():
            word = token.strip(EDGE)
            if word.isalpha():
                words[word] += n
        return words

    def run(batches):
        seen: Counter = Counter()
        total = np.zeros(SIZE**3, np.int64)
        hold_cache("counts", seen.clear)
        for b in parts_of(batches, 0):
            for text in b.column(0).to_pylist():
                seen.update(text.lower().split())
            if len(seen) > 200_000:
                at, n = word_counts_to_rows(plain(seen))
                total[at] += n
                seen.clear()
        at, n = word_counts_to_rows(plain(seen))
        total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["tri", "n"])

    return id_text(docs).select("text").mapInArrow(run, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n"))


class CharacterModel:
    """-log P(next | last two), interpolated with shorter contexts; one table of SIZE**3 floats."""

    def __init__(self, tri: np.ndarray, n: np.ndarray):
        count = np.zeros(SIZE**3)
        count[tri] = n
        count = count.reshape(SIZE, SIZE, SIZE)
        one = count.sum((0, 1)) + 0.5
        one /= one.sum()
        pair = count.sum(0)
        two = (pair + 4 * one) / (pair.sum(1, keepdims=True) + 4)
        three = (count + 4 * two[None]) / (count.sum(2, keepdims=True) + 4)
        self.cost = (-np.log(three)).astype(np.float32)


def slots(text: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice: for each place, what it may read as ("" for nothing, " " for a word's end) and at what cost."""
    out: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(text):
        c, run = text[k], 1
        while k + run < len(text) and text[k + run] == c:
            run += 1
        if c in _INDEX or c.isalpha():
            if run == 1:
                out.append([(c, 0.0)])
            else:
                out.append([(c, REPEATED if run > 2 else 3.0), (c + c, 0.0 if run == 2 else REPEATED + 0.5)])
        elif c in LEET:
            out.append([(x, SWAP) for x in LEET[c]] + [(x + x, SWAP + 0.5) for x in LEET[c] if run > 1] + [("", INSERTED)])
        elif c.isspace():
            out.append([("", JOINED), (" ", 0.0 if run > 1 else 1.0)] if spaced else [(" ", 0.0)])
        else:
            out.append([("", JOINED if spaced else 0.6), (" ", 1.5)])
        k += run
    return out


def restore(text: str, model: CharacterModel, spaced: bool = False) -> str:
    """The best reading of a disguised stretch (lower case)."""
    cost = model.cost
    states = {(0, 0): (0.0, "")}
    kept: list[str] = []
    for options in slots(text, spaced):
        nxt: dict = {}
        for (a, b), (total, read) in states.items():
            for piece, extra in options:
                x, y, t = a, b, total + extra
                for c in piece:
                    z = 0 if c == " " else _INDEX.get(c, 1)
                    if z == 0 and y == 0:
                        continue
                    t += float(cost[x, y, z])
                    x, y = (0, 0) if z == 0 else (y, z)
                old = nxt.get((x, y))
                if old is None or t < old[0]:
                    nxt[x, y] = (t, read + piece)
        states = nxt
        if len(states) == 1:  # all readings agree so far: keep it aside, so long stretches stay linear
            ((key, (t, read)),) = states.items()
            kept.append(read)
            states = {key: (0.0, "")}
    best = min(states.items(), key=lambda s: s[1][0] + (float(cost[s[0][0], s[0][1], 0]) if s[0][1] else 0.0))
    return "".join(kept) + best[1][1]


def disguised(token: str) -> bool:
    """Whether a token (lower case, marks at its edges taken off) may hide letters."""
    if token.isalpha():
        return _RUN.search(token) is not None
    return _MIXED.search(token) is not None and (_LEETED.search(token) is not None or _INNER.search(token) is not None or _RUN.search(token) is not None)


def words_of_token(token: str, model: CharacterModel) -> list[str]:
    """The restored words of one token."""
    core = token.strip(EDGE)
    if core.endswith("$$$"):
        core = core.rstrip("$" + EDGE)
    if not core:
        return []
    if not disguised(core):
        return [core] if core.isalpha() else _WORD.findall(core)
    return list(dict.fromkeys(_WORD.findall(restore(core, model)) + _WORD.findall(core)))


def grams(word: str) -> list[str]:
    """A word's prefixes of 4 to 8 letters and the word itself."""
    return [word[:n] for n in range(4, min(8, len(word) - 1) + 1)] + [f"{word}$"]


class _Tokens(dict):
    """Token -> what its restored words give; what isn't known yet is made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        value = self[token] = self.make(token)
        return value


def spaced_words(text: str, model: CharacterModel) -> list[str]:
    """Words restored from letters that stand apart; as their borders are uncertain, also what follows each letter."""
    out: list[str] = []
    for m in _SPACED.finditer(text):
        if len(set(m.group())) > 3:  # a few letters over and over hide no word
            words = [w for w in _WORD.findall(restore(m.group(), model, True)) if len(w) > 1]
            letters = "".join(words)
            out += words + [letters[k : k + 12] for k in range(len(letters) - 3)]
    return out


def _gram_counts(train: DataFrame, model) -> DataFrame:
    """(gram, pos, neg): documents of each label that hold the gram."""

    def run(batches):
        m = model.value
        make = _Tokens(lambda token: [g for w in words_of_token(token, m) for g in grams(w)])
        sides = (Counter(), Counter())

        def rows():
            names = list(sides[0].keys() | sides[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sides[1][g] for g in names], pa.int64()), pa.array([sides[0][g] for g in names], pa.int64())], ["gram", "pos", "neg"])

        hold_cache("grams", make.clear)
        for b in parts_of(batches, 0):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = text.lower()
                found = {g for token in set(low.split()) for g in make[token]}
                found.update(g for w in spaced_words(low, m) for g in grams(w))
                sides[label].update(found)
            if len(make) > 100_000:
                make.clear()
            if len(sides[0]) + len(sides[1]) > 300_000:
                yield rows()
                sides[0].clear(), sides[1].clear()
        yield rows()

    return train.select("text", "label").mapInArrow(run, "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Scorer:
    """Score of a text: logistic of log counts of the feature grams in its restored words."""

    def __init__(self, model: CharacterModel, names: list[str], weights: np.ndarray, bias: float):
        self.model, self.index, self.weights, self.bias = model, {g: k for k, g in enumerate(names)}, weights, bias
        self.tokens = None

    def __getstate__(self):
        return self.__dict__ | {"tokens": None}

    def _hits(self, words: list[str]) -> tuple[int, ...]:
        get = self.index.get
        return tuple(k for w in words for g in grams(w) if (k := get(g)) is not None)

    def counts(self, text: str) -> Counter:
        if self.tokens is None:
            self.tokens = _Tokens(lambda token: self._hits(words_of_token(token, self.model)))
        hold_cache(id(self), self.tokens.clear)
        if len(self.tokens) > MOST_TOKENS:
            self.tokens.clear()
        low = text.lower()
        found = Counter()
        for hit in filter(None, map(self.tokens.__getitem__, low.split())):
            found.update(hit)
        if spaced := spaced_words(low, self.model):
            found.update(self._hits(spaced))
        return found

    def score(self, text: str) -> float:
        found = self.counts(text)
        total = self.bias
        for k, n in found.items():
            total += self.weights[k] * np.log1p(n)
        return float(logistic(np.float64(total)))


def _fit(rows, cols, values, labels, weights, n_features, strength=1.0, steps=400):
    """Weights and bias of an L2-regularised logistic model, by accelerated gradient steps on sparse rows."""
    w, b, n = np.zeros(n_features), 0.0, len(labels)
    share = float(np.average(labels, weights=weights))
    b = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    gw, gb = np.full(n_features, 1e-8), 1e-8
    for step in range(steps):
        p = logistic(np.bincount(rows, values * w[cols], n) + b)
        d = weights * (p - labels)
        g = np.bincount(cols, values * d[rows], n_features) + strength * w
        s = d.sum()
        gw, gb = gw + g * g, gb + s * s
        rate = 0.5
        w, b = w - rate * g / np.sqrt(gw), b - rate * s / np.sqrt(gb)
    return w, b


def train_scorer(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Scorer:
    """The character model over all documents, and the classifier over a bounded sample of the labelled ones."""
    spark, docs = docs.sparkSession, id_text(docs)
    counted = character_counts(docs).toPandas()  # at most SIZE**3 rows
    model = CharacterModel(counted["tri"].to_numpy(np.int64), counted["n"].to_numpy(np.float64))
    sent = spark.sparkContext.broadcast(model)
    known = training_labels(labels, column)
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        scorer = Scorer(model, [], np.zeros(0), 0.0)
        scorer.bias = 40.0 if 1 in shares else -40.0
        return scorer
    sample = known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).union(known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    train = materialise(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label"), "toxic-train")  # at most 2 * SAMPLE ids
    sampled = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sampled) < 2:
        return Scorer(model, [], np.zeros(0), float(np.log((shares[1] + 1e-6) / (shares[0] + 1e-6))))
    n1, n0 = float(sampled[1]), float(sampled[0])
    grams_ = _gram_counts(train, sent).where(F.col("pos") >= LEAST_DOCS)
    p, q = (F.col("pos") + 0.5) / (n1 + 1), (F.col("neg") + 0.5) / (n0 + 1)
    best = grams_.where(p > 2 * q).withColumn("gain", F.col("pos") * F.log(p / q)).orderBy(F.desc("gain"), "gram").limit(FEATURES)
    names = [r["gram"] for r in best.select("gram").collect()]
    scorer = Scorer(model, names, np.zeros(len(names)), 0.0)
    if names:
        inside = spark.sparkContext.broadcast(scorer)

        def run(batches):
            s = inside.value
            for b in parts_of(batches, 0):
                found = [s.counts(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], ["label", "k", "n"])

        got = train.select("text", "label").mapInArrow(run, "label int, k array<int>, n array<int>").collect()  # of the bounded sample
        labels_ = np.array([r["label"] for r in got], float)
        rows = np.repeat(np.arange(len(got)), [len(r["k"]) for r in got])
        cols = np.array([k for r in got for k in r["k"]], np.int64)
        values = np.log1p(np.array([n for r in got for n in r["n"]], float))
        weights = np.where(labels_ == 1, shares[1] / n1, shares[0] / n0)
        scorer.weights, scorer.bias = _fit(rows, cols, values, labels_, weights, len(names))
    else:
        scorer.bias = float(np.log((shares[1] + 1e-6) / (shares[0] + 1e-6)))
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scorer = docs.sparkSession.sparkContext.broadcast(train_scorer(docs, labels, column))

    def run(batches):
        s = scorer.value
        for b in parts_of(batches, 1):
            scores = [s.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())], ["doc_id", "score", "predicted"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns; no shuffle of texts."""
    scorer = docs.sparkSession.sparkContext.broadcast(train_scorer(docs, labels, column))
    at = docs.columns.index(text_col)

    def run(batches):
        s = scorer.value
        for b in parts_of(batches, at):
            yield b.filter(pa.array([s.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
