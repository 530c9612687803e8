"""Operator 12: phrase collocations by n-grams of dictionary ids, sorted and counted by run length.

1. Words are counted per language where texts are read; those that occur ``least`` times or more are the
   dictionary (no phrase with another word can occur as often).
2. Texts become arrays of dictionary ids, 0 for every other word and for the end of a piece, written once.
3. Neighbouring ids are packed into fixed-width binary keys.  A task radix-sorts its keys, counts runs and
   deals them by ranges of keys; the task of a range merges the runs by the same sort.  Ranges are cut by
   the words' own counts, first word and second, so a frequent word's phrases lie over several tasks.
4. Pairs first; longer phrases are only gathered where every pair in them is frequent, by a table of bits of
   bounded size (a false hit costs a count, no result).
5. Parts of phrases, scores and containment are joins on keys.

The dictionary is broadcast (20 bytes a word) while it has at most ``MOST_DENSE`` words, and ids are 32-bit ranks.
Beyond that ids are the words' 128-bit digests and a bit table of ``BITS`` bits tells the frequent words: nothing
that grows is broadcast, at keys four times as wide.

Words are told apart by 96 (dense) or 128 bits of a digest of (language, word); two of a billion words agree with
probability 1e-11.

Defined cases: null and empty texts have no words.  Null language: ``und``, one with rows that say so.  Repeated rows
count each.  Equal scores: more occurrences first, then the phrase in UTF-8 byte order.  Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallyframe.llm.common import hold_cache, materialise, parts, parts_of

MOST_WORDS = 500_000
MOST_DENSE = 1 << 22
BITS = 27
#: Keys that a task sorts at a time, and that a range holds on average at most.
SORTED = 1 << 21
LONGEST = 4
#: A-Z lower-cased, every end of a piece a full stop, tab a space.
TABLE = bytes(b + 32 if 65 <= b < 91 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def tokens(text: str) -> list[bytes]:
    """Words, and a full stop at every end of a piece; no word holds one."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b".", b" . ").split()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word binary, n) of every word."""

    def flush(by_lang):
        for lang, seen in by_lang.items():
            seen.pop(b".", None)
            words = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], ["lang", "word", "n"])
        by_lang.clear()

    def run(batches):
        by_lang: dict[str, Counter] = {}
        for b in parts_of(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = by_lang.get(lang)
                if seen is None:
                    seen = by_lang[lang] = Counter()
                seen.update(tokens(text))
            if sum(map(len, by_lang.values())) > MOST_WORDS:
                yield from flush(by_lang)
        yield from flush(by_lang)

    return texts.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def digests(lang: str, words: list[bytes]) -> np.ndarray:
    """(high, low) 64 bits of each word's digest."""
    start = lang.encode() + b"\0"
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(start + w) for w in words]), ">u8").reshape(-1, 2).astype(np.uint64)


class Dense:
    """Dictionary of 32-bit ids: the rank of the digest, from 1.  ``cdf``: the share of all words before each id, in order
    of the ids; it cuts the ranges of keys."""

    width = 4

    def __init__(self, high: np.ndarray, low: np.ndarray, n: np.ndarray):
        self.key = uuid.uuid4().hex  # a worker's cache holds ids of one dictionary
        order = np.argsort(high, kind="stable")
        self.high, self.low = high[order], (low[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        n = n[order].astype(np.float64)
        self.cdf = np.concatenate([[0], np.cumsum(n)]) / max(1.0, n.sum())

    def ids(self, found: np.ndarray) -> np.ndarray:
        """(ids,) as one column; 0: not in the dictionary."""
        if not len(self.high):
            return np.zeros((len(found), 1), np.uint64)
        at = np.searchsorted(self.high, found[:, 0])
        at[at == len(self.high)] = 0
        hit = (self.high[at] == found[:, 0]) & (self.low[at] == (found[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return np.where(hit, at + 1, 0).astype(np.uint64)[:, None]

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Where a pair stands among all, in [0, 1), if words were drawn apart; ascending with the key."""
        a, b = (ids[:, k, 0].astype(np.int64) for k in (0, 1))
        return self.cdf[a - 1] + (self.cdf[a] - self.cdf[a - 1]) * self.cdf[b - 1]


class Wide:
    """Dictionary too large to broadcast: ids are digests, a bit table lets all frequent words and few others pass."""

    width = 16

    def __init__(self, bits: np.ndarray):
        self.key = uuid.uuid4().hex
        self.bits = bits

    def ids(self, found: np.ndarray) -> np.ndarray:
        hit = test_bits(self.bits, found[:, 0])
        return np.where(hit[:, None], found | np.uint64(1), np.uint64(0))

    def place(self, ids: np.ndarray) -> np.ndarray:
        return (mix(ids[:, :2].reshape(len(ids), -1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def mix(columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a row of 64-bit integers."""
    h = np.full(len(columns), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(columns.shape[1]):
        h = (h ^ columns[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def test_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The bits of a column ``h`` of 64-bit hashes: 2**BITS bits, built by blocks in tasks, whatever the input."""
    block = 1 << 19

    def build(key, rows):
        bits = np.zeros(block, np.uint8)
        bits[rows.column("bit").to_numpy() % block] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bit = F.shiftrightunsigned("h", 64 - BITS).alias("bit")
    by_block = hashes.select(bit).distinct().groupBy(F.floor(F.col("bit") / block).alias("block"))
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for r in by_block.applyInArrow(build, "block long, bits binary").collect():
        table[r["block"] * (block >> 3) : (r["block"] + 1) * (block >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return table


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows of unsigned 64-bit columns, first column first: least significant 16-bit digit first; digits
    that are equal in all rows are passed over."""
    order = None
    for column in reversed(columns):
        spread = int(np.bitwise_or.reduce(column ^ column[0])) if len(column) else 0
        for shift in (0, 16, 32, 48):
            if spread >> shift & 0xFFFF:
                digit = (column >> np.uint64(shift)).astype(np.uint16)
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(len(columns[0])) if order is None else order


def run_lengths(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and the sum of their counts (None: one each)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at)
    return [c[at] for c in columns], counts.astype(np.int64)


def packed(ids: np.ndarray, width: int) -> list[np.ndarray]:
    """Columns of 64 bits of phrases (rows, words, 64-bit parts of an id): two ids of 32 bits share one."""
    flat = ids.reshape(len(ids), -1)
    if width == 16:
        return [flat[:, k] for k in range(flat.shape[1])]
    if flat.shape[1] % 2:
        flat = np.concatenate([flat, np.zeros((len(flat), 1), np.uint64)], axis=1)
    return [flat[:, k] << np.uint64(32) | flat[:, k + 1] for k in range(0, flat.shape[1], 2)]


#: A worker's ids of each language's words.
_known: dict[str, dict[bytes, bytes]] = {}


def encode(texts: DataFrame, dictionary) -> DataFrame:
    """(ids binary): slices of texts as ids, 0 at every end of a piece and of a text and for words outside the dictionary."""
    of = texts.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        d = of.value
        zero = b"\0" * d.width
        code = (lambda row: int(row[0]).to_bytes(4, "little")) if d.width == 4 else (lambda row: row.astype("<u8").tobytes())
        for b in parts_of(batches, 1):
            hold_cache(("phrases", d.key), _known.clear)
            if sum(map(len, _known.values())) > MOST_WORDS:
                _known.clear()
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = _known.get(lang)
                if known is None:
                    known = _known[lang] = {b".": zero}
                found = tokens(text)
                new = [w for w in set(found) if w not in known]
                if new:
                    known.update(zip(new, map(code, d.ids(digests(lang, new)))))
                out.extend(map(known.__getitem__, found))
                out.append(zero)
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["ids"])

    return texts.mapInArrow(run, "ids binary")


def _array(raw: bytes, width: int) -> np.ndarray:
    """(words, 64-bit parts) of encoded ids."""
    if width == 4:
        return np.frombuffer(raw, "<u4").astype(np.uint64)[:, None]
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def count_phrases(coded: DataFrame, dictionary, sizes: tuple[int, ...], least: int, ranges: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(size, key, a): phrases of ``sizes`` words with at least ``least`` occurrences; a key is the ids' bytes, big-endian.

    With ``pairs`` (bits of the frequent pairs' hashes) phrases end where a pair isn't frequent.
    """
    spark = coded.sparkSession
    of = spark.sparkContext.broadcast((dictionary, pairs))
    blobs = "range int, size int, keys binary, counts binary"

    def deal(size, columns, counts, place):
        to = np.minimum((place * ranges).astype(np.int64), ranges - 1)
        order = np.argsort(to, kind="stable")  # within a range the keys stay sorted
        keys = np.stack([c[order] for c in columns], axis=1)
        counts, to = counts[order], to[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)]):
            yield int(to[start]), size, keys[start:end].tobytes(), counts[start:end].astype("<i8").tobytes()

    def flush(held):
        d, _ = of.value
        for size, found in held.items():
            if found:
                ids = np.concatenate(found)
                columns, counts = run_lengths(packed(ids, d.width))
                rows = list(deal(size, columns, counts, d.place(unpacked(columns, d.width, size))))
                for k in range(0, len(rows), 16):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows[k : k + 16]), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "size", "keys", "counts"])
                held[size] = []

    def gather(batches):
        d, bits = of.value
        held, n = {s: [] for s in sizes}, 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                ids = _array(raw, d.width)
                full = ids[:, 0] != 0
                linked = full[:-1] & full[1:]
                if bits is not None:
                    at = np.flatnonzero(linked)
                    two = np.stack([ids[at], ids[at + 1]], axis=1)
                    linked[at] = test_bits(bits, mix(two.reshape(len(two), -1)))
                chain = linked
                for size in range(2, max(sizes) + 1):
                    if size > 2:
                        chain = chain[:-1] & linked[size - 2 :]
                    if size in held:
                        at = np.flatnonzero(chain)
                        held[size].append(np.stack([ids[at + k] for k in range(size)], axis=1))
                        n += len(at)
                if n * d.width > SORTED * 4:
                    yield from flush(held)
                    n = 0
        yield from flush(held)

    def merge(batches):
        d, _ = of.value
        # of each size: merged runs, runs that wait, and how many wait
        runs = {s: [None, [], 0] for s in sizes}

        def settle(s):
            done, wait, _ = runs[s]
            if wait:
                every = ([done] if done else []) + wait
                runs[s] = [run_lengths([np.concatenate([c[k] for c, _ in every]) for k in range(len(every[0][0]))], np.concatenate([n for _, n in every])), [], 0]

        for b in batches:
            for size, keys, counts in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                n = np.frombuffer(counts, "<i8")
                table = np.frombuffer(keys, np.uint64).reshape(len(n), -1)
                runs[size][1].append(([table[:, k] for k in range(table.shape[1])], n))
                runs[size][2] += len(n)
                if runs[size][2] > SORTED:
                    settle(size)
        for s in sizes:
            settle(s)
            if runs[s][0] is None:
                continue
            columns, counts = runs[s][0]
            at = np.flatnonzero(counts >= least)
            if not len(at):
                continue
            ids = unpacked([c[at] for c in columns], d.width, s)
            raw = ids[:, :, 0].astype(">u4") if d.width == 4 else ids.astype(">u8").reshape(len(at), -1)
            raw = np.ascontiguousarray(raw).view(np.uint8).reshape(len(at), -1)
            for k in range(0, len(at), 10_000):
                part = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(at[part]), pa.int32()), pa.array([r.tobytes() for r in raw[part]], pa.binary()), pa.array(counts[at[part]], pa.int64())], ["size", "key", "a"])

    return coded.mapInArrow(gather, blobs).repartitionById(ranges, F.col("range")).mapInArrow(merge, "size int, key binary, a long")


def unpacked(columns: list[np.ndarray], width: int, size: int) -> np.ndarray:
    """The ids of :func:`packed`: (rows, words, 64-bit parts)."""
    if width == 16:
        return np.stack(columns, axis=1).reshape(len(columns[0]), size, 2)
    halves = [h for c in columns for h in (c >> np.uint64(32), c & np.uint64(0xFFFFFFFF))]
    return np.stack(halves[:size], axis=1)[:, :, None]


def _dictionary(spark: SparkSession, frequent: DataFrame, most_dense: int):
    if frequent.count() > most_dense:

        def hashes(batches):
            for b in batches:
                for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(digests(lang, [word])[:, 0].view(np.int64))], ["h"])

        return Wide(bit_table(frequent.select("lang", "word").mapInArrow(hashes, "h long")))
    rows = frequent.select("lang", "word", "n").toArrow()
    found, n = np.zeros((rows.num_rows, 2), np.uint64), rows.column("n").to_numpy()
    for k, (lang, word) in enumerate(zip(rows.column("lang").to_pylist(), rows.column("word").to_pylist())):
        found[k] = digests(lang, [word])[0]
    return Dense(found[:, 0], found[:, 1], n)


def phrases(docs: DataFrame, least: int = 30, share: int = 80, text_col: str = "text", lang_col: str = "lang", most_dense: int = MOST_DENSE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases of two to four words that occur ``least`` times, without those of which a
    longer candidate holds ``share`` percent of the occurrences."""
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    words = materialise(word_counts(texts), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    dictionary = _dictionary(spark, frequent, most_dense)
    width = dictionary.width
    coded = materialise(encode(texts, dictionary), "phrase-ids")
    occurrences = words.agg(F.sum("n")).first()[0] or 0
    ranges = max(parts(spark), -(-occurrences // SORTED))
    pairs = materialise(count_phrases(coded, dictionary, (2,), least, ranges), "phrase-pairs")

    def hashes(batches):
        for b in batches:
            raw = b"".join(b.column(0).to_pylist())
            ids = np.frombuffer(raw, ">u4" if width == 4 else ">u8").astype(np.uint64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(mix(ids).view(np.int64))], ["h"])

    bits = bit_table(pairs.select("key").mapInArrow(hashes, "h long"))
    longer = materialise(count_phrases(coded, dictionary, tuple(range(3, LONGEST + 1)), least, ranges, bits), "phrase-longer")
    of = spark.sparkContext.broadcast(dictionary)

    def keyed(batches):
        d = of.value
        for b in batches:
            raw = []
            for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = d.ids(digests(lang, [word]))
                raw.append((ids[:, 0].astype(">u4") if d.width == 4 else ids.astype(">u8")).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), b.column(2)], ["lang", "word", "key", "a"])

    named = materialise(frequent.select("lang", "word", "n").mapInArrow(keyed, "lang string, word binary, key binary, a long"), "phrase-dictionary")
    return _scored(pairs.unionByName(longer), named, totals, width, share)


def _scored(candidates: DataFrame, named: DataFrame, totals: DataFrame, width: int, share: int) -> DataFrame:
    """Cuts, scores and containment of candidates (size, key, a), by joins on keys."""
    counts = candidates.select("key", F.col("a").alias("f")).unionByName(named.select("key", F.col("a").alias("f")))

    def part(first, words):
        return F.substring("key", first * width + 1, words * width)

    # every cut asks for both its parts; a part's count answers all who ask
    cut = F.explode(F.expr("sequence(1, size - 1)")).alias("k")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(0), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k"), F.col("size") - F.col("k")).alias("part")))).alias("s")
    asked = candidates.select("key", "size", "a", cut).select("key", "size", "a", "k", sides).select("key", "size", "a", "k", "s.side", "s.part")
    answered = asked.join(counts.withColumnRenamed("key", "part"), "part")
    both = answered.groupBy("key", "size", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr("(cast(a as decimal(19, 0)) * 2000000) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = both.withColumn("score", score).groupBy("key", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # parts of longer candidates: those words stand inside one
    inside = [F.struct(part(F.lit(i), F.lit(w)).alias("part"), F.lit(s).alias("of")) for s in range(3, LONGEST + 1) for w in range(2, s) for i in range(s - w + 1)]
    held = candidates.where("size > 2").select("a", "size", F.explode(F.array(*inside)).alias("p")).where("p.of = size")
    most = held.groupBy(F.col("p.part").alias("key")).agg(F.max("a").alias("inside"))
    big = F.col("a").cast("decimal(22, 0)")
    kept = best.join(most, "key", "left").where(F.col("inside").isNull() | (F.col("inside").cast("decimal(22, 0)") * 100 < big * share))
    # words by their ids
    at = F.posexplode(F.expr(f"transform(sequence(0, size - 1), i -> substring(key, i * {width} + 1, {width}))")).alias("i", "word_key")
    spelled = kept.select("key", "a", "c", at).join(named.select(F.col("key").alias("word_key"), "lang", "word"), "word_key")
    lines = spelled.groupBy("key").agg(
        F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("i", F.decode("word", "UTF-8").alias("w")))).alias("words")
    )
    phrase = F.concat_ws(" ", F.transform("words", lambda x: x["w"]))
    return lines.join(F.broadcast(totals), "lang").select("lang", phrase.alias("phrase"), "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def top_phrases(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = phrases(docs, **options)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first within salts of a language, then over what is left of it
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
