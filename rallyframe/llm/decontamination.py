"""Operator 8: benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words that ignores some positions, so a window with
substituted words still hashes alike when they fall on ignored positions.  The items' seed hashes are
made in tasks and stay a table; of them only a bit table of bounded size is broadcast.  One pass over
the documents hashes their words under the same masks and keeps, with their texts, the documents that
have hashes which the bit table knows; those hashes and the items' are joined, and each (document,
item, diagonal) of a hit is verified once: the words of both are compared on the diagonal, and every
stretch is kept that is long and alike enough, those that touch as one.  Nothing of the benchmark but
the bits passes the driver, and the documents are read once whatever the benchmark's size.

Defined cases: null and empty texts hit nothing; items without words can't be found; items shorter
than the masks are searched whole, exact or (from ``SHORTEST_LOOSE`` words) with one word substituted;
repeated rows and repeated items are reported each, null ids under null; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import id_text, materialise, parts_of
from rallyframe.llm.words import hashes_of, letter_words

#: Masks of 11 words with 7 that count.  Whichever fifth (rounded down) of 13 to 20 words is substituted, some mask hits at some shift.
MASKS = ("11011010011", "10111001101", "11100111001", "10010110111", "11011110001", "10100011111", "11000101111", "11101100101", "11111100001", "11001011101")
SPAN, SHORTEST_LOOSE = len(MASKS[0]), 6
#: A verified stretch: words, share of them equal; a shorter item must be covered whole.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: The bit table: 128 bits a seed or more, from 2**20 to 2**28 bits (32 MB); each seed sets ``PROBES`` of them.
#: A fuller table lets more hashes through to the join and changes no result.
LEAST_BITS, MOST_BITS, PROBES = 20, 28, 3
#: From so many contaminated texts (16 bytes each) their digests are no longer broadcast.
MOST_SENT = 500_000


def masks_for(n: int) -> list[tuple[int, ...]]:
    """The offsets that count, mask by mask, for an item of ``n`` words."""
    if n >= LEAST_WORDS:
        return [tuple(k for k, c in enumerate(m) if c == "1") for m in MASKS]
    whole = tuple(range(n))
    return [whole] + ([whole[:k] + whole[k + 1 :] for k in range(n)] if n >= SHORTEST_LOOSE else [])


@lru_cache(maxsize=64)
def _factors(mask: tuple[int, ...], span: int) -> tuple[np.ndarray, np.uint64]:
    rng = np.random.default_rng([span, *mask])
    f = rng.integers(1, 1 << 63, len(mask) + 1, dtype=np.uint64) | np.uint64(1)
    return f[:-1], f[-1]


def seed_hashes(words: np.ndarray, mask: tuple[int, ...], span: int) -> np.ndarray:
    """The mask's hash at every place where its span fits."""
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors, add = _factors(mask, span)
    total = np.full(n, add, np.uint64)
    for k, f in zip(mask, factors):
        total += words[k : k + n] * f
    return total ^ (total >> np.uint64(29))


@lru_cache(maxsize=256)
def _code(mask: tuple[int, ...], span: int) -> np.uint64:
    """What sets the hashes of one mask apart from those of others."""
    return np.random.default_rng([7, span, *mask]).integers(1, 1 << 63, dtype=np.uint64)


def keys_of(words: np.ndarray, mask: tuple[int, ...], span: int) -> np.ndarray:
    return seed_hashes(words, mask, span) ^ _code(mask, span)


def masks_in_use(lengths: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """(mask, span) of all items; ``lengths``: the items' different numbers of words, LEAST_WORDS for longer ones."""
    return [(mask, SPAN if n >= LEAST_WORDS else n) for n in lengths if n for mask in masks_for(n)]


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of keys in a table of ``2**bits`` bits."""
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << bits) - 1)
    return [((mixed >> np.uint64(s)) & low).astype(np.int64) for s in (3, 17, 33)[:PROBES]]


def verified(words: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, equal words, item's first word) of the stretches on a diagonal that are long and alike enough."""
    first, last = max(0, diagonal), min(len(words), diagonal + len(item))
    equal = words[first:last] == item[first - diagonal : last - diagonal]
    if len(item) < LEAST_WORDS:
        whole = len(equal) == len(item) and equal.sum() >= len(item) - (len(item) >= SHORTEST_LOOSE)
        return [(first, len(item), int(equal.sum()), 0)] if whole else []
    return [(first + s, e - s, int(equal[s:e].sum()), first + s - diagonal) for s, e in stretches(equal)]


def stretches(equal: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of LEAST_WORDS or more with LEAST_SHARE equal words, those that overlap
    merged: stretches whose end words are equal, or any where there are none."""
    n = len(equal)
    if n < LEAST_WORDS:
        return []
    total = np.concatenate([[0], np.cumsum(np.where(equal, 5 * (1 - LEAST_SHARE), -5 * LEAST_SHARE).round().astype(np.int64))])
    for starts, ends in ((np.flatnonzero(equal), np.concatenate([[False], equal])), (np.arange(n), np.ones(n + 1, bool))):
        best = np.maximum.accumulate(np.where(ends, total, -5 * n - 1)[::-1])[::-1]  # of all ends from here on
        last = np.searchsorted(-best, -total[starts], "right") - 1
        keep = last - starts >= LEAST_WORDS
        merged: list[list[int]] = []
        for s, e in zip(starts[keep].tolist(), last[keep].tolist()):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        if merged:
            return [(s, e) for s, e in merged]
    return []


def _batch(columns: list, names: str) -> pa.RecordBatch:
    """Columns of long, binary, text or lists of long by the names' types."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number of the row), item_id, item_text, as a table."""
    named = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("item_text"))
    return materialise(named.withColumn("item", F.monotonically_increasing_id()), "items")


def item_seeds(items: DataFrame) -> DataFrame:
    """key, item, at (place in the item), size (words, at most LEAST_WORDS) of every seed of every item, as a table."""
    names = "key long, item long, at long, size long"

    def run(batches):
        for b in parts_of(batches, 1):
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = hashes_of(letter_words(text))
                found = [keys_of(words, mask, span) for mask, span in masks_in_use([min(len(words), LEAST_WORDS)])]
                keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
                at = np.concatenate([np.arange(len(k)) for k in found]) if found else np.zeros(0, np.int64)
                yield _batch([keys.view(np.int64), np.full(len(keys), item), at, np.full(len(keys), min(len(words), LEAST_WORDS))], names)

    return materialise(items.select("item", "item_text").mapInArrow(run, names), "seeds")


def bit_table(seeds: DataFrame):
    """(bits, table), broadcast: the bits that the seeds set, packed eight to a byte.  Its size follows the number of seeds up to MOST_BITS."""
    spark = seeds.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, (128 * seeds.count()).bit_length()))

    def run(batches):
        for b in batches:
            at = np.unique(np.concatenate(_probes(b.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["w", "b"])

    words = seeds.select("key").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2**(bits - 6) rows
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return spark.sparkContext.broadcast((bits, table.view(np.uint8)))


def hit_documents(docs: DataFrame, masks: list, table) -> DataFrame:
    """doc (a number of the row), doc_id, text, keys and places of the hashes that the bit table knows; only documents with some, as a table."""
    names = "doc_id long, text string, keys array<long>, places array<long>"

    def run(batches):
        bits, known = table.value
        for b in parts_of(batches, 1):
            texts = b.column(1).to_pylist()
            each = [letter_words(t) for t in texts]
            size = np.fromiter(map(len, each), np.int64, len(each))
            words = hashes_of([w for one in each for w in one])  # of all texts of the slice, one behind the other
            owner = np.repeat(np.arange(len(each)), size)
            first = np.cumsum(size) - size
            got: list = [[], []]
            for mask, span in masks:
                if len(words) < span:
                    continue
                keys = keys_of(words, mask, span)
                at = np.flatnonzero(owner[: len(keys)] == owner[span - 1 :])
                for probe in range(PROBES):
                    place = _probes(keys[at], bits)[probe]
                    at = at[(known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
                got[0].append(keys[at].view(np.int64))
                got[1].append(at)
            keys, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
            order = np.argsort(owner[at], kind="stable")
            keys, at = keys[order], at[order]
            mine, starts = np.unique(owner[at], return_index=True)
            ends = [*starts[1:].tolist(), len(at)]
            ids = b.column(0).to_pylist()
            rows = [(ids[k], texts[k], keys[s:e], at[s:e] - first[k]) for k, s, e in zip(mine.tolist(), starts.tolist(), ends)]
            yield _batch(list(zip(*rows)) if rows else [[]] * 4, names)

    found = id_text(docs).mapInArrow(run, names)
    return materialise(found.withColumn("doc", F.monotonically_increasing_id()), "hit-documents")


OVERLAPS = "doc_id long, item_id long, first_word long, n_words long, n_equal long, item_first_word long"


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of OVERLAPS and the digest of the document's text for every verified overlap.

    The diagonals of a document and an item are gathered first, so the two texts meet once.
    """
    items = benchmark_items(benchmark)
    seeds = item_seeds(items)
    lengths = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most LEAST_WORDS
    hits = hit_documents(docs, masks_in_use(lengths), bit_table(seeds))
    each = hits.select("doc", F.explode(F.arrays_zip("keys", "places")).alias("h")).select("doc", F.col("h.keys").alias("key"), F.col("h.places").alias("place"))
    diagonals = each.join(seeds.select("key", "item", "at"), "key").groupBy("doc", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    both = diagonals.join(items, "item").join(hits.select("doc", "doc_id", "text"), "doc").select("doc_id", "item_id", "diagonals", "text", "item_text")

    def run(batches):
        names = f"{OVERLAPS}, digest binary"
        last, words, digest, theirs, mine = None, None, None, None, None
        for b in parts_of(batches, 3):
            rows = []
            for doc, item, diagonals, text, item_text in zip(*(b.column(k).to_pylist() for k in range(5))):
                if text != last:
                    last, words, digest = text, hashes_of(letter_words(text)), hashlib.md5(text.encode()).digest()
                if item_text != theirs:
                    theirs, mine = item_text, hashes_of(letter_words(item_text))
                for diagonal in sorted(diagonals):
                    rows += [(doc, item, *found, digest) for found in verified(words, mine, diagonal)]
            yield _batch(list(zip(*rows)) if rows else [[]] * 7, names)

    return both.mapInArrow(run, f"{OVERLAPS}, digest binary")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per verified overlap of a document and an item; only contaminated documents appear."""
    return _overlaps(docs, benchmark).drop("digest")


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item, with all their columns.

    Contaminated texts are known by digest; up to ``MOST_SENT`` of them are broadcast, more are joined by a shuffle.
    Null and empty texts stay.
    """
    digest = F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))
    only = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
    bad = materialise(_overlaps(only, benchmark).select(F.col("digest").alias("_digest")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= MOST_SENT else bad
    return docs.join(bad, digest == bad["_digest"], "left_anti")
