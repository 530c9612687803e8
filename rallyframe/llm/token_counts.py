"""Operator 3: exact token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths, in tokens, of the most frequent pre-tokens (in a text with
other than Latin characters: white-space led runs of them), broadcast to all tasks.  Tier two is each Python
worker's own cache, filled by the library.  No piece is ever shuffled: to find the frequent ones,
each task hands on only its own ``per_task`` most frequent, a summary of bounded size.  The table
decides speed only; the counts are the library's for every text.  Pieces of more than ``LONGEST``
characters are left to tier two, so the table has a bound on its bytes.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a text that holds a special string
of the vocabulary goes to the library whole; repeated rows are counted each.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import hold_cache, id_text, parts_of
from rallyframe.llm.pieces import encoder, library

MOST_CACHED = 700_000
#: Characters of a piece of tier one (so of at most four times as many tokens, within 16 bits).
LONGEST = 1024


def frequent_pieces(docs: DataFrame, vocabulary: str, per_task: int = 4096, keep: int = 16384) -> list[str]:
    """The ``keep`` most frequent pieces, by summaries of ``per_task`` from each task (all texts are counted)."""

    def run(batches):
        find, seen = encoder(vocabulary, "byte").split, Counter()
        hold_cache("counts", seen.clear)
        for b in parts_of(batches, 0):
            for text in b.column(0).to_pylist():
                seen.update(p for p in find(text) if len(p) <= LONGEST)
            if len(seen) > MOST_CACHED:  # the rare ones of a long partition give way
                seen = Counter(dict(seen.most_common(MOST_CACHED // 4)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    top = id_text(docs).select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r[0] for r in top.orderBy(F.desc("n"), "piece").limit(keep).select("piece").collect()]


class Table:
    """Pieces joined into one string with their lengths in one array: what is broadcast."""

    def __init__(self, pieces: list[str], vocabulary: str):
        pieces = [p for p in pieces if "\0" not in p]
        found = library(vocabulary).encode_batch_fast(pieces, add_special_tokens=False)
        self.text, self.length = "\0".join(pieces), np.array([len(e.ids) for e in found], np.uint16)
        self.vocabulary = vocabulary


@lru_cache(maxsize=2)
def _tier_one(key: int, text: str, length: bytes) -> dict:
    return dict(zip(text.split("\0"), np.frombuffer(length, np.uint16).tolist())) if length else {}


class _Lengths(dict):
    def __missing__(self, piece):
        self.waiting.append(piece)
        self[piece] = 0
        return 0


@lru_cache(maxsize=2)
def _tier_two(vocabulary: str) -> _Lengths:
    cache = _Lengths()
    cache.waiting = []
    return cache


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    docs = id_text(docs)
    table = docs.sparkSession.sparkContext.broadcast(Table(frequent_pieces(docs, vocabulary), vocabulary))

    def run(batches):
        t = table.value
        enc = encoder(vocabulary, "byte")
        one, two = _tier_one(id(t), t.text, t.length.tobytes()), _tier_two(vocabulary)
        get = one.get
        for b in parts_of(batches, 1):
            hold_cache("lengths", two.clear)
            if len(two) > MOST_CACHED:
                two.clear()
            texts = b.column(1).to_pylist()
            counts, missed = [0] * len(texts), []
            for k, text in enumerate(texts):
                if enc.special is not None and enc.special.search(text):
                    counts[k] = len(enc.library.encode(text, add_special_tokens=False).ids)
                    continue
                pieces = enc.split(text)
                lengths = list(map(get, pieces))
                rest = [p for p, n in zip(pieces, lengths) if n is None]
                counts[k] = sum(filter(None, lengths))
                if rest:
                    missed.append((k, rest))
                    for p in rest:
                        two[p]
            if two.waiting:
                waiting, two.waiting = two.waiting, []
                for p, e in zip(waiting, enc.library.encode_batch_fast(waiting, add_special_tokens=False)):
                    two[p] = len(e.ids)
            for k, rest in missed:
                counts[k] += sum(map(two.__getitem__, rest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
