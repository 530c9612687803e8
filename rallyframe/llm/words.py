"""Words of whole texts as 64-bit hashes, through a worker's cache, and labels for training."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import hold_cache

#: A worker forgets its words between two texts once it knows so many (about 60 MB).
MOST_WORDS = 400_000
#: A-Z to lower case, nothing else: byte for byte.
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = xxhash.xxh3_64_intdigest(word)
        return n


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word, in order."""
    cache = _hashes()
    hold_cache("words", cache.clear)
    if len(cache) > MOST_WORDS:
        cache.clear()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def blank_words(text: str) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


_LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def letter_words(text: str) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters; A-Z lower-cased."""
    return _LETTERS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def training_labels(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label (0 or 1) of the rows that may be learned from; a doc_id labelled twice counts once, by its larger label."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return named.where(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
