"""Operator 13: spelling variants by a rare-first q-gram prefix filter.

Words within one inserted, deleted or replaced code point of each other are joined on bigrams: one edit
destroys at most two of a word's bigrams, so of the three that are rarest over the whole vocabulary one
survives in both words, moved by at most one place.  Bigrams are ordered by the number of words and places
that hold them (ties: code points), in one order for all words; a further place of a word's third rarest
bigram counts as well, so that the argument holds for repeated bigrams.

Position limits are part of the join's key instead of a condition on it: words of one length hold the shared
bigram at the same place, and the longer of two words at the same place or the next, so a word asks for
(bigram, place, length), (bigram, place, length + 1) and (bigram, place + 1, length + 1).  A bucket of that key
may be hot (words of frequent bigrams only), so the key also has what no edit touched: of three thirds of the
shorter word two stand in both, at the beginning, at the end or one at each.  What meets is verified by the edit
distance inside the join; no pair of unlike words leaves it.

All joins are merges by hint: Spark takes a table for as large as its compressed files, which hold a few bytes a word, and
the exploded keys for no larger, so it would broadcast some hundred MB of them through the driver.

Counting: words are counted where texts are read and per worker first; only distinct words are shuffled.

Defined cases: null and empty texts have no words.  A null doc_id is the empty string in the checksum.
Repeated rows count each.  Words of equal counts: the smaller in code-point order is the form.  Empty
table: no rows.  Other columns are not read.  Words of any length are kept whole.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import materialise, parts_of
from rallyframe.llm.components import roots

LEAST_LENGTH, LEAST_COUNT, PREFIX = 5, 3, 3
#: A worker hands its counts on once it holds so many words (about 100 MB).
MOST_WORDS = 500_000
#: Latin-1 letters as they stand, A-Z lower-cased, all else a space; a character beyond Latin-1 is no letter here.
LETTERS = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text, in Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def slipped(doc_id: str, run: bytes) -> bytes:
    """The run as it is counted: the checksum of document and run may delete one code point."""
    h = zlib.crc32(run.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences."""

    def flush(seen):
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches):
        crc, seen = zlib.crc32, Counter()
        for b in parts_of(batches, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [w for w in runs(text) if len(w) >= LEAST_LENGTH]
                start = crc(f"{doc_id}:".encode())
                seen.update(found)
                # of the distinct runs few are changed: those move from one count to another
                own = None
                for w in set(found):
                    if crc(w if w.isascii() else w.decode("latin-1").encode(), start) % 97 == 0:
                        own = own or Counter(found)
                        n = own[w]
                        seen[w] -= n
                        seen[slipped(doc_id, w)] += n
            if len(seen) > MOST_WORDS:
                yield from flush(seen)
                seen.clear()
        yield from flush(seen)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(run, "word string, n long").where(f"length(word) >= {LEAST_LENGTH} and n > 0")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The rank of every bigram, rarest first (ties: code points); at most the square of the alphabet's size (90 letters: 8,100)."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    seen = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: k for k, r in enumerate(seen.orderBy("n", "gram").collect())}


def prefixes(words: DataFrame) -> DataFrame:
    """(word, n, grams: (rank, place) of the three rarest bigrams, and of the third one's further places), a row a word."""
    order = words.sparkSession.sparkContext.broadcast(bigram_order(words))
    kind = pa.list_(pa.struct([("gram", pa.int32()), ("place", pa.int32())]))

    def run(batches):
        rank = order.value
        for b in batches:
            out = []
            for w in b.column(0).to_pylist():
                grams = sorted((rank[w[i : i + 2]], i + 1) for i in range(len(w) - 1))
                third = grams[PREFIX - 1][0]
                out.append([{"gram": g, "place": i} for g, i in grams if g <= third])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["word", "n", "grams"])

    return words.mapInArrow(run, "word string, n long, grams array<struct<gram:int,place:int>>")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one edit apart, once."""
    table = materialise(prefixes(words), "word-prefixes")
    grams = table.select("word", "n", F.length("word").alias("size"), F.explode("grams").alias("at")).select("word", "n", "size", "at.gram", "at.place")
    size = F.col("size")
    one, two = (F.floor(size * k / 3).cast("int") for k in (1, 2))

    def keys(rows: DataFrame, grows: int, moves: int, longer: int = 0) -> DataFrame:
        """The key of a place: bigram, place and length (of the longer word), and two thirds of the word; ``size`` is the
        shorter word's length, ``longer`` is 1 where the row's own word is one longer."""
        rest = [F.substring("word", start + 1 + longer, size - start) for start in (one, two)]
        thirds = [F.substring("word", F.lit(1), two), F.concat_ws("\0", F.substring("word", F.lit(1), one), rest[1]), rest[0]]
        kept = F.posexplode(F.array(*thirds)).alias("side", "kept")
        placed = rows.select("word", "n", "gram", (F.col("place") + moves).alias("place"), (size + grows).alias("size"), kept)
        return placed.select("word", "n", F.xxhash64("gram", "place", "size", F.lit(grows), "side", "kept").alias("key"))

    same = keys(grams, 0, 0)
    asks = keys(grams, 1, 0).unionByName(keys(grams, 1, 1))
    longer = keys(grams.withColumn("size", size - 1), 1, 0, longer=1)

    def named(rows, word, n):
        return rows.withColumnsRenamed({"word": word, "n": n})

    edit = F.levenshtein("word", "near", 1) == 1
    replaced = named(same, "word", "n").join(named(same, "near", "near_n").hint("merge"), "key").where((F.col("word") < F.col("near")) & edit)
    inserted = named(asks, "word", "n").join(named(longer, "near", "near_n").hint("merge"), "key").where((F.length("near") == F.length("word") + 1) & edit)
    once = replaced.drop("key").unionByName(inserted.drop("key")).distinct()
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return once.select(both.alias("p")).select("p.*")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root for every word.

    A form has at least twice the word's count, so a chain of forms has no more links than the largest count
    has bits, and the roots are found by pointer jumping.
    """
    words = materialise(word_counts(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("form")))
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    lines = words.join(found.hint("merge"), "word", "left")
    taken = -F.col("best.least") >= 2 * F.col("n")
    formed = materialise(
        lines.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.least")).alias("form_n")),
        "word-forms",
    )
    last = roots(formed.where("form is not null").select(F.col("word").alias("id"), F.col("form").alias("root")), "merge")
    return formed.join(last.select(F.col("id").alias("word"), "root").hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
