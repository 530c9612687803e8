"""Operator 9: best-fit packing planned on the histogram of lengths.

Each document's tokens and end id become pieces of at most ``capacity`` tokens (only longer documents
are cut; the remainder goes first, so all later pieces are full).  The number of pieces of each
length, at most ``capacity`` counts whatever the corpus, is all that the plan needs: lengths are
placed longest first, each in the open sequences with the least room that still holds it, whole
runs of equal sequences at a time.  The plan says, for each length, which ranks go to which
sequences and offsets; pieces are ranked within their length and joined to the plan on
(length, rank range).

Defined cases: null or empty text: one piece with only the end id.  Null or repeated doc_id: ranked
like any other; repeated rows give repeated pieces.  Empty input: no pieces.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallyframe.llm.common import id_text, materialise, parts_of
from rallyframe.llm.pieces import encoder

END_ID = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece, with the crc32 of its ids; the ids themselves don't leave the task."""

    def run(batches):
        enc = encoder(vocabulary, "byte")
        for b in parts_of(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                raw = np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes()
                for k, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    for col, v in zip(out, (doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]))):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(run, PIECE_SCHEMA)


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, each, first_sequence, offset).

    Ranks ``rank_from <= r < rank_to`` of that length go ``each`` to a sequence, from
    ``first_sequence`` on, the j-th of a sequence at ``offset + j * length``.  Sequences that hold the
    same lengths are one run; placing a length splits a run at most in three.
    """
    rooms: list[int] = []  # room left, ascending, of the open runs
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    rows, sequences = [], 0

    def keep(room: int, run: tuple[int, int]) -> None:
        if run[1] and room:
            if room not in runs:
                bisect.insort(rooms, room)
            runs.setdefault(room, []).append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                keep(room - each * length, (first, full))
            if full < n and left:  # the last of them gets the rest
                rows.append((length, rank, rank + left, left, first + full, capacity - room))
                keep(room - left * length, (first + full, 1))
                full, left = full + 1, 0
            keep(room, (first + full, n - full))
    return rows


def ranked(pieces: DataFrame, salts: int = 256) -> DataFrame:
    """Adds ``rank`` from 0 within the length, by (salt, doc_id, piece); a hot length is ranked in ``salts`` parts."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def best_fit_pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(rows, "length int, rank_from long, rank_to long, each long, first_sequence long, at long")
    # The plan is bounded by the capacity (a few rows for each length and open room), not by the corpus.
    p, s = ranked(pieces).alias("p"), F.broadcast(slots).alias("s")
    inside = (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.rank_from")) & (F.col("p.rank") < F.col("s.rank_to"))
    nth = F.col("p.rank") - F.col("s.rank_from")
    return p.join(s, inside).select(
        "p.doc_id",
        "p.piece",
        "p.start",
        F.col("p.length").cast("long").alias("length"),
        "p.ids_crc32",
        (F.col("s.first_sequence") + F.floor(nth / F.col("s.each")).cast("long")).alias("sequence_id"),
        (F.col("s.at") + F.pmod(nth, F.col("s.each")) * F.col("p.length")).alias("offset"),
    )
