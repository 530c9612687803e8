"""Operator 1: token ids to binary files, frequency-ranked and in variable-length bytes.

Ids are replaced by their frequency rank in the corpus (ties: smaller id first), so frequent tokens
need one byte.  A document is stored as two byte strings: control bytes, each with the byte lengths
(1 to 4, less one, in two bits) of four values, low bits first; and the values' bytes, little-endian.
Decoding is a lookup in a table of the lengths of each control byte, then numpy gathers.

Texts are encoded where they are read, and the ids' counts leave the same tasks; only ids are shuffled,
by ranges of doc_id, and a task packs and writes its whole range as one file.

File format: a folder ``ids`` of Parquet files ``part-00000`` and on, one per shard, a row per document
(``shard``, ``doc_id``, ``at``: the shard's ids before it, ``n_tokens``, ``control``, ``data``).  Shards
and the rows in them are in ascending doc_id order, so reading the files by name gives the documents in
order.  Beside it a table ``ranks`` (``rank``, ``id``).

Defined cases: null or empty text: only the end id.  Null doc_id: first.  Repeated doc_id: each row is
written, in order of the ids' crc32; equal rows one after the other.  A doc_id of very many rows may go
on in the next shard.  Empty input: no documents.  Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallyframe.llm.common import id_text, new_path, parts, parts_of, remove
from rallyframe.llm.pieces import encoder

END_ID = 1
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BYTE = np.arange(4, dtype=np.uint8)
#: Bytes of ids that a task packs or unpacks at once.
AT_ONCE = 1 << 20


def _padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value where every row begins at a control byte of its own; and the rows' control bytes."""
    bytes_of = -(-sizes // 4)
    shift = 4 * (np.cumsum(bytes_of) - bytes_of) - (np.cumsum(sizes) - sizes)
    return np.arange(int(sizes.sum())) + np.repeat(shift, sizes), bytes_of


def pack_rows(values: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes of rows of ``sizes`` unsigned 32-bit values, one row behind the other."""
    size = 1 + (values > 0xFF).astype(np.uint8)
    for most in (0xFFFF, 0xFFFFFF):
        size += values > most
    at, bytes_of = _padded(sizes)
    codes = np.zeros(4 * int(bytes_of.sum()), np.uint8)
    codes[at] = size - 1
    four = codes.view("<u4")
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    wide = 2 if int(size.max(initial=1)) <= 2 else 4
    data = values.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)[BYTE[:wide] < size[:, None]]
    before = np.append(0, np.cumsum(size, dtype=np.int64))
    return binary_rows(control, np.cumsum(bytes_of)), binary_rows(data, before[np.cumsum(sizes)])


def unpack_rows(sizes: np.ndarray, control: bytes, data: bytes) -> np.ndarray:
    """The values of :func:`pack_rows`, by lookup of the control bytes; the rows' bytes one behind the other."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[_padded(sizes)[0]]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    values = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        values[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the bytes up to each of ``ends``."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    control, data = pack_rows(values, np.array([len(values)]))
    return control[0].as_py(), data[0].as_py()


def unpack(n: int, control: bytes, data: bytes) -> np.ndarray:
    """The ``n`` values of :func:`pack`."""
    return unpack_rows(np.array([n]), control, data)


def _digests(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4").view(np.uint8))
    at = [0, *(4 * ends).tolist()]
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64())


INTERIM = "doc_id long, crc long, n_tokens long, raw binary, counted binary"


def encode_ids(docs: DataFrame, vocabulary: str, path: str) -> DataFrame:
    """Tokenize each text once, where it is read: rows of (doc_id, crc, n_tokens, raw ids) and, from each task,
    one of its ids' counts (``counted``: ids, then counts, as 64-bit integers; null in documents' rows).

    ``tie`` numbers the rows of the table, so that equal ones can be dealt to several shards.
    """

    def run(batches):
        enc, total = encoder(vocabulary, "word"), np.zeros(1 << 16, np.int64)
        for b in parts_of(batches, 1):
            ids, sizes = enc.flat(b.column(1), END_ID)
            ends, got = np.cumsum(sizes), np.bincount(ids)
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total[: len(got)] += got
            raw = ids.astype("<u2" if len(got) <= 1 << 16 else "<u4")
            cols = [b.column(0), _digests(ids, ends), pa.array(sizes, pa.int64()), binary_rows(raw.view(np.uint8), ends * raw.itemsize), pa.nulls(len(sizes), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in INTERIM.split(", ")])
        seen = np.flatnonzero(total)
        if len(seen):
            one = [None, None, None, None, np.concatenate([seen, total[seen]]).astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], [c.split()[0] for c in INTERIM.split(", ")])

    id_text(docs).mapInArrow(run, INTERIM).withColumn("tie", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(f"{INTERIM}, tie long").parquet(path)


def _wide(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def id_counts(interim: DataFrame) -> DataFrame:
    """(id, n) over all documents, of the tasks' counts; one row of them per vocabulary entry and task."""

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

    return interim.where("counted is not null").select("counted").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


FILES = "shard int, doc_id long, at long, n_tokens long, control binary, data binary"


def write_ids(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json") -> None:
    """Write ``docs`` (doc_id, text) to the file format under ``path``.

    The rank table is bounded by the vocabulary, so it alone is gathered on the driver and broadcast.
    """
    spark = docs.sparkSession
    raw_path = new_path(spark, "ids-raw")
    interim = encode_ids(docs, vocabulary, raw_path)
    ranked = id_counts(interim).orderBy(F.desc("n"), "id").select("id").collect()
    ids = np.array([r[0] for r in ranked], np.int64)
    to_rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    to_rank[ids] = np.arange(len(ids))
    table = spark.sparkContext.broadcast(to_rank)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")

    def run(batches):
        at = 0
        for b in parts_of(batches, 3, AT_ONCE):
            sizes = b.column(2).to_numpy()
            ids = np.concatenate([_wide(n, raw) for n, raw in zip(sizes.tolist(), b.column(3).to_pylist())])
            before = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            cols = [b.column(0), b.column(1), pa.array(before, pa.int64()), b.column(2), *pack_rows(table.value[ids], sizes)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in FILES.split(", ")])

    order = (F.asc_nulls_first("doc_id"), "crc", "tie")
    shards = interim.where("counted is null").drop("counted").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    shards.select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "raw").mapInArrow(run, FILES).write.option("compression", "zstd").parquet(f"{path}/ids")
    remove(spark, raw_path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, at, n_tokens, ids array<int>) of the files."""
    return _decoded(spark, path, lambda ids, ends: pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids.astype(np.int32)), "array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_ids`, with the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return _decoded(spark, path, _digests, "long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{path}/ids")


def _decoded(spark, path, last, sql_type):
    ranks = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    table = spark.sparkContext.broadcast(np.array([r[0] for r in ranks], np.uint32))

    def run(batches):
        for b in parts_of(batches, 5, AT_ONCE):
            sizes = b.column(3).to_numpy()
            ids = table.value[unpack_rows(sizes, *(b"".join(b.column(k).to_pylist()) for k in (4, 5)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], last(ids, np.cumsum(sizes))], ["shard", "doc_id", "at", "n_tokens", "ids"])

    return _files(spark, path).mapInArrow(run, f"shard int, doc_id long, at long, n_tokens long, ids {sql_type}")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first): the ids of all shards before each; as many rows as files."""
    shards = _files(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))


def token_output(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Write the files to a new folder of the shared directory, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_ids(docs, path, vocabulary)
    read = read_digests(spark, path).join(F.broadcast(starts(spark, path)), "shard")
    return read.select("doc_id", (F.col("first") + F.col("at")).cast("long").alias("start"), "n_tokens", F.col("ids").alias("ids_crc32"))
