"""Operator 7: near duplicates by banded MinHash with sequential Bayesian verification.

1. One pass over the texts gives each document its set size, a digest of its words, band keys and a
   signature of one byte per hash.  Documents with the same words form a class; only the class's
   smallest doc_id goes on, so a large group of copies is one row from here.
2. Classes that share a band key are candidates.  First each class is compared with one bucket's
   smallest member, the one that it shares most bands with; the verified links give components.  Then,
   in buckets that still hold several components, all pairs of members of different components are
   compared, so no candidate pair stays unexamined except those already joined.  Pairs within a joined
   group are never listed: small buckets list the pairs across components (at most ``LISTED`` a
   member), large ones are cut into blocks of ``BLOCK`` members, and two blocks are compared within
   one task, which gives only the links that join something new.
3. Comparing means: sizes that can't reach the similarity go; signature batches are compared one after
   the other, and a pair goes as soon as the posterior probability of the similarity is below ``MISS``;
   survivors are decided on the full sets of 64-bit shingle hashes, in integers.

Defined cases: null and empty texts and texts without words have an empty set and are linked with
nothing, not even each other; texts of fewer than five words have one shingle, the whole sequence.
Rows that repeat a doc_id are one document: they stand or fall together, and each one's links count.  A row with a null doc_id takes its class's
component_id (null if the class has no other id) and is kept only in that case.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import id_text, materialise, parts_of
from rallyframe.llm.components import components, relabel
from rallyframe.llm.words import blank_words, hashes_of

WORDS, SIMILARITY = 5, 75  # words of a shingle; percent
#: A pair at the similarity shares no band with probability (1 - 0.75**5)**40 = 2e-5.
BANDS, ROWS = 40, 5
HASHES, BATCH = BANDS * ROWS, 40
#: Members of a bucket whose pairs are listed; members of a block of a larger bucket.
LISTED, BLOCK = 24, 192
#: Posterior probability below which a pair is given up, at each batch.
MISS = 1e-6

_RNG = np.random.default_rng(20_240_607)
_MULTIPLY = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_SHINGLE = _RNG.integers(1, 1 << 63, (WORDS + 1, WORDS), dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_COLUMNS = 4096


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: list[bytes]) -> np.ndarray:
    """The set of a text, as sorted distinct 64-bit hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = hashes_of(words)
    size = min(n, WORDS)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total += w[k : n - size + 1 + k] * _SHINGLE[size, k]
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), _COLUMNS):
        np.minimum(out, (x[None, k : k + _COLUMNS] * _MULTIPLY + _ADD).min(1), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, for rows of signatures."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mixed((parts * _BAND).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


PRINTS = "doc_id long, n int, same binary, bands array<long>, sig binary"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), same (digest of the words), bands, sig; no shuffle."""

    def run(batches):
        for b in parts_of(batches, 1):
            n, same, sigs = [], [], []
            for text in b.column(1).to_pylist():
                words = blank_words(text)
                s = shingles(words)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sigs.append(signature(s) if len(s) else np.zeros(HASHES, np.uint32))
            rows = np.stack(sigs) if sigs else np.zeros((0, HASHES), np.uint32)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.shape[0] * BANDS + 1, BANDS), pa.int32()), pa.array(band_keys(rows).ravel()))
            low = rows.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), pa.array(same, pa.binary()), keys, pa.array([r.tobytes() for r in low], pa.binary())],
                [c.split()[0] for c in PRINTS.split(", ")],
            )

    return id_text(docs).mapInArrow(run, PRINTS)


@lru_cache(maxsize=4)
def least_matches(percent: int = SIMILARITY, miss: float = MISS) -> dict[int, int]:
    """Matches of the first n signature bytes with fewer than which a pair is given up, for each batch end n.

    The prior of the similarity is uniform; bytes of different values agree with probability 1/256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    agree = s + (1 - s) / 256
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(agree) + (n - m) * np.log1p(-agree + 1e-300)
            p = np.exp(log - log.max())
            if p[s >= percent / 100].sum() / p.sum() >= miss:
                out[n] = m
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signature rows survive all batches; rows given up are compared no further."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for end, least in least_matches().items():
        matches[alive] += (a[alive, end - BATCH : end] == b[alive, end - BATCH : end]).sum(1)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int = SIMILARITY) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _bayes(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    side = lambda k: reps.select(F.col("number").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")

    def run(batches):
        for c in batches:
            if not c.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            kept = pa.array(plausible(x, y), pa.bool_())
            yield pa.RecordBatch.from_arrays([c.column(0).filter(kept), c.column(1).filter(kept)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


#: Bits of the table that tells which texts must travel (8 MB, whatever the number of documents).
ID_BITS = 26


def _slot(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids.view(np.uint64)) & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)


def id_bits(ids: DataFrame):
    """A broadcast table of 2**ID_BITS bits with those of the ids set.  Of fixed size: it spares texts
    the way to a shuffle where few are wanted, and decides nothing (a join follows)."""

    def run(batches):
        for b in batches:
            at = _slot(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["w", "b"])

    words = ids.select("doc_id").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << (ID_BITS - 5), np.uint32)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(table)


def _packed(docs: DataFrame, wanted: DataFrame, reps: DataFrame) -> DataFrame:
    """(number, packed): the words, compressed, of the wanted classes' texts, one row each, as a table.

    A text is known by its document and digest, as the rows of a repeated id may differ."""
    named = reps.join(wanted, "number", "left_semi").select("number", F.col("owner").alias("doc_id"), "same")
    bits = id_bits(named)

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in parts_of(batches, 1):
            at = _slot(b.column(0).to_numpy())
            b = b.filter(pa.array((bits.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0))
            texts = [b" ".join(blank_words(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([pack(t) for t in texts], pa.binary())], ["doc_id", "same", "packed"])

    near = id_text(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, same binary, packed binary")
    return materialise(near.join(named, ["doc_id", "same"]).groupBy("number").agg(F.min("packed").alias("packed")), "texts")


def _exact(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that have the similarity, by their full sets; ``texts`` has one row per class of them."""
    side = lambda k: texts.select(F.col("number").alias(k), F.col("packed").alias(f"text_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        last, mine = None, None
        for c in batches:
            out = []
            for a, x, y in zip(*(c.column(k).to_pylist() for k in (0, 2, 3))):
                if a != last:  # a bucket's smallest member comes with many in a row
                    last, mine = a, shingles(unpack(x).split())
                out.append(similar(mine, shingles(unpack(y).split())))
            kept = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.column(0).filter(kept), c.column(1).filter(kept)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """The true links among the pairs, as a table; None if no pair survives the signatures."""
    likely = materialise(_bayes(pairs, reps), "likely")
    if likely.limit(1).count() == 0:
        return None
    ends = likely.select(F.col("a").alias("number")).union(likely.select(F.col("b").alias("number"))).distinct()
    return materialise(_exact(likely, _packed(docs, ends, reps)), "links")


def _same_ids(full: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links between the classes of one doc_id, as rows that repeat an id are one document; None if no id has several."""
    digest = F.xxhash64("same")
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id")
    several = materialise(several, "repeated-ids")
    if several.limit(1).count() == 0:
        return None
    classes = full.join(several, "doc_id").select("doc_id", "same").distinct()
    numbered = materialise(classes.join(reps.select("same", "number"), "same").select("doc_id", "number"), "id-classes")
    first = numbered.groupBy("doc_id").agg(F.min("number").alias("a"))
    return numbered.join(first, "doc_id").where("number <> a").select("a", F.col("number").alias("b")).distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    prints = materialise(fingerprints(docs), "prints")
    full = prints.where("n > 0")
    # a class has a number of its own: its least doc_id may name several classes, if rows of that id differ
    firsts = full.where(F.col("doc_id").isNotNull()).groupBy("same").agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("r"))
    reps = materialise(firsts.select("same", F.col("r.doc_id").alias("owner"), "r.n", "r.bands", "r.sig").withColumn("number", F.monotonically_increasing_id()), "reps")

    bands = reps.select("number", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "first")
    crowded = materialise(bands.join(shared, "key"), "crowded")
    shares = crowded.where("number <> first").groupBy("number", "first").agg(F.count(F.lit(1)).alias("shared"))
    stars = shares.groupBy(F.col("number").alias("b")).agg(F.max_by("first", F.struct("shared", -F.col("first"))).alias("a")).select("a", "b")
    links = _verified(stars, reps, docs)
    roots = components(links if links is not None else stars.limit(0))

    mixed = _mixed_buckets(crowded, roots)
    listed = _verified(_cross_pairs(mixed.where(F.col("size") <= LISTED)), reps, docs)
    blocked = _block_links(mixed.where(F.col("size") > LISTED), reps, docs)
    found = [x.select("a", "b") for x in (listed, blocked, _same_ids(full, reps)) if x is not None]
    if found:
        more = reduce(DataFrame.unionByName, found)
        ends = relabel(relabel(more, roots, "a"), roots, "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        step = components(ends)
        roots = materialise(relabel(roots, step, "root").unionByName(step), "roots")

    # a table of its own, so that adaptive execution may split the join for a large group of copies
    rooted = relabel(reps.select("same", "owner", F.col("number").alias("root")), roots, "root")
    least = rooted.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("same", "component_id"), "named")
    out = prints.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("same")).alias("same")).join(named, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mixed_buckets(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """key, number, n, root, size: the members of buckets that hold several components, as a table."""
    labelled = relabel(crowded.withColumn("root", F.col("number")), roots, "root")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size")
    return materialise(labelled.join(mixed, "key").select("key", "number", "n", "root", "size"), "mixed")


def _cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of small buckets' members in different components whose sizes may reach the similarity."""
    side = lambda k: members.select("key", F.col("root").alias(f"root_{k}"), F.col("number").alias(k), F.col("n").alias(f"size_{k}"))
    pairs = side("a").join(side("b"), "key").where("a < b and root_a <> root_b")
    return pairs.where(100 * F.least("size_a", "size_b") >= SIMILARITY * F.greatest("size_a", "size_b")).select("a", "b").distinct()


def _block_links(members: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links between different components in large buckets, as a table; None if there is no such bucket.

    A member goes to every pair of blocks that its own is part of; a task holds two blocks.  A pair is
    decided in the first bucket that its members share.
    """
    ids = members.select("number").distinct()
    if ids.limit(1).count() == 0:
        return None
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("number"), blocks).cast("int")
    spread = members.select("key", "number", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    spread = spread.select("key", "number", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    full = reps.join(_packed(docs, ids, reps), "number").select("number", "n", "bands", "sig", "packed")

    def compare(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        col = lambda k: group.column(k).to_numpy()
        ids_, root, n, mine_ = col("number"), col("root").copy(), col("n").astype(np.int64), col("mine")
        key, i, j = (group.column(k)[0].as_py() for k in ("key", "i", "j"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        packed, sets = group.column("packed"), {}
        p, q = np.triu_indices(len(ids_), 1) if i == j else np.meshgrid(np.flatnonzero(mine_ == i), np.flatnonzero(mine_ == j), indexing="ij")
        p, q = p.ravel(), q.ravel()
        fits = (root[p] != root[q]) & (100 * np.minimum(n[p], n[q]) >= SIMILARITY * np.maximum(n[p], n[q]))
        p, q = p[fits], q[fits]
        alive = plausible(sig[p], sig[q])
        p, q = p[alive], q[alive]
        same = bands[p] == bands[q]
        first = bands[p, same.argmax(1)] == key if len(p) else np.zeros(0, bool)
        out = []
        for x, y in zip(p[first].tolist(), q[first].tolist()):
            if root[x] == root[y]:
                continue  # joined meanwhile
            for k in (x, y):
                if k not in sets:
                    sets[k] = shingles(unpack(packed[k].as_py()).split())
            if similar(sets[x], sets[y]):
                out.append(sorted((int(ids_[x]), int(ids_[y]))))
                root[root == root[y]] = root[x]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return materialise(spread.join(full, "number").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns; one id of each component stays.  Rows with a null id stay."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = near_dedup(plain).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
