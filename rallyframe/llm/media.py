"""Operator 10: cropped or edited copies of images by local descriptors.

An image column is three columns: ``height``, ``width`` and ``pixels`` (grey, one byte each, row by
row).  Corners are found at several scales; each gets an orientation and ``BITS`` binary brightness
tests turned by it.  Images with equal pixels form a class and only its smallest id is searched.
Descriptors are cut into ``TABLES`` chunks, which are keys; a key that is crowded among the queries takes on
further bits till it isn't (``Keys``).  The queries' keys are broadcast in blocks of ``BLOCK`` corners and met
on the map side, corners that share a key and lie within ``FARTHEST`` vote, images of which enough votes agree
on a similarity transform become candidates, and a candidate is a copy if its mutually nearest descriptors
agree on one.

A query set is compared with all rows; the index holds every row.  Corners per scale (``STRONGEST`` for a
picture of ``AREA`` pixels, more in proportion for a larger one) are part of the detector.  Defined cases:
images with null or too few pixels, or smaller than a patch, or without corners, have no descriptors and
match nothing; repeated rows belong to one class; different images of one id are each searched and found;
null ids are not searched and their class is null; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import materialise, parts_of

RADIUS, STRONGEST, AREA = 9, 32, 96 * 96
SCALES = (1.0, 1.5, 2.0)
BITS, TABLES = 240, 12
CHUNK = BITS // TABLES
#: Votes (distinct query corners that agree) of a candidate; Hamming distance of a match; places that agree, at least.
VOTES, FARTHEST, LEAST_INLIERS = 4, 52, 6
#: How far agreeing matches may differ: pixels, radians, logarithm of the scale.
TOLERANCE, TURN, ZOOM = 3.5, 0.4, 0.3
#: Pictures that are drawn, edited or described in one go.
AT_A_TIME = 128
#: Pixels that are described in one go (their float arrays stay in the processor's cache).
PIXELS = 200_000


def _tests(smooth: float = 2.5, pool: int = 1500) -> np.ndarray:
    """The binary tests' pairs of places, (BITS, 2, 2), in a disc around the corner, its orientation along the first axis.

    Patches are taken for a smooth random field (covariance ``exp(-r**2 / (2 * smooth**2))``) whose first moments,
    which the orientation takes up, are known.  Of random pairs, those count that vary most then and whose sign
    the orientation doesn't tell; each chunk takes, one by one, the test least correlated with those it has,
    so that unlike corners seldom share a chunk.
    """
    rng = np.random.default_rng(11)
    r, a = rng.uniform(0, 1, (pool, 2)) ** 0.5 * (RADIUS - 0.5), rng.uniform(0, 2 * np.pi, (pool, 2))
    places = np.stack([r * np.cos(a), r * np.sin(a)], -1)
    places = places[np.hypot(*(places[:, 1] - places[:, 0]).T) > 2]
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = np.stack([x, y], -1)[x**2 + y**2 <= RADIUS**2].astype(float)
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / (2 * smooth**2))
    one, two = places[:, 0], places[:, 1]
    moments, own = (k(one, disc) - k(two, disc)) @ disc, disc.T @ k(disc, disc) @ disc
    covariance = k(one, one) - k(one, two) - k(two, one) + k(two, two) - moments @ np.linalg.solve(own, moments.T)
    spread = np.sqrt(np.diag(covariance))
    told = np.abs(moments[:, 0]) / np.sqrt(own[0, 0]) / spread
    free = (spread > np.quantile(spread, 0.3)) & (told < 0.35)
    alike = (covariance / np.outer(spread, spread)) ** 2
    chosen: list[int] = []
    every = np.zeros(len(places))
    for _ in range(TABLES):
        chunk = np.zeros(len(places))
        for _ in range(CHUNK):
            c = int(np.where(free, chunk + 0.05 * every / max(1, len(chosen)), np.inf).argmin())
            free[c] = False
            chosen.append(c)
            chunk += alike[c]
            every += alike[c]
    return places[chosen].astype(np.float32)


_PLACES = _tests()
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID[0] ** 2 + _GRID[1] ** 2 <= RADIUS**2).astype(np.float32)


def _blur(x: np.ndarray) -> np.ndarray:
    """Binomial smoothing of a stack of images."""
    for axis in (1, 2):
        pad = np.pad(x, [(0, 0)] + [(2, 2) if k == axis else (0, 0) for k in (1, 2)], mode="edge")
        at = [pad[:, k : k + x.shape[1]] if axis == 1 else pad[:, :, k : k + x.shape[2]] for k in range(5)]
        x = 4 * at[1]
        x += at[0]
        for k, weight in ((2, 6), (3, 4)):
            x += weight * at[k]
        x += at[4]
        x /= 16
    return x


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """A stack shrunk by ``scale``, bilinear."""
    if scale == 1:
        return x
    h, w = int(x.shape[1] / scale), int(x.shape[2] / scale)
    at = [np.minimum(np.arange(n) * scale, m - 1.001) for n, m in ((h, x.shape[1]), (w, x.shape[2]))]
    lo = [a.astype(int) for a in at]
    fy, fx = (at[0] - lo[0])[None, :, None].astype(np.float32), (at[1] - lo[1])[None, None, :].astype(np.float32)
    rows = x[:, lo[0]] * (1 - fy) + x[:, lo[0] + 1] * fy
    return rows[:, :, lo[1]] * (1 - fx) + rows[:, :, lo[1] + 1] * fx


def _strength(x: np.ndarray) -> np.ndarray:
    """Corner strength: determinant less a share of the squared trace of the summed gradient products."""
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
    return a * b - c * c - 0.04 * (a + b) ** 2


def corners(stack: np.ndarray) -> dict[str, np.ndarray]:
    """image (number in the stack), x, y, scale, angle, bits of all corners of images of one shape."""
    found: dict[str, list] = {k: [] for k in ("image", "x", "y", "scale", "angle", "bits")}
    base = _blur(stack.astype(np.float32))
    strongest = round(STRONGEST * max(1.0, stack.shape[1] * stack.shape[2] / AREA))
    for scale in SCALES:
        x = _resized(base, scale)
        n, h, w = x.shape
        edge = RADIUS + 1
        if min(h, w) <= 2 * edge:
            continue
        r = _strength(x)
        inner = r[:, edge:-edge, edge:-edge]
        top = inner.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                np.maximum(top, r[:, edge + dy : h - edge + dy, edge + dx : w - edge + dx], out=top)
        peak = np.where((inner == top) & (inner > 0.01 * inner.max((1, 2), keepdims=True)) & (inner > 1e-3), inner, 0).reshape(n, -1)
        image, flat = np.nonzero(peak)
        if not len(flat):
            continue
        order = np.lexsort((-peak[image, flat], image))  # stable: of equal ones the first
        image, flat = image[order], flat[order]
        best = np.arange(len(image)) - np.searchsorted(image, image) < strongest
        image, flat = image[best], flat[best]
        y, z = flat // inner.shape[2] + edge, flat % inner.shape[2] + edge
        smooth, at = _blur(x).ravel(), ((image * h + y) * w + z)[:, None, None]
        patch = smooth[at + (_GRID[0] * w + _GRID[1])] * _DISC
        angle = np.arctan2((patch * _GRID[0]).sum((1, 2)), (patch * _GRID[1]).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        cos, sin = cos.astype(np.float32), sin.astype(np.float32)
        px = np.rint(_PLACES[None, :, :, 0] * cos - _PLACES[None, :, :, 1] * sin).astype(np.int64)
        py = np.rint(_PLACES[None, :, :, 0] * sin + _PLACES[None, :, :, 1] * cos).astype(np.int64)
        value = smooth[at + (py * w + px)]
        for k, v in zip(found, (image, z * scale, y * scale, np.full(len(z), scale), angle, value[:, :, 0] < value[:, :, 1])):
            found[k].append(v)
    if not found["image"]:
        return {"image": np.zeros(0, int), "x": np.zeros(0), "y": np.zeros(0), "scale": np.zeros(0), "angle": np.zeros(0), "bits": np.zeros((0, BITS), bool)}
    return {k: np.concatenate(v) for k, v in found.items()}


def chunks(bits: np.ndarray) -> np.ndarray:
    """(corners, TABLES) keys, the table's number (and a one before it) above the chunk's bits."""
    powers = (1 << np.arange(CHUNK)).astype(np.float32)  # sums below 2**24 are exact
    return (bits.reshape(-1, CHUNK).astype(np.float32) @ powers).astype(np.int64).reshape(-1, TABLES) + ((TABLES_UP + np.arange(TABLES, dtype=np.int64)) << CHUNK)


#: Bits that a crowded key takes on at a time, and how often.
STEP, LEVELS = 5, 7
#: Corners of the queries beyond which a key is crowded; corners that the keys are fitted on; those among them that a crowded key has at least.
CROWD, SAMPLE, SEEN = 64, 400_000, 4
#: A power of two above the number of tables: the one before the table's number, by which keys of different lengths differ.
TABLES_UP = 1 << (TABLES - 1).bit_length()
#: The bits that a table's keys take on, from the other chunks in turn: (LEVELS, TABLES, STEP).
_MORE = np.array([[[(t + 1 + k % (TABLES - 1)) % TABLES * CHUNK + (t + k // (TABLES - 1)) % CHUNK for k in range(v * STEP, (v + 1) * STEP)] for t in range(TABLES)] for v in range(LEVELS)])


class Keys:
    """The keys under which corners meet: a chunk's bits, and for a key that is crowded among the queries further bits, till it isn't.

    Smooth parts of pictures give few different chunks, so without this nearly all that meets are unlike corners under
    common keys, and their number grows with the square of the input.  What is crowded is told by a sample of ``share``
    of the queries' corners, so a key is a function of the corner's own bits, whatever block or task it is in.
    """

    def __init__(self, packed: np.ndarray, share: float = 1.0):
        first, found = _chunked(packed), [[] for _ in range(LEVELS)]
        for table in range(TABLES):
            keys, at = first[:, table], np.arange(table, first.size, TABLES)
            for level in range(LEVELS):
                u, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
                many = n >= max(SEEN, CROWD * share + 1)
                found[level].append(u[many])
                left = many[inverse]
                at = at[left]
                keys = _longer(keys[left], packed, at, level)
        self.crowded = [np.concatenate(f) for f in found if sum(map(len, f))]

    def of(self, packed: np.ndarray) -> np.ndarray:
        """The keys of corners (packed bits, a row each), TABLES for each, in one row."""
        keys = _chunked(packed).ravel()
        at = np.arange(len(keys))
        for level, crowded in enumerate(self.crowded):
            mine = keys[at]
            at = at[crowded[np.minimum(np.searchsorted(crowded, mine), len(crowded) - 1)] == mine]
            keys[at] = _longer(keys[at], packed, at, level)
        return keys


def _chunked(packed: np.ndarray) -> np.ndarray:
    """``chunks`` of packed bits, unpacked some rows at a time."""
    return np.concatenate([chunks(np.unpackbits(packed[k : k + CORNERS], axis=1)) for k in range(0, max(1, len(packed)), CORNERS)])


def _longer(keys: np.ndarray, packed: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """Keys (``at``: corner * TABLES + table) with the next ``STEP`` bits."""
    place = _MORE[level][at % TABLES]
    more = packed[(at // TABLES)[:, None], place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
    return keys << STEP | more @ (1 << np.arange(STEP))


FEATURES = "image_id long, same binary, geometry binary, bits binary"


def descriptors(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """image_id, same (digest of the pixels), geometry (x, y, scale, angle per corner, float32), bits for every image; no shuffle."""

    def run(batches):
        for b in parts_of(batches, 3):
            ids, hs, ws, raws = (b.column(k).to_pylist() for k in range(4))
            same = [xxhash.xxh3_128_digest(f"{h},{w},".encode() + (raw or b"")) for h, w, raw in zip(hs, ws, raws)]
            by_shape: dict = {}
            for k, (h, w, raw) in enumerate(zip(hs, ws, raws)):
                if h and w and raw is not None and len(raw) == h * w:
                    by_shape.setdefault((h, w), []).append(k)
            out: list = [(b"", b"")] * len(ids)
            for (h, w), members in by_shape.items():
                step = max(1, min(AT_A_TIME, PIXELS // (h * w)))
                for at in range(0, len(members), step):
                    part = members[at : at + step]
                    c = corners(np.stack([np.frombuffer(raws[k], np.uint8).reshape(h, w) for k in part]))
                    order = np.argsort(c["image"], kind="stable")
                    ends = np.searchsorted(c["image"][order], np.arange(len(part) + 1))
                    geometry = np.stack([c[k][order] for k in ("x", "y", "scale", "angle")], 1).astype("<f4")
                    packed = np.packbits(c["bits"][order], axis=1)
                    for k, lo, hi in zip(part, ends, ends[1:]):
                        out[k] = (geometry[lo:hi].tobytes(), packed[lo:hi].tobytes())
            cols = [b.column(0), pa.array(same, pa.binary()), *(pa.array([r[k] for r in out], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["image_id", "same", "geometry", "bits"])

    named = images.select(F.col(id_col).cast("long").alias("image_id"), F.col("height").cast("int"), F.col("width").cast("int"), "pixels")
    return named.mapInArrow(run, FEATURES)


def rows_of(bits: bytes) -> np.ndarray:
    """The packed bits, a row per corner."""
    return np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)


#: Query corners of a broadcast block (about 60 bytes each, 300 once it is sorted); corners of images, and pairs of votes, looked at in one go; votes from which a pair is a candidate unseen.
BLOCK, CORNERS, AT_ONCE, MANY = 400_000, 8_000, 500_000, 256
#: Bins of turns, none narrower than TURN.
TURNS = int(2 * np.pi / TURN)


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed descriptors (bytes a row) as 64-bit words, (words, corners), for counting differences."""
    return np.ascontiguousarray(np.pad(bits, [(0, 0), (0, -bits.shape[1] % 8)]).view(np.uint64).T)


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of different bits (at most 255) of words laid out alike, or broadcast against each other."""
    total = np.bitwise_count(x[0] ^ y[0])
    for a, b in zip(x[1:], y[1:]):
        total = total + np.bitwise_count(a ^ b)
    return total


def _near(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the corners x[:, a] and y[:, b] lie within FARTHEST; those too far by their first words are not looked at further."""
    left, total = np.arange(len(a)), np.zeros(len(a), np.uint8)
    for v, w in zip(x, y):
        total = total + np.bitwise_count(v[a] ^ w[b])
        keep = np.flatnonzero(total <= FARTHEST)
        left, total, a, b = left[keep], total[keep], a[keep], b[keep]
    return left


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of ``x`` in order (sorting is faster here than np.unique)."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=-1))]


def _slices(many: np.ndarray):
    """(start, stop) of runs of ``many`` with sums of about AT_ONCE, so that common keys need no more memory."""
    ends, start = np.cumsum(many), 0
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        yield start, stop
        start = stop


class Queries:
    """A block of query images, with a sorted table of their corners' keys made where it is used."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        self.rows, self.tables = rows, None

    def __getstate__(self):
        return {"rows": self.rows, "tables": None}

    def prepare(self, keys: Keys) -> None:
        packed = [rows_of(b) for _, _, b in self.rows]
        self.owner = np.repeat(np.arange(len(packed)), [len(p) for p in packed])
        every = np.concatenate(packed)
        self.words = _words(every)
        self.geometry = np.concatenate([np.frombuffer(g, "<f4").reshape(-1, 4) for _, g, _ in self.rows])
        own = np.concatenate([keys.of(every[k : k + CORNERS]) for k in range(0, len(every), CORNERS)]).reshape(-1, TABLES)
        known, starts, members, corner = [], [], [], []
        for table in range(TABLES):  # one at a time, for the memory
            order = np.argsort(own[:, table], kind="stable").astype(np.int32)
            mine = own[order, table]
            start = np.flatnonzero(np.diff(mine, prepend=-1))
            known.append(mine[start])
            starts.append((start + table * len(mine)).astype(np.int32))
            members.append(np.diff(start, append=len(mine)).astype(np.int32))
            corner.append(order)
        known = np.concatenate(known)
        order = np.argsort(known).astype(np.int32)
        self.tables = known[order], np.concatenate(starts)[order], np.concatenate(members)[order], np.concatenate(corner)

    def candidates(self, keys: Keys, image: np.ndarray, geometry: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of queries, numbers of images) of which VOTES corners of the query share a key with a near corner of the image and
        agree on a transform.  ``image``, ``geometry``, ``packed``: some images' corners, the images numbered in order."""
        if self.tables is None:
            self.prepare(keys)
        known, starts, members, corner = self.tables
        mine = keys.of(packed)
        k = np.argsort(mine)
        mine = mine[k]
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        met = np.flatnonzero(known[at] == mine)
        k, lo, many = k[met] // TABLES, starts[at[met]], members[at[met]].astype(np.int64)
        words, seen, images = _words(packed), [], int(image[-1]) + 1 if len(image) else 1
        for start, stop in _slices(many):
            n = many[start:stop]
            i = np.repeat(k[start:stop], n)
            q = corner[np.repeat(lo[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            near = _near(self.words, words, q, i)
            seen.append(_distinct(q[near].astype(np.int64) * len(packed) + i[near]))
        q, i = np.divmod(_distinct(np.concatenate(seen)) if seen else np.zeros(0, np.int64), max(1, len(packed)))
        pairs, owner = np.unique(self.owner[q] * images + image[i], return_inverse=True)
        distinct = np.bincount(owner[np.flatnonzero(np.diff(q * images + image[i], prepend=-1))], minlength=len(pairs))
        count = np.bincount(owner, minlength=len(pairs))
        found = [np.flatnonzero(count > MANY)]
        left = np.flatnonzero(((count <= MANY) & (distinct >= VOTES))[owner])
        # votes by pair and turn: those that agree stand in bins next to each other
        some = np.unique(owner[left])
        q, i, owner = q[left], i[left], np.searchsorted(some, owner[left])
        turn = (geometry[i, 3].astype(float) - self.geometry[q, 3]) % (2 * np.pi)
        here = np.minimum((turn * (TURNS / (2 * np.pi))).astype(np.int64), TURNS - 1)
        bins = np.bincount(owner * TURNS + here, minlength=len(some) * TURNS).reshape(-1, TURNS)
        left = np.flatnonzero((bins + np.roll(bins, 1, 1) + np.roll(bins, -1, 1) >= VOTES)[owner, here])
        left = left[np.argsort(owner[left] * TURNS + here[left], kind="stable")]
        q, i, owner, here, turn = (x[left] for x in (q, i, owner, here, turn))
        gq, gi = self.geometry[q].astype(float), geometry[i].astype(float)
        key = owner * TURNS + here
        scale = gi[:, 2] / gq[:, 2]
        cos, sin, zoom = scale * np.cos(turn), scale * np.sin(turn), np.log(scale)
        tx, ty = gi[:, 0] - (cos * gq[:, 0] - sin * gq[:, 1]), gi[:, 1] - (sin * gq[:, 0] + cos * gq[:, 1])
        limit = (TOLERANCE * np.maximum(1, scale)) ** 2
        beside = np.stack([owner * TURNS + (here + d) % TURNS for d in (-1, 0, 1)], 1).ravel()
        lo = np.searchsorted(key, beside, "left")
        many = np.searchsorted(key, beside, "right") - lo
        agreed = []
        for start, stop in _slices(many):
            n = many[start:stop]
            a = np.repeat(np.arange(start, stop) // 3, n)
            b = np.repeat(lo[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
            keep = np.flatnonzero(np.abs(zoom[a] - zoom[b]) <= ZOOM)
            a, b = a[keep], b[keep]
            x, y = cos[a] * gq[b, 0] - sin[a] * gq[b, 1] + tx[a], sin[a] * gq[b, 0] + cos[a] * gq[b, 1] + ty[a]
            keep = np.flatnonzero((x - gi[b, 0]) ** 2 + (y - gi[b, 1]) ** 2 <= limit[a])
            a, b = a[keep], b[keep]
            turned = np.abs(turn[a] - turn[b])
            keep = np.minimum(turned, 2 * np.pi - turned) <= TURN
            agreed.append(a[keep] * len(self.owner) + q[b[keep]])
        if agreed:
            voted = _distinct(np.concatenate(agreed)) // len(self.owner)
            found.append(some[owner[np.flatnonzero(np.bincount(voted) >= VOTES)]])
        return np.divmod(pairs[np.unique(np.concatenate(found))], images)


def fitted(asked: DataFrame) -> Keys:
    """The keys for the queries with descriptors, fitted on about SAMPLE of their corners, which a digest of each picks."""
    total = asked.agg(F.sum(F.length("bits"))).first()[0] or 0
    share = min(1.0, SAMPLE * (BITS // 8) / max(1, total))
    most = int(share * (1 << 64))

    def run(batches):
        for b in parts_of(batches, 1):
            picked = []
            for i, g, bits in zip(*(b.column(k).to_pylist() for k in range(3))):
                for k in range(len(bits) * 8 // BITS):
                    row = bits[k * BITS // 8 : (k + 1) * BITS // 8]
                    if share == 1 or xxhash.xxh3_64_intdigest(g[16 * k : 16 * k + 16] + row, i & (1 << 63) - 1) < most:
                        picked.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(picked)], pa.binary())], ["bits"])

    rows = asked.select("image_id", "geometry", "bits").mapInArrow(run, "bits binary")
    return Keys(rows_of(b"".join(bytes(r[0]) for r in rows.toLocalIterator())), share)


def blocks(asked: DataFrame, size: int | None = None):
    """The queries with descriptors in broadcast blocks of about ``size`` corners."""
    rows, weight = [], 0
    for r in asked.where("length(bits) > 0").select("image_id", "geometry", "bits").toLocalIterator():
        rows.append((r[0], bytes(r[1]), bytes(r[2])))
        weight += len(r[2]) * 8 // BITS
        if weight >= (size or BLOCK):
            yield asked.sparkSession.sparkContext.broadcast(Queries(rows))
            rows, weight = [], 0
    if rows:
        yield asked.sparkSession.sparkContext.broadcast(Queries(rows))


def consensus(gq: np.ndarray, bq: np.ndarray, gi: np.ndarray, bi: np.ndarray) -> tuple[int, float, float, float, float]:
    """(inliers, dx, dy, scale, angle) of the similarity transform from the query to the image with which most mutually nearest corners agree.

    ``gq``, ``gi``: geometry, a row per corner; ``bq``, ``bi``: packed bits, a row per corner.
    """
    distance = _differences(_words(bq)[:, :, None], _words(bi)[:, None, :])
    to, back = distance.argmin(1), distance.argmin(0)
    rows = np.flatnonzero((back[to] == np.arange(len(to))) & (distance[np.arange(len(to)), to] <= FARTHEST))
    if len(rows) < LEAST_INLIERS:
        return len(rows), 0.0, 0.0, 1.0, 0.0
    q, i = gq[rows].astype(float), gi[to[rows]].astype(float)
    scale, angle = i[:, 2] / q[:, 2], i[:, 3] - q[:, 3]
    cos, sin = scale * np.cos(angle), scale * np.sin(angle)
    tx = i[:, 0] - (cos * q[:, 0] - sin * q[:, 1])
    ty = i[:, 1] - (sin * q[:, 0] + cos * q[:, 1])
    best, k, agreed = -1, 0, np.zeros(0, bool)
    for at in range(0, len(rows), step := max(1, AT_ONCE // len(rows))):
        c, d, one = cos[at : at + step, None], sin[at : at + step, None], slice(at, at + step)
        x, y = c * q[:, 0] - d * q[:, 1] + tx[one, None], d * q[:, 0] + c * q[:, 1] + ty[one, None]
        agree = (x - i[:, 0]) ** 2 + (y - i[:, 1]) ** 2 <= (TOLERANCE * np.maximum(1, scale[one]))[:, None] ** 2
        turned = np.abs((angle[one, None] - angle[None, :] + np.pi) % (2 * np.pi) - np.pi)
        agree &= (turned <= TURN) & (np.abs(np.log(scale[one, None] / scale[None, :])) <= ZOOM)
        counts = agree.sum(1)
        if counts.max() > best:
            best, k = int(counts.max()), at + int(counts.argmax())
            agreed = agree[k - at]
    # corners found at several scales in one place count once, on either side
    places = min(len({(round(a / TOLERANCE), round(b / TOLERANCE)) for a, b in g[agreed, :2]}) for g in (q, i))
    return places, float(tx[k]), float(ty[k]), float(scale[k]), float(angle[k])


PAIRS = "query_id long, image_id long, members long, inliers long, dx double, dy double, scale double, angle double"


def _some(images: list[tuple]):
    """Parts of images (id, members, geometry, bits) with descriptors of about CORNERS corners."""
    part, weight = [], 0
    for row in images:
        if row[3]:
            part.append(row)
            weight += len(row[3]) * 8 // BITS
            if weight >= CORNERS:
                yield part
                part, weight = [], 0
    if part:
        yield part


def _pairs(asked: DataFrame, index: DataFrame) -> DataFrame:
    out = None
    keys = asked.sparkSession.sparkContext.broadcast(fitted(asked))
    for block in blocks(asked):

        def run(batches, block=block):
            kinds = (pa.int64(),) * 4 + (pa.float64(),) * 4
            names = [c.split()[0] for c in PAIRS.split(", ")]
            for b in parts_of(batches, 3):
                rows = []
                for part in _some(list(zip(*(b.column(k).to_pylist() for k in range(4))))):
                    geometry = [np.frombuffer(g, "<f4").reshape(-1, 4) for _, _, g, _ in part]
                    packed = [rows_of(bits) for *_, bits in part]
                    image = np.repeat(np.arange(len(part)), [len(p) for p in packed])
                    found = block.value.candidates(keys.value, image, np.concatenate(geometry), np.concatenate(packed))
                    for k, at in zip(*(x.tolist() for x in found)):
                        q, g_q, b_q = block.value.rows[k]
                        got = consensus(np.frombuffer(g_q, "<f4").reshape(-1, 4), rows_of(b_q), geometry[at], packed[at])
                        if got[0] >= LEAST_INLIERS:
                            rows.append((q, *part[at][:2], *got))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

        part = index.mapInArrow(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return asked.sparkSession.createDataFrame([], PAIRS) if out is None else out


def _searched(queries: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs, the features of all images, and the classes (same, image_id: the smallest, members)."""
    every = materialise(descriptors(images), "image-features")
    named = every.where("image_id is not null")
    classes = named.groupBy("same").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("members"))
    index = materialise(named.join(classes, ["same", "image_id"]).select("same", "image_id", "members", "geometry", "bits").dropDuplicates(["same"]).drop("same"), "image-index")
    asked = materialise(descriptors(queries).where("image_id is not null"), "image-queries")
    return _pairs(asked, index), every, classes


def find_copies(queries: DataFrame, images: DataFrame) -> DataFrame:
    """query_id, image_id (a class's smallest id), members (of the class), inliers, dx, dy, scale, angle.

    ``queries`` and ``images`` have image_id, height, width, pixels.  Pixels are read once and never
    shuffled; votes and pairs that aren't copies stay in the task.
    """
    return _searched(queries, images)[0]


def copies_and_classes(queries: DataFrame, images: DataFrame) -> DataFrame:
    """The pairs of ``find_copies`` with class_id, and one row of (image_id, class_id) with null query_id for every row of ``images``."""
    pairs, every, classes = _searched(queries, images)
    of = classes.select("same", F.col("image_id").alias("class_id"))
    rows = every.select("image_id", "same").join(of, "same", "left").select("image_id", F.when(F.col("image_id").isNotNull(), F.col("class_id")).alias("class_id"))
    rows = materialise(rows, "image-classes")
    return pairs.withColumn("class_id", F.col("image_id")).unionByName(rows, allowMissingColumns=True)


#: Rendering of a vector: a square grid of cells of 12 by 12 pixels, each with 4 by 4 grains.
CELL, GRAIN = 12, 4


@lru_cache(maxsize=8)
def _enlarging(side: int = 8) -> np.ndarray:
    """Cubic interpolation weights, (side * CELL, side)."""
    out = np.zeros((side * CELL, side), np.float32)
    for p in range(side * CELL):
        x = (p + 0.5) / CELL - 0.5
        k = int(np.floor(x))
        for m in range(k - 1, k + 3):
            d = abs(x - m)
            w = 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0
            out[p, min(max(m, 0), side - 1)] += w
    return out


def drawn(grids: np.ndarray) -> np.ndarray:
    """Pictures of rows of side * side numbers: smooth grey levels, and in each cell a grain that its number's bits decide."""
    side = round(grids.shape[1] ** 0.5)
    weights = _enlarging(side)
    z = (grids - grids.mean(1, keepdims=True)) / (grids.std(1, keepdims=True) + 1e-9)
    smooth = np.einsum("pi,bij,qj->bpq", weights, z.reshape(-1, side, side), weights, optimize=True)
    bits = np.ascontiguousarray(grids, np.float32).view(np.uint32).astype(np.uint64).reshape(-1, side, 1, side, 1)
    grain = np.arange(GRAIN * GRAIN, dtype=np.uint64).reshape(1, 1, GRAIN, 1, GRAIN)
    h = (bits * np.uint64(GRAIN * GRAIN) + grain) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    tone = ((h >> np.uint64(40)).astype(np.float32) / (1 << 23) - 1).reshape(-1, side * GRAIN, side * GRAIN)
    tone = tone.repeat(CELL // GRAIN, 1).repeat(CELL // GRAIN, 2)
    return np.clip(np.rint(128 + 30 * smooth + 40 * tone), 0, 255).astype(np.uint8)


IMAGES = "image_id long, height int, width int, pixels binary"


def _images(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], [c.split()[0] for c in IMAGES.split(", ")])


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """image_id, height, width, pixels: all of each vector's numbers drawn as a grey picture.

    The grid is 8 by 8, or larger for a longer vector, filled up with zeros; null, infinite and missing numbers
    are zeros, so a null vector is an even picture.
    """

    def run(batches):
        for b in (b.slice(k, AT_A_TIME) for b in batches for k in range(0, b.num_rows, AT_A_TIME)):
            rows: list = [None] * b.num_rows
            by_side: dict = {}
            for k, v in enumerate(b.column(1).to_pylist()):
                by_side.setdefault(max(8, math.isqrt(max(0, len(v or ()) - 1)) + 1), []).append((k, v or ()))
            for side, members in by_side.items():
                grids = np.zeros((len(members), side * side), np.float32)
                for g, (_, v) in zip(grids, members):
                    g[: len(v)] = np.nan_to_num(np.array([0 if x is None else x for x in v], np.float32), posinf=0, neginf=0)
                for (k, _), p in zip(members, drawn(grids)):
                    rows[k] = (b.column(0)[k].as_py(), *p.shape, p.tobytes())
            yield _images(rows)

    return vectors.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector_col)).mapInArrow(run, IMAGES)


def warped(x: np.ndarray, turn: float, zoom: float) -> np.ndarray:
    """A picture turned by ``turn`` radians about its middle and enlarged by ``zoom``, bilinear; beyond its border the border goes on."""
    h, w = x.shape
    n, m = max(1, round(h * zoom)), max(1, round(w * zoom))
    y, z = ((np.arange(n) + 0.5) / zoom - h / 2)[:, None], ((np.arange(m) + 0.5) / zoom - w / 2)[None, :]
    c, d = np.cos(turn), np.sin(turn)
    at = np.clip(c * y - d * z + h / 2 - 0.5, 0, h - 1.001), np.clip(d * y + c * z + w / 2 - 0.5, 0, w - 1.001)
    i, j = (a.astype(int) for a in at)
    u, v = (a - a.astype(int) for a in at)
    return x[i, j] * (1 - u) * (1 - v) + x[i + 1, j] * u * (1 - v) + x[i, j + 1] * (1 - u) * v + x[i + 1, j + 1] * u * v


EDITS = ("right", "turned", "rescaled", "blurred", "cropped")


def edited(images: DataFrame, keep: float = 0.8, kind: str | None = None) -> DataFrame:
    """Deterministic edits of images: a crop (place by id) to ``keep`` of each side, then one of EDITS (``kind``, or by id; ``cropped`` is
    a crop to 0.6 alone), other brightness and contrast, light noise.  Images without whole pixels stay as they are; a null id counts as 0."""

    def edit(i, h, w, raw):
        if not h or not w or raw is None or len(raw) != h * w:
            return i, h, w, raw
        x = np.frombuffer(raw, np.uint8).reshape(h, w).astype(np.float32)
        rng = np.random.default_rng(abs(i or 0))
        how = kind or EDITS[int(rng.integers(0, len(EDITS)))]
        ch, cw = (max(1, int(n * (0.6 if how == "cropped" else keep))) for n in (h, w))
        top, left = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
        x = x[top : top + ch, left : left + cw]
        if min(x.shape) < 2:
            return i, *x.shape, x.astype(np.uint8).tobytes()
        if how == "right":
            x = np.rot90(x, int(rng.integers(0, 4)))
        elif how == "turned":
            x = warped(x, rng.uniform(-np.pi, np.pi), 1.0)
        elif how == "rescaled":
            x = warped(x, 0.0, rng.uniform(0.7, 1.5))
        elif how == "blurred":
            x = _blur(_blur(x[None]))[0]
        x = np.clip(np.rint(x * 0.85 + 12 + rng.normal(0, 2, x.shape)), 0, 255).astype(np.uint8)
        return i, *x.shape, x.tobytes()

    def run(batches):
        for b in (b.slice(k, AT_A_TIME) for b in batches for k in range(0, b.num_rows, AT_A_TIME)):
            yield _images([edit(*r) for r in zip(*(b.column(k).to_pylist() for k in range(4)))])

    named = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("height").cast("int"), F.col("width").cast("int"), "pixels")
    return named.mapInArrow(run, IMAGES)
