"""Operator 6: secrets by exact patterns and by dictionary-primed zstandard novelty.

Pattern spans: three kinds (``assign``, ``access``, ``hex``), leftmost and non-overlapping per kind.
Novel spans: runs of identifier characters near a sensitive word.  Each is measured by the bytes that
it adds to the compressed surroundings, zstandard being primed with a dictionary of identifiers (fixed
ones and the corpus's own: the words of letters that stand in most documents, one in a thousand at least, away from sensitive words); a
run that adds nearly as many bytes as it has characters could not be predicted from code or prose and
is reported as kind ``novel``, also where it touches a pattern span.  As words near sensitive ones don't
prime, a secret that leaks many times stays as novel as one that leaks once.

Defined cases: null and empty texts have no spans; repeated rows are scanned each; in an empty table only the
fixed identifiers prime.  Texts are scanned whole; only words with
the numbers of their documents are shuffled.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import id_text, parts_of

#: The kinds' patterns, the group measured, the least characters of it.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Words that make a context sensitive.
SENSITIVE = ("secret", "token", "passw", "passphrase", "pwd", "credential", "apikey", "api_key", "api-key", "access_key", "private_key", "client_id", "auth", "bearer", "akia")
_SENSITIVE = re.compile("|".join(SENSITIVE))
#: A candidate: at least twelve identifier characters, dots within; how far from a sensitive word it may start; its surroundings.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]")
NEAR, AROUND = 64, 256
#: Added bytes per character, and added bytes, from which a candidate is novel.
NOVEL, LEAST_BYTES = 0.6, 12
#: Identifiers and syntax that surround secrets in code.
IDENTIFIERS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "secret_key", "private_key", "client_secret", "client_id",
    "authorization", "bearer", "credential", "username", "user_name", "database", "connection_string", "export", "const", "public static final String",
    "https://", "http://", "localhost", "config", "settings", "environment", "os.environ", "getenv", "return", "function", "import", "self.", "None", "null", "true", "false",
    "example", "placeholder", "changeme", "your_api_key_here", "xxxxxxxxxxxxxxxx", "0000000000000000", "1234567890", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef",
)
_HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three exact kinds, in code points, end exclusive."""
    spans = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, under a primed dictionary."""

    def __init__(self, pieces: list[str]):
        self.primer = " ".join([*pieces, *IDENTIFIERS]).encode("utf-8", "surrogatepass")
        self.compressor = None

    def __getstate__(self):
        return self.__dict__ | {"compressor": None}

    def size(self, data: bytes) -> int:
        if self.compressor is None:
            import zstandard

            d = zstandard.ZstdCompressionDict(self.primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressor = zstandard.ZstdCompressor(level=3, dict_data=d)
        return len(self.compressor.compress(data))

    def added(self, before: str, candidate: str, after: str) -> int:
        a, c, z = (x.encode("utf-8", "surrogatepass") for x in (before, candidate, after))
        return self.size(a + z + c) - self.size(a + z)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Novel candidates near sensitive words."""
        low = _lowered(text)
        if not any(w in low for w in SENSITIVE):
            return []
        near = [m.start() for m in _SENSITIVE.finditer(low)]
        found, k = [], 0
        for m in _CANDIDATE.finditer(text):
            s, e = m.span()
            while k < len(near) and near[k] < s - NEAR:
                k += 1
            if k == len(near):
                break
            if near[k] > e + NEAR:
                continue
            c = m.group()
            added = self.added(text[max(0, s - AROUND) : s], c, text[e : e + AROUND])
            if added >= LEAST_BYTES and added >= NOVEL * len(c):
                found.append(("novel", s, e))
        return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


#: Words that prime the measure at most, the share of all documents that must hold one away from sensitive words, and its letters.
PRIMING, LEAST_SHARE = 2048, 0.001
_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{4,32}(?![A-Za-z0-9])")
#: Distinct words a task holds before it hands on their partial counts.
HELD = 200_000


def _lowered(text: str) -> str:
    """Lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def ordinary_words(text: str) -> set[str]:
    """The words of letters of a text that stand more than NEAR characters away from every sensitive word."""
    at = [m.span() for m in _SENSITIVE.finditer(_lowered(text))]
    if not at:
        return set(_WORD.findall(text))
    found, end = set(), 0
    for s, e in [*at, (len(text) + NEAR, 0)]:
        if s - NEAR > end:
            # a word that a border cuts is left out
            found.update(m.group() for m in _WORD.finditer(text, max(0, end - 33), s - NEAR + 33) if m.start() >= end and m.end() <= s - NEAR)
        end = max(end, e + NEAR)
    return found


def novelty(docs: DataFrame) -> Novelty:
    """The measure primed with the words that stand in most documents, counted exactly (ties: in order of the word)."""

    def run(batches):
        seen: Counter = Counter()

        def partial():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in parts_of(batches, 0):
            seen[""] += b.num_rows  # the number of documents
            for text in b.column(0).to_pylist():
                seen.update(ordinary_words(text))
            if len(seen) > HELD:
                yield partial()
                seen.clear()
        yield partial()

    counts = id_text(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "word").limit(PRIMING + 1).collect()  # no word stands in more documents than there are
    total = next((r["n"] for r in most if not r["word"]), 0)
    return Novelty([r["word"] for r in most if r["word"] and r["n"] >= LEAST_SHARE * total][:PRIMING])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    measure = docs.sparkSession.sparkContext.broadcast(novelty(docs))

    def run(batches):
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in parts_of(batches, 1):
            cols: tuple = ([], [], [], [], [])
            for text in b.column(1).to_pylist():
                base = pattern_spans(text)
                for col, kind in zip(cols, KINDS):
                    if kind != "novel":
                        col.append(sum(s[0] == kind for s in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(base + measure.value.spans(text)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", *names])

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch that spans cover replaced by ``[REDACTED]``."""
    out, at = [], 0
    for s, e in _stretches(spans):
        out += [text[at:s], "[REDACTED]"]
        at = e
    return "".join([*out, text[at:]])


def _stretches(spans):
    merged: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, the secrets of their texts redacted and ``length_col`` set anew where they were."""
    measure = docs.sparkSession.sparkContext.broadcast(novelty(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))))
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for b in parts_of(batches, at):
            texts = b.column(at).to_pylist()
            changed = {}
            for k, text in enumerate(texts):
                if text and (found := (base := pattern_spans(text)) + measure.value.spans(text)):
                    changed[k] = redact(text, found)
            if changed:
                cols = list(b.columns)
                cols[at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], cols[at].type)
                if size_at is not None:
                    sizes = cols[size_at].to_pylist()
                    cols[size_at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(sizes)], cols[size_at].type)
                b = pa.RecordBatch.from_arrays(cols, names=b.schema.names)
            yield b

    return docs.mapInArrow(run, docs.schema)


@lru_cache(maxsize=1)
def plain_measure() -> Novelty:
    """The measure with the fixed identifiers alone, for tests and small uses."""
    return Novelty([])
