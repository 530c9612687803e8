"""Operator 5: license notices, exact and with a bounded number of errors.

Exact places: a phrase's words standing consecutively.  Fuzzy places: a notice phrase with at most
``errors`` edits, found by the pigeonhole rule: cut into ``errors + 1`` parts, one part must stand
unchanged, so an automaton over all parts (the seeds) locates candidates in one pass over the text
and the regex library's bounded-error matching verifies the window around each and reports its span.
A short seed also needs the phrase's other letters nearby, which the verification decides.

Defined cases: null text: empty; no words: n_words 0, no places, null first and last word, empty
labels, score 0.  Repeated rows are answered each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rallyframe.llm.common import id_text, parts_of

#: The phrases whose exact places count, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices searched with errors: phrase, label, edits.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("apache license", "apache", 1),
    ("mit license", "mit", 1),
    ("mozilla public license", "mpl", 2),
    ("bsd 3 clause license", "bsd", 2),
    ("bsd 2 clause license", "bsd", 2),
    ("creative commons attribution", "cc-by", 3),
    ("cc by nc", "cc-by-nc", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("cc by nd", "cc-by-nd", 0),
    ("cc0 1 0 universal", "cc0", 1),
    ("all rights reserved", "proprietary", 2),
    ("licensed under the", "notice", 2),
)
#: A-Z to lower case; what is no word character becomes a space.
WORD_BYTES = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))


def seeds(phrase: str, errors: int) -> list[tuple[str, int]]:
    """``errors + 1`` parts of nearly equal length, with their offsets."""
    n, k = len(phrase), errors + 1
    ends = [n * i // k for i in range(k + 1)]
    return [(phrase[a:b], a) for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def _machine():
    import ahocorasick
    import regex

    automaton, by = ahocorasick.Automaton(), {}
    for which, (phrase, _, errors) in enumerate(NOTICES):
        for part, at in seeds(phrase, errors):
            by.setdefault(part, []).append((which, at))
    for part, uses in by.items():
        automaton.add_word(part, (len(part), uses))
    automaton.make_automaton()
    patterns = [regex.compile(rf"(?<![^ ])(?:{regex.escape(p, literal_spaces=True)}){{e<={e}}}(?![^ ])", regex.BESTMATCH) for p, _, e in NOTICES]
    return automaton, patterns


#: No word of a notice with its errors is so long; a window never needs to reach into one.
LONG_WORD = 64


def _window(text: str, start: int, end: int) -> tuple[int, int]:
    """The window, its end moved to the end of a word: a cut word would look like a whole one."""
    start, end = max(0, start), min(end, len(text))
    if end < len(text) and text[end] != " ":
        space = text.find(" ", end, end + LONG_WORD)
        if space < 0 and end + LONG_WORD < len(text):
            space = max(start, text.rfind(" ", start, end))
        end = len(text) if space < 0 else space
    return start, end


def fuzzy_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of notices in ``text`` (words joined by single spaces), one per disjoint place.

    Each seed's own window, of bounded length, is verified; of places of one notice that overlap the one with
    the fewest edits counts, then the leftmost.
    """
    automaton, patterns = _machine()
    windows: dict[int, set[tuple[int, int]]] = {}
    for end, (size, uses) in automaton.iter(text):
        start = end - size + 1
        for which, at in uses:
            phrase, _, errors = NOTICES[which]
            windows.setdefault(which, set()).add(_window(text, start - at - errors - 1, start - at + len(phrase) + errors + 1))
    found = []
    for which, mine in windows.items():
        places = set()
        for a, b in mine:
            if m := patterns[which].search(text, a, b):
                places.add((sum(m.fuzzy_counts), m.start(), m.end()))
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for edits, start, end in sorted(places):
            k = bisect_left(taken, (start, end))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (start, end))
                found.append((NOTICES[which][1], start, end, edits))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


@lru_cache(maxsize=1)
def _base_patterns():
    return [(re.compile(rf"(?<![^ ])(?={re.escape(p)}(?![^ ]))"), label) for p, label in BASE]


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    flat = b" ".join(words).decode("utf-8", "surrogatepass")
    places, base = [], set()
    for pattern, label in _base_patterns():
        at = word = 0
        for m in pattern.finditer(flat):
            base.add(label)
            word += flat.count(" ", at, m.start())  # each stretch of the text is counted once
            at = m.start()
            places.append(word)
    spans = fuzzy_spans(flat)
    labels = base | {s[0] for s in spans}
    best = 1.0 if base else max((1 - s[3] / (s[2] - s[1]) for s in spans), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, [f"{a}:{s}:{e}:{k}" for a, s, e, k in spans]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document; ``spans`` are label:start:end:edits in the text of words joined by single spaces.  No shuffle."""

    def run(batches):
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
        names = SCHEMA.replace("array<string>", "x").split(", ")
        for b in parts_of(batches, 1):
            cols = list(zip(*map(scan, b.column(1).to_pylist()))) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], [n.split()[0] for n in names])

    return id_text(docs).mapInArrow(run, SCHEMA)
