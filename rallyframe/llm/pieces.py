"""Whole-text tokenizing through a worker cache of pieces.

Both vocabularies split a text before merging, and a run of non-space characters (with the one
space before it, for the byte-level one) always begins and ends at such a split.  So the ids of a
text are the ids of its pieces in order, and a piece needs the library once per Python worker.
A text of Latin characters only is cut at the vocabulary's own splits, so a word is one piece whatever
marks stand around it; the white-space dropping vocabulary folds case first, and so is such a text.
A text that holds one of the vocabulary's special strings is given to the library whole.

Texts of a batch become arrays of piece numbers; their ids are gathered with numpy.  For the white-space dropping
vocabulary :meth:`PieceEncoder.flat` cuts all Latin texts of an Arrow column at once: bytes are folded and classed by
table lookup, and only the different pieces of the column are looked up in the worker's cache.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rallyframe.llm.common import hold_cache

#: Unicode's White_Space, as the vocabularies' patterns understand ``\s``.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = {
    "word": re.compile(f"[^{SPACE}]+"),
    "byte": re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
}
#: Below this code point no character composes with its neighbours, so folding a whole text is what folding after normalisation is.
_PLAIN = 0x250
_OTHER = re.compile(f"[^\0-{chr(_PLAIN - 1)}]")


def _class(kind: str) -> str:
    return "".join(chr(c) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
#: The vocabularies' splits, for Latin text (folded, for the white-space dropping one).
SPLITS = {
    "word": re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{SPACE}{_L}{_N}]+"),
    "byte": re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
}
#: By code point, as far as two bytes of UTF-8 reach: whether it is white space (0), letter (1), other (2) or number (3), and the folded one;
#: -1 where a text that holds it is not plain, or the folded one is not.
_SPACE, _OTHERS, _NUMBER = 0, 2, 3
_KINDS, _FOLDED = np.full(0x800, _OTHERS, np.uint8), np.full(0x800, -1, np.int16)
for _c in range(_PLAIN):
    _KINDS[_c] = _SPACE if re.match(f"[{SPACE}]", chr(_c)) else 1 if chr(_c) in _L else _NUMBER if chr(_c) in _N else _OTHERS
    if len(chr(_c).lower()) == 1 and ord(chr(_c).lower()) < _PLAIN:
        _FOLDED[_c] = ord(chr(_c).lower())
_FOLDED_BYTE = np.arange(256, dtype=np.uint8)
_FOLDED_BYTE[:128] = _FOLDED[:128]
#: A worker forgets its pieces between two batches once it knows so many (about 150 MB).
MOST_PIECES = 700_000
#: New pieces that the library gets in one text.
JOINED = 256


def vocabulary(name: str) -> str:
    """The vocabulary file: a path as it stands, else a name in the public collection."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@lru_cache(maxsize=4)
def merger(name: str):
    """The library with the same vocabulary and merges for folded pieces with a space between them, and by id whether it ends a
    piece; none where the vocabulary does not mark the ends of words."""
    whole = library(name)
    suffix = getattr(whole.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    spec = json.loads(whole.to_str())
    at_spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    in_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [at_spaces, in_bytes]}}
    entries = whole.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(entries.values()) + 1, bool)
    ends[[i for token, i in entries.items() if token.endswith(suffix)]] = True
    return type(whole).from_str(json.dumps(spec)), ends


class _Slots(dict):
    """Piece -> number; a piece not seen before gets the next one and waits for the library."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.waiting.append(piece)
        return n


def cut_words(column: pa.Array, apart: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Folded pieces of the plain texts of a large string column without nulls, cut as ``SPLITS["word"]`` cuts them; how many each
    text has; and the places of the others, of which no pieces are given: those that hold or fold to other scripts, and those
    that ``apart`` marks."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - first
    # three bytes more, so that a split may be looked for behind the last one; the places ``two`` are those of the characters of more than one
    data = np.zeros(n + 3, np.uint8)
    if n:
        data[:n] = _FOLDED_BYTE[np.frombuffer(column.buffers()[2], np.uint8)[first : first + n]]
    kind = _KINDS[:256][data]
    two = np.flatnonzero(data >= 0xC0)
    code = (data[two] & np.uint16(0x1F)) << 6 | data[two + 1] & np.uint16(0x3F)
    folded = _FOLDED[code]
    apart = apart.copy()
    apart[np.searchsorted(offsets, two[(data[two] >= 0xE0) | (folded < 0)], "right") - 1] = True
    folded = np.maximum(folded, 0).astype(np.uint16)
    kind[two] = kind[two + 1] = _KINDS[folded]
    data[two], data[two + 1] = 0xC0 | folded >> 6, 0x80 | folded & 0x3F
    kind[n:] = _SPACE
    if apart.any():
        kind[:n][np.repeat(apart, np.diff(offsets))] = _SPACE
    start = kind == _NUMBER
    start[1:] |= kind[1:] != kind[:-1]
    start[two + 1] = False
    start[offsets[:-1]] = True
    start &= kind != _SPACE
    mark = np.flatnonzero((data == ord("'")) & start)
    one, after = data[mark + 1], data[mark + 2]
    length = 2 * np.isin(one, np.frombuffer(b"stmd", np.uint8))
    length[((after == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((after == ord("l")) & (one == ord("l")))] = 3
    whole = (length > 0) & (mark + length <= offsets[np.searchsorted(offsets, mark, "right")])
    mark, behind = mark[whole], (mark + length)[whole]
    start[mark + 1] = False
    start[behind] = kind[behind] != _SPACE
    counts = np.diff(np.searchsorted(np.flatnonzero(start), offsets))
    held = kind != _SPACE
    letters = data[held]
    ends = np.append(np.flatnonzero(start[held]), len(letters)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return pieces, counts, np.flatnonzero(apart)


class PieceEncoder:
    """Ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    kind: ``word`` drops white space and never merges across it; ``byte`` keeps a space with the
    word behind it.
    """

    def __init__(self, name: str, kind: str):
        self.name, self.library, self.kind, self.find, self.cut = name, library(name), kind, PIECES[kind].findall, SPLITS[kind].findall
        self.specials = special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        plain = [(t.content, i) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark, self.mark_id = plain[0] if plain and kind == "word" else (None, None)
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.known = np.zeros(1 << 20, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.used = 0

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special strings; their ids one behind the other are the text's."""
        cut = text.lower() if self.kind == "word" else text
        # capitals may fold to letters that the classes of the splits do not hold
        return self.find(text) if _OTHER.search(text) or (cut is not text and _OTHER.search(cut)) else self.cut(cut)

    def _learn(self, folded: bool = False) -> None:
        """Ask the library for the pieces that wait, all in one call; ``folded``: they are folded and cut at the splits."""
        waiting, self.slots.waiting = self.slots.waiting, []
        start = len(self.slots) - len(waiting)
        ids, sizes = self._merged(waiting) if folded and merger(self.name) else self._joined(waiting) if self.mark else self._single(waiting)
        while self.used + len(ids) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        while len(self.slots) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.known[self.used : self.used + len(ids)] = ids
        self.size[start : start + len(sizes)] = sizes
        self.first[start : start + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _single(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one behind the other, and how many each has."""
        lists = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum())), sizes

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, ``JOINED`` pieces a text with a special string between them, at which the library cuts first."""
        groups = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
        found = []
        for group, e in zip(groups, self.library.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            between = ids == self.mark_id
            at = np.flatnonzero(between)
            # a piece that gives the special id itself: each for itself
            found.append((ids[~between], np.diff(at, prepend=-1, append=len(ids)) - 1) if len(at) == len(group) - 1 else self._single(group))
        return np.concatenate([i for i, _ in found]), np.concatenate([n for _, n in found]).astype(np.int32)

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for folded pieces, which the library need not normalise and split again; every piece's last id is one that ends words."""
        lean, ends = merger(self.name)
        groups = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
        found = []
        for group, e in zip(groups, lean.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            sizes = np.diff(np.flatnonzero(ends[ids]), prepend=-1)
            found.append((ids, sizes) if len(sizes) == len(group) and int(sizes.sum()) == len(ids) else self._single(group))
        return np.concatenate([i for i, _ in found]), np.concatenate([n for _, n in found]).astype(np.int32)

    def flat(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column without nulls, each with ``end_id`` behind it, one text behind the other, and how many each
        has; for the kind ``word``."""
        hold_cache(id(self), self._clear)
        if len(self.slots) > MOST_PIECES:
            self._clear()
        column, special = column.cast(pa.large_string()), np.zeros(len(column), bool)
        for text in self.specials:
            special |= pc.match_substring(column, text).to_numpy(zero_copy_only=False)
        pieces, counts, rest = cut_words(column, special)
        coded = pieces.dictionary_encode()
        numbers = np.fromiter(map(self.slots.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int32, len(coded.dictionary))
        if self.slots.waiting:
            self._learn(folded=True)
        at = numbers[coded.indices.to_numpy()]
        size = self.size[at]
        ids = self._ids(at, size)
        ends = np.append(0, np.cumsum(size, dtype=np.int64))[np.append(0, np.cumsum(counts))]
        if len(rest):
            texts = np.split(ids, ends[1:-1])
            for k, found in zip(rest.tolist(), self.encode(column.take(pa.array(rest)).to_pylist())):
                texts[k] = found
            ids, ends = np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts]))
        return np.insert(ids, ends[1:], np.uint32(end_id)), np.diff(ends) + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text."""
        hold_cache(id(self), self._clear)
        if len(self.slots) > MOST_PIECES:
            self._clear()
        number = self.slots.__getitem__
        rows: list = []
        for text in texts:
            if self.special is not None and self.special.search(text):
                rows.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                rows.append(list(map(number, self.split(text))))
        if self.slots.waiting:
            self._learn()
        return [r if isinstance(r, np.ndarray) else self._gather(r) for r in rows]

    def _gather(self, numbers: list[int]) -> np.ndarray:
        if not numbers:
            return np.zeros(0, np.uint32)
        at = np.array(numbers, np.int32)
        return self._ids(at, self.size[at])

    def _ids(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the pieces numbered ``at``, of so many ids each, one behind the other."""
        ends = np.cumsum(size, dtype=np.int64)
        shift = self.first[at] - (ends - size)
        return self.known[np.repeat(shift, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(maxsize=4)
def encoder(name: str, kind: str) -> PieceEncoder:
    """The worker's encoder; it keeps its pieces from task to task."""
    return PieceEncoder(name, kind)
