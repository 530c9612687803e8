"""Operators 1, 3 and 9 against the tokenizers library itself."""

import itertools
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rallyframe.llm.common import table
from rallyframe.llm.packing import best_fit_pack, cuts, plan
from rallyframe.llm.pieces import PieceEncoder
from rallyframe.llm.token_counts import token_counts
from rallyframe.llm.token_output import pack, pack_rows, read_ids, token_output, unpack, unpack_rows, write_ids

ODD = [
    None,
    "",
    " ",
    "  two  spaces \n\n and\tlines\r\n",
    "don't stop, it's 3.14e10 — naïve café ﬁn",
    "<|endoftext|> inside <|startoftext|> text",
    "日本語 と 한국어　x y z",
    "word " * 5000,
    "x" * 20000,
    "A, b. C,d .e ,f",
    "É. ñ, ß.",
    "İstanbul ΣΑΣ H\u0331 E\u0301 \u1e96 İ's DON'T 'S 'RE² ½x ªº",
    "x\x85y\xa0z\x1cw  \n\n  A1b2 'll''s ''S",
]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    return rows + [(10_000 + k, t) for k, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # extra columns with the operators' own names
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id long, text string, ids string, n_tokens int, length int").repartition(5)


def test_token_output_is_the_librarys(spark, docs, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in token_output(docs).collect()}
    at = 0
    for i, text in sorted(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids)), text
        at += len(ids)
    assert len(got) == len(texts)


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_every_code_point_is_the_librarys(name, kind):
    """Every assigned code point alone, in a word, between digits and between spaces; then random Latin words."""
    texts = []
    for k in range(0x110000):
        c = chr(k)
        if unicodedata.category(c) not in ("Cn", "Cs", "Co"):
            texts.append(f"{c}\na{c}b\n1{c}2\na {c} b")
    latin = [chr(k) for k in range(0x250) if unicodedata.category(chr(k))[0] in "LN"] + list(" '.")
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(latin, 12)) for _ in range(6000)] + ["BAKI ŞƏHƏRİ, AZƏRBAYCAN"]
    t, mine = Tokenizer.from_file(public_tokenizers.path(name)), PieceEncoder(name, kind)
    for at in range(0, len(texts), 5000):
        some = texts[at : at + 5000]
        for text, got, want in zip(some, mine.encode(some), t.encode_batch(some, add_special_tokens=False)):
            assert got.tolist() == want.ids, (text, hex(ord(text[0])))


def test_variable_length_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (unpack(n, *pack(v)) == v).all()


def test_files_are_in_order(spark, docs, texts, tmp_path):
    """Reading every file by name and row gives the documents in ascending order."""
    write_ids(docs, str(tmp_path / "f"))
    rows = []
    for name in sorted(p.name for p in (tmp_path / "f" / "ids").glob("part-*.parquet")):
        rows += pq.read_table(tmp_path / "f" / "ids" / name).to_pylist()
    assert [r["doc_id"] for r in rows] == sorted(i for i, _ in texts)
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows) and len({r["shard"] for r in rows}) > 1
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = dict(texts)
    for r in read_ids(spark, str(tmp_path / "f")).collect():
        assert r["ids"] == [*t.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids, 1]


def test_repeated_ids_start_where_they_stand(spark, tmp_path):
    rows = [(1, "a a a a a a a a"), (1, "b"), (None, "c d"), (2, None), (1, "b"), (None, "e")] + [(7, f"x {k}") for k in range(40)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, at int").repartition(3)
    write_ids(docs, str(tmp_path / "f"))
    stored, at = [], 0
    for name in sorted(p.name for p in (tmp_path / "f" / "ids").glob("part-*.parquet")):
        for r in pq.read_table(tmp_path / "f" / "ids" / name).to_pylist():
            stored.append((r["doc_id"], at, r["n_tokens"]))
            at += r["n_tokens"]
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_output(docs).collect()]
    assert sorted(got, key=lambda x: x[1]) == stored and len(stored) == len(rows)


def test_token_counts_are_the_librarys(docs, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in token_counts(docs, limit=1024).collect()}
    for i, text in texts:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024), text


def test_packing_is_whole_and_gapless(docs, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = best_fit_pack(docs, 2048).collect()
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == cuts(len(ids), 2048)
        assert [r["ids_crc32"] for r in mine] == [crc(ids[r["start"] : r["start"] + r["length"]]) for r in mine]
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 2048) * 1.05 + 1


def test_plan_covers_every_rank_once():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 100, 60), rng.integers(1, 500, 60))}
    seen = {k: [] for k in histogram}
    for length, a, b, each, first, at in plan(histogram, 100):
        assert at + min(each, b - a) * length <= 100
        seen[length] += range(a, b)
    assert {k: len(v) for k, v in seen.items()} == histogram
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    assert token_output(none).count() == token_counts(none).count() == best_fit_pack(none).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], schema)
    assert token_output(twice).count() == token_counts(twice).count() == best_fit_pack(twice).count() == 3


def test_long_unbroken_text_is_counted(spark):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 200_000))
    r = token_counts(spark.createDataFrame([(1, text), (2, "a few words")], "doc_id long, text string"), "byte_bpe_50k.json").where("doc_id = 1").collect()[0]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert r["n_tokens"] == len(t.encode(text, add_special_tokens=False).ids) > 65_535


def test_new_pieces_reach_the_library_in_joined_texts(monkeypatch):
    """Ids of joined pieces are those of each alone, also where a piece gives the id of the special string between them."""
    from rallyframe.llm.pieces import PieceEncoder

    enc = PieceEncoder("word_bpe_49k.json", "word")
    rng = np.random.default_rng(5)
    pieces = ["".join(rng.choice(list("abcxyz'-é1中ÅİΣ<|>_"), rng.integers(1, 12))) for _ in range(1000)] + ["\u200b", "\ufe0f", "\u0301"]
    for given in (pieces, [*pieces[:300], enc.mark, *pieces[300:]]):
        ids, sizes = enc._joined(given)
        want, lengths = enc._single(given)
        assert ids.tolist() == want.tolist() and sizes.tolist() == lengths.tolist()
    texts, calls = [" ".join(pieces)] * 2, []
    real = enc.library
    monkeypatch.setattr(enc, "library", type("Counted", (), {"encode_batch_fast": lambda self, x, **k: calls.append(len(x)) or real.encode_batch_fast(x, **k)})())
    assert [r.tolist() for r in enc.encode(texts)] == [real.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(calls) * 100 < len(enc.slots)


def test_columns_of_texts_are_the_librarys():
    """Every assigned code point alone, in a word, between digits and between spaces, each in a text of its own among plain ones; every string
    of up to five of the characters at which splits are decided; texts that end where a split may go on; special strings; parts of columns."""
    chars = [chr(k) for k in range(0x110000) if unicodedata.category(chr(k)) not in ("Cn", "Cs", "Co") and (k < 0x3000 or k % 50 == 0)]
    texts = [t for c in chars for t in (f"{c}\na{c}b\n1{c}2\na {c} b", f"It's {c.upper()}{c}'{c}s")]
    texts += ["".join(x) for n in range(6) for x in itertools.product("'sLe .1", repeat=n)]
    texts += ["".join(x) for n in (3, 4) for x in itertools.product("'²éR\xa0v|<", repeat=n)]
    texts += ["a '", "s b", "a 'r", "e", "", "it'", "'ll", "x<", "|startoftext|>", "y<|endoftext|>z", "<|", "<|startoftext|>"]
    texts += [t or "" for t in ODD]
    t, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), PieceEncoder("word_bpe_49k.json", "word")
    for at in range(0, len(texts), 4000):
        some = texts[at : at + 4000]
        for column, part in ((pa.array(some), some), (pa.array(["before é", *some, "'s behind"])[1:-1], some)):
            ids, sizes = mine.flat(column, 1)
            ends = np.cumsum(sizes)
            assert len(ends) == len(part) and ends[-1] == len(ids)
            for text, got, want in zip(part, np.split(ids, ends[:-1]), t.encode_batch(part, add_special_tokens=False)):
                assert got.tolist() == [*want.ids, 1], text


def test_a_column_looks_up_each_piece_once(monkeypatch):
    """The cost of a column is that of its different pieces, and the library gets those folded and cut, without normalising them again."""
    mine = PieceEncoder("word_bpe_49k.json", "word")
    asked, given = [], []
    slots = type(mine.slots)

    class Counted(slots):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    monkeypatch.setattr("rallyframe.llm.pieces._Slots", Counted)
    monkeypatch.setattr(mine, "library", type("None", (), {"encode_batch_fast": lambda self, x, **k: given.extend(x)})())
    mine._clear()
    text = "The cat's 12 Cats, the CATS don't."
    ids, sizes = mine.flat(pa.array([text] * 3000), 1)
    want = [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, 1]
    assert ids.tolist() == want * 3000 and (sizes == len(want)).all()
    assert sorted(asked) == sorted({"the", "cat", "'s", "1", "2", "cats", ",", "don", "'t", "."}) and not given


def test_rows_packed_together_are_those_packed_alone():
    rng = np.random.default_rng(4)
    for most in (8, 16, 32):
        sizes = rng.integers(0, 9, 200)
        values = (rng.integers(0, 1 << most, int(sizes.sum()), dtype=np.uint64) >> rng.integers(0, most, int(sizes.sum()), dtype=np.uint64)).astype(np.uint32)
        control, data = pack_rows(values, sizes)
        rows = np.split(values, np.cumsum(sizes)[:-1])
        assert list(zip(control.to_pylist(), data.to_pylist())) == [pack(r) for r in rows]
        assert (unpack_rows(sizes, b"".join(control.to_pylist()), b"".join(data.to_pylist())) == values).all()
        # plainly: two bits a value, then its bytes
        for row, c, d in zip(rows, control.to_pylist(), data.to_pylist()):
            size = [max(1, (int(v).bit_length() + 7) // 8) for v in row]
            assert c == bytes(sum(n - 1 << 2 * k for k, n in enumerate(size[j : j + 4])) for j in range(0, len(size), 4))
            assert d == b"".join(int(v).to_bytes(n, "little") for v, n in zip(row, size))
