"""Operator 10 (recall against the known copies, brute-force joins) and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rallyframe.llm import media as md
from rallyframe.llm.common import table


def test_edited_copies_are_found(spark, sf_dir):
    images = md.rendered(table(spark, sf_dir, "embeddings")).limit(200).cache()
    queries = md.edited(images.where("image_id % 5 = 0"))
    got = md.find_copies(queries, images).collect()
    asked = {r["image_id"] for r in queries.collect()}
    own = {r["query_id"] for r in got if r["query_id"] == r["image_id"]}
    assert len(own) >= 0.95 * len(asked)
    assert sum(r["query_id"] != r["image_id"] for r in got) <= 0.2 * len(asked)


def test_candidates_lose_nothing_against_all_pairs(spark, sf_dir):
    images = md.rendered(table(spark, sf_dir, "embeddings")).limit(60).cache()
    queries = md.edited(images.where("image_id % 10 = 0"))
    f = lambda df: {r["image_id"]: (np.frombuffer(r["geometry"], "<f4").reshape(-1, 4), md.rows_of(r["bits"])) for r in md.descriptors(df).collect()}
    index, asked = f(images), f(queries)
    brute = {(q, i) for q, (gq, bq) in asked.items() for i, (gi, bi) in index.items() if len(gq) and len(gi) and md.consensus(gq, bq, gi, bi)[0] >= md.LEAST_INLIERS}
    got = {(r["query_id"], r["image_id"]) for r in md.find_copies(queries, images).collect()}
    assert got <= brute and len(got) >= 0.9 * len(brute)


def test_equal_images_are_one_class_and_odd_ones_match_nothing(spark, sf_dir):
    one = md.rendered(table(spark, sf_dir, "embeddings")).limit(1).collect()[0]
    rows = [(k, one["height"], one["width"], bytes(one["pixels"])) for k in (5, 6, 7, 7)] + [(8, 3, 3, b"123456789"), (9, None, None, None), (10, 100, 100, b"short"), (11, 60, 60, bytes(3600)), (None, 1, 1, b"x")]
    images = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")
    got = md.find_copies(images.where("image_id in (6, 8, 9, 10, 11)"), images).collect()
    assert [(r["query_id"], r["image_id"], r["members"]) for r in got] == [(6, 5, 4)]
    assert md.find_copies(images.limit(0), images.limit(0)).count() == 0


def plain_pictures(vectors):
    """Pictures without grain: smooth grey levels alone."""
    z = (vectors - vectors.mean(1, keepdims=True)) / vectors.std(1, keepdims=True)
    smooth = np.einsum("pi,bij,qj->bpq", md._enlarging(), z.reshape(-1, 8, 8), md._enlarging())
    return np.clip(np.rint(128 + 45 * smooth), 0, 255).astype(np.uint8)


#: Recall against all rows of a table, by kind of edit; smooth pictures cut to 0.6 keep too few corners for more.
RECALL = {(kind, grain): 0.9 for kind in md.EDITS for grain in (True, False)} | {("cropped", False): 0.5}


@pytest.mark.parametrize("grain", [True, False])
@pytest.mark.parametrize("kind", md.EDITS)
def test_every_kind_of_edit_is_found_as_by_all_pairs(spark, sf_dir, kind, grain):
    vectors = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(80)
    images = md.rendered(vectors)
    if not grain:
        numbers = np.array([r["embedding"][:64] for r in vectors.collect()], np.float32)
        rows = [(k, 96, 96, p.tobytes()) for k, p in enumerate(plain_pictures(numbers))]
        images = spark.createDataFrame(rows, images.schema)
    images = images.cache()
    queries = md.edited(images.where("image_id % 2 = 0"), kind=kind).cache()
    f = lambda df: {r["image_id"]: (np.frombuffer(r["geometry"], "<f4").reshape(-1, 4), md.rows_of(r["bits"])) for r in md.descriptors(df).collect()}
    index, asked = f(images), f(queries)
    brute = {(q, i) for q, (gq, bq) in asked.items() for i, (gi, bi) in index.items() if md.consensus(gq, bq, gi, bi)[0] >= md.LEAST_INLIERS}
    got = {(r["query_id"], r["image_id"]) for r in md.find_copies(queries, images).collect()}
    own = {(q, q) for q in asked}
    assert got <= brute and len(got & own) >= RECALL[kind, grain] * len(own), len(got & own) / len(own)
    assert len(got & own) >= 0.97 * len(brute & own) and len(got - own) <= 0.05 * len(own)


def test_a_turn_of_twenty_degrees_and_both_ends_of_the_zoom(spark, sf_dir):
    rows = md.rendered(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(60)).collect()
    images = spark.createDataFrame(rows, md.IMAGES).cache()
    for turn, zoom in ((np.radians(20), 1.0), (0.0, 0.7), (0.0, 1.5)):
        changed = [(r["image_id"], md.warped(np.frombuffer(r["pixels"], np.uint8).reshape(96, 96).astype(np.float32), turn, zoom)) for r in rows]
        queries = spark.createDataFrame([(i, *x.shape, np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()) for i, x in changed], md.IMAGES)
        found = {r["query_id"] for r in md.find_copies(queries, images).collect() if r["query_id"] == r["image_id"]}
        assert len(found) >= 0.9 * len(rows), (turn, zoom, len(found))


def test_odd_vectors_are_drawn_and_odd_images_stay(spark):
    rows = [(1, [float(k) for k in range(65)]), (2, None), (3, []), (4, [1.0, None, float("nan"), float("inf")]), (None, [1.0] * 64)]
    vectors = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, height int")
    got = {r["image_id"]: r for r in md.rendered(vectors).collect()}
    assert (got[1]["height"], got[2]["height"]) == (108, 96) and len(got) == 5 and len(set(got[2]["pixels"])) < 40
    odd = spark.createDataFrame([(1, None, None, None), (2, 5, 5, b"x"), (3, 1, 1, b"x"), (None, 2, 2, b"abcd")], md.IMAGES)
    kept = {r["image_id"]: tuple(r) for r in md.edited(odd).collect()}
    assert kept[1] == (1, None, None, None) and kept[2] == (2, 5, 5, b"x") and len(kept) == 4


def test_different_pictures_of_one_id_are_each_found(spark, sf_dir):
    a, b = (tuple(r)[1:] for r in md.rendered(table(spark, sf_dir, "embeddings")).limit(2).collect())
    images = spark.createDataFrame([(7, *a), (7, *b), (8, *a)], md.IMAGES)
    for picture, members in ((a, 2), (b, 1)):
        got = md.find_copies(spark.createDataFrame([(1, *picture)], md.IMAGES), images).collect()
        assert [(r["image_id"], r["members"]) for r in got] == [(7, members)]


def test_larger_pictures_have_more_corners():
    rng = np.random.default_rng(1)
    small, large = (md.corners(rng.integers(0, 256, (1, n, n)).astype(np.uint8)) for n in (96, 288))
    assert len(small["x"]) <= 3 * md.STRONGEST and len(large["x"]) > 5 * len(small["x"])


def test_every_row_has_its_class_and_blocks_give_the_same(spark, sf_dir, monkeypatch):
    rows = md.rendered(table(spark, sf_dir, "embeddings")).limit(12).collect()
    rows = [tuple(r) for r in rows] + [(1000 + k, *tuple(r)[1:]) for k, r in enumerate(rows[:5])] + [(None, *tuple(rows[0])[1:])]
    images = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary").cache()
    queries = md.edited(images.where("image_id < 1000"))
    got = md.copies_and_classes(queries, images).collect()
    classes = [(r["image_id"], r["class_id"]) for r in got if r["query_id"] is None]
    least = {}
    for i, *pixels in rows:
        if i is not None:
            least[tuple(pixels)] = min(i, least.get(tuple(pixels), i))
    key = lambda x: (x[0] is None, x)
    assert sorted(classes, key=key) == sorted(((i, None if i is None else least[tuple(p)]) for i, *p in rows), key=key)
    pairs = sorted((r["query_id"], r["image_id"], r["inliers"]) for r in got if r["query_id"] is not None)
    monkeypatch.setattr(md, "BLOCK", 100)
    monkeypatch.setattr(md, "AT_ONCE", 50)
    assert pairs and pairs == sorted((r["query_id"], r["image_id"], r["inliers"]) for r in md.find_copies(queries, images).collect())


def test_crowded_keys_take_on_bits_and_no_corner_is_dropped():
    """What meets under a key stays about as much when the corners under one chunk become four times as many; equal corners stay together."""
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (20_000, md.BITS)).astype(np.uint8)
    bits[:, : md.CHUNK] = 0  # one chunk is the same everywhere
    met = []
    for n in (5_000, 20_000):
        packed = np.packbits(bits[:n], axis=1)
        for keys in (md.Keys(packed), md.Keys(packed[: n // 2], 0.5)):
            own = keys.of(packed).reshape(-1, md.TABLES)
            counts = np.unique(own[:, 0], return_counts=True)[1]
            met.append((counts**2).sum() / n)
            assert own.shape == (n, md.TABLES) and counts.sum() == n and counts.max() <= 2 * md.CROWD
            assert len(set(own[:, 0].tolist()) & set(own[:, 1].tolist())) == 0
    assert max(met) <= 2 * md.CROWD
    same = np.packbits(np.repeat(bits[:1], 300, 0), axis=1)
    keys = md.Keys(same)
    assert len(np.unique(keys.of(same))) == md.TABLES and len(keys.crowded) == md.LEVELS
    rows = md.Queries([(k, np.zeros((1, 4), "<f4").tobytes(), bytes(b)) for k, b in enumerate(same)])
    rows.prepare(keys)
    assert rows.tables[2].tolist() == [300] * md.TABLES and len(rows.tables[3]) == 300 * md.TABLES


@pytest.mark.parametrize("sample", [400_000, 1_000])
def test_copies_are_found_by_long_keys_too_in_any_blocks(spark, sf_dir, monkeypatch, sample):
    images = spark.createDataFrame(md.rendered(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(90)).collect(), md.IMAGES).cache()
    queries = md.edited(images).cache()
    f = lambda df: {r["image_id"]: (np.frombuffer(r["geometry"], "<f4").reshape(-1, 4), md.rows_of(r["bits"])) for r in md.descriptors(df).collect()}
    index, asked = f(images), f(queries)
    brute = {(k, k) for k, (g, b) in asked.items() if md.consensus(g, b, *index[k])[0] >= md.LEAST_INLIERS}
    for name, value in (("CROWD", 2), ("SEEN", 2), ("SAMPLE", sample)):
        monkeypatch.setattr(md, name, value)
    keys = md.fitted(md.descriptors(queries))
    assert len(keys.crowded) >= 3
    found = []
    for size in (400_000, 300):
        monkeypatch.setattr(md, "BLOCK", size)
        found.append(sorted((r["query_id"], r["image_id"], r["inliers"]) for r in md.find_copies(queries, images.repartition(3)).collect()))
    assert found[0] == found[1] and len(brute & {x[:2] for x in found[0]}) >= 0.95 * len(brute) > 60


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after_df = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert sorted(after_df.columns) == sorted(docs.columns)
        after = {r["doc_id"] for r in after_df.select("doc_id").collect()}
        assert after <= before and len(after) > 0.3 * len(before), name
        docs, before = after_df, after
    from rallyframe.llm.near_dedup import near_dedup

    assert near_dedup(docs).where("not kept").count() <= 2  # redaction may make two texts alike
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in rows} == before
    for r in rows[:100]:
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def _plain_pipeline(rows, items, toxic):
    """The stages but packing in plain Python, by the rules stated: rows (doc_id, text, n_chars), the toxic texts given."""
    import re

    from rallyframe.llm import decontamination as dc
    from rallyframe.llm import secrets as se
    from rallyframe.llm.words import blank_words, hashes_of, letter_words

    rows = [r for r in rows if r[1] not in toxic]

    def shingles(text):
        w = blank_words(text or "")
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    rows = [r for r, g, s in zip(rows, group, sets) if r[0] is None or not s or r[0] == least[g]]
    theirs = [hashes_of(letter_words(t or "")) for t in items]

    def clean(text):
        mine = hashes_of(letter_words(text or ""))
        return not any(dc.verified(mine, t, d) for t in theirs if len(t) for d in range(-len(t) + 1, len(mine)))

    rows = [r for r in rows if clean(r[1])]
    measure = se.Novelty([])
    out = []
    for i, text, n in rows:
        spans = se.pattern_spans(text) + measure.spans(text) if text else []
        covered = sorted({k for _, s, e in spans for k in range(s, e)})
        new = text if not spans else re.sub("\\0+", "[REDACTED]", "".join("\0" if k in set(covered) else c for k, c in enumerate(text)))
        out.append((i, new, n if new == text else len(new)))
    return out


def test_stages_against_a_plain_pipeline(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns; and empty tables."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(400)]
    some = lambda n: " ".join(rng.choice(words, n))
    item, base = some(30), some(40)
    rows = [(1, None), (2, ""), (3, base), (4, base.upper()), (5, base), (5, base), (None, base), (None, None), (6, some(20) + " " + item + " " + some(9)), (7, f"{some(12)} password = abcdefgh12345678 and auth bearer Zx9Kq2vL7pW4mN8rT1yB5c {some(9)}"), (8, some(30_000)), (9, "x" * 50_000), (10, some(4)), (11, some(25)), (None, item)]
    rows += [(100 + k, some(15) + " vile filthword scum") for k in range(24)] + [(200 + k, some(15)) for k in range(24)]
    toxic_texts = {t for i, t in rows if i is not None and 100 <= i < 200}
    schema = "doc_id long, text string, lang string, source string, n_chars long, keys string, _gone long, same string"
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", 1, None) for i, t in rows], schema).repartition(3)
    labels = [(i, None, int(100 <= i < 200)) for i, _ in rows if i is not None and i >= 100] + [(None, 1, 1), (3, 1, None)]
    for name, df in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, got, str(tmp_path)), f"test-{name}")
        assert after.columns == docs.columns, name
        got = after
    want = _plain_pipeline([(i, t, None if t is None else len(t)) for i, t in rows], [item, None, ""], toxic_texts)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=key) == sorted(want, key=key)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in want)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
