"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyframe.llm.chat import chat_formatting
from rallyframe.llm.common import table
from rallyframe.llm.decontamination import overlaps
from rallyframe.llm.licenses import license_scan
from rallyframe.llm.media import copies_and_classes, edited, rendered
from rallyframe.llm.near_dedup import near_dedup
from rallyframe.llm.packing import best_fit_pack
from rallyframe.llm.phrases import top_phrases
from rallyframe.llm.quality import quality
from rallyframe.llm.secrets import secret_spans
from rallyframe.llm.spelling import spelling_variants
from rallyframe.llm.token_counts import token_counts
from rallyframe.llm.token_output import token_output
from rallyframe.llm.toxicity import toxicity


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", threshold=0.3)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=1024)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", threshold=0.7)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), 2048, "byte_bpe_50k.json")


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied tables hold no pictures: each vector of ``embeddings`` is drawn as one.  The query set is the
    edited pictures of the ids divisible by 50, against all; beside the pairs stands every row's class."""
    images = rendered(table(spark, sf_dir, "embeddings"))
    return copies_and_classes(edited(images.where("image_id % 50 = 0")), images)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more of two turns whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_formatting(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(table(spark, sf_dir, "documents"), top=2000, least=30, share=80)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_toxicity,
        op3_token_counts,
        op4_quality,
        op5_license_scan,
        op6_secret_scan,
        op7_minhash_dedup,
        op8_decontamination,
        op9_best_fit_packing,
        op10_image_copies,
        op11_chat_formatting,
        op12_phrases,
        op13_spelling_variants,
    )
}
ORACLES: dict[str, str] = {
    "op7_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * common >= 75 * (na.n + nb.n - common)),
ends AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ends.y, r.c FROM r JOIN ends ON ends.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)""",
    "op11_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(regexp_extract_all(role || chr(1) || text, '<\\*(?:/?s>|\|(?:im_start|im_end|endoftext|system|user|assistant|turn|body|end)\|>)|\[\\*/?INST\]')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|><|body|><|end|>') + length(role) + length(text) + escapes)::BIGINT AS formatted_chars, true AS history_kept
FROM e GROUP BY conv_id""",
    "op12_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT lang, ws[i:i + k - 1] AS p, k FROM g, (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, p, k, count(*) AS a FROM p GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.p, c.k, c.a, j, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:j] JOIN f r ON r.lang = c.lang AND r.p = c.p[j + 1:c.k]),
best AS (SELECT lang, p, k, a, arg_min(l, score * 10 + j) AS l, arg_min(r, score * 10 + j) AS r, min(score) AS score FROM cuts GROUP BY ALL),
inside AS (SELECT DISTINCT c.lang, c.a, c.p[i:i + w - 1] AS p FROM c, (VALUES (2), (3)) v(w), (VALUES (1), (2), (3)) u(i) WHERE w < c.k AND i + w - 1 <= c.k),
most AS (SELECT lang, p, max(a) AS a FROM inside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN most USING (lang, p) WHERE most.a IS NULL OR 100 * most.a < 80 * best.a),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
