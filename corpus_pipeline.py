"""The corpus pipeline: documents through toxicity, near-dedup, decontamination, secrets and packing.

Each stage gets what the one before kept, written as a table and read again; all but the last return
the columns of documents, whatever extra ones those have.  Rows are decided one by one or with their
group, never by position, so ties and repeated rows are treated alike; an empty table passes through
every stage.  Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallyframe.llm.common import discard, mark, materialise, table
from rallyframe.llm.decontamination import reject_contaminated
from rallyframe.llm.near_dedup import keep_first
from rallyframe.llm.packing import best_fit_pack
from rallyframe.llm.secrets import redact_secrets
from rallyframe.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts have the score of a text without evidence; equal texts share their fate; null ids
    are scored but never learned from.
    """
    return reject_toxic(docs, table(spark, sf_dir, "labels"), "toxic", threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null and empty texts are like nothing and stay; rows that repeat the smallest id all stay; rows with a null
    id stay, as no id can name them.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Null and empty texts stay; the text alone decides, so repeated rows and null ids go or stay by their texts.
    """
    return reject_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted and n_chars set anew where they were; every row stays, null and empty texts as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048.

    A null or empty text is its end id alone; repeated rows give repeated pieces; an empty table gives none.
    """
    return best_fit_pack(docs, 2048, "byte_bpe_50k.json")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's interim tables go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since, before = mark(), docs
        docs = materialise(stage(spark, before, sf_dir), f"stage-{name}")
        discard(spark, since, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
