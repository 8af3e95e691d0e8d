"""A training corpus from raw documents: toxicity, near duplicates, benchmark passages, secrets, packing.

Texts of any length are read whole by every stage; columns beside those of documents may have any names, and all but the last stage keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatloom.llm import decontaminate, jaccard, packing, secrets, toxicity
from heatloom.llm.common import table, written
from heatloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole texts aren't scored as toxic; the model is fitted on the labelled ones among them.

    Null and empty texts have the score of no evidence and stay; repeated rows and ids are scored alike; an empty table gives none.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word Jaccard similarity 0.8) the document of the smallest id.

    Null texts are empty, texts without words one group; of rows of one id one stays, rows of a null id all stay; an empty table gives none.
    """
    return jaccard.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by its own text, so repeated rows and ids go or stay by it; null and empty texts stay; an empty table gives none.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets; null texts stay null, empty ones empty, repeated rows alike, an empty table gives none."""
    return secrets.redact_secrets(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts have their end token alone; repeated rows and ids are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]

#: SQL can't express fitted models, fingerprints or a tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
