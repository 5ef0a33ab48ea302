"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before kept; its
result is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Empty tables pass through every stage; extra columns stay until the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentmeter.llm import decontam, langid, mixing, neardup, pii
from agentmeter.llm.common import fold, forget, packed, saved, small_batches, table
from agentmeter.llm.queries import pieces

#: The least posterior of the language that a document is kept with.
LEAST_LANGUAGE = 0.3


def in_order(docs: DataFrame) -> list:
    """The columns of docs from a row that holds text and the others in a struct own, so that no result's name meets theirs."""
    return [F.col("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no likely language; learns from those that name theirs.

    The posterior compares the learned languages with each other only; the gauge says of a text whether
    any of them fits it.
    """
    small_batches(spark)
    model = langid.fit(docs, pieces(), fold(F.col("doc_id"), 4) != 2, gauge=True)
    if not model.langs:  # nothing to tell languages by: only texts without letters go
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = langid.identify(docs.select(packed(docs.drop("text")).alias("own"), "text"), model)
    kept = judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE) & F.col("likely"))
    return kept.select(*in_order(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return neardup.deduplicated(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more is benchmark text."""
    found = decontam.find(docs.select(packed(docs.drop("text")).alias("own"), "text"), table(spark, sf_dir, "benchmark"))
    return found.filter("not found.contaminated").select(*in_order(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: No SQL expresses the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
            forget(before)
    return docs
