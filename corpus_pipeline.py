"""From raw documents to packed sequences: quality rules, near-duplicates, PII, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import mixing, ngram_join, packing, pii, quality_rules
from docspark.llm.staging import mark, read_table, release_since, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    Null and empty texts are rejected, very long ones judged whole, repeated rows
    alike; a value equal to a threshold passes. An empty table stays empty.
    """
    return quality_rules.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: of rows that tie, the smallest id, then the first text.

    Of repeated rows one stays, and one of all null and empty texts; very long
    texts are compared whole. An empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes placeholders; ``n_chars`` follows the text.

    No row goes: null and empty texts stay, very long ones are masked whole,
    repeated rows alike; where spans begin alike, the longest is one placeholder.
    """
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


#: The mixture's budget, as a part of the tokens there are, and how often a document may come.
FRACTION, EPOCHS = 0.8, 1


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, fraction: float = FRACTION, max_epochs: int = EPOCHS) -> DataFrame:
    """Sources at their target weights within ``fraction`` of the tokens there are, no document more than ``max_epochs`` times.

    Null and empty texts have no tokens of their own; a very long text is taken
    whole or not; repeated rows are in or out together. An empty table stays empty.
    """
    return mixing.resample(docs, mixing.corpus_tree(), mixing.corpus_weights(), fraction=fraction, max_epochs=max_epochs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets.

    Null and empty texts are one piece of one id, very long ones are cut, repeated
    rows packed each; pieces of one length are dealt by id, number and checksum.
    An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str, fraction: float = FRACTION, max_epochs: int = EPOCHS) -> DataFrame:
    """All stages over ``documents``; ``fraction`` and ``max_epochs`` are the mixture's."""
    docs, point = read_table(spark, sf_dir, "documents"), mark()
    for name, function in STAGES[:-1]:
        more = {"fraction": fraction, "max_epochs": max_epochs} if function is mixture else {}
        docs = stage(function(spark, docs, sf_dir, **more), name)
        release_since(point, spark, [docs])  # all that this stage was made of
    return STAGES[-1][1](spark, docs, sf_dir)


#: The order of mixing and the tokenizer's ids have no SQL form.
ORACLE_SQL = None
