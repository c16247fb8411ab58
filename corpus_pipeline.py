"""A pipeline over documents: quality, near copies, personal data, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import byte_bpe, jaccard, mixing, pii, quality
from treeline.llm.common import Scratch, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the text as it now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, trained on labels, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five words."""
    return jaccard.without_near_copies(docs, n=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind."""
    return _counted(pii.redact(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return _counted(mixing.mixed_documents(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document of the mix, and decoded_sha256 of the text that its ids give back."""
    import public_tokenizers

    of = public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN
    return byte_bpe.encode_and_decode(docs, *of)


STAGES = [
    ("quality", good_documents),
    ("near_copies", without_near_copies),
    ("personal_data", without_personal_data),
    ("mix", mixed_sources),
    ("tokens", token_ids),
]

#: Components of near copies and the trained classifier aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
