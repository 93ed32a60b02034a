"""The corpus pipeline: what of the documents a training run gets, and in which form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.bpe import encode_public
from rowmill.llm.common import forget, written
from rowmill.llm.exact_dedup import drop_copies
from rowmill.llm.mixing import repeat_documents
from rowmill.llm.ngram_join import drop_near_copies
from rowmill.llm.toxicity import drop_toxic
from rowmill.session import table


# Of every stage: documents keep all their columns, whatever their names, but in the last one; NULL counts as an empty
# text; an empty table gives an empty one.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Repeated rows stay or go together; empty texts stay, unless labelled texts
    are all toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest doc_id; of repeated rows, or of a group
    without doc_id, any one. Empty texts are a group."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: five-word shingles, similarity of
    0.8. Texts without words and rows without doc_id stay."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target says. NULL is a source; texts without words go."""
    return repeat_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mix, of its whole text; one row for each repetition."""
    return encode_public(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote, and then that is deleted. What the last one
    reads stays until the folder of ``spark.checkpoint.dir`` is cleaned."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = written(lambda stage=stage, before=before: stage(spark, before, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
