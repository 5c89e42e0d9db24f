"""The corpus pipeline: toxic documents go, then exact copies, then near copies; what is left is mixed to the sources'
target weights and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import default_vocabulary, encode_and_digest
from tidemark.llm.common import table, written
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.simhash import drop_near_copies
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model is fitted on the labelled documents of the stage's input.
    Null and empty texts score by the bias alone; null ids are judged like others; equal texts go or stay alike; an
    empty table stays empty; without labels of both kinds nothing, or everything, is toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id. Null texts count as empty; null ids
    rank lowest; of rows that repeat an id and a text one stays; an empty table stays empty."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more, directly or over others),
    the document with the smallest id. Null and blank texts and null ids stay; rows of one id stay or go together; an
    empty table stays empty."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document that the mix takes, with the words that the pass takes. Null and blank
    texts have no words and go; a null source is a source of its own; rows with null or repeated ids are rows of their
    own; an empty table stays empty. The operator can name the output shard of each row; the stage's rows have the
    columns of documents only."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's ids and of their decoding. Null and empty texts have no tokens; null ids
    and repeated rows stay rows of their own; an empty table gives no rows."""
    return encode_and_digest(docs, *default_vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Trained scores, sketches, seeded draws and a vocabulary: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
