"""A corpus pipeline: documents without toxic ones, copies and near copies, mixed to source weights, packed.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a DataFrame; ``run``
writes each stage's rows as Parquet in the shared folder and reads them again for the next.

Every stage takes whole texts, a null one counting as empty, and gives an empty table for an empty one; all but the last
return the columns of their docs, whatever others these have. What a stage does with null or repeated ids is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from pairloom.llm.queries import vocabulary
from pairloom.llm.shared import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Each row is judged by its text alone, whatever its id; an empty text isn't toxic."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label")
    return toxicity.drop_toxic(docs, labels)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, empty ones too, the one with the largest id. Rows that repeat that id and the text stay; a
    null id is smaller than all others, and where a text has no other id its rows stay."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links, the one with the smallest id. A text without words, or a row without an id, links with
    nothing and stays; rows that repeat an id count as one document and stay or go together."""
    return jaccard_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times, each row by itself, whatever its id. A text without words is
    not taken; rows without a source are a source of their own."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 4,096 tokens, as packing.pack gives them, of every row, whatever its id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("source mix", mixed),
    ("packing", packed),
]
#: Boosted trees and tokenizers are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
