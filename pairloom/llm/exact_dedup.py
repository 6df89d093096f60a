"""Exact deduplication by skew-safe combining.

Three stages, each of which compares whole texts, the digest only dealing them out:

1. every task combines the equal texts among its own rows (the map side of the first aggregation),
2. the survivors of a digest meet in one of ``salts`` groups, dealt by the task that made them,
3. the at most ``salts`` winners of each text are combined globally.

However many copies a text has, a task sends one row of it, and the last stage gets at most ``salts`` rows of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, small, written

#: A group with a larger share of all rows than one in so many is broadcast: there can't be more such groups than this.
HOT_GROUPS = 256


def text_groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each distinct text of ``docs`` (doc_id, norm, digest): digest, keep_id, group_size."""
    dealt = docs.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = dealt.groupBy("salt", "digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return winners.select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays.
    A null text counts as empty; empty texts are equal to each other. A null id is smaller than all others, and a group
    of nothing but null ids has a null keep_id and keeps its rows. The id names the row: repeated rows with the winning
    id are all marked as kept. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    keyed = keyed.withColumn("digest", F.sha2("norm", 256))
    copies = written(text_groups(keyed, salts).where("group_size > 1"), "copies")
    total = docs.count()
    # Only rows with copies look up their group. The rows of the few largest groups find it in a broadcast table of at
    # most HOT_GROUPS rows and then leave the join's key, so that no key of the shuffled join has many rows.
    large = copies.where(F.col("group_size") * HOT_GROUPS > total).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    small = copies.where(F.col("group_size") * HOT_GROUPS <= total).select(F.col("digest").alias("key"), "keep_id", "group_size")
    rows = keyed.select("doc_id", "digest").join(F.broadcast(large), "digest", "left")
    rows = rows.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id"))))
    rows = rows.join(small, "key", "left")
    size = F.coalesce("hot_size", "group_size", F.lit(1))
    keep = F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("digest").alias("text_sha256"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that exact_dedup keeps, with all their columns.

    A dropped row is found again by its id and a hash of its text, so that of rows that repeat an id only those with a dropped
    text go; rows that repeat both the winning id and its text all stay, as do rows of a group of nothing but null ids.
    Columns may have any names.
    """
    normal = ascii_lower(F.coalesce(F.col("pairloom_row.text"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("pairloom_row"))
    found = exact_dedup(docs, salts=salts).where("not kept").select(F.col("doc_id").alias("dropped_id"), F.substring("text_sha256", 1, 16).alias("dropped_text"))
    dropped = written(found.distinct(), "dropped")
    same = F.col("pairloom_row.doc_id").eqNullSafe(F.col("dropped_id")) & (F.substring(F.sha2(normal, 256), 1, 16) == F.col("dropped_text"))
    return rows.join(small(dropped), same, "left_anti").select("pairloom_row.*")
