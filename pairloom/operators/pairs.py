"""The life of a pair: directed hits, merged pairs, verification, review, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered

#: Reasons for a candidate, in the order in which they are listed.
REASONS = ("exact_sha256", "threshold", "window")


def ordered_reasons(flags: dict[str, Column]) -> Column:
    """The reasons whose flag holds, in the order of REASONS, joined by semicolons."""
    return F.array_join(F.filter(F.array(*[F.when(flags[r], F.lit(r)) for r in REASONS if r in flags]), lambda x: x.isNotNull()), ";")


def merge_directed(hits: DataFrame, spread: float = 1e-5) -> DataFrame:
    """Directed hits (query_id, candidate_id, score, rank, by_threshold, by_window) as unordered pairs.

    a < b; mean score, the rank from either side, whether it was retrieved from either, and its reasons. Scores of one pair
    that differ by more than ``spread`` are an error.
    """
    from_a = F.col("query_id") < F.col("candidate_id")
    rows = hits.withColumn("a", F.least("query_id", "candidate_id")).withColumn("b", F.greatest("query_id", "candidate_id")).withColumn("from_a", from_a)
    merged = rows.groupBy("a", "b").agg(
        F.avg("score").alias("score"),
        (F.max("score") - F.min("score")).alias("spread"),
        F.min(F.when(F.col("from_a"), F.col("rank"))).alias("rank_a_to_b"),
        F.min(F.when(~F.col("from_a"), F.col("rank"))).alias("rank_b_to_a"),
        F.bool_or("from_a").alias("retrieved_from_a"),
        F.bool_or(~F.col("from_a")).alias("retrieved_from_b"),
        F.bool_or("by_threshold").alias("t"),
        F.bool_or("by_window").alias("w"),
    )
    score = F.when(F.col("spread") > spread, F.raise_error(F.lit("scores of one pair differ"))).otherwise(F.round("score", 6))
    reasons = ordered_reasons({"threshold": F.col("t"), "window": F.col("w")})
    return merged.select("a", "b", score.cast("double").alias("score"), "rank_a_to_b", "rank_b_to_a", "retrieved_from_a", "retrieved_from_b", reasons.alias("reasons"))


def equal_content(rows: DataFrame, left: Column | None = None, right: Column | None = None) -> DataFrame:
    """Pairs a < b of (id, sha): of one set, or of rows of ``left`` with rows of ``right``, when their hash is equal."""
    one = (rows if left is None else rows.where(left)).select(F.col("id").alias("a"), "sha")
    two = (rows if right is None else rows.where(right)).select(F.col("id").alias("b"), "sha")
    return one.join(two, "sha").where("a < b" if left is None else "a <> b").select("a", "b", "sha")


def reason_counts(merged: DataFrame) -> DataFrame:
    return merged.select(F.explode(F.split("reasons", ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("pairs"))


def blocking_union(blocks: dict[str, DataFrame]) -> DataFrame:
    """Pairs (a, b, score) of several blockings: a, b, sorted reasons, best score."""
    rows = None
    for name, df in sorted(blocks.items()):
        own = df.select("a", "b", F.col("score").cast("double"), F.lit(name).alias("reason"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"), F.round(F.max("score"), 6).alias("score"))


def latest_decisions(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of an append-only log (decision) for each key; ``order`` is the clock."""
    last = F.max_by("decision", F.struct(*order))
    return log.groupBy(*key).agg(last.alias("decision"), F.count(F.lit(1)).alias("events"))


def decided(pairs: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    return pairs.join(decisions, key, "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def review_queue(candidates: DataFrame, outcomes: DataFrame, images: DataFrame, include_all: bool = False, others: DataFrame | None = None) -> DataFrame:
    """Verified pairs worth a review, with both images: status ok, and positive, or of equal content, or ``include_all``.

    candidates (a, b, score, same), outcomes (a, b, status, prediction), images (id, name). Where a and b are of two sets whose
    ids may meet, ``images`` are those of a and ``others`` those of b.
    """
    worth = (F.col("status") == "ok") & (F.lit(include_all) | F.col("same") | (F.col("prediction") == 1))
    one = images.select(F.col("id").alias("a"), F.col("name").alias("a_name"))
    two = (images if others is None else others).select(F.col("id").alias("b"), F.col("name").alias("b_name"))
    return candidates.join(outcomes, ["a", "b"]).where(worth).join(one, "a").join(two, "b").select("a", "b", "a_name", "b_name", "score", "same", "prediction")


def unmatched(outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Outcomes of pairs that aren't candidates; a review needs none."""
    return outcomes.join(candidates.select("a", "b"), ["a", "b"], "left_anti")


def export_classes(members: DataFrame) -> DataFrame:
    """Keepers of clusters with contiguous class numbers by sorted component: (id, component, is_keeper) to class_id, id,
    n_excluded, excluded (sorted ids, by semicolons)."""
    per = members.groupBy("component").agg(F.max(F.when(F.col("is_keeper"), F.col("id"))).alias("id"), F.array_sort(F.collect_list(F.when(~F.col("is_keeper"), F.col("id")))).alias("out"))
    return numbered(per, [F.col("component")], "class_id").select("class_id", "id", F.size("out").cast("long").alias("n_excluded"), F.array_join(F.transform("out", lambda x: x.cast("string")), ";").alias("excluded"))


def best_source(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """For each key the one row that is first in ``order``: retry caches, duplicates, source precedence."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")
