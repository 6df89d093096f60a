"""What random candidates would give, from the classes' sizes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import with_positives


def expected_top_k(counts: DataFrame, ks: list[int]) -> DataFrame:
    """Expected hits of k random candidates a query, hypergeometric: k, candidate_pairs, expected_hits, pair_quality,
    pair_completeness, macro_recall."""
    grid = with_positives(counts).select("n_candidates", "n_positives", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    grid = grid.withColumn("drawn", F.least("k", "n_candidates"))
    hits = F.col("drawn") * F.col("n_positives") / F.col("n_candidates")
    out = grid.groupBy("k").agg(F.sum("drawn").alias("candidate_pairs"), F.sum(hits).alias("h"), F.sum("n_positives").alias("p"), F.avg(hits / F.col("n_positives")).alias("r"))
    return out.select("k", "candidate_pairs", F.round("h", 6).alias("expected_hits"), F.round(F.col("h") / F.col("candidate_pairs"), 6).alias("pair_quality"), F.round(F.col("h") / F.col("p"), 6).alias("pair_completeness"), F.round("r", 6).alias("macro_recall"))


def expected_f1(counts: DataFrame, ks: list[int]) -> DataFrame:
    """Expected F1 of k random candidates, macro over queries. Queries of equal sizes have the same value, so the sum over
    the hypergeometric distribution is made once for each pair of sizes, in logs."""
    shapes = with_positives(counts).groupBy("n_candidates", "n_positives").agg(F.count(F.lit(1)).alias("queries"))
    rows = shapes.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).withColumn("d", F.least("k", "n_candidates"))
    rows = rows.withColumn("hits", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("d") - F.col("n_candidates") + F.col("n_positives")), F.least(F.col("d").cast("long"), F.col("n_positives")))))

    def log_choose(n: Column, k: Column) -> Column:
        """log C(n, k) as a sum of k terms; k is at most the largest of ``ks``."""
        terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
        pairs = F.zip_with(terms, F.array_repeat((n - k).cast("double"), k.cast("int")), lambda i, r: F.log((r + i) / i))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    weight = F.exp(log_choose(F.col("n_positives"), F.col("hits")) + log_choose(F.col("n_candidates") - F.col("n_positives"), F.col("d") - F.col("hits")) - log_choose(F.col("n_candidates"), F.col("d").cast("long")))
    f1 = 2 * F.col("hits") / (F.col("k") + F.col("n_positives"))
    per = rows.groupBy("k", "n_candidates", "n_positives", "queries").agg(F.sum(weight * f1).alias("f"))
    return per.groupBy("k").agg(F.round(F.sum(F.col("f") * F.col("queries")) / F.sum("queries"), 6).alias("expected_f1"))


def prevalence(counts: DataFrame) -> DataFrame:
    """The quality of random candidates at any completeness: the share of true pairs among all."""
    return with_positives(counts).agg(F.sum("n_positives").alias("positives"), F.sum("n_candidates").alias("possible"), F.round(F.sum("n_positives") / F.sum("n_candidates"), 6).alias("prevalence"))
