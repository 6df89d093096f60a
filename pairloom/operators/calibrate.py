"""Operating points: thresholds and k chosen on one set of pairs and frozen for another."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rough, similarity
from .metrics import class_counts, is_match, quantile_bin, ratio, totals, with_positives

#: Width of the bins in which a threshold is searched first.
WIDTH = 1e-4


def _operating_points(bins: DataFrame, exact: Callable[[list[tuple[float, float]]], DataFrame], total: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the highest threshold that reaches it. ``bins`` has counts by bin (bin, n, tp, low, high), at most
    2 / WIDTH rows; the target's threshold is in the first bin, from above, by whose end it is reached, so only the scores
    of that bin are looked at one by one: ``exact`` gives them for spans (score, n, tp)."""
    spark, sums = total.sparkSession, total.first()
    positives, possible = sums["positives"] or 0, sums["possible"] or 0
    places, pairs, found = {}, 0, 0
    for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
        for t in targets:
            if t not in places and found + r["tp"] >= t * positives - 1e-9:
                places[t] = (float(t), r["low"], r["high"], pairs, found)
        pairs, found = pairs + r["n"], found + r["tp"]
    wanted = spark.createDataFrame([(float(t),) for t in targets], "target double")
    if places:
        spans = F.broadcast(spark.createDataFrame(list(places.values()), "target double, low double, high double, above long, had long"))  # a row a target
        inside = exact(sorted({x[1:3] for x in places.values()})).join(spans, F.col("score").between(F.col("low"), F.col("high")))
        down = Window.partitionBy("target").orderBy(F.desc("score"))  # the scores of one bin
        upto = inside.select("target", "score", (F.col("above") + F.sum("n").over(down)).alias("pairs"), (F.col("had") + F.sum("tp").over(down)).alias("found"))
        hit = upto.where(F.col("found") >= F.col("target") * positives - 1e-9).groupBy("target").agg(F.max("score").alias("threshold"), F.min("pairs").alias("pairs"), F.min("found").alias("found"))
    else:
        hit = spark.createDataFrame([], "target double, threshold double, pairs long, found long")
    return _points(wanted.join(hit, "target", "left"), positives, possible)


def _points(out: DataFrame, positives: int, possible: int) -> DataFrame:
    return out.select("target", "threshold", F.col("pairs").alias("candidate_pairs"), F.col("found").alias("true_positives"), F.round(F.col("found") / F.lit(positives), 6).alias("pair_completeness"), F.round(F.col("found") / F.col("pairs"), 6).alias("pair_quality"), F.round(1 - F.col("pairs") / F.lit(possible), 6).alias("reduction_ratio"), F.col("threshold").isNotNull().alias("attained"))


def target_operating_points(pairs: DataFrame, counts: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the highest threshold whose pairs have that share of the true ones; null where none has. Equal scores
    stand or fall together."""
    counts = with_positives(counts)
    rows = pairs.join(counts.select("query_id"), "query_id", "left_semi")
    sums = (F.count(F.lit(1)).alias("n"), F.count_if(is_match()).alias("tp"))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(round(2 / WIDTH)), F.bround((F.col("score") + 1) / WIDTH)))
    bins = rows.groupBy(bin_.cast("long").alias("bin")).agg(*sums, F.min("score").alias("low"), F.max("score").alias("high"))

    def exact(spans: list[tuple[float, float]]) -> DataFrame:
        inside = F.lit(False)
        for low, high in spans:
            inside |= F.col("score").between(low, high)
        return rows.where(inside).groupBy("score").agg(*sums)

    return _operating_points(bins, exact, totals(counts), targets)


def joined_operating_points(queries: DataFrame, candidates: DataFrame, targets: list[float]) -> DataFrame:
    """target_operating_points of all pairs of (id, class, vector) on both sides, counted where they arise."""
    counts = with_positives(class_counts(queries, candidates))
    mine = counts.select(F.col("query_id").alias("id"))
    asked, spark, sums = queries.join(mine, "id", "left_semi"), queries.sparkSession, totals(counts).first()
    positives, possible = sums["positives"] or 0, sums["possible"] or 0
    needs = {float(t): math.ceil(t * positives - 1e-9) for t in targets}
    if min(needs.values(), default=0) > 0:
        alone, from_ = queries.count() - sums["n_queries"], asked
        if queries is candidates and 4 * alone < sums["n_queries"]:  # else half of all pairs are more than those of ``asked``
            from_, alone = queries, queries.join(mine, "id", "left_anti") if alone else None
        else:
            alone = None
        found = rough.operating_points(from_, candidates, needs, WIDTH, alone)
        hit = spark.createDataFrame(found, "target double, threshold double, pairs long, found long")
        return _points(spark.createDataFrame([(float(t),) for t in targets], "target double").join(F.broadcast(hit), "target", "left"), positives, possible)
    return _operating_points(similarity.score_bins(asked, candidates, quantile_bin(WIDTH)), lambda spans: similarity.scores_between(asked, candidates, spans), totals(counts), targets)


def transferred(points: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Frozen thresholds (target, threshold) applied to other pairs, not searched again: what they reach there."""
    frozen = _frozen(points)
    rows = pairs.join(with_positives(counts).select("query_id"), "query_id", "left_semi").withColumn("hit", is_match())
    aggregates = [x for k, t in enumerate(_thresholds(frozen)) for x in (F.count_if(F.col("score") >= t).alias(f"n{k}"), F.count_if((F.col("score") >= t) & F.col("hit")).alias(f"t{k}"))]
    return _reached(frozen, rows.agg(F.count(F.lit(1)).alias("all"), *aggregates), counts)


def joined_transferred(points: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """transferred to all pairs of (id, class, vector) on both sides, counted where they arise."""
    frozen, counts = _frozen(points), class_counts(queries, candidates)
    if not _thresholds(frozen):
        return _reached(frozen, queries.sparkSession.range(1), counts)
    per = similarity.score_counts(queries, candidates, _thresholds(frozen)).join(with_positives(counts).select("query_id"), "query_id", "left_semi")
    return _reached(frozen, per.agg(F.count(F.lit(1)).alias("all"), *[F.coalesce(F.sum(f"{c}{k}"), F.lit(0)).alias(f"{c}{k}") for k in range(len(_thresholds(frozen))) for c in "nt"]), counts)


def _frozen(points: DataFrame) -> list:
    return sorted(points.select("target", "threshold").collect(), key=lambda r: (r["threshold"] is None, r["target"]))  # a row a target, nulls last


def _thresholds(frozen: list) -> list[float]:
    return [r["threshold"] for r in frozen if r["threshold"] is not None]


def _reached(frozen: list, got: DataFrame, counts: DataFrame) -> DataFrame:
    """Of one row of counts by threshold: a row for each frozen point."""
    point = lambda k, r: F.struct(F.lit(r["target"]).alias("target"), F.lit(r["threshold"]).cast("double").alias("threshold"), *[(F.col(f"{c}{k}") if r["threshold"] is not None else F.lit(None)).cast("long").alias(c) for c in "nt"])
    out = got.select(F.explode(F.array(*[point(k, r) for k, r in enumerate(frozen)])).alias("p")).select("p.*").join(F.broadcast(totals(with_positives(counts))))  # one row
    reached = ratio(F.col("t"), F.col("positives"))
    return out.select("target", "threshold", F.col("n").alias("candidate_pairs"), F.col("t").alias("true_positives"), F.round(reached, 6).alias("pair_completeness"), F.round(reached - F.col("target"), 6).alias("calibration_error"), F.coalesce(reached >= F.col("target") - 1e-12, F.lit(False)).alias("attained"))


def calibrated_k(metrics: DataFrame, targets: list[float], fallback: bool = False) -> DataFrame:
    """For each target the smallest k of top_k_metrics that reaches it: target, k, status. Where none does, k is null, or
    with ``fallback`` the largest k, marked as such."""
    rows = metrics.select("k", "pair_completeness")
    wanted = rows.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    ok = F.col("pair_completeness") >= F.col("target") - 1e-12
    got = wanted.join(rows).groupBy("target").agg(F.min(F.when(ok, F.col("k"))).alias("best"), F.max("k").alias("last"))  # targets by ks
    k = F.coalesce("best", "last") if fallback else F.col("best")
    status = F.when(F.col("best").isNotNull(), "attained").otherwise("least_restrictive" if fallback else "target_not_attained")
    return got.select("target", k.alias("k"), status.alias("status"))


def leaked(calibration: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys that both sets have; a protocol that calibrates on one and reports the other needs none."""
    return calibration.select(key).intersect(test.select(key))
