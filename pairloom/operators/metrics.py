"""Metrics of blocking: what share of the true pairs a candidate set has (completeness), what share of it is true (quality),
how much smaller it is than all pairs (reduction), and for how many queries it has anything (coverage)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similarity


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return ratio((1 + b) * precision * recall, b * precision + recall)


def is_match() -> Column:
    return F.col("query_class") == F.col("candidate_class")


def class_counts(queries: DataFrame, candidates: DataFrame, exclude_self: bool = True) -> DataFrame:
    """For each query (id, class) its number of candidates and of true ones among them: query_id, query_class, n_candidates,
    n_positives. Counts come from the classes' sizes, no pair is made."""
    sizes = candidates.groupBy("class").agg(F.count(F.lit(1)).alias("m"))
    total = candidates.count()
    own = queries.join(candidates.select("id").withColumn("self", F.lit(1)), "id", "left") if exclude_self else queries.withColumn("self", F.lit(0))
    rows = own.join(sizes, "class", "left")
    mine = F.coalesce("self", F.lit(0))
    return rows.select(F.col("id").alias("query_id"), F.col("class").alias("query_class"), (F.lit(total) - mine).cast("long").alias("n_candidates"), (F.coalesce("m", F.lit(0)) - mine).cast("long").alias("n_positives"))


def with_positives(counts: DataFrame) -> DataFrame:
    """Queries that have a true pair; the others take no part in metrics."""
    return counts.where("n_positives > 0")


def totals(counts: DataFrame) -> DataFrame:
    """One row: n_queries, possible, positives."""
    return counts.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_candidates").alias("possible"), F.sum("n_positives").alias("positives"))


def _pooled(rows: DataFrame) -> list[Column]:
    tp, pairs = F.col("true_positives"), F.col("candidate_pairs")
    return [
        F.round(ratio(tp, pairs), 6).alias("pair_quality"),
        F.round(ratio(tp, F.col("positives")), 6).alias("pair_completeness"),
        F.round(1 - ratio(pairs, F.col("possible")), 6).alias("reduction_ratio"),
        F.round(ratio(F.col("covered"), F.col("n_queries")), 6).alias("query_coverage"),
    ]


def top_k_metrics(ranked: DataFrame, counts: DataFrame, ks: list[int]) -> DataFrame:
    """A row for each k. Macro precision divides by the k asked for, pooled counts by the pairs that there are. ``ranked`` are
    ranked pairs, or what similarity.top_counts gives for ``ks``."""
    counts = with_positives(counts)
    if "rank" not in ranked.columns:
        grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{j}").alias("n"), F.col(f"h{j}").alias("tp")) for j, k in enumerate(ks)])).alias("g")
        none = {f"{c}{j}": 0 for j in range(len(ks)) for c in "kh"}
        per = counts.select("query_id", "n_positives").join(ranked.select("query_id", *none), "query_id", "left").fillna(none)
        return _top_k_rows(per.select("query_id", "n_positives", grid).select("query_id", "n_positives", "g.*"), counts)
    grid = ranked.withColumn("hit", is_match().cast("long")).join(counts.select("query_id"), "query_id", "left_semi")
    grid = grid.select("query_id", "rank", "hit", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k")
    per = grid.groupBy("k", "query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("tp"))
    per = counts.select("query_id", "n_positives", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).join(per, ["k", "query_id"], "left").fillna(0, ["n", "tp"])
    return _top_k_rows(per, counts)


def _top_k_rows(per: DataFrame, counts: DataFrame) -> DataFrame:
    """Of a row for each k and query (k, query_id, n_positives, n, tp): a row for each k."""
    p, r = F.col("tp") / F.col("k"), F.col("tp") / F.col("n_positives")
    rows = per.groupBy("k").agg(
        F.sum("n").alias("candidate_pairs"),
        F.sum("tp").alias("true_positives"),
        F.count_if(F.col("n") > 0).alias("covered"),
        F.avg(p).alias("mp"),
        F.avg(r).alias("mr"),
        *[F.avg(f_beta(p, r, b)).alias(f"mf{k}") for k, b in enumerate((0.5, 1.0, 2.0))],
    )
    rows = rows.join(F.broadcast(totals(counts)))  # one row
    return rows.select(
        "k", "candidate_pairs", "true_positives", (F.col("candidate_pairs") - F.col("true_positives")).alias("false_positives"), (F.col("positives") - F.col("true_positives")).alias("false_negatives"), *_pooled(rows),
        F.round("mp", 6).alias("macro_precision"), F.round("mr", 6).alias("macro_recall"), F.round("mf0", 6).alias("macro_f05"), F.round("mf1", 6).alias("macro_f1"), F.round("mf2", 6).alias("macro_f2"),
    )


def _pair_counts(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """What similarity.score_counts gives, of pairs that are there."""
    counts = [x for k, t in enumerate(thresholds) for x in (F.count_if(F.col("score") >= t).alias(f"n{k}"), F.count_if((F.col("score") >= t) & is_match()).alias(f"t{k}"))]
    return pairs.groupBy("query_id").agg(*counts)


def threshold_metrics(pairs: DataFrame, counts: DataFrame, thresholds: list[float], floor: int = 0) -> DataFrame:
    """A row for each threshold: pairs that reach it, or are among the query's ``floor`` best. ``pairs`` are pairs, or
    what similarity.score_counts gives for these thresholds and the floor."""
    counts = with_positives(counts)
    if not floor:
        per = _pair_counts(pairs, thresholds) if "score" in pairs.columns else pairs
        per = per.join(counts.select("query_id"), "query_id", "left_semi").withColumns({f"{r}{k}": F.col(f"{c}{k}") for k in range(len(thresholds)) for r, c in ("rn", "st")})
    elif "score" not in pairs.columns:
        per = pairs.join(counts.select("query_id"), "query_id", "left_semi")
    else:
        rows = pairs.join(counts.select("query_id"), "query_id", "left_semi").withColumn("hit", is_match())
        if "rank" not in rows.columns:
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")))
        aggregates = []
        for k, t in enumerate(thresholds):
            reach = F.col("score") >= t
            chosen = reach | (F.col("rank") <= floor)
            aggregates += [F.count_if(chosen).alias(f"n{k}"), F.count_if(chosen & F.col("hit")).alias(f"t{k}"), F.count_if(reach).alias(f"r{k}"), F.count_if(reach & F.col("hit")).alias(f"s{k}")]
        per = rows.groupBy("query_id").agg(*aggregates)
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{k}").alias(c) for c in "ntrs"]) for k, t in enumerate(thresholds)])).alias("g")
    per = per.select("query_id", grid).select("g.*", "query_id")
    out = per.groupBy("threshold").agg(F.sum("n").alias("candidate_pairs"), F.sum("t").alias("true_positives"), F.count_if(F.col("n") > 0).alias("covered"), (F.sum("n") - F.sum("r")).alias("floor_added"), (F.sum("t") - F.sum("s")).alias("floor_rescued"), F.count_if(F.col("r") < F.col("n")).alias("floor_queries"))
    out = out.join(F.broadcast(totals(counts)))  # one row
    extra = ["floor_added", "floor_rescued", "floor_queries"] if floor else []
    return out.select("threshold", "candidate_pairs", "true_positives", *extra, *_pooled(out))


def candidate_sizes(pairs: DataFrame, queries: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold and size of candidate set, how many queries have it; queries with nothing count as size 0. ``pairs``
    are pairs, or what similarity.score_counts gives."""
    per = _pair_counts(pairs, thresholds) if "score" in pairs.columns else pairs
    per = queries.select(F.col("id").alias("query_id")).join(per, "query_id", "left").fillna(0)
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("size")) for k, t in enumerate(thresholds)])).alias("g")
    return per.select(grid).select("g.*").groupBy("threshold", "size").agg(F.count(F.lit(1)).alias("queries"))


def histogram_bin(bins: int):
    """The bin of a score among equal ones over [-1, 1], the last closed, for arrays; scores outside have the bin ``bins``."""
    return lambda s: np.where(np.abs(s) <= 1, np.minimum(np.floor((s + 1) * bins / 2), bins - 1), bins)


def score_histogram(pairs: DataFrame, bins: int = 80) -> DataFrame:
    """Matches and other pairs in equal bins over [-1, 1], the last closed; empty bins are rows too. ``pairs`` are pairs, or
    what similarity.score_bins gives for histogram_bin."""
    if "score" in pairs.columns:
        bin_ = F.least(F.floor((F.col("score") + 1) * bins / 2), F.lit(bins - 1)).cast("int")
        pairs = pairs.where("score between -1 and 1").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_match()).alias("tp"))
    found = pairs.select(F.col("bin").cast("int").alias("bin"), F.col("tp").alias("matches"), (F.col("n") - F.col("tp")).alias("others"))
    every = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").fillna(0, ["matches", "others"])


def curve_point(points: int):
    """The last of ``points`` even thresholds on [-1, 1] that a score reaches, for arrays; 0 where it reaches none."""
    step = 2.0 / (points - 1)
    return lambda s: np.clip(np.floor(np.round((s + 1) / step, 9)), 0, points - 1)


def threshold_curve(pairs: DataFrame, counts: DataFrame, points: int) -> DataFrame:
    """Counts at ``points`` even thresholds on [-1, 1]: each score falls in the last threshold that it reaches, and a
    running sum from the top gives what reaches each, so pairs are read once whatever the number of points. ``pairs`` are
    pairs, or what similarity.score_bins gives for curve_point and queries that have a true pair."""
    step = 2.0 / (points - 1)
    if "score" in pairs.columns:
        at = F.greatest(F.lit(0), F.least(F.floor(F.round((F.col("score") + 1) / step, 9)), F.lit(points - 1)))
        rows = pairs.join(with_positives(counts).select("query_id"), "query_id", "left_semi")
        pairs = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_match()).alias("tp"))
    found = pairs.select(F.col("bin").cast("int").alias("point"), "n", "tp")
    every = pairs.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    above = Window.orderBy(F.desc("point"))  # over the points, not the pairs
    curve = every.join(found, "point", "left").fillna(0, ["n", "tp"])
    curve = curve.select("point", F.round(F.col("point") * step - 1, 6).alias("threshold"), F.sum("n").over(above).alias("candidate_pairs"), F.sum("tp").over(above).alias("true_positives"))
    curve = curve.join(F.broadcast(totals(with_positives(counts))))  # one row
    return curve.select("point", "threshold", "candidate_pairs", "true_positives", F.round(ratio(F.col("true_positives"), F.col("candidate_pairs")), 6).alias("precision"), F.round(ratio(F.col("true_positives"), F.col("positives")), 6).alias("recall"))


def quantile_bin(width: float = 1e-4):
    """The bin of ``width`` that a score of [-1, 1] is nearest to, for arrays."""
    return lambda s: np.clip(np.rint((s + 1) / width), 0, round(2 / width))


def quantiles_by_bins(scores: DataFrame, qs: list[float], width: float = 1e-4) -> DataFrame:
    """Nearest-rank quantiles of scores in [-1, 1], to a bin of ``width``, in fixed memory; the ends are exact. ``scores`` are
    rows with a score, or what similarity.score_bins gives for quantile_bin."""
    top = round(2 / width)
    if "score" in scores.columns:
        bin_ = F.greatest(F.lit(0), F.least(F.lit(top), F.bround((F.col("score") + 1) / width))).cast("int")
        scores = scores.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    binned = scores.select("bin", "n")
    ends = scores.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("total"))
    upto = binned.withColumn("upto", F.sum("n").over(Window.orderBy("bin")))  # over the bins
    wanted = ends.select("low", "high", "total", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total"))))
    hit = wanted.join(upto, F.col("upto") >= F.col("rank")).groupBy("q", "low", "high").agg(F.min("bin").alias("bin"))
    value = F.when(F.col("q") <= 0, F.col("low")).when(F.col("q") >= 1, F.col("high")).otherwise(F.col("bin") * width - 1)
    return hit.select("q", F.round(value, 4).alias("score"))


def rank_view(ranked: DataFrame) -> DataFrame:
    """The true pairs with their ranks: query_id, query_class, candidate_id, rank, score."""
    return ranked.where(is_match()).select("query_id", "query_class", "candidate_id", "rank", "score")


def found_by_class(view: DataFrame, ks: list[int]) -> DataFrame:
    """For each class with a true pair: query_class, n (its true pairs), and n{k} of them within rank k. ``view`` has the true
    pairs with their ranks, or is what similarity.top_counts gives for ``ks``."""
    if "rank" in view.columns:
        return view.groupBy("query_class").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks])
    return view.groupBy("query_class").agg(F.sum("positives").alias("n"), *[F.sum(f"h{j}").alias(f"n{k}") for j, k in enumerate(ks)]).where("n > 0")


def joined_smallest_k(queries: DataFrame, candidates: DataFrame, targets: list[float]) -> DataFrame:
    """smallest_k of all pairs of (id, class, vector) on both sides, counted where they arise: by bins of ranks first, and then
    by the ranks of the bins in which the targets are reached."""
    width = max(1, -(-candidates.count() // similarity.RANK_BINS))
    bins = sorted(tuple(r) for r in similarity.true_rank_counts(queries, candidates, lambda rank: (rank - 1) // width).collect())
    total = sum(n for _, n in bins)

    def reached(counts: list, need: int) -> int | None:
        found = 0
        for at, n in counts:
            found += n
            if found >= need:
                return at
        return None

    needs = {float(t): math.ceil(t * total - 1e-9) for t in targets}
    places = {t: at for t, need in needs.items() if (at := reached(bins, need)) is not None}
    if width > 1 and places:
        chosen = np.array(sorted(set(places.values())))
        inside = sorted(tuple(r) for r in similarity.true_rank_counts(queries, candidates, lambda rank: np.where(np.isin((rank - 1) // width, chosen), rank - 1, -1)).collect())
        for t, bin_ in places.items():
            before = sum(n for at, n in bins if at < bin_)
            places[t] = reached([(at, n) for at, n in inside if at // width == bin_], needs[t] - before)
    return queries.sparkSession.createDataFrame([(t, at + 1) for t, at in places.items()], "target double, k int")


def smallest_k(view: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the smallest k whose top k have that share of all true pairs: the ceil(target * n)-th rank."""
    by_rank = view.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    upto = by_rank.withColumn("upto", F.sum("n").over(Window.orderBy("rank")))  # over the ranks
    total = view.agg(F.count(F.lit(1)).alias("total"))
    wanted = total.select(F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target"), "total")
    need = F.ceil(F.col("target") * F.col("total") - 1e-9)
    return wanted.join(upto, F.col("upto") >= need).groupBy("target").agg(F.min("rank").alias("k"))


def identity_completeness(view: DataFrame, ks: list[int]) -> DataFrame:
    """Completeness with every class of equal weight, and pooled, for each k: the mean over classes of the share found."""
    per = found_by_class(view, ks)
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("found")) for k in ks])).alias("g")
    rows = per.select("n", grid).select("n", "g.*")
    return rows.groupBy("k").agg(F.round(F.avg(F.col("found") / F.col("n")), 6).alias("identity_pc"), F.round(F.sum("found") / F.sum("n"), 6).alias("pooled_pc"), F.count(F.lit(1)).alias("classes"))


def misses(view: DataFrame, k: int, top: int) -> DataFrame:
    """Classes by true pairs beyond rank k: the ``top`` with most, with their share of all misses."""
    lost = found_by_class(view, [k]).select("query_class", (F.col("n") - F.col(f"n{k}")).alias("missed")).where("missed > 0")
    total = lost.agg(F.sum("missed").alias("total"))
    rows = lost.join(F.broadcast(total)).select("query_class", "missed", F.round(F.col("missed") / F.col("total"), 6).alias("share"))  # one row
    return rows.orderBy(F.desc("missed"), "query_class").limit(top)


def retrieval_summary(candidates: DataFrame) -> DataFrame:
    """Counts of a candidate set with flags by_threshold and by_window, and of its sizes per query. ``candidates`` are pairs, or
    what similarity.rule_counts gives."""
    per = candidates if "both" in candidates.columns else candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("by_threshold").alias("t"), F.count_if("by_window").alias("w"), F.count_if(F.col("by_threshold") & F.col("by_window")).alias("both"))
    return per.agg(
        F.sum("n").alias("pairs"), F.sum("t").alias("threshold_pairs"), F.sum("w").alias("window_pairs"), F.sum("both").alias("both_pairs"), (F.sum("n") - F.sum("w")).alias("threshold_only"), (F.sum("n") - F.sum("t")).alias("window_only"),
        F.count(F.lit(1)).alias("queries"), F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"),
    )


def profile_diagnostics(queries: DataFrame, candidates: DataFrame, profiles: list[str], ks: list[int], thresholds: list[float]) -> DataFrame:
    """Metrics of slices of the candidates (id, class, vector, profile), each ranked by itself, at every k and at thresholds that
    were chosen elsewhere: profile, mode, point, candidate_pairs, true_positives, pair_completeness, pair_quality,
    reduction_ratio. Slices without a true pair have no rows."""
    number = F.array_position(F.array(*[F.lit(p) for p in profiles]), F.col("profile")).cast("int")
    sliced = candidates.withColumn("slice", F.coalesce(number, F.lit(0)))  # 0: of none of them
    if queries is not candidates:
        sliced = sliced.where("slice > 0")
    rows = similarity.slice_counts(sliced if queries is candidates else queries, sliced, ks, thresholds).where("slice > 0")
    points = [("top_k", k, f"k{j}", f"h{j}") for j, k in enumerate(ks)] + [("calibrated_threshold", t, f"n{j}", f"t{j}") for j, t in enumerate(thresholds)]
    grid = F.explode(F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(float(x)).alias("point"), F.col(n).alias("candidate_pairs"), F.col(tp).alias("true_positives")) for mode, x, n, tp in points])).alias("g")
    rows = rows.select(F.element_at(F.array(*[F.lit(p) for p in profiles]), F.col("slice")).alias("profile"), "possible", "positives", grid).select("profile", "possible", "positives", "g.*")
    tp, n = F.col("true_positives"), F.col("candidate_pairs")
    pooled = [F.round(ratio(tp, F.col("positives")), 6).alias("pair_completeness"), F.round(ratio(tp, n), 6).alias("pair_quality"), F.round(1 - ratio(n, F.col("possible")), 6).alias("reduction_ratio")]
    return rows.select("profile", "mode", "point", "candidate_pairs", "true_positives", *pooled)


def profile_macro(rows: DataFrame, profiles: int) -> DataFrame:
    """The mean over profiles of profile_diagnostics() for each operating point; a profile that lacks is an error."""
    each = rows.groupBy("mode", "point").agg(F.count(F.lit(1)).alias("profiles"), *[F.round(F.avg(c), 6).alias(c) for c in ("pair_completeness", "pair_quality", "reduction_ratio")])
    whole = F.when(F.col("profiles") == profiles, F.col("profiles")).otherwise(F.raise_error(F.lit("a profile without a result")).cast("long"))
    return each.withColumn("profiles", whole)
