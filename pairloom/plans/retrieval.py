"""Queries over the embeddings: similarity joins, metrics, operating points, risk control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import vector_report
from ..operators import baseline, calibrate, certify, metrics, rough, similarity
from ..sources.storage import written
from .registry import query, table

#: All ordered pairs of different vectors, as DuckDB has them.
PAIRS = """WITH p AS (
  SELECT q.vec_id AS qid, c.vec_id AS cid, q.label AS ql, c.label AS cl, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rk, ql = cl AS hit FROM p),
cnt AS (SELECT qid, ql, count(*) AS nc, count(*) FILTER (ql = cl) AS np FROM p GROUP BY qid, ql),
tot AS (SELECT count(*) AS nq, sum(nc) AS possible, sum(np) AS positives FROM cnt WHERE np > 0)"""
POOLED = """round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6) AS pair_quality, round(tp / positives, 6) AS pair_completeness,
  round(1 - n / possible, 6) AS reduction_ratio, round(cov / nq, 6) AS query_coverage"""
KS = [1, 5, 10, 20, 40]
THRESHOLDS = [0.1, 0.2, 0.3]
TARGETS = [0.05, 0.1, 0.25]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("class"), F.col("embedding").alias("vector"))


def top_counts(spark: SparkSession, sf_dir: str, ks: list[int]) -> DataFrame:
    v = vectors(spark, sf_dir)
    return written(similarity.top_counts(v, v, ks), "top-counts")  # read several times


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return metrics.class_counts(v, v)


@query(f"""{PAIRS}, g AS (SELECT k, cnt.qid, cnt.np, count(r.cid) AS n, count(r.cid) FILTER (r.hit) AS tp
  FROM cnt CROSS JOIN (SELECT unnest({KS}) AS k) ks LEFT JOIN r ON r.qid = cnt.qid AND r.rk <= k WHERE np > 0 GROUP BY ALL),
f AS (SELECT k, sum(n) AS n, sum(tp) AS tp, count(*) FILTER (n > 0) AS cov, avg(tp / k) AS mp, avg(tp / np) AS mr,
  avg(CASE WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / k) * (tp / np) / (0.25 * (tp / k) + tp / np) END) AS f05,
  avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / k) * (tp / np) / (tp / k + tp / np) END) AS f1,
  avg(CASE WHEN tp = 0 THEN 0 ELSE 5 * (tp / k) * (tp / np) / (4 * (tp / k) + tp / np) END) AS f2 FROM g GROUP BY k)
SELECT k, n::BIGINT AS candidate_pairs, tp::BIGINT AS true_positives, (n - tp)::BIGINT AS false_positives, (positives - tp)::BIGINT AS false_negatives, {POOLED},
  round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(f05, 6) AS macro_f05, round(f1, 6) AS macro_f1, round(f2, 6) AS macro_f2 FROM f CROSS JOIN tot""")
def topk_blocking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the k nearest, for each k."""
    return metrics.top_k_metrics(top_counts(spark, sf_dir, KS), counts(spark, sf_dir), KS)


@query(f"""{PAIRS}, g AS (SELECT t, qid, count(*) FILTER (s >= t) AS n, count(*) FILTER (s >= t AND hit) AS tp
  FROM r SEMI JOIN (SELECT qid FROM cnt WHERE np > 0) c USING (qid) CROSS JOIN (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS t) ts GROUP BY ALL),
f AS (SELECT t, sum(n) AS n, sum(tp) AS tp, count(*) FILTER (n > 0) AS cov FROM g GROUP BY t)
SELECT t AS threshold, n::BIGINT AS candidate_pairs, tp::BIGINT AS true_positives, {POOLED} FROM f CROSS JOIN tot""")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the pairs that reach a threshold."""
    v = vectors(spark, sf_dir)
    return metrics.threshold_metrics(similarity.score_counts(v, v, THRESHOLDS), counts(spark, sf_dir), THRESHOLDS)


@query(f"""{PAIRS}, g AS (SELECT t, qid, count(*) FILTER (s >= t OR rk <= 5) AS n, count(*) FILTER ((s >= t OR rk <= 5) AND hit) AS tp, count(*) FILTER (s >= t) AS rn, count(*) FILTER (s >= t AND hit) AS rt
  FROM r SEMI JOIN (SELECT qid FROM cnt WHERE np > 0) c USING (qid) CROSS JOIN (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS t) ts GROUP BY ALL),
f AS (SELECT t, sum(n) AS n, sum(tp) AS tp, count(*) FILTER (n > 0) AS cov, sum(n - rn) AS fa, sum(tp - rt) AS fr, count(*) FILTER (rn < n) AS fq FROM g GROUP BY t)
SELECT t AS threshold, n::BIGINT AS candidate_pairs, tp::BIGINT AS true_positives, fa::BIGINT AS floor_added, fr::BIGINT AS floor_rescued, fq AS floor_queries, {POOLED} FROM f CROSS JOIN tot""")
def threshold_topk_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold with at least the five nearest of each query."""
    v = vectors(spark, sf_dir)
    return metrics.threshold_metrics(similarity.score_counts(v, v, [0.2, 0.4, 0.6], floor=5), counts(spark, sf_dir), [0.2, 0.4, 0.6], floor=5)


POINTS = f"""{PAIRS}, b AS (SELECT s, count(*) AS n, count(*) FILTER (hit) AS tp FROM r SEMI JOIN (SELECT qid FROM cnt WHERE np > 0) c USING (qid) GROUP BY s),
u AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS n, sum(tp) OVER (ORDER BY s DESC) AS tp FROM b),
o AS (SELECT target, any_value(positives) AS positives, any_value(possible) AS possible, max(s) AS threshold, min(n) AS n, min(tp) AS tp
  FROM (SELECT unnest([0.05, 0.1, 0.25, 1.5]::DOUBLE[]) AS target) t CROSS JOIN tot LEFT JOIN u ON tp >= target * positives - 1e-9 GROUP BY target)"""


@query(f"""{POINTS} SELECT target, threshold, n::BIGINT AS candidate_pairs, tp::BIGINT AS true_positives, round(tp / positives, 6) AS pair_completeness, round(tp / n, 6) AS pair_quality,
  round(1 - n / possible, 6) AS reduction_ratio, threshold IS NOT NULL AS attained FROM o""")
def target_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest threshold that reaches a completeness; 1.5 can't be reached and stays null."""
    v = vectors(spark, sf_dir)
    return calibrate.joined_operating_points(v, v, [*TARGETS, 1.5])


HALVES = PAIRS.replace("ON q.vec_id <> c.vec_id)", "ON q.vec_id <> c.vec_id AND (q.label < 5) = (c.label < 5))")


@query(f"""{HALVES}, cal AS (SELECT s, count(*) AS n, count(*) FILTER (hit) AS tp FROM r WHERE ql < 5 AND qid IN (SELECT qid FROM cnt WHERE np > 0) GROUP BY s),
u AS (SELECT s, sum(tp) OVER (ORDER BY s DESC) AS tp FROM cal), pos AS (SELECT sum(np) FILTER (ql < 5) AS a, sum(np) FILTER (ql >= 5) AS b FROM cnt),
o AS (SELECT target, max(s) AS threshold FROM (SELECT unnest({TARGETS}::DOUBLE[]) AS target) t CROSS JOIN pos JOIN u ON tp >= target * a - 1e-9 GROUP BY target),
w AS (SELECT target, threshold, any_value(b) AS b, count(*) FILTER (s >= threshold) AS n, count(*) FILTER (s >= threshold AND hit) AS tp FROM o CROSS JOIN pos CROSS JOIN r WHERE ql >= 5 AND qid IN (SELECT qid FROM cnt WHERE np > 0) GROUP BY target, threshold)
SELECT target, threshold, n AS candidate_pairs, tp AS true_positives, round(tp / b, 6) AS pair_completeness, round(tp / b - target, 6) AS calibration_error, tp / b >= target - 1e-12 AS attained FROM w""")
def calibrated_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of the classes below five, frozen, on the other classes."""
    v = vectors(spark, sf_dir)
    one, two = v.where("class < 5"), v.where("class >= 5")
    return calibrate.joined_transferred(calibrate.joined_operating_points(one, one, TARGETS), two, two)


@query(f"""{PAIRS}, g AS (SELECT k, count(*) FILTER (hit) AS tp FROM (SELECT unnest({KS}) AS k) ks JOIN r ON rk <= k SEMI JOIN (SELECT qid FROM cnt WHERE np > 0) c USING (qid) GROUP BY k),
m AS (SELECT k, round(tp / positives, 6) AS pc FROM g CROSS JOIN tot)
SELECT target, min(k) FILTER (pc >= target - 1e-12) AS k, CASE WHEN min(k) FILTER (pc >= target - 1e-12) IS NULL THEN 'target_not_attained' ELSE 'attained' END AS status
FROM (SELECT unnest([0.02, 0.05, 0.99]::DOUBLE[]) AS target) t CROSS JOIN m GROUP BY target""")
def calibrated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest k of a grid that reaches a completeness."""
    return calibrate.calibrated_k(topk_blocking_metrics(spark, sf_dir), [0.02, 0.05, 0.99])


@query(f"""{PAIRS} SELECT t AS threshold, n AS size, count(*) AS queries FROM (SELECT t, qid, count(*) FILTER (s >= t) AS n FROM r CROSS JOIN (SELECT unnest([0.2, 0.3]::DOUBLE[]) AS t) ts GROUP BY ALL) g GROUP BY ALL""")
def candidate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates a query gets."""
    v = vectors(spark, sf_dir)
    return metrics.candidate_sizes(similarity.score_counts(v, v, [0.2, 0.3]), v, [0.2, 0.3])


@query(f"""{PAIRS}, h AS (SELECT least(floor((s + 1) * 80 / 2), 79)::INT AS bin, count(*) FILTER (hit) AS m, count(*) FILTER (NOT hit) AS o FROM r WHERE s BETWEEN -1 AND 1 GROUP BY 1)
SELECT b.bin::INT AS bin, coalesce(m, 0) AS matches, coalesce(o, 0) AS others FROM range(80) b(bin) LEFT JOIN h ON h.bin = b.bin""")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of matches and others in 80 bins."""
    v = vectors(spark, sf_dir)
    return metrics.score_histogram(similarity.score_bins(v, v, metrics.histogram_bin(80)))


@query(f"""{PAIRS}, h AS (SELECT least(floor(round((s + 1) / 0.001, 9)), 2000)::INT AS point, count(*) AS n, count(*) FILTER (hit) AS tp FROM r WHERE qid IN (SELECT qid FROM cnt WHERE np > 0) GROUP BY 1),
c AS (SELECT b.point::INT AS point, sum(coalesce(n, 0)) OVER (ORDER BY b.point DESC) AS n, sum(coalesce(tp, 0)) OVER (ORDER BY b.point DESC) AS tp FROM range(2001) b(point) LEFT JOIN h ON h.point = b.point)
SELECT point, round(point * 0.001 - 1, 6) AS threshold, n::BIGINT AS candidate_pairs, tp::BIGINT AS true_positives, round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6) AS precision, round(tp / positives, 6) AS recall FROM c CROSS JOIN tot""")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at 2001 thresholds."""
    v, of = vectors(spark, sf_dir), counts(spark, sf_dir)
    asked = v.join(metrics.with_positives(of).select(F.col("query_id").alias("id")), "id", "left_semi")
    return metrics.threshold_curve(similarity.score_bins(asked, v, metrics.curve_point(2001)), of, 2001)


@query(f"""{PAIRS}, h AS (SELECT greatest(0, least(20000, round_even((s + 1) / 1e-4, 0)))::INT AS bin, count(*) AS n FROM r GROUP BY 1),
u AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto FROM h), e AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS total FROM r)
SELECT q, round(CASE WHEN q <= 0 THEN any_value(lo) WHEN q >= 1 THEN any_value(hi) ELSE min(bin) * 1e-4 - 1 END, 4) AS score FROM (SELECT unnest([0, 0.25, 0.5, 0.75, 0.99, 1]::DOUBLE[]) AS q) t CROSS JOIN e JOIN u ON upto >= greatest(1, ceil(q * total)) GROUP BY q""")
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles in fixed memory."""
    v = vectors(spark, sf_dir)
    return rough.quantiles(v, [0.0, 0.25, 0.5, 0.75, 0.99, 1.0])


@query(f"""{PAIRS}, v AS (SELECT * FROM r WHERE hit), u AS (SELECT rk, sum(count(*)) OVER (ORDER BY rk) AS upto FROM v GROUP BY rk)
SELECT target, min(rk) AS k FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS target) t CROSS JOIN (SELECT count(*) AS total FROM v) n JOIN u ON upto >= ceil(target * total - 1e-9) GROUP BY target""")
def smallest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest k with a pooled completeness."""
    v = vectors(spark, sf_dir)
    return metrics.joined_smallest_k(v, v, [0.5, 0.9, 0.95, 0.99])


@query(f"""{PAIRS}, v AS (SELECT ql, k, count(*) AS n, count(*) FILTER (rk <= k) AS f FROM r CROSS JOIN (SELECT unnest([10, 40, 160]) AS k) ks WHERE hit GROUP BY ALL)
SELECT k, round(avg(f / n), 6) AS identity_pc, round(sum(f) / sum(n), 6) AS pooled_pc, count(*) AS classes FROM v GROUP BY k""")
def identity_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness by class and pooled."""
    return metrics.identity_completeness(top_counts(spark, sf_dir, [10, 40, 160]), [10, 40, 160])


@query(f"""{PAIRS}, l AS (SELECT ql, count(*) AS missed FROM r WHERE hit AND rk > 40 GROUP BY ql)
SELECT ql::BIGINT AS query_class, missed, round(missed / sum(missed) OVER (), 6) AS share FROM l ORDER BY missed DESC, ql LIMIT 3""")
def misses_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three classes with most true pairs beyond rank 40."""
    return metrics.misses(top_counts(spark, sf_dir, [40]), 40, 3)


@query(f"""{PAIRS}, l AS (SELECT k, ql, 1 - count(*) FILTER (rk <= k) / count(*) AS loss FROM r CROSS JOIN (SELECT unnest([20, 80, 160, 320, 480]) AS k) ks WHERE hit GROUP BY ALL),
b AS (SELECT k, count(*) AS n, round(count(*) / (count(*) + 1) * avg(loss) + 1 / (count(*) + 1), 9) AS bound FROM l GROUP BY k),
g AS (SELECT alpha, k, bound, bound <= alpha AS holds FROM (SELECT unnest([0.05, 0.25, 0.5]::DOUBLE[]) AS alpha) a CROSS JOIN b),
z AS (SELECT alpha, coalesce(max(k) FILTER (NOT holds), -1) AS failed FROM g GROUP BY alpha)
SELECT z.alpha, min(g.k) AS k, round(arg_min(g.bound, g.k), 6) AS bound, ceil(round(1 / z.alpha, 9) - 1)::BIGINT AS classes_needed FROM z LEFT JOIN g ON g.alpha = z.alpha AND g.k > failed GROUP BY z.alpha""")
def conformal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K with certified risk."""
    view = top_counts(spark, sf_dir, [20, 80, 160, 320, 480])
    return certify.conformal_points(certify.class_losses(view, [20, 80, 160, 320, 480]), [0.05, 0.25, 0.5])


@query(f"""{PAIRS}, v AS (SELECT ql, count(*) AS n, count(*) FILTER (rk <= 40) AS f FROM r WHERE hit GROUP BY ql), x AS (SELECT * FROM v ORDER BY n DESC, ql LIMIT 1)
SELECT x.ql::BIGINT AS largest_class, round(sum(v.f) / sum(v.n), 6) AS pooled_pc, round((sum(v.f) - x.f) / (sum(v.n) - x.n), 6) AS pc_without, round(x.f / x.n, 6) AS pc_of_largest FROM v CROSS JOIN x GROUP BY x.ql, x.f, x.n""")
def without_largest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness without the largest class."""
    return certify.without_largest(top_counts(spark, sf_dir, [40]), 40)


@query(f"""{PAIRS}, v AS (SELECT ql, k, count(*) FILTER (rk <= k) / count(*) AS pc FROM r CROSS JOIN (SELECT unnest([10, 40]) AS k) ks WHERE hit GROUP BY ALL),
x AS (SELECT 'pc@' || k AS key, ql AS class, pc AS value FROM v UNION ALL SELECT 'pc@40 - pc@10', ql, max(pc) FILTER (k = 40) - max(pc) FILTER (k = 10) FROM v GROUP BY ql),
o AS (SELECT label AS class, row_number() OVER (ORDER BY label) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings) l),
d AS (SELECT s.range AS resample, k.range AS k, ('0x' || md5('0:' || s.range || ':' || k.range)[1:8])::BIGINT % (SELECT max(n) FROM o) AS place FROM range(2000) s, range((SELECT max(n) FROM o)) k),
m AS (SELECT x.key, resample, sum(value * times) / sum(times) AS m FROM (SELECT resample, class, count(*) AS times FROM d JOIN o USING (place) GROUP BY ALL) t JOIN x USING (class) GROUP BY ALL),
q AS (SELECT key, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END) AS positive FROM m GROUP BY key)
SELECT key, round(c.mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(positive, 6) AS positive, low > 0 OR high < 0 AS zero_excluded FROM q JOIN (SELECT key, avg(value) AS mean FROM x GROUP BY key) c USING (key)""")
def bootstrap_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the completeness at two k over resampled classes, and of their difference; draws are seeded."""
    losses = certify.class_losses(top_counts(spark, sf_dir, [10, 40]), [10, 40]).withColumn("value", 1 - F.col("loss"))
    draws = certify.bootstrap_draws(vectors(spark, sf_dir).select("class"), 2000, 0)
    values = losses.select(F.concat(F.lit("pc@"), F.col("k").cast("string")).alias("key"), F.col("query_class").alias("class"), "value")
    wide = losses.groupBy(F.col("query_class").alias("class")).agg(F.sum(F.when(F.col("k") == 40, F.col("value")).otherwise(-F.col("value"))).alias("value"))
    return certify.bootstrap_interval(values.unionByName(wide.select(F.lit("pc@40 - pc@10").alias("key"), "class", "value")), draws)


@query("""WITH c AS (SELECT e.vec_id, (SELECT count(*) FROM embeddings) - 1 AS nc, (SELECT count(*) FROM embeddings f WHERE f.label = e.label) - 1 AS np FROM embeddings e),
g AS (SELECT k, least(k, nc) AS d, nc, np FROM c CROSS JOIN (SELECT unnest([1, 10, 40]) AS k) ks WHERE np > 0)
SELECT k, sum(d)::BIGINT AS candidate_pairs, round(sum(d * np / nc), 6) AS expected_hits, round(sum(d * np / nc) / sum(d), 6) AS pair_quality, round(sum(d * np / nc) / sum(np), 6) AS pair_completeness, round(avg(d / nc), 6) AS macro_recall FROM g GROUP BY k""")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What k random candidates give."""
    return baseline.expected_top_k(counts(spark, sf_dir), [1, 10, 40])


@query("""WITH c AS (SELECT (SELECT count(*) FROM embeddings) - 1 AS nc, (SELECT count(*) FROM embeddings f WHERE f.label = e.label) - 1 AS np FROM embeddings e),
s AS (SELECT nc, np, count(*) AS m FROM c WHERE np > 0 GROUP BY ALL), g AS (SELECT nc, np, m, k, unnest(range(greatest(0, k - nc + np)::BIGINT, least(k, np)::BIGINT + 1)) AS h FROM s CROSS JOIN (SELECT unnest([1, 5, 10]) AS k) ks),
w AS (SELECT k, m, exp(lgamma(np + 1) - lgamma(h + 1) - lgamma(np - h + 1) + lgamma(nc - np + 1) - lgamma(k - h + 1) - lgamma(nc - np - k + h + 1) - lgamma(nc + 1) + lgamma(k + 1) + lgamma(nc - k + 1)) * 2 * h / (k + np) AS f FROM g)
SELECT k, round(sum(f * m) / (SELECT sum(m) FROM s), 6) AS expected_f1 FROM w GROUP BY k""")
def random_baseline_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected F1 of k random candidates."""
    return baseline.expected_f1(counts(spark, sf_dir), [1, 5, 10])


@query("""WITH c AS (SELECT (SELECT count(*) FROM embeddings) - 1 AS nc, (SELECT count(*) FROM embeddings f WHERE f.label = e.label) - 1 AS np FROM embeddings e)
SELECT sum(np)::BIGINT AS positives, sum(nc)::BIGINT AS possible, round(sum(np) / sum(nc), 6) AS prevalence FROM c WHERE np > 0""")
def random_baseline_at_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of true pairs."""
    return baseline.prevalence(counts(spark, sf_dir))


DIRECTED = f"""{PAIRS}, d AS (SELECT qid, cid, s, rk, s >= 0.35 AS t, rk <= 3 AS w FROM r WHERE s >= 0.35 OR rk <= 3),
m AS (SELECT least(qid, cid) AS a, greatest(qid, cid) AS b, avg(s) AS s, min(rk) FILTER (qid < cid) AS ra, min(rk) FILTER (qid > cid) AS rb, bool_or(qid < cid) AS fa, bool_or(qid > cid) AS fb, bool_or(t) AS t, bool_or(w) AS w FROM d GROUP BY ALL)"""


@query(f"""{DIRECTED} SELECT a, b, round(s, 6) AS score, ra::INT AS rank_a_to_b, rb::INT AS rank_b_to_a, fa AS retrieved_from_a, fb AS retrieved_from_b, concat_ws(';', CASE WHEN t THEN 'threshold' END, CASE WHEN w THEN 'window' END) AS reasons FROM m""")
def symmetric_pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed hits as unordered pairs with their reasons."""
    return rough.merged_pairs(vectors(spark, sf_dir), 0.35, 3)


@query(f"""{DIRECTED}, e AS (SELECT unnest(string_split(concat_ws(';', CASE WHEN t THEN 'threshold' END, CASE WHEN w THEN 'window' END), ';')) AS reason FROM m) SELECT reason, count(*) AS pairs FROM e GROUP BY reason""")
def pair_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs each reason names."""
    v = vectors(spark, sf_dir)
    return similarity.reason_counts(v, 0.35, 3)


@query(f"""{DIRECTED}, q AS (SELECT qid, count(*) AS n, count(*) FILTER (t) AS t, count(*) FILTER (w) AS w, count(*) FILTER (t AND w) AS both_ FROM d GROUP BY qid)
SELECT sum(n)::BIGINT AS pairs, sum(t)::BIGINT AS threshold_pairs, sum(w)::BIGINT AS window_pairs, sum(both_)::BIGINT AS both_pairs, sum(n - w)::BIGINT AS threshold_only, sum(n - t)::BIGINT AS window_only, count(*) AS queries, min(n) AS least, median(n) AS median, max(n) AS most FROM q""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a candidate set."""
    v = vectors(spark, sf_dir)
    return metrics.retrieval_summary(similarity.rule_counts(v, v, 0.35, 3))


@query(f"""{PAIRS}, h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS n FROM p WHERE ql <> cl) SELECT qid AS query_id, cid AS candidate_id, ql::BIGINT AS query_class, cl::BIGINT AS candidate_class, s AS score, n::INT AS rank FROM h WHERE n <= 5""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of other classes."""
    v = vectors(spark, sf_dir)
    return similarity.nearest_negatives(v, v, 5)


@query(f"""{PAIRS}, o AS (SELECT qid, max(s) AS own FROM p WHERE ql = cl GROUP BY qid), h AS (SELECT p.*, own, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS n FROM p JOIN o USING (qid) WHERE ql <> cl AND s <= own)
SELECT qid AS query_id, cid AS candidate_id, ql::BIGINT AS query_class, cl::BIGINT AS candidate_class, s AS score, own AS own_score, n::INT AS rank FROM h WHERE n <= 5""")
def guarded_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives below the query's own best."""
    v = vectors(spark, sf_dir)
    return similarity.nearest_negatives(v, v, 5, guarded=True)


@query(f"""{PAIRS}, x AS (SELECT *, max(s) OVER (PARTITION BY qid) AS best FROM r) SELECT qid AS query_id, cid AS candidate_id, ql::BIGINT AS query_class, cl::BIGINT AS candidate_class, s AS score, rk::INT AS rank FROM x WHERE rk <= 20 AND (s >= 0.4 OR (best < 0.4 AND best >= 0.3 AND rk = 1))""")
def image_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near neighbours with a cap, or else the best one."""
    v = vectors(spark, sf_dir)
    return similarity.neighbours(similarity.nearest(v, v, 20, least=0.3), 0.4, 20, 0.3)


@query("""SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) AS not_finite,
  count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1.1e-4) AS not_unit FROM embeddings""")
def descriptor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vectors are of one size, finite and of unit length."""
    return vector_report(table(spark, sf_dir, "embeddings"), "embedding", 64)


@query(f"""{PAIRS.replace("ON q.vec_id <> c.vec_id)", "ON q.label < 5 AND c.label >= 5)")} SELECT qid AS query_id, cid AS candidate_id, ql::BIGINT AS query_class, cl::BIGINT AS candidate_class, s AS score, rk::INT AS rank FROM r WHERE rk <= 3""")
def bipartite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint sets, three nearest each."""
    v = vectors(spark, sf_dir)
    return similarity.nearest(v.where("class < 5"), v.where("class >= 5"), 3, exclude_self=False)


@query("""SELECT a.label::BIGINT AS class, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1""")
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs by class, from the classes' sizes."""
    return counts(spark, sf_dir).groupBy(F.col("query_class").alias("class")).agg(F.sum("n_positives").alias("pairs"))


@query("""SELECT DISTINCT a.label::BIGINT AS class FROM embeddings a WHERE vec_id % 2 = 0 AND EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id % 2 = 1 AND b.label = a.label)""")
def protocol_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that both halves of the vectors have."""
    v = vectors(spark, sf_dir)
    return calibrate.leaked(v.where("id % 2 = 0"), v.where("id % 2 = 1"), "class")
