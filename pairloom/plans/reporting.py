"""Queries over many runs. The driver's tables have no runs, so order lines stand in for them: the ship mode flags name a
model, the ship month a split, the line number a training seed, and one minus the discount a completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import certify, runs, selection
from .registry import query, table

RUNS = "r AS (SELECT l_returnflag || l_linestatus AS model, month(l_shipdate)::INT AS split, l_linenumber::INT AS seed, round(avg(1 - l_discount), 9) AS pc, round(avg(l_quantity / 50), 9) AS rr, count(*) AS pairs FROM lineitem GROUP BY ALL)"


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, split, seed, pc, rr, pairs."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("model"), F.month("l_shipdate").alias("split"), F.col("l_linenumber").cast("int").alias("seed")).agg(F.round(F.avg(1 - F.col("l_discount")), 9).alias("pc"), F.round(F.avg(F.col("l_quantity") / 50), 9).alias("rr"), F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH {RUNS}, p AS (SELECT model, split, avg(pc) AS v, count(*) AS s FROM r GROUP BY ALL)
SELECT model, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most, count(*) AS splits, sum(s)::BIGINT AS runs FROM p GROUP BY model""")
def two_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds averaged inside a split, then statistics over splits."""
    return runs.two_level(metric_rows(spark, sf_dir), ["model"], "split", "pc")


@query(f"""WITH {RUNS}, p AS (SELECT model, split, avg(pc) AS v FROM r GROUP BY ALL) SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.v - b.v > 1e-9) AS wins, count(*) FILTER (abs(a.v - b.v) <= 1e-9) AS ties, count(*) FILTER (a.v - b.v < -1e-9) AS losses, round(avg(a.v - b.v), 6) AS mean_difference FROM p a JOIN p b USING (split) WHERE a.model < b.model GROUP BY ALL""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models compared split by split."""
    return runs.paired(metric_rows(spark, sf_dir), "model", "split", "pc")


@query(f"WITH {RUNS} SELECT model, count(*) FILTER (pc >= 0.95 - 1e-12) AS attained, count(*) AS runs, round(avg((pc >= 0.95 - 1e-12)::INT), 6) AS rate FROM r GROUP BY model")
def attainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a target is reached."""
    return runs.attainment(metric_rows(spark, sf_dir), ["model"], "pc", 0.95)


@query(f"WITH {RUNS} SELECT split, count(DISTINCT (seed, model)) AS signatures, min(pairs) AS least, max(pairs) AS most, max(pairs) / min(pairs) > 1.1 AS spread FROM r GROUP BY split")
def population_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether runs of a split were measured on one population."""
    return runs.population_check(metric_rows(spark, sf_dir), ["split"], ["seed", "model"], "pairs")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are not unique."""
    return runs.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query(f"""WITH {RUNS}, w AS (SELECT model, round(avg(pc) FILTER (seed = 1), 6) AS seed_1, round(avg(pc) FILTER (seed = 2), 6) AS seed_2, round(avg(pc) FILTER (seed = 3), 6) AS seed_3 FROM r GROUP BY model) SELECT *, round(greatest(seed_1, seed_2, seed_3) - least(seed_1, seed_2, seed_3), 6) AS span FROM w""")
def seed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span over training seeds."""
    return runs.seed_spans(metric_rows(spark, sf_dir), "model", "seed", [1, 2, 3], "pc")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, p90, interquartile range and rate."""
    return runs.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("WITH p AS (SELECT user_id % 20 AS block, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT p.event_type, count(*) AS blocks, round(avg(p.v / b.v), 6) AS mean_ratio FROM p JOIN p b ON b.block = p.block AND b.event_type = (SELECT min(event_type) FROM events) GROUP BY p.event_type")
def block_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models against a base model, block by block."""
    e = table(spark, sf_dir, "events").withColumn("block", F.col("user_id") % 20)
    base = e.agg(F.min("event_type").alias("m")).first()["m"]
    return runs.block_ratios(e, "block", "event_type", "value", base)


@query("""WITH b AS (SELECT l_returnflag AS model, month(l_shipdate)::INT AS split, l_linenumber::INT AS rep, least(floor(l_discount * 100 / 2), 5)::INT AS bin FROM lineitem), c AS (SELECT model, split, rep, bin, count(*) AS n FROM b GROUP BY ALL),
d AS (SELECT model, split, bin, n / (sum(n) OVER (PARTITION BY model, split, rep) * 0.02) AS d FROM c), k AS (SELECT model, split, count(DISTINCT rep) AS reps FROM b GROUP BY ALL), s AS (SELECT model, split, bin, sum(d) / any_value(reps) AS d FROM d JOIN k USING (model, split) GROUP BY ALL)
SELECT model, bin, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS most, count(*) AS splits FROM s GROUP BY ALL""")
def density_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of unit area, averaged in two levels."""
    bin_ = F.least(F.floor(F.col("l_discount") * 100 / 2), F.lit(5)).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.month("l_shipdate").alias("split"), F.col("l_linenumber").alias("rep"), bin_.alias("bin"))
    return runs.density_average(rows, "model", "split", "rep", "bin", 0.02)


EPOCHS = f"{RUNS}, e AS (SELECT model, split AS epoch, round(avg(pc), 6) AS pc, round(avg(rr), 6) AS rr, sum(pairs)::BIGINT AS pairs FROM r GROUP BY ALL)"


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, epoch, pc, rr, pairs: the splits taken as epochs."""
    return metric_rows(spark, sf_dir).groupBy("model", F.col("split").alias("epoch")).agg(F.round(F.avg("pc"), 6).alias("pc"), F.round(F.avg("rr"), 6).alias("rr"), F.sum("pairs").alias("pairs"))


@query(f"""WITH {EPOCHS}, a AS (SELECT * FROM e WHERE pc >= (SELECT max(pc) FROM e) - 0.002), b AS (SELECT * FROM a WHERE rr >= (SELECT max(rr) FROM a) - 0.01), c AS (SELECT * FROM b WHERE pairs <= (SELECT min(pairs) FROM b) + 100) SELECT * FROM c""")
def selection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within a margin of the leader, step by step."""
    return runs.funnel(epochs(spark, sf_dir), [("pc", True, 0.002), ("rr", True, 0.01), ("pairs", False, 100)], "epoch")


@query(f"WITH {EPOCHS} SELECT model, epoch, pc, rr FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rr DESC, epoch) AS n FROM e WHERE pc >= 0.949) s WHERE n = 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch of the best reduction among those that reach the target, the earlier on ties."""
    return selection.best_by(epochs(spark, sf_dir), ["model"], [F.desc("rr"), F.col("epoch")], F.col("pc") >= 0.949).select("model", "epoch", "pc", "rr")


@query(f"""WITH RECURSIVE {EPOCHS}, f AS (SELECT model, epoch, pc, rr, epoch AS pos FROM e WHERE epoch = 1 UNION ALL SELECT f.model, CASE WHEN w THEN n.epoch ELSE f.epoch END, CASE WHEN w THEN n.pc ELSE f.pc END, CASE WHEN w THEN n.rr ELSE f.rr END, n.epoch
  FROM f JOIN e n ON n.model = f.model AND n.epoch = f.pos + 1 CROSS JOIN LATERAL (SELECT n.pc > f.pc + 0.0005 OR (abs(n.pc - f.pc) <= 0.0005 AND n.rr > f.rr) AS w) x) SELECT model, epoch, pc, rr FROM f WHERE pos = 12""")
def incumbent_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead after an ordered fold with a tie margin."""
    return selection.incumbent(epochs(spark, sf_dir), ["model"], "epoch", "pc", "rr", 0.0005)


@query(f"""WITH {EPOCHS}, b AS (SELECT *, coalesce(pc > max(pc) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS nb FROM e), i AS (SELECT *, sum(nb::INT) OVER (PARTITION BY model ORDER BY epoch) AS isl FROM b)
SELECT model, epoch, pc, nb AS new_best, row_number() OVER (PARTITION BY model, isl ORDER BY epoch) - 1 AS since_best FROM i""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs since the last new best."""
    return runs.early_stop(epochs(spark, sf_dir), "model", "epoch", "pc").select("model", "epoch", "pc", "new_best", "since_best")


@query(f"""WITH {EPOCHS} SELECT epoch, model, pc, row_number() OVER (PARTITION BY epoch ORDER BY pc DESC, model) AS place FROM e""")
def ranked_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models in order, epoch by epoch."""
    return runs.ranked_models(epochs(spark, sf_dir).select("epoch", "model", "pc"), ["epoch"], "model", "pc")


@query(f"""WITH {EPOCHS}, b AS (SELECT epoch, model, pc, max(pc) OVER (PARTITION BY epoch) AS best FROM e) SELECT epoch, model, pc, best, max(CASE WHEN pc < best - 1e-12 THEN pc END) OVER (PARTITION BY epoch) AS second, abs(pc - best) <= 1e-12 AS is_best, abs(pc - max(pc) OVER ()) <= 1e-12 AS is_overall_best FROM b""")
def extreme_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and second-best values of a group and of all."""
    return runs.extremes(epochs(spark, sf_dir).select("epoch", "model", "pc"), ["epoch"], "pc")


@query(f"""WITH {EPOCHS} SELECT e.epoch, e.model, e.pc, b.pc AS base_value, round(e.pc - b.pc, 6) AS delta FROM e JOIN e b ON b.epoch = e.epoch AND b.model = 'AF'""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to a base model."""
    return runs.against_base(epochs(spark, sf_dir).select("epoch", "model", "pc"), ["epoch"], "model", "AF", "pc")


@query(f"""WITH {RUNS}, g AS (SELECT model, split AS k FROM r GROUP BY ALL) SELECT model, coalesce(max(k) FILTER (k = 25), max(k) FILTER (k <= 7), min(k)) AS k FROM g GROUP BY model""")
def preferred_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k that a figure shows."""
    return selection.preferred_k(metric_rows(spark, sf_dir), ["model"], "split", 25, 7)


@query(f"WITH {RUNS} SELECT model, round(avg(pc) FILTER (split IN (1, 5, 10)), 6) AS mean_pc, count(DISTINCT split) FILTER (split IN (1, 5, 10)) AS ks, round(0.5 * avg(pc) + 0.3 * avg(rr) + 0.2 * min(pc), 6) AS weighted FROM r GROUP BY model")
def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over a grid of k and a weighted score."""
    grid = F.col("split").isin(1, 5, 10)
    return metric_rows(spark, sf_dir).groupBy("model").agg(F.round(F.avg(F.when(grid, F.col("pc"))), 6).alias("mean_pc"), F.countDistinct(F.when(grid, F.col("split"))).alias("ks"), F.round(0.5 * F.avg("pc") + 0.3 * F.avg("rr") + 0.2 * F.min("pc"), 6).alias("weighted"))


@query("""WITH m AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id DESC) AS n FROM events), w AS (SELECT (2 - (n - 1) // 200) AS win, quantile_cont(value, 0.5) AS m FROM m WHERE n <= 600 GROUP BY 1)
SELECT win AS "window", round(m, 6) AS median, round(abs(m / lag(m) OVER (ORDER BY win) - 1), 6) AS change, coalesce(abs(m / lag(m) OVER (ORDER BY win) - 1) < 0.1, true) AS stable FROM w""")
def warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the last three windows of samples (the limit is the feature: it looks at the last 600)."""
    return runs.warm_up(table(spark, sf_dir, "events"), "event_id", "value", 200, 0.1)


@query(f"""WITH {EPOCHS}, a AS (SELECT model, min(epoch) AS lo, max(epoch) AS hi FROM e GROUP BY model), g AS (SELECT unnest([0.5, 2.5, 7.25, 20]::DOUBLE[]) AS pt),
x AS (SELECT a.model, pt, greatest(lo, least(hi, pt)) AS c FROM a CROSS JOIN g), l AS (SELECT x.model, pt, c, max(e.epoch) AS p FROM x JOIN e ON e.model = x.model AND e.epoch <= c GROUP BY ALL), u AS (SELECT x.model, pt, min(e.epoch) AS q FROM x JOIN e ON e.model = x.model AND e.epoch >= c GROUP BY ALL)
SELECT l.model, l.pt AS point, round(CASE WHEN p = q THEN y.pc ELSE y.pc + (z.pc - y.pc) * (c - p) / (q - p) END, 6) AS value FROM l JOIN u ON u.model = l.model AND u.pt = l.pt JOIN e y ON y.model = l.model AND y.epoch = p JOIN e z ON z.model = l.model AND z.epoch = q""")
def interpolated_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve at points between its own."""
    return selection.interpolated(epochs(spark, sf_dir), ["model"], "epoch", "pc", [0.5, 2.5, 7.25, 20.0])


@query(f"""WITH {EPOCHS}, l AS (SELECT *, lag(pc) OVER (PARTITION BY model ORDER BY epoch) AS prev FROM e) SELECT model, bool_or(least(pc, prev) <= 0.951 AND greatest(pc, prev) >= 0.949) AS crosses, list_aggregate(list_sort(list(epoch)), 'string_agg', ',') AS epochs FROM l GROUP BY model""")
def crossing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose line crosses a band."""
    rows = epochs(spark, sf_dir).withColumn("prev", F.lag("pc").over(Window.partitionBy("model").orderBy("epoch")))
    inside = (F.least("pc", "prev") <= 0.951) & (F.greatest("pc", "prev") >= 0.949) & F.col("prev").isNotNull()
    return rows.groupBy("model").agg(F.bool_or(inside).alias("crosses"), F.array_join(F.transform(F.array_sort(F.collect_list("epoch")), lambda e: e.cast("string")), ",").alias("epochs"))


@query("""SELECT k AS name, CASE WHEN a AND b THEN 'both' WHEN a THEN 'found' ELSE 'configured' END AS origin FROM (SELECT coalesce(x.k, y.k) AS k, x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders) x FULL JOIN (SELECT c_custkey AS k FROM customer) y ON x.k = y.k) z""")
def model_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found against what is configured."""
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name")).distinct()
    return selection.inventory(found, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")), "name")


@query("SELECT o_custkey AS id, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS role FROM orders GROUP BY o_custkey")
def unambiguous_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role only where it is unambiguous."""
    return selection.unambiguous(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("role")), "id", "role")


@query("SELECT n AS class, (dense_rank() OVER (ORDER BY n) - 1) AS label FROM (SELECT DISTINCT c_nationkey::VARCHAR AS n FROM customer) s")
def dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes numbered in the order of their names as strings."""
    return selection.dense_labels(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("class")), "class")


@query("""WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, k) AS i, sum(n) OVER (ORDER BY n DESC, k ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS t FROM p)
SELECT count(*) AS n_keys, any_value(t)::BIGINT AS n_rows, round(max(n) / any_value(t), 6) AS largest_share, round(sum(n) FILTER (i <= 10) / any_value(t), 6) AS top_ten_share, min(i) FILTER (c >= t / 2) AS keys_for_half, median(n) AS median, round(any_value(t) * any_value(t) / sum(n * n), 6) AS effective_keys FROM o""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unevenly orders fall on customers."""
    return certify.concentration(table(spark, sf_dir, "orders"), "o_custkey")


@query(f"""WITH {RUNS} SELECT model, metric, round(avg(value), 6) AS mean, count(*) AS n FROM (UNPIVOT (SELECT model, pc, rr FROM r) ON pc, rr INTO NAME metric VALUE value) u GROUP BY ALL""")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics unpivoted to long rows and averaged."""
    rows = metric_rows(spark, sf_dir).unpivot(["model"], ["pc", "rr"], "metric", "value")
    return rows.groupBy("model", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS} SELECT model, round(avg(pc) FILTER (split = 1), 6) AS target_1, round(avg(pc) FILTER (split = 2), 6) AS target_2, round(avg(pc) FILTER (split = 3), 6) AS target_3 FROM r GROUP BY model""")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's targets side by side."""
    wide = metric_rows(spark, sf_dir).groupBy("model").pivot("split", [1, 2, 3]).agg(F.round(F.avg("pc"), 6))
    return wide.select("model", *[F.col(f"`{k}`").alias(f"target_{k}") for k in (1, 2, 3)])


@query("""WITH a AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT c.c_custkey AS id, 'original' AS kind FROM customer c JOIN a ON a.o_custkey = c.c_custkey UNION ALL SELECT first, 'derived' FROM a""")
def derived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one derived row for each class, from its first."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("id"))
    known = c.join(first, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("id"), F.lit("original").alias("kind"))
    return known.unionByName(first.select("id", F.lit("derived").alias("kind")))


@query(f"""WITH {RUNS}, t AS (SELECT model, x AS target, min(split) FILTER (pc >= x) AS met_at FROM r CROSS JOIN (SELECT unnest([0.945, 0.95]::DOUBLE[]) AS x) g GROUP BY ALL)
SELECT 'calibrated' AS chart, target, model, round(avg(r.pc), 6) AS value, row_number() OVER (PARTITION BY target ORDER BY round(avg(r.pc), 6) DESC, model) AS place FROM t JOIN r USING (model) WHERE split = met_at GROUP BY target, model
UNION ALL SELECT 'validation_rr', NULL, model, round(avg(rr), 6), row_number() OVER (ORDER BY round(avg(rr), 6) DESC, model) FROM r GROUP BY model""")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of completeness at the first split that reaches each target, and of reduction, best first, ties by name."""
    rows = metric_rows(spark, sf_dir)
    return runs.bars(rows, "model", "split", "pc", "rr", [0.945, 0.95])
