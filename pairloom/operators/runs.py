"""Statistics over many runs: splits, training seeds, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_and_spread(value: Column) -> list[Column]:
    """Mean, sample standard deviation (0 for one value), least and most, rounded."""
    return [F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("most")]


def two_level(metrics: DataFrame, keys: list[str], split: str, value: str) -> DataFrame:
    """The mean over training seeds inside a split, then statistics over splits; counts are never pooled."""
    per = metrics.groupBy(*keys, split).agg(F.avg(value).alias("v"), F.count(F.lit(1)).alias("seeds"))
    return per.groupBy(*keys).agg(*mean_and_spread(F.col("v")), F.count(F.lit(1)).alias("splits"), F.sum("seeds").alias("runs"))


def paired(metrics: DataFrame, model: str, split: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Every two models over the splits that they share: wins, ties, losses of the first, and the mean difference."""
    per = metrics.groupBy(model, split).agg(F.avg(value).alias("v"))
    one = per.select(F.col(model).alias("model_a"), F.col(split).alias("s"), F.col("v").alias("va"))
    two = per.select(F.col(model).alias("model_b"), F.col(split).alias("s"), F.col("v").alias("vb"))
    d = F.col("va") - F.col("vb")
    rows = one.join(two, one["s"].eqNullSafe(two["s"])).where("model_a < model_b")
    return rows.groupBy("model_a", "model_b").agg(F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"), F.round(F.avg(d), 6).alias("mean_difference"))


def attainment(metrics: DataFrame, keys: list[str], value: str, target: float, tolerance: float = 1e-12) -> DataFrame:
    ok = F.col(value) >= target - tolerance
    return metrics.groupBy(*keys).agg(F.count_if(ok).alias("attained"), F.count(F.lit(1)).alias("runs"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


def population_check(rows: DataFrame, group: list[str], signature: list[str], size: str, tolerance: float = 1.10) -> DataFrame:
    """For each group whether all rows have one signature, and whether sizes spread by more than a tenth."""
    return rows.groupBy(*group).agg(F.countDistinct(F.struct(*signature)).alias("signatures"), F.min(size).alias("least"), F.max(size).alias("most"), F.coalesce(F.max(size) / F.min(size) > tolerance, F.lit(False)).alias("spread"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def seed_spans(metrics: DataFrame, model: str, seed: str, seeds: list, value: str) -> DataFrame:
    """A column for each training seed, and the span over them."""
    wide = metrics.groupBy(model).pivot(seed, seeds).agg(F.round(F.avg(value), 6))
    cells = [F.col(f"`{s}`") for s in seeds]
    return wide.select(model, *[c.alias(f"seed_{s}") for c, s in zip(cells, seeds)], F.round(F.greatest(*cells) - F.least(*cells), 6).alias("span"))


def latency_summary(samples: DataFrame, model: str, value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return samples.groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(q(0.5), 6).alias("median"), F.round(q(0.9), 6).alias("p90"), F.round(q(0.75) - q(0.25), 6).alias("iqr"), F.round(1e3 / F.avg(value), 6).alias("per_second"))


def block_ratios(samples: DataFrame, block: str, model: str, value: str, base: str) -> DataFrame:
    """Each model's block means over the base model's in the same block."""
    per = samples.groupBy(block, model).agg(F.avg(value).alias("v"))
    rows = per.join(per.where(F.col(model) == base).select(block, F.col("v").alias("vb")), block)
    return rows.groupBy(model).agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg(F.col("v") / F.col("vb")), 6).alias("mean_ratio"))


def density_average(rows: DataFrame, model: str, split: str, repeat: str, bin_: str, width: float) -> DataFrame:
    """Histograms of unit area for each source, averaged over repeats, then mean, least and most over splits."""
    counts = rows.groupBy(model, split, repeat, bin_).agg(F.count(F.lit(1)).alias("n"))
    density = counts.withColumn("d", F.col("n") / (F.sum("n").over(Window.partitionBy(model, split, repeat)) * width))
    repeats = rows.groupBy(model, split).agg(F.countDistinct(repeat).alias("repeats"))
    per = density.groupBy(model, split, bin_).agg(F.sum("d").alias("d")).join(repeats, [model, split]).withColumn("d", F.col("d") / F.col("repeats"))
    return per.groupBy(model, bin_).agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.min("d"), 6).alias("least"), F.round(F.max("d"), 6).alias("most"), F.count(F.lit(1)).alias("splits"))


def funnel(rows: DataFrame, steps: list[tuple[str, bool, float]], key: str) -> DataFrame:
    """Rows left after each step (column, whether more is better, margin) kept those within the margin of the leader; what
    is left at the end in order of ``key``. Margins aren't transitive, so no single sort does it."""
    for column, more, margin in steps:
        edge = rows.agg((F.max(column) - margin if more else F.min(column) + margin).alias("edge"))
        near = F.col(column) >= F.col("edge") if more else F.col(column) <= F.col("edge")
        rows = rows.join(F.broadcast(edge)).where(near).drop("edge")  # one row
    return rows.orderBy(key)


def extremes(rows: DataFrame, group: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Marks on the best value of each group and overall, ties included, and the second-best distinct value."""
    here, everywhere = Window.partitionBy(*group), Window.partitionBy(F.lit(0))
    best = F.max(value).over(here)
    second = F.max(F.when(F.col(value) < F.col("best") - tolerance, F.col(value))).over(here)
    rows = rows.withColumn("best", best).withColumn("second", second)
    return rows.withColumn("is_best", F.abs(F.col(value) - F.col("best")) <= tolerance).withColumn("is_overall_best", F.abs(F.col(value) - F.max(value).over(everywhere)) <= tolerance)


def ranked_models(rows: DataFrame, group: list[str], model: str, value: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), model)).cast("long"))


def against_base(rows: DataFrame, group: list[str], model: str, base: str, value: str) -> DataFrame:
    """Each row with the difference to the base model's of the same group."""
    own = rows.where(F.col(model) == base).select(*group, F.col(value).alias("base_value"))
    return rows.join(own, group).withColumn("delta", F.round(F.col(value) - F.col("base_value"), 6))


def warm_up(samples: DataFrame, order: str, value: str, window: int, tolerance: float) -> DataFrame:
    """Medians of the last three windows of ``window`` samples, newest last, and whether neighbours differ by less than
    the tolerance relatively."""
    back = samples.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(order)))).where(F.col("_n") <= 3 * window)
    med = back.groupBy((2 - F.floor((F.col("_n") - 1) / window)).cast("long").alias("window")).agg(F.percentile(value, F.lit(0.5)).alias("m"))
    change = F.abs(F.col("m") / F.lag("m").over(Window.orderBy("window")) - 1)
    return med.select("window", F.round("m", 6).alias("median"), F.round(change, 6).alias("change"), F.coalesce(change < tolerance, F.lit(True)).alias("stable"))


def early_stop(epochs: DataFrame, group: str, epoch: str, value: str) -> DataFrame:
    """Each epoch's count of epochs since the last new best, by group: gaps and islands."""
    order = Window.partitionBy(group).orderBy(epoch)
    before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = epochs.withColumn("new_best", F.coalesce(F.col(value) > before, F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("new_best").cast("long")).over(order))
    since = F.row_number().over(Window.partitionBy(group, "island").orderBy(epoch)) - 1
    return rows.withColumn("since_best", since.cast("long")).drop("island")


def bars(rows: DataFrame, model: str, step: str, pc: str, rr: str, targets: list[float]) -> DataFrame:
    """Bars of charts: for each target the models' mean ``pc`` at the first step that reaches it, models that never do having
    none, and every model's mean ``rr``: chart, target, model, value, place (best first, ties by name)."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    first = rows.select(model, step, pc, wanted).where(F.col(pc) >= F.col("target")).groupBy(model, "target").agg(F.min(step).alias("_at"))
    met = rows.join(first, model).where(F.col(step) == F.col("_at")).groupBy("target", model).agg(F.round(F.avg(pc), 6).alias("value"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), model))
    met = met.select(F.lit("calibrated").alias("chart"), "target", model, "value", place("target").alias("place"))
    other = rows.groupBy(model).agg(F.round(F.avg(rr), 6).alias("value")).select(F.lit("validation_rr").alias("chart"), F.lit(None).cast("double").alias("target"), model, "value")
    return met.unionByName(other.withColumn("place", place("chart")))
