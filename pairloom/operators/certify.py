"""Risk control, resampling intervals and concentration, all on one row per class or less."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import found_by_class
from .ordering import numbered


def class_losses(view: DataFrame, budgets: list[int]) -> DataFrame:
    """For each budget k and class, one minus the share of its true pairs within rank k."""
    per = found_by_class(view, budgets)
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("found")) for k in budgets])).alias("g")
    return per.select("query_class", "n", grid).select("query_class", F.col("g.k").alias("k"), (1 - F.col("g.found") / F.col("n")).alias("loss"))


def conformal_points(losses: DataFrame, alphas: list[float]) -> DataFrame:
    """For each alpha the first budget from which on the bound n/(n+1) mean(loss) + 1/(n+1) <= alpha holds at every larger
    one; null where the last budget fails. classes_needed is the least number of classes with which alpha can hold at all."""
    by_k = losses.groupBy("k").agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("classes"))
    bound = F.col("classes") / (F.col("classes") + 1) * F.col("mean_loss") + 1 / (F.col("classes") + 1)
    by_k = by_k.withColumn("bound", F.round(bound, 9))
    wanted = by_k.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")
    grid = wanted.join(by_k).withColumn("holds", F.col("bound") <= F.col("alpha"))  # alphas by budgets
    last = grid.groupBy("alpha").agg(F.max(F.when(~F.col("holds"), F.col("k"))).alias("failed"))
    safe = grid.join(last, "alpha").where("k > coalesce(failed, -1)").groupBy("alpha").agg(F.min(F.struct("k", "bound")).alias("s"))
    out = wanted.join(safe, "alpha", "left")
    return out.select("alpha", F.col("s.k").alias("k"), F.round("s.bound", 6).alias("bound"), F.ceil(F.round(1 / F.col("alpha"), 9) - 1).cast("long").alias("classes_needed"))


def bootstrap_draws(classes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """How often each resample draws each class (class): resample, class, times; shared by all that are compared. A draw is a
    hash of the seed, the resample and the draw's number, modulo the number of classes, so any engine draws the same."""
    order = numbered(classes.select("class").distinct(), [F.col("class")], "place")
    n = order.count()
    draws = classes.sparkSession.range(resamples).select(F.col("id").cast("int").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))).alias("k"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    times = draws.groupBy("resample", (number % max(1, n)).alias("place")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    return times.join(F.broadcast(order), "place").select("resample", "class", "times")  # a row a class


def bootstrap_interval(values: DataFrame, draws: DataFrame, level: float = 0.95) -> DataFrame:
    """Of (key, class, value) and shared draws (resample, class, times): for each key the mean over classes, the interval
    of resampled means, and the share of resamples above zero."""
    means = values.join(draws, "class").groupBy("key", "resample").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("m"))
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    spread = means.groupBy("key").agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("positive"))
    centre = values.groupBy("key").agg(F.avg("value").alias("mean"))
    return centre.join(spread, "key").select("key", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "positive")], ((F.col("low") > 0) | (F.col("high") < 0)).alias("zero_excluded"))


def concentration(rows: DataFrame, key: str) -> DataFrame:
    """How unevenly rows fall on keys: n_keys, largest and top ten shares, keys that hold half, median, and the effective
    number of keys, T^2 / sum n^2."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy("n").agg(F.count(F.lit(1)).alias("m"))  # sizes are few, so the window below sees few rows
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sizes = sizes.select("n", "m", F.coalesce(F.sum("m").over(down), F.lit(0)).alias("keys"), F.coalesce(F.sum(F.col("n") * F.col("m")).over(down), F.lit(0)).alias("rows"), F.sum(F.col("n") * F.col("m")).over(every).alias("total"))
    ten = F.greatest(F.lit(0), F.least(F.col("m"), 10 - F.col("keys"))) * F.col("n")
    need = F.ceil((F.col("total") / 2 - F.col("rows")) / F.col("n"))
    half = F.when((F.col("rows") < F.col("total") / 2) & (F.col("rows") + F.col("n") * F.col("m") >= F.col("total") / 2), F.col("keys") + need)
    out = sizes.agg(F.sum("m").alias("n_keys"), F.max("total").alias("total"), F.max("n").alias("largest"), F.sum(ten).alias("ten"), F.max(half).alias("half"), F.sum(F.col("n") * F.col("n") * F.col("m")).alias("squares"))
    median = per.agg(F.median("n").alias("median"))
    out = out.join(F.broadcast(median))  # one row each
    return out.select("n_keys", F.col("total").cast("long").alias("n_rows"), F.round(F.col("largest") / F.col("total"), 6).alias("largest_share"), F.round(F.col("ten") / F.col("total"), 6).alias("top_ten_share"), F.col("half").cast("long").alias("keys_for_half"), "median", F.round(F.col("total") * F.col("total") / F.col("squares"), 6).alias("effective_keys"))


def without_largest(view: DataFrame, k: int) -> DataFrame:
    """Completeness at k pooled, without the class of most true pairs (ties: the smallest), and of that class alone."""
    per = found_by_class(view, [k]).withColumnRenamed(f"n{k}", "found")
    largest = per.agg(F.max(F.struct("n", (-F.col("query_class")).alias("c"), "found")).alias("x"), F.sum("n").alias("n"), F.sum("found").alias("found"))
    n, found = F.col("n") - F.col("x.n"), F.col("found") - F.col("x.found")
    return largest.select((-F.col("x.c")).alias("largest_class"), F.round(F.col("found") / F.col("n"), 6).alias("pooled_pc"), F.round(found / n, 6).alias("pc_without"), F.round(F.col("x.found") / F.col("x.n"), 6).alias("pc_of_largest"))
