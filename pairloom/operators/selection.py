"""Choosing checkpoints and models from metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def best_by(rows: DataFrame, group: list[str], order: list[Column], where: Column | None = None) -> DataFrame:
    """The first row of each group in ``order`` among those for which ``where`` holds."""
    rows = rows if where is None else rows.where(where)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def incumbent(rows: DataFrame, group: list[str], epoch: str, value: str, second: str, margin: float) -> DataFrame:
    """The epoch that holds the lead after an ordered fold: a later one takes it if it is better by more than ``margin``, or
    within the margin and better in ``second``. The result depends on the order, so no aggregate by maximum gives it."""
    items = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(value).alias("v"), F.col(second).alias("s"))))

    def step(best: Column, x: Column) -> Column:
        wins = (x["v"] > best["v"] + margin) | ((F.abs(x["v"] - best["v"]) <= margin) & (x["s"] > best["s"]))
        return F.when(wins, x).otherwise(best)

    per = rows.groupBy(*group).agg(items.alias("items"))
    lead = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), F.element_at("items", 1), step)
    return per.select(*group, lead.alias("x")).select(*group, F.col("x.e").alias(epoch), F.col("x.v").alias(value), F.col("x.s").alias(second))


def preferred_k(rows: DataFrame, group: list[str], k: str, wanted: int, most: int) -> DataFrame:
    """The k to show: the wanted one if there, else the largest not above ``most``, else the smallest."""
    return rows.groupBy(*group).agg(F.coalesce(F.max(F.when(F.col(k) == wanted, F.col(k))), F.max(F.when(F.col(k) <= most, F.col(k))), F.min(k)).alias("k"))


def same_population(rows: DataFrame, task: list[str], model: str, signature: list[str]) -> DataFrame:
    """For each task the number of models and of different populations they were measured on: 1 is as it should be."""
    return rows.groupBy(*task).agg(F.countDistinct(model).alias("models"), F.countDistinct(F.struct(*signature)).alias("populations"))


def inventory(found: DataFrame, configured: DataFrame, key: str) -> DataFrame:
    """Models found and configured, side by side, with where each is from."""
    rows = found.withColumn("is_found", F.lit(True)).join(configured.withColumn("is_configured", F.lit(True)), key, "full")
    f, c = F.coalesce("is_found", F.lit(False)), F.coalesce("is_configured", F.lit(False))
    return rows.select(key, F.when(f & c, "both").when(f, "found").otherwise("configured").alias("origin"))


def unambiguous(rows: DataFrame, key: str, role: str) -> DataFrame:
    """A key's role where it has only one, else null."""
    return rows.groupBy(key).agg(F.when(F.countDistinct(role) == 1, F.max(role)).alias(role))


def dense_labels(rows: DataFrame, key: str) -> DataFrame:
    """Keys numbered from 0 in order, as strings order."""
    keys = rows.select(F.col(key).cast("string").alias(key)).distinct()
    return numbered(keys, [F.col(key)], "label").select(key, "label")


def interpolated(curve: DataFrame, group: list[str], x: str, y: str, grid: list[float]) -> DataFrame:
    """A curve's values at grid points, linear between its points and held at its ends."""
    spark = curve.sparkSession
    keys = curve.select(*group).distinct()
    wanted = keys.crossJoin(F.broadcast(spark.createDataFrame([(float(g),) for g in grid], "g double")))  # keys by grid points
    rows = curve.select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(False).alias("asked"))
    rows = rows.unionByName(wanted.select(*group, F.col("g").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("asked")))
    point = F.when(~F.col("asked"), F.struct("x", "y"))
    upto = Window.partitionBy(*group).orderBy("x", "asked").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*group).orderBy("x", F.desc("asked")).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("p", F.last(point, ignorenulls=True).over(upto)).withColumn("n", F.first(point, ignorenulls=True).over(down)).where("asked")
    inner = F.col("p.y") + (F.col("n.y") - F.col("p.y")) * (F.col("x") - F.col("p.x")) / (F.col("n.x") - F.col("p.x"))
    value = F.when(F.col("p").isNull(), F.col("n.y")).when(F.col("n").isNull() | (F.col("n.x") == F.col("p.x")), F.col("p.y")).otherwise(inner)
    return rows.select(*group, F.col("x").alias("point"), F.round(value, 6).alias("value"))
