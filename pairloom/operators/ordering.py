"""Global orders and numbers without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

#: Bits of monotonically_increasing_id() that count the rows of a partition.
ROWS = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their place, from 0, in a total order. Spark's range sort cuts them into ordered partitions; a row's place
    is that in its partition plus the rows of the partitions before, of which there is one count a partition."""
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", ROWS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = F.broadcast(counts.select("_part", before.alias("_before")))
    local = F.col("_at").bitwiseAND((1 << ROWS) - 1)
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, local + F.col("_before")).drop("_at", "_part", "_before")


def metric_order(mode: Column) -> Column:
    """The place of a selection mode among the rows of a run."""
    modes = ("top_k", "target_pc", "threshold", "calibrated_threshold", "calibrated_top_k")
    return F.coalesce(*[F.when(mode == m, F.lit(k)) for k, m in enumerate(modes)], F.lit(len(modes)))


def display_order(group: Column, name: Column, groups: list[str], pinned: list[str], explicit: list[str], trailing: list[str]) -> list[Column]:
    """Sort keys of table rows: groups as listed, the others behind them by name; in a group pinned rows, those in an explicit
    order, the rest by name, and trailing rows."""
    at = lambda x, some: F.coalesce(*[F.when(x == s, F.lit(k)) for k, s in enumerate(some)], F.lit(None).cast("int"))
    kind = F.when(name.isin(*pinned), 0).when(name.isin(*trailing), 3).when(name.isin(*explicit), 1).otherwise(2) if pinned or trailing or explicit else F.lit(2)
    place = F.coalesce(at(name, pinned), at(name, explicit), at(name, trailing), F.lit(0))
    return [F.coalesce(at(group, groups), F.lit(len(groups))), group, kind, place, name]
