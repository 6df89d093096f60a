"""Building and checking splits. Shuffles are of class lists, made on the driver with the named seed."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered


def divide_classes(classes: Sequence, ratios: dict[str, float], seed: int) -> dict[str, list]:
    """Classes to subsets by ratios after a seeded shuffle of the sorted list. Cuts are floors; the last subset with a
    ratio takes the rest, and an empty subset with a ratio takes one from the largest where that leaves it one."""
    if abs(sum(ratios.values()) - 1) > 1e-9 or min(ratios.values()) < 0:
        raise ValueError("ratios must be parts of 1")
    order = sorted(classes)
    random.Random(seed).shuffle(order)
    live = [name for name, r in ratios.items() if r > 0]
    out: dict[str, list] = {name: [] for name in ratios}
    at = 0
    for name in live[:-1]:
        n = int(len(order) * ratios[name])
        out[name], at = order[at : at + n], at + n
    out[live[-1]] = order[at:]
    for name in live:
        largest = max(live, key=lambda x: len(out[x]))
        if not out[name] and len(out[largest]) > 1:
            out[name].append(out[largest].pop())
    return out


def hashed_split(classes: DataFrame, key: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """divide_classes() for classes of any number, shuffled by a seeded sha256 and numbered without one task seeing all: ``key``
    and subset. Cuts are floors and the last subset with a ratio takes the rest; an empty subset takes none here."""
    if abs(sum(ratios.values()) - 1) > 1e-9 or min(ratios.values()) < 0:
        raise ValueError("ratios must be parts of 1")
    shuffled = numbered(classes, [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), F.col(key)], "place")
    total, at, subset = shuffled.count(), 0, None
    live = [name for name, r in ratios.items() if r > 0]
    for name in live[:-1]:
        at += int(total * ratios[name] + 1e-9)
        subset = F.when(F.col("place") < at, name) if subset is None else subset.when(F.col("place") < at, name)
    return shuffled.select(key, (F.lit(live[-1]) if subset is None else subset.otherwise(live[-1])).alias("subset"))


def membership(rows: DataFrame, parts: dict[str, list], key: str) -> DataFrame:
    """``rows`` with the subset of their class; classes in no subset fall out. ``parts`` has one entry a class."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    flat = spark.createDataFrame([(c, name) for name, classes in parts.items() for c in classes], f"{key} {kind}, subset string")
    return rows.join(F.broadcast(flat), key)


def halves(classes: Sequence, seed: int) -> dict[str, list]:
    order = sorted(classes)
    random.Random(seed).shuffle(order)
    return {"one": order[: len(order) // 2], "two": order[len(order) // 2 :]}


def covered_classes(rows: DataFrame, key: str, role: str, required: Sequence[str]) -> DataFrame:
    """For each class whether it has every required role."""
    flags = [F.bool_or(F.col(role) == r) for r in required]
    every = flags[0]
    for f in flags[1:]:
        every = every & f
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), every.alias("covered"))


def role_quotas(rows: DataFrame, key: str, role: str, quotas: dict[str, int]) -> DataFrame:
    """Counts of each role for each class, and whether they are the quotas exactly."""
    wide = rows.groupBy(key).agg(*[F.count_if(F.col(role) == r).alias(r) for r in quotas], F.count_if(~F.col(role).isin(*quotas)).alias("others"))
    exact = F.col("others") == 0
    for r, n in quotas.items():
        exact = exact & (F.col(r) == n)
    return wide.withColumn("exact", exact)


def subset_overlaps(rows: DataFrame, subset: str, key: str) -> DataFrame:
    """For every two subsets how many keys both have; leakage where it isn't 0."""
    one = rows.select(F.col(subset).alias("one"), key).distinct()
    two = one.withColumnRenamed("one", "two")
    names = rows.select(F.col(subset).alias("one")).distinct()
    every = names.crossJoin(names.withColumnRenamed("one", "two")).where("one < two")  # subsets are few
    found = one.join(two, key).where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("shared"))
    return every.join(found, ["one", "two"], "left").fillna(0, ["shared"])


def sample_per_class(rows: DataFrame, key: str, per_class: int, seed: int, id_col: str) -> DataFrame:
    """``per_class`` rows of each class by a seeded hash: the stratified sampler's draw, the same on every run."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), id_col), id_col))
    return rows.withColumn("_place", place).where(F.col("_place") <= per_class).drop("_place")


def first_per_class(rows: DataFrame, key: str, per_class: int, order: list[Column]) -> DataFrame:
    """The first ``per_class`` rows of each class in ``order``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= per_class).drop("_place")


def round_robin(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("slot", ((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) % n).cast("long"))
