"""Admission of runs, choice of sources, merges of shards, split plans, and what is published of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def admitted_runs(runs: DataFrame, approved: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Runs (run_dir, run_id, status, and the columns that ``wanted`` names) with the reason for which each is skipped, or
    'admitted'. ``approved`` (name) has paths, ids or last parts of paths; a run must be approved, completed, and have the
    wanted values, in that order of reasons."""
    base = F.regexp_extract("run_dir", "[^/]+$", 0)
    names = F.array_distinct(F.array("run_dir", F.coalesce("run_id", base), base))
    listed = runs.select("run_dir", F.explode(names).alias("name")).join(approved.select("name"), "name", "left_semi").select("run_dir", F.lit(True).alias("listed")).distinct()
    reason = F.when(F.col("listed").isNull(), "not_approved").when(~F.coalesce(F.col("status") == "completed", F.lit(False)), "not_completed")
    for column, value in wanted.items():
        reason = reason.when(~F.coalesce(F.col(column) == value, F.lit(False)), f"other_{column}")
    return runs.join(listed, "run_dir", "left").withColumn("reason", reason.otherwise("admitted")).drop("listed")


def chosen_sources(candidates: DataFrame, cell: list[str], capabilities: list[str], required: list[str], policy: str) -> DataFrame:
    """The source of each cell among candidates (created_at, run_dir and a flag for each capability): one that has what is
    required first, then, unless the newest is asked for, the one with most capabilities, then the newest, then by path."""
    if policy not in ("newest_complete", "richest_then_newest", "prefer_existing"):
        raise ValueError(f"unknown policy: {policy}")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    has = F.least(*[flag(c) for c in required], F.lit(1)) if required else F.lit(1)
    rich = sum((flag(c) for c in capabilities), F.lit(0)) if policy != "newest_complete" else F.lit(0)
    score = F.struct(has, rich, F.coalesce("created_at", F.lit("")), "run_dir")
    return candidates.groupBy(*cell).agg(F.max_by("run_dir", score).alias("run_dir"), F.max_by(has, score).cast("boolean").alias("complete"))


def canonical_rows(rows: DataFrame, key: str, groups: DataFrame, also: list[str]) -> DataFrame:
    """Rows without the members of groups (group, member, canonical) that aren't their group's predeclared one; ``also`` are
    kept all the same."""
    others = groups.where("member <> canonical").where(~F.col("member").isin(*also) if also else F.lit(True)).select(F.col("member").alias(key)).distinct()
    return rows.join(others, key, "left_anti")


def finite_series(rows: DataFrame, model: str, x: str, y: str) -> DataFrame:
    """Each model's values in the order of ``x``, as lists; a model with a value that is missing or not finite has none."""
    fine = F.col(y).isNotNull() & ~F.isnan(y) & (F.abs(F.col(y)) != float("inf"))
    series = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    per = rows.where(F.col(x).isNotNull()).groupBy(model).agg(series.alias("s"), F.bool_and(fine).alias("fine")).where("fine")
    return per.select(model, F.transform("s", lambda p: p["x"]).alias(x), F.transform("s", lambda p: p["y"]).alias(y))


def weighted_scores(rows: DataFrame, group: str, weights: tuple[float, float, float]) -> DataFrame:
    """Of (k, pc, transferred_pc, transferred_rr) by group: the weighted sum of the mean completeness over the k and of the
    transferred completeness and reduction; a value that isn't in [0, 1] is an error."""
    bad = F.raise_error(F.concat(F.lit("not in [0, 1]: "), F.col(group).cast("string"))).cast("double")
    checked = lambda c: F.when(F.col(c).between(0, 1), F.col(c)).otherwise(bad)
    per = rows.groupBy(group).agg(F.avg(checked("pc")).alias("mean_pc"), F.max(checked("transferred_pc")).alias("tp"), F.max(checked("transferred_rr")).alias("tr"))
    a, b, c = weights
    return per.select(group, F.round("mean_pc", 6).alias("mean_pc"), F.round(a * F.col("mean_pc") + b * F.col("tp") + c * F.col("tr"), 6).alias("score"))


def merged_shards(outcomes: DataFrame, shards: int, candidates: DataFrame, expected_hash: str) -> DataFrame:
    """Outcomes (shard, a, b, status, prediction, candidates_hash) of all shards as one row of counts. Shards must be all there,
    have been made for the same candidates, and cover every candidate pair (a, b) once; anything else is an error."""
    per = outcomes.agg(
        F.countDistinct("shard").alias("shards"), F.count_if(F.col("candidates_hash") != expected_hash).alias("foreign"), F.count(F.lit(1)).alias("candidate_count"), F.countDistinct("a", "b").alias("pairs"),
        F.count_if(F.col("status") == "ok").alias("completed_count"), F.count_if((F.col("status") == "ok") & (F.col("prediction") == 1)).alias("positive_count"), F.count_if((F.col("status") == "ok") & ~F.coalesce(F.col("prediction") == 1, F.lit(False))).alias("negative_count"), F.count_if(F.col("status") != "ok").alias("failed_count"),
    )
    missing = candidates.join(outcomes.select("a", "b"), ["a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    rows = per.join(F.broadcast(missing))  # one row each
    wrong = F.when(F.col("shards") != shards, "a shard is missing").when(F.col("foreign") > 0, "a shard of other candidates").when((F.col("missing") > 0) | (F.col("pairs") != F.col("candidate_count")), "shards don't cover the candidates once")
    counts = ["candidate_count", "completed_count", "positive_count", "negative_count", "failed_count"]
    return rows.select(*[F.when(wrong.isNull(), F.col(c)).otherwise(F.raise_error(wrong).cast("long")).alias(c) for c in counts])


def denominators(rows: DataFrame, key: list[str], population: list[str], pairs: str, seed: str) -> DataFrame:
    """An audit row for each split: its population as it stands (an error where training seeds differ in it), the mean of the
    pairs retained, and their values by seed."""
    same = [F.when(F.countDistinct(c) == 1, F.max(c)).otherwise(F.raise_error(F.lit(f"{c} differs between training seeds")).cast("long")).alias(c) for c in population]
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seed, pairs))), lambda x: x[pairs].cast("string")), ";")
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("training_repeats"), *same, F.round(F.avg(pairs), 6).alias("mean_pairs"), values.alias("pairs_by_seed"))


def shuffled(rows: DataFrame, key: Column, seed: int, name: str = "place") -> DataFrame:
    """Rows numbered in the order of a seeded hash of ``key``: the same shuffle on every engine, without one task seeing all."""
    return numbered(rows, [F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), key], name)


def partitioned_assets(assets: DataFrame, seed: int, subsets: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Assets (type, digest) dealt to subsets in turn inside each type, after a shuffle by a seeded hash: every subset has some of
    each type that has as many."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), "type", F.lit(":"), "digest"), 256)
    place = F.row_number().over(Window.partitionBy("type").orderBy(order, "digest")) - 1
    return assets.select("type", "digest", F.element_at(F.array(*[F.lit(s) for s in subsets]), (place % len(subsets) + 1).cast("int")).alias("subset"))


def distractor_splits(images: DataFrame, known: DataFrame, first_class: int, seeds: list[int]) -> DataFrame:
    """Distractor images (name, identity) in two halves for each seed: seed, identity, class_id, subset, images. All images of an
    identity are in one subset and have one class, numbered from ``first_class`` in the order of identities; a name that
    ``known`` (name) has is an error."""
    clash = images.join(known.select("name", F.lit(True).alias("is_known")), "name", "left")
    bad = F.raise_error(F.concat(F.lit("a distractor has the name of an image: "), F.col("name"))).cast("string")
    groups = clash.withColumn("name", F.when(F.col("is_known").isNull(), F.col("name")).otherwise(bad)).groupBy("identity").agg(F.count("name").alias("images"))
    classed = numbered(groups, [F.col("identity")], "place").select("identity", "images", (F.col("place") + first_class).alias("class_id"))
    total, out = classed.count(), None
    for seed in seeds:
        rows = shuffled(classed, F.col("identity"), seed).select(F.lit(seed).alias("seed"), "identity", "class_id", F.when(F.col("place") < total // 2, "val").otherwise("test").alias("subset"), "images")
        out = rows if out is None else out.unionByName(rows)
    return out


def galleries(queries: DataFrame, photos: DataFrame) -> DataFrame:
    """Query identities (identity) with their catalogue photos (identity, photo) counted; an identity without a photo is an
    error."""
    per = photos.groupBy("identity").agg(F.count(F.lit(1)).alias("photos"))
    lacks = F.raise_error(F.concat(F.lit("no gallery for "), F.col("identity").cast("string"))).cast("long")
    return queries.select("identity").distinct().join(per, "identity", "left").withColumn("photos", F.coalesce("photos", lacks))


def finalised(split: DataFrame, files: DataFrame) -> DataFrame:
    """Split members (subset, role, file_id) with names, classes and provenance of files (file_id, name, class_id, source). A
    member without a file, a name that two files share, and a file that is twice in a subset are errors."""
    named = files.join(files.groupBy("name").agg(F.count(F.lit(1)).alias("_same")), "name")
    rows = split.join(named, "file_id", "left").withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("subset", "file_id")))
    wrong = F.when(F.col("name").isNull(), "a member without a file").when(F.col("_same") > 1, "a name of two files").when(F.col("_times") > 1, "a file twice in a subset")
    return rows.withColumn("name", F.when(wrong.isNull(), F.col("name")).otherwise(F.raise_error(F.concat(wrong, F.lit(": "), F.col("file_id"))).cast("string"))).drop("_same", "_times")


def role_batches(rows: DataFrame, classes: int, quotas: dict[str, int], seed: int) -> DataFrame:
    """Batches of a role-stratified sampler over (class, role, id): ``classes`` classes a batch, and of each class so many rows of
    every role, in a shuffle by a seeded hash; a class that lacks a role's quota is left out, and so is a last, short batch."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("class", "role").orderBy(order, "id"))
    wanted = F.coalesce(*[F.when(F.col("role") == r, F.lit(n)) for r, n in quotas.items()], F.lit(0))
    drawn = rows.withColumn("_p", place).where(F.col("_p") <= wanted).drop("_p")
    whole = drawn.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == sum(quotas.values())).select("class")
    dealt = shuffled(whole, F.col("class"), seed).withColumn("batch", F.floor(F.col("place") / classes))
    full = dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == classes).select("batch")
    return drawn.join(dealt.select("class", "batch").join(full, "batch", "left_semi"), "class")


def cost_projection(rows: DataFrame, k: str, rate: float, per_day: float) -> DataFrame:
    """Hours of verification a day for budgets of ``k`` candidates a query at ``rate`` pairs a second and ``per_day`` queries, and
    their ratio to the smallest budget."""
    hours = F.col(k) / rate * per_day / 3600
    return rows.select(k, F.round(hours, 4).alias("hours_per_day"), F.round(F.col(k) / F.min(k).over(Window.partitionBy(F.lit(0))), 6).alias("ratio"))  # a row a budget
