"""Look-ups over records, memberships and models, and what goes with them: caches by content, budgets of other models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fetch_records(files: DataFrame, classes: DataFrame, tags: DataFrame, label: str, ids: DataFrame | None = None, members: DataFrame | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Files (file_id, status, role) of the primary ``label`` of classes (file_id, class_id, primary_label), with their tags
    (file_id, tag) sorted, as tags_csv, '' where there are none. ``ids`` (file_id) and ``members`` (file_id) restrict them where
    given, an empty table to nothing; ``statuses`` are those that count."""
    rows = files
    if statuses is not None:
        rows = rows.where(F.col("status").isin(*statuses))
    for some in (ids, members):
        if some is not None:
            rows = rows.join(some.select("file_id"), "file_id", "left_semi")
    listed = tags.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags_csv"))
    rows = rows.join(classes.where(F.col("primary_label") == label).select("file_id", "class_id"), "file_id").join(listed, "file_id", "left")
    return rows.withColumn("tags_csv", F.coalesce("tags_csv", F.lit("")))


def ids_for_role_or_tag(records: DataFrame, roles: list[str], tag: str) -> DataFrame:
    """Ids of records (id, role, tags) that have ``tag``; where no record has it, those with one of ``roles`` in their comma list
    of roles, whatever its case."""
    tagged = F.array_contains("tags", tag)
    some = records.agg(F.coalesce(F.bool_or(tagged), F.lit(False)).alias("some"))
    parts = F.transform(F.split(F.lower(F.coalesce("role", F.lit(""))), ","), lambda p: F.trim(p))
    wanted = F.array(*[F.lit(r.strip().lower()) for r in roles])
    return records.join(F.broadcast(some)).where(F.when(F.col("some"), tagged).otherwise(F.arrays_overlap(parts, wanted))).select("id")  # one row


def id_list_hash(rows: DataFrame, group: str, id_: str) -> DataFrame:
    """For each group the sha256 of its ids as a sorted JSON list, which names its population: group, n, ids_hash."""
    listed = F.to_json(F.array_sort(F.collect_list(F.col(id_).cast("string"))))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sha2(listed, 256).alias("ids_hash"))


def donor_budgets(view: DataFrame, targets: list[float], tolerance: float = 0.0) -> DataFrame:
    """Of true pairs (model, partition, kind, rank), kind being calibration or test: for each model, other model (donor) and
    target, the smallest k that reaches the target on the donor's calibration pairs, applied to both models' test pairs of the
    same partition: partitions, mean completeness of either, wins, ties, and how often the target is attained."""
    by_rank = view.groupBy("model", "partition", "kind", "rank").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("model", "partition", "kind").orderBy("rank")
    whole = Window.partitionBy("model", "partition", "kind")
    curve = by_rank.select("model", "partition", "kind", "rank", F.sum("n").over(upto).alias("found"), F.sum("n").over(whole).alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    budgets = curve.where("kind = 'calibration'").select("*", wanted).where(F.col("found") >= F.ceil(F.col("target") * F.col("total") - 1e-9)).groupBy(F.col("model").alias("donor"), "partition", "target").agg(F.min("rank").alias("k"))
    test = view.where("kind = 'test'").select("model", "partition", "rank")
    reached = test.join(budgets, "partition").groupBy("donor", "partition", "target", "model").agg(F.avg((F.col("rank") <= F.col("k")).cast("double")).alias("pc"))
    donors = reached.where("model = donor").select("donor", "partition", "target", F.col("pc").alias("donor_pc"))
    both = reached.where("model <> donor").join(donors, ["donor", "partition", "target"])
    ok = lambda c: F.count_if(F.col(c) >= F.col("target") - tolerance - 1e-12)
    return both.groupBy("model", "donor", "target").agg(
        F.count(F.lit(1)).alias("partitions"), F.round(F.avg("pc"), 6).alias("pc"), F.round(F.avg("donor_pc"), 6).alias("donor_pc"), F.count_if(F.col("pc") > F.col("donor_pc") + 1e-12).alias("wins"), F.count_if(F.abs(F.col("pc") - F.col("donor_pc")) <= 1e-12).alias("ties"), ok("pc").alias("attained"), ok("donor_pc").alias("donor_attained"),
    )


def model_of_source(sources: DataFrame, models: DataFrame) -> DataFrame:
    """Sources (key, identities, fallback) with the configured model (model_id, aliases) that shares an alias with their
    identities, or else the fallback: key, model_id. A source that is of several models is an error."""
    names = models.select("model_id", F.explode("aliases").alias("alias"))
    hits = sources.select("key", F.explode(F.array_distinct("identities")).alias("alias")).join(names, "alias").groupBy("key").agg(F.collect_set("model_id").alias("of"))
    rows = sources.select("key", "fallback").join(hits, "key", "left")
    several = F.raise_error(F.concat(F.lit("a source of several models: "), F.col("key").cast("string"))).cast("string")
    return rows.select("key", F.when(F.size("of") > 1, several).otherwise(F.coalesce(F.try_element_at("of", F.lit(1)), F.col("fallback"))).alias("model_id"))


def membership_of(asked: DataFrame, membership: DataFrame) -> DataFrame:
    """For lists of names (list), by commas or semicolons and with or without folders, each name's subsets and roles of
    membership (file_id, subset, role), sorted: name, places; NOT_FOUND where it has none."""
    name = F.regexp_extract(F.trim("part"), r"([^/\\]*)$", 1)
    names = asked.select(F.explode(F.split("list", "[;,]")).alias("part")).select(name.alias("name")).where("name <> ''").distinct()
    places = membership.groupBy(F.col("file_id").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "subset", "role"))), ";").alias("places"))
    return names.join(places, "name", "left").withColumn("places", F.coalesce("places", F.lit("NOT_FOUND")))


def staged(names: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``names`` (name) with the folder that its prefix is staged from, and the path in it: the longest prefix holds; names
    without one are an error."""
    source = F.coalesce(*[F.when(F.col("name").startswith(p), F.lit(folder)) for p, folder in sorted(prefixes.items(), key=lambda x: -len(x[0]))], F.raise_error(F.concat(F.lit("no folder for "), F.col("name"))).cast("string"))
    return names.select("name", source.alias("folder")).withColumn("path", F.concat_ws("/", "folder", "name"))


def reused_vectors(wanted: DataFrame, caches: DataFrame, absolute: float = 2e-5, relative: float = 1e-5) -> DataFrame:
    """Contents (sha) with the vector that caches (cache, sha, vector) have of them: sha, vector, state. Where caches disagree by
    more than the tolerances the vector isn't used (state disagrees); states are cached, disagrees, missing."""
    first = caches.groupBy("sha").agg(F.min_by("vector", "cache").alias("vector"))
    both = caches.join(first.withColumnRenamed("vector", "first"), "sha")
    near = (F.size("vector") == F.size("first")) & F.forall(F.zip_with("vector", "first", lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda ok: F.coalesce(ok, F.lit(False)))
    state = both.groupBy("sha").agg(F.bool_and(near).alias("agree"))
    rows = wanted.select("sha").join(first.join(state, "sha"), "sha", "left")
    return rows.select("sha", F.when(F.col("agree"), F.col("vector")).alias("vector"), F.when(F.col("agree").isNull(), "missing").when(F.col("agree"), "cached").otherwise("disagrees").alias("state"))


def by_reference(pairs: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b, source_a) of two sets as (reference, query, shard): the end of set_b is the reference, and all pairs of a
    reference have one shard. Only keys are dealt here; a group of a shard is worked through in order."""
    reference = F.when(F.col("source_a") == "set_b", F.col("a")).otherwise(F.col("b"))
    query = F.when(F.col("source_a") == "set_b", F.col("b")).otherwise(F.col("a"))
    return pairs.select(reference.alias("reference"), query.alias("query")).withColumn("shard", F.pmod(F.xxhash64("reference"), F.lit(parts)).cast("int"))


def best_image(images: DataFrame, objects: DataFrame) -> DataFrame:
    """The first open image of each wanted object: images (object_id, uuid, sequence, viewtype, openaccess), objects (object_id);
    only primary views with open access count."""
    rows = images.where("viewtype = 'primary' and openaccess = 1").join(objects.select("object_id"), "object_id", "left_semi")
    return rows.groupBy("object_id").agg(F.min_by("uuid", F.struct("sequence", "uuid")).alias("uuid"))


def merged_missing(into: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """``into`` with the rows of ``extra`` whose key it doesn't have."""
    return into.unionByName(extra.join(into.select(*key), key, "left_anti").select(*into.columns))


def origin_code(role: Column) -> Column:
    """0 for historic roles, 1 for modern ones, by name or prefix; null for others."""
    return F.when((role == "historic") | role.startswith("historic_"), 0).when((role == "modern") | role.startswith("modern_"), 1)


def transfer_epoch(epochs: DataFrame, key: list[str], minimum: float, margin: float) -> DataFrame:
    """For each key the epoch of (epoch, pc, rr) that a calibration transfers best to: among those with pc above ``minimum``, the
    earliest whose rr is within ``margin`` of the best; keys without one have no row."""
    eligible = epochs.where(F.col("pc") > minimum)
    best = eligible.withColumn("best", F.max("rr").over(Window.partitionBy(*key)))
    return best.where(F.col("rr") >= F.col("best") - margin).groupBy(*key).agg(F.min("epoch").alias("epoch"), F.max("best").alias("best_rr"))


def unique_stems(rows: DataFrame) -> DataFrame:
    """Of (id, name): names made unique by _002, _003, ... in id order, past numbers that other rows have as their own name.

    The k-th repeat of a name takes the k-th free number from 2 on; a name such as ``x_002`` that stands by itself keeps it.
    """
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("id")))
    stem = rows.select(F.regexp_extract("name", r"^(.*)_(\d{3,})$", 1).alias("name"), F.regexp_extract("name", r"_(\d{3,})$", 1).alias("digits")).where("name <> '' and digits <> ''")
    number = F.col("digits").try_cast("long")  # null beyond all numbers that are given
    padded = lambda n: F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), "0")  # noqa: E731  lpad alone cuts 1000 to 100
    taken = stem.where(F.col("digits") == padded(number)).groupBy("name").agg(F.array_sort(F.collect_set(number)).alias("taken"))
    # the number of the k-th repeat (k = 2, 3, ...) is k plus the taken numbers from 2 on that come no later
    step = lambda n, t: F.when((t >= 2) & (t <= n), n + 1).otherwise(n)
    numbered = own.join(taken, "name", "left").withColumn("n", F.when(F.col("taken").isNull() | (F.col("k") == 1), F.col("k")).otherwise(F.aggregate("taken", F.col("k"), step)))
    return numbered.select("id", "name", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), padded(F.col("n")))).alias("unique_name"))
