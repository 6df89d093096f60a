"""Queries around published results: admission, sources, shards, split plans, sinks and cached scans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import publishing, splits
from ..sources import manifests
from ..sources.storage import write_texts
from .matching import folder
from .registry import query, table


@query("""WITH r AS (SELECT 'runs/' || o_orderkey AS run_dir, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'id' || o_orderkey END AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status, o_orderpriority AS dataset, o_orderkey AS k FROM orders)
SELECT CASE WHEN NOT (k % 5 = 0 OR (k % 7 = 0 AND run_id IS NOT NULL) OR k % 11 = 0) THEN 'not_approved' WHEN status <> 'completed' THEN 'not_completed' WHEN dataset <> '1-URGENT' THEN 'other_dataset' ELSE 'admitted' END AS reason, count(*) AS runs FROM r GROUP BY 1""")
def run_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the reason for which they are skipped: approved by path, id or last part of the path, completed, and of
    the wanted dataset."""
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(F.concat(F.lit("runs/"), k.cast("string")).alias("run_dir"), F.when(k % 3 != 0, F.concat(F.lit("id"), k.cast("string"))).alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderpriority").alias("dataset"), k.alias("k"))
    approved = runs.where("k % 5 = 0").select(F.col("run_dir").alias("name")).union(runs.where("k % 7 = 0").select("run_id")).union(runs.where("k % 11 = 0").select(F.col("k").cast("string")))
    return publishing.admitted_runs(runs, approved.where("name is not null"), {"dataset": "1-URGENT"}).groupBy("reason").agg(F.count(F.lit(1)).alias("runs"))


CELLS = "c AS (SELECT l_partkey AS cell, 'run' || lpad(l_orderkey::VARCHAR, 9, '0') || '-' || l_linenumber || '-' || l_suppkey AS run_dir, strftime(l_shipdate, '%Y-%m-%d') AS created_at, l_quantity > 10 AS a, l_discount > 0.05 AS b, l_tax > 0.04 AS c FROM lineitem)"


@query(f"""WITH {CELLS} SELECT cell, arg_max(run_dir, (a::INT, a::INT + b::INT + c::INT, created_at, run_dir)) AS run_dir, bool_or(a) AS complete, arg_max(run_dir, (a::INT, created_at, run_dir)) AS newest FROM c GROUP BY cell""")
def cell_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of each cell by what it must have, richness, age and path, and by the policy that takes the newest."""
    li, text = table(spark, sf_dir, "lineitem"), lambda c: F.col(c).cast("string")
    run = F.concat(F.lit("run"), F.lpad(text("l_orderkey"), 9, "0"), F.lit("-"), text("l_linenumber"), F.lit("-"), text("l_suppkey"))
    rows = li.select(F.col("l_partkey").alias("cell"), run.alias("run_dir"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"), (F.col("l_quantity") > 10).alias("a"), (F.col("l_discount") > 0.05).alias("b"), (F.col("l_tax") > 0.04).alias("c"))
    best = publishing.chosen_sources(rows, ["cell"], ["a", "b", "c"], ["a"], "richest_then_newest")
    newest = publishing.chosen_sources(rows, ["cell"], ["a", "b", "c"], ["a"], "newest_complete")
    return best.join(newest.select("cell", F.col("run_dir").alias("newest")), "cell")


@query("""SELECT c_mktsegment AS model, count(*) AS rows FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD') GROUP BY 1""")
def canonical_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the representatives that groups have declared, of one more that is asked for, and of models in no group."""
    groups = spark.createDataFrame([("g", "AUTOMOBILE", "AUTOMOBILE"), ("g", "MACHINERY", "AUTOMOBILE"), ("h", "FURNITURE", "BUILDING"), ("h", "HOUSEHOLD", "BUILDING"), ("h", "BUILDING", "BUILDING")], "group string, member string, canonical string")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"))
    return publishing.canonical_rows(rows, "model", groups, ["FURNITURE"]).groupBy("model").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH e AS (SELECT l_returnflag || l_linestatus AS model, l_linenumber AS k, CASE WHEN l_returnflag = 'A' AND l_linenumber = 4 THEN NULL ELSE round(avg(1 - l_discount), 6) END AS pc FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)
SELECT model, string_agg(k, ',' ORDER BY k) AS ks, round(sum(pc), 6) AS total FROM e GROUP BY model HAVING bool_and(pc IS NOT NULL)""")
def finite_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's series over k; one with a value that isn't finite is left out."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("k")).agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("pc"))
    rows = rows.select(F.concat("l_returnflag", "l_linestatus").alias("model"), "k", F.when((F.col("l_returnflag") == "A") & (F.col("k") == 4), float("nan")).otherwise(F.col("pc")).alias("pc"))
    got = publishing.finite_series(rows, "model", "k", "pc")
    return got.select("model", F.array_join(F.transform("k", lambda k: k.cast("string")), ",").alias("ks"), F.round(F.aggregate("pc", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH e AS (SELECT l_returnflag AS model, l_linenumber AS k, avg(1 - l_discount) AS pc FROM lineitem WHERE l_linenumber IN (1, 5) GROUP BY ALL), t AS (SELECT l_returnflag AS model, avg(1 - l_tax) AS tp, avg(l_quantity) / 100 AS tr FROM lineitem GROUP BY 1)
SELECT model, round(avg(pc), 6) AS mean_pc, round(0.5 * avg(pc) + 0.3 * max(tp) + 0.2 * max(tr), 6) AS score FROM e JOIN t USING (model) GROUP BY model""")
def transfer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score of mean completeness at fixed k and of transferred completeness and reduction."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "model")
    fixed = li.where("l_linenumber in (1, 5)").groupBy("model", F.col("l_linenumber").alias("k")).agg(F.avg(1 - F.col("l_discount")).alias("pc"))
    moved = li.groupBy("model").agg(F.avg(1 - F.col("l_tax")).alias("transferred_pc"), (F.avg("l_quantity") / 100).alias("transferred_rr"))
    return publishing.weighted_scores(fixed.join(moved, "model"), "model", (0.5, 0.3, 0.2))


@query("""SELECT count(*) AS candidate_count, count(*) FILTER (o_orderstatus <> 'P') AS completed_count, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice > 200000) AS positive_count, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice <= 200000) AS negative_count, count(*) FILTER (o_orderstatus = 'P') AS failed_count FROM orders""")
def merged_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all shards summed, once they cover the candidates."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), "o_orderstatus", "o_totalprice")
    rows = o.select((F.col("b") % 4).alias("shard"), "a", "b", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), (F.col("o_totalprice") > 200000).cast("int").alias("prediction"), F.lit("h").alias("candidates_hash"))
    return publishing.merged_shards(rows, 4, o.select("a", "b"), "h")


@query("""WITH p AS (SELECT l_linenumber AS split, l_returnflag AS model, l_linestatus AS seed, count(*) AS pairs FROM lineitem GROUP BY ALL), q AS (SELECT l_linenumber AS split, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT split, model, count(*) AS training_repeats, max(parts) AS parts, round(avg(pairs), 6) AS mean_pairs, string_agg(pairs, ';' ORDER BY seed) AS pairs_by_seed FROM p JOIN q USING (split) GROUP BY split, model""")
def denominator_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each split's metrics are shares of, with the pairs retained by training seed."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("split"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("seed"), "l_partkey")
    rows = li.groupBy("split", "model", "seed").agg(F.count(F.lit(1)).alias("pairs")).join(li.groupBy("split").agg(F.countDistinct("l_partkey").alias("parts")), "split")
    return publishing.denominators(rows, ["split", "model"], ["parts"], "pairs", "seed")


@query("""WITH a AS (SELECT p_type AS type, sha256(p_partkey::VARCHAR) AS digest FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY sha256('5:' || type || ':' || digest), digest) - 1 AS i FROM a)
SELECT type, digest, ['train', 'val', 'test'][(i % 3 + 1)::INT] AS subset FROM o""")
def asset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets dealt to subsets in turn inside their type, after a seeded shuffle."""
    assets = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("digest"))
    return publishing.partitioned_assets(assets, 5)


@query("""WITH g AS (SELECT o_custkey AS identity, count(*) AS images, row_number() OVER (ORDER BY o_custkey) - 1 + 100000 AS class_id, count(*) OVER () AS t FROM orders GROUP BY o_custkey),
s AS (SELECT seed, g.*, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || identity), identity) - 1 AS i FROM g CROSS JOIN (SELECT unnest([1, 2, 3]) AS seed) x)
SELECT seed, identity, class_id, CASE WHEN i < t // 2 THEN 'val' ELSE 'test' END AS subset, images FROM s""")
def distractor_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractors by identity, one class each, halved by several seeds; names that images have already are errors."""
    images = table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_custkey").alias("identity"))
    known = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return publishing.distractor_splits(images, known, 100000, [1, 2, 3])


@query("SELECT l_partkey AS identity, count(*) AS photos FROM lineitem GROUP BY 1")
def identity_galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query identities with their catalogue photos."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("identity"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("photo"))
    return publishing.galleries(li.where("photo like '%-1'").select("identity").union(li.select("identity").distinct()), li)


@query("""SELECT CASE c_nationkey % 2 WHEN 0 THEN 'train' ELSE 'test' END AS subset, lower(c_mktsegment) AS role, count(*) AS files, count(DISTINCT c_nationkey) AS classes, min(c_name) AS first FROM customer GROUP BY ALL""")
def finalised_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split members with their files' names and classes, checked."""
    c = table(spark, sf_dir, "customer")
    members = c.select(F.when(F.col("c_nationkey") % 2 == 0, "train").otherwise("test").alias("subset"), F.lower("c_mktsegment").alias("role"), F.col("c_custkey").alias("file_id"))
    files = c.select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("class_id"), F.lit("catalogue").alias("source"))
    return publishing.finalised(members, files).groupBy("subset", "role").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("class_id").alias("classes"), F.min("name").alias("first"))


@query("""WITH r AS (SELECT o_custkey AS class, CASE WHEN o_orderstatus = 'F' THEN 'historic' ELSE 'modern' END AS role, o_orderkey AS id FROM orders), d AS (SELECT *, row_number() OVER (PARTITION BY class, role ORDER BY sha256('9:' || id), id) AS p FROM r),
k AS (SELECT * FROM d WHERE p <= CASE role WHEN 'historic' THEN 2 ELSE 1 END), w AS (SELECT class FROM k GROUP BY class HAVING count(*) = 3), s AS (SELECT class, (row_number() OVER (ORDER BY sha256('9:' || class), class) - 1) // 4 AS batch FROM w), f AS (SELECT batch FROM s GROUP BY batch HAVING count(*) = 4)
SELECT batch, class, role, id FROM k JOIN s USING (class) WHERE batch IN (SELECT batch FROM f)""")
def role_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four classes with two historic rows and a modern one each."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("class"), F.when(F.col("o_orderstatus") == "F", "historic").otherwise("modern").alias("role"), F.col("o_orderkey").alias("id"))
    return publishing.role_batches(rows, 4, {"historic": 2, "modern": 1}, 9).select("batch", "class", "role", "id")


@query("""WITH k AS (SELECT DISTINCT l_linenumber * 20 AS k FROM lineitem) SELECT k, round(k / 41.05 * 4899.1 / 3600, 4) AS hours_per_day, round(k / min(k) OVER (), 6) AS ratio FROM k""")
def cost_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of verification a day by budget, at a stated rate and number of queries, and their ratios."""
    return publishing.cost_projection(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 20).alias("k")).distinct(), "k", 41.05, 4899.1)


@query("""WITH i AS (SELECT l_partkey AS object_id, l_suppkey AS uuid, l_linenumber AS seq FROM lineitem WHERE l_returnflag = 'N') SELECT run.r AS run, run.r = 'first' AS made, count(DISTINCT object_id) AS objects, count(*) AS images FROM i JOIN part ON p_partkey = object_id AND p_size > 25 CROSS JOIN (VALUES ('first'), ('second')) run(r) GROUP BY ALL""")
def cached_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two CSV files made once and scanned twice, images of the wanted objects alone."""
    path, out = folder(spark, "csv"), None
    for run in ("first", "second"):
        objects, made = manifests.cached_scan(spark, f"{path}/objects", lambda: table(spark, sf_dir, "part").select("p_partkey", "p_size"))
        images, also = manifests.cached_scan(spark, f"{path}/images", lambda: table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"))
        wanted = objects.where(F.col("p_size").cast("int") > 25).select(F.col("p_partkey").alias("l_partkey"))
        rows = images.where("l_returnflag = 'N'").join(wanted, "l_partkey", "left_semi").agg(F.countDistinct("l_partkey").alias("objects"), F.count(F.lit(1)).alias("images"))
        rows = rows.select(F.lit(run).alias("run"), F.lit(made and also).alias("made"), "objects", "images")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'ValueError: no page ' || n_nationkey END AS error, CASE WHEN n_nationkey % 4 <> 0 THEN 'body of ' || n_nationkey END AS body, n_nationkey::VARCHAR AS key, n_nationkey < 10 AS from_cache FROM nation""")
def cached_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched once, failures too; a second call asks only for those that the first didn't."""
    cache = folder(spark, "fetched")
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"))

    def fetch(key: str) -> str:
        if int(key) % 4 == 0:
            raise ValueError(f"no page {key}")
        return f"body of {key}"

    def offline(key: str) -> str:
        if int(key) < 10:
            raise RuntimeError("asked again")
        return fetch(key)

    manifests.fetched(keys.where("cast(key as int) < 10"), fetch, cache)
    return manifests.fetched(keys, offline, cache).select("key", "body", "error", (F.col("key").cast("int") < 10).alias("from_cache"))


@query("""SELECT label, seed, rank, n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'head only' ELSE 'adapted' END AS label, l_linenumber::VARCHAR AS seed, l_returnflag, l_quantity::INT AS rank, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL) t""")
def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank documents found by name, labelled by their folder, the first of each label and seed; others are left out."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber", F.col("l_quantity").cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    docs = per.groupBy("l_returnflag", "l_linenumber").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("ranks"))).alias("text")).collect()  # a document a flag and line number
    path, kind = folder(spark, "ranks"), {"A": "head", "N": "hold", "R": "other"}
    texts = {f"{path}/{kind[r['l_returnflag']]}-s{r['l_linenumber']}/rank_positions.json": r["text"] for r in docs}
    texts |= {f"{path}/zz-hold-s{r['l_linenumber']}/rank_positions.json": json.dumps({"ranks": []}) for r in docs}  # later by path
    write_texts(spark, texts)
    return manifests.rank_files(spark, path, [("^head", "head only"), ("hold", "adapted")])


@query("""SELECT 'files' AS table_name, count(*) AS given, (SELECT count(DISTINCT c_custkey) FROM customer) AS kept FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey = 0) x
UNION ALL SELECT 'classes', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'splits', count(*), (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) y) FROM orders""")
def loaded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables loaded with the first row of every key, and how many rows that leaves."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    files = c.select(F.col("c_custkey").alias("file_id"), "c_name")
    return manifests.load_tables(spark, folder(spark, "tables"), {
        "files": (files.unionByName(c.where("c_nationkey = 0").select(F.col("c_custkey").alias("file_id"), "c_name")), ["file_id"]),
        "classes": (c.select(F.col("c_nationkey").alias("class_id"), "c_mktsegment"), ["class_id"]),
        "splits": (o.select(F.col("o_orderstatus").alias("split_name"), F.col("o_custkey").alias("file_id")), ["split_name", "file_id"]),
    })


@query("""SELECT p_brand AS brand, count(*) AS parts FROM part GROUP BY 1""")
def published_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written aside, checked, renamed to its place and read again; one that breaks a rule is never published."""
    path, rows = folder(spark, "published"), table(spark, sf_dir, "part").withColumn("sha", F.sha2("p_name", 256))
    try:
        manifests.publish(spark, rows, f"{path}/broken", {"size": F.col("p_size") > 40})
        raise AssertionError("published in spite of its rule")
    except ValueError:
        pass
    done = manifests.publish(spark, rows, f"{path}/good", {"hash": F.col("sha") == F.sha2("p_name", 256), "size": F.col("p_size") > 0})
    return done.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("parts"))


@query("""SELECT '\\pnset{parts.' || lower(p_type) || '}{' || replace(format('{:,}', count(*) * 1000), ',', '{,}') || '}' AS line FROM part GROUP BY p_type""")
def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as lines of a LaTeX file."""
    n = (F.count(F.lit(1)) * 1000).cast("decimal(20,0)")
    values = table(spark, sf_dir, "part").groupBy("p_type").agg(F.regexp_replace(strings.grouped_number(n), ",", "{,}").alias("value")).select(F.concat(F.lit("parts."), F.lower("p_type")).alias("key"), "value")
    return manifests.number_lines(values)


@query("""SELECT l_returnflag AS split_name, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY sha256('1:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey)) AS n FROM lineitem) t WHERE n <= 50""")
def limited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so many sources of each split, which is what the operator is for; those with the smallest hashes."""
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.sha2(F.concat(F.lit("1:"), F.concat_ws("-", *parts)), 256))
    return splits.first_per_class(rows, "l_returnflag", 50, [F.col("key")]).select(F.col("l_returnflag").alias("split_name"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
