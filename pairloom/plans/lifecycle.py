"""Queries around experiments and reviews: schedules, reuse, kernels, transfers, guards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, protocol, registry, similarity, splits
from ..sources.storage import shared_dir
from .registry import query, table
from .retrieval import PAIRS, counts, vectors


@query(f"""{PAIRS}, h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS n FROM p WHERE ql <> cl) SELECT ql::BIGINT AS query_class, count(*) AS negatives, round(avg(s), 6) AS mean_score FROM h WHERE n <= 10 GROUP BY 1""")
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined negatives written as a table and scanned again."""
    path = f"{shared_dir(spark)}/pairloom/negatives-{uuid.uuid4().hex}"
    v = vectors(spark, sf_dir)
    similarity.nearest_negatives(v, v, 10).write.parquet(path)
    return spark.read.parquet(path).groupBy("query_class").agg(F.count(F.lit(1)).alias("negatives"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("""WITH c AS (SELECT e.vec_id, (SELECT count(*) FROM embeddings f WHERE f.label = e.label) - 1 AS np FROM embeddings e) SELECT count(*) FILTER (np > 0) AS kept, count(*) FILTER (np = 0) AS dropped FROM c""")
def queries_without_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that no candidate can match."""
    return counts(spark, sf_dir).agg(F.count_if(F.col("n_positives") > 0).alias("kept"), F.count_if(F.col("n_positives") == 0).alias("dropped"))


@query("SELECT o_orderkey, c_custkey, c_name FROM (SELECT o_orderkey, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS k FROM orders) o JOIN customer ON c_name = k")
def derived_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a key built from a number and a prefix."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"))
    return o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name").select("o_orderkey", "c_custkey", "c_name")


@query("SELECT b.range AS block, s.range AS place, (s.range + b.range) % 7 AS item FROM range(7) b CROSS JOIN range(7) s")
def latin_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic order of seven models: balanced by place, not by neighbours (for those, williams_rows)."""
    return protocol.latin_square(spark.range(7).select(F.col("id").alias("slot")), 7)


@query("""WITH f AS (SELECT range AS p, CASE WHEN range % 2 = 0 THEN range // 2 ELSE 6 - range // 2 END AS x FROM range(7)) SELECT b.range AS block, p AS place, (x + b.range) % 7 AS item FROM f CROSS JOIN range(7) b UNION ALL SELECT 7 + b.range, 6 - p, (x + b.range) % 7 FROM f CROSS JOIN range(7) b""")
def williams_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Williams square of seven models, with its reversals."""
    rows = [(block, place, item) for block, row in enumerate(protocol.williams_rows(7)) for place, item in enumerate(row)]
    return spark.createDataFrame(rows, "block long, place long, item long")


@query("""SELECT c.range AS cycle, 'model' || a.range AS before, 'model' || b.range AS model, 2 AS n FROM range(1, 4) c CROSS JOIN range(7) a CROSS JOIN range(7) b WHERE a.range <> b.range""")
def williams_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeded cycles of seven models, checked for balance: how often each model comes right before another."""
    schedule = protocol.williams_schedule(spark, [f"model{k}" for k in range(7)], [11, 12, 13], 5)
    if broken := protocol.unbalanced(schedule).take(1):
        raise ValueError(f"not balanced: {broken[0]}")
    return protocol.neighbours(schedule)


@query("""SELECT model, count(*) AS rows FROM (SELECT l_returnflag || l_linestatus AS model, l_linenumber FROM lineitem) t GROUP BY model HAVING list_sort(list_distinct(list(l_linenumber))) = [1, 2, 3, 4, 5, 6, 7]""")
def complete_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that have every expected key."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.col("l_linenumber").cast("int").alias("n"))
    return protocol.complete_protocols(rows, "model", "n", [1, 2, 3, 4, 5, 6, 7]).groupBy("model").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH k AS (SELECT CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
s AS (SELECT round(least(1.0, greatest(0, k / 100) * 0.40 + greatest(0, least(1, (192 - (32 + 3 * k)) / 160)) * 0.45 + CASE WHEN k % 2 = 0 THEN 0.10 ELSE 0 END + least(0.10, k / 500) + CASE WHEN k % 3 = 0 THEN 0.05 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.05 ELSE 0 END + CASE WHEN 100 - k <= 72 THEN 0.08 ELSE 0 END), 6) AS x FROM k)
SELECT CASE WHEN x >= 0.72 THEN 'extreme' WHEN x >= 0.50 THEN 'hard' WHEN x >= 0.25 THEN 'medium' ELSE 'mild' END AS bucket, count(*) AS n, round(avg(x), 6) AS mean FROM s GROUP BY 1""")
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strength of transforms read from JSON, weighted and in buckets. Each event's number makes one document
    of transforms."""
    k = F.get_json_object("props", "$.k").cast("int")
    done = lambda n: F.when(k % n == 0, F.struct(F.lit(True).alias("applied")))
    transforms = F.to_json(F.struct(
        F.struct((1 - k / 100).alias("retained_area_fraction")).alias("crop"), F.struct((32 + 3 * k).alias("longest_side_pixels")).alias("resolution_loss"), done(2).alias("perspective"),
        F.struct((k / 500).alias("coverage")).alias("occlusion"), done(3).alias("annotations"), done(5).alias("paper_document"), F.struct((100 - k).alias("quality")).alias("jpeg"),
    ))
    x, bucket = protocol.severity(transforms)
    return table(spark, sf_dir, "events").select(x.alias("x"), bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query("""WITH f AS (SELECT c_nationkey::BIGINT AS scene, c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 10)::DOUBLE AS y FROM customer), t AS (SELECT s_nationkey::BIGINT AS scene, s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey % 10)::DOUBLE AS y FROM supplier),
o AS (SELECT scene, f.id AS f, t.id AS t, greatest(0, least(f.x + 40, t.x + 40) - greatest(f.x, t.x)) * greatest(0, least(f.y + 10, t.y + 10) - greatest(f.y, t.y)) AS i FROM f JOIN t USING (scene)),
p AS (SELECT scene, f, t, i / (800 - i) AS iou FROM o WHERE i / (800 - i) >= 0.5),
g AS (SELECT scene, list_reduce(list([{'f': f, 't': t, 'iou': iou}] ORDER BY iou DESC, f, t), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.f = x[1].f OR a.t = x[1].t)) > 0 THEN acc ELSE list_concat(acc, x) END) AS m FROM p GROUP BY scene)
SELECT scene, len(m) AS matches, round(list_avg(list_transform(m, lambda a: round(a.iou, 6))), 6) AS mean_iou FROM g""")
def box_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found and true boxes of a scene matched one to one; scenes are nations, boxes come from balances."""
    box = lambda df, key, bal, found: df.select(F.col(f"{key[0]}_nationkey").cast("long").alias("scene"), F.lit(found).alias("found"), F.col(key).alias("id"), (F.col(bal) / 100).alias("x0"), (F.col(key) % 10).cast("double").alias("y0"), (F.col(bal) / 100 + 40).alias("x1"), (F.col(key) % 10 + 10).cast("double").alias("y1"))
    rows = box(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", True).unionByName(box(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", False))
    return protocol.greedy_boxes(rows, 0.5).groupBy("scene").agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg("iou"), 6).alias("mean_iou"))


@query("SELECT count(*) AS classes, 0::BIGINT AS shared FROM (SELECT DISTINCT c_nationkey FROM customer) t")
def class_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in two halves with a seeded shuffle; none is in both."""
    classes = sorted(r[0] for r in table(spark, sf_dir, "customer").select("c_nationkey").distinct().collect())
    rows = splits.membership(table(spark, sf_dir, "customer"), splits.halves(classes, 3), "c_nationkey")
    per = rows.groupBy("c_nationkey").agg(F.countDistinct("subset").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("n") > 1).alias("shared"))


@query("SELECT o_orderkey AS id, 'gone' AS change FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT -o_orderkey - 1, 'added' FROM orders WHERE o_orderstatus = 'P'")
def queue_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two queues."""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"))
    new = o.select(F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("id"))
    return protocol.queue_changed(old, new)


@query(f"""{PAIRS}, k AS (SELECT x AS split, qid, cid, hit, row_number() OVER (PARTITION BY x, qid ORDER BY s DESC, cid) AS rk FROM p0 JOIN (SELECT unnest([0, 1, 2]) AS x) y ON qid % 3 = x AND cid % 3 = x)
SELECT split, count(*) AS candidate_pairs, count(*) FILTER (hit) AS true_positives FROM k WHERE rk <= 5 GROUP BY split""".replace("WITH p AS", "WITH p AS").replace("r AS (SELECT *,", "p0 AS (SELECT *, ql = cl AS hit FROM p), r AS (SELECT *,"))
def split_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q08: the same join for each split, every vector in one of three; a split's pairs stay among its own vectors."""
    splits_ = [vectors(spark, sf_dir).where(F.col("id") % 3 == k) for k in range(3)]
    runs = [similarity.ranked(similarity.similarity_pairs(v, v, top=5), 5).withColumn("split", F.lit(k)) for k, v in enumerate(splits_)]
    return runs[0].union(runs[1]).union(runs[2]).groupBy("split").agg(F.count(F.lit(1)).alias("candidate_pairs"), F.count_if(metrics.is_match()).alias("true_positives"))


@query("""SELECT p_partkey AS id, round(len(regexp_replace(lower(p_name), '[^e]', '', 'g')) / greatest(1, len(regexp_replace(lower(p_name), '[^a-z]', '', 'g'))), 6) AS share_e, 26::BIGINT AS size FROM part""")
def embedded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered embedder over all names, made once a task."""
    v = registry.embed(table(spark, sf_dir, "part"), "letters", "p_partkey", "p_name")
    return v.select("id", F.round(F.element_at("vector", 5), 6).alias("share_e"), F.size("vector").cast("long").alias("size"))


@query("""SELECT CASE WHEN o_totalprice < 1000 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_totalprice < 1000 THEN NULL WHEN o_totalprice > 200000 THEN 1 ELSE 0 END::BIGINT AS prediction, count(*) AS pairs FROM orders GROUP BY ALL""")
def verified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verifier over pairs; one that fails is a row with its error."""

    def judge(row: dict) -> tuple[int, float, int]:
        if row["price"] < 1000:
            raise ValueError("too little to judge")
        return int(row["price"] > 200000), min(1.0, row["price"] / 500000), 1

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("price"))
    return registry.verify(o, judge, ["price"]).groupBy("status", "prediction").agg(F.count(F.lit(1)).alias("pairs"))


@query("""WITH m AS (SELECT l_returnflag AS model, round(avg(1 - l_discount), 6) AS pc FROM lineitem GROUP BY 1), a(model, alias) AS (VALUES ('R', 'returned'), ('N', 'new')), s AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'returned' WHEN 'MACHINERY' THEN 'new' ELSE 'A' END AS id, count(*) AS n FROM customer GROUP BY 1)
SELECT m.model, m.pc, coalesce(s.n, 0) / 100 AS cost FROM m LEFT JOIN a USING (model) LEFT JOIN s ON s.id = coalesce(a.alias, m.model)""")
def sidecar_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics joined to a side table by aliases, with a divisor and a default."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("pc"))
    alias = spark.createDataFrame([("R", "returned"), ("N", "new")], "model string, alias string")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "returned").when(F.col("c_mktsegment") == "MACHINERY", "new").otherwise("A")
    side = table(spark, sf_dir, "customer").groupBy(segment.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = m.join(F.broadcast(alias), "model", "left").withColumn("id", F.coalesce("alias", "model")).join(side, "id", "left")
    return rows.select("model", "pc", (F.coalesce("n", F.lit(0)) / 100).alias("cost"))


@query("""SELECT o_custkey AS config, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def reusable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest completed run of each configuration."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.groupBy(F.col("o_custkey").alias("config")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"))


@query("SELECT DISTINCT source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphaned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with rows that nothing refers to."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("source").distinct()
