"""Queries over records and files: look-ups, verdicts, budgets of other models, caches, orders, names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings, vectors
from ..operators import lookups, metrics, ordering, pairs, protocol
from ..sources import manifests, stages
from ..sources.storage import shared_dir, write_texts
from .records import NORM
from .registry import query, table
from .retrieval import PAIRS
from .retrieval import vectors as embedded


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"


def words(sql: str) -> str:
    return f"list_distinct(list_filter(string_split({sql}, ' '), lambda x: x <> ''))"


GENERIC = ", ".join(f"'{w}'" for w in strings.GENERIC_ARTIST)
TITLES = ", ".join(f"'{w}'" for w in strings.GENERIC_TITLE)
SPECIFIC = "list_filter({0}, lambda x: length(x) >= 4 AND x NOT IN (" + GENERIC + "))"


@query(f"""WITH t AS (SELECT p_partkey AS id, {NORM.format("p_name || ' by ' || p_type || ' and ' || p_name || ' master ' || p_brand")} AS norm, {NORM.format("p_type || ' painter ' || p_name")} AS artist FROM part),
w AS (SELECT id, norm, {words('norm')} AS ws, {SPECIFIC.format(words('artist'))} AS aw, norm IN ({TITLES}) OR len(list_filter(string_split(norm, ' '), lambda x: x <> '')) < 3 AS g FROM t),
p AS (SELECT round(len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))), 6) AS score, x.norm = y.norm AS exact, NOT x.g AND NOT y.g AS sp, len(x.aw) AS na, len(y.aw) AS nb, len(list_intersect(x.aw, y.aw)) > 0 AS shared FROM w x JOIN w y ON y.id = x.id + 1)
SELECT CASE WHEN sp AND na > 0 AND nb > 0 AND NOT shared AND score >= 0.8 THEN 'obvious_false_positive' WHEN sp AND shared AND (score >= 0.9 OR exact) THEN 'likely' ELSE 'uncertain' END AS verdict, score, count(*) AS pairs FROM p GROUP BY ALL""")
def match_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on matches of each part's title with the next one's, by the titles' likeness and the artists' words."""
    title = F.concat("p_name", F.lit(" by "), "p_type", F.lit(" and "), "p_name", F.lit(" master "), "p_brand")
    artist = F.concat("p_type", F.lit(" painter "), "p_name")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), strings.normalised_text(title, ascii_only=True).alias("norm"), strings.normalised_text(artist, ascii_only=True).alias("artist"))
    both = rows.toDF("id", "na", "aa").join(rows.select((F.col("id") - 1).alias("id"), F.col("norm").alias("nb"), F.col("artist").alias("ab")), "id")
    score = F.round(strings.jaccard(strings.token_set(F.col("na")), strings.token_set(F.col("nb"))), 6)
    verdict = strings.match_verdict(F.col("na"), F.col("nb"), F.col("aa"), F.col("ab"), F.col("score"), F.col("na") == F.col("nb"))
    return both.withColumn("score", score).groupBy(verdict.alias("verdict"), "score").agg(F.count(F.lit(1)).alias("pairs"))


@query("""SELECT o_orderkey::VARCHAR AS file_id, o_orderstatus AS status, c_nationkey::BIGINT AS class_id, coalesce(tags_csv, '') AS tags_csv FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, string_agg(t, ',' ORDER BY t) AS tags_csv FROM (SELECT DISTINCT l_orderkey, l_returnflag AS t FROM lineitem) x GROUP BY l_orderkey) g ON g.l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderstatus IN ('F', 'O') AND EXISTS (SELECT 1 FROM lineitem WHERE lineitem.l_orderkey = o_orderkey AND l_linestatus = 'F')""")
def record_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a primary label that a split has and whose status counts, with their sorted tags."""
    o, c, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("string").alias("file_id")
    files = o.select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("role"))
    classes = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("c_nationkey").cast("long").alias("class_id"), F.col("c_mktsegment").alias("primary_label"))
    got = lookups.fetch_records(files, classes, li.select(key, F.col("l_returnflag").alias("tag")).distinct(), "BUILDING", members=li.where("l_linestatus = 'F'").select(key), statuses=["F", "O"])
    return got.select("file_id", "status", "class_id", "tags_csv")


@query("""WITH r AS (SELECT c_custkey AS id, c_mktsegment AS role, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') > 0 AS urgent FROM customer)
SELECT 'tag' AS asked, id FROM r WHERE urgent UNION ALL SELECT 'role', id FROM r WHERE role IN ('BUILDING', 'MACHINERY')""")
def role_or_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by a tag that some have, and by a tag that none has, which falls back on their roles."""
    tags = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("tags"))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" x, "), "c_mktsegment", F.lit(" ,")).alias("role")).join(tags, "id", "left")
    records = records.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    ask = lambda name, tag: lookups.ids_for_role_or_tag(records, ["Building", " machinery "], tag).select(F.lit(name).alias("asked"), "id")
    return ask("tag", "1-URGENT").unionByName(ask("role", "no such tag"))


@query("""SELECT source, count(*) AS n, sha256('[' || string_agg('"' || doc_id || '"', ',' ORDER BY doc_id::VARCHAR) || ']') AS ids_hash FROM documents GROUP BY source""")
def population_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The population of each source as a hash of its sorted ids."""
    return lookups.id_list_hash(table(spark, sf_dir, "documents"), "source", "doc_id")


VIEW = "v AS (SELECT l_returnflag AS model, l_linenumber AS p, CASE WHEN l_orderkey % 2 = 0 THEN 'calibration' ELSE 'test' END AS kind, l_quantity::INT AS rk FROM lineitem)"


@query(f"""WITH {VIEW}, c AS (SELECT model, p, rk, sum(count(*)) OVER (PARTITION BY model, p ORDER BY rk) AS f, sum(count(*)) OVER (PARTITION BY model, p) AS t FROM v WHERE kind = 'calibration' GROUP BY model, p, rk),
b AS (SELECT model AS donor, p, target, min(rk) AS k FROM c CROSS JOIN (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS target) g WHERE f >= ceil(target * t - 1e-9) GROUP BY ALL),
r AS (SELECT b.donor, b.p, b.target, v.model, avg(CASE WHEN rk <= k THEN 1::DOUBLE ELSE 0 END) AS pc FROM b JOIN v ON v.p = b.p AND v.kind = 'test' GROUP BY ALL)
SELECT x.model, x.donor, x.target, count(*) AS partitions, round(avg(x.pc), 6) AS pc, round(avg(y.pc), 6) AS donor_pc, count(*) FILTER (x.pc > y.pc + 1e-12) AS wins, count(*) FILTER (abs(x.pc - y.pc) <= 1e-12) AS ties, count(*) FILTER (x.pc >= x.target - 1e-12) AS attained, count(*) FILTER (y.pc >= y.target - 1e-12) AS donor_attained
FROM r x JOIN r y ON y.donor = x.donor AND y.p = x.p AND y.target = x.target AND y.model = y.donor WHERE x.model <> x.donor GROUP BY x.model, x.donor, x.target""")
def donor_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model at the budgets that another model's calibration sets, partition by partition."""
    kind = F.when(F.col("l_orderkey") % 2 == 0, "calibration").otherwise("test")
    view = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("partition"), kind.alias("kind"), F.col("l_quantity").cast("int").alias("rank"))
    return lookups.donor_budgets(view, [0.5, 0.9])


@query("""WITH m(model_id, alias) AS (VALUES ('auto', 'AUTOMOBILE'), ('auto', 'MACHINERY'), ('home', 'FURNITURE'), ('home', 'Customer#000000003')),
s AS (SELECT c_custkey AS k, c_mktsegment AS x, c_name AS y FROM customer WHERE NOT (c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AND c_name = 'Customer#000000003'))
SELECT coalesce((SELECT max(model_id) FROM m WHERE alias IN (x, y)), 'own:' || x) AS model_id, count(*) AS sources FROM s GROUP BY 1""")
def source_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the aliases of configured models, those of none by their own name; a source of two models would be an
    error, so the one that may be is left out here."""
    models = spark.createDataFrame([("auto", ["AUTOMOBILE", "MACHINERY"]), ("home", ["FURNITURE", "Customer#000000003"])], "model_id string, aliases array<string>")
    c = table(spark, sf_dir, "customer").where("not (c_mktsegment in ('AUTOMOBILE', 'MACHINERY') and c_name = 'Customer#000000003')")
    sources = c.select(F.col("c_custkey").alias("key"), F.array("c_mktsegment", "c_name").alias("identities"), F.concat(F.lit("own:"), "c_mktsegment").alias("fallback"))
    return lookups.model_of_source(sources, models).groupBy("model_id").agg(F.count(F.lit(1)).alias("sources"))


PROFILES = ("archival", "print", "cropped_record", "framed_photo")
SLICES = f"""{PAIRS}, s AS (SELECT p.*, ['archival', 'print', 'cropped_record', 'framed_photo'][(cid % 4 + 1)::INT] AS profile, ql = cl AS hit FROM p),
z AS (SELECT *, row_number() OVER (PARTITION BY profile, qid ORDER BY s DESC, cid) AS k FROM s), n AS (SELECT profile, qid, count(*) AS nc, count(*) FILTER (hit) AS np FROM s GROUP BY ALL),
t AS (SELECT profile, sum(nc) AS possible, sum(np) AS positives, count(*) AS nq FROM n WHERE np > 0 GROUP BY profile),
g AS (SELECT z.profile, 'top_k' AS mode, x::DOUBLE AS point, count(*) AS pairs, count(*) FILTER (hit) AS tp FROM z JOIN n USING (profile, qid) CROSS JOIN (SELECT unnest([5, 20]) AS x) q WHERE np > 0 AND k <= x GROUP BY ALL
  UNION ALL SELECT z.profile, 'calibrated_threshold', y, count(*) FILTER (s >= y), count(*) FILTER (hit AND s >= y) FROM z JOIN n USING (profile, qid) CROSS JOIN (SELECT unnest([0.1, 0.2]::DOUBLE[]) AS y) q WHERE np > 0 GROUP BY ALL),
d AS (SELECT profile, mode, point, pairs AS candidate_pairs, tp AS true_positives, round(tp / positives, 6) AS pair_completeness, round(CASE WHEN pairs > 0 THEN tp / pairs ELSE 0 END, 6) AS pair_quality, round(1 - pairs / possible, 6) AS reduction_ratio FROM g JOIN t USING (profile))"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(p) for p in PROFILES]), (F.col("id") % 4 + 1).cast("int"))
    v = embedded(spark, sf_dir).withColumn("profile", names)
    return metrics.profile_diagnostics(v, v, list(PROFILES), [5, 20], [0.1, 0.2])


@query(f"{SLICES} SELECT * FROM d")
def profile_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of slices of the candidates by their profile, at operating points that are never chosen from them."""
    return _profiles(spark, sf_dir)


@query(f"{SLICES} SELECT mode, point, count(*) AS profiles, round(avg(pair_completeness), 6) AS pair_completeness, round(avg(pair_quality), 6) AS pair_quality, round(avg(reduction_ratio), 6) AS reduction_ratio FROM d GROUP BY mode, point")
def profile_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over profiles for each operating point."""
    return metrics.profile_macro(_profiles(spark, sf_dir), len(PROFILES))


@query("""WITH m AS (SELECT l_linenumber AS run, l_returnflag AS model, l_linestatus AS layout, count(*) AS n, sum(l_quantity) AS w, bool_or(l_quantity = 1 AND l_linenumber = 3) AS reused FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus)
SELECT run::VARCHAR AS run, model, layout = 'F' AS by_folder, n AS num_images, round(n / w, 6) AS images_per_second, CASE WHEN layout = 'F' THEN 64 ELSE 32 END::BIGINT AS dimensions FROM (SELECT *, row_number() OVER (PARTITION BY run, model ORDER BY layout = 'F' DESC) AS k FROM m WHERE NOT reused) x WHERE k = 1""")
def resource_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource documents found in two layouts, flattened, those of reused caches left out, one of each run and
    model, that of the resource_metrics folder before the model's own."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("w"), F.bool_or(F.col("l_quantity") == 1).alias("one")).collect()  # a document each
    path, texts = folder(spark, "resources"), {}
    for r in per:
        own = {"wall_time_seconds": r["w"], "num_images": r["n"], "cache_reused_for_run": bool(r["one"]) and r["l_linenumber"] == 3}
        size = {"summary": {"embedding_dimensionality": 64}} if r["l_linestatus"] == "F" else {"model": {"embedding_dim": 32}}
        place = f"resource_metrics/{r['l_returnflag']}.json" if r["l_linestatus"] == "F" else f"models/{r['l_returnflag']}/resource_metrics.json"
        texts[f"{path}/{r['l_linenumber']}/{place}"] = json.dumps({"model_id": r["l_returnflag"], "embedding": own, **size})
    write_texts(spark, texts)
    return manifests.resource_rows(spark, path)


@query("""SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'invalid' WHEN n_nationkey % 5 = 1 THEN 'orphan' ELSE 'valid' END AS state, 'set_a/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.TXT' ELSE '.txt' END AS path, length(n_name) + 1 AS size, sha256(n_name || CASE WHEN n_nationkey % 5 = 0 THEN '!' ELSE '.' END) AS sha256 FROM nation""")
def file_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a named source found at any depth by extension, with hashes and sizes, those that can't be decoded
    told apart, and those that no record knows as orphans."""
    rows = table(spark, sf_dir, "nation").collect()  # a file each
    path = folder(spark, "files")
    name, place = protocol.parse_source(f"set_a={path}")
    texts = {f"{path}/{r['n_regionkey']}/{r['n_name']}{'.TXT' if r['n_nationkey'] % 2 == 0 else '.txt'}": r["n_name"] + ("!" if r["n_nationkey"] % 5 == 0 else ".") for r in rows}
    write_texts(spark, texts | {f"{path}/0/notes.md": "not asked for"})
    known = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 1").select(F.col("n_name").alias("stem"))
    return manifests.ingest(spark, name, place, [".txt"], lambda content: content.endswith(b"."), known)


@query("""WITH b AS (SELECT c_custkey AS id, c_name AS label FROM customer WHERE c_custkey % 3 <> 0), x AS (SELECT c_custkey AS id, 'second ' || c_name AS label FROM customer) SELECT id, label FROM b UNION ALL SELECT id, label FROM x WHERE id NOT IN (SELECT id FROM b)""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one catalogue, and of a second one those that the first lacks."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return lookups.merged_missing(c.where("id % 3 <> 0"), c.withColumn("label", F.concat(F.lit("second "), "label")), ["id"])


@query("""WITH e AS (SELECT l_returnflag AS model, l_linenumber AS epoch, avg(1 - l_discount) AS pc, avg(1 - l_tax) AS rr FROM lineitem GROUP BY ALL), c AS (SELECT *, max(rr) OVER (PARTITION BY model) AS best FROM e WHERE pc > 0.9)
SELECT model, min(epoch) AS epoch, round(max(best), 6) AS best_rr FROM c WHERE rr >= best - 0.0005 GROUP BY model""")
def transfer_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest epoch whose reduction is within a margin of the best among those complete enough."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("epoch")).agg(F.avg(1 - F.col("l_discount")).alias("pc"), F.avg(1 - F.col("l_tax")).alias("rr"))
    return lookups.transfer_epoch(rows, ["model"], 0.9, 0.0005).withColumn("best_rr", F.round("best_rr", 6))


@query("""SELECT role, CASE WHEN role = 'historic' OR starts_with(role, 'historic_') THEN 0 WHEN role = 'modern' OR starts_with(role, 'modern_') THEN 1 END AS origin, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'historic' WHEN '2-HIGH' THEN 'historic_print' WHEN '3-MEDIUM' THEN 'modern_generated' WHEN '5-LOW' THEN 'modernist' ELSE 'modern' END AS role FROM orders) t GROUP BY ALL""")
def origin_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as codes of their origin; a role that only begins with the same letters has none."""
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "historic").when(F.col("o_orderpriority") == "2-HIGH", "historic_print").when(F.col("o_orderpriority") == "3-MEDIUM", "modern_generated").when(F.col("o_orderpriority") == "5-LOW", "modernist").otherwise("modern")
    return table(spark, sf_dir, "orders").select(role.alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n")).select("role", lookups.origin_code(F.col("role")).alias("origin"), "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1) AS place FROM lineitem")
def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with their places in one order, by ranges that are sorted apart."""
    order = [F.desc("l_extendedprice"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")]]
    return ordering.numbered(table(spark, sf_dir, "lineitem"), order, "place").select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""WITH s AS (SELECT sha256(text) AS h, doc_id AS id FROM documents), c AS (SELECT min(id) AS component, count(*) AS size FROM s GROUP BY h) SELECT component, size, size - 1 AS edges, row_number() OVER (ORDER BY size DESC, size - 1 DESC, component) - 1 AS place FROM c""")
def component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by falling size, falling number of links, and id, with their places."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"))
    per = d.groupBy("sha").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size")).select("component", "size", (F.col("size") - 1).alias("edges"))
    return ordering.numbered(per, [F.desc("size"), F.desc("edges"), F.col("component")], "place")


@query("""WITH r AS (SELECT l_returnflag AS grp, l_linestatus || l_linenumber AS name, CASE l_linenumber WHEN 1 THEN 'threshold' WHEN 2 THEN 'top_k' WHEN 3 THEN 'target_pc' ELSE 'other' END AS mode, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY CASE grp WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, grp, CASE WHEN name = 'O4' THEN 0 WHEN name IN ('F2', 'F1') THEN 1 WHEN name = 'F3' THEN 3 ELSE 2 END, CASE name WHEN 'F2' THEN 0 WHEN 'F1' THEN 1 ELSE 0 END, name, CASE mode WHEN 'top_k' THEN 0 WHEN 'target_pc' THEN 1 WHEN 'threshold' THEN 2 ELSE 5 END) - 1 AS place FROM r""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table by group, pinned, listed, named and trailing rows, and by the rank of their mode."""
    n = F.col("l_linenumber")
    mode = F.when(n == 1, "threshold").when(n == 2, "top_k").when(n == 3, "target_pc").otherwise("other")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.concat("l_linestatus", n.cast("string")).alias("name"), mode.alias("mode")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    keys = ordering.display_order(F.col("grp"), F.col("name"), ["R", "A"], ["O4"], ["F2", "F1"], ["F3"])
    return ordering.numbered(rows, [*keys, ordering.metric_order(F.col("mode"))], "place")


@query("""SELECT p_partkey AS id, format('{:,}', (p_retailprice * 1000)::BIGINT) AS thousands, CASE WHEN p_size = 50 THEN '1.000' ELSE printf('%.3f', p_size / 50)[2:] END AS share, (CASE WHEN p_size >= 25 THEN '+' ELSE '-' END) || printf('%.2f', abs(p_size - 25) / 4) AS delta, p_type || '\\_' || p_brand[1:5] || '\\#' || p_size || '\\%' AS label FROM part""")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands, shares without the zero before the point, signed differences, and labels as LaTeX prints them."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    raw = F.concat("p_type", F.lit("_"), F.substring("p_brand", 1, 5), F.lit("#"), size, F.lit("%"))
    return p.select(
        F.col("p_partkey").alias("id"), strings.grouped_number((F.col("p_retailprice") * 1000).cast("decimal(20,0)")).alias("thousands"), strings.share_label(F.col("p_size") / 50).alias("share"),
        strings.signed_delta((F.col("p_size") - 25) / 4).alias("delta"), strings.latex_escape(raw).alias("label"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events""")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as UTC in ISO form."""
    return table(spark, sf_dir, "events").select("event_id", strings.utc_iso(F.col("ts")).alias("at"))


@query("""WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x * 3) * (x * 3)))) AS norm FROM embeddings) SELECT vec_id AS id, round(e.embedding[1] * 3 / norm, 5) AS first, 1.0::DOUBLE AS norm FROM embeddings e JOIN n USING (vec_id)""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to unit length, first by their largest part; one that is nearly zero is an error."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vectors.normalised(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)).alias("v"))
    return v.select("id", F.round(F.element_at("v", 1), 5).alias("first"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query("""SELECT * FROM (VALUES ('a', 'bipartite'), ('set_b', 'symmetric'), ('m-e007-s0p25', 'm 7 0.25'), ('grid', '1 10 100 1000'), ('targets', 'targets are distinct, rising, above 0 and at most 1'),
('calibration', 'calibration may use neither test subsets nor wildcards'), ('lineage', 'stable')) t(name, mode)""")
def protocol_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, grids, modes and checks that a run is set up by; they read no table."""
    rows = [(protocol.parse_source("a=/x/y")[0], protocol.set_mode("/x/y", "/x/z")), (protocol.parse_source("/data/set b/")[0], protocol.set_mode("/data/set b/", "/data/set b"))]
    name = protocol.checkpoint_name("m", 7, 0.25)
    rows += [(name, " ".join(map(str, protocol.parse_checkpoint(name)))), ("grid", " ".join(map(str, protocol.log_grid(1, 1000, 4))))]
    for what, check in (("targets", lambda: protocol.check_targets([0.9, 0.5], [1])), ("calibration", lambda: protocol.check_calibration(["test"], ["test"]))):
        try:
            check()
            rows.append((what, "no error"))
        except ValueError as error:
            rows.append((what, str(error)))
    rows.append(("lineage", "stable" if protocol.lineage_id(["a", "b"]) == protocol.lineage_id(["a", "b"]) != protocol.lineage_id(["b", "a"]) else "not stable"))
    return spark.createDataFrame(rows, "name string, mode string")


@query("""WITH u AS (SELECT p_partkey AS a, p_partkey + 1 AS b, 'next' AS reason, 0.5 AS s FROM part UNION ALL SELECT p_partkey - p_partkey % 4, p_partkey, 'group', 0.25 FROM part WHERE p_partkey % 4 <> 0), o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, reason, s FROM u)
SELECT a, b, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons, max(s) AS score FROM o GROUP BY a, b""")
def blocking_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of several blockings with the set of their reasons and the best score."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    nexts = p.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.lit("next").alias("reason"), F.lit(0.5).alias("score"))
    groups = p.where("k % 4 <> 0").select((F.col("k") - F.col("k") % 4).alias("a"), F.col("k").alias("b"), F.lit("group").alias("reason"), F.lit(0.25).alias("score"))
    return pairs.blocking_union({"next": nexts, "group": groups})


@query("""SELECT n_nationkey::BIGINT AS objectid, n_name AS title, greatest(0, (n_nationkey - 2) // 10)::BIGINT AS page FROM nation WHERE n_nationkey % 4 <> 0""")
def paged_catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue read page by page through a fetcher that is handed in, rows that aren't open left out by the
    scan, and objects that come again on a later page dropped."""
    rows = sorted((r["n_nationkey"], r["n_name"]) for r in table(spark, sf_dir, "nation").collect())
    pages = [rows[k : k + 12] for k in range(0, len(rows), 10)]  # the last two of a page come again on the next
    fetch = lambda page: [{"objectid": k, "title": t, "page": page} for k, t in pages[page] if k % 4]
    return manifests.paged_scan(spark, fetch, len(pages), "objectid long, title string, page long", "objectid")


@query("""SELECT CASE c_nationkey % 2 WHEN 0 THEN 'train' ELSE 'test' END AS subset, CASE WHEN c_nationkey % 3 = 0 THEN 'modern' ELSE 'historic' END AS role, count(*) AS files, count(DISTINCT c_nationkey) AS classes FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) t GROUP BY ALL""")
def split_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split document written and read again, checked."""
    files = sorted((r["c_nationkey"], r["c_mktsegment"]) for r in table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().collect())  # a file a nation and segment
    split: dict = {"schema_version": 2, "images": {}, "subsets": {s: {"roles": {"modern": [], "historic": []}} for s in ("train", "test")}}
    for nation, segment in files:
        name = f"{segment}-{nation}.jpg"
        split["images"][name] = {"class_id": nation}
        split["subsets"]["test" if nation % 2 else "train"]["roles"]["historic" if nation % 3 else "modern"].append(name)
    rows = manifests.read_split(spark, json.dumps(split))
    return rows.groupBy("subset", "role").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("class_id").alias("classes"))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'disagrees' ELSE 'cached' END AS state, count(*) AS contents, round(sum(CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN n_chars ELSE 0 END), 6) AS total FROM (SELECT min(doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY sha256(text)) t GROUP BY 1""")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents whose vector some cache has, those that caches disagree about, and those still to be computed."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("id"), F.max("n_chars").cast("double").alias("x"))
    cache = lambda name, off: d.where("id % 5 <> 0").select(F.lit(name).alias("cache"), "sha", F.array(F.col("x") + off, F.lit(1.0)).alias("vector"))
    caches = cache("a", F.lit(0.0)).unionByName(cache("b", F.when(F.col("id") % 7 == 0, 1.0 + F.col("x")).otherwise(1e-6)))
    got = lookups.reused_vectors(d, caches)
    return got.groupBy("state").agg(F.count(F.lit(1)).alias("contents"), F.round(F.coalesce(F.sum(F.element_at("vector", 1)), F.lit(0.0)), 6).alias("total"))


@query("""SELECT * FROM (VALUES ('first', 'embed', 'ran'), ('first', 'retrieve', 'ran'), ('second', 'embed', 'reused'), ('second', 'retrieve', 'reused'), ('third', 'embed', 'reused'), ('third', 'retrieve', 'ran')) t(run, stage, state)""")
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages whose outputs are kept under a hash of their settings: run, run again, and run with another setting
    for the second stage, which alone is done again."""
    path, out = folder(spark, "stages"), []
    for run, top in (("first", 3), ("second", 3), ("third", 5)):
        got = stages.Stages(spark, path)
        got.run("embed", {"table": "nation"}, lambda _: table(spark, sf_dir, "nation"))
        got.run("retrieve", {"top": top}, lambda docs, k=top: docs.where(F.col("n_nationkey") < k))
        out += [(run, name, state) for name, state in got.states]
    return spark.createDataFrame(out, "run string, stage string, state string")


@query("""SELECT b.name, CASE WHEN c_custkey IS NULL THEN 'NOT_FOUND' ELSE CASE c_nationkey % 2 WHEN 0 THEN 'train' ELSE 'test' END || '/' || lower(c_mktsegment) END AS places FROM (SELECT DISTINCT 'f' || (o_custkey + o_orderkey % 2) AS name FROM orders) b LEFT JOIN customer ON 'f' || c_custkey = b.name""")
def membership_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in lists, with or without folders, looked up in a split."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file_id"), F.when(F.col("c_nationkey") % 2 == 0, "train").otherwise("test").alias("subset"), F.lower("c_mktsegment").alias("role"))
    name = F.concat(F.lit("f"), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string"))
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey") % 1000).agg(F.concat_ws("; ", F.collect_list(F.concat(F.lit("some/where/"), name))).alias("list"))
    return lookups.membership_of(lists, c)


@query("""SELECT s_name AS name, 'suppliers' || CASE WHEN s_name LIKE 'Supplier#0000000%' THEN '/first' ELSE '' END AS folder, 'suppliers' || CASE WHEN s_name LIKE 'Supplier#0000000%' THEN '/first' ELSE '' END || '/' || s_name AS path FROM supplier UNION ALL SELECT c_name, 'customers', 'customers/' || c_name FROM customer""")
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files staged from the folder of their longest prefix."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).union(table(spark, sf_dir, "customer").select("c_name"))
    return lookups.staged(names, {"Supplier#": "suppliers", "Supplier#0000000": "suppliers/first", "Customer#": "customers"})


@query("""WITH p AS (SELECT l_partkey AS ref, count(*) AS n, 1 AS shards FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) t GROUP BY l_partkey) SELECT ref AS reference, n AS queries, shards FROM p""")
def reference_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two sets by their reference; all of a reference are in one shard."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("k"))
    flip = F.col("k") % 2 == 0
    pairs_ = li.select(F.when(flip, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("a"), F.when(flip, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("b"), F.when(flip, "set_b").otherwise("set_a").alias("source_a"))
    return lookups.by_reference(pairs_, 16).groupBy("reference").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("shard").cast("int").alias("shards"))


@query("""SELECT l_partkey AS object_id, arg_min(l_orderkey || '-' || l_linenumber || '-' || l_suppkey, (l_linenumber, l_orderkey || '-' || l_linenumber || '-' || l_suppkey)) AS uuid FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey""")
def best_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first open primary image of each wanted object."""
    li = table(spark, sf_dir, "lineitem")
    images = li.select(F.col("l_partkey").alias("object_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("uuid"), F.col("l_linenumber").alias("sequence"), F.when(F.col("l_returnflag") == "N", "primary").otherwise("other").alias("viewtype"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("openaccess"))
    return lookups.best_image(images, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("object_id")))


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN p_name || '_002' ELSE p_name END AS name FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM r)
SELECT name, count(*) AS n, count(DISTINCT id) AS ids, bool_or(name NOT LIKE '%_002' AND k > 1) AS numbered FROM k GROUP BY name""")
def unique_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique by numbers that no other row has as its own; a number that is twice would be an error here."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("_002"))).otherwise(F.col("p_name")).alias("name"))
    named = lookups.unique_stems(rows)
    twice = named.groupBy("unique_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a name is twice")
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.bool_or(~F.col("name").endswith("_002") & (F.col("unique_name") != F.col("name"))).alias("numbered"))


@query("""SELECT c_nationkey::BIGINT AS painting, label, n FROM (SELECT c_nationkey, CASE WHEN c_name LIKE '%0' THEN 'control: head only' WHEN c_name LIKE '%1' THEN 'H+ adapted' ELSE 'own' END AS label, count(*) AS n FROM customer GROUP BY ALL) t""")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: labels of runs by the first rule that their name meets."""
    label = strings.ruled_label(F.col("c_name"), [("0$", "control: head only"), ("[01]$", "H+ adapted")], "own")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("painting"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
