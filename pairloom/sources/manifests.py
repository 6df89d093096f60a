"""Scans and sinks of manifests: CSV with a fixed field list, JSON documents and lines, database dumps, paged catalogues."""

from __future__ import annotations

import bisect
import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def write_manifest(df: DataFrame, path: str, fields: list[str]) -> None:
    """``fields`` in order as CSV with a header; nulls as empty fields. The committer makes it all or nothing."""
    df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_manifest(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A manifest with every value as it stands: strings, empty fields as ''."""
    schema = StructType([StructField(f, StringType()) for f in fields])
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    return raw.fillna("")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to the named types; an empty field is 0 for a number, and other text in one is an error."""

    def cast(name: str, kind: str) -> Column:
        if kind == "string":
            return F.col(name)
        return F.when(F.col(name) == "", F.lit(0)).otherwise(F.col(name).cast(kind)).cast(kind).alias(name)

    return df.select(*[cast(f, kinds.get(f, "string")).alias(f) for f in df.columns])


def last_of_each(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The last row of each key in the order of ``sequence``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(sequence)))).where("_n = 1").drop("_n")


def missing_tables(spark: SparkSession, sf_dir: str, required: dict[str, list[str]]) -> list[str]:
    """What of the required tables and columns isn't there."""
    out = []
    for name, columns in required.items():
        try:
            there = spark.read.parquet(f"{sf_dir}/{name}.parquet").columns
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            out.append(name)
            continue
        out += [f"{name}.{c}" for c in columns if c not in there]
    return out


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, and the rest of ``new`` added."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def wide_union(frames: list[DataFrame], first: list[str]) -> DataFrame:
    """All rows of all frames under the union of their columns: ``first``, then the others by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[c for c in first if c in out.columns], *sorted(c for c in out.columns if c not in first))


def read_copy_dump(spark: SparkSession, path: str, table: str, fields: list[str]) -> DataFrame:
    """One table's rows of database dumps in COPY form: lines between ``COPY table ... FROM stdin;`` and ``\\.``, fields by
    tabs, ``\\N`` null. A dump is read by one task, line by line; dumps are read in parallel."""
    kind = ", ".join(f"`{f}` string" for f in fields)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        undo = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\\\": "\\"}
        for batch in batches:
            for content in batch["content"]:
                rows, inside = [], False
                for line in content.decode("utf-8").split("\n"):
                    if not inside:
                        inside = line.startswith(f"COPY {table} ") and line.rstrip().endswith("FROM stdin;")
                    elif line.rstrip("\r") == "\\.":
                        inside = False
                    else:
                        values = [None if v == "\\N" else v for v in line.rstrip("\r").split("\t")]
                        for k, v in enumerate(values):
                            if v and "\\" in v:
                                for old, new in undo.items():
                                    v = v.replace(old, new)
                                values[k] = v
                        rows.append(values)
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=fields)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, kind)


def paged_scan(spark: SparkSession, fetch: Callable[[int], list[dict]], pages: int, schema: str, key: str) -> DataFrame:
    """Rows of a paged catalogue: a task a page, ``fetch(page)`` giving its rows; a key that comes again is dropped, the
    row of the first page staying."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["id"].tolist():
                rows = fetch(page)
                if rows:
                    yield pd.DataFrame(rows).assign(_page=page)

    got = spark.range(0, pages, 1, max(1, pages)).mapInPandas(run, f"{schema}, _page long")
    first = F.row_number().over(Window.partitionBy(key).orderBy("_page"))
    return got.withColumn("_n", first).where("_n = 1").drop("_n", "_page")


#: Most halvings that range_plan counts at a time: at most 2 ** HALVINGS rows come to the driver.
HALVINGS = 14


def range_plan(ids: DataFrame, column: str, most: int) -> list[tuple[int, int, int]]:
    """Ranges [low, high) of ids with at most ``most`` rows each, empty ones left out: halves of halves. A round counts the ids
    of all ranges still too large by the range that they are in after several halvings; ranges between are sums of these."""
    id_ = F.col(column).cast("long")
    edge = ids.agg(F.min(id_).alias("a"), F.max(id_).alias("b"), F.count(id_).alias("n")).first()
    if not edge["n"]:
        return []
    rows = ids.where(id_.isNotNull()).select(id_.alias("id"), F.lit(edge["a"]).cast("long").alias("low"), F.lit(edge["b"] + 1).cast("long").alias("high"))
    todo, done = [(edge["a"], edge["b"] + 1, edge["n"])], []

    def halved(depth: int):
        def step(at, _):
            middle = at["low"] + F.shiftright(at["high"] - at["low"], 1)
            lower, upper = F.struct(at["low"].alias("low"), middle.alias("high")), F.struct(middle.alias("low"), at["high"].alias("high"))
            return F.when(at["high"] - at["low"] <= 1, at).when(F.col("id") < middle, lower).otherwise(upper)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct("low", "high"), step)

    while todo:
        done += [r for r in todo if r[2] <= most or r[1] - r[0] <= 1]
        large = [r for r in todo if r[2] > most and r[1] - r[0] > 1]
        if not large:
            break
        depth = max(1, min(HALVINGS - (len(large) - 1).bit_length(), (max(r[2] for r in large) // most).bit_length() + 1))
        wanted = F.broadcast(ids.sparkSession.createDataFrame([r[:2] for r in large], "low long, high long"))
        rows = rows.join(wanted, ["low", "high"]).select("id", halved(depth).alias("at")).select("id", "at.*")
        leaves = sorted(tuple(r) for r in rows.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).collect())
        lows, sums = [r[0] for r in leaves], [0, *itertools.accumulate(r[2] for r in leaves)]
        todo, inner = [], [(a, b, n, 0) for a, b, n in large]
        while inner:
            a, b, n, k = inner.pop()
            if n <= most or b - a <= 1 or k == depth:
                todo.append((a, b, n))
            else:
                middle = (a + b) // 2
                parts = ((x, y, sums[bisect.bisect_left(lows, y)] - sums[bisect.bisect_left(lows, x)], k + 1) for x, y in ((a, middle), (middle, b)))
                inner += [p for p in parts if p[2]]
    return sorted(done)


def range_of(id_: Column, plan: list[tuple[int, int, int]]) -> Column:
    """The low end of the range of range_plan that an id is in, by halving the list of ranges; for ids that the plan was made of."""
    lows = F.split(F.lit(",".join(str(r[0]) for r in plan)), ",").cast("array<bigint>")  # folded to a constant

    def step(at, _):
        middle = F.shiftright(at["first"] + at["last"] + 1, 1)
        upper, lower = F.struct(middle.alias("first"), at["last"].alias("last")), F.struct(at["first"].alias("first"), (middle - 1).alias("last"))
        return F.when(at["first"] == at["last"], at).when(F.get(lows, middle) <= id_, upper).otherwise(lower)

    place = F.aggregate(F.sequence(F.lit(1), F.lit(len(plan).bit_length())), F.struct(F.lit(0).alias("first"), F.lit(len(plan) - 1).alias("last")), step)
    return F.get(lows, place["first"])


def read_split(spark: SparkSession, text: str) -> DataFrame:
    """A split document (schema_version 2) as rows (subset, role, file_id, class_id), checked."""
    split = json.loads(text)
    if split.get("schema_version") != 2:
        raise ValueError("split documents have schema_version 2")
    rows = []
    for subset, body in split["subsets"].items():
        for role, files in body["roles"].items():
            for f in files:
                if f not in split["images"]:
                    raise ValueError(f"{f} is in {subset} but not among the images")
                rows.append((subset, role, f, int(split["images"][f]["class_id"])))
    if len({(s, f) for s, _, f, _ in rows}) != len(rows):
        raise ValueError("a file is twice in a subset")
    return spark.createDataFrame(rows, "subset string, role string, file_id string, class_id long")


def select_files(membership: DataFrame, subsets: list[str], roles: list[str]) -> DataFrame:
    """Distinct files of the named subsets and roles, sorted; "*" names all."""
    rows = membership
    if "*" not in subsets:
        rows = rows.where(F.col("subset").isin(*subsets))
    if "*" not in roles:
        rows = rows.where(F.col("role").isin(*roles))
    return rows.select("file_id").distinct().orderBy("file_id")


def flatten_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents (eval.json, found at any depth) as one row a metric: path, model, task, mode, k, target, value."""
    schema = "model string, tasks array<struct<task: string, top_k: array<struct<k: int, pair_completeness: double>>, thresholds: array<struct<threshold: double, pair_completeness: double>>, targets: array<struct<target: double, pair_completeness: double>>, threshold_floors: array<struct<threshold: double, pair_completeness: double>>, calibrated_top_k: array<struct<k: int, pair_completeness: double>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "eval.json").json(path)
    tasks = docs.select(F.input_file_name().alias("path"), "model", F.explode_outer("tasks").alias("t"))
    out = None
    for mode, key in (("top_k", "k"), ("thresholds", "threshold"), ("targets", "target"), ("threshold_floors", "threshold"), ("calibrated_top_k", "k")):
        rows = tasks.select("path", "model", F.col("t.task").alias("task"), F.explode(f"t.{mode}").alias("m"))
        rows = rows.select("path", "model", "task", F.lit(mode).alias("mode"), F.col(f"m.{key}").cast("double").alias("key"), F.col("m.pair_completeness").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def completed_runs(spark: SparkSession, path: str) -> DataFrame:
    """flatten_runs() of the documents RUN/models/MODEL/eval.json whose RUN/run.json says that the run is completed, with
    the run's folder as run_dir and its name as run. Other documents, and runs without run.json, are left out."""
    rows = flatten_runs(spark, path).withColumn("run_dir", F.regexp_extract("path", r"^(.*)/models/[^/]+/eval\.json$", 1)).where("run_dir <> ''")
    runs = spark.read.schema("status string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").json(path)
    done = runs.where("status = 'completed'").select(F.regexp_replace(F.input_file_name(), r"/run\.json$", "").alias("run_dir"))
    return rows.join(done, "run_dir", "left_semi").withColumn("run", F.regexp_extract("run_dir", "[^/]+$", 0))


def scan_files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """Files below a folder by extension, whatever its case: path, size, sha256. Contents stay in their tasks."""
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(wanted).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each rule the number of rows that break it, nulls counted as breaks."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def ingest(spark: SparkSession, source: str, path: str, extensions: list[str], decodes: Callable[[bytes], bool], known: DataFrame) -> DataFrame:
    """Files below a folder by extension: path (source/name), size, sha256, state. A file that ``decodes`` turns down, or on
    which it fails, is invalid; a valid one whose stem isn't in ``known`` (stem) is an orphan. Contents stay in their tasks."""
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(wanted)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fine(content: bytes) -> bool:
            try:
                return bool(decodes(bytes(content)))
            except Exception:
                return False

        for batch in batches:
            yield batch.assign(valid=[fine(c) for c in batch["content"]]).drop(columns="content")

    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content").mapInPandas(check, "path string, size long, sha256 string, valid boolean")
    rows = rows.withColumn("stem", F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1)).join(known.select("stem", F.lit(True).alias("is_known")).distinct(), "stem", "left")
    state = F.when(~F.col("valid"), "invalid").when(F.col("is_known"), "valid").otherwise("orphan")
    return rows.select(state.alias("state"), F.concat(F.lit(f"{source}/"), F.regexp_extract("path", "[^/]+$", 0)).alias("path"), "size", "sha256")


def resource_rows(spark: SparkSession, path: str) -> DataFrame:
    """Resource documents RUN/resource_metrics/NAME.json and RUN/models/MODEL/resource_metrics.json as one row a run and model:
    run, model, by_folder, num_images, images_per_second, dimensions. Those of reused caches are left out; of two for a run and
    model that of the resource_metrics folder stays."""
    embedding = "embedding struct<num_images: long, wall_time_seconds: double, cache_reused_for_run: boolean, embedding_dimensionality: long>"
    schema = f"model_id string, {embedding}, summary struct<embedding_dimensionality: long>, model struct<embedding_dim: long>"
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    place = F.regexp_extract(F.input_file_name(), r"([^/]+)/(resource_metrics/[^/]+|models/[^/]+/resource_metrics)\.json$", 1)
    docs = docs.select(place.alias("run"), F.col("model_id").alias("model"), F.input_file_name().rlike(r"/resource_metrics/[^/]+\.json$").alias("by_folder"), "embedding", "summary", F.col("model").alias("about")).where("run <> ''")
    docs = docs.where(~F.coalesce("embedding.cache_reused_for_run", F.lit(False)))
    n, seconds = F.col("embedding.num_images"), F.col("embedding.wall_time_seconds")
    rows = docs.select("run", "model", "by_folder", n.alias("num_images"), F.round(F.when(seconds > 0, n / seconds), 6).alias("images_per_second"), F.coalesce("summary.embedding_dimensionality", "embedding.embedding_dimensionality", "about.embedding_dim").alias("dimensions"))
    first = F.row_number().over(Window.partitionBy("run", "model").orderBy(F.desc("by_folder")))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def cached_scan(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A CSV table that is made once: read where it is whole, otherwise made, and whether it was made. A table is whole when its
    committer has marked it, so a broken download is made again."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    if not there:
        make().write.mode("overwrite").option("header", True).csv(path)
    return spark.read.option("header", True).csv(path), not there


def fetched(keys: DataFrame, fetch: Callable[[str], str], cache: str) -> DataFrame:
    """Responses (key, body, error) for distinct keys, those that the cache has, failures too, not asked for again. ``fetch`` runs
    in tasks; what it raises is the row's error. New rows are added to the cache before any is used."""
    spark, kind = keys.sparkSession, "key string, body string, error string"
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    old = spark.read.schema(kind).parquet(cache) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else spark.createDataFrame([], kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch["key"]:
                try:
                    rows.append((key, fetch(key), None))
                except Exception as error:
                    rows.append((key, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["key", "body", "error"])

    keys = keys.select(F.col("key").cast("string")).distinct()
    keys.join(old.select("key"), "key", "left_anti").mapInPandas(run, kind).write.mode("append").parquet(cache)
    return spark.read.schema(kind).parquet(cache).join(keys, "key", "left_semi")


def rank_files(spark: SparkSession, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Rank documents (rank_positions.json at any depth) as rows (label, seed, rank, n), of those with a label, by the first rule
    (pattern, label) that their folder meets; of several for a label and seed the first by path stays."""
    schema = "ranks array<struct<rank: int, n: long>>"
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "rank_positions.json").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/rank_positions\.json$", 1)
    label = F.coalesce(*[F.when(F.regexp_like("run", F.lit(p)), F.lit(x)) for p, x in rules])
    docs = docs.select(name.alias("run"), F.input_file_name().alias("path"), "ranks").withColumn("label", label).where("label is not null")
    docs = docs.withColumn("seed", F.regexp_extract("run", r"-s(\d+)", 1))
    first = F.row_number().over(Window.partitionBy("label", "seed").orderBy("path"))
    return docs.withColumn("_n", first).where("_n = 1").select("label", "seed", F.explode("ranks").alias("r")).select("label", "seed", "r.rank", "r.n")


def load_tables(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Several tables written below a folder, each with the first row of every key (by all its columns), as one that is inserted
    twice is left out; then how many rows were given and kept: table_name, given, kept."""
    out = None
    for name, (df, key) in tables.items():
        first = F.row_number().over(Window.partitionBy(*key).orderBy(*df.columns))
        df.withColumn("_n", first).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/{name}")
        kept = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("kept"))
        row = df.agg(F.count(F.lit(1)).alias("given")).join(F.broadcast(kept)).select(F.lit(name).alias("table_name"), "given", "kept")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def publish(spark: SparkSession, rows: DataFrame, path: str, rules: dict[str, Column]) -> DataFrame:
    """Write rows beside ``path``, check what has been written against rules (name, condition that every row meets), and only
    then rename it to ``path``, which must not be there yet. What is published is read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staging")
    system = place.getFileSystem(conf)
    if system.exists(place):
        raise ValueError(f"already published: {path}")
    rows.write.mode("overwrite").parquet(f"{path}.staging")
    broken = [r["rule"] for r in rule_report(spark.read.parquet(f"{path}.staging"), rules).where("violations > 0").collect()]
    if broken:
        system.delete(staging, True)
        raise ValueError(f"not published: {', '.join(broken)}")
    if not system.rename(staging, place):
        raise OSError(f"can't rename to {path}")
    return spark.read.parquet(path)


def number_lines(values: DataFrame) -> DataFrame:
    """Values (key, value) as the lines of a file of LaTeX numbers, in the order of keys: line. Both are escaped by the caller."""
    return values.orderBy("key").select(F.concat(F.lit("\\pnset{"), "key", F.lit("}{"), "value", F.lit("}")).alias("line"))
