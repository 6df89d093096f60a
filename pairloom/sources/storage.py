"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets a temporary folder; a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut, safe when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/pairloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() has made, once nothing that is still to run reads them."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Most bytes of passing() tables that wait for the JVM to collect its garbage by itself.
WAITING = 8 << 20
_sweeping = threading.Lock()


def passing(table: DataFrame) -> DataFrame:
    """``table``, one that written() has made for a result that is still to be computed, to be deleted by sweep() once no DataFrame
    made of it is left: their plans all hold the list of its files, which is watched by a weak reference. RDDs made of such
    DataFrames don't hold it: keep the DataFrame as long as its RDD."""
    spark, plan = table.sparkSession, table._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":  # else it stays
        files = plan.relation().location()
        watched = vars(spark.sparkContext).setdefault("_pairloom_passing", [])
        watched.append((spark._jvm.java.lang.ref.WeakReference(files), table.written_to, files.sizeInBytes()))
    return table


def sweep(spark: SparkSession) -> None:
    """Delete the passing() tables that nothing can read any more. What was let go in the last second may stay until next time."""
    watched = vars(spark.sparkContext).get("_pairloom_passing", [])
    if sum(size for _, _, size in watched) > WAITING:
        gc.collect()
        spark._jvm.java.lang.System.gc()
    with _sweeping:
        for entry in list(watched):
            held, path, _ = entry
            if held.refersTo(None):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
                watched.remove(entry)


#: Most rows of a table of a few numbers a row that is broadcast: some 64 MB.
BROADCAST = 2_000_000


def small(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``df``, a written table of a few numbers a row under distinct keys, for a join: broadcast if it has at most ``most`` rows,
    and otherwise left to Spark, which shuffles. Distinct keys take more than a byte each, so rows are counted only in tables
    of more than ``most`` bytes."""
    path, spark = vars(df).get("written_to"), df.sparkSession
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength() <= most:
            return F.broadcast(df)
    return F.broadcast(df) if df.count() <= most else df


def write_texts(spark: SparkSession, texts: dict[str, str]) -> None:
    """Small named files by path, through Hadoop's file systems, as shared folders need it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path, text in texts.items():
        place = jvm.org.apache.hadoop.fs.Path(path)
        out = place.getFileSystem(conf).create(place, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
