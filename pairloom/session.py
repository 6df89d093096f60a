"""Session builder with the settings that the operators assume."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairloom", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` overrides any setting (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("PAIRLOOM_DRIVER_MEMORY", "8g"),
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Most bytes of an Arrow batch that goes to a Python worker: with long rows Spark's own bounds let a batch be 64 MB, which
#: the JVM and the worker hold several times over.
BATCH_BYTES = 8 << 20


def by_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)``, a worker giving back at the end of each task what its allocators hold: workers are used
    again, and what one task leaves in them counts against the memory of the next."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return df.mapInArrow(tidy, schema)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a Spark context, and keep their batches small; operators with
    Python code call it."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:  # a session's own setting stays
        spark.conf.set(bound, f"{BATCH_BYTES}b")
    context = spark.sparkContext
    if getattr(context, "_pairloom_shipped", False):
        return
    top = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="pairloom-")) / "pairloom.zip"  # Spark itself serves it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._pairloom_shipped = True
