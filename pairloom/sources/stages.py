"""Stages whose outputs are kept under a hash of what made them, so that a rerun does only what has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .storage import write_texts


class Stages:
    """Stages in a shared folder, each fed by the one before. A stage's key is a hash of its name, its settings and the key of
    the stage before; it is reused when its table is there with the mark that is written once the table is whole and that
    names its key and rows. One driver runs a folder's stages at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.key, self.states, self.table = spark, folder.rstrip("/"), "", [], None

    def run(self, name: str, settings: dict, make: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
        """The stage's table: kept, or made by ``make`` from the table of the stage before. ``states`` says which."""
        self.key = hashlib.sha256(json.dumps([self.key, name, settings], sort_keys=True).encode()).hexdigest()
        path = f"{self.folder}/{name}-{self.key[:18]}"
        mark = f"{path}.json"
        if self._valid(mark, path):
            self.states.append((name, "reused"))
        else:
            make(self.table).write.mode("overwrite").parquet(path)
            rows = self.spark.read.parquet(path).count()
            write_texts(self.spark, {mark: json.dumps({"key": self.key, "rows": rows})})
            self.states.append((name, "ran"))
        self.table = self.spark.read.parquet(path)
        return self.table

    def _valid(self, mark: str, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(mark)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return False
        found = self.spark.read.schema("key string, rows long").json(mark).first()
        return found is not None and found["key"] == self.key and self.spark.read.parquet(path).count() == found["rows"]
