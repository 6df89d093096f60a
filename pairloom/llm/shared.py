"""What the operators of this subpackage share: words, case, small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from ..sources.storage import discard, written

__all__ = ["BROADCAST", "LOWER", "UPPER", "WORD", "ascii_lower", "discard", "small", "table", "written"]

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rows of a table of ids that is broadcast: some 64 MB.
BROADCAST = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """As storage.small, with this subpackage's bound."""
    return storage.small(df, BROADCAST)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
