"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

Distinct pre-tokens are per task, and the join is a look-up in the task that has the document: a join across tasks would
shuffle a row for each document and distinct pre-token, several times the input. No ids are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_batches, ship_package
from . import tokens


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str = tokens.BYTE_LEVEL, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``pattern`` is the pre-tokenizer's, for texts in Latin letters; others are split by the library's pre-tokenizer. The
    strings of special tokens count as the library's default has it: one token. A null text counts as empty: no bytes, no tokens. Rows
    stand for themselves, so null ids, repeated rows and extra columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.Counts(tokenizer_path, pattern)
        for batch in batches:
            found = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            n_bytes = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, found], ["doc_id", "n_bytes", "n_tokens"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return by_batches(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
