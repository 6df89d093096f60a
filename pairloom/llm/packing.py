"""Packing by concatenating and cutting.

First pass: every partition tokenizes its documents, numbers their ids from its own start, and writes them as a table.
The partitions' totals, one number a partition, are summed up on the driver to give each partition's global start.
Second pass: an id's global place is its partition's start plus its own, so each document is cut where the fixed windows
end, by itself; a window's boundary records are the pieces on both sides of the cut. Only the last window has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_batches, ship_package
from . import tokens
from .shared import written

WINDOW = 4096
FIRST = "part int, doc_id long, local long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces that a task holds before it hands them on.
HELD = 20_000


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """The first pass, as a table: each document's ids with the number of ids before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, local = tokens.Ids(tokenizer_path), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(2, "little")
        for batch in batches:
            ids = [ids_of(t.as_py()) + end for t in batch.column(1)]
            n = np.array([len(x) // 2 for x in ids], "int64")
            starts = local + np.cumsum(n) - n
            local += int(n.sum())
            columns = [pa.array(np.full(len(ids), part, "int32")), batch.column(0), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local", "n", "ids"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return written(by_batches(rows, run, FIRST), "ids", compression="zstd")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and ``end_id``; sequences are filled one after the other, without gaps, in the order of the
    partitions and of the rows in them. ``ids_crc32`` is of the piece's ids as little-endian unsigned 32-bit numbers;
    ``with_ids`` adds these as ``ids``. A null or empty text is ``end_id`` alone. A document of any length is cut into as
    many pieces as windows that it reaches. Repeated rows are packed one by one; an empty table gives no pieces; other
    columns of ``docs`` are not looked at.
    """
    table = tokenized(docs, tokenizer_path, end_id)
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a partition
    sizes = np.array([totals.get(k, 0) for k in range(max(totals, default=-1) + 1)], "int64")
    starts = np.cumsum(sizes) - sizes
    names = PIECES.replace(" long", "").split(", ") + ["ids"] * with_ids

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple] = []
        for batch in batches:
            for part, doc_id, local, n, ids in zip(*[c.to_pylist() for c in batch.columns]):
                place, wide, start = int(starts[part]) + local, np.frombuffer(ids, "<u2").astype("<u4"), 0
                while start < n:
                    offset = (place + start) % window
                    length = min(n - start, window - offset)
                    own = wide[start : start + length].tobytes()
                    pieces.append((doc_id, start, length, zlib.crc32(own), n, (place + start) // window, offset, *[own] * with_ids))
                    start += length
                    if len(pieces) >= HELD:
                        yield rows(pieces)
                        pieces = []
        if pieces:
            yield rows(pieces)

    return by_batches(table, run, PIECES + ", ids binary" * with_ids)
