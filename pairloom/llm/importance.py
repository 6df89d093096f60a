"""Quality classifier by importance resampling.

Two generative models, bags of hashed word 1-grams and 2-grams, are counted over whole tables: one over the target texts,
one over all. A document's importance is the log of the ratio of its probabilities under them; adding Gumbel noise, made
from the id, and taking the k largest samples k documents without replacement in proportion to their importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..session import by_batches, ship_package
from .shared import small, written
from .shingles import mix, slices, words

#: Hash buckets of either model, and the count that every bucket has to begin with.
BUCKETS, PRIOR = 1 << 14, 1.0
#: Bins into which each round of the search for the k-th key cuts what is left.
BINS = 1024


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-grams and 2-grams of all texts, and for each its text's place. Case of A-Z doesn't count."""
    hashes, begin = words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    with np.errstate(over="ignore"):
        pairs = mix(mix(hashes[:-1]) + hashes[1:]) if len(hashes) else hashes
    inside = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    buckets = np.concatenate([hashes, pairs[inside]]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([owner, owner[:-1][inside] if len(owner) else owner])


def gram_counts(texts: DataFrame, name: str) -> np.ndarray:
    """Counts of a table's (text) buckets: each task sums up its own, so a task sends BUCKETS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                total += np.bincount(grams(part)[0], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    counts = by_batches(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each bucket, the log of its probability under the target over that under the raw model."""
    p, q = target + PRIOR, raw + PRIOR
    return np.log(p / p.sum()) - np.log(q / q.sum())


def top_k(keyed: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest (key, doc_id), exactly, of rows (doc_id, key, ...) without null or NaN keys.

    Counts by bins find the k-th key, each round inside the bin that has it; the rows are never sorted. What has the same
    key as the k-th row goes by the id.
    """
    if k <= 0:
        return keyed.limit(0)
    edge, need = keyed, k
    for _ in range(8):
        span = edge.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n")).first()
        if span["n"] <= need:
            low = span["a"]
            return keyed if low is None else keyed.where(F.col("key") >= F.lit(low))
        low, high = span["a"], span["b"]
        if low == high:
            break
        width = (high - low) / BINS
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        taken, at = 0, 0
        for r in sorted(edge.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
            if taken + r["count"] >= need:
                at = r["bin"]
                break
            taken += r["count"]
        need -= taken
        edge = edge.where(bin_ == at)
    above = keyed.join(edge.agg(F.max("key").alias("top")).hint("broadcast"), F.col("key") > F.col("top"), "inner").drop("top")
    last = numbered(edge, [F.desc("key"), F.desc("doc_id")], "place").where(F.col("place") < need).drop("place")
    return above.unionByName(last)


def resample(docs: DataFrame, target: DataFrame, share: float = 0.8, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of ``docs``, floor(share * rows) of them: doc_id, n_grams, log_ratio, key.

    ``target`` (text) is what the sample should be like. A text without words, or null, has ratio 0; so has every text if
    the target is empty. Noise depends on id and seed alone, so reruns agree and repeated rows are taken or left together
    up to the last; null ids count as one id. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = gram_counts(target.select("text"), "target")
    weights = log_ratio(wanted, gram_counts(docs.select("text"), "raw")) if wanted.sum() else np.zeros(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ratios = [], []
            for part in slices(batch.column(1)):
                buckets, owner = grams(part)
                sizes.append(np.bincount(owner, minlength=len(part)))
                ratios.append(np.bincount(owner, weights[buckets], len(part)))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(ratios))], ["doc_id", "n_grams", "log_ratio"])

    scored = by_batches(docs, run, "doc_id long, n_grams long, log_ratio double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    scored = written(scored.withColumn("key", F.round(F.col("log_ratio") - F.log(-F.log(uniform)), 9)), "importance")
    return top_k(scored, int(scored.count() * share))


def good_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of documents that any label calls of good quality."""
    good = written(labels.where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct(), "good")
    return docs.join(small(good), F.col("doc_id") == F.col("good_id"), "left_semi").select("text")
