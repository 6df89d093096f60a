"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of two lexicons (a small fixed one and one learned from labels), how near their words stand to
words of the second person, capitals, punctuation, and rates of obfuscated words. Only the classifier is fitted on a
bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_batches, ship_package
from .boosting import Isotonic, Trees, boost, isotonic, sigmoid
from .shared import written

#: Most labelled rows that the classifier is fitted on, those with the smallest hashes of their ids.
TRAINING_ROWS = 12_000
#: Most entries of the learned lexicon: words, and beginnings of words of these lengths.
LEARNED, BEGINNINGS = 600, (4, 5, 6)
#: An entry needs so many toxic documents, this likelihood ratio statistic, and these log odds.
LEAST_DOCS, LEAST_RATIO, LEAST_ODDS = 3, 20.0, 2.0
#: A small general lexicon, words of the second person, and what digits and signs stand for in words.
SEED = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk ugly hate shut hell damn crap freak creep pig rat liar vermin filth garbage imbecile cretin coward disgrace".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr tu te toi ton ta vous votre tú ti usted tus su".split())
LEET = str.maketrans("013457@$!|+", "oieastasiit")
THRESHOLD = 0.7
#: Words this near count as next to each other.
NEAR = 6
FEATURES = ("log_words", "learned", "learned_distinct", "learned_share", "learned_weight", "learned_most", "seed", "seed_share", "second_share", "near", "near_share", "obfuscated", "obfuscated_hits", "capitals", "capitals_by_word", "exclaimed", "asked", "signs", "digits")
INNER = re.compile(r"[^\w]|_")
OBFUSCATED = re.compile(r"[^\W\d_][\d@$!|+*._-]+[^\W\d_]")


@dataclass
class Lexicon:
    """Entries and their log odds; "x*" is a beginning."""

    weights: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        return max([self.weights.get(word, 0.0), *[self.weights.get(word[:n] + "*", 0.0) for n in BEGINNINGS if len(word) >= n]])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the raw ones keeps the order inside flat blocks."""
        margin = self.trees.margin(x)
        return np.clip(0.999 * self.calibration(margin) + 0.001 * sigmoid(margin), 0, 1)


class Words(dict):
    """For a word as it stands: (learned weight, seed, second person, obfuscated, obfuscated hit), or None for nothing."""

    MOST = 300_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = self.look(word)
        return found

    def look(self, word: str):
        bare = word.strip(".,;:!?\"'()[]{}<>*_-|#«»¡¿…")
        weight, seed, second = self.lexicon.weight(bare), bare in SEED, bare in SECOND
        hidden, hit = OBFUSCATED.search(bare) is not None, False
        if hidden and not weight:
            plain = INNER.sub("", bare.translate(LEET))
            weight, seed = self.lexicon.weight(plain), seed or plain in SEED
            hit = weight > 0 or seed
        return (weight, seed, second, hidden, hit) if weight or seed or second or hidden else None


def _signs(texts: pa.Array) -> np.ndarray:
    """For each text the numbers of bytes that are capitals, letters, ``!``, ``?``, other signs, digits."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    kind = np.full(256, 6, np.uint8)
    for c in range(33, 127):
        kind[c] = 4
    kind[65:91], kind[97:123], kind[48:58], kind[33], kind[63], kind[128:] = 0, 1, 5, 2, 3, 1
    out = np.zeros((len(texts), 7), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            out[k] = np.bincount(kind[data[a:b]], minlength=7)
    return out


def _near(places: np.ndarray, others: np.ndarray) -> int:
    """How many of ``places`` are at most NEAR from one of ``others``; both rise."""
    if not len(places) or not len(others):
        return 0
    after = np.searchsorted(others, places)
    gaps = np.minimum(np.abs(places - others[np.maximum(after - 1, 0)]), np.abs(others[np.minimum(after, len(others) - 1)] - places))
    return int((gaps <= NEAR).sum())


def features(texts: pa.Array, words: Words) -> np.ndarray:
    """The features of texts (none null), a row each, in the order of FEATURES."""
    signs = _signs(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts.to_pylist()):
        own = text.lower().split()
        n = max(1, len(own))
        found = [(i, hit) for i, hit in enumerate(map(words.__getitem__, own)) if hit is not None]
        bad = [(i, hit[0]) for i, hit in found if hit[0] or hit[1]]
        weights = [w for _, w in bad if w]
        second = np.array([i for i, hit in found if hit[2]], np.int64)
        near = _near(np.array([i for i, _ in bad], np.int64), second)
        seeds = sum(hit[1] for _, hit in found)
        capitals, letters, exclaimed, asked, other, digits, _ = signs[k].tolist()
        size = max(1, capitals + letters)
        out[k] = (
            math.log1p(len(own)), len(weights), len({own[i] for i, w in bad if w}), len(weights) / n, sum(weights) / n, max(weights, default=0.0), seeds, seeds / n, len(second) / n, near, near / n,
            sum(hit[3] for _, hit in found) / n, sum(hit[4] for _, hit in found), capitals / size, capitals / n, exclaimed / n, asked / n, other / n, digits / n,
        )
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1. A null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Of (text, label): words and beginnings of words that stand out in toxic documents, by documents."""
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon()
    terms = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    starts = [F.transform(F.filter(terms, _at_least(n)), _beginning(n)) for n in BEGINNINGS]
    entries = F.array_distinct(F.concat(F.filter(terms, lambda t: F.length(t) >= 3), *starts))
    counts = sample.select("label", F.explode(entries).alias("e")).groupBy("e").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    odds = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (good + 1))
    rate = (a + b) / (bad + good)
    part = lambda k, n: F.when(k > 0, k * F.log(k / (rate * n))).otherwise(0.0)
    ratio = 2 * (part(a, bad) + part(b, good))
    kept = counts.withColumn("odds", odds).withColumn("ratio", ratio).where((F.col("a") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO))
    return Lexicon({r["e"]: r["odds"] for r in kept.orderBy(F.desc("ratio"), "e").limit(LEARNED).collect()})


def _at_least(n: int):
    return lambda t: F.length(t) >= n


def _beginning(n: int):
    return lambda t: F.concat(F.substr(t, F.lit(1), F.lit(n)), F.lit("*"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that aren't held out. Of (doc_id, text) and (doc_id, label 0 or 1).

    Lexicon and trees come from three quarters of them, the calibration from the others. Without labelled documents of
    both classes every score is the same.
    """
    ship_package(docs.sparkSession)
    chosen = labels.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.withColumn("u", F.xxhash64("doc_id")).orderBy("u", "doc_id").limit(rows)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "u", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label"))
    sample = written(sample.dropDuplicates(["doc_id"]), "labelled")
    fitted = F.pmod(F.shiftright("u", 7), F.lit(4)) != 0
    lexicon = learn_lexicon(sample.where(fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(batch.column(0), words).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), x], ["doc_id", "label", "fit", "x"])

    got = by_batches(sample.select("text", "doc_id", "label", fitted.alias("fit")), run, "doc_id long, label long, fit boolean, x array<double>").collect()
    got.sort(key=lambda r: r["doc_id"])
    x, y, fit = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], float), np.array([r["fit"] for r in got], bool)
    trees = boost(x[fit], y[fit], rounds=80, depth=3, rate=0.15)
    check = ~fit if 0 < y[~fit].sum() < (~fit).sum() else np.ones(len(y), bool)
    return Model(lexicon, trees, isotonic(trees.margin(x[check]), y[check]))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    A null text scores as an empty one does. Labels other than 0 and 1, and those of unknown documents, are left out; of
    several for a document the highest counts. Ids, labels and other columns are no inputs of a score, so equal texts
    score the same. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = train(docs, labels.select(F.col("doc_id").cast("long"), F.col(label_col).alias("label")), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1), words)))], ["doc_id", "score"])

    scored = by_batches(docs, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that aren't predicted toxic, with all their columns.

    The rows go through the model as they are, other columns untouched, so nothing is joined or shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(texts, labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.lexicon)
        for batch in batches:
            scores = model.score(features(batch.column(place).fill_null(""), words))
            yield batch.filter(pa.array(scores < THRESHOLD))

    return by_batches(docs, run, docs.schema)
