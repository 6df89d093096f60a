"""Blocking of text records: equal titles, shared rare tokens, ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import jaccard, token_set
from ..sources.storage import written


def title_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of (id, norm) with equal titles, none empty."""
    one = left.where("norm <> ''").select(F.col("id").alias("a"), "norm")
    return one.join(right.select(F.col("id").alias("b"), "norm"), "norm").select("a", "b")


def title_pair_counts(rows: DataFrame) -> DataFrame:
    """For each title of (id, norm) that isn't empty its pairs of different ids, the smaller one first: norm, pairs. They come
    from the sizes of titles, less the pairs of rows that repeat an id; no pair is made."""
    per = rows.where("norm <> '' and id is not null").groupBy("norm", "id").agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("norm").agg(F.expr("(sum(m) * sum(m) - sum(m * m)) div 2").alias("pairs")).where("pairs > 0")


def distinct_titles(rows: DataFrame) -> DataFrame:
    """Of (id, norm): a row for each title that isn't empty: norm, words (its token set), n (rows that have it). However often
    a title comes, it is compared once."""
    return rows.where("norm <> ''").groupBy("norm").agg(F.count(F.lit(1)).alias("n")).withColumn("words", token_set(F.col("norm")))


def similar_titles(left: DataFrame, right: DataFrame, length: int = 1, least: float = 0.5) -> DataFrame:
    """Pairs (norm_a, norm_b, n_a, n_b, score) of distinct_titles() that share a word of ``length`` letters and have a Jaccard
    similarity of ``least``, above 0; equal titles too.

    A title's words are ordered from rare to frequent, and only the first n - ceil(least * n) + 1 of its n words, one of which
    any similar title has among its own first, are joined: a frequent word makes no pairs where titles have rarer ones.
    """
    both = left.select("norm", "words").union(right.select("norm", "words"))
    counts = both.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def posted(titles: DataFrame, side: str) -> DataFrame:
        rows = titles.select("norm", "words", "n", F.explode("words").alias("w")).join(counts, "w")
        first = F.size("words") - F.ceil(F.size("words") * F.lit(least)).cast("int") + 1
        rows = rows.groupBy("norm").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "w"))).alias("by"))
        rows = rows.select("norm", "words", "n", F.explode(F.transform(F.slice("by", F.lit(1), F.greatest(first, F.lit(1))), lambda x: x["w"])).alias("w"))
        return rows.select("w", *[F.col(c).alias(f"{c}_{side}") for c in ("norm", "words", "n")])

    met = posted(left, "a").join(posted(right, "b"), "w")
    met = met.where(F.size("words_a") >= F.size("words_b") * least).where(F.size("words_b") >= F.size("words_a") * least)
    met = met.withColumn("score", F.round(jaccard(F.col("words_a"), F.col("words_b")), 6)).where(F.col("score") >= least)
    long_ = F.exists(F.array_intersect("words_a", "words_b"), lambda w: F.length(w) >= length)
    return met.where(long_).select("norm_a", "norm_b", "n_a", "n_b", "score").distinct()


def token_pairs(left: DataFrame, right: DataFrame, length: int = 5, least: float = 0.5, exact: bool = False) -> DataFrame:
    """Pairs (a, b, score) of (id, norm) that share a token of ``length`` letters or more and have a Jaccard similarity of
    ``least``; pairs of equal titles only with ``exact``. Titles are compared once each; ids are joined to similar titles."""
    met = similar_titles(distinct_titles(left), distinct_titles(right), length, least)
    if not exact:
        met = met.where("norm_a <> norm_b")
    one, two = left.select(F.col("id").alias("a"), F.col("norm").alias("norm_a")), right.select(F.col("id").alias("b"), F.col("norm").alias("norm_b"))
    return met.join(one, "norm_a").join(two, "norm_b").select("a", "b", "score")


def best_titles(left: DataFrame, right: DataFrame, steps: tuple[float, ...] = (0.6, 0.3, 0.0001), other: bool = False) -> DataFrame:
    """For each a the best b among pairs with a common token: equal titles first, then the higher Jaccard, then the smaller
    id: a, b, exact, score; ``other`` leaves equal titles out.

    Titles are searched by falling bounds of similarity, each only those that have found none above the last: a title with a
    near one never meets the many that share a frequent word with it.
    """
    ids = right.groupBy("norm").agg(F.min("id").alias("b"))
    open_, titles, found = distinct_titles(left), distinct_titles(right), []
    for least in steps:
        met = similar_titles(open_, titles, 1, least)
        if other:
            met = met.where("norm_a <> norm_b")
        rows = met.join(ids.withColumnRenamed("norm", "norm_b"), "norm_b").withColumn("exact", F.col("norm_a") == F.col("norm_b"))
        best = F.min_by(F.struct("b", "exact", "score"), F.struct(~F.col("exact"), -F.col("score"), F.col("b")))
        found.append(written(rows.groupBy("norm_a").agg(best.alias("x")).select(F.col("norm_a").alias("norm"), "x.*"), "best"))
        open_ = open_.join(found[-1], "norm", "left_anti")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return left.select(F.col("id").alias("a"), "norm").join(every, "norm").select("a", "b", "exact", "score")


def next_members(asks: DataFrame, members: DataFrame, key: list[str], cap: int) -> DataFrame:
    """For each row of ``asks`` (key, id) the next ``cap`` larger ids of ``members`` (key, id) with its key: pairs (a, b). The ids
    of a key are sorted once and never paired with each other."""
    run = F.collect_list("id").over(Window.partitionBy(*key).orderBy("id").rowsBetween(0, cap - 1))
    kind = "array<bigint>"
    rows = members.select(*key, "id", run.cast(kind).alias("run"), F.lit(False).alias("asked"))
    rows = rows.unionByName(asks.select(*key, "id", F.lit(None).cast(kind).alias("run"), F.lit(True).alias("asked")))
    above = Window.partitionBy(*key).orderBy(F.desc("id")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last("run", ignorenulls=True).over(above)).where("asked")
    return rows.select(F.col("id").alias("a"), F.explode("next").alias("b"))


def ruled_pairs(pairs: DataFrame, rules: list[tuple[str, Column]], cap: int) -> DataFrame:
    """Pairs that some rule (name, condition) names, at most ``cap`` for each a: by the first rule that holds, then score,
    then b. reasons lists all rules that hold, in order."""
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    first = F.coalesce(*[F.when(c, F.lit(k)) for k, (_, c) in enumerate(rules)])
    rows = pairs.withColumn("reasons", F.array_join(named, ";")).withColumn("priority", first).where("priority is not null")
    place = F.row_number().over(Window.partitionBy("a").orderBy("priority", F.desc("score"), "b"))
    return rows.withColumn("place", place).where(F.col("place") <= cap)
