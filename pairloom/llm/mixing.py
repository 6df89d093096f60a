"""Mixing sources to target weights by entropy balancing.

Every document gets a rate in (0, 2]. Among all rates that give each source its target of words, those nearest to 1 in
relative entropy are ``min(2, exp(tilt * size))`` with one tilt a source: the dual is one convex problem a source, which
Newton's method solves from sums over the documents. Documents of one source and size have the same rate, so the sums
run over a histogram of (source, size), a distributed aggregate of the corpus; an iteration is one join and aggregation.
The rates are then rounded into whole copies, deterministically, so that a source's taken words meet its target up to
about its smallest documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .shared import WORD, discard, small, written

#: Most copies of a document.
MOST = 2
#: Newton steps, each falling back on halving the bracket, so that the count bounds the error by itself.
STEPS = 12
#: Documents of one source and size are dealt to so many groups; each is ranked by itself.
SALTS = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """Of (source_key, source, size): a row for each source: source_key, source_size, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; no target is
    above ``MOST`` times its source's size, and what is above goes to the others by weight. That is water filling: the level
    is raised while some source's cap is below it, each round one sum over the sources; the capped ones only grow, so the
    level is exact once no more are capped. Sources, of which there may be many, are numbered without one task seeing all.
    """
    per = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("turn"), F.lit(len(weights))) + 1).cast("int"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "turn").select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("cap"))
    per = written(per, "sources")
    level, capped = float("-inf"), -1
    while True:
        full = F.col("cap") / F.col("weight") <= F.lit(level)
        sums = per.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if sums["n"] == capped or not sums["open"]:
            break
        capped, level = sums["n"], max(level, (sums["all"] * share - sums["caps"]) / sums["open"])
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return per.select("source_key", "source_size", target.cast("double").alias("target"))


def _rate(tilt: Column, size: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(tilt * size, F.lit(1.0))))


def solve_tilts(cells: DataFrame, targets: DataFrame, steps: int = STEPS) -> DataFrame:
    """Of the histogram (source_key, size, n): a row for each source that has words: source_key, tilt.

    The dual's derivative, words given minus target, rises with the tilt, so a bracket stays valid. Where the Newton step
    leaves the bracket or the curvature vanishes (all documents at the cap), the middle of the bracket is taken. Sums are
    decimal, so that the order of addition can't change a result.
    """
    size, tilt = F.col("size"), F.col("tilt")
    full = F.lit(math.log(MOST) + 1e-3)  # at this tilt a document of one word is at the cap
    least = F.when(F.col("target") < F.col("source_size"), F.lit(-60.0)).otherwise(F.lit(0.0))
    start = F.when(F.col("target") >= F.col("source_size") * MOST, full).otherwise(F.lit(0.0))
    state = targets.where("source_size > 0").select("source_key", "target", least.alias("low"), full.alias("high"), start.alias("tilt"))
    for step in range(steps):
        rate = _rate(tilt, size)
        words = F.col("n") * size * rate
        slope = F.when(rate < MOST, words * size).otherwise(0.0)
        sums = cells.join(state.select("source_key", "tilt"), "source_key").groupBy("source_key")
        sums = sums.agg(*[F.sum(x.cast("decimal(38,6)")).cast("double").alias(name) for name, x in (("words", words), ("slope", slope))])
        gap = F.col("words") - F.col("target")
        moved = state.join(sums, "source_key").withColumns({"low": F.when(gap < 0, tilt).otherwise(F.col("low")), "high": F.when(gap > 0, tilt).otherwise(F.col("high"))})
        newton = F.when(F.col("slope") > 0, tilt - gap / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        best = F.when(F.abs(gap) <= F.col("target") * 1e-9, tilt).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        old, state = state if step else None, written(moved.select("source_key", "target", "low", "high", best.alias("tilt")), f"tilts-{step}")
        discard(old)
    return state.select("source_key", "tilt")


def whole_copies(cells: DataFrame, targets: DataFrame, tilts: DataFrame, rounds: int = 3) -> DataFrame:
    """The histogram with ``copies``, the whole copies that all ``n`` documents of a cell get together.

    Along falling size, expected copies are rounded by their running sum, which leaves an error of one large document at
    most; each round then gives or takes copies of the size nearest to what is left.
    """
    cells = cells.join(targets, "source_key").join(tilts, "source_key", "left")
    expected = F.col("n") * F.coalesce(_rate(F.col("tilt"), F.col("size")), F.lit(0.0))
    by_size = Window.partitionBy("source_key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum(F.when(F.col("size") > 0, expected).otherwise(0.0)).over(by_size) + 0.5)
    cells = cells.withColumn("upto", upto)
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source_key").orderBy(F.desc("size"))), F.lit(0))
    copies = F.greatest(F.lit(0), F.least(F.col("upto") - before, F.col("n") * MOST))
    cells = written(cells.select("source_key", "size", "n", "source_size", "target", copies.cast("long").alias("copies")), "copies-0")
    done = cells
    for k in range(rounds):
        left = cells.groupBy("source_key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        open_ = cells.join(left, "source_key")
        slack = F.when(F.col("left") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
        off = F.abs(F.abs(F.col("left")) - F.col("size"))
        useful = (slack > 0) & (F.col("size") > 0) & (off < F.abs(F.col("left")))
        count = F.least(slack, F.greatest(F.lit(1), F.floor(F.abs(F.col("left")) / F.col("size"))))
        pick = open_.where(useful).groupBy("source_key").agg(F.min(F.struct(off.alias("off"), "size", (count * F.signum("left")).cast("long").alias("more"))).alias("pick"))
        pick = pick.select("source_key", F.col("pick.size").alias("size"), F.col("pick.more").alias("more"))
        cells = cells.join(pick, ["source_key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")
        old, cells = done, written(cells, f"copies-{k + 1}")
        discard(old)
        done = cells
    return cells


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))  # no source's key is "null"


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, copies, source_key.

    size is the number of words, 0 for a null or empty text; such documents are not taken. Documents without a source
    form one source, the last. taken is size times copies, copies being 0, 1 or 2. Of documents that are alike in source
    and size, those with the smaller hash of the id get the odd copies; repeated rows count one by one, in any order.
    A source of no words has target 0; an empty table gives an empty result. Other columns are not looked at.
    """
    size, key = _size(F.col(text_col)), _source_key(F.col(source_col))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("source_key"), size.alias("size"))
    sizes = written(sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "source_key"), F.lit(SALTS))), "sizes")
    dealt = sizes.groupBy("source_key", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = written(dealt.groupBy("source_key", "size").agg(F.sum("n").alias("n")), "cells")
    targets = written(source_targets(sizes, weights, share), "targets")
    cells = whole_copies(cells, targets, solve_tilts(cells, targets))
    earlier = Window.partitionBy("source_key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.select("source_key", "size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    plan = first.join(cells, ["source_key", "size"])
    own = Window.partitionBy("source_key", "size", "salt").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id")
    rank = F.col("first") + F.col("rank")
    odd = F.when(rank <= F.pmod(F.col("copies"), F.col("n")), F.lit(1)).otherwise(F.lit(0))
    rows = sizes.drop("source").withColumn("rank", F.row_number().over(own)).join(plan, ["source_key", "size", "salt"])
    rows = rows.withColumn("own", (F.floor(F.col("copies") / F.col("n")) + odd).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("own") * F.col("size")).alias("taken"), F.col("own").alias("copies"), "source_key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any others) as often as the mix takes them, 0, 1 or 2 times.

    Rows find their copies by id. Where an id is null or comes again, its rows, and they alone, are told apart by source, size
    and a number among those that are alike in all three, which take the copies of their like in turn: as many rows come out as
    the mix takes, whatever the ids. Columns may have any names.
    """
    plan = written(mix_sources(docs).select(F.col("doc_id").alias("taken_id"), "size", "source_key", "copies"), "taken")
    again = written(plan.groupBy("taken_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1 or taken_id is null").select(F.col("taken_id").alias("again_id")), "again")
    is_again = F.col("pairloom_row.doc_id").eqNullSafe(F.col("again_id"))
    once = docs.select(F.struct(*docs.columns).alias("pairloom_row"))
    copies = written(plan.where("copies > 0").join(small(again), F.col("taken_id").eqNullSafe(F.col("again_id")), "left_anti").select("taken_id", "copies"), "copies")
    rows = once.join(small(copies), F.col("pairloom_row.doc_id") == F.col("taken_id")).select("pairloom_row", "copies")
    if not again.isEmpty():
        alike = ["id", "source_key", "size"]
        repeated = once.join(small(again), is_again, "left_semi").select("pairloom_row", F.col("pairloom_row.doc_id").alias("id"), _source_key(F.col("pairloom_row.source")).alias("source_key"), _size(F.col("pairloom_row.text")).alias("size"))
        number = F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64("pairloom_row")))
        wanted = plan.join(small(again), F.col("taken_id").eqNullSafe(F.col("again_id")), "left_semi").withColumnRenamed("taken_id", "id")
        wanted = wanted.withColumn("number", F.row_number().over(Window.partitionBy(*alike).orderBy(F.desc("copies")))).where("copies > 0")
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*alike, "number"]]
        rows = rows.union(repeated.withColumn("number", number).alias("l").join(wanted.alias("r"), on).select("pairloom_row", "copies"))
    return rows.select("pairloom_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pairloom_copy")).select("pairloom_row.*")
