"""N-gram Jaccard join: prefix blocks, and signature trees inside the blocks that are long.

Exact: two documents link when their sets of word shingles have a Jaccard similarity of at least 4/5, no link between
different sets is lost, and only classes that the links would give anyway save work.

1. Documents with equal sets are one class; one row of it, its member with the smallest id, goes on.
2. Blocks. Let all shingles have one order. Two sets that link share a shingle among the first n - ceil(0.8 n) + 1 of
   either (a set's prefix). The order is by hash, but the shingles known to be frequent come last, so that a common line
   is in hardly any prefix. A block is the sets that have a shingle in their prefixes.
3. Stars. In each block every set looks to the one with the smallest id; each set's most frequent partner is compared
   exactly, and the links found give a first set of components. Groups of copies collapse here, whatever their size.
4. What is left of a block is pairs of different components. Blocks no larger than a leaf are joined, and a pair goes on
   if the number of shingles that its prefixes share allows 4/5. Of the others, those with the same centre make one
   neighbourhood, which is cut into tiles; each pair of tiles is searched by two signature trees, whose nodes hold size
   ranges and the OR of their sets' bitmaps: a pair of nodes is left when the largest possible overlap of any two of
   their sets is too small. A pair that meets in several neighbourhoods is given by the first.
5. Pairs that went on are compared exactly; their links join the components. Of the pairs that trees leave, a set gives one of
   each tile first: in a group of near copies its link saves all others. Sets with pairs left out are searched again, now of the
   components that these links gave, for 4, 16 and 64 pairs, and at last for all, so that no pair of different components is lost.

A document's whole set is written once, when a pair first needs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..session import by_batches, ship_package
from . import shared
from .shared import discard, small, written
from .shingles import shingle_sets

#: Links need a similarity of NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: A first pass keeps the smallest hashes of a set, this share of them (more than a prefix), to find frequent shingles.
HEAD = 0.3
#: A shingle of more heads than FREQUENT is ordered last; at most MOST_FREQUENT of them, the most frequent, are broadcast.
#: Which shingles these are decides how long blocks are, not what is found.
FREQUENT, MOST_FREQUENT = 24, 200_000
#: Sets of a tile, of a leaf of its tree, and shingles of all a tile's sets.
TILE, LEAF, TILE_SHINGLES = 256, 8, 1 << 22
#: Blocks of more sets than this are long: signature trees search them.
LONG = LEAF
#: Neighbourhoods of a set that are listed with it; the pairs of a set of more may be given more than once.
LISTED = 64
#: Pairs of one set that a task compares exactly; what is above goes to others.
HELD = 10_000
#: Bytes of bitmaps that are compared at a time.
COMPARED = 1 << 23
BASE = "id long, n long, k1 long, k2 long, head array<long>"


def prefix_size(n: np.ndarray | int):
    """Number of shingles that come before a set of n has too few left to link: n - ceil(0.8 n) + 1."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def bit_count(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: 16 to 32 a shingle, and as many as a set needs that is compared to larger ones."""
    kind = n.bit_length() - 1
    return 1 << max(6, kind + 5 + (n * DENOMINATOR >= NUMERATOR << (kind + 1)))


def bitmap(own: np.ndarray, size: int | None = None) -> bytes:
    bits = np.zeros(size or bit_count(len(own)), bool)
    bits[(own >> np.uint64(20)).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap in ``width`` 64-bit words, from one as wide or wider by powers of two."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) > width:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The numpy arrays of a list column of longs, as unsigned."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def base_table(docs: DataFrame) -> DataFrame:
    """Of (id, text): size, two sums that name the set, and head of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            with np.errstate(over="ignore"):
                sums = [(int(s.view(np.int64).sum()), int((s * (s >> np.uint64(7)) ^ s).view(np.int64).sum())) for s in sets]
            heads = [s[: int(len(s) * HEAD) + 1] for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1)], _lists(heads)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "k1", "k2", "head"])

    return written(by_batches(docs, run, BASE), "sets")


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole sets (id, s) of the documents with the given distinct ids, a written table, made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(shingle_sets(batch.column(1)))], ["id", "s"])

    return written(by_batches(docs.join(small(ids), "id", "left_semi").select("id", "text"), run, "id long, s array<long>"), "whole")


class Sets:
    """Whole sets, each written once, when it is first asked for. Where more are asked for than a broadcast holds, and the
    texts have to be shuffled, those of all sets in ``blocks`` (id, ...) are written, so that it happens once."""

    def __init__(self, docs: DataFrame, blocks: DataFrame):
        self.docs, self.blocks, self.ids, self.tables = docs, blocks, [], []

    def have(self, ids: DataFrame) -> None:
        """See to the sets of distinct ``ids``."""
        new = written(self._without(ids), "asked")
        n = new.count()
        if n > shared.BROADCAST:
            discard(new)
            new = written(self._without(self.blocks.select("id").distinct()), "asked")
        if n or not self.tables:
            self.ids.append(new)
            self.tables.append(sets_of(self.docs, new))

    def _without(self, ids: DataFrame) -> DataFrame:
        for have in self.ids:
            ids = ids.join(small(have), "id", "left_anti")
        return ids

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, s) of the written table of distinct ``ids``."""
        self.have(ids)
        return reduce(DataFrame.union, self.tables).join(small(ids), "id", "left_semi")

    def discard(self) -> None:
        discard(*self.ids, *self.tables)


def representatives(base: DataFrame) -> DataFrame:
    """(id, rep) of the sets that equal one of a smaller id, rep being the smallest. Empty sets equal nothing."""
    same = written(base.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1"), "classes")
    large = same.where(F.col("m") > 10_000).orderBy(F.desc("m")).limit(1_000).select("n", "k1", "k2", F.col("rep").alias("hot"))
    rows = base.select("id", "n", "k1", "k2").where("n > 0").join(F.broadcast(large), ["n", "k1", "k2"], "left")  # at most 1,000 rows
    rest = same.select("n", "k1", "k2", "rep")
    key = F.when(F.col("hot").isNull(), F.col("k1")).otherwise(F.col("id"))  # found already: dealt out, and found again by none
    rows = rows.withColumn("k1", key).join(rest, ["n", "k1", "k2"], "left")
    return rows.select("id", F.coalesce("hot", "rep").alias("rep")).where("rep is not null and rep <> id")


def frequent_shingles(base: DataFrame) -> np.ndarray:
    counts = base.select(F.explode("head").alias("h")).groupBy("h").count().where(F.col("count") > FREQUENT)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT)
    return np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(np.uint64))


def _prefix(n: int, head: np.ndarray, frequent: np.ndarray) -> np.ndarray | None:
    """The first prefix_size(n) shingles, frequent ones last, from a set's smallest; None if these don't tell."""
    last, p = _among(head, frequent), prefix_size(n)
    if not last[:p].any():
        return head[:p]
    rare = head[~last]
    if len(rare) >= p:
        return rare[:p]
    return np.concatenate([rare, head[last]])[:p] if len(head) == n else None


def postings(docs: DataFrame, base: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Rows (h, id, n) of all sets' prefixes. Where a head doesn't tell the prefix, the whole set is made anew."""

    def rows(ids: pa.Array, sets: list[np.ndarray], ns: list[int]) -> tuple[pa.RecordBatch, list[int]]:
        found = [_prefix(n, s, frequent) for n, s in zip(ns, sets)]
        sizes = [0 if p is None else len(p) for p in found]
        flat = np.concatenate([*[p for p in found if p is not None], np.zeros(0, np.uint64)]).view(np.int64)
        ids = ids.to_numpy(zero_copy_only=False)
        columns = [pa.array(flat), pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(np.array(ns, np.int64), sizes))]
        return pa.RecordBatch.from_arrays(columns, ["h", "id", "n"]), [int(i) for i, p in zip(ids, found) if p is None]

    def untold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = rows(batch.column(0), _arrays(batch.column(2)), batch.column(1).to_pylist())[1]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["id"])

    def from_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch.column(0), _arrays(batch.column(2)), batch.column(1).to_pylist())[0]

    def from_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _arrays(batch.column(1))
            yield rows(batch.column(0), sets, [len(s) for s in sets])[0]

    heads = base.select("id", "n", "head")
    kind = "h long, id long, n long"
    asked = written(by_batches(heads, untold, "id long"), "untold")
    whole = sets_of(docs, asked)
    found = written(by_batches(heads, from_heads, kind).union(by_batches(whole, from_sets, kind)), "postings")
    discard(asked, whole)
    return found


def verified(pairs: DataFrame, sets: Sets) -> DataFrame:
    """Of distinct pairs (a, b), those that link, as a written table. Both ends' sets are joined to a pair; an end with more
    than HELD pairs is dealt out, its set going to each part."""
    pairs = written(pairs.select("a", "b"), "pairs")
    if pairs.isEmpty():
        return pairs
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    rows, whole, sides, done = pairs, sets.of(ids), [], [pairs, ids]
    parts = F.coalesce("parts", F.lit(1))
    for end, other in (("a", "b"), ("b", "a")):
        many = written(pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("parts")).where("parts > 1"), "many")
        rows = rows.join(small(many), end, "left").withColumn(f"deal_{end}", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
        own = whole.select(F.col("id").alias(end), F.col("s").alias(f"s{end}")).join(small(many), end, "left")
        sides.append((end, own.select(end, f"s{end}", F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"deal_{end}"))))
        done.append(many)
    for end, own in sides:
        rows = rows.join(own, [end, f"deal_{end}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3))):
                common = int(_among(x, y).sum()) if len(x) <= len(y) else int(_among(y, x).sum())
                keep.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    linked = written(by_batches(rows.select("a", "b", "sa", "sb"), run, "a long, b long"), "linked")
    discard(*done)
    return linked


def _spare(n: Column) -> Column:
    """Shingles of a set of ``n`` outside its prefix."""
    return F.ceil(n * NUMERATOR / DENOMINATOR) - 1


def star_pairs(blocks: DataFrame, seed: int) -> DataFrame:
    """Of (h, id, n, df, comp): a pair for each set of which some block's centre is of another component: the centre met most
    often. The centre is the smallest id of a block, or, with a seed, the smallest hash."""
    order = F.col("id") if not seed else F.xxhash64(F.lit(seed), F.col("id"))
    centres = blocks.groupBy("h").agg(F.min(F.struct(order.alias("o"), "id", "comp", "n")).alias("c"), F.max("df").alias("df"))
    # a block of several tiles is dealt out, and its centre goes to each part
    parts = F.ceil(F.col("df") / TILE).cast("int")
    centres = centres.select("h", "c.id", "c.comp", "c.n", F.explode(F.sequence(F.lit(0), parts - 1))).toDF("h", "b", "comp_b", "n_b", "part")
    met = blocks.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).join(centres, ["h", "part"]).where("comp <> comp_b").where(F.least("n", "n_b") * DENOMINATOR >= F.greatest("n", "n_b") * NUMERATOR)
    met = met.groupBy("id", "b", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") * 4 >= F.col("n") - _spare(F.col("n")))
    best = met.groupBy("id").agg(F.max(F.struct("m", "b")).alias("x"))
    return best.select(F.least("id", "x.b").alias("a"), F.greatest("id", "x.b").alias("b")).distinct()


def short_pairs(blocks: DataFrame) -> DataFrame:
    """Of the blocks (h, id, n, comp, df, n_long) that are short: pairs of different components that can link. They
    share at most what their prefixes share, of which the ``n_long`` in long blocks aren't seen here, and the rest of one."""
    one = blocks.where(F.col("df") <= LONG).select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("n_long").alias("la"))
    two = one.toDF("h", "b", "nb", "cb", "lb")
    met = one.join(two, "h").where("a < b and ca <> cb").where(F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR)
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("na", "nb", "la", "lb")])
    most = F.col("m") + F.least("la", "lb") + F.greatest(_spare(F.col("na")), _spare(F.col("nb")))
    return met.where(most * (NUMERATOR + DENOMINATOR) >= (F.col("na") + F.col("nb")) * NUMERATOR).select("a", "b")


class Tree:
    """A signature tree over the sets of a tile, by rising size. Level 0 has the sets, each level above nodes of LEAF
    below; a node has a range of sizes, the OR of its bitmaps, and the AND, whose bits all its sets have."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.low, self.high, self.any, self.all = [sizes], [sizes], [bits], [bits]
        while len(self.low[-1]) > 1:
            cut = np.arange(0, len(self.low[-1]), LEAF)
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], cut))
            self.all.append(np.bitwise_and.reduceat(self.all[-1], cut))

    def level(self, k: int) -> int:
        return min(k, len(self.low) - 1)

    def below(self, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes of level ``k``, and which node each is of."""
        first = nodes * LEAF
        count = np.minimum(first + LEAF, len(self.low[k - 1])) - first
        owner = np.repeat(np.arange(len(nodes)), count)
        return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner], owner


def dual_search(left: Tree, right: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a set of each tree whose largest possible overlap allows a link: a set has at least as many shingles that
    another lacks as bits that the other's bitmap lacks."""
    k = max(len(left.low), len(right.low)) - 1
    x = y = np.zeros(1, np.int64)
    at_once = max(1, COMPARED // left.any[0][:1].nbytes)
    while True:
        i, j = left.level(k), right.level(k)
        low_x, high_x, low_y, high_y = left.low[i][x], left.high[i][x], right.low[j][y], right.high[j][y]
        fits = (high_x * DENOMINATOR >= low_y * NUMERATOR) & (high_y * DENOMINATOR >= low_x * NUMERATOR)
        x, y = x[fits], y[fits]
        kept = [np.zeros(0, bool)]
        for first in range(0, len(x), at_once):
            u, v = x[first : first + at_once], y[first : first + at_once]
            lacks_v = np.bitwise_count(left.all[i][u] & ~right.any[j][v]).sum(1, dtype=np.int64)
            lacks_u = np.bitwise_count(right.all[j][v] & ~left.any[i][u]).sum(1, dtype=np.int64)
            most = np.minimum(left.high[i][u] - lacks_v, right.high[j][v] - lacks_u)
            kept.append(most * (NUMERATOR + DENOMINATOR) >= (left.low[i][u] + right.low[j][v]) * NUMERATOR)
        keep = np.concatenate(kept)
        x, y = x[keep], y[keep]
        if k == 0 or not len(x):
            return x, y
        if i == k:
            below, owner = left.below(k, x)
            x, y = below, y[owner]
        if j == k:
            below, owner = right.below(k, y)
            x, y = x[owner], below
        k -= 1


def tile_pairs(n: np.ndarray, bits: list[bytes], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x of side 0, y of side 1) of the sets of two tiles that trees can't tell apart. Sets are searched by classes
    of size, up to twice the smallest, so that one width of bitmap suits all; those of the class below that can link with
    larger ones are guests."""
    kind = np.frexp(n.astype(float))[1] - 1
    found = [(np.zeros(0, np.int64),) * 2]
    for c in np.unique(kind).tolist():
        guest = (kind == c - 1) & (n * DENOMINATOR >= NUMERATOR << c)
        there = np.flatnonzero((kind == c) | guest)
        there = there[np.argsort(n[there], kind="stable")]
        one, two = there[side[there] == 0], there[side[there] == 1]
        if len(one) and len(two):
            width = 1 << max(0, c - 1)
            trees = [Tree(n[own], np.stack([folded(bits[k], width) for k in own.tolist()])) for own in (one, two)]
            x, y = dual_search(*trees)
            x, y = one[x], two[y]
            once = ~(guest[x] & guest[y])
            found.append((x[once], y[once]))
    return tuple(np.concatenate(part) for part in zip(*found))


def neighbourhoods(blocks: DataFrame) -> DataFrame:
    """Of the long blocks, a written table (c, id, n, comp) of the sets of each neighbourhood, c being its centre."""
    rows = blocks.where(F.col("df") > LONG).select("h", "id", "n", "comp", "df")
    centres = written(rows.groupBy("h").agg(F.min(F.xxhash64(F.lit(7), "id")).alias("c")), "centres")
    near = written(rows.join(small(centres), "h").groupBy("c", "id", "n", "comp").agg(F.count(F.lit(1)).alias("m")).drop("m"), "near")
    discard(centres)
    return near


def thinned(x: np.ndarray, y: np.ndarray, key: np.ndarray, odd: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs of places (x, y) are among the first ``most`` of their x: partners that aren't odd come first, then it
    goes by ``key``."""
    order = np.lexsort((key[y], odd[y], x))
    n = np.bincount(x, minlength=len(key))
    kept = np.zeros(len(x), bool)
    kept[order] = np.arange(len(x)) - (np.cumsum(n) - n)[x[order]] < most
    return kept


def long_pairs(near: DataFrame, sets: Sets, most: int | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of the sets of neighbourhoods (c, id, n, comp): pairs of different components that signature trees can't tell apart. With
    ``most``, at most so many for a set in each pair of tiles. The second table (id) has the ends of pairs that this left out;
    given as ``only`` to the next call, with later components, none but pairs of them are searched.

    Blocks with the same centre, the smallest hash of an id, make one neighbourhood, so that a group of near copies, which
    has hundreds of shingles in common, is searched a few times and not hundreds of times. In a neighbourhood only sets
    outside the component of its smallest id are compared, to all others: tiles of these against tiles of all. A pair is
    given by the first neighbourhood that has both.
    """
    about = written(near.groupBy("c").agg(F.min(F.struct("id", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")), "about")
    near = near.withColumn("open", F.lit(True)) if only is None else near.join(small(only.withColumn("open", F.lit(True))), "id", "left").fillna(False, ["open"])
    odd = near.join(small(about), "c").where("open and comp <> main").groupBy("c").agg(F.count(F.lit(1)).alias("o"), F.sum("n").alias("v"))
    tiles = lambda m, w: F.ceil(F.greatest(F.col(m) / TILE, F.col(w) / TILE_SHINGLES)).cast("int")
    plan = written(about.join(odd, "c").select("c", "main", tiles("o", "v").alias("ko"), tiles("m", "w").alias("km")), "plan")
    rows = compared = written(near.join(small(plan), "c"), "compared")
    ids = written(rows.groupBy("id").agg(F.when(F.count(F.lit(1)) <= LISTED, F.array_sort(F.collect_list("c"))).alias("cs")), "ids")
    names = written(ids.select("id"), "names")

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bitmap(s) for s in _arrays(batch.column(1))], pa.binary())], ["id", "bits"])

    bits = by_batches(sets.of(names).select("id", "s"), bits_of, "id long, bits binary")
    rows = rows.join(ids.join(bits, "id"), "id")
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    strange = F.col("open") & (F.col("comp") != F.col("main"))
    as_left = F.transform(every("km"), lambda j: F.struct(own("ko").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_right = F.transform(every("ko"), lambda i: F.struct(i.alias("i"), own("km").alias("j"), F.lit(1).alias("side")))
    places = F.when(strange, F.concat(as_left, as_right)).otherwise(as_right)
    rows = rows.select("c", "id", "n", "comp", strange.alias("strange"), "cs", "bits", F.explode(places).alias("p"))
    rows = rows.select("c", "p.i", "p.j", "p.side", "id", "n", "comp", "strange", "cs", "bits")

    def search(group: pa.Table) -> pa.Table:
        c, side, ids, n, comp, odd_one = (group.column(k).to_numpy() for k in ("c", "side", "id", "n", "comp", "strange"))
        x, y = tile_pairs(n, group.column("bits").to_pylist(), side)
        apart = (comp[x] != comp[y]) & (~odd_one[y] | (ids[x] < ids[y]))
        x, y = x[apart], y[apart]
        cs = group.column("cs").to_pylist()
        lists = {k: cs[k] and set(cs[k]) for k in {*x.tolist(), *y.tolist()}}
        here = int(c[0]) if len(c) else 0
        first = np.array([not lists[u] or not lists[v] or min(lists[u] & lists[v]) == here for u, v in zip(x.tolist(), y.tolist())], bool)
        x, y = x[first], y[first]
        kept = thinned(x, y, ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), odd_one, most) if most else np.ones(len(x), bool)
        left = np.unique(np.concatenate([x[~kept], y[~kept][odd_one[y[~kept]]]]))
        a, b = ids[x][kept], ids[y][kept]
        none = lambda n: pa.nulls(n, pa.int64())
        ends = zip((np.minimum(a, b), np.maximum(a, b)), (none(len(left)),) * 2)
        return pa.table(dict(zip("ab", [pa.chunked_array([pa.array(u), v]) for u, v in ends])) | {"left": pa.chunked_array([none(len(a)), pa.array(ids[left])])})

    found = written(rows.groupBy("c", "i", "j").applyInArrow(search, "a long, b long, left long"), "found")
    pairs = written(found.where("left is null").select("a", "b").distinct(), "candidates")
    left = written(found.where("left is not null").select(F.col("left").alias("id")).distinct(), "left-out")
    discard(about, plan, compared, ids, names, found)
    return pairs, left


#: Pairs of a set in each pair of tiles, one search after the other; the last gives all.
THINNED = (1, 4, 16, 64, None)
#: Times that stars with other centres are tried on blocks that are still open.
STARS = 3


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest id that links reach. A null text, or one without words, has no shingles and links with
    nothing; a text of fewer than five words has one shingle, all of it. The id names a document: rows that repeat an id
    repeat its text, and share one result; a row with a null id links with nothing and has a null component. An empty
    table gives an empty result; other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base_table(docs)
    known, once = base.where("id is not null and n > 0"), None
    if not known.groupBy("id").count().where("count > 1").isEmpty():
        known = written(known.dropDuplicates(["id"]), "sets-once")
        once = known
        docs = docs.where("id is not null").dropDuplicates(["id"])
    copies = written(representatives(known), "copies")
    unique = known.join(small(copies).select("id"), "id", "left_anti")
    frequent = frequent_shingles(unique)
    rows = postings(docs.where("id is not null"), unique, frequent)
    shared_ = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    blocks = written(rows.join(small(shared_), "h").select("h", "id", "n", "df"), "blocks")
    sizes = written(base.select("id", "n"), "sizes")
    discard(base, once, rows, shared_)
    sets = Sets(docs.where("id is not null"), blocks)
    links, comps, open_ = [], None, None
    for k in range(STARS + 1):
        placed = blocks.withColumn("comp", F.col("id"))
        if comps is not None:
            placed = blocks.join(small(comps), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        mixed = written(placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h"), f"mixed-{k}")
        old, open_ = open_, written(placed.join(small(mixed), "h", "left_semi"), f"open-{k}")
        discard(old, mixed)
        if k == STARS:
            break
        found = verified(star_pairs(open_, k), sets)
        if found.isEmpty():
            discard(found)
            break
        links.append(found)
        discard(comps)
        comps = written(graph.components(reduce(DataFrame.union, links)), "comps")
    n_long = written(blocks.where(F.col("df") > LONG).groupBy("id").agg(F.count(F.lit(1)).alias("n_long")), "n-long")
    short = short_pairs(open_.join(small(n_long), "id", "left").fillna(0, ["n_long"]))
    near, left = neighbourhoods(open_), None
    for most in THINNED:
        placed = near
        if left is not None:
            placed = near.join(small(comps), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component") if comps is not None else near
        old = left
        long_, left = long_pairs(placed, sets, most, left)
        found = verified((short.union(long_) if old is None else long_).distinct(), sets)
        discard(old, long_)
        if found.isEmpty():
            discard(found)
        else:
            links.append(found)
            discard(comps)
            comps = written(graph.components(reduce(DataFrame.union, links)), "comps")
        if left.isEmpty():
            break
    discard(n_long, open_, blocks, near, left)
    sets.discard()
    rep = copies
    if comps is not None:
        rep = copies.join(small(comps).withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("rep")).union(comps.join(small(copies).select("id"), "id", "left_anti").select("id", "component"))
        rep = written(rep, "rep")
    discard(*links)
    rows = sizes.join(small(rep), "id", "left")
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose id is the smallest of its component, with all their columns. Rows
    with a null id link with nothing and stay; rows that repeat an id stay or go together. Columns may have any names."""
    dropped = written(jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("pairloom_row"))
    return rows.join(small(dropped), F.col("pairloom_row.doc_id") == F.col("dropped_id"), "left_anti").select("pairloom_row.*")
