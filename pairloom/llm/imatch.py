"""Document fingerprints by I-Match with several randomised lexicons.

The lexicon is the terms whose document frequency lies in a band, neither rare nor common. It is split at random, by
hash, into many small lexicons; the hash of a document's sorted distinct terms in one of them is one entry of its
fingerprint. Two texts share an entry when they agree on every term of that small lexicon. Texts of many distinct terms
need smaller lexicons than texts of few for that to say anything, so a fingerprint has two families of SLOTS lexicons: each
lexicon of family c holds one in 8**c of the terms, and texts of class c, by their distinct terms, use the families c and
c + 1; texts of neighbouring classes have a family in common.

Neighbours in id order meet without a global sort: ids fall into ranges cut at approximate percentiles, and the first
document of a range also goes, as a ghost, to the range before (of the first range, to the last).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, written

SLOTS = 64
#: The band, as shares of all documents; a term must be in two documents at least.
LEAST, MOST = 0.001, 0.1
#: Numbers of distinct terms from which a text is of the next class; classes count from 2.
CLASSES = (128, 1_024, 8_192, 65_536, 524_288, 4_194_304)
#: Ids are cut at so many percentiles, and those ranges evenly into at most so many each of about ROWS documents.
CUTS, PARTS, ROWS = 256, 4096, 500
FIRST = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms, runs of letters and digits in lower case."""
    terms = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.xxhash64(t))


def lexicon(texts: DataFrame, total: int) -> DataFrame:
    """Of (text): the hashes of the terms in the band, as column h."""
    counts = texts.select(F.explode(term_hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    counts = written(counts.where("df > 1"), "frequencies")
    return counts.where((F.col("df") >= max(2.0, LEAST * total)) & (F.col("df") <= max(2.0, MOST * total))).select("h")


def id_ranges(ids: DataFrame, total: int) -> tuple[Column, int]:
    """A number for the range of column ``k``, rising with it, and how many numbers there may be."""
    qs = [i / CUTS for i in range(CUTS + 1)]
    cuts = ids.agg(F.percentile_approx("k", qs, 100 * CUTS).alias("c")).first()["c"] or [0]
    cuts = sorted(set(cuts))
    parts = max(1, min(PARTS, round(total / ROWS / max(1, len(cuts) - 1))))
    ends = cuts[1:] + [cuts[-1] + 1]
    starts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("low"), F.lit(float(b - a)).alias("width")) for i, (a, b) in enumerate(zip(cuts, ends))])
    cut = F.array_max(F.filter(starts, lambda c: (c["i"] == 0) | (c["low"] <= F.col("k"))))
    part = F.floor((F.col("k").cast("double") - cut["low"].cast("double")) / cut["width"] * parts)
    return (cut["i"] * parts + F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1))).cast("int"), len(cuts) * parts


def neighbours(docs: DataFrame, total: int) -> DataFrame:
    """Rows (range, rn, ghost, k, text, next_text), k being the id: rn numbers a range's rows in id order, its ghost last.

    A null id comes first, as FIRST does, which counts as null; rows with the same id are in the order of their texts.
    """
    docs = docs.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(FIRST)))
    number, _ = id_ranges(docs.select("k"), total)
    firsts = docs.select(number.alias("range"), "k").groupBy("range").agg(F.min("k").alias("k"))
    order = Window.orderBy("range")
    every = Window.partitionBy(F.lit(0))
    firsts = firsts.select("k", F.coalesce(F.lag("range").over(order), F.max("range").over(every)).alias("before"))  # at most CUTS * PARTS rows
    rows = docs.withColumn("range", number).join(F.broadcast(firsts), "k", "left")
    own = F.struct("range", F.lit(False).alias("ghost"))
    also = F.struct(F.col("before").alias("range"), F.lit(True).alias("ghost"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))
    # only columns that every use of these rows needs, and the filter that a join on the range would add for one of them,
    # so that the texts are shuffled once for all uses
    rows = rows.select("k", "text", F.explode(places).alias("p")).select("p.range", "p.ghost", "k", "text").where("range is not null")
    by = Window.partitionBy("range").orderBy("ghost", "k", "text")
    return rows.select("range", F.row_number().over(by).alias("rn"), "ghost", "k", "text", F.lead("text").over(by).alias("next_text"))


def _edited() -> Column:
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))


def _class(terms: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.size(terms) >= c, 1).otherwise(0) for c in CLASSES]) + 2


def _entries(terms: Column, family: Column) -> Column:
    """The entries of a text's sorted distinct terms: for each lexicon that has some of them, family, lexicon, and 24 bits
    of their hash."""

    def entry(slot: Column) -> Column:
        own = F.filter(terms, lambda h: h.bitwiseAND(SLOTS - 1) == slot)
        mixed = F.xxhash64(own).bitwiseAND(0xFFFFFF)
        return F.when(F.size(own) > 0, F.concat(family.cast("string"), F.lpad(F.lower(F.hex(slot)), 2, "0"), F.lpad(F.lower(F.hex(mixed)), 6, "0")))

    return F.filter(F.transform(F.array_distinct(F.transform(terms, lambda h: h.bitwiseAND(SLOTS - 1))), entry), lambda e: e.isNotNull())


def fingerprints(rows: DataFrame, band: DataFrame) -> DataFrame:
    """Of neighbours(): range, rn and the sorted entries of the text (``own``) and of the edited text (``changed``). The
    lexicon ``band``, a written table, is broadcast if it is small() and otherwise joined by a shuffle."""
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.when(~F.col("ghost"), _edited()).alias("t")))
    each = rows.select("range", "rn", F.explode(texts).alias("e")).select("range", "rn", "e.kind", "e.t").where("t is not null")
    each = each.select("range", "rn", "kind", term_hashes(F.col("t")).alias("hs")).withColumn("c", _class(F.col("hs")))
    size = F.pow(F.lit(8.0), F.col("c")).cast("long")
    each = each.select("range", "rn", "kind", "c", size.alias("m"), "hs")
    used = F.filter(F.zip_with("hs", F.array_repeat(F.col("m") - 1, F.size("hs")), lambda h, m: F.when(h.bitwiseAND(m) < SLOTS, h)), lambda h: h.isNotNull())
    terms = each.select("range", "rn", "kind", "c", "m", F.explode(used).alias("h")).join(small(band), "h", "left_semi")
    terms = terms.groupBy("range", "rn", "kind", "c", "m").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    finer = F.filter(F.zip_with("hs", F.array_repeat(F.col("m") * 8 - 1, F.size("hs")), lambda h, m: F.when(h.bitwiseAND(m) < SLOTS, h)), lambda h: h.isNotNull())
    entries = F.concat(_entries(F.col("hs"), F.col("c")), _entries(finer, F.col("c") + 1))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("entries")))
    return terms.select("range", "rn", "kind", F.array_sort(entries).alias("entries")).groupBy("range", "rn").agg(of(0).alias("own"), of(1).alias("changed"))


def likeness(a: Column, b: Column) -> Column:
    """Of two sorted entry lists: the share of equal entries among the lexicons that either text has terms of, in the
    common family with more of those; 0 where there is none. Texts without entries have one that names the whole text."""

    def share(family: Column) -> Column:
        own = F.filter(a, lambda e: F.substr(e, F.lit(1), F.lit(1)) == family)
        other = F.filter(b, lambda e: F.substr(e, F.lit(1), F.lit(1)) == family)
        slot = lambda e: F.substr(e, F.lit(2), F.lit(2))
        either = F.size(F.array_union(F.transform(own, slot), F.transform(other, slot)))
        return F.struct(either.alias("n"), (F.size(F.array_intersect(own, other)) / either).alias("share"))

    families = lambda x: F.array_distinct(F.transform(x, lambda e: F.substr(e, F.lit(1), F.lit(1))))
    common = F.array_intersect(families(a), families(b))
    return F.coalesce(F.array_max(F.transform(common, share))["share"], F.lit(0.0))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    A fingerprint is its entries, sorted and joined by dots. A text without a term in the lexicon (an empty or null one,
    counted as empty, too) has one entry that names the whole text in lower case, so it is like nothing but its equals.
    The next document is the next in id order, after the last the first; a document alone is its own next. Null ids come
    first, rows with one id in the order of their texts. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.count()
    rows = neighbours(docs, total)
    band = written(lexicon(docs.select("text"), total), "lexicon")
    prints = fingerprints(rows, band)
    edited = _edited()
    whole = lambda t: F.concat(F.lit("w00"), F.lower(F.hex(F.xxhash64(F.lower(t)))))
    about = rows.select("range", "rn", "ghost", "k", F.char_length("text").cast("long").alias("n_chars"), F.when(~F.col("ghost"), F.sha2(edited, 256)).alias("edited_sha256"), whole(F.col("text")).alias("w0"), F.when(~F.col("ghost"), whole(edited)).alias("w1"))
    both = about.join(prints, ["range", "rn"], "left")
    filled = lambda c, w: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(w))
    both = both.select("range", "rn", "ghost", "k", "n_chars", "edited_sha256", filled("own", "w0").alias("own"), filled("changed", "w1").alias("changed"))
    both = both.withColumn("following", F.lead("own").over(Window.partitionBy("range").orderBy("rn"))).where("not ghost")
    return both.select(
        F.when(F.col("k") != FIRST, F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.array_join("own", ".").alias("fingerprint"),
        F.array_join("changed", ".").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
