"""Identifiers, normalised titles and token sets as expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that titles are compared without, in catalogues of many languages and in those with German titles.
STOP_WORDS = ("a", "an", "the", "of", "and", "le", "la", "les", "el", "der", "die", "das")
GERMAN_STOP_WORDS = ("a", "an", "the", "of", "and", "le", "la", "les", "el", "der", "die", "das", "des", "den", "dem", "ein", "eine", "und", "von", "van", "de")
#: Words of artists' names that many names have, and titles that many works have.
GENERIC_ARTIST = (
    "master", "painter", "andrea", "giovanni", "unknown", "unbekannt", "unbekannte", "school", "schule", "werkstatt", "nachfolger", "artist", "maler", "anonymous", "anonym", "copy", "kopie", "workshop", "follower", "attributed",
)
GENERIC_TITLE = (
    "portrait of a man", "portrait of a woman", "portrait of a lady", "portrait of a girl", "madonna and child", "madonna with child", "crucifixion", "the crucifixion", "landscape", "a landscape", "still life", "self portrait",
    "head of a man", "head of a woman", "flowers", "study", "bildnis", "landschaft", "stillleben", "kreuzigung", "madonnenbild",
)


def pair_id(a_id: Column, a_sha: Column, b_id: Column, b_sha: Column, two_sets: bool = False) -> Column:
    """sha256 of both ids and contents, smaller id first, joined by NUL. A pair of an id with itself is an error, but for ends
    of ``two_sets``, which may use the same ids."""
    first = a_id < b_id
    text = F.when(first, F.concat_ws("\0", a_id, a_sha, b_id, b_sha)).otherwise(F.concat_ws("\0", b_id, b_sha, a_id, a_sha))
    if two_sets:
        return F.sha2(text, 256)
    return F.when(a_id == b_id, F.raise_error(F.lit("a pair needs two different ids"))).otherwise(F.sha2(text, 256))


def cluster_id(members: Column) -> Column:
    """sha256 of an array of member ids, sorted and joined by NUL."""
    return F.sha2(F.array_join(F.array_sort(members), "\0"), 256)


def safe_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def image_id(source: Column, path: Column) -> Column:
    return F.concat(source, F.lit("/"), F.trim(F.regexp_replace(path, r"[\\/]+", "/"), F.lit("/")))


def hash_bucket(key: Column, n: int) -> Column:
    """The first 8 bytes of sha256, as an unsigned big-endian number, modulo ``n``."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(n)).cast("long")


def hex_shard(key: Column, n: int) -> Column:
    """The first 8 hexadecimal digits of sha256, as a number, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n).cast("long")


def fold_marks(text: Column) -> Column:
    """Compatibility decomposition without combining marks; Spark has no Unicode normaliser, so Arrow batches go to Python."""

    def fold(batch):
        return batch.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return F.pandas_udf(fold, StringType(), functionType=F.PandasUDFType.SCALAR)(text)


def normalised_text(text: Column, stop: Iterable[str] = STOP_WORDS, ascii_only: bool = False) -> Column:
    """Lower case, marks folded, runs of other than letters and digits as one space, without stop words.

    ``ascii_only`` skips the folding, and with it Python, for texts that are known to be ASCII.
    """
    folded = text if ascii_only else fold_marks(text)
    words = F.split(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "), " ")
    unwanted = F.array(*[F.lit(w) for w in ("", *stop)])
    return F.array_join(F.filter(words, lambda w: ~F.array_contains(unwanted, w)), " ")


def token_set(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def tags(text: Column) -> Column:
    """A comma list as sorted distinct tags."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")))


def generic_title(norm: Column, generic: Iterable[str] = GENERIC_TITLE) -> Column:
    """Whether a normalised title says too little: empty, one of ``generic``, or of fewer than three words."""
    return norm.isin(*generic) | (F.size(F.filter(F.split(norm, " "), lambda w: w != "")) < 3)


def specific_tokens(norm: Column, generic: Iterable[str] = GENERIC_ARTIST) -> Column:
    """The words of a normalised name that tell it from others: of four letters or more, and none of ``generic``."""
    unwanted = F.array(*[F.lit(w) for w in generic])
    return F.filter(token_set(norm), lambda w: (F.length(w) >= 4) & ~F.array_contains(unwanted, w))


def match_verdict(title_a: Column, title_b: Column, artist_a: Column, artist_b: Column, score: Column, exact: Column) -> Column:
    """What a match of normalised titles is worth: obvious_false_positive where specific titles agree but the artists' words
    don't, likely where both agree, else uncertain."""
    one, two = specific_tokens(artist_a), specific_tokens(artist_b)
    shared = F.arrays_overlap(one, two)
    specific = ~generic_title(title_a) & ~generic_title(title_b)
    wrong = specific & (F.size(one) > 0) & (F.size(two) > 0) & ~shared & (score >= 0.8)
    return F.when(wrong, "obvious_false_positive").when(specific & shared & ((score >= 0.9) | exact), "likely").otherwise("uncertain")


def grouped_number(number: Column, digits: int = 0) -> Column:
    """A number with commas between thousands and fixed digits after the point."""
    return F.format_number(number, digits)


def share_label(share: Column, digits: int = 3) -> Column:
    """A share with fixed digits and without the zero before the point, as tables print it; 1 keeps its one."""
    return F.regexp_replace(F.format_number(share, digits), r"^(-?)0(?=\.)", "$1")


def latex_escape(text: Column) -> Column:
    """Text whose special signs LaTeX prints as they are."""
    text = F.regexp_replace(text, r"\\", "\x01")
    text = F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")
    text = F.regexp_replace(F.regexp_replace(text, "~", r"\\textasciitilde{}"), r"\^", r"\\textasciicircum{}")
    return F.regexp_replace(text, "\x01", r"\\textbackslash{}")


def signed_delta(value: Column, digits: int = 2) -> Column:
    """A difference with its sign, plus for zero, and fixed digits."""
    return F.format_string(f"%+.{digits}f", value.cast("double"))


def utc_iso(at: Column) -> Column:
    """A time to the second in ISO form, in UTC."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def ruled_label(name: Column, rules: Iterable[tuple[str, str]], other: str) -> Column:
    """The label of the first rule (pattern, label) that a name meets."""
    return F.coalesce(*[F.when(F.regexp_like(name, F.lit(pattern)), F.lit(label)) for pattern, label in rules], F.lit(other))
