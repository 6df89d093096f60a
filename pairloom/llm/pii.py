"""PII spans: fixed formats, plus candidates of high-recall generators that boosted trees select.

Everything is a Spark expression over one row, so a scan of the texts is one map-only stage without Python. The trees are
trained on the driver from at most TRAINING_ROWS invented snippets, as there are no labels for personal data; their features
come from the same expressions that score documents. Generators propose spans that may overlap; calibrated probabilities
choose among them.

Positions are code points. Java's matcher gives no positions to Spark, so they are the running sum of what lies between
the matches (``split``) and of the matches themselves (``regexp_extract_all``).
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees, boost, isotonic

#: The base kinds, in order, with their patterns. Each is the stated pattern, written so that Java matches
#: it in linear time and without recursion: possessive repeats, and no start inside a run that has failed from its start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a base kind to be searched for at all.
CUES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: The generators of further candidates, whose proposals overlap: runs that may be secrets, what is assigned to something (which
#: may be a part of such a run), numbers that may be a person's, and addresses written around filters.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+",
    "value": r"(?<=[A-Za-z]\x20?[=:]\x20?[\"'`]?)[A-Za-z0-9_/+-]{12,}+",
    "number": r"(?<![0-9A-Za-z])[(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,18}+(?![0-9A-Za-z])",
    "handle": r"[A-Za-z0-9._%+-]++[\x20]?(?:\(at\)|\[at\]|@|[\x20]at[\x20])[\x20]?[A-Za-z0-9-]++(?:(?:\.|[\x20]?(?:\(dot\)|\[dot\]|[\x20]dot[\x20])[\x20]?)[A-Za-z0-9-]++)++",
}
CUES |= {"secret": r"[A-Za-z0-9_/+=-]{16}", "value": r"[A-Za-z]\x20?[=:]\x20?[\"'`]?[A-Za-z0-9_/+-]{12}", "number": r"[0-9][^A-Za-z]{0,8}[0-9]", "handle": r"(?i)@|\(at\)|\[at\]| at "}
#: Words that announce a secret, a number, an address.
ANNOUNCE = {"secret": "token|secret|key|passw|pwd|auth|bearer|credential", "value": "token|secret|key|passw|pwd|auth|bearer|credential", "number": "phone|tel|call|mobile|fax|card|account|iban|ssn|social|passport", "handle": "mail|contact|write|reach"}
#: Code points before and after a candidate that its features look at.
BEFORE, AFTER = 24, 8
FEATURES = ("generator", "length", "digits", "upper", "lower", "hex", "marks", "classes", "groups", "spread", "announced", "assigned", "quoted", "closed", "glued", "hidden")
#: Most snippets of the training set.
TRAINING_ROWS = 3000
#: A generator's candidates are redacted from the lowest calibrated probability on at which this share of its held-out ones is
#: personal.
PRECISION = 0.98
CHUNK = 256


def _located(text: Column, pattern: str, cue: str) -> Column:
    """The matches of ``pattern`` as an array of (start, end, m). Running sums go by chunks, so that many matches of one
    text cost little more than their number."""
    there = F.regexp_like(text, F.lit(cue))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), lambda p: p["m"].isNotNull())
    none = F.array().cast("array<struct<gap:int,m:string>>")
    pairs = F.when(there, pairs).otherwise(none)
    whole = F.ceil(F.size(pairs) / F.lit(CHUNK)).cast("int")
    chunks = F.when(whole > 0, F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), lambda k: F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<struct<gap:int,m:string>>>"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.char_length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m")))).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    local = F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def join(acc: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["m"].alias("m")))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    nested = F.array().cast("array<array<struct<start:int,end:int,m:string>>>")
    return F.flatten(F.aggregate(local, F.struct(F.lit(0).alias("at"), nested.alias("out")), join)["out"])


def _small(part: Column) -> Column:
    """Whether a string of digits is at most 255 as a number."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, n - k + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _small)
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str, span: Column) -> Column:
    return _valid(kind, span["m"])


def _count(m: Column, drop: str) -> Column:
    return F.char_length(F.regexp_replace(m, drop, "")).cast("double")


def _features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as doubles in the order of FEATURES."""
    digits, upper, lower = _count(m, "[^0-9]"), _count(m, "[^A-Z]"), _count(m, "[^a-z]")
    flag = lambda c: c.cast("double")
    distinct = F.size(F.array_distinct(F.split(m, ""))).cast("double")
    return [
        F.lit(float(list(GENERATORS).index(kind))),
        F.char_length(m).cast("double"),
        digits,
        upper,
        lower,
        flag(F.regexp_like(m, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))),
        F.char_length(m) - digits - upper - lower,
        flag(digits > 0) + flag(upper > 0) + flag(lower > 0),
        F.size(F.split(m, "[^0-9A-Za-z]+")).cast("double"),
        distinct / F.char_length(m),
        flag(F.regexp_like(before, F.lit(f"(?i)(?:{ANNOUNCE[kind]})"))),
        flag(F.regexp_like(before, F.lit("[=:][\\x20]?[\"']?$"))),
        flag(F.regexp_like(before, F.lit("[\"'`]$"))),
        flag(F.regexp_like(after, F.lit("^[\"'`]"))),
        flag(F.regexp_like(before, F.lit("[0-9A-Za-z$€#.,]$")) | F.regexp_like(after, F.lit("^(?:[0-9A-Za-z%€]|[.,][0-9])"))),
        flag(F.regexp_like(m, F.lit(r"(?i)[(\[](?:at|dot)[)\]]|[\x20]dot[\x20]"))),
    ]


def _candidates(text: Column, kind: str) -> Column:
    """The generator's candidates of a text: an array of (start, end, x), x being the features."""

    def described(s: Column) -> Column:
        first = F.greatest(s["start"] - BEFORE, F.lit(0))
        before = F.substr(text, first + 1, s["start"] - first)
        after = F.substr(text, s["end"] + 1, F.lit(AFTER))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*_features(kind, s["m"], before, after)).alias("x"))

    return F.transform(_located(text, GENERATORS[kind], CUES[kind]), described)


def snippets(rows: int = TRAINING_ROWS, seed: int = 7) -> list[tuple[str, int, int]]:
    """Invented training snippets: text, number of the generator, and whether its candidate is personal."""
    rnd = random.Random(seed)
    word = lambda a=2, b=9: "".join(rnd.choice("aeioubcdfghlmnprstvw") for _ in range(rnd.randint(a, b)))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    pick = lambda s, n: "".join(rnd.choice(s) for _ in range(n))
    alnum = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"

    def value(good: bool) -> str:
        body = pick(alnum, rnd.randint(14, 40)) if good else rnd.choice([word(12, 20), "/".join(word(4, 6) for _ in range(3)), digits(rnd.randint(12, 14)), "_".join(word(4, 6) for _ in range(3)), f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(4)}"])
        lead = rnd.choice(["token", "api_key", "password", "client_secret", "auth"]) if good else rnd.choice(["name", "path", "title", "date", "note", word()])
        q = rnd.choice(["", '"', "'"])
        return f"{lead}{rnd.choice(['=', ': ', ' = '])}{q}{body}{q}"

    def secret(good: bool) -> str:
        if good:
            body = rnd.choice([pick("0123456789abcdef", rnd.choice([32, 40, 64])), pick(alnum, rnd.randint(20, 48)), "sk-" + pick(alnum, 32), pick("0123456789ABCDEF", 40)])
            lead = rnd.choice(["token = ", "api_key=", "secret: ", "password = ", "key: ", "Authorization: Bearer ", "TOKEN = "])
            q = rnd.choice(["", '"', "'"])
            return f"{lead}{q}{body}{q}"
        return rnd.choice([word(16, 30), "-".join(word() for _ in range(5)), "_".join(word() for _ in range(4)), "/".join(word() for _ in range(5)), "=" * rnd.randint(16, 40), "-" * rnd.randint(16, 40), digits(rnd.randint(16, 24)), word(9, 12).upper() + word(9, 12).upper()])

    def number(good: bool) -> str:
        if good:
            body = rnd.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"])
            return rnd.choice(["call ", "phone: ", "tel ", "mobile ", "SSN ", "fax: ", "account "]) + body
        return rnd.choice([f"20{digits(2)}-0{rnd.randint(1, 9)}-1{digits(1)}", digits(rnd.randint(7, 18)), f"{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", " ".join(digits(rnd.randint(1, 3)) for _ in range(6)), f"{digits(4)}-{digits(4)}", f"${digits(7)}", f"{digits(8)}%"])

    def handle(good: bool) -> str:
        if good:
            name = rnd.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}"])
            at, dot = rnd.choice([(" (at) ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", ".")])
            return f"{rnd.choice(['', '', 'mail ', 'contact: ', 'write to ', 'reach '])}{name}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net', 'de', 'co'])}"
        return rnd.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word(8, 9)}.{word()}", "look at " + word() + ".html", "meet at 5.30", f"{word()} at {digits(1)}.{digits(2)}", f"mail {word()} at {word()}.{word()}"])

    makers = [secret, value, number, handle]
    out = []
    for _ in range(rows):
        g, good = rnd.randrange(len(makers)), rnd.random() < 0.5
        out.append((f"{word()} {word()} {makers[g](good)} {word()} {word()}", g, int(good)))
    return out


@dataclass
class Model:
    """Trees, and for each generator the map of margins to probabilities and the probability from which on it redacts."""

    trees: Trees
    calibration: dict[str, Isotonic]
    least: dict[str, float]

    def probability(self, kind: str, x: Column) -> Column:
        margin = self.trees.margin_column(lambda j: F.element_at(x, j + 1))
        return self.calibration[kind].column(margin)


def train(spark: SparkSession, rows: int = TRAINING_ROWS) -> Model:
    """Fitted on two thirds of the snippets; calibrated, and thresholds set, on the third that is held out, generator by
    generator. A generator whose held-out candidates never reach PRECISION redacts nothing."""
    data = spark.createDataFrame(snippets(rows), "text string, generator int, personal int").coalesce(1)
    found = F.coalesce(*[F.when(F.col("generator") == k, F.try_element_at(F.transform(_candidates(F.col("text"), kind), lambda c: c["x"]), F.lit(1))) for k, kind in enumerate(GENERATORS)])
    data = data.select("text", "generator", "personal", found.alias("x")).where("x is not null")
    got = sorted((r["text"], r["generator"], r["personal"], list(r["x"])) for r in data.collect())  # at most ``rows``
    of, y, x = np.array([r[1] for r in got]), np.array([r[2] for r in got], float), np.array([r[3] for r in got], float)
    held = np.arange(len(y)) % 3 == 0
    trees = boost(x[~held], y[~held], rounds=24, depth=3, rate=0.3)
    calibration, least = {}, {}
    for k, kind in enumerate(GENERATORS):
        own = held & (of == k)
        margin = trees.margin(x[own])
        calibration[kind] = isotonic(margin, y[own])
        p = calibration[kind](margin)
        safe = [t for t in np.unique(p) if t >= 0.5 and y[own][p >= t].mean() >= PRECISION]
        least[kind] = float(min(safe)) if safe else 2.0
    return Model(trees, calibration, least)


@lru_cache(maxsize=4)
def _trained(spark: SparkSession) -> Model:
    return train(spark)


def _proposals(text: Column, kind: str, place: int, model: Model) -> Column:
    """The generator's candidates that reach its threshold, as an array of (rank, start, place, end) that sorts from the most
    probable down; ``place`` is the generator's."""
    scored = F.transform(_candidates(text, kind), lambda c: F.struct(model.probability(kind, c["x"]).alias("p"), c["start"].alias("start"), c["end"].alias("end")))
    kept = F.filter(scored, lambda c: c["p"] >= model.least[kind])
    return F.transform(kept, lambda c: F.struct((-c["p"]).alias("rank"), c["start"].alias("start"), F.lit(place).alias("place"), c["end"].alias("end")))


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _texts(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, span_list,

    n_spans.

    ``spans`` has all spans as kind:start:end, joined by commas, by kind (email, ip, card, phone, secret, value, number, handle)
    and start; ``span_list`` the same as structs; n_spans is their number. Base spans always stay. Of the generators'
    candidates, those that reach their generator's threshold and overlap no base span are taken by falling probability (then
    by start and kind), each that overlaps none taken before it. A null or empty text has none: counts 0, the digest of the
    empty string, ''. Texts are read whole, however long; null ids and repeated rows stand for themselves; other columns are
    not looked at.
    """
    model = _trained(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = {}
    for kind, pattern in BASE.items():
        base[kind] = _named(kind, F.filter(_located(text, pattern, CUES[kind]), partial(_valid_span, kind)))
    rows = rows.select("doc_id", "text", *[c.alias(f"of_{kind}") for kind, c in base.items()])
    rows = rows.withColumn("base", F.concat(*[F.col(f"of_{kind}") for kind in BASE]))
    proposed = [_proposals(text, kind, k, model) for k, kind in enumerate(GENERATORS)]
    rows = rows.withColumn("proposed", F.concat(*proposed))
    free = F.filter("proposed", lambda c: ~F.exists("base", lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"])))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    span = lambda c: F.struct(F.element_at(F.array(*[F.lit(k) for k in GENERATORS]), c["place"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    put = lambda taken, c: F.when(F.exists(taken, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"])), taken).otherwise(F.concat(taken, F.array(span(c))))
    rows = rows.withColumn("added", F.aggregate(F.array_sort(free), none, put))
    rows = rows.withColumn("taken", F.concat("base", *[F.array_sort(F.filter("added", partial(_is_kind, kind))) for kind in GENERATORS]))
    texts = F.array_join(_texts(F.col("taken")), ",")
    return rows.select(
        "doc_id",
        *[F.size(f"of_{kind}").cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.array_join(_texts(F.col("base")), ","), 256).alias("base_sha256"),
        texts.alias("spans"),
        (F.size("taken") - F.size("base")).cast("long").alias("n_added"),
        F.col("taken").alias("span_list"),
        F.size("taken").cast("long").alias("n_spans"),
        *["text"] * keep_text,
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span of find_pii put as [KIND]; overlapping spans count as the first of them."""
    found = find_pii(docs, id_col, text_col, keep_text=True)
    ordered = F.array_sort(F.transform("span_list", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(ordered, start, step)
    found = found.withColumn("done", done)
    return found.select("doc_id", F.concat(F.array_join("done.out", ""), F.substr("text", F.col("done.at") + 1, F.char_length("text"))).alias("text"))
