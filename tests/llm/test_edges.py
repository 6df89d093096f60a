"""Every operator and pipeline stage on rows that are awkward: null and repeated ids, null, empty and very long texts, repeated
rows, columns with clashing names, empty tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pairloom.llm import exact_dedup, imatch, importance, jaccard_join, licenses, mixing, packing, pii, queries, token_counts, toxicity

CLASHES = ["id", "n", "s", "h", "k", "p", "size", "copies", "taken_id", "dropped_id", "norm", "digest", "salt", "key", "range", "base", "taken", "part", "ids", "comp", "again_id", "number"]


def _rows():
    rnd = random.Random(4)
    long_ = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "x1", "y2"]) for _ in range(60_000))
    plain = "the quick brown fox jumps over the lazy dog near a river"
    return [
        (1, plain, "a"), (1, plain, "a"), (1, plain.upper(), "b"), (2, plain + " again", "a"), (3, None, "a"), (4, "", None), (None, plain, "a"), (None, "something of its own that nobody shares at all", None),
        (5, long_, "b"), (6, long_ + " end", "b"), (-7, "mail me at jo@example.com", "c"), (8, "mail me at jo@example.com", "c"), (8, "mail me at jo@example.com", "c"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(_rows(), "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASHES})
    return rows.withColumn("lang", F.lit("en")).withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def _each(name, docs, labels):
    toxic = labels.withColumnRenamed("toxic", "label")
    return {
        "op1": lambda: licenses.scan_licenses(docs),
        "op2": lambda: pii.find_pii(docs),
        "op3": lambda: exact_dedup.exact_dedup(docs),
        "op4": lambda: packing.pack(docs, queries.vocabulary("word_bpe_49k.json")),
        "op5": lambda: mixing.mix_sources(docs),
        "op6": lambda: importance.resample(docs, importance.good_texts(docs, labels), share=1.0),
        "op7": lambda: jaccard_join.jaccard_components(docs),
        "op8": lambda: token_counts.count_tokens(docs, queries.vocabulary("byte_bpe_50k.json")),
        "op9": lambda: imatch.fingerprint_documents(docs),
        "op10": lambda: toxicity.score_toxicity(docs, toxic, label_col="label"),
    }[name]()


@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 11)])
def test_odd_rows(odd, labels, name):
    got = _each(name, odd, labels).collect()
    rows = _rows()
    if name == "op4":  # pieces: each row's ids, all of them, once
        assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
        assert sorted(str(r["doc_id"]) for r in got if r["start"] == 0) == sorted(str(r[0]) for r in rows)
        return
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    if name == "op3":
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["group_size"] > 2} == {(1, 1, 4), (None, 1, 4), (-7, 8, 3), (8, 8, 3)}
    if name == "op7":
        assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5} and {r["component_id"] for r in got if r["doc_id"] in (-7, 8)} == {-7}
        assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}


@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 11)])
def test_empty_tables(odd, labels, name):
    assert _each(name, odd.limit(0), labels).count() == 0
    assert _each(name, odd.limit(0), labels.limit(0)).count() == 0


def test_toxic_rows_go_by_their_text(odd, labels):
    kept = toxicity.drop_toxic(odd, labels.withColumnRenamed("toxic", "label"))
    assert kept.columns == odd.columns and kept.count() == len(_rows())  # too few labels to call anything toxic


def test_copies_go_by_id_and_text(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:20]) for r in kept.collect())
    plain = "the quick brown fox "
    assert [x for x in got if x[1].lower() == plain] == [("1", plain.upper()), ("1", plain), ("1", plain), ("2", plain)]
    assert [x[0] for x in got if x[1] == ""] == ["4"] and [x[0] for x in got if x[1].startswith("mail")] == ["8", "8"]


def test_one_of_each_with_odd_ids(odd):
    kept = jaccard_join.one_of_each(odd)
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    assert kept.columns == odd.columns and got == sorted(["1", "1", "1", "3", "4", "None", "None", "5", "-7"])


def test_as_many_rows_as_the_mix_takes(odd):
    wanted = {}
    for r in mixing.mix_sources(odd).collect():
        wanted[str(r["doc_id"]), r["source_key"], r["size"]] = wanted.get((str(r["doc_id"]), r["source_key"], r["size"]), 0) + r["copies"]
    rows = mixing.mixed_documents(odd)
    assert rows.columns == odd.columns
    got = {}
    for r in rows.collect():
        key = str(r["doc_id"]), "null" if r["source"] is None else "s" + r["source"], len((r["text"] or "").split())
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in wanted.items() if n}


def test_stages_on_an_empty_table(spark, odd, small):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small)
        assert after.count() == 0, name
        if name != "packing":
            assert after.columns == docs.columns, name
