import pytest
from pyspark.sql import functions as F

from pairloom.operators import protocol, registry


def test_names_and_seeds():
    assert protocol.parse_source("set a=/x/y") == ("set_a", "/x/y") and protocol.parse_source("/x/my set/") == ("my_set", "/x/my set/")
    assert protocol.parse_checkpoint(protocol.checkpoint_name("vit-l", 7, 0.25)) == ("vit-l", 7, 0.25)
    assert protocol.task_seed("a", "b") != protocol.task_seed("ab") and protocol.task_seed("a") < 1 << 64
    assert protocol.lineage_id(["a", "b"]) == protocol.lineage_id(["a", "b"]) != protocol.lineage_id(["b", "a"])
    assert protocol.log_grid(1, 1000, 4) == [1, 10, 100, 1000]


def test_rules():
    assert [protocol.set_mode("/a", None), protocol.set_mode("/a", "/a/"), protocol.set_mode("/a", "/ab")] == ["symmetric", "symmetric", "bipartite"]
    for wrong in (lambda: protocol.set_mode("/a", "/a/b"), lambda: protocol.check_targets([0.9, 0.5], [1]), lambda: protocol.check_targets([0.5], [0]), lambda: protocol.check_calibration(["*"], ["test"]), lambda: protocol.check_calibration(["test"], ["test"])):
        with pytest.raises(ValueError):
            wrong()
    protocol.check_targets([0.5, 0.9], [1, 5])
    protocol.check_calibration(["val"], ["test"])


def test_latin_square_is_balanced(spark):
    rows = protocol.latin_square(spark.range(5).select(F.col("id").alias("slot")), 5).collect()
    assert len({(r["block"], r["item"]) for r in rows}) == len({(r["place"], r["item"]) for r in rows}) == 25


def test_williams_rows():
    assert protocol.williams_rows(1) == [[0]] and protocol.williams_rows(2) == [[0, 1], [1, 0]]
    assert protocol.williams_rows(4) == [[0, 3, 1, 2], [1, 0, 2, 3], [2, 1, 3, 0], [3, 2, 0, 1]]
    assert protocol.williams_rows(5)[0] == [0, 4, 1, 3, 2] and protocol.williams_rows(5)[5] == [2, 3, 1, 4, 0] and len(protocol.williams_rows(7)) == 14
    with pytest.raises(ValueError):
        protocol.williams_rows(0)


def test_williams_schedule_is_balanced(spark):
    for n in (1, 2, 4, 5):
        schedule = protocol.williams_schedule(spark, [f"m{k}" for k in range(n)], [3, 4], 9)
        assert schedule.count() == 2 * n * len(protocol.williams_rows(n)) and protocol.unbalanced(schedule).count() == 0
    assert schedule.select("block", "image_order_seed").distinct().count() == 20
    assert {r["rule"] for r in protocol.unbalanced(schedule.where("block <> 2")).collect()} == {"blocks", "place", "neighbours"}
    assert "block" in {r["rule"] for r in protocol.unbalanced(schedule.where("block <> 2 or place <> 0")).collect()}
    square = protocol.latin_square(spark.range(4).select(F.col("id").alias("slot")), 4).select(F.lit(1).alias("cycle"), "block", "place", F.col("item").cast("string").alias("model"))
    assert {r["rule"] for r in protocol.unbalanced(square).collect()} == {"neighbours"}


def test_boxes_are_matched_greedily(spark):
    boxes = spark.createDataFrame([(1, True, 1, 0.0, 0.0, 2.0, 2.0), (1, True, 2, 0.0, 0.0, 2.0, 1.0), (1, False, 7, 0.0, 0.0, 2.0, 2.0), (1, False, 8, 0.0, 0.0, 2.0, 0.9)], "scene long, found boolean, id long, x0 double, y0 double, x1 double, y1 double")
    assert {(r["found_id"], r["true_id"], r["iou"]) for r in protocol.greedy_boxes(boxes, 0.1).collect()} == {(1, 7, 1.0), (2, 8, 0.9)}


def test_kernels(spark):
    rows = spark.createDataFrame([(1, "Abba"), (2, None)], "n long, t string")
    got = {r["id"]: r["vector"][:2] for r in registry.embed(rows, "letters", "n", "t", alphabet="abc").collect()}
    assert got == {1: [0.5, 0.5], 2: [0.0, 0.0]}
    with pytest.raises(KeyError):
        registry.embed(rows, "unknown", "n", "t")
    pairs = spark.createDataFrame([(1, 2, 4.0), (1, 3, 0.0)], "a long, b long, x double")
    out = {r["b"]: (r["status"], r["prediction"]) for r in registry.verify(pairs, lambda r: (1, 1 / r["x"], 3), ["x"]).collect()}
    assert out == {2: ("ok", 1), 3: ("failed", None)}
