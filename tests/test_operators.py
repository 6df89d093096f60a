"""Small inputs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import strings, vectors
from pairloom.operators import blocking, calibrate, certify, graph, lookups, metrics, ordering, pairs, runs, similarity, splits
from pairloom.sources import manifests, storage


def frozen(spark):
    """Five queries and five candidates; a query's own is its match, the rest score -1."""
    own = {1: 0.9, 2: 0.85, 3: 0.8, 4: 0.75, 5: 0.4}
    rows = [(q, c + 10, q, c, own[q] if q == c else -1.0) for q in own for c in own]
    p = spark.createDataFrame(rows, "query_id long, candidate_id long, query_class long, candidate_class long, score double")
    counts = spark.createDataFrame([(q, q, 5, 1) for q in own], "query_id long, query_class long, n_candidates long, n_positives long")
    return p, counts


def test_threshold_is_frozen(spark):
    p, counts = frozen(spark)
    val = spark.createDataFrame([(1, 11, 1, 1, 0.7), (2, 12, 2, 2, 0.7), (1, 12, 1, 2, 0.3), (2, 11, 2, 1, 0.2)], p.schema)
    val_counts = spark.createDataFrame([(1, 1, 2, 1), (2, 2, 2, 1)], counts.schema)
    points = calibrate.target_operating_points(val, val_counts, [0.99])
    assert [(r["threshold"], r["pair_completeness"]) for r in points.collect()] == [(0.7, 1.0)]
    got = calibrate.transferred(points, p, counts).first()
    assert (got["pair_completeness"], got["attained"]) == (0.8, False)
    assert calibrate.target_operating_points(p, counts, [1.0]).first()["threshold"] == 0.4


def test_floor_rescues(spark):
    p, counts = frozen(spark)
    for floor in (1, 2):
        r = metrics.threshold_metrics(p, counts, [0.7], floor=floor).first()
        assert (r["pair_completeness"], r["floor_rescued"]) == (1.0, 1)
    assert metrics.threshold_metrics(p, counts, [0.7], floor=1).first()["floor_queries"] == 1


def test_ties_go_to_the_first_candidate(spark):
    p = spark.createDataFrame([(1, 1, 9, 8, 0.5), (1, 2, 9, 9, 0.5), (1, 3, 9, 7, 0.1)], "query_id long, candidate_id long, query_class long, candidate_class long, score double")
    counts = spark.createDataFrame([(1, 9, 3, 1)], "query_id long, query_class long, n_candidates long, n_positives long")
    r = metrics.threshold_metrics(p, counts, [0.9], floor=1).first()
    assert (r["candidate_pairs"], r["true_positives"]) == (1, 0)


def test_candidate_sizes_keep_zero(spark):
    p, _ = frozen(spark)
    q = spark.createDataFrame([(k,) for k in range(1, 6)], "id long")
    assert {(r["size"], r["queries"]) for r in metrics.candidate_sizes(p, q, [0.7]).collect()} == {(1, 4), (0, 1)}


def test_unattainable_k(spark):
    m = spark.createDataFrame([(1, 0.8)], "k int, pair_completeness double")
    assert calibrate.calibrated_k(m, [0.99]).first().asDict() == {"target": 0.99, "k": None, "status": "target_not_attained"}
    assert calibrate.calibrated_k(m, [0.99], fallback=True).first().asDict() == {"target": 0.99, "k": 1, "status": "least_restrictive"}


def test_distinct_targets(spark):
    rows = [(i, i, 1, 1, 1 - i / 1000) for i in range(1, 201)] + [(i, i + 1000, 1, 2, -1.0) for i in range(1, 201)]
    p = spark.createDataFrame(rows, "query_id long, candidate_id long, query_class long, candidate_class long, score double")
    counts = spark.createDataFrame([(i, 1, 2, 1) for i in range(1, 201)], "query_id long, query_class long, n_candidates long, n_positives long")
    got = {r["target"]: (r["true_positives"], r["threshold"]) for r in calibrate.target_operating_points(p, counts, [0.95, 0.99, 0.995]).collect()}
    assert [got[t][0] for t in (0.95, 0.99, 0.995)] == [190, 198, 199]
    assert got[0.95][1] > got[0.99][1] > got[0.995][1]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, class long, vector array<double>")


def test_retrieval_by_threshold_or_window(spark):
    q = vector_frame(spark, [(1, 1, [1.0, 0.0])])
    c = vector_frame(spark, [(2, 1, [0.8, 0.6]), (3, 1, [0.7, 0.51**0.5]), (4, 1, [0.0, 1.0])])
    got = similarity.candidates_by_rule(similarity.similarity_pairs(q, c), 0.5, 1).collect()
    assert {r["candidate_id"] for r in got} == {2, 3} and sum(r["by_threshold"] for r in got) == 2
    assert sum(r["by_window"] and not r["by_threshold"] for r in got) == 0


def test_symmetric_merge(spark):
    v = vector_frame(spark, [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0])])
    merged = pairs.merge_directed(similarity.candidates_by_rule(similarity.similarity_pairs(v, v), 0.5, 2)).collect()
    assert len(merged) == 3
    top = next(r for r in merged if (r["a"], r["b"]) == (1, 2))
    assert (top["rank_a_to_b"], top["rank_b_to_a"], top["reasons"]) == (1, 1, "threshold;window")


def test_blocks_agree(spark):
    v = vector_frame(spark, [(k, k % 3, [float((k * 7) % 5), float((k * 3) % 4), 1.0]) for k in range(40)])
    whole = {tuple(r) for r in similarity.ranked(similarity.similarity_pairs(v, v), 4).collect()}
    assert {tuple(r) for r in similarity.ranked(similarity.similarity_pairs(v, v, top=4, block=7), 4).collect()} == whole


def test_two_level_statistics(spark):
    seeds = {6: (0.90, 0.94), 7: (0.96, 1.0), 9: (0.98, 1.0)}
    m = spark.createDataFrame([("a", s, k, v) for s, vs in seeds.items() for k, v in zip((101, 202), vs)], "model string, split int, seed int, pc double")
    r = runs.two_level(m, ["model"], "split", "pc").first()
    assert (r["mean"], r["sd"], r["splits"], r["runs"]) == (round((0.92 + 0.98 + 0.99) / 3, 6), 0.037859, 3, 6)
    one = runs.two_level(m.where("split = 6"), ["model"], "split", "pc").first()
    assert one["sd"] == 0.0


def test_funnel(spark):
    steps = [("pc", True, 0.005), ("rr", True, 0.01), ("epoch", False, 0)]
    frame = lambda rows: spark.createDataFrame(rows, "pc double, rr double, epoch int")
    assert [r["epoch"] for r in runs.funnel(frame([(0.90, 0.9, 1), (0.91, 0.1, 2)]), steps, "epoch").collect()] == [2]
    assert [r["epoch"] for r in runs.funnel(frame([(0.910000, 0.20, 1), (0.909995, 0.40, 2)]), steps, "epoch").collect()] == [2]
    assert [r["epoch"] for r in runs.funnel(frame([(0.9, 0.50, 3), (0.9, 0.505, 1)]), steps, "epoch").collect()] == [1]


def test_clusters_conflicts_and_cover(spark):
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    members = graph.clusters(nodes, links)
    assert {(r["id"], r["component"]) for r in members.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert graph.conflicts(spark.createDataFrame([(1, 3)], "a long, b long"), members).count() == 1
    cover = graph.vertex_cover(links)
    assert [(r["id"], r["cover_size"]) for r in cover.collect()] == [(2, 1)]
    assert graph.witnesses(cover, links).first()["witness"] == 1
    assert graph.unknown_ends(nodes, spark.createDataFrame([(1, 9)], "a long, b long")).first()["id"] == 9


@pytest.mark.parametrize("seed", range(8))
def test_matching_is_as_large_as_the_cover(seed):
    rng = random.Random(seed)
    edges = [(a, 100 + b) for a in range(9) for b in range(12) if rng.random() < 0.1 + 0.06 * seed]
    assert graph._matching(edges) == len(graph._cover(edges))


def test_matching_by_component(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (5, 20), (6, 20), (7, 20)], "a long, b long")
    assert {(r["component"], r["matching_size"]) for r in graph.matching_sizes(links).collect()} == {(1, 2), (5, 1)}


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(200, 100), (100, 150), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(links).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in (100, 150, 200))
    assert graph.components(links.where("a < 0")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_cover_is_minimum(seed):
    import itertools
    import random

    rnd = random.Random(seed)
    edges = sorted({tuple(sorted(rnd.sample(range(9), 2))) for _ in range(14)})
    nodes = sorted({x for e in edges for x in e})
    least = next(n for n in range(len(nodes) + 1) if any(all(a in s or b in s for a, b in edges) for s in map(set, itertools.combinations(nodes, n))))
    cover = graph._cover(edges)
    assert len(cover) == least and all(a in cover or b in cover for a, b in edges)


def test_decisions_replay(spark):
    log = spark.createDataFrame([(1, 1, "accepted"), (1, 2, "pending"), (2, 1, "rejected")], "pair long, seq int, decision string")
    last = pairs.latest_decisions(log, ["pair"], ["seq"])
    got = pairs.decided(spark.createDataFrame([(1,), (2,), (3,)], "pair long"), last.select("pair", "decision"), ["pair"])
    assert {(r["pair"], r["decision"]) for r in got.collect()} == {(1, "pending"), (2, "rejected"), (3, "pending")}


def test_conformal_needs_enough_classes(spark):
    losses = spark.createDataFrame([(c, k, max(0.0, 1 - k / 10)) for c in range(10) for k in (5, 10)], "query_class long, k int, loss double")
    got = {r["alpha"]: (r["k"], r["classes_needed"]) for r in certify.conformal_points(losses, [0.05, 0.25]).collect()}
    assert got == {0.05: (None, 19), 0.25: (10, 3)}


def test_identifiers(spark):
    import hashlib

    row = spark.createDataFrame([("b", "2", "a", "1")], "x string, xs string, y string, ys string")
    got = row.select(strings.pair_id(F.col("x"), F.col("xs"), F.col("y"), F.col("ys")).alias("p"), strings.hash_bucket(F.col("x"), 1000).alias("b"), strings.normalised_text(F.lit("The Éclair, of Zoë!")).alias("n")).first()
    assert got["p"] == hashlib.sha256(b"a\x001\x00b\x002").hexdigest()
    assert got["b"] == int.from_bytes(hashlib.sha256(b"b").digest()[:8], "big") % 1000
    assert got["n"] == "eclair zoe"
    with pytest.raises(Exception, match="two different ids"):
        row.select(strings.pair_id(F.col("x"), F.col("xs"), F.col("x"), F.col("xs"))).collect()


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([1.0, 0.0],)], "v array<double>")
    assert [r["u"] for r in v.select(vectors.normalised(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [1.0, 0.0]]
    assert vectors.vector_report(v, "v", 2).first().asDict() == {"n": 2, "wrong_size": 0, "not_finite": 0, "not_unit": 1}


def test_token_blocking(spark):
    left = spark.createDataFrame([(1, "golden river bank"), (2, "old mill")], "id long, norm string")
    right = spark.createDataFrame([(7, "golden river"), (8, "old mill"), (9, "mills of old")], "id long, norm string")
    assert [(r["a"], r["b"]) for r in blocking.token_pairs(left, right).collect()] == [(1, 7)]
    assert [(r["a"], r["b"]) for r in blocking.title_pairs(left, right).collect()] == [(2, 8)]
    assert {(r["a"], r["b"], r["exact"]) for r in blocking.best_titles(left, right).collect()} == {(1, 7, False), (2, 8, True)}


def test_divided_classes():
    parts = splits.divide_classes(range(10), {"train": 0.7, "val": 0.15, "test": 0.15}, 3)
    assert sorted(x for p in parts.values() for x in p) == list(range(10)) and all(parts.values())
    assert parts == splits.divide_classes(list(range(10))[::-1], {"train": 0.7, "val": 0.15, "test": 0.15}, 3)
    with pytest.raises(ValueError):
        splits.divide_classes(range(3), {"a": 0.5}, 1)


def test_copy_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("COPY a (x) FROM stdin;\n9\n\\.\nCOPY t (x, y) FROM stdin;\n1\tone\\ttab\n2\t\\N\n\\.\nrest\n")
    got = manifests.read_copy_dump(spark, str(tmp_path / "d.sql"), "t", ["x", "y"]).orderBy("x").collect()
    assert [tuple(r) for r in got] == [("1", "one\ttab"), ("2", None)]


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 'x "y", z'), ("b", 3, "")], "id string, w int, note string")
    manifests.write_manifest(rows, str(tmp_path / "m"), ["id", "w", "note"])
    got = manifests.typed(manifests.read_manifest(spark, str(tmp_path / "m"), ["id", "w", "note"]), {"w": "int"})
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, 'x "y", z'), ("b", 3, "")]


def test_range_plan(spark):
    ids = spark.createDataFrame([(k,) for k in [*range(0, 30), 1000, 5000]], "id long")
    plan = manifests.range_plan(ids, "id", 10)
    assert all(n <= 10 for *_, n in plan) and sum(n for *_, n in plan) == 32


def test_files_and_split_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.JPG").write_bytes(b"1")
    (tmp_path / "in" / "b.jpg").write_bytes(b"22")
    (tmp_path / "c.txt").write_bytes(b"3")
    assert sorted(r["size"] for r in manifests.scan_files(spark, str(tmp_path), ["jpg"]).collect()) == [1, 2]
    text = '{"schema_version": 2, "subsets": {"train": {"roles": {"modern": ["m1"], "historic": ["h1"]}}}, "images": {"m1": {"class_id": 1}, "h1": {"class_id": 1}}}'
    got = manifests.read_split(spark, text)
    assert [r["file_id"] for r in manifests.select_files(got, ["*"], ["modern"]).collect()] == ["m1"]
    with pytest.raises(ValueError):
        manifests.read_split(spark, text.replace('"images": {"m1"', '"images": {"m2"'))


def test_run_documents(spark, tmp_path):
    for m in "ab":
        (tmp_path / m).mkdir()
        (tmp_path / m / "eval.json").write_text('{"model": "%s", "tasks": [{"task": "t", "top_k": [{"k": 1, "pair_completeness": 0.5}], "thresholds": [], "targets": [{"target": 0.9, "pair_completeness": 0.91}]}]}' % m)
    got = manifests.flatten_runs(spark, str(tmp_path)).select("model", "mode", "key", "value").collect()
    assert sorted(tuple(r) for r in got) == [(m, mode, k, v) for m in "ab" for mode, k, v in (("targets", 0.9, 0.91), ("top_k", 1.0, 0.5))]


def test_completed_runs(spark, tmp_path):
    text = '{"model": "m", "tasks": [{"task": "t", %s}]}' % ", ".join('"%s": [{"%s": 1, "pair_completeness": 0.5}]' % x for x in (("top_k", "k"), ("thresholds", "threshold"), ("targets", "target"), ("threshold_floors", "threshold"), ("calibrated_top_k", "k")))
    for run, status in (("one", "completed"), ("two", "running"), ("three", None)):
        storage.write_texts(spark, {f"{tmp_path}/in/{run}/models/m/eval.json": text} | ({f"{tmp_path}/in/{run}/run.json": '{"status": "%s"}' % status} if status else {}))
    storage.write_texts(spark, {f"{tmp_path}/in/one/eval.json": text})
    got = sorted((r["run"], r["mode"], r["key"], r["value"]) for r in manifests.completed_runs(spark, f"{tmp_path}/in").collect())
    assert got == [("one", mode, 1.0, 0.5) for mode in ("calibrated_top_k", "targets", "threshold_floors", "thresholds", "top_k")]


def test_paged_scan_drops_repeats(spark):
    def fetch(page: int) -> list[dict]:
        return [{"objectid": page * 2 + k, "title": f"p{page}"} for k in range(3)]

    got = manifests.paged_scan(spark, fetch, 3, "objectid long, title string", "objectid").orderBy("objectid").collect()
    assert [(r["objectid"], r["title"]) for r in got] == [(0, "p0"), (1, "p0"), (2, "p0"), (3, "p1"), (4, "p1"), (5, "p2"), (6, "p2")]


def test_cover_out_of_time_is_not_proven():
    rnd = random.Random(1)
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60) if rnd.random() < 0.3]
    cover, proven = graph._cover_within(edges, 0.0)
    assert not proven and all(a in cover or b in cover for a, b in edges)
    assert graph._cover_within(edges[:20], 60)[1]


def test_numbers_of_a_total_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = ordering.numbered(rows, [F.desc("x")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(5000)) and [r["x"] for r in got] == sorted((r["x"] for r in got), reverse=True)
    assert ordering.numbered(rows.limit(0), [F.col("x")]).count() == 0


def test_source_of_two_models_is_an_error(spark):
    models = spark.createDataFrame([("m", ["a"]), ("n", ["b"])], "model_id string, aliases array<string>")
    source = lambda *names: spark.createDataFrame([(1, list(names), "own")], "key int, identities array<string>, fallback string")
    assert [lookups.model_of_source(source(*x), models).first()["model_id"] for x in (("a",), ("b", "b"), ("c",))] == ["m", "n", "own"]
    with pytest.raises(Exception, match="several models"):
        lookups.model_of_source(source("a", "b"), models).collect()


def test_stems_step_over_taken_numbers(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x_002"), (4, "x"), (5, "x_004"), (6, "x"), (7, "y"), (8, "y")], "id long, name string")
    got = {r["id"]: r["unique_name"] for r in lookups.unique_stems(rows).collect()}
    assert got == {1: "x", 2: "x_003", 3: "x_002", 4: "x_005", 5: "x_004", 6: "x_006", 7: "y", 8: "y_002"}


def test_verdicts(spark):
    cases = [
        ("view of the old harbour", "view of the old harbour", "rembrandt", "vermeer", 1.0, True, "obvious_false_positive"),
        ("view of the old harbour", "view of the old harbour", "rembrandt", "rembrandt van rijn", 1.0, True, "likely"),
        ("landscape", "landscape", "rembrandt", "rembrandt", 1.0, True, "uncertain"),
        ("view of the old harbour", "view of the harbour", "rembrandt", "rembrandt", 0.8, False, "uncertain"),
        ("view of the old harbour", "view of the old harbour", "unknown master", "painter", 1.0, True, "uncertain"),
    ]
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string, x string, y string, s double, e boolean, want string")
    norm = lambda c: strings.normalised_text(F.col(c), strings.GERMAN_STOP_WORDS, ascii_only=True)
    got = d.select("want", strings.match_verdict(norm("a"), norm("b"), norm("x"), norm("y"), F.col("s"), F.col("e")).alias("v")).collect()
    assert [r["v"] for r in got] == [r["want"] for r in got]


def test_blockwise_reductions_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 32)
    rnd = random.Random(5)
    rows = []
    for k in range(90):
        v = [rnd.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3)]  # many equal scores
        n = sum(x * x for x in v) ** 0.5
        rows.append((k, k % 7, [x / n for x in v]))
    v = spark.createDataFrame(rows, "id long, class long, vector array<double>")
    pairs_ = similarity.similarity_pairs(v, v).cache()
    counts = metrics.class_counts(v, v)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(metrics.rank_view(similarity.ranked(pairs_)), similarity.true_ranks(v, v))
    for t in ([0.0, 0.5, 0.9],):
        assert same(metrics.threshold_metrics(pairs_, counts, t), metrics.threshold_metrics(similarity.score_counts(v, v, t), counts, t))
    assert same(metrics.score_histogram(pairs_), metrics.score_histogram(similarity.score_bins(v, v, metrics.histogram_bin(80))))
    assert same(metrics.quantiles_by_bins(pairs_, [0.0, 0.3, 1.0]), metrics.quantiles_by_bins(similarity.score_bins(v, v, metrics.quantile_bin()), [0.0, 0.3, 1.0]))
    targets = [0.01, 0.5, 0.9, 1.0, 1.5]
    points = calibrate.target_operating_points(pairs_, counts, targets)
    assert same(points, calibrate.joined_operating_points(v, v, targets))
    assert same(calibrate.transferred(points, pairs_, counts), calibrate.joined_transferred(points, v, v))
    assert same(similarity.hard_negatives(pairs_, 4), similarity.nearest_negatives(v, v, 4))
    assert same(similarity.guarded_negatives(pairs_, 4), similarity.nearest_negatives(v, v, 4, guarded=True))
