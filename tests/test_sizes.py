"""What larger tables bring: ids of two kinds that meet, numbers of four digits, large groups."""

from comparing import same_rows

from pairloom.plans import catalog

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"


def tables(spark, folder, small, **own):
    """The tables of a test folder, with ``own`` (rows, schema) in place of some."""
    import os

    from comparing import TABLES

    for t in TABLES:
        if t in own:
            spark.createDataFrame(*own[t]).coalesce(1).write.parquet(f"{folder}/rows-{t}")
            part = next(f for f in os.listdir(f"{folder}/rows-{t}") if f.endswith(".parquet"))
            os.link(f"{folder}/rows-{t}/{part}", f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{small}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def agrees(spark, folder, name):
    same_rows(spark, folder, catalog.QUERIES[name], catalog.ORACLES[name])


def meeting(spark, tmp_path, small):
    """Parts whose ids are those of suppliers a million on."""
    parts = [(k, f"part {k}", "b", "t", 1, 1.0) for k in (1, 1000001, 1000002)]
    suppliers = [(k, f"supplier {k}", 0, 0.0) for k in (1, 2)]
    lines = [(1, p, s, 1, 5.0, 0.0, "R", "F") for p in (1, 1000001, 1000002) for s in (1, 2)]
    return tables(spark, tmp_path, small, part=(parts, PART), supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), lineitem=(lines, LINE))


def test_review_queue_of_two_kinds_of_ids(spark, tmp_path, small):
    agrees(spark, meeting(spark, tmp_path, small), "review_queue")


def close_vectors(spark):
    """Ninety vectors with many equal scores."""
    import random

    rnd, rows = random.Random(7), []
    for k in range(90):
        v = [rnd.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((k, k % 7, [x / n for x in v]))
    return spark.createDataFrame(rows, "id long, class long, vector array<double>")


def test_counts_in_the_task_are_those_of_all_pairs(spark, monkeypatch):
    from pairloom.operators import certify, metrics, pairs, similarity

    monkeypatch.setattr(similarity, "BLOCK", 32)
    monkeypatch.setattr(similarity, "RANK_BINS", 8)
    v = close_vectors(spark)
    every = similarity.similarity_pairs(v, v).cache()
    ranked, counts = similarity.ranked(every).cache(), metrics.class_counts(v, v)
    view = metrics.rank_view(ranked).cache()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    top = similarity.top_counts(v, v, [3, 50]).cache()
    assert same(metrics.top_k_metrics(ranked, counts, [3, 50]), metrics.top_k_metrics(top, counts, [3, 50]))
    assert same(metrics.identity_completeness(view, [3, 50]), metrics.identity_completeness(top, [3, 50]))
    assert same(certify.class_losses(view, [3, 50]), certify.class_losses(top, [3, 50]))
    assert same(certify.without_largest(view, 3), certify.without_largest(similarity.top_counts(v, v, [3]), 3))
    assert same(metrics.misses(view, 3, 5), metrics.misses(similarity.top_counts(v, v, [3]), 3, 5))
    assert same(metrics.smallest_k(view, [0.0, 0.1, 0.5, 0.9, 1.0, 1.5]), metrics.joined_smallest_k(v, v, [0.0, 0.1, 0.5, 0.9, 1.0, 1.5]))
    assert same(metrics.threshold_metrics(every, counts, [0.5, 0.99], floor=4), metrics.threshold_metrics(similarity.score_counts(v, v, [0.5, 0.99], floor=4), counts, [0.5, 0.99], floor=4))
    rule = similarity.candidates_by_rule(every, 0.98, 3)
    assert same(rule, similarity.candidates_by_rule(similarity.by_rule(v, v, 0.98, 3), 0.98, 3))
    assert same(metrics.retrieval_summary(rule), metrics.retrieval_summary(similarity.rule_counts(v, v, 0.98, 3)))
    assert similarity.reaching(v, v, 0.98).first()["n"] == pairs.merge_directed(rule).where("reasons like '%threshold%'").count()
    assert same(similarity.neighbours(every, 0.9999, 5, 0.9), similarity.neighbours(similarity.nearest(v, v, 5, least=0.9), 0.9999, 5, 0.9))


def test_no_row_is_sent_for_each_block(spark, monkeypatch):
    from pairloom.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", 32)
    v = close_vectors(spark)
    for rows in (similarity.top_counts(v, v, [3]), similarity.score_counts(v, v, [0.5]), similarity.nearest_negatives(v, v, 3)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapGroups" not in plan


def test_numbers_of_four_digits(spark):
    from pairloom.operators import lookups

    rows = [(k, "x") for k in range(1, 1103)] + [(2000, "x_1000"), (2001, "x_99999999999999999999999")]
    named = lookups.unique_stems(spark.createDataFrame(rows, "id long, name string"))
    got = {r["id"]: r["unique_name"] for r in named.collect()}
    assert len(set(got.values())) == len(rows)
    assert got[1] == "x" and got[2] == "x_002" and got[999] == "x_999" and got[1000] == "x_1001" and got[2000] == "x_1000"


def halves(ids, a, b, most):
    inside = [x for x in ids if a <= x < b]
    if not inside:
        return []
    if len(inside) <= most or b - a <= 1:
        return [(a, b, len(inside))]
    return halves(inside, a, (a + b) // 2, most) + halves(inside, (a + b) // 2, b, most)


def test_ranges_of_uneven_ids(spark, monkeypatch):
    import random

    from pairloom.sources import manifests

    rnd = random.Random(3)
    ids = sorted({rnd.randrange(-(10**5), 10**5) for _ in range(500)} | {10**12 + k for k in range(300)}) + [7] * 40
    frame = spark.createDataFrame([(x,) for x in ids], "id long")
    for halvings in (7, 14):
        monkeypatch.setattr(manifests, "HALVINGS", halvings)
        assert manifests.range_plan(frame, "id", 25) == halves(ids, min(ids), max(ids) + 1, 25)
    plan = halves(ids, min(ids), max(ids) + 1, 25)
    low = {x: next(a for a, b, _ in plan if a <= x < b) for x in ids}
    assert {r["id"]: r["low"] for r in frame.withColumn("low", manifests.range_of(frame["id"], plan)).collect()} == low


def test_stream_gives_rows_by_a_table(spark, small):
    """No sink in the driver's memory."""
    from pairloom.streaming import events

    got = events.run_to_end(events.sessions(events.stream_of(spark, small, "events.parquet"), "30 minutes"), "complete")
    assert "FileScan" in got._jdf.queryExecution().executedPlan().toString().replace("Scan parquet", "FileScan")
    assert got.count() > 0


def test_boxes_by_few_partners(spark, monkeypatch):
    import random

    from pairloom.operators import protocol

    monkeypatch.setattr(protocol, "NEXT", 2)
    for seed, (found, true) in enumerate(((60, 15), (15, 60), (40, 40))):
        rnd, rows = random.Random(seed), []
        for side, n in ((True, found), (False, true)):
            rows += [(1, side, k, float(x), float(y), x + 4.0, y + 3.0) for k in range(n) for x, y in [(rnd.randrange(6), rnd.randrange(3))]]
        rows += [(1, True, 3, 1.0, 1.0, 5.0, 4.0)]  # an id twice
        scored = sorted((-i / (f_ + t_ - i), f[2], t[2]) for f in rows if f[1] for t in rows if not t[1] for i in [max(0.0, min(f[5], t[5]) - max(f[3], t[3])) * max(0.0, min(f[6], t[6]) - max(f[4], t[4]))] for f_, t_ in [((f[5] - f[3]) * (f[6] - f[4]), (t[5] - t[3]) * (t[6] - t[4]))] if i / (f_ + t_ - i) >= 0.2)
        want, fs, ts = set(), set(), set()
        for iou, f, t in scored:
            if f not in fs and t not in ts:
                fs.add(f)
                ts.add(t)
                want.add((f, t, round(-iou, 6)))
        boxes = spark.createDataFrame(rows, "scene long, found boolean, id long, x0 double, y0 double, x1 double, y1 double")
        assert {tuple(r)[1:] for r in protocol.greedy_boxes(boxes, 0.2).collect()} == want


def test_vectors_are_not_shuffled(spark, monkeypatch):
    """Disk: one packed table, and shuffles of sums or of a few numbers a query."""
    from pairloom.operators import metrics, similarity

    monkeypatch.setattr(similarity, "BLOCK", 32)
    v = close_vectors(spark).cache()
    p = v.selectExpr("*", "case id % 3 when 0 then 'a' when 1 then 'b' end as profile")
    made = []
    monkeypatch.setattr(similarity, "written", lambda df, name, *how, own=similarity.written: made.append(own(df, name, *how)) or made[-1])
    frames = similarity.top_counts(v, v, [3]), similarity.nearest_negatives(v, v, 3), similarity.nearest(v, v, 3), similarity.score_bins(v, v, metrics.quantile_bin()), similarity.rule_counts(v, v, 0.9, 3), similarity.reason_counts(v, 0.9, 3), metrics.profile_diagnostics(p, p, ["a", "b"], [3], [0.9])
    assert len(made) == len(frames)
    for rows in frames:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort " not in plan
        assert rows.count() > 0


def test_reasons_and_profiles_are_those_of_all_pairs(spark, monkeypatch):
    from pairloom.operators import metrics, pairs, similarity

    monkeypatch.setattr(similarity, "BLOCK", 32)
    v = close_vectors(spark).cache()
    every = similarity.similarity_pairs(v, v).cache()
    for least in (0.98, 2.0):
        merged = pairs.merge_directed(similarity.candidates_by_rule(every, least, 3))
        want = {r: n for r in ("threshold", "window") if (n := merged.where(f"reasons like '%{r}%'").count())}
        assert {tuple(r) for r in similarity.reason_counts(v, least, 3).collect()} == set(want.items())
    p = v.selectExpr("*", "case id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' end as profile")
    for queries, candidates in ((p, p), (v, p), (v.where("id % 2 = 0"), p.where("id % 5 > 0"))):
        got = {(r["profile"], r["mode"], r["point"]): tuple(r)[3:] for r in metrics.profile_diagnostics(queries, candidates, ["b", "a", "none"], [3, 50], [0.9]).collect()}
        assert {k[0] for k in got} == {"a", "b"} and len(got) == 6
        for name in ("a", "b"):
            own = candidates.where(f"profile = '{name}'").select("id", "class", "vector")
            some, counts = similarity.similarity_pairs(queries.select("id", "class", "vector"), own).cache(), metrics.class_counts(queries.select("id", "class", "vector"), own)
            kept = ["candidate_pairs", "true_positives", "pair_completeness", "pair_quality", "reduction_ratio"]
            for r in metrics.top_k_metrics(similarity.ranked(some), counts, [3, 50]).select("k", *kept).collect():
                assert got[name, "top_k", float(r["k"])] == tuple(r)[1:]
            for r in metrics.threshold_metrics(some, counts, [0.9]).select("threshold", *kept).collect():
                assert got[name, "calibrated_threshold", r["threshold"]] == tuple(r)[1:]


def test_bins_of_many_blocks_in_a_task(spark, monkeypatch):
    from pairloom.operators import metrics, similarity

    v = close_vectors(spark).repartition(5).cache()
    bin_of, got = metrics.histogram_bin(40), []
    for block, queries, most in ((2048, 512, 1 << 14), (8, 4, 24), (16, 8, 64), (64, 16, 32)):
        for name, x in (("BLOCK", block), ("QUERIES", queries), ("SHARED", most)):
            monkeypatch.setattr(similarity, name, x)
        got.append(sorted(map(tuple, similarity.score_bins(v, v, bin_of).collect())))
    assert all(x == got[0] for x in got) and sum(r[1] for r in got[0]) == 90 * 89


def test_packed_vectors_go_when_nothing_reads_them(spark, monkeypatch):
    """Disk: queries of one session don't leave their packed tables."""
    import os
    import time

    from pairloom.operators import similarity
    from pairloom.sources import storage

    monkeypatch.setattr(storage, "WAITING", 0)
    packed, paths = similarity.written, []

    def noted(*args):
        table = packed(*args)
        paths.append(table.written_to.removeprefix("file://"))
        return table

    monkeypatch.setattr(similarity, "written", noted)
    v = close_vectors(spark).cache()
    kept = similarity.nearest_negatives(v, v, 3).where("rank < 3")  # not computed yet
    for _ in range(4):
        assert similarity.nearest_negatives(v, v, 3).count() > 0
    for _ in range(20):
        storage.sweep(spark)
        if not any(map(os.path.exists, paths[1:])):
            break
        time.sleep(0.5)
    assert len(paths) == 5 and [os.path.exists(p) for p in paths] == [True] + [False] * 4
    want = similarity.hard_negatives(similarity.similarity_pairs(v, v), 2)
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.select(*kept.columns).collect()))
