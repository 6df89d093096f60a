"""The models and fingerprints against plain versions that share none of their code but the hashes."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from test_llm import docs, none, rows  # noqa: F401  fixtures

from pairloom.llm import imatch, importance, mixing, shingles, toxicity


def test_log_ratio_by_hand(spark, docs, rows):  # noqa: F811
    good = [t for i, t in rows if t and i % 6 == 2]
    got = {r["doc_id"]: r for r in importance.resample(docs, spark.createDataFrame([(t,) for t in good], "text string"), share=1.0).collect()}
    known: dict = {}

    def grams(t):
        words = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
        for w in words:
            if w not in known:
                known[w] = int(shingles.words(pa.array([w]))[0][0])
        one = [known[w] for w in words]
        two = [int(shingles.mix(shingles.mix(np.array([a], np.uint64)) + np.array([b], np.uint64))[0]) for a, b in zip(one, one[1:])]
        return [h % importance.BUCKETS for h in one + two]

    target, raw = Counter(), Counter()
    for t in good:
        target.update(grams(t))
    own = {i: grams(t) for i, t in rows}
    for g in own.values():
        raw.update(g)
    a, b = sum(target.values()) + importance.BUCKETS, sum(raw.values()) + importance.BUCKETS
    for i, g in own.items():
        want = sum(math.log((target[h] + 1) / a) - math.log((raw[h] + 1) / b) for h in g)
        assert got[i]["n_grams"] == len(g) and math.isclose(got[i]["log_ratio"], want, abs_tol=1e-6), i


def plain_prints(texts: list[str], spark) -> list[set]:
    """Entries (family, slot, sorted terms) of texts by the definition of imatch: the band is that of the first half, the
    documents; the second half are the edited texts."""
    n = len(texts) // 2
    terms = [sorted(set(regex.findall(r"[\p{L}\p{N}]+", t.lower()))) for t in texts]
    every = sorted({w for ws in terms for w in ws})
    hashed = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    df = Counter(w for ws in terms[:n] for w in ws)
    band = {w for w, k in df.items() if k >= 2 and max(2, imatch.LEAST * n) <= k <= max(2, imatch.MOST * n)}
    out = []
    for t, ws in zip(texts, terms):
        c = 2 + sum(len(ws) >= least for least in imatch.CLASSES)
        groups: dict = {}
        for w in ws:
            h = hashed[w]
            for family in (c, c + 1):
                if w in band and h % 8**family < imatch.SLOTS:
                    groups.setdefault((family, h % imatch.SLOTS), []).append(h)
        out.append({(f, s, tuple(sorted(hs))) for (f, s), hs in groups.items()} or {("whole", t.lower())})
    return out


def likeness(a: set, b: set) -> float:
    best = (0, 0.0)
    for family in {e[0] for e in a} & {e[0] for e in b}:
        x, y = {e for e in a if e[0] == family}, {e for e in b if e[0] == family}
        either = len({e[1] for e in x} | {e[1] for e in y})
        best = max(best, (either, len(x & y) / either))
    return best[1]


def test_fingerprints_by_hand(spark, docs, rows):  # noqa: F811
    texts = [t or "" for _, t in rows]
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4] for k, t in enumerate(texts)]
    prints = plain_prints(texts + edited, spark)
    own, changed = prints[: len(texts)], prints[len(texts) :]
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(docs).collect()}
    names: dict = {}
    for k, (i, _) in enumerate(rows):
        assert math.isclose(got[i]["near_edited"], likeness(own[k], changed[k]), abs_tol=1e-9), i
        assert math.isclose(got[i]["near_next"], likeness(own[k], own[(k + 1) % len(own)]), abs_tol=1e-9), i
        for name, entries in ((got[i]["fingerprint"], own[k]), (got[i]["edited_fingerprint"], changed[k])):
            assert names.setdefault(name, frozenset(entries)) == frozenset(entries) and len(name.split(".")) == len(entries)
    assert len(set(names.values())) == len(names)


def test_rates_solve_the_dual(spark):
    """Tilts by distributed Newton steps against a bisection of each source's own equation."""
    rnd = np.random.default_rng(3)
    sizes = [(f"s{s}", int(x)) for s, scale in (("a", 40), ("b", 400), ("c", 5)) for x in rnd.integers(1, scale, 300)]
    cells = spark.createDataFrame(sizes, "source_key string, size long").groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"))
    share = {"sa": 1.7, "sb": 0.4, "sc": 1.0}
    total = Counter()
    for s, x in sizes:
        total[s] += x
    targets = spark.createDataFrame([(s, total[s], total[s] * share[s]) for s in share], "source_key string, source_size long, target double")
    got = {r["source_key"]: r["tilt"] for r in mixing.solve_tilts(cells, targets).collect()}
    for s in share:
        x = np.array([v for k, v in sizes if k == s], float)
        given = lambda t: float((x * np.minimum(mixing.MOST, np.exp(np.minimum(t * x, 1.0)))).sum())  # noqa: B023, E731
        low, high = -60.0, math.log(mixing.MOST) + 1e-3
        for _ in range(200):
            low, high = ((low + high) / 2, high) if given((low + high) / 2) < total[s] * share[s] else (low, (low + high) / 2)
        assert math.isclose(given(got[s]), total[s] * share[s], rel_tol=1e-3), (s, got[s], low)


def test_toxic_features_by_hand():
    words = toxicity.Words(toxicity.Lexicon({"vrok": 3.0, "blar*": 2.0}))
    texts = ["You VROK! you v.r.o.k, you BLARG blargest?", "", "quiet day 12 at sea", "m0r0n" * 1]
    x = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(texts), words).T.tolist()))
    assert x["log_words"] == [math.log1p(n) for n in (7, 0, 5, 1)]
    assert x["learned"][0] >= 3 and x["learned"][1:] == [0, 0, 0] and x["learned_most"][0] == 3.0
    assert x["seed"][3] == 1 and x["second_share"][0] == 3 / 7 and x["near"][0] >= 3 and x["near"][2] == 0
    assert x["exclaimed"][0] == 1 / 7 and x["asked"][0] == 1 / 7 and x["digits"][2] == 2 / 5
    assert x["obfuscated"][0] == 1 / 7 and x["obfuscated"][3] == 1.0
