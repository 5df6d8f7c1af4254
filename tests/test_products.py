"""Cleaning, model words, blocking, similarity, clustering and evaluation on worked examples."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from kinsift.functions import text as T
from kinsift.operators import blocking, brands, clustering, components, evaluation, minhash, scoring, settling, similarity, vocabulary
from kinsift.plans import catalog, experiment
from kinsift.sources import products as P
from kinsift.sources import results
from kinsift.streaming import listings


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_cleaning(spark):
    rows = [
        ('29" TV', "29inch tv", "29inch tv"), ("29-inch LED", "29inch led", "29inch led"), ("60 Hertz", "60hz", "60hz"), ("60.5 Hz", "60.5hz", "60 5hz"),
        ('18-3/8"', "18-3/8inch", "1838inch"), ("2 in 1", "2inch 1", "2inch 1"), ("refresh hz", "refreshhz", "refresh hz"), ("(60hz)", "(60hz )", "60hz"),
        (None, "none", "none"), ('LG 47" 1080p/120Hz', "lg 47inch 1080p/120hz", "lg 47inch 1080p120hz"), ("White-Westinghouse", "white-westinghouse", "whitewestinghouse"), ("", "", ""),
    ]
    raw = [r[0] for r in rows]
    assert column(spark, raw, T.clean_basic) == [r[1] for r in rows]
    assert column(spark, raw, T.clean_unified) == [r[2] for r in rows]


def test_model_words(spark):
    assert column(spark, ["29inch", "1920x1080", "1.2.3", "12.5kg", "3 year", None], T.value_word) == ["29", "1080", "2.3", "12.5", None, None]
    assert column(spark, ["lg 29ln450b 1080p led-lcd hdtv 1.5 60hz,3d"], T.title_words)[0] == ["29ln450b", "1080p", "1.5", "60hz", "3d"]


@pytest.mark.parametrize(("a", "b", "dice", "jaccard"), [("abc", "abd", 0.4, 0.25), ("", "", 1, 1), ("Screen Size", "Screen Size Class", 0.6875, 0.5238), ("Refresh Rate", "Refresh Rate:", 0.8276, 0.7059), ("Brand", "brand", 0.5714, 0.4)])
def test_qgrams(spark, a, b, dice, jaccard):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(T.dice(T.qgrams(F.col("a")), T.qgrams(F.col("b"))), T.jaccard(T.qgrams(F.col("a")), T.qgrams(F.col("b")))).first()
    assert (round(r[0], 4), round(r[1], 4)) == (dice, jaccard)


def test_json_source(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"b": [{"title": "x", "shop": "s", "modelID": "m", "featuresMap": {"k": "1"}}, {"title": "y", "shop": "t", "modelID": "m", "featuresMap": {}}], "a": [{"title": "z", "shop": "s", "modelID": "n", "featuresMap": None}]}))
    rows = P.read_products(spark, str(path)).orderBy("product_idx").collect()
    assert [(r.product_idx, r.title) for r in rows] == [(0, "x"), (1, "y"), (2, "z")]
    assert rows[0].features == {"k": "1"}


def test_word_index_is_dense_and_sorted(spark):
    words = ["b1", "a2", "é3", "a1", "z9", "10x", "b1"]
    got = {r.word: r.word_idx for r in vocabulary.word_index(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def test_minhash_against_python(spark):
    rows = [(0, 0), (0, 3), (1, 3), (2, 7), (2, 1)]
    p, pairs = minhash.parameters(70)
    for k in (5, 70):
        p, pairs = minhash.parameters(k)
        got = {r.product_idx: r.sig for r in minhash.signatures(spark.createDataFrame(rows, "product_idx long, word_idx long"), k).collect()}
        for i in (0, 1, 2):
            assert got[i] == [min((a + b * x) % p for j, x in rows if j == i) for a, b in pairs]


def test_band_configs_and_candidates(spark):
    got = {(r.r, r.b) for r in blocking.band_configs(spark, 10).collect()}
    assert got == {(1, 10), (2, 5), (3, 4), (4, 3), (5, 2), (6, 2), (10, 1)}
    sigs = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 2, 4]), (2, [9, 9, 3]), (3, [1, 2, 3])], "product_idx long, sig array<long>")
    for key in ("exact", "float64"):
        found = {tuple(r) for r in blocking.candidates(blocking.bands(sigs, 2, key)).collect()}
        assert found == {(0, 1), (0, 3), (1, 3), (0, 2), (2, 3)}


def test_brands(spark):
    assert column(spark, ["premium connector", "lg tv", ""], brands.brand_substring) == ["emi", "lg", None]
    assert column(spark, ["premium connector", "LG tv sony", ""], brands.brand_whole_word) == [None, "lg", None]


def make(spark, rows):
    p = spark.createDataFrame([(i, f"m{i}", shop, title) for i, shop, title, _ in rows], "product_idx long, model_id string, shop string, title string")
    f = spark.createDataFrame([(i, k, v) for i, _, _, m in rows for k, v in m.items()] or [], "product_idx long, key string, value string")
    return p, f


def test_pair_similarity(spark):
    p, f = make(spark, [(0, "a", "sony 46inch", {"Size": "46inch", "Brand": "sony"}), (1, "b", "sony 42inch", {"Size": "42inch", "Brand": "sony"}), (2, "c", "a b c", {}), (3, "d", "a b c", {})])
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "i long, j long")
    for variant in ("exact", "fast"):
        got = {(r.i, r.j): r for r in similarity.pair_similarity(pairs, p, f, variant=variant).collect()}
        assert got[0, 1].tmwm == -1 and got[0, 1].m == 2 and 0.5 < got[0, 1].similarity < 1
        assert got[2, 3].tmwm == 1 and abs(got[2, 3].similarity - 0.65) < 1e-6


def test_constrained_linkage():
    edges = {(0, 1): 0.10, (1, 2): 0.20, (2, 3): 0.25}
    assert clustering.agglomerate([0, 1, 2, 3], edges, 0.3) == {0: 0, 1: 0, 2: 2, 3: 2}
    assert clustering.agglomerate([0, 1], {(0, 1): 0.3}, 0.3) == {0: 0, 1: 0}
    assert clustering.agglomerate([0, 1, 2], {(0, 1): 0.1, (1, 2): 0.1}, 0.3) == {0: 0, 1: 0, 2: 2}


def test_agglomerate_against_full_scans():
    import itertools
    import math
    import random

    def slow(n, edges, eps):
        dist = lambda a, b: max(ds) if math.inf in (ds := [edges.get((min(i, j), max(i, j)), math.inf) for i in a for j in b]) else min(ds)
        groups = [{i} for i in range(n)]
        while True:
            best = min(((dist(groups[i], groups[j]), i, j) for i, j in itertools.combinations(range(len(groups)), 2)), default=(math.inf, 0, 0))
            if best[0] > eps:
                return {x: min(g) for g in groups for x in g}
            _, i, j = best
            g = groups[i] | groups[j]
            groups = [x for k, x in enumerate(groups) if k not in (i, j)] + [g]

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(2, 8)
        edges = {e: rng.choice([0.1, 0.2, 0.3, 0.6]) for e in itertools.combinations(range(n), 2) if rng.random() < 0.6}
        assert clustering.agglomerate(list(range(n)), edges, 0.3) == slow(n, edges, 0.3)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)] + [(7, 7)]
    got = {r.node: r.least for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_keep_singletons(spark):
    p = spark.createDataFrame([(i,) for i in range(4)], "product_idx long")
    edges = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.9)], "i long, j long, dissim double")
    assert {r.product_idx: r.cluster_id for r in clustering.clusters(p, edges, 0.5).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_metrics_and_curves(spark):
    p = spark.createDataFrame([(i, "m") for i in range(4)], "product_idx long, model_id string")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "i long, j long")
    r = evaluation.pair_metrics(pairs, evaluation.true_pairs(p), p).first()
    assert (r.comparisons, r.found, r.total, r.n) == (2, 2, 6, 4)
    assert (r.pq, round(r.pc, 4), r.f1, round(r.foc, 4)) == (1.0, 0.3333, 0.5, 0.3333)
    none = evaluation.pair_metrics(pairs.limit(0), pairs.limit(0), p).first()
    assert (none.pq, none.pc, none.f1) == (None, None, 0.0)
    curve = lambda pts: spark.createDataFrame([(k, *q) for k, q in enumerate(pts)], "r int, foc_lsh double, pc_lsh double")
    auc = lambda a, b: tuple(round(x, 6) for x in evaluation.fair_auc(curve(a), curve(b)).first())
    whole = [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]
    assert auc(whole, whole) == (0.75, 0.75)
    assert auc(whole, [(0.0, 0.0), (0.5, 0.5)]) == (0.25, 0.125)


def test_bootstrap(spark):
    p = spark.createDataFrame([(i * 7,) for i in range(50)], "product_idx long")
    rows = evaluation.bootstrap_samples(p, 2).collect()
    for b in (0, 1):
        train = [r.product_idx for r in rows if r.bootstrap == b and r.split == "train"]
        test = [r.product_idx for r in rows if r.bootstrap == b and r.split == "test"]
        assert len(train) == 50 and set(test) == {i * 7 for i in range(50)} - set(train) and len(test) == len(set(test))


def test_experiment_resumes(spark, tmp_path):
    rows = []
    for m in range(6):
        for shop in "abc":
            rows.append((m * 3 + "abc".index(shop), shop, f"brand{m} {20 + m}inch model{m}x", {"Size": f"{20 + m}inch"}))
    p, f = make(spark, rows)
    p = p.withColumn("model_id", F.floor(F.col("product_idx") / 3).cast("string"))
    words = vocabulary.basic_words(p, f)
    path = str(tmp_path / "r")
    done = [(0, r, b, 0.5, 1, 1, 1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1) for r, b in ((1, 4), (2, 2), (3, 2))]
    results.write_results(spark.createDataFrame(done, results.RESULTS), path)
    got = experiment.run(p, f, words, path, 4, n_bootstraps=1).collect()
    assert {(r.r, r.b) for r in got} == {(1, 4), (2, 2), (3, 2), (4, 1)}
    new = next(r for r in got if r.r == 4)
    assert new.duplicates_found_lsh >= new.duplicates_found_msm >= 0
    assert evaluation.summarize(results.read_results(spark, path)).count() == 4


def test_large_buckets_in_blocks(spark):
    rng = random.Random(5)
    rows = [(k, band, str(rng.randrange(3))) for k in range(60) for band in range(2)]
    banded = spark.createDataFrame(rows, "product_idx long, band_id int, band_key string")
    key = {(k, band): x for k, band, x in rows}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if any(key[i, b] == key[j, b] for b in range(2))}
    for block in (blocking.BLOCK, 3, 1):
        got = [tuple(r) for r in blocking.candidates(banded, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_groups_of_several_files(spark):
    one = lambda t: {"title": t, "shop": "s", "modelID": "m"}
    rows = [(2, {"g": [one("d")], "h": None}), (0, {"g": [one("a"), one("b")], "e": [], "h": [one("c")]}), (1, None), (3, {})]
    df = spark.createDataFrame([(f, json.dumps(g) if g is not None else None) for f, g in rows], "f int, j string").select("f", F.from_json("j", f"map<string,array<{P.ITEM}>>").alias("groups"))
    got = P.flatten_groups(df, "f").collect()
    assert [(r.product_idx, r.title, r.group_key) for r in sorted(got)] == [(0, "a", "g"), (1, "b", "g"), (2, "c", "h"), (3, "d", "g")]


def test_both_pipelines(spark, tmp_path):
    rows = [(m * 2 + k, "ab"[k], f"brand{m} {20 + m}inch x{m}y", {"Size": f"{20 + m}inch"}) for m in range(3) for k in range(2)]
    p, f = make(spark, rows)
    p = p.withColumn("model_id", F.floor(F.col("product_idx") / 2).cast("string"))
    every = vocabulary.vocabulary(vocabulary.basic_words(p, f))
    assert minhash.signature_size(every).first()["k"] == every.count() // 2 > 1
    for name in ("baseline", "extended"):  # all but one are done
        done = [(0, r, b, 0.5, 9, 1, 1, 0.1 * r, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1) for r, b in ((1, 3), (2, 2), (3, 1))[: 3 if name == "baseline" else 2]]
        results.write_results(spark.createDataFrame(done, results.RESULTS), f"{tmp_path}/{name}")
    got = experiment.compared(p, f, p.select("product_idx", "title"), str(tmp_path), n_bootstraps=1, k=3)
    n = got["baseline"].count()
    assert n == got["extended"].count() == 3 and got["curves"].count() == 6
    assert {r.measure for r in got["areas"].collect()} == {"pc_lsh", "pq_lsh", "f1_star"}
    lines = experiment.report(got["baseline"]).split("\n")
    assert len(lines) == n + 1 and lines[0].split()[:3] == ["r", "b", "t"] and len({len(x) for x in lines}) == 1


def test_result_files(spark, tmp_path):
    assert results.read_results(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"bootstrap": 1, "(r,b)": [2, 5], "t": 0.5, "candidate_pairs": 7, "f1": 0.25}]))
    r = results.read_json_results(spark, str(path)).first()
    assert (r.bootstrap, r.r, r.b, r.candidate_pairs, r.f1) == (1, 2, 5, 7, 0.25)


def test_stream_of_listings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"product_idx": 1, "model_id": "m", "shop": "s", "title": '29" TV', "features": {"k": "60 Hertz"}}) + "\n")
    seen = []
    q = listings.for_each(listings.words(listings.cleaned(listings.read(spark, str(tmp_path / "in")))), lambda df, _: seen.extend(sorted(r.word for r in df.collect())), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["29inch", "60hz"]


def test_clusters_and_epsilon_over_all_candidates(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "R", 4)  # more candidates between different parts
    every = {tuple(r) for r in catalog.lsh_candidates(spark, d).collect()}
    offers = {r.product_idx: r for r in catalog.offered(spark, d).collect()}
    # brand 1 is found in brand 11 to brand 15, and so on
    brand = lambda k: offers[k].p_brand.lower().replace("brand#", "")[:1]
    left = [p for p in every if offers[p[0]].shop != offers[p[1]].shop and brand(p[0]) == brand(p[1])]
    assert any(i // 16 != j // 16 for i, j in left) and len(left) < len(every)
    pairs = spark.createDataFrame(left, "i long, j long")
    scored = similarity.dissimilarity(similarity.pair_similarity(pairs, catalog.products(spark, d), catalog.features(spark, d)))
    edges = {(r.i, r.j): r.dissim for r in scored.collect()}
    assert set(edges) == set(left)
    joined = lambda eps: clustering.agglomerate(list(offers), edges, eps)
    assert {r.product_idx: r.cluster_id for r in catalog.clusters(spark, d).collect()} == joined(0.5)
    truth, scores = {tuple(r) for r in catalog.true_pairs(spark, d).collect()}, []
    for eps in experiment.EPSILONS:
        own = joined(eps)
        hits = sum(own[i] == own[j] for i, j in truth)
        pq, pc = hits / len(every), hits / len(truth)
        scores.append((round(2 * pq * pc / (pq + pc), 6) if hits else 0.0, -eps))
    got = catalog.epsilon_grid_best(spark, d).first()
    assert (got.f1, -got.epsilon) == max(scores)


def test_candidates_without_making_them_twice(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randint(0, 2) for _ in range(7)]) for k in range(60)] + [(k, [1] * 7) for k in range(60, 80)]
    sigs = spark.createDataFrame(rows, "product_idx long, sig array<long>").coalesce(1)
    for r, block in ((2, 8), (3, 4096)):
        share = lambda a, b: any(a[k : k + r] == b[k : k + r] for k in range(0, 7, r))  # noqa: B023, E731
        want = [(i, j) for i, a in rows for j, b in rows if i < j and share(a, b)]
        made = blocking.signed_candidates(sigs, r, block=block)
        assert sorted(map(tuple, made.collect())) == want
        assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # pairs are not shuffled to be told apart


def test_candidates_are_counted_without_making_them(spark):
    rng = random.Random(7)
    rows = [(k, [rng.randint(0, 2) for _ in range(5)]) for k in range(150)] + [(k, [1] * 5) for k in range(150, 180)]
    sigs = spark.createDataFrame(rows, "product_idx long, sig array<long>").coalesce(1)
    share = lambda a, b: any(a[k : k + 2] == b[k : k + 2] for k in range(0, 5, 2))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and share(a, b)}
    for block in (50, 4096):
        assert blocking.count_candidates(sigs, 2, block).first()["comparisons"] == len(want)
    assert blocking.count_candidates(sigs.limit(0), 2).first()["comparisons"] == 0
    some = [(0, 1), (5, 160), (7, 9), (150, 179)]
    got = blocking.sharing(spark.createDataFrame(some, "i long, j long"), sigs, 2).collect()
    assert {tuple(x) for x in got} == {*some} & want


def test_candidates_of_a_sample(spark):
    rng = random.Random(9)
    sigs = spark.createDataFrame([(k, [rng.randint(0, 2) for _ in range(4)]) for k in range(20)], "product_idx long, sig array<long>").coalesce(1)
    own = spark.createDataFrame([(k, rng.randrange(20)) for k in range(20)], "local_pos long, product_idx long").coalesce(1)
    local = own.join(sigs, "product_idx").select(F.col("local_pos").alias("product_idx"), "sig")
    want = {tuple(r) for r in blocking.to_global(blocking.candidates(blocking.bands(local, 2)), own).collect()}
    got = [tuple(r) for r in blocking.drawn_candidates(sigs, own, 2).collect()]
    assert len(got) == len(want) and set(got) == want and any(i == j for i, j in want)


def test_tables_of_products_are_not_sent_to_the_driver(spark):
    p, f = make(spark, [(k, "ab"[k % 2], f"tv {k % 4}x", {"Size": f"{k % 2}inch"}) for k in range(8)])
    pairs = spark.createDataFrame([(i, j) for i in range(8) for j in range(i + 1, 8)], "i long, j long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (brands.prune_same_shop(pairs, p), similarity.title_pairs(pairs, p), clustering.cluster_pairs(p.select("product_idx", F.floor(F.col("product_idx") / 4).alias("cluster_id")))):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
    like, few, own = similarity.alike_features(pairs, f)
    assert {r.like for r in like.collect()} == {0, 1} and {tuple(r) for r in few.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert sorted(r.product_idx for r in own.collect()) == [0, 1]


def test_edges_scored_in_buckets(spark):
    rng = random.Random(4)
    some = [
        (k, rng.choice(["a", "b", "c", None]), rng.choice(["sony tv 46inch x1y", "set of 5inch 60hz", "lg 46inch screen x2y big", "", "red sonny tvs 46inch"]) + rng.choice(["", " new one", " 3d"]),
         {x: v for x, v in (("Size", rng.choice(["46inch", "42 inch"])), ("Brand", rng.choice(["sony", "lg", "none"])), ("Refresh Rate", "60Hz"), ("Refresh Rate:", "50hz")) if rng.random() < 0.6}) for k in range(40)
    ]
    p, f = make(spark, some)
    signed = spark.createDataFrame([(k, [rng.randint(0, 1) for _ in range(4)]) for k in range(40)], "product_idx long, sig array<long>").coalesce(1)
    every = blocking.signed_candidates(signed, 2)
    for variant, block in (("exact", 8), ("fast", 1024)):
        want = {(r.i, r.j): r.dissim for r in experiment.scored_edges(every, p, f, variant, places=9).collect()}
        made = scoring.scored_edges(signed, p, f, 2, 0.5, variant, places=9, block=block)
        rows = made.collect()
        assert len(rows) == len(want) and {(r.i, r.j) for r in rows} == set(want)
        assert all(abs(r.dissim - want[r.i, r.j]) < 2e-9 for r in rows)
        parts = [{tuple(x) for x in components.components(e, "i", "j").collect()} for e in (made.where("link"), made.where("dissim <= 0.5"))]
        assert parts[0] == parts[1]
        assert 0 < sum(r.link for r in rows) < len(rows)


def test_linkage_of_a_grid_is_that_of_each_epsilon():
    rng = random.Random(8)
    for _ in range(40):
        edges = {(i, j): rng.choice([0.0, 0.1, 0.2, 0.3, 0.5]) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.7}
        i, j = (clustering.np.array([e[k] for e in edges]) for k in (0, 1))
        d = clustering.np.array([*edges.values()])
        grid = (0.0, 0.1, 0.3, 0.4)
        for eps, least in zip(grid, clustering.linkage(12, i, j, d, grid), strict=True):
            assert dict(enumerate(least.tolist())) == clustering.agglomerate(list(range(12)), edges, eps)


def test_whole_clusters_are_those_of_the_linkage():
    np, some, many = clustering.np, 0, 0
    for seed in range(300):
        rng = random.Random(seed)
        n, shops = rng.randint(2, 40), rng.randint(2, 4)
        shop, brand = np.array([rng.randint(0 if rng.random() < 0.95 else -1, shops - 1) for _ in range(n)]), np.array([rng.choice([-1, 0, 0, 0, 1]) for _ in range(n)])
        codes = [np.array([rng.randint(0, rng.choice([1, 3, 8])) for _ in range(n)]) for _ in range(2)]
        share = rng.choice([0.2, 0.5, 0.9])
        meets = lambda a, b: shop[a] != shop[b] and min(shop[a], shop[b]) >= 0 and (brand[a] == brand[b] or min(brand[a], brand[b]) < 0) and any(c[a] == c[b] for c in codes)  # noqa: B023, E731
        edges = {(a, b): 0.0 if rng.random() < share else rng.choice([0.1, 0.6]) for a in range(n) for b in range(a + 1, n) if meets(a, b)}
        got = settling.whole(shop, brand, codes, lambda a, b: edges[min(a, b), max(a, b)] == 0.0)  # noqa: B023
        wide = len({x for x in shop.tolist() if x >= 0})
        for eps in (0.0, 0.3):
            own = clustering.agglomerate(list(range(n)), edges, eps)
            groups = {}
            for k, c in own.items():
                groups.setdefault(c, []).append(k)
            full = {tuple(g) for g in groups.values() if len(g) == wide > 1}
            assert {tuple(sorted(c)) for c in got} == full if eps == 0 else {tuple(sorted(c)) for c in got} <= full
        done = {x for c in got for x in c}
        rest = [k for k in range(n) if k not in done]  # others are linked as if those were not there
        left = {e: d for e, d in edges.items() if not done & {*e}}
        assert clustering.agglomerate(rest, left, 0.3) == {k: own[k] for k in rest}
        stopped = settling.whole(shop, brand, codes, lambda a, b: edges[min(a, b), max(a, b)] == 0.0, tries=-40)  # noqa: B023
        assert {*map(tuple, map(sorted, stopped))} <= {*map(tuple, map(sorted, got))}
        some, many = some + len(got), many + n
    assert some > 200
