"""Ranking operators on small pools, against plain Python."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.operators import bayes, diffs, fuzzy, lexical, ranker, routing, semantic, softmax, splits, stats, validate
from tarn.operators import groupwise as G
from tarn.operators import metrics as M
from tarn.operators import scores as S
from tarn.plans import experiments, queries
from tarn.sources import files, pools

SAMPLES = [("s1", "Please rename `old_name` to new_name in src/app.py"), ("s2", "remove this line: x = 1"), ("s3", "")]
POOL = [
    ("s1", 1, "a::hunk_1", "path: src/other.py\n@@ -1 +1 @@\n+something else\n-another", "src/other.py", False),
    ("s1", 2, "b::hunk_1", "path: src/app.py\n@@ -1 +1 @@\n-old_name = 3\n+new_name = 3", "src/app.py", True),
    ("s2", 1, "c::hunk_1", "path: b.py\n@@ -1 +1 @@\n-x = 1\n+y = 2", "b.py", True),
    ("s2", 2, "c::hunk_2", "path: b.py\n@@ -9 +9 @@\n+z = 3", "b.py", False),
    ("s3", 1, "d::hunk_1", "", "", False),
]


@pytest.fixture(scope="module")
def tables(spark):
    samples = spark.createDataFrame(SAMPLES, "sample_id string, comment string")
    return samples, spark.createDataFrame(POOL, "sample_id string, pos int, context_id string, text string, path string, is_gold boolean")


def test_bm25_by_hand(spark):
    docs = [["a", "b", "a"], ["b", "c"], ["d"]]
    samples = spark.createDataFrame([("s", "a b b")], "sample_id string, comment string")
    pool = spark.createDataFrame([("s", i, " ".join(d)) for i, d in enumerate(docs)], "sample_id string, pos int, text string")
    got = {r.pos: r.bm25 for r in lexical.bm25(samples, pool).collect()}
    avg, df = 2.0, Counter(t for d in docs for t in set(d))
    for i, d in enumerate(docs):
        s = 0.0
        for t in ["a", "b", "b"]:
            f = d.count(t)
            s += math.log(1 + (3 - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / avg)) if f else 0
        assert math.isclose(got[i], s, abs_tol=1e-12)


def test_lexical_features_and_ranking(tables):
    samples, pool = tables
    rows = {(r.sample_id, r.pos): r for r in lexical.base_features(samples, pool).withColumn("score", lexical.lexical_score()).collect()}
    assert len(rows) == len(POOL)
    gold = rows["s1", 2]
    assert gold.path_exact_match == 1.0 and gold.inline_code_overlap == 1.0 and rows["s1", 1].path_exact_match == 0.0
    assert rows["s2", 1].line_overlap == 0.0 and rows["s2", 1].removed_token_overlap > 0
    assert gold.score > rows["s1", 1].score and rows["s2", 1].score > rows["s2", 2].score
    assert rows["s3", 1].score == 0.0
    with pytest.raises(ValueError):
        lexical.lexical_score({"nothing": 1.0})
    assert {r.score_name for r in lexical.ablation_scores(lexical.base_features(samples, pool)).select("score_name").distinct().collect()} == set(lexical.ABLATIONS)


def brute_share(values):
    n = len(values)
    order = sorted(range(n), key=lambda i: (math.isnan(values[i]), -values[i] if not math.isnan(values[i]) else 0, i))
    out = [0.0] * n
    for r, i in enumerate(order):
        out[i] = 1.0 if n == 1 else 1 - r / (n - 1)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0.0, 1.0, 1.0, 2.5, -3.0, float("nan")]), min_size=1, max_size=7), min_size=1, max_size=5))
def test_ranks_and_normalizations(spark, groups):
    rows = [(g, p, v) for g, vs in enumerate(groups) for p, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "sample_id int, pos int, score double")
    s = F.col("score")
    got = {(r.sample_id, r.pos): r for r in df.select("sample_id", "pos", G.rank_share(s).alias("share"), G.normalized(s, "zscore").alias("z"), G.normalized(s, "minmax").alias("m"), G.normalized(s, "minmax", 1.0).alias("ones")).collect()}
    for g, vs in enumerate(groups):
        for p, e in enumerate(brute_share(vs)):
            assert math.isclose(got[g, p].share, e)
        if not any(map(math.isnan, vs)):
            a = np.array(vs)
            z = a - a.mean() if a.std() < 1e-6 else (a - a.mean()) / a.std()
            m = a * 0 if np.ptp(a) < 1e-6 else (a - a.min()) / np.ptp(a)
            for p in range(len(vs)):
                assert math.isclose(got[g, p].z, z[p], abs_tol=1e-9) and math.isclose(got[g, p].m, m[p], abs_tol=1e-9)
                assert got[g, p].ones == (1.0 if np.ptp(a) < 1e-6 else got[g, p].m)


def test_feature_matrix(spark):
    rnd = random.Random(2)
    rows = [(g, p, rnd.choice(["x", "y", ""]), rnd.choice([0.0, 1.0, 2.0]), rnd.random()) for g, n in enumerate((1, 3, 15, 25, 45)) for p in range(n)]
    df = spark.createDataFrame(rows, "sample_id int, pos int, path string, u double, v double")
    with pytest.raises(ValueError):
        G.feature_matrix(df, ["u"], "other")
    for transform in G.TRANSFORMS:
        got = G.feature_matrix(df, ["u", "v"], transform)
        assert got.columns[2:] == G.column_names(["u", "v"], transform)
    canonical = list(G.TRANSFORMS)[-1]
    assert len(G.column_names([str(i) for i in range(25)], canonical)) == 200
    got = {(r.sample_id, r.pos): r for r in G.feature_matrix(df, ["u", "v"], canonical).collect()}
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        for k, name in ((3, "u"), (4, "v")):
            vs = [r[k] for r in own]
            top = max(vs) if max(vs) > 0 else 1.0
            share = brute_share(vs)
            for i, r in enumerate(own):
                x = got[g, r[1]].asDict()
                file = [q for q in own if q[2] == r[2]]
                fs = brute_share([q[k] for q in file])
                assert math.isclose(x[f"{name}_max_norm"], r[k] / top) and math.isclose(x[f"{name}_rank_pct"], share[i])
                assert x[f"{name}_file_max"] == max(q[k] for q in file) and math.isclose(x[f"{name}_within_file_rank_pct"], fs[file.index(r)])
                n = len(own)
                assert (x[f"{name}_x_ctx_11_20"], x[f"{name}_x_ctx_21_40"], x[f"{name}_x_ctx_gt40"]) == (r[k] * (11 <= n <= 20), r[k] * (21 <= n <= 40), r[k] * (n > 40))


def test_outcomes(spark):
    rows = [("a", i, f"c{i}", 1.0 - i / 10, i == 3) for i in range(5)] + [("b", 0, "x", 1.0, True), ("b", 1, "y", 1.0, True), ("c", 0, "z", 1.0, False)]
    df = spark.createDataFrame(rows, "sample_id string, pos int, context_id string, score double, is_gold boolean")
    got = {r.sample_id: (r.first_rank, r.hit_1, r.hit_k, r.rr, r.rr_k) for r in M.outcomes(df).collect()}
    assert got == {"a": (4, 0, 0, 0.25, 0.0), "b": (1, 1, 1, 1.0, 1.0), "c": (0, 0, 0, 0.0, 0.0)}
    assert M.summary(M.outcomes(df)).first().mrr == pytest.approx(1.25 / 3)
    assert M.summary(M.outcomes(df.limit(0))).first().mrr == 0.0
    assert [r.sample_id for r in M.failures(M.outcomes(df), 1).collect()] == ["a"]
    t = {r.sample_id: (r.top_id, r.second, r.margin) for r in G.top_stats(df).collect()}
    assert t["b"] == ("x", 1.0, 0.0) and t["c"] == ("z", 1.0, 0.0)
    assert {r.sample_id: r.margin for r in G.top_stats(df, "zero").collect()}["c"] == 1.0


def test_classification(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    got = M.classification(spark.createDataFrame(rows, "gold string, pred string")).first()
    f = {"a": 0.5, "b": 2 / 3, "c": 0.0}
    assert got.accuracy == 0.5 and got.macro_f1 == pytest.approx(sum(f.values()) / 3) and got.weighted_f1 == pytest.approx((2 * f["a"] + f["b"]) / 4)
    assert M.classification(spark.createDataFrame([], "gold string, pred string")).first().accuracy == 0.0


@pytest.mark.parametrize("penalty", [0.0, 0.25, 1.0])
def test_neighbours(spark, penalty):
    rnd = random.Random(3)
    rows = [(g, p, rnd.choice("xy"), rnd.choice([None, 1, 2, 2, 5, 9]), rnd.uniform(-2, 2)) for g in range(30) for p in range(6)]
    df = spark.createDataFrame(rows, "sample_id int, pos int, path string, hunk int, score double")
    got = {(r.sample_id, r.pos): r.score for r in S.neighbours(df, penalty).collect()}
    for r in rows:
        near = [q[4] - penalty * abs(q[3] - r[3]) for q in rows if q[0] == r[0] and q[2] == r[2] and q[3] is not None] if r[3] is not None else [r[4]]
        assert math.isclose(got[r[0], r[1]], max([r[4], *near]), abs_tol=1e-12)


def test_fusion_routing_and_rerank(spark):
    rows = [("s", 0, "p", 1.0, 0.1, False), ("s", 1, "p", 0.5, 0.9, True), ("s", 2, "q", 0.0, 0.5, False)]
    df = spark.createDataFrame(rows, "sample_id string, pos int, path string, a double, b double, is_gold boolean")
    got = {r.pos: r.score for r in S.fuse([(df.withColumn("score", F.col("a")), 1.0), (df.withColumn("score", F.col("b")), 2.0)], "minmax").collect()}
    assert got == pytest.approx({0: 1.0, 1: 2.5, 2: 1.0})
    with pytest.raises(ValueError):
        S.fuse([])
    grid = S.two_way_grid(df)
    assert grid.count() == len(S.MODES) * len(S.WEIGHTS) and S.best_point(grid, "mode", "weight").first().hit_1 == 1.0
    assert {r.pos: r.score for r in S.rerank_top(df, 2, 1.0).collect()} == pytest.approx({0: 0.0, 1: 1.0, 2: -1.0})
    assert {r.pos: r.score for r in S.route(df, F.lit(True)).collect()} == {0: 0.1, 1: 0.9, 2: 0.5}
    h = S.hierarchical(df.withColumn("score", F.col("a")), F.lit(True), "mean", 1.0, 1, 0.5)
    assert {r.pos: r.score for r in h.collect()} == pytest.approx({0: 2.0, 1: 1.5, 2: -0.5})
    assert {r.pos: r.score for r in S.file_prior(df.withColumn("score", F.col("a")), "top2_mean").collect()} == {0: 0.75, 1: 0.75, 2: 0.0}
    r = M.rankings(df.withColumn("context_id", F.col("pos").cast("string")).withColumn("score", F.col("a")))
    aux = r.withColumn("ranked_context_ids", F.array(F.lit("2"), F.lit("1")))
    merged = S.hybrid(r, [aux], r.select("sample_id", F.lit(True).alias("applies"))).first().ranked_context_ids
    assert merged == ["0", "2", "1"]


def test_feedback_contexts_by_file(spark):
    rows = [("s", i, p, s) for i, (p, s) in enumerate([("x", 5.0), ("X", 4.0), ("", 3.0), ("", 2.0), ("y", 1.0)])]
    df = spark.createDataFrame(rows, "sample_id string, pos int, path string, score double")
    order = lambda d: [r.pos for r in d.orderBy("rank").collect()]
    assert order(S.feedback_contexts(df, 3)) == [0, 1, 2]
    assert order(S.feedback_contexts(df, 5, True)) == [0, 2, 3, 4, 1]


def test_naive_bayes(spark):
    rows = [(1, "good good film", "pos"), (2, "bad film", "neg"), (3, "good", "pos")]
    df = spark.createDataFrame(rows, "row_id int, text string, label string")
    test = spark.createDataFrame([(1, "good unseen"), (2, "bad"), (3, "")], "row_id int, text string")
    got = {r.row_id: (r.pred, r.score) for r in bayes.predict(test, bayes.fit(df)).collect()}
    assert got[1][0] == "pos" and got[1][1] == pytest.approx(math.log(2 / 3) + math.log(4 / 7) + math.log(1 / 7))
    assert got[2][0] == "neg" and got[3] == ("pos", pytest.approx(math.log(2 / 3)))


def test_fuzzy(spark, tables):
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abcd", k=rnd.randint(3, 8))) for _ in range(2))
        assert fuzzy.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
        many = ["".join(rnd.choices("abcde", k=rnd.randint(3, 9))) for _ in range(12)]
        assert fuzzy.best_similarity(a, many) == max([SequenceMatcher(None, a, m).ratio() for m in many if fuzzy.worth(a, m)], default=0.0)
    samples, pool = tables
    got = {(r.sample_id, r.pos): r.score for r in fuzzy.fuzzy_scores(samples, pool).collect()}
    assert got["s1", 2] > got["s1", 1] and got["s3", 1] == 0.0
    focused = {(r.sample_id, r.pos): r.score for r in fuzzy.fuzzy_scores(samples, pool, focused=True).collect()}
    assert focused["s1", 2] > focused["s1", 1]


def test_semantic_and_feedback(spark, tables):
    samples, pool = tables
    texts = spark.createDataFrame([(t,) for t in ("red apple pie", "green apple tart", "fast red car", "slow green car", "apple car")], "text string")
    model = semantic.fit(texts, rank=10, min_df=2, max_df=1.0)
    terms = {r.term for r in model.vocabulary.collect()}
    assert terms == {"red", "apple", "green", "car"}
    q = spark.createDataFrame([("s", "red apple")], "sample_id string, text string")
    c = spark.createDataFrame([("s", 0, "apple red"), ("s", 1, "green car"), ("s", 2, "unknown words")], "sample_id string, pos int, text string")
    got = {r.pos: r.score for r in semantic.score(q, c, model).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] < 0.5 and got[2] == 0.0
    with pytest.raises(ValueError):
        semantic.fit(texts.limit(0))
    queries = samples.select("sample_id", F.lit("rename value").alias("query"))
    scored = pool.withColumn("score", F.when(F.col("is_gold"), 1.0).otherwise(0.0))
    added = {r.sample_id: r for r in semantic.feedback_terms(queries, scored, 1).collect()}
    assert added["s1"].terms == ["src", "app", "py", "old_name", "new_name", "old", "new"]
    assert added["s1"].paths == ["src/app.py"] and added["s3"].terms == []
    assert {r.sample_id: r.text for r in semantic.feedback_query(queries, semantic.feedback_terms(queries, scored, 1)).collect()}["s3"] == "rename value"


def test_logistic_ranker(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 3)) * [1, 5, 1] + [0, 2, 0]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    rows = [(f"s{i // 6}", i % 6, int(y[i]), *map(float, x[i]), i // 6 % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id string, pos int, label int, u double, v double, w double, fold int")
    model = ranker.fit(df, ["u", "v", "w"], 0.5)
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((300, 1))])
    w = np.zeros(4)
    cw = np.where(y > 0, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(0.5 * (z * (cw * p * (1 - p))[:, None]).T @ z + np.eye(4), 0.5 * z.T @ (cw * (p - y)) + w)
    assert np.allclose([*model["coefficients"], model["intercept"]], w, atol=1e-6)
    got = [r.s for r in df.orderBy(F.expr("int(substring(sample_id, 2))"), "pos").select(ranker.linear_score(model).alias("s")).collect()]
    assert np.allclose(got, z @ w, atol=1e-6)
    best = ranker.select(df.where("fold < 2"), df.where("fold = 2"), ["u", "v", "w"], (0.1, 1.0))
    assert best["C"] in (0.1, 1.0) and best["dev_metrics"]["hit_1"] > 0.5
    assert ranker.out_of_fold(df, ["u", "v", "w"], 1.0, 3).count() == 300
    with pytest.raises(ValueError):
        ranker.fit(df.where("label = 1"), ["u"])


def test_routers(spark, tables):
    samples, pool = tables
    meta = routing.described(samples, pool)
    assert len(meta.columns) == 21 and {r.sample_id: r.intent_remove for r in meta.collect()} == {"s1": 0.0, "s2": 1.0, "s3": 0.0}
    rnd = random.Random(6)
    rows = [(f"r{i}", p, f"c{p}", rnd.random(), rnd.random(), p == 0) for i in range(60) for p in range(4)]
    pairs = spark.createDataFrame(rows, "sample_id string, pos int, context_id string, a double, b double, is_gold boolean")
    own = pairs.select("sample_id").distinct().withColumn("x", F.hash("sample_id") % 3 + 0.0)
    model, grid = routing.score_router(own, pairs, own, pairs)
    assert grid.count() == len(routing.THRESHOLDS) and len(model["feature_names"]) == 8
    both = pairs.select(F.lit("a").alias("model"), "sample_id", "pos", F.col("a").alias("score"), "is_gold").unionByName(pairs.select(F.lit("b").alias("model"), "sample_id", "pos", F.col("b").alias("score"), "is_gold"))
    best = routing.best_models(both, ["a", "b"])
    assert {r.best for r in best.collect()} == {"a", "b"}
    model = softmax.fit_many(best.join(own, "sample_id"), ["x"], ["a", "b"], (1.0,), "best")[0]
    assert best.join(own, "sample_id").withColumn("k", softmax.predicted(model)).where("k in ('a', 'b')").count() == 60
    assert routing.chosen(both, best.withColumnRenamed("best", "model")).count() == 240


def test_splits(spark):
    rows = [(f"s{i}", f"g{i % 9 if i % 2 else 0}", "x" if i % 4 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "sample_id string, group_key string, repo string")
    for again in range(2):
        s = splits.split_by_group(df, 0.1, 3)
        assert s.count() == 100 and validate.split_overlap(s, "group_key").count() == 0
    assert sorted(r.sample_id for r in s.where("split = 'dev'").collect()) == sorted(r.sample_id for r in splits.split_by_group(df, 0.1, 3).where("split = 'dev'").collect())
    folds = splits.group_folds(df, 3, 7)
    assert folds.count() == 100 and validate.split_overlap(folds.withColumn("split", F.col("fold").cast("string")), "group_key").count() == 0
    dealt = splits.fold_of_groups([("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 1), ("f", 1)], 3, 1)
    load = Counter()
    for k, n in (("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 1), ("f", 1)):
        load[dealt[k]] += n
    assert sorted(load.values()) == [3, 3, 4]
    with pytest.raises(ValueError):
        splits.fold_of_groups([("a", 3)], 3, 1)
    got = Counter(r.repo for r in splits.stratified_sample(df, "repo", 0.1, 1).collect())
    assert got == {"x": 8, "y": 2}
    assert Counter((r.repo, r.split) for r in splits.stratified_split(df, "repo", 1).collect()) == {("x", "train"): 52, ("x", "dev"): 7, ("x", "test"): 16, ("y", "train"): 17, ("y", "dev"): 2, ("y", "test"): 6}
    rare = splits.stratified_split(df.limit(2).withColumn("label", F.lit("z")), "label", 1)
    assert Counter(r.split for r in rare.collect()) == {"train": 1, "dev": 1}


def test_statistics(spark):
    sums = lambda rows: spark.createDataFrame([(str(i), t, n) for i, (t, n) in enumerate(rows)], "group_key string, total double, n long")
    got = stats.bootstrap(sums([(1.0, 2), (0.5, 1)]), 500, 1).first()
    assert got["mean"] == 0.5 and got.ci_low <= 0.5 <= got.ci_high
    wide = stats.bootstrap(sums([(float(i % 2), 1) for i in range(100)]), 1000, 1).first()
    assert 0.36 < wide.ci_low < 0.44 and 0.56 < wide.ci_high < 0.64
    assert tuple(stats.bootstrap(sums([]), 10, 1).first()) == (0.0, 0.0, 0.0)
    p = lambda rows, flips: stats.sign_flip(sums(rows), flips, 1).first().p_value
    assert p([(0.0, 1)] * 3, 100) == 1.0 and p([(1.0, 1)] * 20, 2000) < 0.01 and p([(1.0, 1), (-1.0, 1)] * 10 + [(1.0, 1)], 2000) > 0.5
    with pytest.raises(ValueError):
        stats.bootstrap(sums([]), 0, 1)


def test_validation(spark):
    x = spark.createDataFrame([("s", 0, "a", 1.0), ("s", 1, "b", 2.0)], "sample_id string, pos int, context_id string, score double")
    assert validate.aligned(x, x).count() == 0
    bad = spark.createDataFrame([("s", 0, "z", 1.0), ("t", 0, "c", float("nan"))], x.schema)
    assert {(r.sample_id, r.pos): r.problem for r in validate.aligned(x, bad).collect()} == {("s", 0): "other context", ("s", 1): "missing", ("t", 0): "extra"}
    assert validate.attach(x.drop("score"), x, "sem").columns[-1] == "sem"
    with pytest.raises(ValueError):
        validate.attach(x.drop("score"), bad, "sem")
    full = M.rankings(x)
    assert validate.incomplete_rankings(x, full).count() == 0
    cut = full.withColumn("ranked_context_ids", F.slice("ranked_context_ids", 1, 1))
    assert [r.problem for r in validate.incomplete_rankings(x, cut).collect()] == ["truncated"]
    stale = full.select("sample_id", F.array(F.lit("a")).alias("predicted_context_ids_topk"))
    assert validate.stale_predictions(full, stale, 1).count() == 1
    samples = spark.createDataFrame([("s", None, ["q"], [("a", "d", "t"), ("a", "d", "t")])], f"sample_id string, comment string, gold_context_ids array<string>, contexts array<{files.CONTEXT}>")
    assert {r.problem for r in validate.contract(samples).collect()} == {"missing comment", "repeated context_id", "gold outside the pool"}


def test_diffs(spark):
    from tarn.plans import queries

    found = diffs.hunks(spark.createDataFrame([("p", queries.PATCH)], "instance_id string, patch string"))
    h = found.orderBy("ord").collect()
    assert [r.context_id for r in h] == ["src/a.py::hunk_1", "src/a.py::hunk_2", "gone.py::hunk_1"]
    assert h[0].text.endswith("+y = 2\n---old") and (h[2].old_start, h[2].new_count) == (0, 0)
    reviews = [
        (1, "p", "src/a.py", "@@ -1,2 +1,3 @@\n x = 1\n+y = 2", None, None, None),
        (2, "p", "b/src/a.py", "@@ -10 +11,0 @@ def f():\n-other", None, None, None),
        (3, "p", "src/a.py", "", 2, None, None),
        (4, "p", "src/a.py", "", None, 10, None),
        (5, "p", "nowhere.py", "x", None, None, None),
        (6, "p", "src/a.py", "@@ -7 +7 @@\n-z\n-q", None, None, None),
        (7, "p", "src/a.py", "nothing alike", None, None, None),
    ]
    df = spark.createDataFrame(reviews, "review_id int, instance_id string, path string, diff_hunk string, line int, original_line int, original_start_line int")
    got = {r.review_id: (r.gold_context_ids, r.method, r.reason) for r in diffs.match_reviews(df, found).collect()}
    assert got[1][:2] == (["src/a.py::hunk_1"], "diff_hunk_content")
    assert got[2][:2] == (["src/a.py::hunk_2"], "diff_hunk_header")
    assert got[3][:2] == (["src/a.py::hunk_1"], "new_line") and got[4][:2] == (["src/a.py::hunk_2"], "old_line")
    assert got[5] == ([], "unresolved", "path_not_found")
    assert got[6][:2] == (["src/a.py::hunk_2"], "content_overlap") and got[7][1] == "unresolved"


def test_files(spark, tmp_path):
    sample = '{"sample_id": "s", "comment": "c", "gold_context_ids": ["b"], "contexts": [{"context_id": "a", "source": "d", "text": "x"}, {"context_id": "b", "text": "y"}]}'
    (tmp_path / "s.jsonl").write_text(sample + "\n\n")
    rows = files.candidates_of(files.read_samples(spark, str(tmp_path / "s.jsonl"))).collect()
    assert [(r.pos, r.context_id, r.source, r.is_gold) for r in rows] == [(0, "a", "d", False), (1, "b", "unknown", True)]
    (tmp_path / "c.json").write_text('{"model_path": "m", "sample_ids": ["s", "t"], "context_ids_by_group": [["a", "b"], ["c"]], "gold_context_ids_by_group": [["b"], []], "group_sizes": [2, 1], "scores": [0.5, 1.5, 2.5]}')
    cache = files.read_score_cache(spark, str(tmp_path / "c.json"), "sem")
    assert [(r.sample_id, r.pos, r.context_id, r.is_gold, r.score) for r in cache.orderBy("sample_id", "pos").collect()] == [("s", 0, "a", False, 0.5), ("s", 1, "b", True, 1.5), ("t", 0, "c", False, 2.5)]
    files.write_scores(cache.drop("score_name"), str(tmp_path / "out"), "sem", "dev")
    assert spark.read.parquet(str(tmp_path / "out")).where("score_name = 'sem' and split = 'dev'").count() == 3
    (tmp_path / "a.csv").write_text("folderName,anyInserted\nf,1\nf,2\n")
    assert [r.attributes["anyInserted"] for r in files.read_attributes(spark, str(tmp_path / "a.csv")).collect()] == ["2"]
    files.write_predictions(M.rankings(cache), str(tmp_path / "p"), 1)
    assert {r.sample_id: r.predicted_context_ids_topk for r in spark.read.json(str(tmp_path / "p")).collect()} == {"s": ["b"], "t": ["c"]}
    assert files.named_paths(["a=b"]) == {"a": "b"}
    with pytest.raises(ValueError):
        files.named_paths(["a"])


def test_ingest(spark, tmp_path):
    from tarn.plans.queries import PATCH
    from tarn.sources import ingest

    comment = lambda text, path, hunk, line=None: (text, path, line, None, None, hunk)
    rows = [
        ("i1", "o/r", 7, "Python", (PATCH, "abc"), [comment("@dev: fix it", "src/a.py", "-z"), comment(" ", "src/a.py", "x"), comment("lost", "no.py", "x")], ("easy", "web")),
        ("i2", None, None, "Python", ("@@ -1 +1 @@\n+q", "d"), [comment("one hunk only", "unknown", "+q")], ("easy", "web")),
        ("i3", "o/t", 9, "Python", (PATCH, "e"), [comment("in test", "src/a.py", "-z")], ("easy", "web")),
        ("i4", "o/u", 1, "Java", (PATCH, "f"), [comment("other language", "src/a.py", "-z")], ("easy", "web")),
    ]
    raw = spark.createDataFrame(rows, ingest.RAW)
    done = ingest.resolve(raw, "Python", raw.where("instance_id = 'i3'")).cache()
    assert {r.status: r.n for r in ingest.counts(done).collect()} == {"ok": 1, "empty_comment": 1, "path_not_found": 1, "fewer_than_min_contexts": 1}
    s = ingest.samples(done).first()
    assert (s.sample_id, s.comment, s.gold_context_ids) == ("i1::comment_0", "fix it", ["src/a.py::hunk_2"])
    assert s.metadata.group_key == "o/r::pr_7" and s.metadata.gold_match_method == "diff_hunk_content" and len(s.contexts) == 3
    assert {(r.sample_id, r.reason, r.matcher_stage) for r in ingest.unresolved(done).collect()} == {("i1::comment_2", "path_not_found", "unresolved"), ("i2::comment_0", "fewer_than_min_contexts", "candidate_pool_filter")}
    assert ingest.sized(ingest.samples(done), 3, 3).count() == 1 and ingest.sized(ingest.samples(done), 4).count() == 0
    names = "comment_id string, message string, comment_group string, category_fine string, project string, file_name string, change_type string, line_number int, patchset_number int, is_bug_fix boolean, is_new_file boolean"
    intents = spark.createDataFrame([("f", " hi ", "Code Style!", "c", "p", "a.c", "M", 3, 1, True, False), ("g", None, "x", "c", "p", "a.c", "M", 3, 1, True, False)], names)
    (tmp_path / "a.csv").write_text("folderName,anyInserted,anyDeleted\nf,2,0\n")
    got = ingest.intent_samples(intents, files.read_attributes(spark, str(tmp_path / "a.csv"))).collect()
    assert len(got) == 1 and (got[0].comment, got[0].intent) == ("hi", "code_style") and got[0].contexts[1].text == "inserted tokens: 2"


def test_experiments(spark):
    from tarn.plans import experiments as E

    rng = np.random.default_rng(8)
    rows, split = [], []
    for i in range(60):
        gold = int(rng.integers(0, 4))
        split.append((f"s{i}", "train" if i < 36 else "dev" if i < 46 else "test", "web" if i % 2 else "db"))
        rows += [(f"s{i}", p, "f", int(p == gold), float((p == gold) + rng.normal(0, 0.4))) for p in range(4)]
    features = spark.createDataFrame(rows, "sample_id string, pos int, path string, label int, u double")
    s = spark.createDataFrame(split, "sample_id string, split string, domain string")
    model, scored = E.train_ranker(features, s.select("sample_id", "split"), ("u",), "raw_plus_relative", (1.0,))
    assert model["dev_metrics"]["hit_1"] > 0.5 and scored.count() == 240
    got = E.holdout(features, s, "domain", "web", names=("u",), transform="raw", c_values=(1.0,))
    assert got["n"] == 7 and got["target"] == "web"
    samples = spark.createDataFrame([("a", "hello")], "sample_id string, comment string")
    pool = spark.createDataFrame([("a", 0, "x", "one", 1.0), ("a", 1, "y", "two", 2.0)], "sample_id string, pos int, context_id string, text string, score double")
    text = lambda mode: E.intent_texts(samples, pool, mode, 1).first().text
    assert text("none") == "comment: hello\ncontext:" and text("full") == "comment: hello\ncontext: one\ntwo"
    assert text("retrieved") == "comment: hello\ncontext: two" and text("random") in ("comment: hello\ncontext: one", "comment: hello\ncontext: two")
    with pytest.raises(ValueError):
        text("other")
    labelled = spark.createDataFrame([(i, "good film" if i % 2 else "bad film", "pos" if i % 2 else "neg", "test" if i > 6 else "train") for i in range(10)], "row_id int, text string, label string, split string")
    assert E.intent_run(labelled).first().accuracy == 1.0
    assert E.best_mode({"none": labelled, "full": labelled})[0] == "none"


def test_semantic_rank_of_query_and_features(monkeypatch, spark, sf):
    ranks = []

    def fit(texts, analyzer="word", rank=semantic.RANK, **more):
        ranks.append(rank)
        raise InterruptedError

    monkeypatch.setattr(semantic, "fit", fit)
    samples, candidates = pools.conversation_pools(spark, sf)
    for run in (lambda: queries.semantic_scores(spark, sf), lambda: experiments.canonical_features(samples, candidates, samples.select("sample_id"))):
        with pytest.raises(InterruptedError):
            run()
    assert ranks == [128, 128]
