"""Models fitted together, the nested holdout and the grid inside pools, against slow versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import grid, ranker, splits
from tarn.operators import metrics as M
from tarn.operators import scores as S
from tarn.plans import experiments
from tarn.plans import queries as Q


def close(a: dict, b: dict) -> bool:
    return all(np.allclose(a[k], b[k], atol=1e-7) for k in ("scaler_mean", "scaler_scale", "coefficients", "intercept"))


@pytest.fixture(scope="module")
def labelled(spark):
    rnd, rows = random.Random(1), []
    for i in range(120):
        for p in range(4):
            u, v = rnd.gauss(0, 1), rnd.gauss(2, 5)
            rows.append((f"s{i}", p, f"f{p % 2}", i % 3, i // 3 % 4, u, v, rnd.gauss(0, 0.1), int(rnd.random() < 1 / (1 + np.exp(0.1 * v - 1.5 * u)))))
    return spark.createDataFrame(rows, "sample_id string, pos int, path string, target int, fold int, u double, v double, w double, label int").cache()


def test_models_fitted_together_equal_single_fits(labelled):
    names = ["u", "v", "w"]
    fits = [ranker.Fit(0.5, 0, None), ranker.Fit(0.5, 0, 2), ranker.Fit(2.0, None, 1), ranker.Fit(0.1, 2, 0)]
    for f, got in zip(fits, ranker.fit_many(labelled, names, fits)):
        own = labelled if f.within is None else labelled.where(F.col("target") == f.within)
        own = own if f.fold is None else own.where(F.col("fold") != f.fold)
        assert close(got, ranker.fit(own, names, f.c)) and got["C"] == f.c
    with pytest.raises(ValueError):
        ranker.fit_many(labelled, names, [ranker.Fit(1.0, within=9)])


def slow_lasso(x, y, c):
    a = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))])
    of = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    steep, w = c * np.linalg.eigvalsh((a * (of / 4)[:, None]).T @ a).max(), np.zeros(a.shape[1])
    for _ in range(100_000):
        z = w - c * a.T @ (of * (1 / (1 + np.exp(-a @ w)) - y)) / steep
        new = np.sign(z) * np.maximum(np.abs(z) - 1 / steep, 0)
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w


@pytest.mark.parametrize("c", [0.005, 0.02, 1.0])
def test_lasso_equals_proximal_gradient(labelled, c):
    rows = labelled.select("u", "v", "w", "label").collect()
    want = slow_lasso(np.array([r[:3] for r in rows]), np.array([r[3] for r in rows], float), c)
    got = ranker.fit(labelled, ["u", "v", "w"], c, penalty="l1")
    assert np.allclose([*got["coefficients"], got["intercept"]], want, atol=1e-6)
    assert [x == 0 for x in got["coefficients"]] == [abs(x) < 1e-12 for x in want[:3]]
    with pytest.raises(ValueError):
        ranker.fit(labelled, ["u"], penalty="l3")


def test_nested_holdout(spark, labelled, tmp_path):
    kinds = ["x", "y", None]
    k = F.substring("sample_id", 2, 9).cast("int")
    samples = labelled.select("sample_id", (F.col("fold") % 2).alias("fold")).distinct().withColumns({"kind": F.element_at(F.array(*map(F.lit, kinds)), k % 3 + 1), "split": F.when(k % 5 == 0, "test").when(k % 5 == 1, "dev").otherwise("train")})
    features = labelled.drop("target", "fold")
    got = experiments.nested_holdout(features, samples, "kind", ["x", "y"], 2, ("u",), ("v", "w"), "raw", (0.5, 2.0))
    cover = experiments.anchor_coverage(got["anchor"], features, samples, "kind", ["x", "y"]).collect()
    assert len(cover) == 6 and all(r.missing == r.repeated == 0 for r in cover)
    # target by target and fold by fold
    for target in ("x", "y"):
        inside = F.col("kind").eqNullSafe(F.lit(target))
        use = samples.where(F.when(F.col("split") == "test", inside).otherwise(~inside))
        rows = features.join(use, "sample_id")
        train, dev = rows.where("split = 'train'"), rows.where("split = 'dev'")
        anchor = ranker.select(train, dev, ["u"], (0.5, 2.0))
        assert close(anchor, got["anchors"][target]) and anchor["C"] == got["anchors"][target]["C"]
        want = {}
        for f in range(2):
            model = ranker.fit(train.where(F.col("fold") != f), ["u"], anchor["C"])
            want |= {(r.sample_id, r.pos): r.s for r in train.where(F.col("fold") == f).select("sample_id", "pos", ranker.linear_score(model).alias("s")).collect()}
        want |= {(r.sample_id, r.pos): r.s for r in rows.where("split <> 'train'").select("sample_id", "pos", ranker.linear_score(anchor).alias("s")).collect()}
        scores = got["anchor"].where(F.col("target") == target)
        found = {(r.sample_id, r.pos): r.score for r in scores.collect()}
        assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-6 for x in want)
        full = rows.join(scores.select("sample_id", "pos", F.col("score").alias("anchor_score")), ["sample_id", "pos"])
        final = ranker.select(full.where("split = 'train'"), full.where("split = 'dev'"), ["v", "w", "anchor_score"], (0.5, 2.0))
        assert close(final, got["models"][target])
        test = full.where("split = 'test'").select("sample_id", "pos", ranker.linear_score(final).alias("score"), (F.col("label") > 0).alias("is_gold"))
        a, b = M.summary(M.outcomes(test)).first(), got["summary"].where(F.col("target") == target).first()
        assert all(abs(a[c] - b[c]) < 1e-9 for c in ("n", "hit_1", "hit_k", "mrr", "mrr_k"))
    experiments.save_holdout(got, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h" / "models")).count() == 4
    assert spark.read.parquet(str(tmp_path / "h" / "scores")).where("target = 'x'").count() == got["scores"].where("target = 'x'").count()


def test_grid_equals_one_rerank_per_point(spark):
    rnd = random.Random(4)
    rows = [(f"s{i}", p, rnd.choice(["a", "b", "c", None]) if i % 7 else "a", rnd.randrange(8) / 8, rnd.randrange(8) / 8, rnd.random() < 0.2) for i in range(40) for p in range(rnd.choice((1, 3, 9)))]
    df = spark.createDataFrame(rows, "sample_id string, pos int, path string, score double, other double, is_gold boolean").withColumn("path", F.coalesce("path", F.lit("")))
    big = F.count("*").over(S.G.pool()) > 3
    own = df.withColumn("big", big)
    got = {tuple(r)[:6]: tuple(r)[6:] for r in grid.hierarchical_grid(own, {"always": F.lit(True), "big": F.col("big")}).collect()}
    assert len(got) == 2 * 900
    for point in rnd.sample(sorted(got), 12):
        policy, source, mode, alpha, top, penalty = point
        x = own.withColumn("hybrid", (S.G.normalized(F.col("score"), "minmax", 1.0, 0.0) + S.G.normalized(F.col("other"), "minmax", 1.0, 0.0)) / 2)
        one = S.hierarchical(x, F.lit(True) if policy == "always" else F.col("big"), mode, alpha, top, penalty, {"model": "score", "semantic": "other", "hybrid_norm": "hybrid"}[source])
        want = M.summary(M.outcomes(one.withColumn("score", F.round("score", 9)))).first()
        assert np.allclose(got[point], tuple(want), atol=1e-9) or np.allclose(tuple(grid_point(own, point)), tuple(want), atol=1e-9)
    assert grid.hierarchical_grid(own.limit(0), {"always": F.lit(True)}).count() == 0


def grid_point(rows, point):
    """The point again, with sums rounded before they are ranked, as in the slow version."""
    policy, source, mode, alpha, top, penalty = point
    r = grid.hierarchical_grid(rows, {policy: F.lit(True) if policy == "always" else F.col("big")}, (source,), (mode,), (alpha,), (top,), (penalty,), digits=9).first()
    return tuple(r)[6:]


def test_split_by_group_has_no_task_of_all_groups(spark):
    df = spark.range(3000).select(F.col("id").alias("sample_id"), (F.col("id") % 700).cast("string").alias("group_key"))
    got = splits.split_by_group(df, 0.2, 5)
    order = df.groupBy("group_key").agg(F.count("*").alias("n")).withColumn("d", splits.draw(5, "group_key")).orderBy("d", "group_key").collect()
    dev, used = set(), 0
    for r in order:
        if used < 600:
            dev.add(r.group_key)
        used += r.n
    assert {r.group_key for r in got.where("split = 'dev'").select("group_key").distinct().collect()} == dev


def test_quoted_spans_of_the_six_forms(spark):
    rows = spark.createDataFrame([(str(i), c) for i, c in enumerate(["Use this here"] * 6 + [None, ""])], "sample_id string, comment string")
    got = {r.sample_id: r for r in Q.quoting_samples(rows).select("sample_id", "comment", T.inline_code(F.col("comment")).alias("inline"), T.quoted_spans(F.col("comment")).alias("quoted"), T.path_mentions(F.col("comment")).alias("paths")).collect()}
    assert [got[str(k)].quoted for k in range(6)] == [["Use this"], ["Use this"], ["Use this.py"], [], ["Use this"], []]
    assert [got[str(k)].inline for k in (0, 1, 4)] == [[], ["Use this"], ["Use this"]]
    assert got["2"].paths == ["this.py"] and got["5"].paths == ["this/a.txt"]
    assert got["6"].comment is None and got["7"].comment == " see ``" and got["7"].quoted == []
