"""The multinomial router against a slow fit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import metrics as M
from tarn.operators import softmax


def slow_fit(x, y, k, c):
    """Plain descent with the step of the largest curvature."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.hstack([(x - x.mean(0)) / scale, np.ones((len(x), 1))])
    n = np.bincount(y, minlength=k)
    of, hit = (len(y) / (k * n))[y], np.eye(k)[y]
    ridge = np.r_[np.full(a.shape[1] - 1, 2.0 if k == 2 else 1.0), 0.0]
    steep = c * np.linalg.eigvalsh((a * (of / 2)[:, None]).T @ a).max() + 2
    w = np.zeros((k, a.shape[1]))
    for _ in range(200_000):
        z = np.exp(a @ w.T)
        step = (c * (of[:, None] * (z / z.sum(1, keepdims=True) - hit)).T @ a + ridge * w) / steep
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return w


@pytest.fixture(scope="module")
def rows(spark):
    rnd, out = random.Random(3), []
    for i in range(240):
        u, v = rnd.gauss(0, 1), rnd.gauss(5, 3)
        out.append((i, u, v, 7.0, max("abc", key=lambda k: {"a": u, "b": 0.2 * v - 1, "c": 0.3}[k] + rnd.gauss(0, 1))))
    return spark.createDataFrame(out, "i int, u double, v double, same double, label string").cache()


@pytest.mark.parametrize("classes", ["abc", "ab"])
def test_all_c_values_equal_slow_fits(rows, classes):
    own = rows.where(F.col("label").isin(*classes))
    r = own.collect()
    x, y = np.array([[t.u, t.v, t.same] for t in r]), np.array([classes.index(t.label) for t in r])
    # a class without rows gets no weights
    for m in softmax.fit_many(own, ["u", "v", "same"], [*classes, "unused"], (0.01, 0.5)):
        want = slow_fit(x, y, len(classes), m["C"])
        assert m["classes"] == list(classes)
        assert np.allclose(m["coefficients"], want[:, :-1], atol=1e-6) and np.allclose(m["intercepts"], want[:, -1], atol=1e-6)
        got = {t.i: t.k for t in own.select("i", softmax.predicted(m).alias("k")).collect()}
        a = (x - m["scaler_mean"]) / m["scaler_scale"] @ np.array(m["coefficients"]).T + m["intercepts"]
        assert got == {t.i: classes[j] for t, j in zip(r, a.argmax(1))}
    assert all(w == 0 for w in np.array(m["coefficients"])[:, 2])
    assert [n for n, _ in softmax.strongest(m, 2)[classes[0]]] == ["uv"[j] for j in np.argsort(-np.abs(m["coefficients"][0][:2]))]


def test_classes_are_checked(rows):
    with pytest.raises(ValueError):
        softmax.fit_many(rows.where("label = 'a'"), ["u"], ["a", "b"])
    with pytest.raises(Exception, match="unknown class"):
        softmax.fit_many(rows, ["u"], ["a", "b"])


def test_router(spark):
    rnd, rows, meta = random.Random(8), [], []
    for i in range(150):
        kind = i % 3
        meta.append((f"s{i}", float(kind == 0), float(kind == 1), ("train", "train", "dev", "test")[i % 4]))
        for p in range(1 if i == 149 else 5):
            for m, name in enumerate("xyz"):
                rows.append((name, f"s{i}", p, f"c{p}", rnd.random() + (p == 0) * (0.9 if m == kind else 0.0), p == 0))
    scores = spark.createDataFrame(rows, "model string, sample_id string, pos int, context_id string, score double, is_gold boolean")
    meta = spark.createDataFrame(meta, "sample_id string, k0 double, k1 double, split string")
    table, names = softmax.router_table(meta.drop("split"), scores, ["x", "y", "z"])
    assert len(names) == 2 + 3 * 2 + 6 * 3 and names == sorted(names)
    model, report = softmax.select_router(table.join(meta.select("sample_id", "split"), "sample_id"), names, ["x", "y", "z"], (0.01, 1.0))
    got = {(r.C, r.split): r for r in report.collect()}
    assert len(got) == 6 and model["C"] in (0.01, 1.0)
    # the same by ranking the chosen scores
    chosen = softmax.routed(table, [model]).select("sample_id", F.col("best").alias("model"))
    again = M.summary(M.outcomes(scores.join(chosen, ["sample_id", "model"]).join(meta.select("sample_id", "split"), "sample_id"), 3, ("split",)), ("split",))
    for r in again.collect():
        g = got[model["C"], r.split]
        assert (g.n, g.hit_1, g.hit_k) == (r.n, r.hit_1, r.hit_k) and g.mrr == pytest.approx(r.mrr) and g.usage_x + g.usage_y + g.usage_z == g.n
    best = max((0.01, 1.0), key=lambda c: (got[c, "dev"].hit_1, got[c, "dev"].mrr, got[c, "dev"].hit_k))
    assert model["C"] == best and got[best, "test"].hit_1 > 0.6
    # the first of equal rankers is the label
    tie = scores.where("sample_id = 's149'")
    assert softmax.router_table(meta.drop("split"), tie, ["z", "x", "y"])[0].first()["label"] == "z"
