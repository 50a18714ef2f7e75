"""Pointwise logistic rankers: many models of the same rows, fitted together.

The data stays in Spark. Each Newton step is one pass that sums gradient and Hessian of every model that is still moving, per
partition, adds them up in a second step, and brings one small matrix per model to the driver. Models differ in C and in the rows that
they learn from: those of one holdout dataset, less one fold. The intercept is penalized like the other weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M

C_VALUES = (0.1, 0.25, 0.5, 1.0, 2.0)
#: Partial sums that come to the driver at most.
PARTS = 16
#: Models whose sums one pass takes; more of them take more passes.
MODELS = 64
#: Features of which all products of two are made once for all models.
PRODUCTS = 16
#: A column that varies less than this share of its variance over all rows is constant for a model.
CONSTANT = 1e-12
#: Weights settle when no step is larger.
SETTLED = 1e-8


class Fit(NamedTuple):
    """One model: its C, the dataset (value of column target), and the fold and group (values of the columns fold and holdout) that it doesn't see."""

    c: float = 1.0
    within: int | None = None
    fold: int | None = None
    without: int | None = None

    def uses(self, keys: dict[str, np.ndarray], n: int) -> np.ndarray:
        """Which of n rows with these keys it learns from."""
        keep = np.ones(n, bool)
        if self.within is not None:
            keep &= keys["target"] == self.within
        if self.fold is not None:
            keep &= keys["fold"] != self.fold
        if self.without is not None:
            keep &= keys["holdout"] != self.without
        return keep


def scaling(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 where 0)."""
    got = rows.agg(*[F.avg(F.col(f"`{n}`")) for n in names], *[F.stddev_pop(F.col(f"`{n}`")) for n in names]).first()
    mean, scale = np.array(got[: len(names)], float), np.array(got[len(names) :], float)
    return mean, np.where(scale > 0, scale, 1.0)


def add_up(partials: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors that each partition gives as bytes (part, v)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for f in frames:
            for v in f["v"]:
                total += np.frombuffer(v)
        yield pd.DataFrame({"v": [total.tobytes()]})

    rows = partials.repartition(PARTS, "part").select("v").mapInPandas(run, "v binary").collect()
    return np.sum([np.frombuffer(r["v"]) for r in rows], axis=0) if rows else np.zeros(size)


class Design:
    """The rows of a fit: their features in the scale of all rows with a column of ones, their labels, datasets and folds."""

    def __init__(self, rows: DataFrame, names: list[str], label: str, cached: bool = False, each: int = 0):
        # each: the last feature is an array, with a value for each group that a model may do without
        last = F.col(names[-1]) if each else None
        self.mean, self.scale = scaling(rows.withColumn(names[-1], F.get(last, 0)) if each else rows, names)
        keys = [c for c in ("target", "fold", "holdout") if c in rows.columns]
        # one array instead of as many columns; kept for the passes of the fit and let go behind it, unless the caller keeps the rows
        single = F.array(*[F.col(f"`{n}`").cast("double") for n in (names[:-1] if each else names)])
        self.rows = rows.select((F.concat(single, last) if each else single).alias("x"), F.col(label).cast("double").alias("y"), *keys)
        if not cached:
            self.rows.persist()
        self.size, self.each = len(names) + 1, each

    def sums(self, fits: list[Fit], per_model: int, part) -> np.ndarray:
        """For each model the sum over its rows of part(a, y, k, used): a the features, y the labels, k the models' numbers, used the rows of
        each model among them; a row of `per_model` numbers for each. Models that share most of the rows are taken together."""
        mean, scale, keys, d, each = self.mean, self.scale, self.rows.columns[2:], self.size - 1, self.each
        # models with the same features, and the columns of x that those are
        alike = [(np.array([k for k, m in enumerate(fits) if m.without == t], int), [*range(d - 1), d - 1 + t]) for t in range(each)] if each else [(np.arange(len(fits)), list(range(d)))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((len(fits), per_model)), 0
            for f in batches:
                n = f.num_rows
                if not n:
                    continue
                seen += n
                # an array column is one flat vector of numbers in Arrow
                x = f["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                y = f["y"].to_numpy(zero_copy_only=False)
                own = {c: f[c].to_numpy(zero_copy_only=False) for c in keys}
                used = np.stack([m.uses(own, n) for m in fits], 1)
                shares = used.mean(0)
                for models, columns in alike:
                    if not len(models):
                        continue
                    a = np.hstack([((x[:, columns] if each else x) - mean) / scale, np.ones((n, 1))])
                    if len(some := models[shares[models] >= 0.5]):
                        total[some] += part(a, y, some, used[:, some])
                    for k in models[(shares[models] > 0) & (shares[models] < 0.5)]:
                        total[k] += part(a[used[:, k]], y[used[:, k]], np.array([k]), np.ones((1, 1), bool))[0]
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], ["part", "v"])

        return add_up(self.rows.mapInArrow(run, "part long, v binary"), len(fits) * per_model).reshape(len(fits), per_model)


def moments(a: np.ndarray, y: np.ndarray, k: np.ndarray, used: np.ndarray) -> np.ndarray:
    x = a[:, :-1]
    rows = np.column_stack([np.ones(len(y)), y > 0, x, x * x])
    return np.broadcast_to(used, (len(y), len(k))).astype(float).T @ rows


def one_by_one(part: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Callable[..., np.ndarray]:
    """For Design.sums, part(a, y, k) of one model's own rows."""
    return lambda a, y, ks, used: np.stack([part(a, y, k) if own.all() else part(a[own], y[own], k) for k, own in zip(ks.tolist(), np.broadcast_to(used, (len(y), len(ks))).T)])


def curvature(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each column of q, a.T @ diag(q) @ a as one row."""
    d = a.shape[1]
    if d > PRODUCTS:
        return np.stack([((a * v[:, None]).T @ a).ravel() for v in q.T])
    i, j = np.triu_indices(d)
    out = np.empty((q.shape[1], d, d))
    out[:, i, j] = out[:, j, i] = q.T @ (a[:, i] * a[:, j])
    return out.reshape(len(out), -1)


def lasso_step(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The w that minimizes |w|_1 + g(w - w0) + (w - w0) h (w - w0) / 2, by coordinate descent."""
    out, slope = w.copy(), g.copy()
    for _ in range(1000):
        largest = 0.0
        for j in range(len(w)):
            if h[j, j] <= 0:
                continue
            free = out[j] - slope[j] / h[j, j]
            new = np.sign(free) * max(abs(free) - 1 / h[j, j], 0.0)
            if new != out[j]:
                slope += h[:, j] * (new - out[j])
                largest = max(largest, abs(new - out[j]))
                out[j] = new
        if largest < SETTLED / 100:
            break
    return out


def fit_many(rows: DataFrame, names: list[str], fits: list[Fit], label: str = "label", balanced: bool = True, penalty: str = "l2", steps: int = 50, cached: bool = False, each: int = 0) -> list[dict]:
    """The model of each entry of fits: the weights that minimize the penalty (|w|^2 / 2, or |w|_1) + c * (sum of weighted log losses).

    Features are standardized over the model's own rows. rows: the names, the label, and the columns target and fold where fits name them.
    Every step is one pass for all models that still move (MODELS of them at a time); a step that makes a model worse is halved.
    cached: the rows come from a persisted table, so they need not be kept again. each: the last feature is an array, of which a model takes
    the value at the place of its group `without`.
    """
    if penalty not in ("l1", "l2"):
        raise ValueError(f"Unsupported penalty: {penalty}")
    design = Design(rows, names, label, cached, each)
    try:
        return [m for at in range(0, len(fits), MODELS) for m in _fit_block(design, names, fits[at : at + MODELS], balanced, penalty, steps)]
    finally:
        if not cached:
            design.rows.unpersist()


def _fit_block(design: Design, names: list[str], fits: list[Fit], balanced: bool, penalty: str, steps: int) -> list[dict]:
    d = design.size
    got = design.sums(fits, 2 * d, moments)
    n, ones = got[:, 0], got[:, 1]
    if (ones == 0).any() or (ones == n).any():
        raise ValueError("both classes are needed")
    balance = np.stack([n / (2 * (n - ones)), n / (2 * ones)], 1) if balanced else np.ones((len(fits), 2))
    mean = got[:, 2 : d + 1] / n[:, None]
    spread = np.maximum(got[:, d + 1 :] / n[:, None] - mean**2, 0)
    scale = np.where(spread > CONSTANT, np.sqrt(spread), 1 / design.scale)
    # a @ into[k] are the features in the model's own scale
    into = np.zeros((len(fits), d, d))
    into[:, range(d - 1), range(d - 1)] = 1 / scale
    into[:, d - 1, : d - 1] = -mean / scale
    into[:, d - 1, d - 1] = 1
    w = np.zeros((len(fits), d))
    best, reached = w.copy(), np.full(len(fits), np.inf)
    moving = list(range(len(fits)))
    for _ in range(steps):
        own = np.stack([into[k] @ w[k] for k in moving])
        weights = balance[moving]

        def newton(a: np.ndarray, y: np.ndarray, k: np.ndarray, used: np.ndarray) -> np.ndarray:
            z, one = a @ own[k].T, (y > 0)[:, None]
            e = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1.0, e) / (1 + e)
            of = np.where(one, weights[k, 1], weights[k, 0]) * used
            loss = of * (np.log1p(e) + np.maximum(z, 0) - np.where(one, z, 0))
            return np.hstack([loss.sum(0)[:, None], (of * (p - one)).T @ a, curvature(a, of * p * (1 - p))])

        sums = design.sums([fits[k] for k in moving], 1 + d + d * d, newton)
        left = []
        for k, s in zip(moving, sums):
            c = fits[k].c
            value = c * s[0] + (np.abs(w[k]).sum() if penalty == "l1" else w[k] @ w[k] / 2)
            if value > reached[k] + 1e-10 * max(1.0, abs(reached[k])) and np.abs(w[k] - best[k]).max() > SETTLED:
                w[k] = (w[k] + best[k]) / 2
                left.append(k)
                continue
            best[k], reached[k] = w[k], value
            g, h = c * into[k].T @ s[1 : d + 1], c * into[k].T @ s[d + 1 :].reshape(d, d) @ into[k]
            w[k] = lasso_step(g, h, w[k]) if penalty == "l1" else w[k] - np.linalg.solve(h + np.eye(d), g + w[k])
            if np.abs(w[k] - best[k]).max() >= SETTLED:
                left.append(k)
        moving = left
        if not moving:
            break
    out = []
    for k, f in enumerate(fits):
        out.append({
            "model_type": "pointwise_logistic_regression", "feature_names": names, "scaler_mean": (design.mean + mean[k] * design.scale).tolist(), "scaler_scale": (scale[k] * design.scale).tolist(),
            "coefficients": w[k, :-1].tolist(), "intercept": float(w[k, -1]), "C": f.c, "penalty": penalty,
        })
    return out


def fit(rows: DataFrame, names: list[str], c: float = 1.0, label: str = "label", balanced: bool = True, penalty: str = "l2", steps: int = 50) -> dict:
    """One model of all rows; see fit_many."""
    return fit_many(rows, names, [Fit(c)], label, balanced, penalty, steps)[0]


def linear_score(model: dict) -> Column:
    """The model's decision value as one expression; no Python runs on the rows."""
    out = F.lit(model["intercept"])
    for n, m, s, k in zip(model["feature_names"], model["scaler_mean"], model["scaler_scale"], model["coefficients"]):
        out = out + (F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) - m) / (s or 1.0) * k
    return out


def score_by(models: list[dict], which: Column) -> Column:
    """The decision value by the model with the number that `which` gives, as one expression. The models have the same features."""
    names = models[0]["feature_names"]
    weights = [[k / (s or 1.0) for k, s in zip(m["coefficients"], m["scaler_scale"])] for m in models]
    base = [m["intercept"] - sum(k * x for k, x in zip(w, m["scaler_mean"])) for m, w in zip(models, weights)]
    one = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), which)
    out = one(base)
    for j, n in enumerate(names):
        out = out + F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) * one([w[j] for w in weights])
    return out


def scored(rows: DataFrame, models: list[dict], applies: list[Column], keys: list[str]) -> DataFrame:
    """keys, model (its number) and score of every row by each model that applies to it, in one pass. The models have the same features."""
    names = models[0]["feature_names"]
    mean, coefficients = np.array([m["scaler_mean"] for m in models]), np.array([m["coefficients"] for m in models])
    weights = coefficients / np.array([[s or 1.0 for s in m["scaler_scale"]] for m in models])
    base = np.array([m["intercept"] for m in models]) - (mean * weights).sum(1)
    chosen = F.filter(F.array(*[F.when(use, F.lit(k)) for k, use in enumerate(applies)]), lambda k: k.isNotNull())
    x = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names])
    dealt = rows.select(*keys, x.alias("x"), F.explode(chosen).alias("model"))
    kinds = dict(dealt.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                k = f["model"].to_numpy()
                yield f[[*keys, "model"]].assign(score=(np.stack(f["x"].to_numpy()) * weights[k]).sum(1) + base[k])

    return dealt.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "model")) + ", score double")


def best_of(metrics: list[tuple[int, dict]]) -> int:
    """The number with the best hit_1, then mrr; the first wins ties."""
    return max(metrics, key=lambda x: (x[1]["hit_1"], x[1]["mrr"], -x[0]))[0]


def dev_metrics(dev: DataFrame, models: list[dict], applies: list[Column], k: int = 3) -> dict[int, dict]:
    """Each model's ranking metrics on the dev rows that it applies to, in one pass."""
    rows = scored(dev, models, applies, ["sample_id", "pos", "label"]).withColumn("is_gold", F.col("label") > 0)
    return {r["model"]: r.asDict() for r in M.summary(M.outcomes(rows, k, ("model",)), ("model",)).collect()}


def select(train: DataFrame, dev: DataFrame, names: list[str], c_values: tuple[float, ...] = C_VALUES, k: int = 3, penalty: str = "l2") -> dict:
    """The model of the C with the best dev hit_1, then mrr; the first wins ties. Rows have sample_id, pos, label and the names."""
    models = fit_many(train, names, [Fit(c) for c in c_values], penalty=penalty)
    found = dev_metrics(dev, models, [F.lit(True)] * len(models), k)
    none = {"n": 0, "hit_1": 0.0, "hit_k": 0.0, "mrr": 0.0, "mrr_k": 0.0}
    each = [(i, {n: v for n, v in found.get(i, none).items() if n != "model"}) for i in range(len(models))]
    best = best_of(each)
    return models[best] | {"dev_metrics": each[best][1]}


def out_of_fold(rows: DataFrame, names: list[str], c: float, folds: int) -> DataFrame:
    """sample_id, pos, score: each fold scored by a model of the others, all of them fitted together. rows has the column fold."""
    models = fit_many(rows, names, [Fit(c, fold=f) for f in range(folds)])
    return scored(rows, models, [F.col("fold") == f for f in range(folds)], ["sample_id", "pos"]).select("sample_id", "pos", "score")
