"""A multinomial logistic classifier, fitted for several C values together, and a router that picks one of several rankers with it.

The data stays in Spark: a Newton step is one pass for all C values that still move, which sums loss, gradient and Hessian. What
comes to the driver are matrices of (classes x features) squared, so this is meant for some hundred of classes x features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groupwise as G
from . import metrics as M
from . import ranker, routing

C_VALUES = (0.1, 0.25, 0.5, 1.0, 2.0)
SETTLED = 1e-8


def probabilities(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = a @ w.T
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_many(rows: DataFrame, names: list[str], classes: list[str], c_values: tuple[float, ...] = C_VALUES, label: str = "label", balanced: bool = True, steps: int = 100) -> list[dict]:
    """A model for each C: the weights that minimize |w|^2 / 2 + C * (sum of weighted log losses).

    Features are standardized over the rows, a constant one counts 0; nulls count 0 before that. Intercepts are not penalized and sum
    up to 0. Balanced weights give each class that occurs the same sum. Classes without a row get no model; at least two need rows.
    With two of them the penalty counts the difference of their weights, as a binary model does. Labels that aren't in classes fail.
    """
    place = F.element_at(F.create_map(*[x for i, k in enumerate(classes) for x in (F.lit(k), F.lit(i))]), F.col(label))
    filled = rows.select(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias(n) for n in names], F.coalesce(place, F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(label), F.lit("null")))).cast("int")).alias("label"))
    design = ranker.Design(filled, names, "label")
    try:
        return _fit(design, names, classes, c_values, balanced, steps)
    finally:
        design.rows.unpersist()


def _fit(design: ranker.Design, names: list[str], classes: list[str], c_values: tuple[float, ...], balanced: bool, steps: int) -> list[dict]:
    counted = design.sums([ranker.Fit()], len(classes), ranker.one_by_one(lambda a, y, _: np.bincount(y.astype(int), minlength=len(classes)).astype(float)))[0]
    seen = [i for i, n in enumerate(counted) if n > 0]
    if len(seen) < 2:
        raise ValueError("at least two classes need rows")
    k, d, n = len(seen), design.size, counted[seen]
    weight = np.zeros(len(classes))
    weight[seen] = n.sum() / (k * n) if balanced else 1.0
    at = np.zeros(len(classes), int)
    at[seen] = range(k)
    # the penalty of each weight; the last of each class is its intercept
    ridge = np.tile(np.r_[np.full(d - 1, 2.0 if k == 2 else 1.0), 0.0], k)
    # equal intercepts change nothing, this keeps their sum at 0
    level = np.zeros(k * d)
    level[d - 1 :: d] = 1.0
    w = np.zeros((len(c_values), k * d))
    best, reached, moving = w.copy(), np.full(len(c_values), np.inf), list(range(len(c_values)))
    for _ in range(steps):
        own = [w[m].reshape(k, d) for m in moving]

        def newton(a: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
            y = y.astype(int)
            p, of = probabilities(a, own[m]), weight[y]
            hit = np.zeros_like(p)
            hit[np.arange(len(y)), at[y]] = 1.0
            loss = -(of * np.log(np.maximum((p * hit).sum(1), 1e-300))).sum()
            h = np.empty((k, d, k, d))
            for i in range(k):
                for j in range(i + 1):
                    h[i, :, j, :] = (a * (of * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a
                    h[j, :, i, :] = h[i, :, j, :].T
            return np.concatenate([[loss], ((of[:, None] * (p - hit)).T @ a).ravel(), h.ravel()])

        left = []
        for m, s in zip(moving, design.sums([ranker.Fit()] * len(moving), 1 + k * d + (k * d) ** 2, ranker.one_by_one(newton))):
            c = c_values[m]
            value = c * s[0] + (ridge * w[m] ** 2).sum() / 2
            if value > reached[m] + 1e-10 * max(1.0, abs(reached[m])) and np.abs(w[m] - best[m]).max() > SETTLED:
                w[m] = (w[m] + best[m]) / 2
                left.append(m)
                continue
            best[m], reached[m] = w[m], value
            h = c * s[1 + k * d :].reshape(k * d, k * d) + np.diag(ridge) + np.outer(level, level)
            w[m] = w[m] - np.linalg.solve(h, c * s[1 : 1 + k * d] + ridge * w[m])
            if np.abs(w[m] - best[m]).max() >= SETTLED:
                left.append(m)
        moving = left
        if not moving:
            break
    kept = {"model_type": "multinomial_logistic_regression", "feature_names": names, "scaler_mean": design.mean.tolist(), "scaler_scale": design.scale.tolist(), "classes": [classes[i] for i in seen]}
    return [kept | {"C": c, "coefficients": x.reshape(k, d)[:, :-1].tolist(), "intercepts": x.reshape(k, d)[:, -1].tolist()} for c, x in zip(c_values, w)]


def choices(models: list[dict]) -> Column:
    """An array of (C, best), for each model its class of the largest value, the first of equal ones. The models have the same features.

    The weights are one literal and the features one array, so the expression stays small for any number of models and classes."""
    names = models[0]["feature_names"]
    each = []
    for m in models:
        w = np.array(m["coefficients"]) / np.array([s or 1.0 for s in m["scaler_scale"]])
        base = np.array(m["intercepts"]) - w @ np.array(m["scaler_mean"])
        own = [F.struct(F.lit(k).alias("k"), F.lit(float(b)).alias("b"), F.array(*[F.lit(float(v)) for v in x]).alias("w")) for k, b, x in zip(m["classes"], base, w)]
        each.append(F.struct(F.lit(float(m["C"])).alias("C"), F.array(*own).alias("classes")))
    x = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names])
    value = lambda c: F.aggregate(F.zip_with(x, c["w"], lambda u, v: u * v), c["b"], lambda a, v: a + v)
    best = lambda m: F.array_max(F.transform(m["classes"], lambda c, i: F.struct(value(c).alias("v"), (-i).alias("i"), c["k"].alias("k"))))["k"]
    return F.transform(F.array(*each), lambda m: F.struct(m["C"].alias("C"), best(m).alias("best")))


def predicted(model: dict) -> Column:
    return choices([model])[0]["best"]


def strongest(model: dict, n: int = 12) -> dict[str, list[tuple[str, float]]]:
    """Per class the n features of the largest absolute weight."""
    return {k: sorted(zip(model["feature_names"], w), key=lambda x: -abs(x[1]))[:n] for k, w in zip(model["classes"], model["coefficients"])}


# ---- choosing one of several rankers ----------------------------------------


def router_table(meta: DataFrame, scores: DataFrame, models: list[str], k: int = 3) -> tuple[DataFrame, list[str]]:
    """One row per sample and the features' names: meta's columns and routing.model_features, label (the best ranker; the first of
    models wins ties) and outcomes, a map from ranker to hit_1, hit_k, rr, rr_k.

    meta: sample_id and numbers. scores: model, sample_id, pos, context_id, score, is_gold, every ranker for every sample."""
    own = F.struct("hit_1", "hit_k", "rr", "rr_k")
    # one sort of the scores gives both the outcomes and the leads
    ranked = M.ranked_by(scores.select("model", "sample_id", "pos", "context_id", "score", "is_gold"), ("model",))
    first = ranked.groupBy("model", "sample_id").agg(F.coalesce(F.min(F.when(F.col("is_gold"), F.col("rank"))), F.lit(0)).alias("first_rank"), *G.lead_columns(F.col("rank")))
    lead = F.struct("top_id", "top", G.margin("zero").alias("margin"))
    both = first.select("model", "sample_id", *M.outcome_columns(k), lead.alias("lead")).groupBy("sample_id")
    found = both.agg(F.map_from_entries(F.collect_list(F.struct("model", own))).alias("outcomes"), F.map_from_entries(F.collect_list(F.struct("model", "lead"))).alias("leads"))
    order = F.array(*[F.struct(F.col("outcomes")[m]["hit_1"].alias("a"), F.col("outcomes")[m]["rr"].alias("b"), F.col("outcomes")[m]["hit_k"].alias("c"), F.lit(-i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(models)])
    pairs = found.where(routing.all_led(models)).select("sample_id", "outcomes", *routing.lead_features(models))
    names = sorted([c for c in (*meta.columns, *pairs.columns) if c not in ("sample_id", "outcomes")])
    table = meta.join(pairs, "sample_id").withColumn("label", F.array_max(order)["m"])
    return table.select("sample_id", "label", "outcomes", *[F.col(f"`{n}`").cast("double").alias(n) for n in names]), names


def routed(table: DataFrame, models: list[dict], keys: tuple[str, ...] = ()) -> DataFrame:
    """C, keys, sample_id, best (the chosen ranker) and its outcome, for every fitted model, in one pass over router_table's rows."""
    x = table.select(*keys, "sample_id", "outcomes", F.explode(choices(models)).alias("r")).select("r.C", *keys, "sample_id", "r.best", F.col("outcomes")[F.col("r.best")].alias("o"))
    return x.select("C", *keys, "sample_id", "best", "o.*")


def usage(rows: DataFrame, rankers: list[str], keys: tuple[str, ...]) -> DataFrame:
    """keys, n, hit_1, hit_k, mrr, mrr_k and usage_<ranker>, the number of samples that each ranker was chosen for."""
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col("best") == r).alias(f"usage_{r}") for r in rankers])
    return M.summary(rows, keys).join(counts, list(keys))


def select_router(table: DataFrame, names: list[str], rankers: list[str], c_values: tuple[float, ...] = C_VALUES) -> tuple[dict, DataFrame]:
    """The model of the C with the best hit_1, then mrr, then hit_k on the dev samples (the first of equal ones), and the figures of
    every C on every split. table: router_table with the column split; the model is fitted on 'train'."""
    table = table.persist()
    try:
        fitted = fit_many(table.where("split = 'train'"), names, rankers, c_values)
        report = usage(routed(table, fitted, ("split",)), rankers, ("C", "split"))
        # a row for each C and split
        rows = report.collect()
    finally:
        table.unpersist()
    dev = {r["C"]: (r["hit_1"], r["mrr"], r["hit_k"]) for r in rows if r["split"] == "dev"}
    return max(fitted, key=lambda m: dev.get(m["C"], (0.0, 0.0, 0.0))), table.sparkSession.createDataFrame(rows, report.schema)
