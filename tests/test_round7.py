"""Findings of round 4 about the ranking queries."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarn.operators import ranker, semantic
from tarn.plans import experiments
from tarn.sources import pools


def plan(df):
    return df._jdf.queryExecution().toString().split("Optimized Logical Plan")[1].split("Physical Plan")[0]


def test_terms_of_a_text_stay_in_its_task(spark):
    """a vector was joined to each term of each text, and the terms were dealt out by text; now a text's weights are made where it is."""
    rnd = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rnd.integers(0, 30, n)) for n in (3, 12, 40, 7, 25, 1, 60)] + ["nothing known", ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        # a text that repeats counts once
        model = semantic.fit(table.unionByName(table), rank=5, min_df=2, max_df=1.0, rounds=40)
        encoded = semantic.encode(table, model)
        logical = plan(encoded)
        assert "Join" not in logical and "Aggregate" not in logical and "Window" not in logical and "Generate" not in logical
        got = {r.h: np.array(r.v) for r in encoded.withColumn("h", F.col("h")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # the same in plain numpy
    words = [t.split() for t in texts]
    terms = [Counter([*(x for x in w if len(x) > 1), *(f"{a} {b}" for a, b in zip(w, w[1:]))]) for w in words]
    df = Counter(g for c in terms for g in c)
    known = sorted(g for g, n in df.items() if n >= 2)
    weights = np.array([[(1 + math.log(c[g])) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) if g in c else 0.0 for g in known] for c in terms])
    assert [r.term for r in model.vocabulary.orderBy("term").collect()] == known
    length = np.linalg.norm(weights, axis=1)
    weights[length > 0] /= length[length > 0][:, None]
    vectors = weights @ np.linalg.svd(weights, full_matrices=False)[2][:5].T
    keys = [spark.sql(f"select sha2('{t}', 256)").first()[0] for t in texts]
    assert set(got) == {k for k, n in zip(keys, length) if n > 0}
    own = [i for i, k in enumerate(keys) if k in got]
    found, want = np.stack([got[keys[i]] for i in own]), vectors[own] / np.linalg.norm(vectors[own], axis=1)[:, None]
    assert np.allclose(found @ found.T, want @ want.T, atol=1e-6)


def test_training_rows_are_read_once_for_all_holdouts(spark, sf, monkeypatch):
    """every pass read a training row once for each target."""
    x = pools.lineitem_pools(spark, sf).where("sample_id % 7 < 3")
    features = x.select("sample_id", "pos", "path", "a", "b", F.col("hunk").cast("double").alias("line"), F.col("is_gold").cast("int").alias("label"))
    k = F.col("sample_id")
    kind = F.element_at(F.array(*map(F.lit, ["x", "y", "z", None])), (k % 4 + 1).cast("int"))
    samples = features.select("sample_id").distinct().select(k, kind.alias("kind"), F.when(k % 5 == 0, "test").when(k % 5 == 1, "dev").otherwise("train").alias("split"), (k % 3).cast("int").alias("fold"))
    rows, own = [], ranker.Design

    class Counted(own):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            rows.append(self.rows.count())

    monkeypatch.setattr(ranker, "Design", Counted)
    got = experiments.nested_holdout(features, samples, "kind", ["x", "y", "z"], 3, ("a", "b"), ("b", "line"), "raw", (0.5,))
    train = features.join(samples.where("split = 'train'"), "sample_id")
    assert rows == [train.count()] * 3
    for i, target in enumerate(("x", "y", "z")):
        inside = F.col("kind").eqNullSafe(F.lit(target))
        anchor = got["anchor"].where(F.col("target") == target).select("sample_id", "pos", F.col("score").alias("anchor_score"))
        full = train.where(~inside).join(anchor, ["sample_id", "pos"])
        want = ranker.fit(full, ["b", "line", "anchor_score"], 0.5)
        model = got["models"][target]
        assert model["feature_names"] == want["feature_names"]
        assert np.allclose([*model["coefficients"], model["intercept"]], [*want["coefficients"], want["intercept"]], atol=1e-6)
    # a score that lacks, one that is there twice, one of a candidate that the holdout doesn't use
    whole = got["anchor"].where("target = 'x'").persist()
    some = {r.split: r for r in whole.groupBy("split").agg(F.min(F.struct("sample_id", "pos")).alias("k")).collect()}
    is_ = lambda s: (F.col("sample_id") == some[s].k.sample_id) & (F.col("pos") == some[s].k.pos)
    odd = whole.where(~is_("train")).unionByName(whole.where(is_("dev"))).unionByName(whole.where(is_("test")).withColumn("pos", F.lit(999)))
    cover = {r.split: r for r in experiments.anchor_coverage(odd, features, samples, "kind", ["x"]).collect()}
    assert {s: (r.missing, r.repeated) for s, r in cover.items()} == {"train": (1, 0), "dev": (0, 1), "test": (0, 0), None: (0, 1)}
    due = {r.split: (r.n, r.c) for r in whole.groupBy("split").agg(F.count_distinct("sample_id").alias("n"), F.count("*").alias("c")).collect()}
    assert {s: (cover[s].samples, cover[s].candidates) for s in due} == due and (cover[None].samples, cover[None].candidates) == (1, 1)
