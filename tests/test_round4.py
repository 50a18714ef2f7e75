"""Findings of round 3 about the ranking operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import lexical, semantic


@pytest.mark.parametrize("analyzer", ["word", "char_wb"])
def test_tfidf_of_small_and_large_pools(spark, monkeypatch, analyzer):
    """a pool of bounded size is one row; larger ones are dealt out by term. Both give the same cosines."""
    samples = spark.createDataFrame([("a", "Fix the Größe of x"), ("b", None), ("c", "alone here"), ("d", "𝒳 the end")], "sample_id string, comment string")
    texts = [("a", 1, "the größe is fixed  the end"), ("a", 2, ""), ("a", 3, None), ("b", 1, "some text"), ("d", 7, "the 𝒳 end"), ("d", 9, "x"), ("e", 1, "no sample")]
    candidates = spark.createDataFrame(texts, "sample_id string, pos int, text string")
    got = []
    for most in (256, 3, 0):
        monkeypatch.setattr(lexical, "POOL_TEXTS", most)
        got.append({(r.sample_id, r.pos): round(r.t, 12) for r in lexical.tfidf(samples, candidates, analyzer, "t").collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == len(texts)
    assert got[0]["a", 1] > 0 and got[0]["a", 2] == got[0]["b", 1] == 0
    assert lexical.tfidf(samples, candidates.where(F.lit(False)), analyzer, "t").count() == 0


def test_a_pass_over_the_weights_has_a_fixed_number_of_tasks(spark, monkeypatch):
    """what a pass shuffles is a vector for each term and task, so the tasks may not grow in number with the texts."""
    parts, own = [], semantic.gram_times
    monkeypatch.setattr(semantic, "gram_times", lambda w, b: parts.append(w.rdd.getNumPartitions()) or own(w, b))
    rnd = np.random.default_rng(1)
    texts = [(" ".join(f"w{i}" for i in rnd.integers(0, 40, 12)),) for _ in range(120)]
    semantic.fit(spark.createDataFrame(texts, "text string"), rank=4, rounds=2)
    assert parts == [semantic.PASSES] * 2
    rows = [(str(h), int(i), float(w)) for h in range(30) for i, w in zip(rnd.permutation(20)[:7], rnd.random(7))]
    basis, dense = rnd.random((20, 3)), np.zeros((30, 20))
    for h, i, w in rows:
        dense[int(h), i] = w
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = own(spark.createDataFrame(rows, "h string, i int, w double").repartition(4, "h").sortWithinPartitions("h"), basis)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(got, dense.T @ (dense @ basis))
