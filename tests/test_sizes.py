"""Steps whose tasks must not grow with their tables."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tarn.operators import grid, scores, stats
from tarn.operators import metrics as M
from tarn.plans import queries
from tarn.sources import pools


def test_line_pools_are_dealt_by_their_rows(spark, sf, monkeypatch):
    names = ("relative_columns", "feature_matrix", "top_rerank", "normalizations", "feedback_contexts")
    want = {n: sorted(map(tuple, queries.QUERIES[n](spark, sf).collect())) for n in names}
    n = pools.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(pools, "ROWS", 100)
    rows = pools.lineitem_pools(spark, sf)
    assert rows.rdd.getNumPartitions() == -(-n // 100)
    assert {n: sorted(map(tuple, queries.QUERIES[n](spark, sf).collect())) for n in names} == want


def test_grids_of_equal_pools(spark):
    rnd = np.random.default_rng(3)
    axes = (grid.SOURCES, grid.MODES, grid.ALPHAS, grid.TOP_FILES, grid.PENALTIES)
    for n in (1, 2, 5, 9):
        score, other = (rnd.integers(0, 6, (50, n)) / 4 for _ in "ab")
        path, gold = rnd.integers(0, 3, (50, n)), rnd.random((50, n)) < 0.3
        got = {at: ranks for at, ranks in grid.equal_pool_ranks(score, other, path, gold, axes, 9)}
        for p in range(50):
            want, _ = grid.pool_ranks(score[p], other[p], path[p].astype(str), gold[p], axes, 9)
            assert all((want[at] == ranks[p]).all() for at, ranks in got.items())


def test_grid_copies_no_rows(spark):
    rows = [(i, p, x, float(p % 3), p == i % 5) for i in range(60) for p, x in enumerate([1.0, None, float("nan"), 0.5, 1.0][: 1 + i % 5])]
    df = spark.createDataFrame(rows, "sample_id long, pos int, a double, b double, is_gold boolean")
    got = scores.two_way_grid(df, (0.0, 0.5), ("raw",))
    assert "Generate" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        want = M.summary(M.outcomes(df.withColumn("score", F.col("a") + r.weight * F.col("b")))).first()
        assert np.allclose(tuple(r)[2:], tuple(want), atol=1e-12)
    routed = {r.condition: tuple(r)[1:] for r in scores.route_grid(df, {"b": F.col("sample_id") > 30}).collect()}
    want = M.summary(M.outcomes(df.withColumn("score", F.when(F.col("sample_id") > 30, F.col("b")).otherwise(F.col("a"))))).first()
    assert np.allclose(routed["b"], tuple(want), atol=1e-12)


def test_statistics_share_the_digests_of_a_cluster(spark):
    own = [(f"c{i}" * (1 + 19 * (i == 7)) if i else None, float(i % 5 - 2), (i % 3) / 2, 1 + i % 4) for i in range(90)]
    df = spark.createDataFrame(own, "key string, u double, v double, n long")
    md5 = lambda key, block, seed: hashlib.md5(f"{key or ''}|{block}|{seed}".encode()).hexdigest()
    plan = stats.resampled(df, ["u", "v"], 50, 7)
    assert "Generate" not in plan._jdf.queryExecution().toString()
    got = {r.resample: (r.u, r.v) for r in plan.collect()}
    for s in range(50):
        u = [int(md5(k, s // 4, 7)[8 * (s % 4) :][:8], 16) / 2**32 for k, *_ in own]
        times = [sum(x >= p for p in stats.POISSON) for x in u]
        n = sum(t * r[3] for t, r in zip(times, own))
        assert np.allclose(got[s], [sum(t * r[c] for t, r in zip(times, own)) / n for c in (1, 2)])
    turned = {r.flip: r.u for r in stats.flipped(df, ["u", "v"], 300, 8).collect()}
    for f in range(300):
        sign = [1 if int(md5(k, f // 128, 8)[f % 128 // 4], 16) >> f % 4 & 1 else -1 for k, *_ in own]
        assert abs(turned[f] - sum(x * r[1] for x, r in zip(sign, own)) / sum(r[3] for r in own)) < 1e-9
    both = stats.comparisons(df, {"x": "u", "y": "v"}, 50, 300, 7).collect()
    assert [r.metric for r in both] == ["x", "y"] and all(r.ci_low <= r.ci_high and 0 < r.p_value <= 1 for r in both)
