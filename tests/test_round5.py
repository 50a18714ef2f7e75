"""Steps of the ranking queries that must not hold or move more than their tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.operators import diffs, metrics, splits, validate
from tarn.plans import experiments, more
from tarn.sources import pools


def plan(df):
    return df._jdf.queryExecution().toString()


def test_hunks_are_cut_inside_their_patch(spark):
    """no row per line of a patch, so nothing is sorted or spilled but the hunks."""
    odd = "+++ b/first\x0b@@ -1 +2,3 @@\r\n--- x\n\ndiff --git a/x\n+++ /dev/null\r@@ bad\n c\ndiff --git a/q b/q\n--- \n@@ -4,5 +6 @@\n+z"
    patches = spark.createDataFrame([("p", odd), ("n", None), ("e", ""), ("w", "no hunk\n+x")], "instance_id string, patch string")
    found = diffs.hunks(patches)
    optimized = plan(found).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert optimized.count("Window [") == 1 and "Aggregate" not in optimized
    got = [tuple(r) for r in found.orderBy("ord").select("instance_id", "ord", "path", "header", "old_start", "new_count", "context_id", "text").collect()]
    assert got == [
        ("p", 1, "first", "@@ -1 +2,3 @@", 1, 3, "first::hunk_1", "path: first\n@@ -1 +2,3 @@\n--- x"),
        ("p", 2, "unknown", "@@ bad", 0, 0, "unknown::hunk_1", "path: unknown\n@@ bad\n c"),
        ("p", 3, "q", "@@ -4,5 +6 @@", 4, 1, "q::hunk_1", "path: q\n@@ -4,5 +6 @@\n+z"),
    ]
    assert [r.context_id for r in diffs.hunks(patches, "patch").orderBy("ord").collect()][1] == "unknown::hunk_2"


def test_router_rows_are_one_pass_over_the_pools(spark, sf):
    """the rankers share the pools, and their outcomes and leads one sort."""
    table, _ = more.router_rows(spark, sf)
    physical = plan(table).split("Physical Plan")[1]
    assert physical.count("lineitem.parquet") == 1
    logical = plan(table).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    # the order of the lines and the rank of the scores
    assert logical.count("Window [") == 2 and logical.count("Join ") == 1


def test_nested_holdout_joins_no_scores(spark, sf):
    """rows are kept once for all holdouts, and scores are not joined back to them."""
    spark.catalog.clearCache()
    x = pools.lineitem_pools(spark, sf).where("sample_id % 7 < 2")
    features = x.select("sample_id", "pos", "path", "a", "b", F.col("is_gold").cast("int").alias("label"))
    k = F.col("sample_id")
    samples = features.select("sample_id").distinct().select(k, F.when(k % 2 == 0, "x").otherwise("y").alias("kind"), F.when(k % 5 == 0, "test").when(k % 5 == 1, "dev").otherwise("train").alias("split"), (k % 3).cast("int").alias("fold"))
    got = experiments.nested_holdout(features, samples, "kind", ["x", "y"], 3, ("a",), ("b",), "raw", (0.5,))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 1
    logical = plan(got["scores"]).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    # the kept rows alone
    assert "InMemoryRelation" in logical and "Join" not in logical.split("InMemoryRelation")[0]
    assert got["anchor"].where("score is null").count() == 0


def test_stale_predictions_are_found_in_one_pass(spark, sf):
    """both rankings of a pool come from one pass over the lines, and no list is longer than it has to be."""
    got = more.stale_predictions(spark, sf)
    assert plan(got).split("Physical Plan")[1].count("lineitem.parquet") == 1
    x = pools.lineitem_pools(spark, sf)
    a, b = (metrics.rankings(x.withColumn("score", F.col(c)), n) for c, n in (("a", None), ("b", 2)))
    want = validate.stale_predictions(a, b.withColumnRenamed("ranked_context_ids", "predicted_context_ids_topk"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_label_is_split_in_slices(spark):
    """no window holds all rows of a label; the split is that of a numbering of the whole label."""
    rows = spark.range(3000).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 < 2, "a").when(F.col("id") == 2, "rare").otherwise("b").alias("label"))
    got = splits.stratified_split(rows, "label", 5)
    logical = plan(got).split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert "row_number" in logical and all("slice_" in x for x in logical.splitlines() if "row_number() windowspec" in x)
    w = Window.partitionBy("label")
    k, n = F.row_number().over(w.orderBy(splits.draw(5, "sample_id"), "sample_id")), F.count("*").over(w)
    numbered = {r.sample_id: (r.k, r.n) for r in rows.select("sample_id", k.alias("k"), n.alias("n")).collect()}
    found = got.collect()
    assert got.columns == ["sample_id", "label", "split"] and len(found) == 3000
    for r in found:
        k, n = numbered[r.sample_id]
        train, dev = max(1, n * 7 // 10), max(1, n // 10)
        if train + dev >= n:
            train, dev = max(1, n - 2), 1
        assert r.split == ("train" if k <= train else "dev" if k <= train + dev else "test")
