"""Operators without a query of their own: caches, saved models, searches, holdouts that fit everything anew."""

import pytest
from pyspark.sql import functions as F

from tarn.operators import lexical, metrics, semantic, stats
from tarn.plans import experiments
from tarn.sources import files, ingest, pools


def test_metrics_of_results():
    m = {"hit@1": 1, "hit@3": 2, "mrr": 0.5, "more": 3}
    want = {"hit@1": 1.0, "hit@3": 2.0, "mrr": 0.5}
    assert metrics.test_metrics({"retrieval_test": m, "test": {}}) == metrics.test_metrics({"test": m}) == metrics.test_metrics({"best": {"test": m}}) == want
    with pytest.raises(KeyError):
        metrics.test_metrics({"best": {"dev": m}})


def test_dataset_stats_of_nothing(spark):
    assert metrics.dataset_stats(spark.createDataFrame([], "sample_id string")).first().asDict() == {"samples": 0, "total_contexts": 0, "avg_contexts_per_sample": 0.0}


def test_toy_samples_and_feature_rows(spark, tmp_path):
    toy = ingest.toy_samples(spark)
    assert {r.split for r in toy.collect()} == {"train", "dev", "test"} and toy.where(F.size("contexts") != 3).count() == 0
    candidates = files.candidates_of(toy)
    f = lexical.overlap_features(toy, candidates).join(candidates, ["sample_id", "pos"])
    names = ["line_overlap", "lexical_overlap"]
    files.write_feature_rows(f, str(tmp_path / "rows"), names)
    back = files.read_feature_rows(spark, str(tmp_path / "rows"), names)
    columns = ["sample_id", "pos", "context_id", "text", *names]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, f.select(columns).collect()))
    # the toy pools are enough to train on
    split = toy.select("sample_id", "split")
    rows = lexical.base_features(toy, candidates).join(candidates.select("sample_id", "pos", "path" if "path" in candidates.columns else F.lit("p").alias("path"), F.col("is_gold").cast("int").alias("label")), ["sample_id", "pos"])
    subsets = experiments.feature_subsets(["bm25", "word_tfidf"], 1, 2, ("bm25",))
    assert subsets == [("bm25",), ("bm25", "word_tfidf")]
    options = {"transform": "raw_plus_relative", "c_values": (1.0,)}
    got = experiments.subset_search(rows, split, ("lexical_overlap",), subsets, str(tmp_path / "search"), **options)
    assert {r.name for r in got.collect()} == {"bm25", "bm25+word_tfidf"}
    assert experiments.subset_search(rows, split, ("lexical_overlap",), subsets, str(tmp_path / "search"), **options).count() == 2
    with pytest.raises(KeyError):
        experiments.feature_subsets(["a"], 1, 1, ("b",))


def test_models_are_read_back(spark, sf, tmp_path):
    model = {"feature_names": ["a"], "scaler_mean": [0.0], "scaler_scale": [1.0], "coefficients": [2.0], "intercept": 0.5, "C": 1.0}
    assert files.read_model(files.model_json(model)) == model
    with pytest.raises(ValueError):
        files.read_model(files.model_json(model | {"coefficients": []}))
    samples, candidates = pools.conversation_pools(spark, sf)
    fitted = semantic.fit(semantic.corpus(samples, candidates), rank=4)
    semantic.save(fitted, str(tmp_path / "vectors"))
    inputs = experiments.semantic_inputs(samples, candidates)
    a, b = (sorted(map(tuple, semantic.score(*inputs, m).select("sample_id", "pos", F.round("score", 9)).collect())) for m in (fitted, semantic.load(spark, str(tmp_path / "vectors"))))
    assert a == b and a


def test_reports(spark):
    rows = spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "name string, score double")
    assert files.markdown_table(rows, 2) == "| name | score |\n| --- | --- |\n| a\\|b | 0.50 |\n|  | 1.00 |\n"


def test_statistics_over_single_samples(spark):
    a = spark.createDataFrame([(i, i % 2, "g") for i in range(40)], "sample_id long, hit_1 int, group_key string")
    b = a.withColumn("hit_1", F.lit(1))
    got = stats.sample_summary(a, ("hit_1",), 200).first()
    assert got.metric == "hit_1" and got["mean"] == 0.5 and got.ci_low < 0.5 < got.ci_high
    assert stats.sample_comparison(a, b, "hit_1", samples=200, flips=400).first().p_value < 0.05


def test_holdout_fits_nothing_on_its_target(spark, sf, monkeypatch):
    samples, candidates = pools.conversation_pools(spark, sf)
    k = F.col("sample_id").cast("long")
    s = samples.withColumns({"split": F.element_at(F.array(*map(F.lit, ("train", "train", "dev", "test"))), (k % 4 + 1).cast("int")), "domain": F.when(k % 3 == 0, "x").otherwise("y"), "fold": (k % 2).cast("int")})
    seen = []
    whole = semantic.corpus
    monkeypatch.setattr(semantic, "corpus", lambda a, b: (seen.append({r.sample_id for r in a.select("sample_id").collect()}), whole(a, b))[1])
    got = experiments.refit_holdout(s, candidates, "domain", "x", transform="raw_plus_relative", c_values=(1.0,))
    target = {r.sample_id for r in s.where("domain = 'x'").collect()}
    assert got["target"] == "x" and got["n"] > 0 and not seen[0] & target
    seen.clear()
    scored = experiments.out_of_fold_semantic(s, candidates, 2)
    assert not seen[0] & seen[1] and scored.count() == candidates.count()
