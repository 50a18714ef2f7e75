"""Ranking and classification metrics, slices and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import groupwise as G


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", G.rank(F.col("score")))


def ranked_by(scores: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return scores.withColumn("rank", G.rank(F.col("score"), (*by, "sample_id")))


def rankings(scores: DataFrame, k: int | None = None) -> DataFrame:
    """sample_id, ranked_context_ids in order, all of them or the first k."""
    r = ranked(scores)
    r = r if k is None else r.where(F.col("rank") <= k)
    return r.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context_id"))), lambda x: x["context_id"]).alias("ranked_context_ids"))


def first_contexts(scores: DataFrame, columns: tuple[str, ...], k: int) -> DataFrame:
    """sample_id and for each score column the first k context_ids by it, in order; one pass over the pools for all of them."""
    r = scores.select("sample_id", "context_id", *[G.rank(F.col(c)).alias(c) for c in columns]).where(" or ".join(f"`{c}` <= {int(k)}" for c in columns))
    firsts = [F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= k, F.struct(c, "context_id")))), lambda x: x["context_id"]).alias(c) for c in columns]
    return r.groupBy("sample_id").agg(*firsts)


def outcomes(scores: DataFrame, k: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Per sample: first_rank of a gold candidate (0: none), hit_1, hit_k, rr, rr_k. scores has sample_id, pos, score, is_gold."""
    keys = [*by, "sample_id"]
    r = ranked_by(scores, by)
    first = r.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("is_gold"), F.col("rank"))), F.lit(0)).alias("first_rank"), F.count("*").alias("candidates"))
    return first.select(*keys, "candidates", *outcome_columns(k))


def outcome_columns(k: int) -> list[Column]:
    f = F.col("first_rank")
    inside = (f >= 1) & (f <= k)
    return [f, (f == 1).cast("int").alias("hit_1"), inside.cast("int").alias("hit_k"), F.when(f > 0, 1 / F.greatest(f, F.lit(1))).otherwise(0.0).alias("rr"), F.when(inside, 1 / F.greatest(f, F.lit(1))).otherwise(0.0).alias("rr_k")]


def summary(per_sample: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, hit_1, hit_k, mrr, mrr_k; an empty table has one row of zeros where there are no keys."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_sample.groupBy(*by).agg(F.count("*").alias("n"), mean("hit_1").alias("hit_1"), mean("hit_k").alias("hit_k"), mean("rr").alias("mrr"), mean("rr_k").alias("mrr_k"))


def diagnostics(per_sample: DataFrame, k: int = 3) -> DataFrame:
    """Pool sizes, samples whose gold is beyond k or missing, and the full against the cut reciprocal rank."""
    f = F.col("first_rank")
    return per_sample.agg(F.min("candidates").alias("min_candidates"), F.percentile("candidates", 0.5).alias("median_candidates"), F.max("candidates").alias("max_candidates"), F.sum("candidates").alias("total_candidates"), F.count_if(f > k).alias("beyond_k"), F.count_if(f == 0).alias("without_gold"), F.avg("rr").alias("mrr"), F.avg("rr_k").alias("mrr_k"))


def slices(per_sample: DataFrame, axes: dict[str, Column], min_samples: int = 1) -> DataFrame:
    """axis, label, n, hit_1, hit_k, mrr for each value of each axis, of those with enough samples."""
    rows = per_sample.select("hit_1", "hit_k", "rr", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("label")) for a, c in axes.items()])).alias("s"))
    out = rows.groupBy("s.axis", "s.label").agg(F.count("*").alias("n"), F.avg("hit_1").alias("hit_1"), F.avg("hit_k").alias("hit_k"), F.avg("rr").alias("mrr"))
    return out.where(F.col("n") >= min_samples)


def compare(base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("axis", "label")) -> DataFrame:
    """Differences of the metrics over the slices that both have."""
    metric = ["hit_1", "hit_k", "mrr"]
    b = base.select(*keys, *[F.col(m).alias(f"{m}_base") for m in metric])
    return new.join(b, list(keys)).select(*keys, "n", *[(F.col(m) - F.col(f"{m}_base")).alias(f"{m}_delta") for m in metric])


def best_system(results: DataFrame, by: str = "hit_1") -> DataFrame:
    """The system with the highest metric; the first one wins ties (column ord)."""
    return results.orderBy(F.col(by).desc(), F.col("ord").asc()).limit(1)


def classification(predictions: DataFrame) -> DataFrame:
    """accuracy, macro_f1, weighted_f1 of rows (gold, pred), over the labels of both; a label without hits has F1 0."""
    counts = predictions.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    each = counts.select("n", F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col("gold") == F.col("pred")).alias("hit"))
    label = each.groupBy("x.label").agg(F.sum(F.col("n") * F.col("x.g")).alias("support"), F.sum(F.col("n") * F.col("x.p")).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.g")).otherwise(0)).alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    total = label.withColumn("f1", f1).agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"))
    return total.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


def averages(targets: DataFrame, metrics: list[str], weight: str = "test_samples") -> DataFrame:
    """metric, macro, weighted: plain means over the targets, and means weighted by their samples."""
    rows = targets.select(weight, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    return rows.groupBy("x.metric").agg(F.avg("x.v").alias("macro"), F.try_divide(F.sum(F.col("x.v") * F.col(weight)), F.sum(weight)).alias("weighted"))


def spread(values: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """mean, deviation of the sample (0 for fewer than two) and both medians: interpolated and upper."""
    v = F.col(value)
    return values.groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.when(F.count(v) > 1, F.stddev_samp(v)), F.lit(0.0)).alias("stdev"), F.percentile(v, 0.5).alias("median"), F.element_at(F.array_sort(F.collect_list(v)), (F.count(v) / 2).cast("int") + 1).alias("upper_median"))


def failures(per_sample: DataFrame, n: int, order: str = "sample_id") -> DataFrame:
    """The first n samples whose best candidate is not gold."""
    return per_sample.where("hit_1 = 0").orderBy(order).limit(n)


def coefficients(model: dict, spark) -> DataFrame:
    """feature, coefficient, by falling size."""
    rows = list(zip(model["feature_names"], model["coefficients"]))
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.abs("coefficient").desc())


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def usage(df: DataFrame, column: str) -> DataFrame:
    """value, n, share of the values of a column."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def dataset_stats(candidates: DataFrame) -> DataFrame:
    """samples, total_contexts, avg_contexts_per_sample of a candidate table; zeros for an empty one."""
    each = candidates.groupBy("sample_id").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(F.count("*").alias("samples"), total.alias("total_contexts"), F.coalesce(F.try_divide(total, F.count("*")), F.lit(0.0)).alias("avg_contexts_per_sample"))


def test_metrics(result: dict) -> dict[str, float]:
    """hit@1, hit@3 and mrr of a result: from retrieval_test, else test, else the test part of best."""
    places = (result.get("retrieval_test"), result.get("test"), (result.get("best") or {}).get("test"))
    found = next((p for p in places if p is not None), None)
    if found is None:
        raise KeyError("no test metrics in the result")
    return {k: float(found[k]) for k in ("hit@1", "hit@3", "mrr")}
