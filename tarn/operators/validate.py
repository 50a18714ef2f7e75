"""Checks of datasets, scores and rankings. Each returns the offending rows or their counts; require() raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(problems: DataFrame, what: str) -> None:
    if first := problems.head(1):
        raise ValueError(f"{what}: {first[0].asDict()}")


def contract(samples: DataFrame) -> DataFrame:
    """problem, n: samples that break the contract, of each kind."""
    ids = F.transform("contexts", lambda c: c["context_id"])
    checks = {
        "missing sample_id": F.col("sample_id").isNull(),
        "missing comment": F.col("comment").isNull(),
        "missing gold_context_ids": F.col("gold_context_ids").isNull(),
        "no contexts": F.col("contexts").isNull() | (F.size("contexts") == 0),
        "repeated context_id": F.size(F.array_distinct(ids)) < F.size(ids),
        "gold outside the pool": F.size(F.array_except("gold_context_ids", ids)) > 0,
    }
    found = samples.select(F.explode(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])).alias("problem")).where("problem is not null")
    repeated = samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated sample_id").alias("problem"))
    return found.unionByName(repeated).groupBy("problem").agg(F.count("*").alias("n"))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """sample_id, pos, problem where two score tables differ in rows or context ids, or the right one has no finite score."""
    r = right.select("sample_id", "pos", F.col("context_id").alias("other_id"), F.col("score").alias("other_score"), F.lit(1).alias("here"))
    x = left.select("sample_id", "pos", "context_id", F.lit(1).alias("there")).join(r, ["sample_id", "pos"], "full_outer")
    finite = F.col("other_score").isNotNull() & ~F.isnan(F.col("other_score").cast("double")) & (F.abs("other_score") < float("inf"))
    problem = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "extra").when(~F.col("context_id").eqNullSafe(F.col("other_id")), "other context").when(~finite, "not finite")
    return x.select("sample_id", "pos", problem.alias("problem")).where("problem is not null")


def attach(features: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """features with the column name from scores; raises unless every row has its score. Samples that features lacks may be extra."""
    own = scores.join(features.select("sample_id").distinct(), "sample_id", "left_semi")
    require(aligned(features.withColumn("score", F.lit(0.0)), own), f"scores {name} don't fit")
    return features.join(own.select("sample_id", "pos", F.col("score").alias(name)), ["sample_id", "pos"])


def missing_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, n: rows without a value."""
    absent = [n for n in names if n not in rows.columns]
    if absent:
        raise ValueError(f"missing features: {absent}")
    return rows.select(F.explode(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])).alias("feature")).where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"))


def incomplete_rankings(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    """sample_id, problem of rankings that are not a permutation of their pool, or pools without a ranking."""
    pools = candidates.groupBy("sample_id").agg(F.array_sort(F.collect_list("context_id")).alias("pool"))
    x = pools.join(rankings, "sample_id", "full_outer")
    r = F.col("ranked_context_ids")
    problem = F.when(r.isNull(), "missing").when(F.col("pool").isNull(), "unknown sample").when(F.size(F.array_distinct(r)) < F.size(r), "repeated").when(F.size(F.array_except(r, F.col("pool"))) > 0, "foreign").when(F.size(r) < F.size("pool"), "truncated")
    return x.select("sample_id", problem.alias("problem")).where("problem is not null")


def stale_predictions(rankings: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """sample_id of predictions that are not the first k of their ranking."""
    return predictions.join(rankings, "sample_id", "left").where(is_stale(F.col("ranked_context_ids"), F.col("predicted_context_ids_topk"), k)).select("sample_id")


def is_stale(ranking: Column, prediction: Column, k: int) -> Column:
    return ~F.slice(ranking, 1, k).eqNullSafe(prediction)


def split_overlap(samples: DataFrame, key: str, split: str = "split") -> DataFrame:
    """left_split, right_split, shared: values of the key that two splits have in common."""
    names = samples.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left_split"), b.alias("right_split")))))
    return names.select(F.explode(pairs).alias("p")).groupBy("p.left_split", "p.right_split").agg(F.count("*").alias("shared"))


def fingerprints(samples: DataFrame, *columns: str) -> DataFrame:
    """samples with fingerprint: SHA-256 of the columns' values, each with its length."""
    parts = [F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return samples.withColumn("fingerprint", F.sha2(F.concat_ws("|", *parts), 256))


def all_problems(*named: tuple[str, DataFrame]) -> DataFrame:
    """check, n of several checks in one table."""
    return reduce(DataFrame.unionByName, [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, p in named])


def prediction_problems(samples: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """sample_id, problem of predictions that don't fit their samples.

    samples: sample_id, gold_context_ids, context_ids; predictions: sample_id, gold_context_ids, predicted_context_ids_topk."""
    p = predictions.groupBy("sample_id").agg(F.count("*").alias("times"), F.first("gold_context_ids").alias("told"), F.first("predicted_context_ids_topk").alias("top"))
    x = samples.join(p, "sample_id", "full_outer")
    top = F.col("top")
    checks = {
        "missing": F.col("times").isNull(),
        "unknown sample": F.col("context_ids").isNull(),
        "repeated sample": F.col("times") > 1,
        "other gold": ~F.col("told").eqNullSafe(F.col("gold_context_ids")),
        "no list": top.isNull(),
        "empty": F.size(top) == 0,
        "too long": F.size(top) > k,
        "foreign": F.size(F.array_except(top, F.col("context_ids"))) > 0,
        "repeated": F.size(F.array_distinct(top)) < F.size(top),
    }
    problem = F.lit(None).cast("string")
    for name, test in reversed(checks.items()):
        problem = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(problem)
    return x.select("sample_id", problem.alias("problem")).where("problem is not null")


def holdout_problems(samples: DataFrame, column: str, target: str, evaluated: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """check, n of a holdout's artefacts: training rows of the target, evaluated rows that are not of it or not in the test
    split, target rows left out, and predictions that don't fit. samples: sample_id, split, the column, gold_context_ids, context_ids;
    evaluated: sample_id, part ('train' or 'test')."""
    x = samples.join(evaluated, "sample_id", "left")
    mine = F.col(column).eqNullSafe(F.lit(target))
    test = samples.where(mine & (F.col("split") == "test"))
    return all_problems(
        ("target in training", x.where((F.col("part") == "train") & mine)),
        ("test split in training", x.where("part = 'train' and split = 'test'")),
        ("other in evaluation", x.where((F.col("part") == "test") & (~mine | (F.col("split") != "test")))),
        ("left out", x.where(mine & (F.col("split") == "test") & ~F.col("part").eqNullSafe(F.lit("test")))),
        ("predictions", prediction_problems(test.select("sample_id", "gold_context_ids", "context_ids"), predictions, k)),
    )
