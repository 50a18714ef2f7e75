"""From raw review tables to samples: hunks as candidates, the annotated hunk as gold, and what could not be resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diffs

RAW = (
    "instance_id string, repo string, pull_number bigint, language string, commit_to_review struct<patch_to_review: string, head_commit: string>, "
    "reference_review_comments array<struct<text: string, path: string, line: int, original_line: int, original_start_line: int, diff_hunk: string>>, "
    "metadata struct<difficulty: string, problem_domain: string>"
)


def reviews(raw: DataFrame, language: str | None = None, test: DataFrame | None = None) -> DataFrame:
    """One row per review comment, with group_key and sample_id; of one language, and of no group that the table test has."""
    rows = raw if language is None else raw.where(F.col("language") == language)
    rows = rows.withColumn("group_key", T.group_key(F.col("repo"), F.col("pull_number"), F.col("instance_id")))
    if test is not None:
        keys = test.select(T.group_key(F.col("repo"), F.col("pull_number"), F.col("instance_id")).alias("group_key")).distinct()
        rows = rows.join(keys, "group_key", "left_anti")
    r = rows.select("instance_id", "repo", "pull_number", "group_key", F.col("commit_to_review.head_commit").alias("head_commit"), "metadata", F.posexplode("reference_review_comments").alias("k", "c"))
    return r.select("*", "c.*", F.concat("instance_id", F.lit("::comment_"), F.col("k").cast("string")).alias("sample_id")).drop("c", "k")


def resolve(raw: DataFrame, language: str | None = None, test: DataFrame | None = None, min_contexts: int = 2) -> DataFrame:
    """All review comments with status: 'ok', 'empty_comment', 'fewer_than_min_contexts' or why no hunk could be named.

    Nothing is dropped here: samples() and unresolved() are filters of this table, and counts() sums it up.
    """
    found = diffs.hunks(raw.select("instance_id", F.col("commit_to_review.patch_to_review").alias("patch")))
    pool = F.transform(F.array_sort(F.collect_list(F.struct("ord", "context_id", "source", "text"))), lambda c: F.struct(c["context_id"].alias("context_id"), c["source"].alias("source"), c["text"].alias("text")))
    pools = found.groupBy("instance_id").agg(pool.alias("contexts"))
    r = reviews(raw, language, test)
    gold = diffs.match_reviews(r.select(F.col("sample_id").alias("review_id"), "instance_id", "path", "diff_hunk", "line", "original_line", "original_start_line"), found)
    x = r.join(pools, "instance_id", "left").join(gold.withColumnRenamed("review_id", "sample_id"), "sample_id")
    x = x.withColumn("comment", T.clean_review(T.none_if_null(F.col("text")))).withColumn("contexts", F.coalesce("contexts", F.array().cast("array<struct<context_id: string, source: string, text: string>>")))
    status = F.when(F.col("comment") == "", "empty_comment").when(F.size("contexts") < min_contexts, "fewer_than_min_contexts").when(F.size("gold_context_ids") == 0, F.coalesce("reason", F.lit("unknown"))).otherwise("ok")
    return x.withColumn("status", status)


def samples(resolved: DataFrame) -> DataFrame:
    fields = ["repo", "pull_number", "instance_id", "group_key", "head_commit", "metadata.difficulty", "metadata.problem_domain", "path"]
    meta = F.struct(*fields, F.col("method").alias("gold_match_method"))
    return resolved.where("status = 'ok'").select("sample_id", "comment", F.lit("review_comment").alias("intent"), "gold_context_ids", "contexts", meta.alias("metadata"))


def unresolved(resolved: DataFrame) -> DataFrame:
    """The dead letters, with the reason and the stage that gave up; empty comments are only counted."""
    stage = F.when(F.col("status") == "fewer_than_min_contexts", "candidate_pool_filter").otherwise(F.col("method"))
    names = ["sample_id", "group_key", "instance_id", "repo", "pull_number", "head_commit", "path", "line", "original_line", "original_start_line"]
    rows = resolved.where("status not in ('ok', 'empty_comment')")
    return rows.select(*names, T.none_if_null(F.col("diff_hunk")).alias("diff_hunk"), F.transform("contexts", lambda c: c["context_id"]).alias("candidate_context_ids"), F.col("status").alias("reason"), stage.alias("matcher_stage"))


def counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("n"))


def intent_samples(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Labelled comments with their change's facts as two candidates; rows without id, message or group are dropped.

    rows: comment_id, message, comment_group, category_fine, project, file_name, change_type, line_number, patchset_number,
    is_bug_fix, is_new_file. attributes: folderName, attributes (see files.read_attributes).
    """
    some = lambda c: T.none_if_null(F.col(c).cast("string")) != ""
    x = rows.where(some("comment_id") & some("message") & some("comment_group")).join(attributes, F.col("comment_id") == F.col("folderName"), "left")
    told = F.concat_ws("; ", *[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for label, c in (("project", "project"), ("file", "file_name"), ("change_type", "change_type"), ("line_number", "line_number"), ("patchset_number", "patchset_number"), ("is_bug_fix", "is_bug_fix"), ("is_new_file", "is_new_file"))])
    metrics = T.metric_context(F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    context = lambda i, s, t: F.struct(F.lit(i).alias("context_id"), F.lit(s).alias("source"), t.alias("text"))
    return x.select(F.col("comment_id").alias("sample_id"), T.strip(F.col("message")).alias("comment"), T.normalize_label(F.col("comment_group")).alias("intent"), F.array().cast("array<string>").alias("gold_context_ids"), F.array(context("ctx-meta", "metadata", told), context("ctx-metrics", "metrics", metrics)).alias("contexts"), F.struct("project", "file_name", "category_fine", "comment_group").alias("metadata"))


def sized(samples_: DataFrame, min_contexts: int = 0, max_contexts: int = 0) -> DataFrame:
    """Samples whose pool is within the bounds; 0 as the upper bound means none."""
    n = F.size("contexts")
    out = samples_.where(n >= min_contexts)
    return out if max_contexts == 0 else out.where(n <= max_contexts)


def first_samples(samples_: DataFrame, n: int, order: str = "sample_id") -> DataFrame:
    """The first n samples in an order; 0 means all."""
    return samples_ if n <= 0 else samples_.orderBy(order).limit(n)


def positive_pairs(samples_: DataFrame, candidates: DataFrame) -> DataFrame:
    """query, context: the text of every sample with those of its gold candidates, each pair of texts once."""
    gold = candidates.where("is_gold").select("sample_id", F.col("text").alias("context"))
    return samples_.select("sample_id", F.col("comment").alias("query")).join(gold, "sample_id").select("query", "context").distinct()


def toy_samples(spark: SparkSession) -> DataFrame:
    """A few labelled samples of three candidates each (diff, function, file), with split: enough to run every step once."""
    kinds = (("correctness", "check the index before reading", "items[i]"), ("testing", "add a test for the empty list", "test_empty"), ("readability", "give the loop variable a name", "row"), ("performance", "do not sort twice", "sorted"))
    rows = []
    for k, (intent, comment, symbol) in enumerate(kinds * 2):
        sid = f"toy-{k}"
        contexts = [(f"{sid}-{s}", s, f"path: src/{s}_{k}.py\n{t}") for s, t in (("diff", f"+ {symbol}"), ("function", f"def f_{k}(): return {k}"), ("file", f"# module {k}"))]
        rows.append((sid, comment, intent, [contexts[0][0]], contexts, ("train", "train", "dev", "test")[(k + k // 4) % 4]))
    return spark.createDataFrame(rows, "sample_id string, comment string, intent string, gold_context_ids array<string>, contexts array<struct<context_id: string, source: string, text: string>>, split string")
