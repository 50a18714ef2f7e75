"""Files: JSON lines, score caches, attributes, configurations and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTEXT = "struct<context_id: string, source: string, text: string>"
METADATA = "struct<repo: string, pull_number: bigint, instance_id: string, group_key: string, head_commit: string, difficulty: string, problem_domain: string, path: string, gold_match_method: string>"
SAMPLE = f"sample_id string, comment string, intent string, gold_context_ids array<string>, contexts array<{CONTEXT}>, metadata {METADATA}"
CACHE = "model_path string, sample_ids array<string>, context_ids_by_group array<array<string>>, gold_context_ids_by_group array<array<string>>, group_sizes array<int>, scores array<double>"
FEATURE_ROWS = "sample_id string, feature_rows array<struct<context_id: string, source: string, text: string, features: map<string, double>>>"
PREDICTION = "sample_id string, gold_context_ids array<string>, predicted_context_ids_topk array<string>"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, gzipped or not by their names; a malformed line fails. Carry an order column in the data if order matters."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(path)


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All splits in one table, with the column split."""
    out = None
    for split, path in paths.items():
        one = read_samples(spark, path).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


def candidates_of(samples: DataFrame) -> DataFrame:
    """sample_id, pos, context_id, source, text, is_gold: one row per context, numbered as they come."""
    rows = samples.select("sample_id", "gold_context_ids", F.posexplode("contexts").alias("pos", "c"))
    gold = F.coalesce(F.array_contains("gold_context_ids", F.col("c.context_id")), F.lit(False))
    return rows.select("sample_id", "pos", "c.context_id", F.coalesce("c.source", F.lit("unknown")).alias("source"), "c.text", gold.alias("is_gold"))


def read_score_cache(spark: SparkSession, path: str, name: str = "score") -> DataFrame:
    """score_name, sample_id, pos, context_id, is_gold, score of a ragged cache; its flat scores are cut by the group sizes."""
    raw = spark.read.schema(CACHE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ends = F.aggregate("group_sizes", F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    groups = raw.withColumn("ends", ends).select("scores", F.posexplode(F.arrays_zip("sample_ids", "context_ids_by_group", "gold_context_ids_by_group", "group_sizes", "ends")).alias("k", "g"))
    own = F.slice("scores", F.col("g.ends") - F.col("g.group_sizes") + 1, F.col("g.group_sizes"))
    rows = groups.select(F.col("g.sample_ids").alias("sample_id"), F.col("g.gold_context_ids_by_group").alias("gold"), F.posexplode(F.arrays_zip(F.col("g.context_ids_by_group").alias("context_id"), own.alias("score"))).alias("pos", "x"))
    return rows.select(F.lit(name).alias("score_name"), "sample_id", "pos", "x.context_id", F.array_contains("gold", F.col("x.context_id")).alias("is_gold"), "x.score")


def write_scores(scores: DataFrame, path: str, name: str, split: str | None = None) -> None:
    """A long score table as Parquet, partitioned by its name and split."""
    out = scores.withColumn("score_name", F.lit(name))
    by = ["score_name"]
    if split is not None:
        out, by = out.withColumn("split", F.lit(split)), [*by, "split"]
    out.write.mode("append").partitionBy(*by).parquet(path)


def read_feature_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """sample_id, pos, context_id, text and the named features (0 where missing) of a feature-row cache."""
    rows = spark.read.schema(FEATURE_ROWS).option("mode", "FAILFAST").json(path).select("sample_id", F.posexplode("feature_rows").alias("pos", "r"))
    return rows.select("sample_id", "pos", "r.context_id", "r.text", *[F.coalesce(F.try_element_at("r.features", F.lit(n)), F.lit(0.0)).alias(n) for n in names])


def write_predictions(rankings: DataFrame, path: str, k: int) -> None:
    """The first k of each ranking as JSON lines."""
    rankings.withColumn("predicted_context_ids_topk", F.slice("ranked_context_ids", 1, k)).drop("ranked_context_ids").write.json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def placed(rows: DataFrame) -> DataFrame:
    """rows as read from files with _file, _block and _id: a file is read in blocks, and a block's rows one behind the other by one task."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def numbered(rows: DataFrame, name: str = "row_number") -> DataFrame:
    """rows, just as they are read from files, with file (its path) and the row's number in it from 0, however many tasks read the file.

    Ids are consecutive inside a block, so a row's number is the count of rows in earlier blocks and its distance from its block's
    first; only one row per block is shuffled."""
    x = placed(rows)
    blocks = x.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_file", "_block", (earlier - F.col("first")).alias("shift"))
    return x.join(starts, ["_file", "_block"]).select(*rows.columns, F.col("_file").alias("file"), (F.col("_id") + F.col("shift")).alias(name))


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """folderName, attributes (a map) of a CSV with a header; of rows with one folderName the last in the file counts (of several
    files, in the last file by name)."""
    raw = spark.read.option("header", True).csv(path)
    values = F.map_from_arrays(F.array(*map(F.lit, raw.columns)), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns]))
    last = F.max_by(values, F.struct("_file", "_block", "_id"))
    return placed(raw).groupBy("folderName").agg(last.alias("attributes"))


def read_config(text: str) -> dict:
    """A YAML or JSON configuration, given as text."""
    import yaml

    return yaml.safe_load(text) or {}


def model_json(model: dict) -> str:
    return json.dumps(model, indent=2, sort_keys=True)


def named_paths(specs: list[str]) -> dict[str, str]:
    """{'name': 'path'} of texts like name=path; a name may occur once."""
    out: dict[str, str] = {}
    for s in specs:
        name, sep, path = s.partition("=")
        if not sep or not name.strip() or not path.strip() or name.strip() in out:
            raise ValueError(f"Expected a new name=path, got {s!r}")
        out[name.strip()] = path.strip()
    return out


def write_feature_rows(rows: DataFrame, path: str, names: list[str]) -> None:
    """A feature-row cache as JSON lines. rows: sample_id, pos, context_id, source, text and the named features."""
    features = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]))
    own = F.struct("pos", "context_id", "source", "text", features.alias("features"))
    cut = lambda r: F.struct(r["context_id"].alias("context_id"), r["source"].alias("source"), r["text"].alias("text"), r["features"].alias("features"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "context_id")))
    # maps have no order, so the rows are found again by their places
    grouped = rows.groupBy("sample_id").agg(ordered.alias("o"), F.map_from_entries(F.collect_list(F.struct("pos", own))).alias("m"))
    grouped.select("sample_id", F.transform("o", lambda x: cut(F.element_at("m", x["pos"]))).alias("feature_rows")).write.json(path)


def read_model(text: str) -> dict:
    """A linear model of model_json; it must name its features, their scaling and as many coefficients."""
    model = json.loads(text)
    n = len(model["feature_names"])
    if any(len(model[k]) != n for k in ("scaler_mean", "scaler_scale", "coefficients")):
        raise ValueError("the model's parts differ in length")
    return model


def markdown_table(rows: DataFrame, digits: int = 4) -> str:
    """A small result as a Markdown table, for reports."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    lines = [rows.columns, ["---"] * len(rows.columns), *[[show(v) for v in r] for r in rows.collect()]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def append_result(spark: SparkSession, path: str, name: str, metrics: dict[str, float]) -> None:
    """One finished step of a search, so that the search can go on from what is there."""
    spark.createDataFrame([(name, {k: float(v) for k, v in metrics.items()})], "name string, metrics map<string, double>").write.mode("append").parquet(path)


def finished(spark: SparkSession, path: str) -> set[str]:
    """Names of the steps that append_result has written; none if there is nothing yet."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {r.name for r in rows.select("name").collect()}
