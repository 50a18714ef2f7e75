"""Per-pool columns: ranks, normalizations and the group-relative feature matrix.

All are windows over sample_id, or over sample_id and path, so one exchange on sample_id serves them. A rank is
never shared: equal values keep the order of pos, and NaN comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

POOL = ("sample_id",)
FILE = ("sample_id", "path")


def pool(*by: str) -> WindowSpec:
    return Window.partitionBy(*(by or POOL))


def descending(score: Column) -> list[Column]:
    return [F.isnan(score).asc(), score.desc_nulls_last(), F.col("pos").asc()]


def rank(score: Column, by: tuple[str, ...] = POOL) -> Column:
    """1 for the best; ties by pos."""
    return F.row_number().over(pool(*by).orderBy(*descending(score.cast("double"))))


def size(by: tuple[str, ...] = POOL) -> Column:
    return F.count(F.lit(1)).over(pool(*by))


def rank_share(score: Column, by: tuple[str, ...] = POOL) -> Column:
    """1 for the best down to 0 for the last, in equal steps; 1 in a pool of one."""
    n = size(by)
    return F.when(n == 1, 1.0).otherwise(1 - (rank(score, by) - 1) / F.greatest(n - 1, F.lit(1)))


def max_norm(score: Column, by: tuple[str, ...] = POOL) -> Column:
    top = F.max(score).over(pool(*by))
    return score / F.when(top > 0, top).otherwise(1.0)


def normalized(score: Column, mode: str, flat: float = 0.0, tolerance: float = 1e-6, by: tuple[str, ...] = POOL) -> Column:
    """raw, zscore (population deviation; only centred where it is below the tolerance), minmax (a pool flatter than the
    tolerance becomes `flat` everywhere) or rank."""
    score, w = score.cast("double"), pool(*by)
    if mode in ("raw", "none"):
        return score
    if mode == "rank":
        return rank_share(score, by)
    if mode == "zscore":
        centred, spread = score - F.avg(score).over(w), F.stddev_pop(score).over(w)
        return F.when(spread < tolerance, centred).otherwise(centred / spread)
    if mode == "minmax":
        low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
        even = span <= 0 if tolerance == 0 else span < tolerance
        return F.when(even, flat).otherwise((score - low) / F.when(even, 1.0).otherwise(span))
    raise ValueError(f"Unsupported normalization mode: {mode}")


def context_bucket(n: Column) -> Column:
    return F.when(n <= 10, "<=10").when(n <= 20, "11-20").when(n <= 40, "21-40").otherwise(">40")


TRANSFORMS = {
    "raw": (),
    "raw_plus_relative": ("relative",),
    "raw_plus_relative_plus_context_buckets": ("relative", "buckets"),
    "raw_plus_relative_plus_file_context": ("relative", "file"),
    "raw_plus_relative_plus_context_buckets_plus_file_context": ("relative", "buckets", "file"),
    "raw_plus_relative_plus_context_slices_plus_file_context": ("relative", "slices", "file"),
}
FLAGS = {"buckets": {"ctx_gt20": (21, None), "ctx_gt40": (41, None)}, "slices": {"ctx_11_20": (11, 20), "ctx_21_40": (21, 40), "ctx_gt40": (41, None)}}


def column_names(names: list[str], transform: str) -> list[str]:
    """The matrix's columns in their order: block by block, features in order within each."""
    blocks = TRANSFORMS[transform]
    suffixes = [""]
    if "relative" in blocks:
        suffixes += ["_max_norm", "_rank_pct"]
    for kind in ("buckets", "slices"):
        if kind in blocks:
            suffixes += [f"_x_{flag}" for flag in FLAGS[kind]]
    if "file" in blocks:
        suffixes += ["_file_max", "_within_file_rank_pct"]
    return [f"{n}{s}" for s in suffixes for n in names]


def feature_matrix(features: DataFrame, names: list[str], transform: str = "raw_plus_relative") -> DataFrame:
    """sample_id, pos and the columns of column_names. features has sample_id, pos, path (for file blocks) and the names; nulls count as 0.

    The features are turned into rows, so that each kind of rank costs one sort and not one for each feature.
    """
    if transform not in TRANSFORMS:
        raise ValueError(f"Unsupported feature transform: {transform}")
    blocks = TRANSFORMS[transform]
    value = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    if not blocks:
        return features.select("sample_id", "pos", *[value(n).alias(n) for n in names])
    keys = ["sample_id", "pos", *(["path"] if "file" in blocks else [])]
    long = features.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("f"), value(n).alias("v")) for n in names])).alias("x")).select(*keys, "x.f", "x.v")
    by, v = ("sample_id", "f"), F.col("v")
    long = long.withColumn("n", size(by))
    parts = {"": v, "_max_norm": max_norm(v, by), "_rank_pct": rank_share(v, by)}
    for kind in ("buckets", "slices"):
        if kind in blocks:
            for flag, (low, high) in FLAGS[kind].items():
                inside = F.col("n") >= low
                parts[f"_x_{flag}"] = F.when(inside if high is None else inside & (F.col("n") <= high), v).otherwise(0.0)
    if "file" in blocks:
        own = (*by, "path")
        parts |= {"_file_max": F.max(v).over(pool(*own)), "_within_file_rank_pct": rank_share(v, own)}
    for suffix, c in parts.items():
        long = long.withColumn(f"v{suffix}", c)
    back = long.groupBy("sample_id", "pos").agg(*[F.max(F.when(F.col("f") == n, F.col(f"v{s}"))).alias(f"{n}{s}") for s in parts for n in names])
    return back.select("sample_id", "pos", *column_names(names, transform))


def top_stats(scores: DataFrame, single: str = "repeat") -> DataFrame:
    """sample_id, top_id, top, second, margin. A pool of one has its own score as the second ('repeat') or 0 ('zero')."""
    s = F.col("score")
    ranked = scores.withColumn("r", rank(s)).where("r <= 2")
    out = ranked.groupBy("sample_id").agg(*lead_columns(F.col("r")))
    second = second_score(single)
    return out.select("sample_id", "top_id", "top", second.alias("second"), margin(single).alias("margin"))


def lead_columns(r: Column) -> list[Column]:
    """Aggregates top_id, top and second of candidates with the rank r."""
    s = F.col("score")
    return [F.max(F.when(r == 1, F.col("context_id"))).alias("top_id"), F.max(F.when(r == 1, s)).alias("top"), F.max(F.when(r == 2, s)).alias("second")]


def second_score(single: str) -> Column:
    return F.coalesce("second", "top" if single == "repeat" else F.lit(0.0))


def margin(single: str) -> Column:
    return F.col("top") - second_score(single)
