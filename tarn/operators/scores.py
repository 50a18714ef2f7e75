"""Score algebra: fuse, spread over files and neighbours, rerank the top, route between rankers, merge rankings.

Scores are tables (sample_id, pos, score, ...); two rankers' tables meet on (sample_id, pos).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import grid
from . import groupwise as G

KEY = ["sample_id", "pos"]
WEIGHTS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
MODES = ("raw", "zscore", "minmax", "rank")


def fuse(components: list[tuple[DataFrame, float]], mode: str = "minmax") -> DataFrame:
    """sample_id, pos, score: the weighted sum of the components' normalized scores. All must have the same rows; see validate.aligned."""
    if not components:
        raise ValueError("At least one component is required for score fusion.")
    each = [c.select(*KEY, (G.normalized(F.col("score"), mode) * float(w)).alias("part")) for c, w in components]
    return reduce(DataFrame.unionByName, each).groupBy(*KEY).agg(F.sum("part").alias("score"))


def two_way_grid(pairs: DataFrame, weights: tuple[float, ...] = WEIGHTS, modes: tuple[str, ...] = MODES, k: int = 3, digits: int | None = None) -> DataFrame:
    """mode, weight, n, hit_1, hit_k, mrr, mrr_k of a + weight * b for every point of the grid, in one job.

    pairs: sample_id, pos, a, b, is_gold; a row is not copied. digits rounds the sums before they are ranked.
    """
    norm = pairs
    for m in modes:
        norm = norm.withColumn(f"a_{m}", G.normalized(F.col("a"), m)).withColumn(f"b_{m}", G.normalized(F.col("b"), m))

    points = [({"mode": m, "weight": float(w)}, F.col(f"a_{m}") + float(w) * F.col(f"b_{m}")) for m in modes for w in weights]
    return grid.point_metrics(norm, points, k, digits)


def best_point(grid: DataFrame, *order: str) -> DataFrame:
    """The row with the highest hit_1, then mrr, then hit_k; the first by the given columns wins ties."""
    return grid.orderBy(F.col("hit_1").desc(), F.col("mrr").desc(), F.col("hit_k").desc(), *order).limit(1)


def file_aggregate(score: Column, mode: str) -> Column:
    """A file's value inside its pool: the max, the mean, or the mean of its two best."""
    w = G.pool(*G.FILE)
    if mode == "max":
        return F.max(score).over(w)
    if mode == "mean":
        return F.avg(score).over(w)
    if mode == "top2_mean":
        top = F.slice(F.sort_array(F.collect_list(score).over(w), asc=False), 1, 2)
        return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    raise ValueError(f"Unsupported aggregation mode: {mode}")


def file_prior(scores: DataFrame, mode: str = "mean", norm: str = "none") -> DataFrame:
    """Every candidate gets its file's value, normalized inside the pool (a flat pool becomes ones)."""
    out = scores.withColumn("score", file_aggregate(F.col("score").cast("double"), mode))
    return out.withColumn("score", G.normalized(F.col("score"), norm, flat=1.0))


def neighbours(scores: DataFrame, penalty: float = 0.25) -> DataFrame:
    """score becomes the best of max_j(score_j - penalty * |hunk_i - hunk_j|) over its file. Rows without a hunk keep their own.

    Two running maxima replace the self-join: what comes from before, and what comes from behind.
    """
    if penalty < 0:
        raise ValueError("penalty must not be negative")
    s, h = F.col("score").cast("double"), F.col("hunk")
    w = Window.partitionBy("sample_id", "path", h.isNull()).orderBy("hunk")
    before = F.max(s + penalty * h).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - penalty * h
    behind = F.max(s - penalty * h).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)) + penalty * h
    return scores.withColumn("score", F.when(h.isNull(), s).otherwise(F.greatest(s, before, behind)))


def rerank_top(pairs: DataFrame, top_n: int, alpha: float) -> DataFrame:
    """Base scores a, and dense scores b for the top_n by a: inside alpha * b + (1 - alpha) * a, each from 0 to 1; outside -1 + 0.01 * a."""
    r = pairs.withColumn("inside", G.rank(F.col("a")) <= top_n).withColumn("a_all", G.normalized(F.col("a"), "minmax", flat=1.0, tolerance=0.0))
    own = ("sample_id", "inside")
    a, b = (G.normalized(F.col(c), "minmax", flat=1.0, tolerance=0.0, by=own) for c in "ab")
    return r.select(*KEY, F.when(F.col("inside"), alpha * b + (1 - alpha) * a).otherwise(-1 + 0.01 * F.col("a_all")).alias("score"))


def policies(n: Column, quoted: Column, mention: Column) -> dict[str, Column]:
    """When a second ranker takes part: by pool size, quoted spans and mentions."""
    return {
        "global": F.lit(True),
        "gt40": n > 40,
        "quoted_no": ~quoted,
        "mention_yes": mention,
        "gt40_or_quoted_no": (n > 40) | ~quoted,
        "gt40_or_mention": (n > 40) | mention,
        "gt40_or_quoted_no_or_mention": (n > 40) | ~quoted | mention,
        "always": F.lit(True),
        "ctx_gt20": n > 20,
        "ctx_gt40": n > 40,
        "quoted_no_or_ctx_gt40": ~quoted | (n > 40),
    }


def route(pairs: DataFrame, use_b: Column) -> DataFrame:
    """score: b where the condition holds for the sample, else a."""
    return pairs.withColumn("score", F.when(use_b, F.col("b")).otherwise(F.col("a")))


def route_grid(pairs: DataFrame, conditions: dict[str, Column], k: int = 3) -> DataFrame:
    """condition, n, hit_1, hit_k, mrr, mrr_k of routing by each condition, in one job."""
    return grid.point_metrics(pairs, [({"condition": c}, F.when(use, F.col("b")).otherwise(F.col("a"))) for c, use in conditions.items()], k)


def margins(pairs: DataFrame, score: str, norm: str) -> DataFrame:
    """sample_id, margin_<score>: best less second best normalized score; the best alone counts whole."""
    rows = pairs.select("sample_id", "pos", F.lit("").alias("context_id"), G.normalized(F.col(score), norm).alias("score"))
    return G.top_stats(rows, "zero").select("sample_id", F.col("margin").alias(f"margin_{score}"))


def margin_router(pairs: DataFrame, norm: str, thresholds: tuple[float, ...], k: int = 3, digits: int | None = None) -> DataFrame:
    """threshold, n, hit_1, ...: ranker b where its margin exceeds a's by the threshold at least; digits rounds the difference first."""
    both = pairs.join(margins(pairs, "a", norm), "sample_id").join(margins(pairs, "b", norm), "sample_id")
    gain = F.col("margin_b") - F.col("margin_a")
    gain = gain if digits is None else F.round(gain, digits)
    return grid.point_metrics(both, [({"threshold": float(t)}, F.when(gain >= t, F.col("b")).otherwise(F.col("a"))) for t in thresholds], k)


def merge_rankings(base: Column, *aux: Column) -> Column:
    """The base's first, then the others' order, then the rest of the base; each id once."""
    return F.array_distinct(F.concat(F.slice(base, 1, 1), *aux, base))


def hybrid(base: DataFrame, aux: list[DataFrame], use: DataFrame) -> DataFrame:
    """Rankings of base, merged with those of aux for the samples that use(sample_id, applies) names."""
    out = base.join(use, "sample_id")
    for i, a in enumerate(aux):
        out = out.join(a.select("sample_id", F.col("ranked_context_ids").alias(f"aux{i}")), "sample_id")
    merged = merge_rankings(F.col("ranked_context_ids"), *[F.col(f"aux{i}") for i in range(len(aux))])
    return out.select("sample_id", F.when(F.col("applies"), merged).otherwise(F.col("ranked_context_ids")).alias("ranked_context_ids"))


def hierarchical(rows: DataFrame, applies: Column, mode: str, alpha: float, top_files: int, penalty: float, source: str = "score") -> DataFrame:
    """Files first: score + alpha * the file's value (0 to 1 over the pool's files), less the penalty outside the top files.

    rows: sample_id, pos, path, score. Files are ordered by their value, then by where they first occur.
    """
    x = rows.withColumn("value", file_aggregate(F.col(source).cast("double"), mode)).withColumn("first_pos", F.min("pos").over(G.pool(*G.FILE)))
    pool = G.pool()
    low, high = F.min("value").over(pool), F.max("value").over(pool)
    x = x.withColumn("share", F.when(high <= low, 1.0).otherwise((F.col("value") - low) / F.when(high <= low, 1.0).otherwise(high - low)))
    x = x.withColumn("place", F.dense_rank().over(pool.orderBy(F.col("share").desc(), "first_pos")))
    outside = (F.lit(top_files) > 0) & (F.col("place") > top_files)
    score = F.col("score") + alpha * F.col("share") - F.when(outside, penalty).otherwise(0.0)
    return x.withColumn("score", F.when(applies, score).otherwise(F.col("score"))).drop("value", "first_pos", "share", "place")


def feedback_contexts(scores: DataFrame, k: int, by_file: bool = False) -> DataFrame:
    """The k best candidates with rank; by_file takes the best of each path first (an empty path is always its own file), then fills up."""
    r = scores.withColumn("rank", G.rank(F.col("score")))
    if not by_file:
        return r.where(F.col("rank") <= k)
    own = F.row_number().over(Window.partitionBy("sample_id", F.lower("path")).orderBy("rank"))
    r = r.withColumn("again", ((F.col("path") != "") & (own > 1)).cast("int"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("again", "rank"))).where(F.col("rank") <= k).drop("again")
