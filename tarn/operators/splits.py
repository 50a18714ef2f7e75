"""Splits and folds that keep groups together, stratified samples and holdout targets."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_counts(samples: DataFrame, key: str = "group_key") -> DataFrame:
    return samples.groupBy(key).agg(F.count("*").alias("n"))


def draw(seed: int, *columns: str):
    """A number from 0 to 1 for the columns' values, the same in every run."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Ranges of the draw over which running totals of groups are taken apart.
RANGES = 4096


def split_by_group(samples: DataFrame, dev_fraction: float, seed: int, key: str = "group_key") -> DataFrame:
    """samples with split: groups in a hashed order go to dev until it has its share (at least one group), the others to train.

    The running total is taken inside ranges of the draw and over the totals of the ranges, so no task sees all groups.
    """
    groups = group_counts(samples, key).withColumn("draw", draw(seed, key)).withColumn("range", F.floor(F.col("draw") * RANGES))
    totals = groups.groupBy("range").agg(F.sum("n").alias("in_range"))
    # at most RANGES + 1 rows
    offset = F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("range", offset.alias("offset"), F.sum("in_range").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("draw", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.greatest(F.lit(1), F.bround(F.col("total") * dev_fraction))
    names = groups.withColumn("inside", inside).join(F.broadcast(totals), "range")
    return samples.join(names.select(key, F.when(F.col("offset") + F.col("inside") < target, "dev").otherwise("train").alias("split")), key)


#: Slices of the draw by which the rows of one label are numbered.
SLICES = 4096


def stratified_split(samples: DataFrame, label: str, seed: int, order: str = "sample_id") -> DataFrame:
    """samples with split: 70 % of each label go to train, 10 % to dev (one at least of both), the others to test.

    A label too rare for that gives one row to dev and all but one of the others to train.
    """
    # a label's rows are numbered in slices of the draw, behind the number of rows in the slices before: no task holds a label
    rows = samples.withColumns({"draw_": draw(seed, order), "slice_": F.floor(draw(seed, order) * SLICES).cast("int")})
    each = rows.groupBy(F.col(label).alias("of_"), F.col("slice_").alias("at_")).agg(F.count("*").alias("m_"))
    w = Window.partitionBy("of_")
    before = F.sum("m_").over(w.orderBy("at_")) - F.col("m_")
    sizes = each.select("of_", "at_", before.alias("before_"), F.sum("m_").over(w).alias("n_"))
    rows = rows.join(sizes, F.col(label).eqNullSafe(F.col("of_")) & (F.col("slice_") == F.col("at_")))
    k, n = F.row_number().over(Window.partitionBy(label, "slice_").orderBy("draw_", order)) + F.col("before_"), F.col("n_")
    train, dev = F.greatest(F.lit(1), F.floor(n * 0.7)), F.greatest(F.lit(1), F.floor(n * 0.1))
    rare = train + dev >= n
    train, dev = F.when(rare, F.greatest(F.lit(1), n - 2)).otherwise(train), F.when(rare, 1).otherwise(dev)
    return rows.select(*samples.columns, F.when(k <= train, "train").when(k <= train + dev, "dev").otherwise("test").alias("split"))


def stratified_sample(samples: DataFrame, by: str, fraction: float, seed: int, order: str = "sample_id") -> DataFrame:
    """A share of each stratum's rows (half to even), one at least."""
    w = Window.partitionBy(by)
    rows = samples.withColumn("k", F.row_number().over(w.orderBy(draw(seed, order), order))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("k") <= F.greatest(F.lit(1), F.bround(F.col("n") * fraction))).drop("k", "n")


def fold_of_groups(counts: list[tuple[str, int]], n_splits: int, seed: int) -> dict[str, int]:
    """Groups to folds: the largest first, each to the fold that has least so far; equal sizes in the order of a seeded hash."""
    n_splits = min(int(n_splits), len(counts))
    if n_splits < 2:
        raise ValueError("folds need at least two groups")
    order = sorted(counts, key=lambda x: (-x[1], hashlib.md5(f"{x[0]}|{seed}".encode()).hexdigest()))
    load, out = [0] * n_splits, {}
    for key, n in order:
        k = load.index(min(load))
        out[key] = k
        load[k] += n
    return out


def group_folds(samples: DataFrame, n_splits: int, seed: int, key: str = "group_key") -> DataFrame:
    """samples with fold. The list of groups and their sizes is dealt on the driver, one small row for each group."""
    counts = [(r[0], r[1]) for r in group_counts(samples, key).orderBy(key).collect()]
    folds = samples.sparkSession.createDataFrame(list(fold_of_groups(counts, n_splits, seed).items()), f"{key} {dict(samples.dtypes)[key]}, fold int")
    return samples.join(folds, key)


def holdout_targets(samples: DataFrame, split: str, column: str, least_train: int, least_test: int, first: int | None = None) -> DataFrame:
    """column, train, test: values frequent enough in both splits, by falling test counts and then by value."""
    counts = samples.groupBy(column).agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test"))
    out = counts.where((F.col("train") >= least_train) & (F.col("test") >= least_test)).orderBy(F.col("test").desc(), column)
    return out if first is None else out.limit(first)


def without_test_groups(rows: DataFrame, test: DataFrame, key: str = "group_key") -> DataFrame:
    """rows whose group is not in the test table."""
    return rows.join(test.select(key).distinct(), key, "left_anti")
