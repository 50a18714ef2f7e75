"""Shared helpers: table access, checkpoints in the shared folder, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that a Python worker holds at a time; with whole texts this bounds its memory.
ARROW_ROWS = 1000

#: Used only where spark.checkpoint.dir is unset, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tarn"
#: Bytes of one Arrow batch, which bound it where texts are long.
ARROW_BYTES = 64 << 20
#: Edges that a task holds at a time to reduce them to stars.
EDGES = 1 << 18
#: Rows of a few numbers that one task reads, about, where a table of them is packed.
PACKED = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder, with Arrow batches kept small and this package on the workers' path."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without one, a folder of this engine."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster names in spark.checkpoint.dir, and read from there on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int = PACKED) -> DataFrame:
    """The checkpoint of df, a table of a few numbers in a row, in no more tasks than one for each `rows` rows: every task in front of a shuffle leaves files."""
    kept = checkpoint(df)
    n = kept.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    return kept.coalesce(max(1, -(-n // rows)))


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the links (a, b): the least node that each reaches, without the roots themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars (node, least node) that connect the same nodes; of no more than EDGES edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return star_forest(*(np.concatenate(x) for x in zip(*held)))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        n += batch.num_rows
        if n >= EDGES:
            held = [stars()]
            n = len(held[0][0])
            if n > EDGES // 2:
                yield out(*held[0])
                held, n = [], 0
    if n:
        yield out(*stars())


def are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no a is a b."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node (long) of the edges (a, b): component is the least node that it reaches.

    Each task first reduces its edges to stars, before any shuffle; few edges in one task (see packed) are stars behind that. Then the
    large-star and small-star steps alternate until all that is left are stars. Each step first takes a minimum per node, which combines before the shuffle, so a hub with
    very many edges costs one row per task. The minima are dealt out anew, so that the rows of a hub meet its minimum in a
    join of two plain shuffles, whose large partitions Spark splits.
    Nodes without edges are not in the result; null nodes are ignored. An empty input gives an empty result.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    cur = packed(pairs.mapInArrow(forests, "a long, b long").distinct())
    rounds = 0
    while not are_stars(cur):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
        rounds += 1
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy(F.col("a").alias("n")).agg(F.least(F.first("a"), F.min("b")).alias("m")).repartition(F.xxhash64("n"))
        # one row for each edge, so that rows which repeat can wait for the end of the round
        large = sym.where("b > a").join(least, sym["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_min = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).repartition(F.xxhash64("n"))
        joined = large.join(small_min, large["a"] == small_min["n"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        cur = packed(small)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
