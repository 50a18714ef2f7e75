"""Intervals and p-values that respect clusters of samples, by weights that a hash draws for each cluster and resample.

Nothing but sums per resample leaves the executors: a cluster's weight in a resample is a Poisson number (how often it is
drawn again), its sign in a flip is a bit of its digest. Equal inputs give equal results in every run.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Flips that one digest gives: its bits.
BITS = 128
#: Resamples for which one digest draws.
DRAWS = 4
#: The constants of MD5, and messages that are digested at once.
MD5_START, MD5_TURNS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476), ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
MESSAGES = 1 << 13
#: Clusters whose weights are held at once, and tasks for each core.
CLUSTERS, TASKS = 64, 3
#: Probabilities of at most 0, 1, 2 ... draws.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def cluster_sums(outcomes: DataFrame, value: str, cluster: str = "group_key") -> DataFrame:
    """cluster, total, n of a per-sample value; a sample without a cluster is its own."""
    return outcomes.groupBy(cluster).agg(F.sum(value).cast("double").alias("total"), F.count("*").alias("n"))


def md5(words: np.ndarray) -> np.ndarray:
    """The digests (four numbers each, messages last) of messages of one padded block (16 x messages)."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in MD5_START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += MD5_SINES[i]
        f += words[g]
        turn = MD5_TURNS[i // 16][i % 4]
        up = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        up |= f
        up += b
        a, b, c, d = d, up, b, c
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), MD5_START)])


def digests(keys: Sequence[str | None], blocks: int, seed: int) -> np.ndarray:
    """The bytes (keys x blocks x 16) of the MD5 of key|block|seed."""
    ends = [f"|{k}|{seed}".encode() for k in range(blocks)]
    width = max(map(len, ends)) + 1
    tail = np.frombuffer(b"".join([(e + b"\x80").ljust(width, b"\0") for e in ends]), np.uint8).reshape(blocks, width)
    size = np.array([len(e) for e in ends])
    out = np.empty((len(keys), blocks, BITS // 8), np.uint8)
    own = [("" if k is None else k).encode() for k in keys]
    for n in {len(k) for k in own}:
        these = [i for i, k in enumerate(own) if len(k) == n]
        if n + width > 56:
            for i in these:
                out[i] = np.frombuffer(b"".join([hashlib.md5(own[i] + e).digest() for e in ends]), np.uint8).reshape(blocks, -1)
            continue
        step = max(1, MESSAGES // blocks)
        for at in range(0, len(these), step):
            part = these[at : at + step]
            text = np.zeros((len(part), blocks, 64), np.uint8)
            text[:, :, :n] = np.frombuffer(b"".join([own[i] for i in part]), np.uint8).reshape(len(part), 1, n)
            text[:, :, n : n + width] = tail
            text[:, :, 56:58] = ((size + n) * 8).astype("<u2").view(np.uint8).reshape(blocks, 2)
            words = np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T).astype(np.uint32, copy=False)
            out[part] = np.ascontiguousarray(md5(words).T.astype("<u4")).view(np.uint8).reshape(len(part), blocks, -1)
    return out


def draws(keys: Sequence[str | None], resamples: int, seed: int) -> np.ndarray:
    """How often (keys x resamples) each cluster is drawn."""
    own = digests(keys, -(-resamples // DRAWS), seed).view(">u4").reshape(len(keys), -1)[:, :resamples].astype(np.uint32)
    times = np.zeros(own.shape, np.uint8)
    for p in POISSON:
        times += own >= np.uint32(math.ceil(p * (1 << 32)))
    return times.astype(float)


def signs(keys: Sequence[str | None], flips: int, seed: int) -> np.ndarray:
    """The sign (keys x flips) of each cluster: the bits of the digest's hexadecimal digits, the lowest of a digit first."""
    bits = np.unpackbits(digests(keys, -(-flips // BITS), seed), axis=2, bitorder="little").reshape(len(keys), -1, 2, 4)
    return 2.0 * bits[:, :, ::-1].reshape(len(keys), -1)[:, :flips] - 1.0


def weighted(sums: DataFrame, columns: list[str], weights: Callable[[Sequence[str | None]], np.ndarray], size: int, name: str) -> DataFrame:
    """name (0 to size - 1), drawn and the columns' sums over all clusters, each by its weight there. What leaves a task is a row for each number."""
    # a cluster is much work and a small row, so the tasks are not left to the rows' bytes
    parts = TASKS * sums.sparkSession.sparkContext.defaultParallelism
    own = sums.select(F.col(sums.columns[0]).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in columns]).repartition(parts, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, 1 + len(columns))), False
        for batch in batches:
            for at in range(0, batch.num_rows, CLUSTERS):
                part = batch.slice(at, CLUSTERS)
                w, seen = weights(part["key"].to_pylist()), True
                values = np.stack([part[c].to_numpy(zero_copy_only=False) for c in columns], 1)
                total[:, 0] += np.abs(w).sum(0)
                total[:, 1:] += w.T @ values
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *map(pa.array, np.ascontiguousarray(total.T))], [name, "drawn", *columns])

    found = own.mapInArrow(run, f"{name} long, drawn double, " + ", ".join(f"`{c}` double" for c in columns))
    return found.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("drawn", *columns)])


def resampled(sums: DataFrame, totals: list[str], resamples: int, seed: int) -> DataFrame:
    """resample and, for each of the totals, the mean per sample of each resample of whole clusters; one that draws no cluster is left out."""
    if resamples < 1:
        raise ValueError("at least one resample is needed")
    rows = weighted(sums, [*totals, "n"], lambda keys: draws(keys, resamples, seed), resamples, "resample").where("drawn > 0")
    return rows.select("resample", *[(F.col(c) / F.col("n")).alias(c) for c in totals])


def resampled_means(sums: DataFrame, resamples: int, seed: int) -> DataFrame:
    """resample, mean: the mean per sample of each resample of whole clusters; one that draws no cluster is left out."""
    return resampled(sums, ["total"], resamples, seed).withColumnRenamed("total", "mean")


def bootstrap(sums: DataFrame, resamples: int, seed: int) -> DataFrame:
    """mean, ci_low, ci_high in one row: the mean per sample and its 95 % interval; zeros where there are no clusters."""
    whole = sums.agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    means = resampled_means(sums, resamples, seed).agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))
    return whole.crossJoin(means).select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "ci_low", "ci_high")])


def flipped(sums: DataFrame, totals: list[str], flips: int, seed: int) -> DataFrame:
    """flip and, for each of the totals, the mean per sample when each cluster's sign is a coin's."""
    if flips < 1:
        raise ValueError("at least one flip is needed")
    whole = sums.agg(F.sum("n").alias("all"))
    some = sums.where(" or ".join(f"`{c}` <> 0" for c in totals))
    rows = weighted(some, totals, lambda keys: signs(keys, flips, seed), flips, "flip")
    return rows.crossJoin(whole).select("flip", *[(F.col(c) / F.col("all")).alias(c) for c in totals])


def flipped_means(sums: DataFrame, flips: int, seed: int) -> DataFrame:
    """flip, mean: the mean per sample when each cluster's sign is a coin's."""
    return flipped(sums, ["total"], flips, seed).withColumnRenamed("total", "mean")


def sign_flip(sums: DataFrame, flips: int, seed: int) -> DataFrame:
    """p_value in one row, two-sided: how often flips reach the mean that was seen, itself among them; 1 for a mean of zero."""
    seen = sums.agg(F.coalesce(F.abs(F.try_divide(F.sum("total"), F.sum("n"))), F.lit(0.0)).alias("seen"))
    hits = flipped_means(sums, flips, seed).crossJoin(seen).agg(F.count_if(F.abs("mean") >= F.col("seen") - 1e-12).alias("hits"))
    return hits.crossJoin(seen).select(F.when(F.col("seen") == 0, 1.0).otherwise((F.col("hits") + 1) / float(flips + 1)).alias("p_value"))


def paired(a: DataFrame, b: DataFrame, value: str, cluster: str = "group_key") -> DataFrame:
    """cluster, total, n of b's value less a's, over the samples of both."""
    other = b.select("sample_id", F.col(value).alias("other"))
    return cluster_sums(a.join(other, "sample_id").withColumn("delta", F.col("other") - F.col(value)), "delta", cluster)


def comparisons(sums: DataFrame, totals: dict[str, str], samples: int = 4000, flips: int = 12000, seed: int = 42) -> DataFrame:
    """metric, mean, ci_low, ci_high, p_value of each metric, whose sum per cluster is a column of sums (the cluster first, and n).

    All metrics share the weights and signs of their clusters, so a cluster's digests are made once."""
    sums, columns = sums.persist(), list(totals.values())
    seen = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("n")), F.lit(0.0))
    whole = sums.agg(*[seen(c).alias(f"mean_{i}") for i, c in enumerate(columns)])
    means = resampled(sums, columns, samples, seed).agg(*[F.coalesce(F.percentile(c, p), F.lit(0.0)).alias(f"{side}_{i}") for i, c in enumerate(columns) for side, p in (("low", 0.025), ("high", 0.975))])
    hits = flipped(sums, columns, flips, seed + 1).crossJoin(whole).agg(*[F.count_if(F.abs(c) >= F.abs(f"mean_{i}") - 1e-12).alias(f"hits_{i}") for i, c in enumerate(columns)])
    p_value = lambda i: F.when(F.col(f"mean_{i}") == 0, 1.0).otherwise((F.col(f"hits_{i}") + 1) / float(flips + 1))
    each = [F.struct(F.lit(m).alias("metric"), F.col(f"mean_{i}").alias("mean"), F.col(f"low_{i}").alias("ci_low"), F.col(f"high_{i}").alias("ci_high"), p_value(i).alias("p_value")) for i, m in enumerate(totals)]
    return whole.crossJoin(means).crossJoin(hits).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def comparison(a: DataFrame, b: DataFrame, value: str, cluster: str = "group_key", samples: int = 4000, flips: int = 12000, seed: int = 42) -> DataFrame:
    """mean, ci_low, ci_high, p_value of b against a, in one row."""
    return comparisons(paired(a, b, value, cluster), {value: "total"}, samples, flips, seed).drop("metric")


def own_cluster(outcomes: DataFrame) -> DataFrame:
    """outcomes with every sample as its own cluster, for statistics without groups."""
    return outcomes.withColumn("group_key", F.col("sample_id").cast("string"))


def sample_summary(outcomes: DataFrame, values: tuple[str, ...], samples: int = 4000, seed: int = 42) -> DataFrame:
    """metric, mean, ci_low, ci_high of each value when single samples are drawn again."""
    out = None
    for v in values:
        one = bootstrap(cluster_sums(own_cluster(outcomes), v), samples, seed).select(F.lit(v).alias("metric"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def sample_comparison(a: DataFrame, b: DataFrame, value: str, **options) -> DataFrame:
    """comparison over single samples."""
    return comparison(own_cluster(a), own_cluster(b), value, **options)
