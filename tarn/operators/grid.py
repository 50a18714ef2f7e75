"""Grids of scores, and the whole grid of file-first reranking, evaluated inside the pools.

A pool gives, for every point of the grid, how many candidates stand above its best gold one. Tasks add the outcomes up per
point, so a candidate is read once and never copied, however many points there are. Pools of equal size are looked at together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOURCES = ("model", "semantic", "hybrid_norm")
MODES = ("max", "mean", "top2_mean")
ALPHAS = (0.1, 0.25, 0.5, 1.0, 1.5)
TOP_FILES = (0, 1, 2, 3, 4)
PENALTIES = (0.0, 0.25, 0.5, 1.0)
#: Numbers that an array over pools, points and candidates holds, about; pools of more than LARGE candidates are looked at one by one.
CELLS, LARGE = 1 << 18, 32
#: Flags of a long.
BITS = 62
POINT = "policy string, file_source string, agg_mode string, alpha double, top_files int, outside_penalty double"


def in_pools(rows: DataFrame) -> DataFrame:
    """rows with `at`, 1 for the first of a pool; a task has whole pools, one after the other, each in the order of pos."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("sample_id").orderBy("pos")))


def whole_pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of in_pools again, so that no pool is cut; each table has some."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(batch["at"].to_numpy() == 1)
        if len(first):
            if left or first[-1]:
                yield pa.Table.from_batches([*left, batch.slice(0, first[-1])])
            left = [batch.slice(first[-1])]
        elif batch.num_rows:
            left.append(batch)
    if left:
        yield pa.Table.from_batches(left)


def of_one_size(at: np.ndarray, points: int) -> Iterator[np.ndarray]:
    """Row numbers (pools x candidates) of pools of one size, few enough for arrays over that many points."""
    starts = np.flatnonzero(at == 1)
    sizes = np.diff(np.append(starts, len(at)))
    for n in np.unique(sizes):
        own, step = starts[sizes == n], max(1, CELLS // (int(n) * points))
        for a in range(0, len(own), step):
            yield own[a : a + step, None] + np.arange(n)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)) / 10.0**digits


def best_ranks(v: np.ndarray, null: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """The rank of the best gold candidate (0 without one) of v (pools x candidates x points): equal scores keep their order, nulls come behind numbers and NaN last."""
    if null.any() or np.isnan(v).any():
        kind = np.where(null, 1, np.where(np.isnan(v), 2, 0))
        order = np.lexsort((-np.where(kind == 0, v, 0.0), kind), axis=1)
        ranks = 1 + np.take_along_axis(np.broadcast_to(gold[:, :, None], v.shape), order, 1).argmax(1)
    else:
        best = np.where(gold[:, :, None], v, -np.inf).max(1)[:, None]
        equal = v == best
        first = (equal & gold[:, :, None]).argmax(1)[:, None]
        ranks = 1 + (v > best).sum(1) + (equal & (np.arange(v.shape[1])[None, :, None] < first)).sum(1)
    return np.where(gold.any(1)[:, None], ranks, 0)


def outcome_stack(ranks: np.ndarray, k: int) -> np.ndarray:
    """n, hit_1, hit_k, rr, rr_k of ranks, on a new last axis."""
    inside = (ranks >= 1) & (ranks <= k)
    rr = np.where(ranks > 0, 1 / np.maximum(ranks, 1), 0.0)
    return np.stack([np.ones(ranks.shape), ranks == 1, inside, rr, np.where(inside, rr, 0.0)], -1)


def point_metrics(rows: DataFrame, points: list[tuple[dict, Column]], k: int = 3, digits: int | None = None) -> DataFrame:
    """The labels, n, hit_1, hit_k, mrr, mrr_k of every point, which has labels and a score. rows: sample_id, pos, is_gold and what the
    scores need. digits rounds the scores before they are ranked. Pools without gold count as misses; without rows the result is empty."""
    scores, size = F.array(*[score.cast("double") for _, score in points]), len(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, 5)), False
        for table in whole_pools(batches):
            seen = True
            flat = table["scores"].combine_chunks().flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size)
            values = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
            values = values if digits is None else rounded(values, digits)
            gold = table["gold"].to_numpy()
            for i in of_one_size(table["at"].to_numpy(), size):
                total += outcome_stack(best_ranks(values[i], null[i], gold[i]), k).sum(0)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], ["point", "n", "hit_1", "hit_k", "mrr", "mrr_k"])

    own = in_pools(rows.select("sample_id", "pos", F.coalesce("is_gold", F.lit(False)).alias("gold"), scores.alias("scores")))
    parts = own.select("at", "gold", "scores").mapInArrow(run, "point int, n double, hit_1 double, hit_k double, mrr double, mrr_k double")
    names, n = list(points[0][0]), F.sum("n")
    label = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in own.items()]) for own, _ in points]), F.col("point") + 1)
    sums = parts.groupBy("point").agg(n.cast("long").alias("n"), *[(F.sum(c) / n).alias(c) for c in ("hit_1", "hit_k", "mrr", "mrr_k")])
    return sums.select(*[label[c].alias(c) for c in names], "n", "hit_1", "hit_k", "mrr", "mrr_k")


def to_unit(values: np.ndarray) -> np.ndarray:
    """From 0 to 1; ones where all are equal."""
    low, high = values.min(), values.max()
    return np.ones(len(values)) if high <= low else (values - low) / (high - low)


def file_values(values: np.ndarray, file: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Each file's value: the max, the mean, or the mean of its two best."""
    order = np.lexsort((-values, file))
    starts = np.searchsorted(file[order], np.arange(n))
    sizes = np.diff(np.append(starts, len(values)))
    best = values[order][starts]
    if mode == "max":
        return best
    if mode == "mean":
        return np.bincount(file, values, n) / sizes
    if mode == "top2_mean":
        second = values[order][np.minimum(starts + 1, len(values) - 1)]
        return np.where(sizes > 1, (best + second) / 2, best)
    raise ValueError(f"Unsupported aggregation mode: {mode}")


def first_ranks(scores: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """The rank of the best gold candidate in each row of scores; equal scores keep their order. 0 without gold."""
    if not gold.any():
        return np.zeros(scores.shape[:-1], np.int64)
    best = scores[..., gold].max(-1, keepdims=True)
    at = ((scores == best) & gold).argmax(-1)[..., None]
    return 1 + (scores > best).sum(-1) + ((scores == best) & (np.arange(scores.shape[-1]) < at)).sum(-1)


def pool_ranks(score: np.ndarray, other: np.ndarray, path: np.ndarray, gold: np.ndarray, axes: tuple, digits: int | None) -> tuple[np.ndarray, int]:
    """The first gold rank at each point (sources x modes x alphas x top files x penalties), and that of the scores as they are."""
    sources, modes, alphas, tops, penalties = axes
    names, first, file = np.unique(path, return_index=True, return_inverse=True)
    known = {"model": score, "semantic": other}
    if "hybrid_norm" in sources:
        known["hybrid_norm"] = (to_unit(score) + to_unit(other)) / 2
    out = np.zeros(tuple(map(len, axes)), np.int64)
    exact = (lambda x, less=0: x) if digits is None else (lambda x, less=0: np.round(x, digits - less))
    for (i, source), (j, mode) in product(enumerate(sources), enumerate(modes)):
        share = exact(to_unit(exact(file_values(known[source], file, len(names), mode))), 3)
        place = np.empty(len(names), np.int64)
        place[np.lexsort((first, -share))] = np.arange(1, len(names) + 1)
        raised = score + np.array(alphas)[:, None] * share[file]
        outside = np.array([(t > 0) & (place[file] > t) for t in tops])
        points = raised[:, None, None] - np.array(penalties)[None, None, :, None] * outside[None, :, None]
        out[i, j] = first_ranks(exact(points), gold)
    return out, int(first_ranks(exact(score[None]), gold)[0])


def equal_pool_ranks(score: np.ndarray, other: np.ndarray, path: np.ndarray, gold: np.ndarray, axes: tuple, digits: int | None) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """What pool_ranks gives, for pools of one size with finite scores (all arrays pools x candidates): source and mode, and ranks (pools x alphas x top files x penalties)."""
    sources, modes, alphas, tops, penalties = axes
    pools, n = score.shape
    same = path[:, :, None] == path[:, None, :]
    first = same.argmax(2)
    leads, sizes = first == np.arange(n), same.sum(2)
    exact = (lambda x, less=0: x) if digits is None else (lambda x, less=0: np.round(x, digits - less))

    def unit(v: np.ndarray) -> np.ndarray:
        low, high = v.min(1, keepdims=True), v.max(1, keepdims=True)
        return np.where(high <= low, 1.0, (v - low) / np.where(high <= low, 1.0, high - low))

    def of_files(v: np.ndarray, mode: str) -> np.ndarray:
        if mode == "mean":
            out = np.zeros(v.shape)
            for j in range(n):
                out += np.where(same[:, :, j], v[:, j, None], 0.0)
            return out / sizes
        own = np.where(same, v[:, None, :], -np.inf)
        best = own.max(2)
        if mode == "max":
            return best
        if mode == "top2_mean":
            return np.where(sizes > 1, (best + (np.partition(own, n - 2, 2)[:, :, n - 2] if n > 1 else best)) / 2, best)
        raise ValueError(f"Unsupported aggregation mode: {mode}")

    known = {"model": score, "semantic": other}
    if "hybrid_norm" in sources:
        known["hybrid_norm"] = (unit(score) + unit(other)) / 2
    for (i, source), (j, mode) in product(enumerate(sources), enumerate(modes)):
        share = exact(unit(exact(of_files(known[source], mode))), 3)
        ahead = (share[:, None, :] > share[:, :, None]) | ((share[:, None, :] == share[:, :, None]) & (first[:, None, :] < first[:, :, None]))
        place = 1 + (ahead & leads[:, None, :]).sum(2)
        raised = score[:, :, None] + np.array(alphas) * share[:, :, None]
        outside = (np.array(tops) > 0) & (place[:, :, None] > np.array(tops))
        points = raised[:, :, :, None, None] - np.array(penalties) * outside[:, :, None, :, None]
        ranks = best_ranks(exact(points).reshape(pools, n, -1), np.zeros(1, bool), gold)
        yield (i, j), ranks.reshape(pools, len(alphas), len(tops), len(penalties))


def hierarchical_grid(
    rows: DataFrame, policies: dict[str, Column], sources: tuple[str, ...] = SOURCES, modes: tuple[str, ...] = MODES, alphas: tuple[float, ...] = ALPHAS, top_files: tuple[int, ...] = TOP_FILES, penalties: tuple[float, ...] = PENALTIES, k: int = 3, digits: int | None = None
) -> DataFrame:
    """policy, file_source, agg_mode, alpha, top_files, outside_penalty, n, hit_1, hit_k, mrr, mrr_k of every point, in one pass.

    rows: sample_id, pos, path, score (of the model), other (the semantic score), is_gold; policies say for which pools the files
    come first (others keep the scores as they are). A file's place is by its value, then by where it first occurs.
    digits rounds values of files and scores before they are ranked, and shares to three digits less. Pools without gold count as misses; without rows the result is empty.
    """
    axes, names = (sources, modes, alphas, top_files, penalties), list(policies)
    shape = tuple(map(len, axes))
    applies = [F.coalesce(c.cast("boolean"), F.lit(False)) for c in policies.values()]
    flags = [sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(applies[a : a + BITS])), F.lit(0)).cast("long") for a in range(0, len(applies), BITS)]
    own = rows.select("sample_id", "pos", F.coalesce("path", F.lit("")).alias("path"), F.col("score").cast("double").alias("score"), F.col("other").cast("double").alias("other"), F.coalesce("is_gold", F.lit(False)).alias("gold"), *[c.alias(f"flags{i}") for i, c in enumerate(flags)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(names), *shape, 5)), False
        for table in whole_pools(batches):
            seen = True
            score, other, gold, at = (table[c].to_numpy() for c in ("score", "other", "gold", "at"))
            path = table["path"].combine_chunks().dictionary_encode().indices.to_numpy()
            text = None
            bits = np.stack([table[f"flags{p // BITS}"].to_numpy() >> (p % BITS) & 1 for p in range(len(names))], 1).astype(bool)
            finite = np.isfinite(score) & np.isfinite(other)
            for i in of_one_size(at, len(alphas) * len(top_files) * len(penalties)):
                on = bits[i[:, 0]].astype(float)
                if i.shape[1] <= LARGE and finite[i].all():
                    plain = outcome_stack(best_ranks((score[i] if digits is None else np.round(score[i], digits))[:, :, None], np.zeros(1, bool), gold[i])[:, 0], k)
                    total += ((1 - on).T @ plain)[:, None, None, None, None, None]
                    for place, ranks in equal_pool_ranks(score[i], other[i], path[i], gold[i], axes, digits):
                        each = outcome_stack(ranks, k)
                        total[(slice(None), *place)] += (on.T @ each.reshape(len(i), -1)).reshape(len(names), *each.shape[1:])
                    continue
                text = table["path"].to_numpy().astype(str) if text is None else text
                for pool, applied in zip(i, on):
                    ranks, plain = pool_ranks(score[pool], other[pool], text[pool], gold[pool], axes, digits)
                    total += np.where(applied[:, None, None, None, None, None, None] > 0, outcome_stack(ranks, k), outcome_stack(np.array(plain), k))
        if seen:
            points = list(zip(*product(names, *axes)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(points, fields)] + [pa.array(x) for x in total.reshape(-1, 5).T.copy()], schema=schema)

    fields = [("policy", pa.string()), ("file_source", pa.string()), ("agg_mode", pa.string()), ("alpha", pa.float64()), ("top_files", pa.int32()), ("outside_penalty", pa.float64())]
    schema = pa.schema([*fields, *[(c, pa.float64()) for c in ("n", "hit_1", "hit_k", "mrr", "mrr_k")]])
    parts = in_pools(own).drop("sample_id", "pos").mapInArrow(run, POINT + ", n double, hit_1 double, hit_k double, mrr double, mrr_k double")
    by = ["policy", "file_source", "agg_mode", "alpha", "top_files", "outside_penalty"]
    n = F.sum("n")
    return parts.groupBy(*by).agg(n.cast("long").alias("n"), *[(F.sum(c) / n).alias(c) for c in ("hit_1", "hit_k", "mrr", "mrr_k")])
