"""Embedding near-duplicates by lattice hashing.

In each table a random projection takes a unit vector to a few 8-dimensional blocks, and each block is decoded to
the nearest point of the lattice E8. The points name the vector's cell; it also looks into neighbouring cells, in
which one block is moved to its second nearest point. Vectors that meet in a cell are verified by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, table

COSINE = 0.93
TABLES = 12
#: Blocks of 8 dimensions that name a cell together.
BLOCKS = 2
#: Distance of neighbouring lattice points, as a part of the projected unit vectors' mean norm in a block.
CELL = 0.85
SEED = 7
#: Vectors that one comparison task holds of each of two parts of a cell or group; larger ones are dealt to parts.
TILE = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0 ...) in all places, and (+-1/2 ...) with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.stack(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: round, and where the sum is odd, round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - r[odd]
        k = np.abs(off).argmax(1)
        r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 moved by one half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = np.square(x - a).sum(1) <= np.square(x - b).sum(1)
    return np.where(closer[:, None], a, b)


def projections(width: int, seed: int = SEED) -> np.ndarray:
    """For each table, orthonormal rows (as far as the width allows) for its blocks."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(TABLES):
        rows: list[np.ndarray] = []
        while len(rows) < 8 * BLOCKS:
            q, _ = np.linalg.qr(rng.standard_normal((width, width)))
            rows += list(q.T)
        out.append(np.stack(rows[: 8 * BLOCKS]))
    return np.stack(out)


def cells(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, TABLES, 1 + BLOCKS) cell codes of unit vectors, the own cell first; and which of them are the own cell."""
    minimal, n = minimal_vectors(), len(x)
    width = x.shape[1]
    # a lattice step of sqrt(2) becomes CELL times the mean norm sqrt(8 / width) of a projected block
    scale = np.sqrt(2) / (CELL * np.sqrt(8 / width))
    mixers = np.random.default_rng(99).integers(1, 1 << 62, (BLOCKS, 8), dtype=np.int64) | 1
    out = np.empty((n, len(planes), 1 + BLOCKS), np.int64)
    with np.errstate(over="ignore"):
        for t, plane in enumerate(planes):
            own, near = [], []
            for b in range(BLOCKS):
                y = x @ plane[8 * b : 8 * b + 8].T * scale
                p = nearest_e8(y)
                second = p + minimal[(2 * (y - p) @ minimal.T).argmax(1)]
                own.append((np.rint(2 * p).astype(np.int64) * mixers[b]).sum(1))
                near.append((np.rint(2 * second).astype(np.int64) * mixers[b]).sum(1))
            total = np.sum(own, axis=0)
            out[:, t, 0] = total
            for b in range(BLOCKS):
                out[:, t, 1 + b] = total - own[b] + near[b]
    return out, np.arange(1 + BLOCKS) == 0


def unit(vectors: list, width: int) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square is too large or too small."""
    x = np.array(vectors, np.float64).reshape(len(vectors), width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def close(x: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of unit rows have that cosine. Products so near to it that they depend on how blocks are multiplied are summed again in one way."""
    product = x @ x.T
    near = product >= cosine
    a, b = np.nonzero(np.abs(product - cosine) < 1e-9)
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        near[i, j] = (x[i] * x[j]).sum(1) >= cosine
    return near


def star_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of 0 .. n-1 reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for at in (a, b, before[a], before[b]):
            np.minimum.at(root, at, low)
        root = root[root]
        if (root == before).all():
            return root


def in_groups(rows: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """run(frame) -> frame for the rows of each group, which are dealt by the columns `by`; groups must be bounded."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            starts = np.flatnonzero((frame[by] != frame[by].shift()).any(axis=1).to_numpy())
            for a, b in zip(starts, starts[1:]):
                if len(got := run(frame.iloc[a:b])):
                    yield got
            left = frame.iloc[starts[-1] :] if len(starts) else None
        if left is not None and len(left) and len(got := run(left)):
            yield got

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(stream, schema)


def tiled(rows: DataFrame, size: str, node: str) -> DataFrame:
    """rows with p, q: those of a group of more than TILE rows (column `size`) come once for each pair of parts that theirs is in."""
    parts = F.ceil(F.col(size) / TILE).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.expr(f"cast(pmod(xxhash64({node}), parts) as int)"))
    pair = "transform(sequence(0, parts - 1), o -> named_struct('p', least(part, o), 'q', greatest(part, o)))"
    return rows.withColumn("o", F.explode(F.expr(pair))).withColumn("p", F.col("o.p")).withColumn("q", F.col("o.q")).drop("o", "parts")


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: vec_id and label not null, all components finite and not all zero, of one width per table."""
    fine = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    return vectors.where("vec_id is not null and label is not null").where(F.coalesce(fine, F.lit(False)))


def candidate_links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b): verified links between classes (node, label, embedding) that meet in a cell of some table, as spanning forests."""

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            lengths = frame["embedding"].map(len)
            for width, part in frame.groupby(lengths):
                planes.setdefault(width, projections(width))
                for at in range(0, len(part), 2000):
                    own = part.iloc[at : at + 2000]
                    codes, home = cells(unit(own["embedding"].tolist(), width), planes[width])
                    n, t, k = codes.shape
                    yield pd.DataFrame({"node": np.repeat(own["node"].to_numpy(), t * k), "label": np.repeat(own["label"].to_numpy(), t * k), "width": np.int32(width), "t": np.tile(np.repeat(np.arange(t, dtype=np.int32), k), n), "cell": codes.ravel(), "home": np.tile(home.astype(np.int32), n * t)})

    kind = dict(classes.dtypes)["label"]
    keyed = checkpoint(classes.select("node", "label", "embedding").mapInPandas(coded, f"node long, label {kind}, width int, t int, cell long, home int"))
    by = ["label", "width", "t", "cell"]
    shared = keyed.groupBy(*by).agg(F.count("*").alias("n"), F.sum("home").alias("homes")).where("n > 1 and homes > 0").drop("homes")
    rows = tiled(keyed.join(shared, by), "n", "node")
    rows = rows.join(classes.select("node", "embedding"), "node").select(*by, "p", "q", "node", "embedding")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["node"].to_numpy()
        x = unit(frame["embedding"].tolist(), len(frame["embedding"].iloc[0]))
        a, b = np.nonzero(np.triu(close(x, cosine), 1))
        root = ids[star_forest(len(ids), a, b)]
        return pd.DataFrame({"a": ids[root != ids], "b": root[root != ids]})

    return in_groups(rows, [*by, "p", "q"], verify, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Vectors are compared when their labels are equal and not null. Exact copies are one node from the start and
    count in n_links. The links that the tables find connect vectors to groups; n_links is then counted exactly
    inside each group, in blocks, so that a dense group costs a row per vector and pair of parts and not one per link.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, link with
    nothing; vectors of different widths neither. Repeated rows each give a row and count as copies; if one vec_id
    carries several vectors, these share one node's component and the links of all. An empty table gives an empty result.
    """
    rows = usable(vectors.select("vec_id", "embedding", "label"))
    classes = checkpoint(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    groups = checkpoint(connected_components(candidate_links(classes, cosine)))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = tiled(groups.join(sizes, "component").withColumnRenamed("component", "root"), "n", "node")
    members = members.join(classes, "node").select("root", "label", "p", "q", "part", "node", "embedding", "copies")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.groupby(frame["embedding"].map(len)):
            x, copies, part = unit(own["embedding"].tolist(), len(own["embedding"].iloc[0])), own["copies"].to_numpy(np.float64), own["part"].to_numpy()
            near = close(x, cosine)
            np.fill_diagonal(near, False)
            if own["p"].iloc[0] != own["q"].iloc[0]:
                near &= part[:, None] != part[None, :]  # pairs within a part are counted in the part's own task
            out.append(pd.DataFrame({"node": own["node"].to_numpy(), "near": (near @ copies).astype(np.int64)}))
        return pd.concat(out)

    near = in_groups(members, ["root", "label", "p", "q"], count, "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))
    nodes = classes.select("label", "embedding", "node", "copies").alias("c").join(groups.alias("g"), F.col("c.node") == F.col("g.node"), "left").join(near.alias("n"), F.col("c.node") == F.col("n.node"), "left")
    nodes = nodes.select("c.label", "c.embedding", "c.node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("g.component", "c.node").alias("component_id"))
    # the least vec_id of a component is a node's own, as nodes are named by their least vec_id
    out = vectors.select("vec_id", "embedding", "label").join(nodes, ["label", "embedding"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.col("n_links"))
    return out.select("vec_id", F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
