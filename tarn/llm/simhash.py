"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in few bits agree on whole blocks of bits: with m blocks and at most d differing bits,
at least m - d blocks are the same. Each choice of m - d blocks is a table; fingerprints that share a key in a
table are compared, and the groups follow from the links that hold.

Groups by similarity (Jaccard, of the sets of shingles) take such links of all texts, each of them checked on the
sets. Pairs that fingerprints miss come by pigeonhole on the sets: in any one order of all shingles, two sets of a similarity t
share l of the first n - ceil(t n) + l of each. So no pair is missed, whatever its fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, packed, star_forest, table

BITS = 64
DISTANCE = 4
#: Words of a shingle in the query's contract; near-duplicate stages elsewhere take five.
QUERY_SHINGLE = 4
SHINGLE = 5
SEED = 42
#: Shingles whose bits are counted, or that are passed on, at once.
CHUNK = 1 << 16
#: Distinct fingerprints that one comparison task holds of each of two parts of a bucket; larger buckets are dealt to parts.
TILE = 4096
#: Distinct fingerprints that share a key by chance, at most, on average; tables get longer keys beyond.
CHANCE = 16
#: Bits in which fingerprints of the SimHash links may differ, where groups are by similarity.
GUESS = DISTANCE
#: Texts, on average, that are looked at for shingles that many texts have (one in SAMPLE_OF, and SAMPLE at least: a share of
#: a larger table that shrinks with it would miss shingles of ever more texts), and the most such shingles. Only the order of
#: the shingles depends on them: common ones come last, so that few texts share a key.
SAMPLE, SAMPLE_OF, COMMON, MOST_COMMON = 4_000, 16, 3, 1_000_000
#: Sets that share a key, up to which all their pairs are checked at once. Sets of larger keys are first put in groups.
FEW = 64
#: Pairs compared by size and place, or kept to drop repeats, at once.
PAIRS = 1 << 18
#: Odd numbers that mix the shingles of a set before the least of them is taken: similar sets mostly have equal least ones.
MIXERS = (1, 0x9E3779B97F4A7C15)
#: Rows of keys that a task looks at together.
ROWS = 1 << 16
#: Texts whose sets a task holds at once, besides the sets themselves.
TEXTS = 512
#: Sets, and bytes of sets, of each of the two parts of a crowded key that one tile holds, on average.
TILE_SETS, TILE_BYTES = 1024, 16 << 20
#: The bitmap that finds the documents of the sets that are needed; BITMAP bits are one row of it.
BITS_PER_NODE, MOST_BITS, BITMAP = 16, 1 << 30, 1 << 15


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of at most so many."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles in their order. Fewer words than the width are one shingle; none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; none give 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int) -> int:
    """Bit i is 1 if it is set in over half the shingles' hashes. Fewer words than the width are one shingle; none give 0."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row of docs, over its whole text; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, same: int) -> list[int]:
    """Masks of every choice of `same` out of `blocks` blocks of the 64 bits, as signed longs."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(own, same)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Blocks to cut into, so that few of n distinct fingerprints share a key by chance. Any number of blocks finds all links."""
    for blocks in range(distance + 2, 17):
        if n <= CHANCE << (BITS * (blocks - distance) // blocks):
            return blocks
    return 17


def close_pairs(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within each run of equal group numbers that differ in at most `distance` bits."""
    bits, sizes = fp.view(np.uint64), np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])))
    found_a, found_b = [], []
    of = np.repeat(sizes, sizes)
    small = np.flatnonzero(of <= 64)
    for step in range(1, int(of[small].max(initial=1))):
        i = small[small + step < len(fp)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        i = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= distance]
        found_a.append(fp[i])
        found_b.append(fp[i + step])
    start = 0
    for n in sizes.tolist():
        if n > 64:
            own = bits[start : start + n]
            for at in range(0, n, 256):
                i, j = np.nonzero(np.bitwise_count(own[at : at + 256, None] ^ own[None, at:]) <= distance)
                keep = i < j
                if keep.any():
                    x, y = star_forest(own[at + i[keep]].view(np.int64), own[at + j[keep]].view(np.int64))
                    found_a.append(x)
                    found_b.append(y)
        start += n
    if not found_a or not sum(map(len, found_a)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return star_forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp that connect all that lie within the distance of each other.

    Keys that a single fingerprint has are dropped before anything is compared. A bucket larger than TILE is dealt
    to parts by hash, and each pair of parts is a task of its own, so that no task holds more than two parts.
    What comes out of a bucket is a spanning forest of its links: at most a row for each fingerprint in it.
    """
    blocks = blocks_for(distinct.count(), distance)
    masks = block_masks(blocks, blocks - distance)
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(shared, ["t", "key"]).withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    rows = rows.select("t", "key", "fp", F.explode(F.expr("transform(sequence(0, parts - 1), o -> named_struct('p', least(part, o), 'q', greatest(part, o)))")).alias("o"))
    rows = rows.select("t", "key", "o.p", "o.q", "fp")
    dealt = rows.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = ["t", "key", "p", "q"]

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            group = (rows[by] != rows[by].shift()).any(axis=1).cumsum().to_numpy()
            a, b = close_pairs(rows["fp"].to_numpy(), group, distance)
            return pd.DataFrame({"a": a, "b": b})

        left = None
        for frame in frames:
            # a bucket may go on in the next batch
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            last = (frame[by] == frame[by].iloc[-1]).all(axis=1).to_numpy()
            cut = len(frame) - int(last.sum())
            left = frame.iloc[cut:]
            if cut:
                yield found(frame.iloc[:cut].reset_index(drop=True))
        if left is not None and len(left):
            yield found(left.reset_index(drop=True))

    return dealt.mapInPandas(run, "a long, b long").distinct()


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of shingles that several texts of a sample have, and in how many of them."""
    n = docs.count()
    share = min(1.0, max(n / SAMPLE_OF, SAMPLE) / max(1, n))
    # copies of a text have its shingles in one set
    some = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, held = [], 0
            for t in batch["text"]:
                sets.append(np.unique(shingle_hashes(t.as_py(), width)).view(np.int64))
                held += len(sets[-1])
                if held > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["h"])
                    sets, held = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["h"])

    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    got = often.orderBy(F.col("n").desc(), "h").limit(MOST_COMMON).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def least_shared(n: int | np.ndarray) -> int | np.ndarray:
    """Keys that a set of n shingles (or of each n) has to share with a similar one of at least its size: more of them leave fewer false candidates."""
    return 1 + n // 16


def least_shared_column(n: Column) -> Column:
    return 1 + F.floor(n / 16)


def prefix(own: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set (ascending hashes), rare ones first: a set at least so similar has least_shared of the smaller one among its own first."""
    n = len(own)
    if not n:
        return own
    hashes, times = common
    weight = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        weight = np.where(hashes[at] == own, times[at], 0)
    return own[np.argsort(weight, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + least_shared(n)]]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def set_rows(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, fp, node (digest of the set of shingles), n (its size), keys (the prefix, packed) and mins (the least mixed shingles) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TEXTS):
            fp, node, n, keys, mins = [], [], [], [], []
            for t in batch["text"]:
                hashes = shingle_hashes(t.as_py(), width)
                own = np.unique(hashes)
                fp.append(majority(hashes))
                node.append(set_id(own))
                n.append(len(own))
                keys.append(prefix(own, similarity, shared.value).tobytes())
                mins.append([int((own * np.uint64(m)).min(initial=np.iinfo(np.uint64).max).view(np.int64)) for m in MIXERS])
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, node, n)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *longs, pa.array(keys, pa.binary()), pa.array(mins, pa.list_(pa.int64()))], ["doc_id", "fp", "node", "n", "keys", "mins"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, node long, n long, keys binary, mins array<long>")


def may_be_similar(n: np.ndarray, place: np.ndarray, m: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles that share the ones at those places of their orders can be so similar."""
    most = np.minimum(n - place, m - at)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (most * (1 + similarity) >= similarity * (n + m) - 1e-6)


def shared_keys(sets: DataFrame, similarity: float) -> DataFrame:
    """What shares a prefix shingle; sets: node, n, keys.

    Where at most FEW sets have it: a null key, a pair a < b of sets of fitting sizes, and how many such keys they were seen
    to share and need. Where more have it: the key, a the set, and b its size and the place of the shingle, packed.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k.as_py(), np.int64) for k in batch["keys"]]
            sizes = [len(k) for k in keys]
            if sum(sizes):
                packed = (np.repeat(batch["n"].to_numpy(), sizes) << 32) + np.concatenate([np.arange(k) for k in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch["node"].to_numpy(), sizes)), pa.array(packed)], ["key", "a", "b"])

    def out(key: np.ndarray | None, a: np.ndarray, b: np.ndarray, seen: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if key is None else pa.array(key), *map(pa.array, (a, b, seen, need))], ["key", "a", "b", "seen", "need"])

    def folded(pairs: list[np.ndarray]) -> np.ndarray:
        """a, b, seen, need of every pair once."""
        rows = np.concatenate(pairs)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:, :2] != rows[:-1, :2]).any(1)]))
        once = rows[starts]
        once[:, 2] = np.add.reduceat(rows[:, 2], starts) if len(starts) else 0
        return once

    def found(key: np.ndarray, node: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(many, pairs): which rows have a key of more than FEW sets; the pairs of the others."""
        n, place = packed >> 32, packed & ((1 << 32) - 1)
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        many = np.repeat(np.diff(edges), np.diff(edges)) > FEW
        pairs, i = [], np.flatnonzero(~many)
        for step in range(1, FEW):
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            if not len(i):
                break
            j = i + step
            less = np.minimum(n[i], n[j])
            fit = less >= similarity * np.maximum(n[i], n[j]) - 1e-6
            pairs.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.ones_like(less), least_shared(less)], 1)[fit])
        return many, np.concatenate(pairs) if pairs else np.zeros((0, 4), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []  # rows whose key may go on
        pairs: list[np.ndarray] = []
        held = waiting = 0

        def look(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal pairs, held
            many, new = found(rows[:, 0], rows[:, 1], rows[:, 2])
            if many.any():
                yield out(*(np.ascontiguousarray(rows[many, k]) for k in range(3)), *np.zeros((2, int(many.sum())), np.int64))
            pairs.append(new)
            held += len(new)
            if held > PAIRS:
                pairs = [folded(pairs)]
                held = len(pairs[0])
                if held > PAIRS // 2:
                    yield out(None, *np.ascontiguousarray(pairs[0].T))
                    pairs, held = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(np.stack([batch[c].to_numpy() for c in ("key", "a", "b")], 1))
            waiting += batch.num_rows
            if waiting >= ROWS:
                rows = np.concatenate(parts)
                cut = int(np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))[-1])
                if cut:
                    yield from look(rows[:cut])
                parts, waiting = [rows[cut:]], 0
        if parts:
            yield from look(np.concatenate(parts))
        if held:
            yield out(None, *np.ascontiguousarray(folded(pairs).T))

    rows = sets.select("node", "n", "keys").mapInArrow(deal, "key long, a long, b long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long, seen long, need long")


class Tile:
    """The sets of a tile (of a key, or of two parts of it) and the links between them that were not known."""

    def __init__(self, key: int, same: bool, rows: list[dict]):
        rows = list({r["node"]: r for r in rows}.values())
        self.node, self.n, self.place, self.root, self.part = (np.array([r[c] for r in rows], np.int64) for c in ("node", "n", "place", "root", "part"))
        self.keys, self.key_starts, self.key_count = self.numbered([np.array(r["keys"], np.int64) for r in rows])
        # which keys come before this one in the order of the set
        self.lower = np.concatenate([np.cumsum(np.array(r["keys"], np.int64) == key) == 0 for r in rows])
        self.sets, self.set_starts, self.set_count = self.numbered([np.frombuffer(r["own"], np.int64) for r in rows])
        self.same = same

    @staticmethod
    def numbered(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """All members one after the other as numbers from 0, where each list starts, and how many numbers there are."""
        names, numbers = np.unique(np.concatenate(lists), return_inverse=True)
        return numbers, np.concatenate([[0], np.cumsum([len(x) for x in lists])]), len(names)

    @staticmethod
    def shared(marks: np.ndarray, numbers: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """How many of each list's members are marked, for the lists `which`."""
        sizes = starts[which + 1] - starts[which]
        at = np.repeat(starts[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.add.reduceat(marks[numbers[at]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))

    def links(self, similarity: float) -> tuple[list[int], list[int]]:
        """Pairs of nodes at least so similar that connect what wasn't connected.

        A pair is looked at if it shares no crowded key before this one (there it is looked at too; the order is that of all sets,
        as the places are those of the first shingle in common), enough crowded keys for what it may have in common, and if its
        sizes and places allow the similarity; then its sets are compared.
        """
        found_a: list[int] = []
        found_b: list[int] = []
        marks, low, own = np.zeros(self.key_count, bool), np.zeros(self.key_count, bool), np.zeros(self.set_count, bool)
        for i in range(len(self.node) - 1):
            j = np.arange(i + 1, len(self.node))
            j = j[(self.root[j] != self.root[i]) & (self.same | (self.part[j] != self.part[i]))]
            j = j[may_be_similar(self.n[i], self.place[i], self.n[j], self.place[j], similarity)]
            if not len(j):
                continue
            mine = slice(self.key_starts[i], self.key_starts[i + 1])
            marks[self.keys[mine]] = True
            low[self.keys[mine][self.lower[mine]]] = True
            enough = self.shared(marks, self.keys, self.key_starts, j) >= least_shared(np.minimum(self.n[i], self.n[j]))
            j = j[enough & (self.shared(low, self.keys, self.key_starts, j) == 0)]
            marks[self.keys[mine]] = low[self.keys[mine]] = False
            if not len(j):
                continue
            mine = slice(self.set_starts[i], self.set_starts[i + 1])
            own[self.sets[mine]] = True
            both = self.shared(own, self.sets, self.set_starts, j)
            own[self.sets[mine]] = False
            for k in j[both >= similarity * (self.n[i] + self.n[j] - both) - 1e-9].tolist():
                if self.root[k] != self.root[i]:
                    found_a.append(int(self.node[i]))
                    found_b.append(int(self.node[k]))
                    self.root[self.root == self.root[k]] = self.root[i]
        return found_a, found_b


def open_links(rows: DataFrame, docs: DataFrame, named: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links at least so similar between sets of different groups that share crowded keys alone.

    rows: key, node, n, place, root of the crowded keys. Only keys of several groups matter. The sets themselves are dealt to
    tiles of such a key, each set once to a tile, and compared there; what comes out is what connects groups, and no pairs.
    Similar sets share least_shared keys, so the first one is never among the last of a set's: those are left out.
    """
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), F.sum("n").alias("total")).where("low <> high")
    mixed = mixed.select("key", F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(8 * F.col("total") / TILE_BYTES)).cast("int").alias("parts"))
    rows = packed(rows.join(mixed, "key"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda k: k["key"])
    keys = checkpoint(rows.groupBy("node").agg(ordered.alias("keys")))
    sets = sets_of(docs, named.join(keys.select("node"), "node", "left_semi"), width)
    first = F.array_position("keys", F.col("key")) <= F.size("keys") - least_shared_column(F.ceil(similarity * F.col("n") - 1e-6)) + 1
    rows = rows.join(keys, "node").where(first).join(sets, "node").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    tiles = F.explode(F.expr("transform(sequence(0, parts - 1), o -> named_struct('p', least(part, o), 'q', greatest(part, o)))")).alias("o")
    by = ["key", "p", "q"]
    names = ["node", "n", "place", "root", "part", "keys", "own"]
    dealt = rows.select("key", *names, tiles).select("key", "o.p", "o.q", *names).repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int, int] | None = None
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            a, b = Tile(at[0], at[1] == at[2], held).links(similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in sliced(batches, TEXTS):
            for tile, row in zip(zip(*(batch[c].to_pylist() for c in by)), batch.select(names).to_pylist()):
                if tile != at:
                    if at is not None:
                        yield out()
                    at, held = tile, []
                held.append(row)
        if at is not None:
            yield out()

    return dealt.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar; named: node and least, a document that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(batch["x"], batch["y"])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # both joins deal the sets by node, so one exchange serves them
    sets = sets_of(docs, named.join(needed, "node", "left_semi"), width)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, own of the given nodes(node, least), and of some others, from the texts of the documents least (whole numbers, or null).

    A bitmap finds the documents, so texts are not shuffled: BITS_PER_NODE bits for a node and MOST_BITS at most, put together in
    Spark. A set may come more than once.
    """
    least = nodes.where("least is not null").select("least")
    size = min(MOST_BITS, max(CHUNK, BITS_PER_NODE * least.count()))
    place = F.pmod("least", F.lit(size)) + 1
    held = np.zeros(-(-size // BITMAP) * BITMAP // 8, np.uint8)
    for r in least.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        held[(r["at"] - 1) * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TEXTS):
            null = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            i = np.mod(batch["doc_id"].cast(pa.int64()).fill_null(0).to_numpy(), size)
            keep = null | (shared.value[i >> 3] >> (i & 7) & 1).astype(bool)
            if not keep.any():
                continue
            own = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch["text"].filter(pa.array(keep))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([set_id(x) for x in own], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "own"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, own binary")


def similar_components(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, fp, component_id of every row of docs; links are all pairs whose sets of shingles are at least so similar.

    Equal sets are one node from the start. The links of close fingerprints (SimHash) of all sets are checked on the sets. So is
    every pair that shares a key of its prefixes, as fingerprints alone miss similar sets; where a key is crowded (more than FEW
    have it), links of equal least shingles are checked first, and then the pairs that are not in one group by now.
    """
    rows = checkpoint(set_rows(docs, width, similarity))
    named = packed(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("mins").alias("mins")))
    shared = checkpoint(shared_keys(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), similarity))
    rows = rows.select("doc_id", "fp", "node")
    crowded = named.join(shared.where("key is not null").select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    first = named.groupBy("fp").agg(F.min("node").alias("first"))
    equal = named.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(packed(first.select("fp")), GUESS).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    mixed = crowded.select("node", F.posexplode("mins").alias("j", "m"))
    centre = mixed.groupBy("j", "m").agg(F.min("node").alias("first")).repartition(F.xxhash64("j", "m"))
    alike = mixed.join(centre, ["j", "m"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    guesses = equal.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # two sets that both have crowded keys may share more than was seen
    seen = shared.where("key is null").groupBy("a", "b").agg(F.sum("seen").alias("seen"), F.first("need").alias("need"))
    seen = seen.join(crowded.select(F.col("node").alias("a"), F.lit(True).alias("x")), "a", "left").join(crowded.select(F.col("node").alias("b"), F.lit(True).alias("y")), "b", "left")
    pairs = packed(seen.where("seen >= need or x and y").select("a", "b").unionByName(guesses).distinct())
    sure = packed(verified(pairs, docs, named, width, similarity))
    known = connected_components(sure).select("node", F.col("component").alias("root"))
    open_rows = shared.where("key is not null").select("key", F.col("a").alias("node"), F.shiftright("b", 32).alias("n"), F.expr("b & 4294967295").alias("place"))
    open_rows = open_rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = packed(open_links(open_rows, docs, named, width, similarity))
    if not left.isEmpty():
        grouped = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
        known = connected_components(packed(grouped.unionByName(left))).select("node", F.col("component").alias("root"))
    rooted = named.join(known, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).repartition(F.xxhash64("root"))
    return rows.join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "fp", "component_id")


def components(docs: DataFrame, width: int = SHINGLE, distance: int | float = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id of every row of docs: the least doc_id reachable over links, its own included.

    The distance is a number of bits between fingerprints (int), or one less the similarity of the sets of shingles (float).

    Equal fingerprints are one node from the start, so groups of copies cost one row each. Null and empty texts
    have the fingerprint zero and are linked like any other; repeated rows each give a row; a null doc_id belongs
    to its group but is never its least (a group of nulls alone has a null component); an empty table gives an
    empty result; other columns of docs are not looked at.
    """
    if isinstance(distance, float):
        return similar_components(docs, width, 1 - distance)
    rows = checkpoint(fingerprints(docs, width))
    distinct = packed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(packed(links(distinct.select("fp"), distance))).alias("g")
    nodes = distinct.join(groups, F.col("fp") == F.col("g.node"), "left").select("fp", "least", F.coalesce("g.component", "fp").alias("root"))
    # dealt out anew, so that the join with the nodes of a large group can be split
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id")).repartition(F.xxhash64("root"))
    nodes = nodes.join(named, "root").select("fp", "component_id")
    return rows.join(nodes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, distance: int | float = DISTANCE) -> DataFrame:
    """The rows of docs that are the first of their group, all their columns with them: the least doc_id stays.

    Of rows that repeat the least doc_id, one stays: the one whose text has the least digest. Rows whose group has
    no doc_id at all stay.
    """
    firsts = components(docs, width, distance).where("component_id is null or doc_id = component_id").groupBy(F.col("doc_id").alias("own_id")).agg(F.count("*").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id")
    single = rows.join(firsts, F.col("doc_id") == F.col("own_id")).select("row", "doc_id", "times")
    repeated = single.where("times > 1").groupBy("doc_id").agg(F.min_by("row", F.md5(F.coalesce("row.text", F.lit("")))).alias("row"))
    nameless = rows.where("doc_id is null").join(F.broadcast(firsts.where("own_id is null").select("times")), how="left_semi")
    return single.where("times = 1").select("row.*").unionByName(repeated.select("row.*")).unionByName(nameless.select("row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = components(table(spark, sf_dir, "documents"), QUERY_SHINGLE)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
