"""Repeated passages by suffix order: bytes that a string of WIDTH bytes covers which also starts in a document with a smaller id.

A window's key is the least hash of the short strings in it, so equal windows have equal keys, and windows that
follow one another mostly share theirs: a run of them is a segment. Keys that one document has alone are dropped;
the segments of all others go to shards by key, and each shard sorts its suffixes by external induction
(see induced.py). Suffixes that agree in WIDTH bytes are neighbours, and the least id among them decides.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .induced import CAP, Inducer

WIDTH = 50
#: Bytes of the strings whose least hash is a window's key.
GRAM = 16
#: Windows of a segment at most; longer runs of one key are cut.
RUN = 64
#: Bytes of text whose keys one bucket holds, about.
BUCKET_BYTES = 1 << 24
#: Shards of segments for each bucket of keys.
SHARDS = 1
#: Bytes of text whose segments are numbered together.
LOT_BYTES = 1 << 22
#: Leading bytes of a key that decide whether it is repeated; two keys of a bucket that agree by chance cost a comparison.
KEY_BYTES = 5
#: Segments whose least id a task keeps in mind, and bytes of segments that it sends on at once.
REMEMBERED = 150_000
SENT_BYTES = 1 << 23
#: Bytes of segments whose windows are hashed at a time, in arrays that a core's cache holds.
HASHED_BYTES = 1 << 18
NONE = np.iinfo(np.int64).max


def hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each position on; data has n bytes at least."""
    with np.errstate(over="ignore"):
        h, have = data.astype(np.uint64) + np.uint64(1), 1
        while have < n:
            step = min(have, n - have)
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + mixed[step:]
            have += step
    return h ^ (h >> np.uint64(32))


def window_keys(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The key of the window that starts at each position, as int64; empty for a text shorter than a window."""
    if len(data) < width:
        return np.zeros(0, np.int64)
    gram = min(GRAM, width)
    h = hashes(data, gram)
    span, low, have = width - gram + 1, h, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low.view(np.int64)


def segments(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of every run of windows with one key."""
    keys = window_keys(data, width)
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.concatenate([at, [len(keys)]]))
    if n.max() > RUN:
        parts = -(-n // RUN)
        of = np.repeat(np.arange(len(at)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, n = at[of] + k * RUN, np.minimum(RUN, n[of] - k * RUN)
    return keys[at], at, n


def arrays(*pairs: tuple) -> list[pa.Array]:
    return [pa.array(x, k) for x, k in pairs]


def deltas(places: np.ndarray, unit: type) -> bytes:
    """Rising numbers from 0 on as differences: a difference is a number of largest units and a smaller one."""
    top = np.iinfo(unit).max
    steps = np.diff(places, prepend=0)
    ends = np.cumsum(steps // top + 1) - 1
    out = np.full(ends[-1] + 1 if len(ends) else 0, top, unit)
    out[ends] = steps % top
    return out.tobytes()


def undeltas(data: bytes, unit: type) -> np.ndarray:
    units = np.frombuffer(data, unit)
    return np.cumsum(units, dtype=np.int64)[units != np.iinfo(unit).max]


def short_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def unit_for(buckets: int) -> type:
    return np.uint8 if buckets <= 128 else np.uint16


PACKED = "to long, tag long, keys binary, places binary, ids binary, counts binary"
ASK = -1


def packed_keys(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """The segments' keys, per lot of documents and bucket of keys, in a few bytes each.

    A lot's segments are numbered; its row for a bucket holds the keys' leading bytes and the numbers. A key that
    several documents of a lot have is repeated for certain: such segments stay in a row of the lot, and the bucket
    is only told the key once (tag ASK), so that a key of very many documents reaches its bucket once for each lot.
    Tags follow from the task and the order of its input, so a task that runs again gives the same.
    """
    unit = unit_for(buckets)

    def pack(tag: int, ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
        found = [segments(np.frombuffer(t, np.uint8), width)[0] for t in texts]
        counts = np.array([len(f) for f in found], np.uint32)
        key = np.concatenate(found)
        if not len(key):
            return None
        row = np.repeat(ids, counts)
        order = np.lexsort((row, key))
        start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        sizes = np.diff(np.concatenate([start, [len(key)]]))
        several = np.zeros(len(key), bool)
        several[order] = np.repeat(row[order][start] != row[order][start + sizes - 1], sizes)
        first = np.zeros(len(key), bool)
        first[order[start]] = True
        cut = lambda k: np.ascontiguousarray((k.view(np.uint64) >> np.uint64(24))[:, None].view(np.uint8)[:, :KEY_BYTES]).tobytes()
        rows = [(-1 - tag, tag, b"", deltas(np.flatnonzero(several), unit), ids.astype(np.int64).tobytes(), counts.tobytes())]
        for ask in (False, True):
            some = np.flatnonzero(several & first if ask else ~several)
            bucket = key[some] & (buckets - 1)
            by = np.argsort(bucket, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else ():
                own = some[part]
                rows.append((int(bucket[part[0]]), ASK if ask else tag, cut(key[own]), b"" if ask else deltas(own, unit), b"", b""))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(arrays(*[(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), *[pa.binary()] * 4))]), ["to", "tag", "keys", "places", "ids", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        ids, texts, size, lot = [], [], 0, 0
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                raw = t.as_py().encode()
                if i is None or len(raw) < width:
                    continue
                ids.append(i)
                texts.append(raw)
                size += len(raw)
                if size >= LOT_BYTES:
                    if (out := pack(task | lot, np.array(ids, np.int64), texts)) is not None:
                        yield out
                    ids, texts, size, lot = [], [], 0, lot + 1
        if ids and (out := pack(task | lot, np.array(ids, np.int64), texts)) is not None:
            yield out

    return docs.mapInArrow(run, PACKED)


def repeated_segments(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """id, ordinals: which segments of the document have a key that another document has too (or one of equal leading bytes)."""
    unit = unit_for(buckets)
    asked = packed_keys(docs.select("doc_id", "text"), buckets, width).repartition("to").sortWithinPartitions("to")

    def decide(rows: list[tuple]) -> list[tuple]:
        if rows[0][0] < 0:
            return rows
        keys = [short_keys(r[2]) for r in rows]
        tag = np.repeat(np.array([r[1] for r in rows], np.int64), [len(k) for k in keys])
        place = np.concatenate([np.zeros(len(k), np.int64) if r[1] == ASK else undeltas(r[3], unit) for r, k in zip(rows, keys)])
        key = np.concatenate(keys)
        order = np.lexsort((tag, key))
        key, tag, place = key[order], tag[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([start, [len(key)]]))
        keep = np.repeat((tag[start] != tag[start + sizes - 1]) | (tag[start] == ASK), sizes) & (tag != ASK)
        tag, place = tag[keep], place[keep]
        order = np.lexsort((place, tag))
        tag, place = tag[order], place[order]
        return [(0, int(tag[p[0]]), b"", deltas(place[p], unit), b"", b"") for p in np.split(np.arange(len(tag)), np.flatnonzero(np.diff(tag)) + 1) if len(p)]

    def runs_of(rows: Iterator[tuple], at: int) -> Iterator[list[tuple]]:
        pending: list[tuple] = []
        for row in rows:
            if pending and row[at] != pending[0][at]:
                yield pending
                pending = []
            pending.append(row)
        if pending:
            yield pending

    names = ["to", "tag", "keys", "places", "ids", "counts"]
    rows_in = lambda batches: (r for b in batches for r in zip(*[b[c].to_pylist() for c in names]))

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(rows_in(batches), 0):
            if got := decide(rows):
                yield pa.RecordBatch.from_arrays(arrays(*[(list(c), k) for c, k in zip(zip(*got), (pa.int64(), pa.int64(), *[pa.binary()] * 4))]), names)

    def by_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(rows_in(batches), 1):
            own = next(r for r in rows if r[4])
            ids, counts = np.frombuffer(own[4], np.int64), np.frombuffer(own[5], np.uint32).astype(np.int64)
            place = np.unique(np.concatenate([undeltas(r[3], unit) for r in rows]))
            starts = np.cumsum(counts) - counts
            doc = np.searchsorted(starts + counts, place, side="right")
            inner = (place - starts[doc]).astype(np.int32)
            parts = [p for p in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(p)]
            yield pa.RecordBatch.from_arrays(arrays(([int(ids[doc[p[0]]]) for p in parts], pa.int64()), ([inner[p].tobytes() for p in parts], pa.binary())), ["id", "ordinals"])

    answered = asked.mapInArrow(by_bucket, PACKED).repartition("tag").sortWithinPartitions("tag")
    return answered.mapInArrow(by_lot, "id long, ordinals binary")


ROUTED = "shard int, blob binary"


def packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of one length and, at the end, bytes, compressed together."""
    body = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return len(parts[0]).to_bytes(4, "little") + len(body).to_bytes(4, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: type) -> tuple:
    """The arrays of the given types, and the bytes after them."""
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    body, at, out = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for k in kinds:
        out.append(np.frombuffer(body, k, n, at))
        at += n * np.dtype(k).itemsize
    return *out, body[at:]


def with_bytes(rows: DataFrame, found: DataFrame, shards: int, width: int) -> DataFrame:
    """shard, blob: the segments' bytes on their way to the shards, those of a lot for one shard in one row.

    Segments of which an equal one of a smaller id is known in the task are removed for certain and need no shard:
    their stretches go on at a negative number. So a passage that very many documents share reaches its shard about
    once for each task. Rows that repeat an id take each other's segments too, which costs a comparison and changes nothing.
    """
    per_doc = found.groupBy("id").agg(F.collect_list("ordinals").alias("ordinals"))
    joined = rows.join(per_doc, F.col("doc_id") == F.col("id"), "left").select("doc_id", "mark", "text", "ordinals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        asked: list[tuple] = []  # per document: id, mark, shards, places, segments
        certain: list[tuple] = []  # per document: id, mark, starts, stops
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            if certain:
                n = [len(c[2]) for c in certain]
                ids, marks = (np.repeat(np.array([c[k] for c in certain], t), n) for k, t in ((0, np.int64), (1, np.int32)))
                out.append((-1 - int(ids[0] & 0x3FFFFFFF), packed(ids, marks, np.concatenate([c[2] for c in certain]).astype(np.int32), np.concatenate([c[3] for c in certain]).astype(np.int32))))
            if asked:
                n = [len(a[2]) for a in asked]
                ids, marks = (np.repeat(np.array([a[k] for a in asked], t), n) for k, t in ((0, np.int64), (1, np.int32)))
                shard, place = np.concatenate([a[2] for a in asked]), np.concatenate([a[3] for a in asked]).astype(np.int32)
                data = [d for a in asked for d in a[4]]
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    own = [data[k] for k in part.tolist()]
                    out.append((int(shard[part[0]]), packed(ids[part], marks[part], place[part], np.array([len(d) for d in own], np.uint16), b"".join(own))))
            asked.clear()
            certain.clear()
            if out:
                yield pa.RecordBatch.from_arrays(arrays(*zip(map(list, zip(*out)), (pa.int32(), pa.binary()))), ["shard", "blob"])

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch["ordinals"]))
            for i, mark, text, which in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], batch["ordinals"].to_pylist()):
                raw = text.as_py().encode()
                key, at, n = segments(np.frombuffer(raw, np.uint8), width)
                own = np.unique(np.concatenate([np.frombuffer(w, np.int32) for w in which]))
                own = own[own < len(key)]
                a, z = at[own], at[own] + n[own] + width - 1
                data = [raw[p:q] for p, q in zip(a.tolist(), z.tolist())]
                known = [least.get(d, i) for d in data]
                new = np.array([k >= i for k in known], bool)
                if not new.all():
                    certain.append((i, mark, *merged(a[~new], z[~new])))
                if new.any():
                    some = [d for d, w in zip(data, new) if w]
                    least.update(dict.fromkeys(some, i))
                    asked.append((i, mark, (key[own][new] & (shards - 1)).astype(np.int32), a[new], some))
                    size += sum(map(len, some))
                if len(least) > REMEMBERED:
                    least.clear()
                if size > SENT_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return joined.mapInArrow(run, ROUTED)


def least_ids(sizes: np.ndarray, owner: np.ndarray, starts: np.ndarray, text: np.ndarray, folder: Path, width: int) -> np.ndarray:
    """Per window, the least id of any window with the same bytes in the shard.

    sizes: windows of each distinct segment; owner: the least id that has it; starts: per window, in the segments' order, its first byte."""
    of = np.full(len(text), -1, np.int32)
    of[starts] = np.arange(len(starts), dtype=np.int32)
    ids = np.repeat(owner, sizes)
    out = np.full(len(starts), NONE)
    open_run: list[np.ndarray] = []

    def close(run: np.ndarray) -> None:
        own = run[run >= 0]
        if len(own):
            out[own] = ids[own].min()

    for batch in Inducer(text, folder).falling():
        window = of[batch["pos"]]
        cuts = np.flatnonzero(batch["lcp"] < width)
        if not len(cuts):
            open_run.append(window)
            continue
        close(np.concatenate([*open_run, window[: cuts[0]]]))
        last = window[cuts[-1] :]
        inner = window[cuts[0] : cuts[-1]]
        if len(inner):
            begins = cuts[:-1] - cuts[0]
            values = np.where(inner >= 0, ids[np.maximum(inner, 0)], NONE)
            lows = np.repeat(np.minimum.reduceat(values, begins), np.diff(np.concatenate([begins, [len(inner)]])))
            out[inner[inner >= 0]] = lows[inner >= 0]
        open_run = [last]
    close(np.concatenate(open_run))
    return out


def sharing(text: np.ndarray, bytes_of: np.ndarray, width: int) -> np.ndarray:
    """Per segment, whether a window of it may be in another one too; text: the segments' bytes, one segment behind the other.

    Equal windows have equal hashes, so a segment that is not marked has no window in common with any other. What is kept of
    a window is one number, its hash above its segment, so that sorting brings those of one hash together."""
    n = len(bytes_of)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    ends = np.cumsum(bytes_of)
    found = np.empty(int((bytes_of - (width - 1)).sum()), np.uint64)
    first = at = 0
    while first < n:
        begin = int(ends[first] - bytes_of[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + HASHED_BYTES, side="right")))
        own = bytes_of[first:last] - (width - 1)
        starts = np.repeat(ends[first:last] - bytes_of[first:last] - begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
        h = hashes(text[begin : int(ends[last - 1])], width)[starts]
        found[at : at + len(h)] = (h >> bits << bits) | np.repeat(np.arange(first, last, dtype=np.uint64), own)
        first, at = last, at + len(h)
    found.sort()
    near = found[1:] ^ found[:-1]
    both = np.flatnonzero((near != 0) & (near >> bits == 0))
    out = np.zeros(n, bool)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out[found[both] & mask] = True
    out[found[both + 1] & mask] = True
    return out


def stretches_of(blobs: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, marks, starts, stops of the removed stretches of one shard, from the segments of its blobs."""
    number: dict[bytes, int] = {}
    owner: list[int] = []
    members = []
    for blob in blobs:
        ids, marks, places, lengths, data = unpacked(blob, np.int64, np.int32, np.int32, np.uint16)
        ends = np.cumsum(lengths, dtype=np.int64)
        of = np.empty(len(ids), np.int64)
        for k, (i, a, z) in enumerate(zip(ids.tolist(), (ends - lengths).tolist(), ends.tolist())):
            d = data[a:z]
            n = number.setdefault(d, len(owner))
            if n == len(owner):
                owner.append(i)
            elif i < owner[n]:
                owner[n] = i
            of[k] = n
        members.append((ids, marks, places, lengths.astype(np.int64) - (width - 1), of))
    bytes_of = np.fromiter(map(len, number), np.int64, len(number))
    whole = np.frombuffer(b"".join(number), np.uint8)
    number.clear()
    owners = np.array(owner, np.int64)
    sizes = bytes_of - (width - 1)
    offsets = np.cumsum(sizes) - sizes
    least = np.repeat(owners, sizes)
    # of a segment that shares no window with another one, its owner is known to be the least
    open_ = sharing(whole, bytes_of, width)
    if open_.any():
        with tempfile.TemporaryDirectory() as name:
            folder = Path(name)
            with (folder / "text").open("wb") as f:
                f.write((whole[np.repeat(open_, bytes_of)] + np.uint8(1)).tobytes() + b"\0")
            own, begin = sizes[open_], np.cumsum(bytes_of[open_]) - bytes_of[open_]
            starts = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
            least[np.repeat(open_, sizes)] = least_ids(own, owners[open_], starts, np.memmap(folder / "text", np.uint8, "r"), folder, width)
    for ids, marks, places, windows, of in members:
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = least[np.repeat(offsets[of], windows) + within] < np.repeat(ids, windows)
        row = np.repeat(np.arange(len(ids)), windows)
        # runs of removed windows inside each segment
        edge = np.concatenate([[False], gone, [False]])
        other = np.concatenate([[True], row[1:] != row[:-1], [True]])
        begin = np.flatnonzero(gone & (~edge[:-2] | other[:-1]))
        end = np.flatnonzero(gone & (~edge[2:] | other[1:]))
        if len(begin):
            yield ids[row[begin]], marks[row[begin]], (places[row[begin]] + within[begin]).astype(np.int32), (places[row[end]] + within[end] + width).astype(np.int32)


def covered(routed: DataFrame, width: int) -> DataFrame:
    """id, mark, start, stop: stretches of bytes that repeat; stretches may overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(shard: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            found = (unpacked(b, np.int64, np.int32, np.int32, np.int32)[:4] for b in blobs) if shard < 0 else stretches_of(blobs, width)
            for ids, marks, starts, stops in found:
                yield pa.RecordBatch.from_arrays(arrays((ids, pa.int64()), (marks, pa.int32()), (starts, pa.int32()), (stops, pa.int32())), ["id", "mark", "start", "stop"])

        shard, blobs = 0, []
        for batch in batches:
            for own, blob in zip(batch["shard"].to_pylist(), batch["blob"].to_pylist()):
                if blobs and (own != shard or own < 0):
                    yield from emit(shard, blobs)
                    blobs = []
                shard = own
                blobs.append(blob)
        if blobs:
            yield from emit(shard, blobs)

    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "id long, mark int, start int, stop int")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the stretches cover; stretches that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


def removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, mark and s, for every row of docs: the stretches of bytes to remove are those in s with the row's mark.

    Null texts are empty. Rows that repeat a doc_id are each other's equals: neither is smaller. Rows with a null doc_id
    lose nothing and count for nobody. Strings never reach across rows, and are judged on the input.
    An empty table gives an empty result; other columns of docs are not looked at.
    """
    if not 2 <= width <= CAP:
        raise ValueError(f"width must be from 2 to {CAP}, up to which common prefixes are told apart")
    # hash() tells rows apart that repeat a doc_id with another text
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("mark", F.hash("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = 1 << max(6, (int(size) // BUCKET_BYTES).bit_length())
    found = covered(with_bytes(rows, repeated_segments(rows, buckets, width), SHARDS * buckets, width), width)
    per_doc = found.groupBy("id").agg(F.collect_list(F.struct("mark", "start", "stop")).alias("s"))
    # both joins read the documents in one way, so that their texts are dealt out by id once
    return rows.join(per_doc, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "mark", "s")


def kept_parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans and the kept bytes of each row of removals."""
    s = batch["s"]
    offsets, flat = s.offsets.to_numpy(), s.values
    mark, start, stop = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("mark", "start", "stop"))
    for k, (text, own) in enumerate(zip(batch["text"], batch["mark"].to_pylist())):
        raw = text.as_py().encode()
        part = slice(offsets[k], offsets[k + 1])
        ours = mark[part] == own
        if not ours.any():
            yield len(raw), 0, 0, raw
            continue
        starts, stops = merged(start[part][ours], stop[part][ours])
        kept, at = [], 0
        for a, b in zip(starts.tolist(), stops.tolist()):
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        yield len(raw), int((stops - starts).sum()), len(starts), b"".join(kept)


def cleaned(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes, or kept_sha256, their digest) of every row of docs."""
    name, kind = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*r[:3], hashlib.sha256(r[3]).hexdigest() if digest else r[3]) for r in kept_parts(batch)]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *arrays(*[(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), kind))])], ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    return removals(docs, width).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    return cleaned(docs, width, digest=True)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
