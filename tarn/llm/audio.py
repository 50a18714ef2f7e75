"""Media columns: audio features of 8-bit PCM.

The stored form is a WAV file of one channel with 8-bit samples. Read back, the samples are resampled by a
polyphase filter, cut into overlapped frames and turned into log-mel energies, which are stored as tensors of a fixed
shape, each with its time span; a hysteresis on the frames' energy gives the time spans in which there is signal.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 64
RATE = 8000
#: Resampling ratio up / down, and the taps of each phase of the filter.
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, FFT, MELS = 192, 96, 256, 20
#: Shape of a tensor: the log-mel energies of so many frames that follow one another. The last of a signal is filled up with FLOOR.
SHAPE = (64, MELS)
#: Least energy of a band, so that silence has a logarithm.
LEAST = 1e-6
FLOOR = float(np.log(np.float32(LEAST)))
#: Decibels over the mean frame energy at which a span opens, and to which it must fall to close.
OPEN_DB, CLOSE_DB = 0.5, 0.0
#: Frames that are computed at once.
FRAMES_AT_ONCE = 4096
#: Bytes of media of the rows that a worker sends on together.
SENT_BYTES = 1 << 23
SPANS = "array<struct<start_ms: long, end_ms: long>>"
SCHEMA = f"doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, tensors array<array<float>>, tensor_spans {SPANS}, spans {SPANS}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, with bytes 0 up to a positive multiple of BLOCK, and their number without those."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def store(payload: bytes) -> bytes:
    """A WAV file of 8-bit samples at RATE."""
    if len(payload) + 36 >= 1 << 32:
        raise ValueError("a WAV file holds less than 4 GiB")
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def read_back(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a WAV file, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is read")
        if kind == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass, split into its `up` phases; each row is in the order of ascending sample index."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.kaiser(n, 8.0) * up
    return np.stack([h[p::up][::-1] for p in range(up)]).astype(np.float32)


def resample(x: np.ndarray, start: int, stop: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs start .. stop-1 of the resampled signal; beyond its ends the signal is zero."""
    filters = phases(up, down, TAPS)
    m = np.arange(start, stop)
    base = m * down // up
    low, high = int(base[0]) - TAPS + 1, int(base[-1]) + 1
    part = np.zeros(high - low, np.float32)
    a, b = max(low, 0), min(high, len(x))
    if a < b:
        part[a - low : b - low] = x[a:b]
    windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(len(m), np.float32)
    for p in range(up):
        at = np.flatnonzero(m * down % up == p)
        if len(at):
            out[at] = np.einsum("ij,j->i", windows[base[at] - TAPS + 1 - low], filters[p])
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: float) -> np.ndarray:
    """Triangular filters over the bins of the power spectrum, equally wide on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FFT // 2 + 1)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@dataclass
class Features:
    frames: int
    tensors: np.ndarray  # any number of SHAPE, float32
    tensor_spans: list[tuple[int, int]]  # milliseconds of each tensor's frames
    spans: list[tuple[int, int]]  # milliseconds with signal


def features_of(samples: bytes, rate: int) -> Features:
    """Features of the whole signal. Spectra are computed in blocks; what grows with the signal is the tensors and one number a frame."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    length = len(x) * UP // DOWN
    new_rate = rate * UP / DOWN
    frames = max(1, 1 + (length - FRAME) // HOP) if length >= FRAME else 1
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(new_rate)
    mels, energy = np.full((-(-frames // SHAPE[0]) * SHAPE[0], MELS), FLOOR, np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, FRAMES_AT_ONCE):
        end = min(frames, at + FRAMES_AT_ONCE)
        y = resample(x, at * HOP, (end - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        cut = cut - cut.mean(1, keepdims=True)
        energy[at:end] = 10 * np.log10(np.square(cut).mean(1) + 1e-10)
        power = np.square(np.abs(np.fft.rfft(cut * window, FFT, axis=1))).astype(np.float32)
        mels[at:end] = np.log(power @ bank + np.float32(LEAST))
    level = float(energy.mean(dtype=np.float64))
    time = lambda a, b: (int(1000 * a * HOP / new_rate), int(1000 * ((b - 1) * HOP + FRAME) / new_rate))
    spans = [time(a, b) for a, b in hysteresis(energy, level + OPEN_DB, level + CLOSE_DB)]
    return Features(frames, mels.reshape(-1, *SHAPE), [time(a, min(a + SHAPE[0], frames)) for a in range(0, frames, SHAPE[0])], spans)


def hysteresis(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Runs of frames at or over `low` that reach `high` somewhere, as [start, end)."""
    over = np.concatenate([[False], energy >= low, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    reach = np.concatenate([[0], np.cumsum(energy >= high)])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if reach[b] > reach[a]]


def summary(f: Features) -> str:
    """The features as a short text: frames, spans, signal time, the mean log-mel energies in tenths, and a digest of all tensors in hundredths."""
    flat = f.tensors.reshape(-1, MELS)[: f.frames]
    bands = " ".join(str(v) for v in np.round(flat.mean(0, dtype=np.float64) * 10).astype(int))
    digest = hashlib.sha256(np.round(f.tensors * np.float32(100)).astype("<i4").tobytes()).hexdigest()[:16]
    return f"{f.frames};{len(f.spans)};{sum(b - a for a, b in f.spans)};{bands};{digest}"


def times(spans: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
    offsets = np.cumsum([0] + [len(s) for s in spans]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start_ms", "end_ms"]))


def media_columns(docs: DataFrame) -> DataFrame:
    """The stored form of every document and what is computed from it: figures, tensors (SHAPE, row by row) with their time
    spans, and the spans with signal.

    Null and empty texts have a payload of BLOCK zero bytes; repeated rows each give a row, with equal values for
    equal texts, as every document is computed on its own; other columns of docs are not looked at. Rows are sent on
    by their bytes, so that a worker holds one long text at a time.
    """

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        ids, n, media, size, digest, crc, f = zip(*rows)
        counts = np.cumsum([0] + [len(x.tensors) for x in f]).astype(np.int32)
        values = pa.array(np.concatenate([x.tensors.ravel() for x in f]))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(counts[-1] + 1, dtype=np.int32) * (SHAPE[0] * SHAPE[1])), values)
        columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(crc, pa.int64()), pa.array([summary(x) for x in f], pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(counts), inner), times([x.tensor_spans for x in f]), times([x.spans for x in f])], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].cast(pa.int64()).to_pylist(), batch["text"]):
                payload, n = payload_of(text.as_py())
                media = store(payload)
                samples, rate = read_back(media)
                rows.append((i, n, media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), features_of(samples, rate)))
                held += len(media)
                if held > SENT_BYTES:
                    yield sent(rows)
                    rows, held = [], 0
        if rows:
            yield sent(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = "doc_id n_bytes media payload_bytes payload_sha256 tail_crc32 feature tensors tensor_spans spans".split()


def tensor_table(rows: pa.Table) -> pa.Table:
    """An Arrow table of media_columns with one row per tensor: doc_id, the tensor as a fixed-shape extension type, start_ms and end_ms."""
    tensors, spans = rows["tensors"].combine_chunks(), rows["tensor_spans"].combine_chunks().flatten()
    owner = np.repeat(np.arange(rows.num_rows), tensors.value_lengths().to_numpy())
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    fixed = pa.FixedSizeListArray.from_arrays(tensors.flatten().flatten().cast(pa.float32()), SHAPE[0] * SHAPE[1])
    return pa.table({"doc_id": rows["doc_id"].take(pa.array(owner)), "tensor": pa.ExtensionArray.from_storage(kind, fixed), "start_ms": spans.field("start_ms"), "end_ms": spans.field("end_ms")})


def write_tensors(docs: DataFrame, path: str) -> None:
    """Parquet of media_columns with a row per tensor: doc_id, tensor (SHAPE, row by row), start_ms and end_ms."""
    pairs = media_columns(docs).select("doc_id", F.explode(F.arrays_zip("tensors", "tensor_spans")).alias("x"))
    pairs.select("doc_id", F.col("x.tensors").alias("tensor"), "x.tensor_spans.start_ms", "x.tensor_spans.end_ms").write.parquet(path)


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_columns(table(spark, sf_dir, "documents"))
    stored = rows.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors", "tensor_spans", "spans")

