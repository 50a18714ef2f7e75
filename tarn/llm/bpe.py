"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring symbols that occurs inside no vocabulary token can never end up in one token, so the
place between them is a certain cut. Words are cut there, the fragments are merged independently, and their ids
are concatenated. Words repeat, so a bounded number of them is remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Words kept in each of two generations: when the young one is full it becomes the old one, and words met again move on.
CACHE_ENTRIES = 150_000
#: Longer words are encoded each time and not kept.
CACHE_CHARS = 64
#: Symbols of a fragment up to which the next merge is looked for in a list, and in a heap beyond.
SHORT = 64
UNRANKED = 1 << 62
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
#: Stands for a byte that the vocabulary lacks: it merges with nothing and has no token.
NO_ID = ID_MASK
#: Documents whose ids are held at once.
SLICE = 100
VOCABULARY = "word_bpe_49k.json"

#: A word's ids, their numbers as text, and their tokens as text.
Coded = tuple[tuple[int, ...], str, str]

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


def normalizer_of(spec: dict):
    """The library's own normalizer, for texts in which lower-casing or composition is not plain; without its vocabulary."""
    from tokenizers import Regex, normalizers

    if spec["type"] == "Sequence":
        return normalizers.Sequence([normalizer_of(x) for x in spec["normalizers"]])
    if spec["type"] == "Replace":
        pattern = spec["pattern"]
        return normalizers.Replace(Regex(pattern["Regex"]) if "Regex" in pattern else pattern["String"], spec["content"])
    return getattr(normalizers, spec["type"])()


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizer file (BPE with an end-of-word suffix, byte-level symbols)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        # two neighbouring ids as one number -> rank of their merge and the id that it makes, as one number
        self.merges = {self.vocab[a] << ID_BITS | self.vocab[b]: r << ID_BITS | self.vocab[a + b] for r, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.first = [self.vocab.get(c, NO_ID) for c in symbols]
        self.last = [self.vocab.get(c + self.suffix, NO_ID) for c in symbols]
        # pairs of bytes inside tokens; those at the end of a word apart, as its last byte carries the suffix
        self.inside: set[tuple[int, int]] = set()
        self.inside_end: set[tuple[int, int]] = set()
        for t in self.vocab:
            ends = bool(self.suffix) and t.endswith(self.suffix) and t != self.suffix
            raw = [byte_of[c] for c in (t[: -len(self.suffix)] if ends else t) if c in byte_of]
            found = list(zip(raw, raw[1:]))
            if ends and found:
                self.inside_end.add(found.pop())
            self.inside.update(found)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")
        self.word_pattern = regex.compile(pattern)
        # for texts of ASCII characters alone the classes are plain ones
        self.ascii_pattern = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")") if self.added else None
        self.normalize_any = normalizer_of(spec["normalizer"]).normalize_str
        self.words: dict[str, Coded] = {}
        self.older: dict[str, Coded] = {}

    def cut(self, raw: bytes) -> list[int]:
        """Places in a word's bytes where no token can reach across."""
        n, cuts = len(raw), []
        if not self.inside.issuperset(zip(raw, raw[1:-1])):
            cuts = [k for k in range(1, n - 1) if (raw[k - 1], raw[k]) not in self.inside]
        if n > 1 and (raw[-2], raw[-1]) not in self.inside_end:
            cuts.append(n - 1)
        return cuts

    def merge(self, ids: list[int]) -> list[int]:
        """Merges of one fragment, lowest rank first and leftmost among equals; in O(n log n) beyond a few symbols."""
        if len(ids) > SHORT:
            return self.merge_long(ids)
        get = self.merges.get
        ranks = [get(a << ID_BITS | b, UNRANKED) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != UNRANKED:
            i = ranks.index(low)
            ids[i] = new = low & ID_MASK
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << ID_BITS | ids[i + 1], UNRANKED)
            if i:
                ranks[i - 1] = get(ids[i - 1] << ID_BITS | new, UNRANKED)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or get(ids[i] << ID_BITS | ids[j]) != r:
                continue
            ids[i], alive[j], after[i] = r & ID_MASK, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(ids[i] << ID_BITS | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := get(ids[p] << ID_BITS | ids[i])) is not None:
                heapq.heappush(heap, (r, p))
        return [ids[i] for i in range(n) if alive[i]]

    def encode_word(self, word: str) -> Coded:
        coded = self.older.get(word)
        if coded is None:
            raw = word.encode()
            symbols = [self.first[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            if cuts := self.cut(raw):
                ids = [i for a, b in zip([0, *cuts], [*cuts, len(raw)]) for i in self.merge(symbols[a:b])]
            else:
                ids = self.merge(symbols)
            coded = self.coded([i for i in ids if i != NO_ID] if NO_ID in ids else ids)
        if len(word) <= CACHE_CHARS:
            if len(self.words) >= CACHE_ENTRIES:
                self.older = self.words.copy()
                self.words.clear()
            self.words[word] = coded
        return coded

    def coded(self, ids: list[int]) -> Coded:
        return tuple(ids), " ".join(map(str, ids)), self.decode(ids)

    def normalize(self, text: str) -> str:
        return text.lower() if text.isascii() else self.normalize_any(text)

    def parts(self, text: str | None) -> list[Coded]:
        """Ids, their numbers as text and the decoded text of each word; an empty or null text has none."""
        if not text:
            return []
        if self.added_pattern is not None and any(x in text for x in self.added):
            pieces = self.added_pattern.split(text)
            return [c for p in pieces for c in ([self.coded([self.added[p]])] if p in self.added else self.parts_plain(p))]
        return self.parts_plain(text)

    def parts_plain(self, text: str) -> list[Coded]:
        known, new = self.words.get, self.encode_word
        pattern = self.ascii_pattern if text.isascii() else self.word_pattern
        return [known(w) or new(w) for w in pattern.findall(self.normalize(text))]

    def encode(self, text: str | None) -> list[int]:
        """The ids of the whole text; an empty or null text has none."""
        return list(chain.from_iterable([c[0] for c in self.parts(text)]))

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with one space between them: these files name no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def coder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> and decoded string of every document.

    Null and empty texts give no ids and an empty string; repeated rows each give a row; other columns of
    docs are ignored. The tokenizer file is read on each executor, at a path that is a parameter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path or default_path())
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids = [bpe.encode(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens and the digests of ids and decoded text, per document, taken inside the worker that encodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path or default_path())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                # tokens are decoded one by one and joined, so a text decodes word by word
                coded = [c for c in bpe.parts(text.as_py()) if c[0]]
                rows.append((sum([len(c[0]) for c in coded]), sha(" ".join([c[1] for c in coded])), sha(" ".join([c[2] for c in coded]))))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
