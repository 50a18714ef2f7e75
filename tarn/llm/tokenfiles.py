"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are sorted by doc_id over all files, encoded behind the sort, and written with the place of their first id inside
their file. Files can be read by stripes in any number of tasks; a lookup by doc_id skips files, stripes and groups of
rows by their statistics and Bloom filters.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import default_path
from .common import shared_folder, table

#: Appended to each document.
END_ID = 2
#: Pieces of text kept in each of two generations with their ids, and the longest that is kept.
PIECES, PIECE_CHARS = 300_000, 48
#: Plain words of one text for the library: of characters that are letters in every form of normalization.
WORDS, PLAIN = 50, re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-į]+").fullmatch
#: ASCII punctuation behind a plain letter or a digit begins another word of the library, but for the added tokens, which begin so.
PUNCTUATION, ADDED = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}])([!-/:-@\[-`{-~])", "<|"
#: Characters whose normal form may depend on the case of an ASCII letter next to them.
CASED = r"[^\x00-\x{12F}]"
#: Characters encoded, and bytes of ids passed on, at once, about.
CHARS, BYTES = 4 << 20, 8 << 20
#: Of the files: bytes of a stripe, rows of a row index's group, share of wrong hits of a Bloom filter.
ORC = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.compress": "ZSTD"}
FILE = "doc_id long, part int, place long, n_tokens long, ids array<int>"


class PieceEncoder:
    """The library's ids of whole texts. A text is cut at spaces and line ends, across which this vocabulary's tokens never reach, and the ids of short pieces are kept.

    Cutting there changes nothing: white space is in no added token, takes no part in the composition of characters, and ends
    every match of the pre-tokenizer. The same holds before ASCII punctuation that follows a plain letter or a digit. ASCII
    letters are lowered first, as the library does, where no other characters can compose with them. Arrow cuts and numbers
    the pieces of many texts at once, so Python looks at each distinct piece once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model for lower-case plain words, which need no normalization and end at spaces alone
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """The same for plain words, several in one text: each of them is one word of the library, whose last token says so."""
        out: list[bytes] = []
        lines = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
        for line, coded in zip(lines, self.plain.encode_batch_fast([" ".join(x).lower() for x in lines], add_special_tokens=False)):
            ids = np.array(coded.ids, "<i4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * ends).tolist()
                out += [raw[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self.ids_of(line)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Brings the pieces and their ids into the young generation."""
        words, others = [], []
        for p in pieces:
            if (known := self.old.get(p)) is not None:
                self.young[p] = known
            else:
                (words if PLAIN(p) else others).append(p)
        self.young.update(zip(words, self.ids_of_words(words)))
        self.young.update(zip(others, self.ids_of(others)))

    def pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts one after the other, and how many each text has."""
        added = pc.match_substring(texts, ADDED)
        texts = pc.if_else(pc.or_(added, pc.match_substring_regex(texts, CASED)), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring(texts, "\n", " ")
        texts = pc.if_else(added, texts, pc.replace_substring_regex(texts, PUNCTUATION, r"\1 \2"))
        lists = pc.split_pattern(texts, " ")
        return lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (without nulls) one after the other, and how many each text has."""
        if len(self.young) > PIECES:
            self.old, self.young = self.young, {}
        coded, sizes = self.pieces(texts)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [p for p in distinct if p not in self.young]
        self.learn(missing)
        known = list(map(self.young.__getitem__, distinct))
        for p in missing:
            if len(p) > PIECE_CHARS:
                del self.young[p]
        flat = pa.array(np.frombuffer(b"".join(known), "<i4"))
        stops = np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4)
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], stops])), flat).take(coded.indices)
        places = lists.offsets.to_numpy()
        return lists.values.to_numpy(), np.diff(places[np.concatenate([[0], np.cumsum(sizes)])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, one after the other."""
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [ids[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist())]


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes doc_id, part (the file's number), place (ids of the file before this document), n_tokens and ids of every row of docs, ascending by doc_id.

    Null and empty texts have the end id alone; rows without a doc_id come first; rows that share one are next to each other
    in the order of a hash of their texts; an empty table gives files without rows; other columns are not looked at.
    Rows are dealt to files by ranges before they are encoded, so a document is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = encoder(path or default_path()), 0

        def coded(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal place
            ids, n = own.encode_column(rows["text"])
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            ends = np.cumsum(n)
            places = place + ends - n
            place += int(n.sum())
            start, held = 0, 0
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(ends, held + BYTES // 4, "right")))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[held], ends[start:stop]]) - held, pa.int32()), pa.array(ids[held : ends[stop - 1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([rows["doc_id"][start:stop], rows["part"][start:stop], pa.array(places[start:stop]), pa.array(n[start:stop]), lists], ["doc_id", "part", "place", "n_tokens", "ids"])
                start, held = stop, int(ends[stop - 1])

        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            batch = pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["part"], texts], ["doc_id", "part", "text"])
            ends = np.cumsum(pc.utf8_length(texts).to_numpy())
            start = 0
            while start < len(ends):
                before = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, before + CHARS)) + 1
                yield from coded(batch.slice(start, stop - start))
                start = stop

    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(run, FILE).write.options(**ORC).mode("overwrite").orc(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files; conditions on doc_id are pushed down to them."""
    return spark.read.schema(FILE).orc(folder)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the given documents: files, stripes and groups of rows that can't hold them are not read."""
    return read_ids(spark, folder).where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "ids")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], batch["place"], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    files = read_ids(spark, folder)
    # one row for each file
    totals = files.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    rows = files.select("doc_id", "part", "place", "ids").mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    return token_index(spark, folder)
