"""Ranked lexical search by windowed bucket scoring.

Documents in the order of their ids are cut into windows of a fixed number of documents. Inside a window the postings of the
query terms are turned term by term: an array of one score per document, small enough for the cache, gets each term's
contributions by scatter-add, a bitset says which places were touched, and only those are harvested into the item's heap.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table

#: Documents of a window: 64 KB of scores.
WINDOW = 8192
#: Postings of a window at most, save those of one document: windows of very long documents end earlier.
POSTINGS = 1 << 22
#: Terms of the items, repeats included, that are looked for in one pass over the documents. More items take more passes.
BLOCK_TERMS = 1 << 16
TOP = 20
#: What parts terms, as bytes and as a pattern; ASCII letters are lower-cased, bytes of other characters stay.
DELIMITERS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def byte_table(delimiters: list[int]) -> bytes:
    """Turns each delimiter into a space and A-Z into a-z."""
    parted = set(delimiters)
    return bytes(0x20 if b in parted else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


TABLE = byte_table(DELIMITERS)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items (item_id, their terms) in blocks of about BLOCK_TERMS terms, one block in the driver at a time."""
    block, held = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        terms = terms_of((r.text or "").encode())
        if block and held + len(terms) > BLOCK_TERMS:
            yield block
            block, held = [], 0
        block.append((r.item_id, terms))
        held += len(terms)
    if block:
        yield block


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms) and the vocabulary's terms of each document that has a term: their numbers, ascending, and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            n, terms, tf = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                own = terms_of(text)
                times = Counter(map(get, own))
                times.pop(None, None)
                known = np.array(sorted(times.items()), np.int32).reshape(-1, 2)
                n.append(len(own))
                terms.append(np.ascontiguousarray(known[:, 0]).tobytes())
                tf.append(np.ascontiguousarray(known[:, 1]).tobytes())
            out = pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(np.array(n, np.int64) > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms binary, tf binary")


def document_frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the `size` terms of a block: sums per task, then one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch["terms"].to_pylist():
                df[np.frombuffer(terms, np.int32)] += 1
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(df[term])], ["term", "df"])

    total = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        total[r.term] = r.df
    return total


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Windows:
    """Scores the windows of one task for the items of a block (term numbers and how often each is asked for) and keeps each item's heap."""

    def __init__(self, items: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.top = items, weights, n_docs, n_terms, top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        self.scores = np.zeros(WINDOW, np.int64)

    def add(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> None:
        """One window: its documents' ids (ascending) and lengths, and their terms, document by document."""
        slot = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        term, slot, tf = terms[order], slot[order], tf[order].astype(np.int64)
        m = 100 - 25 + (25 * n * self.n_docs) // self.n_terms
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[slot]))
        held, starts = np.unique(term, return_index=True)
        stops = np.append(starts[1:], len(term))
        list_of = {t: (slot[a:b], gain[a:b]) for t, a, b in zip(held.tolist(), starts.tolist(), stops.tolist())}
        bits: dict[int, np.ndarray] = {}
        for heap, asked in zip(self.heaps, self.items):
            touched = np.zeros(WINDOW // 8, np.uint8)
            for t, times in asked:
                if t in list_of:
                    at, by = list_of[t]
                    self.scores[at] += by * times if times > 1 else by
                    if t not in bits:
                        mark = np.zeros(WINDOW, bool)
                        mark[at] = True
                        bits[t] = np.packbits(mark)
                    touched |= bits[t]
            self.harvest(heap, np.flatnonzero(np.unpackbits(touched)), ids)

    def harvest(self, heap: list[tuple[int, int]], places: np.ndarray, ids: np.ndarray) -> None:
        got = self.scores[places]
        self.scores[places] = 0
        # ids of later windows are no smaller, so an equal score comes too late
        keep = np.flatnonzero(got > (heap[0][0] if len(heap) == self.top else 0))
        for i in keep[np.argsort(-got[keep], kind="stable")[: self.top]].tolist():
            entry = (int(got[i]), -int(ids[places[i]]))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def block_ranking(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], first: int, top: int) -> DataFrame:
    """item (its number), item_id, doc_id and score: the best of each task for each item of the block."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
    postings = checkpoint(counted(docs, vocabulary))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = term_weights(document_frequencies(postings, len(vocabulary)), n_docs)
    asked = [sorted(Counter(vocabulary[t] for t in terms).items()) for _, terms in block]
    shared = spark.sparkContext.broadcast((asked, weights, [i for i, _ in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, item_ids = shared.value
        windows = Windows(items, weights, n_docs, n_terms, top)
        held: list[tuple[int, int, bytes, bytes]] = []
        size = 0

        def close() -> None:
            ids, n, terms, tf = zip(*held)
            windows.add(np.array(ids), np.array(n), np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(tf), np.int32), np.array([len(t) // 4 for t in terms]))

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "terms", "tf"))):
                if held and (len(held) == WINDOW or size + len(row[2]) // 4 > POSTINGS):
                    close()
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) // 4
        if held:
            close()
        rows = [(first + i, item_ids[i], -neg, score) for i, heap in enumerate(windows.heaps) for score, neg in heap]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    # the second key splits rows that share a doc_id
    ordered = postings.where("doc_id is not null and terms <> X''").repartitionByRange("doc_id", F.xxhash64("terms")).sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` highest scores above 0 of each row of items (item_id, text), equal ones by doc_id.

    docs: doc_id (a whole number) and text. Null and empty texts have no terms. A document without a doc_id counts in the
    statistics and is not ranked; rows that share a doc_id are documents of their own. Each row of items is ranked for
    itself, rows that repeat too; items without terms and items without matches have no rows; without documents or items
    the result is empty. Other columns are not looked at.
    """
    parts, first = [], 0
    for block in item_blocks(items):
        if any(terms for _, terms in block):
            parts.append(block_ranking(docs, block, first, top))
        first += len(block)
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for more in parts[1:]:
        best = best.unionByName(more)
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
with item_terms as (
  select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) as term from benchmark) group by all),
doc_terms as (select doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) as term from documents),
lengths as (select doc_id, count(*) as n from doc_terms group by doc_id),
totals as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from lengths),
tfs as (select doc_id, term, count(*) as tf from doc_terms where term in (select term from item_terms) group by all),
weights as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as w from tfs, totals group by term, big_n),
gains as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) as gain
  from tfs join lengths using (doc_id) join weights using (term), totals),
scored as (select item_id, doc_id, cast(sum(times * gain) as bigint) as score from item_terms join gains using (term) group by all having sum(times * gain) > 0),
placed as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scored)
select item_id, rank, doc_id, score from placed where rank <= {TOP}
"""
