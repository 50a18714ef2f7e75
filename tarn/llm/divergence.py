"""Source divergence audit by a two-pass vocabulary automaton.

The first pass takes exact document frequencies of all terms per language and keeps the frequent ones. The second looks for the
kept terms, padded with delimiters, with an Aho-Corasick automaton and counts their occurrences in each group (language and
source). What comes of it are sparse postings (group, term, count), from which pairs of sources and ranks of terms are made.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, table
from .ranked import LOWER, byte_table

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Counters of a task with so many entries are passed on.
ENTRIES = 300_000
#: Bytes of texts that are looked through at once, about.
BYTES = 8 << 20
#: Terms of the automaton at most, the most frequent ones: what each executor holds of the vocabulary. Kept terms beyond
#: are counted exactly by a shuffle of the words that the automaton lacks.
AUTOMATON_TERMS = 100_000
#: Cells (terms x sources) of one block of postings, about.
CELLS = 1 << 17
#: Pairs of sources in one batch.
PAIRS = 1 << 16
DELIMITERS = [*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
TABLE = byte_table(DELIMITERS)


def plain(docs: DataFrame) -> DataFrame:
    """text, lang and source with '' for null."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def grouped(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """The texts of a batch by the values of the columns, delimiters turned into spaces and A-Z into a-z."""
    texts: dict[tuple, list[bytes]] = defaultdict(list)
    for key, text in zip(zip(*(batch[c].to_pylist() for c in by)), batch["text"].cast(pa.binary()).to_pylist()):
        texts[key].append(text.translate(TABLE))
    yield from texts.items()


def document_frequencies(rows: DataFrame) -> DataFrame:
    """lang, term and df (documents of the lang that hold the term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, times in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(times), pa.string()), pa.array(list(times), pa.binary()).cast(pa.string()), pa.array(list(times.values()), pa.int64())], ["lang", "term", "df"])
            held.clear()

        for batch in batches:
            for (lang,), texts in grouped(batch, ["lang"]):
                for text in texts:
                    held[lang].update(set(text.split()))
            if sum(map(len, held.values())) > ENTRIES:
                yield from out()
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


@lru_cache(maxsize=2)
def automaton(terms: tuple[str, ...]):
    """Finds the terms with a space on both sides; each hit gives the term's number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t} ", i)
    found.make_automaton()
    return found


@lru_cache(maxsize=2)
def given_terms(terms: tuple[str, ...]) -> frozenset[str]:
    return frozenset(terms)


def pieces(texts: list[bytes]) -> Iterator[str]:
    """Texts that are looked through at once, with a space before, between and behind; long ones are cut at spaces."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        start = 0
        while len(text) - start > BYTES:
            cut = text.find(b" ", start + BYTES)
            if cut < 0:
                break
            yield f" {text[start:cut].decode()} "
            start = cut
        held.append(text[start:] if start else text)
        size += len(held[-1])
        if size > BYTES:
            yield f" {b' '.join(held).decode()} "
            held, size = [], 0
    if held:
        yield f" {b' '.join(held).decode()} "


def occurrences(rows: DataFrame, terms: list[str], others: bool) -> DataFrame:
    """lang, source, term and count of the given terms in each group, found by their automaton; each group also has a row with a null term and count 0.

    With others, all further words are counted too.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tuple(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        hits = automaton(known) if known else None
        given = given_terms(known) if others else None
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)
        rest: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), times in found.items():
                names = [None, *(known[i] for i in times), *rest[lang, source]]
                counts = [0, *times.values(), *rest[lang, source].values()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["lang", "source", "term", "count"])
            found.clear()
            rest.clear()

        for batch in batches:
            for group, texts in grouped(batch, ["lang", "source"]):
                times = found[group]
                for text in pieces(texts):
                    if hits is not None:
                        times.update(map(itemgetter(1), hits.iter(text)))
                    if others:
                        rest[group].update(filterfalse(given.__contains__, text.split(" ")))
                rest[group].pop("", None)
            if sum(map(len, found.values())) + sum(map(len, rest.values())) > ENTRIES:
                yield from out()
        yield from out()

    each = rows.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))


def postings(docs: DataFrame, least_docs: int, automaton_terms: int) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): lang, term of the kept terms; lang, source, term, count of those that a group holds, and a row with a null term for each group."""
    rows = plain(docs)
    kept = checkpoint(document_frequencies(rows).where(F.col("df") >= least_docs))
    ordered = kept.groupBy("term").agg(F.sum("df").alias("df")).orderBy(F.col("df").desc(), "term")
    terms = [r.term for r in ordered.limit(automaton_terms).collect()]
    counts = occurrences(rows, terms, len(terms) == automaton_terms)
    # a term that is kept in one lang is also counted in others, where it may not be kept
    marked = counts.join(kept.select("lang", "term", F.lit(True).alias("of_lang")), ["lang", "term"], "left").where("term is null or of_lang")
    return kept.select("lang", "term"), checkpoint(marked.select("lang", "source", "term", "count"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exact in decimals."""
    over = (count + F.lit(SMOOTH)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = n.cast("decimal(19,0)") + v.cast("decimal(19,0)") * F.lit(SMOOTH).cast("decimal(2,0)")
    return F.when(under > 0, F.lit(1) + F.call_function("div", over, under)).otherwise(F.lit(0)).cast("long")


def pair_sums(groups: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b and value, the sum over all kept terms of the lang of |p - q|, for every two sources a < b of a lang.

    groups: lang, source, v, zero (p of a term that the group lacks); known: lang, source, term, p. Postings are dealt to
    blocks of terms of about CELLS cells; a block is a matrix of terms and sources, filled with each source's p of absent
    terms, and gives one row for two sources, of which the blocks' sums are the result.
    """
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("v").alias("v"))
    per_lang = per_lang.select("lang", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("s") / CELLS)).cast("int").alias("blocks"))
    heads = groups.join(per_lang, "lang").select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(None).cast("string").alias("term"), "source", F.col("zero").alias("p"))
    cells = known.join(per_lang, "lang").select("lang", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"), "term", "source", "p")
    dealt = heads.unionByName(cells).repartition("lang", "block").sortWithinPartitions("lang", "block", F.col("term").asc_nulls_first(), "source")

    def sums(lang: str, sources: list[str], zero: np.ndarray, rows: list[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
        column, line = {s: i for i, s in enumerate(sources)}, {t: i for i, t in enumerate(dict.fromkeys(t for t, _, _ in rows))}
        p = np.repeat(zero[:, None], len(line), axis=1)
        p[[column[s] for _, s, _ in rows], [line[t] for t, _, _ in rows]] = [x for _, _, x in rows]
        a: list[np.ndarray] = []
        value: list[np.ndarray] = []
        names = pa.array(sources, pa.string())

        def out() -> pa.RecordBatch:
            left = np.concatenate([np.full(len(v), i, np.int32) for i, v in zip(a, value)])
            right = np.concatenate([np.arange(i + 1, len(sources), dtype=np.int32) for i in a])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(left), pa.string()), names.take(pa.array(left)), names.take(pa.array(right)), pa.array(np.concatenate(value))], ["lang", "a", "b", "value"])

        for i in range(len(sources) - 1):
            a.append(i)
            value.append(np.array([np.abs(p[i] - p[j]).sum() for j in range(i + 1, len(sources))], np.int64))
            if sum(map(len, value)) >= PAIRS:
                yield out()
                a, value = [], []
        if a:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        sources: list[str] = []
        zero: list[int] = []
        rows: list[tuple[str, str, int]] = []
        for batch in batches:
            for lang, block, term, source, p in zip(*(batch[c].to_pylist() for c in ("lang", "block", "term", "source", "p"))):
                if (lang, block) != at:
                    if at is not None:
                        yield from sums(at[0], sources, np.array(zero, np.int64), rows)
                    at, sources, zero, rows = (lang, block), [], [], []
                if term is None:
                    sources.append(source)
                    zero.append(p)
                else:
                    rows.append((term, source, p))
        if at is not None:
            yield from sums(at[0], sources, np.array(zero, np.int64), rows)

    return dealt.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, automaton_terms: int = AUTOMATON_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a lang is from its other sources and which terms set it apart.

    Part pair: every other source of the lang by the sum of |p - q| over the lang's kept terms. Part term: the terms that the
    group holds and uses more than the lang does, by p - q, the first `top`. Null text, lang and source are ''. A lang without
    kept terms gives pairs of value 0; a lang of one source gives no pairs; an empty table gives no rows. Rows that repeat
    count as often as they come; other columns are not looked at.
    """
    kept, counts = postings(docs, least_docs, automaton_terms)
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = counts.groupBy("lang", "source").agg(F.sum("count").alias("n")).join(v, "lang", "left").fillna(0, ["v"])
    groups = checkpoint(groups.withColumn("zero", share(F.lit(0), F.col("n"), F.col("v"))))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.max("v").alias("v"))
    known = counts.where("count > 0").join(groups, ["lang", "source"]).select("lang", "source", "term", "count", share(F.col("count"), F.col("n"), F.col("v")).alias("p"))
    pairs = pair_sums(groups, known.drop("count"))
    both = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    both = both.unionByName(pairs.select("lang", F.col("b").alias("source"), F.lit("pair").alias("part"), F.col("a").alias("item"), "value"))
    in_lang = counts.where("count > 0").groupBy("lang", "term").agg(F.sum("count").alias("all"))
    in_lang = in_lang.join(langs, "lang").select("lang", "term", share(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"))
    apart = known.join(in_lang, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = apart.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(by)).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
with docs as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (select doc_id, lang, source, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct doc_id) >= {LEAST_DOCS}),
sizes as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c from groups g join kept k using (lang) left join counts c using (lang, source, term)),
group_n as (select lang, source, sum(c) as n from cells group by all),
lang_n as (select lang, sum(n) as n from group_n group by lang),
p as (
  select lang, source, term, c, 1 + ({SCALE} * (c::hugeint + {SMOOTH})) // (n::hugeint + {SMOOTH} * v) as p
  from cells join group_n using (lang, source) join sizes using (lang)),
q as (
  select c.lang, c.term, 1 + ({SCALE} * (c.c + {SMOOTH})) // (n.n::hugeint + {SMOOTH} * v) as q
  from (select lang, term, sum(c)::hugeint as c from cells group by all) c join lang_n n using (lang) join sizes using (lang)),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source as one, y.source as other, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by all) s
    on s.lang = a.lang and s.one = a.source and s.other = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q)::bigint as value from p join q using (lang, term) where p.c > 0 and p.p > q.q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
