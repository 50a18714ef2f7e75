"""Ranked search, the divergence audit and token files against brute force, and the hot cases of earlier operators."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

from tarn.llm import divergence, html, pii, ranked, simhash, suffixes, tokenfiles
from tarn.llm.bpe import default_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rnd, n, words="alpha Beta gamma delta éta Ωmega x1 22 eps zeta".split()):
    return "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-", "\x00", "  "]) for _ in range(n))


# ---- ranked search -----------------------------------------------------------


def terms_brute(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranking_brute(docs, items, top=20):
    own = [(i, terms_brute(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, length = len(own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for doc, t in own:
            tf, m = Counter(t), 100 - 25 + (25 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in terms_brute(text) if tf[x])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, k, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("window, block", [(8192, 1 << 16), (7, 1 << 16), (3, 10)])
def test_ranking_equals_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(ranked, "WINDOW", window)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    rnd = random.Random(window)
    docs = [(i, prose(rnd, rnd.choice((0, 1, 5, 40, 400)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "!!! --"), (None, "alpha beta"), (203, docs[5][1]), (204, docs[5][1]), (204, docs[5][1]), (205, "ÉTA éta Ωmega")]
    items = [(1, "alpha ALPHA gamma"), (2, None), (3, "nothing here"), (4, "éta 22 x1"), (5, "alpha beta gamma delta eps zeta"), (6, "?")]
    got = ranked.ranked(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("other")).repartition(5), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranking_brute(docs, items)


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked.ranked(docs.limit(0), items).count() == 0
    assert ranked.ranked(docs, items.limit(0)).count() == 0
    assert ranked.ranked(docs, items.withColumn("text", F.lit(None).cast("string"))).count() == 0


# ---- divergence ------------------------------------------------------------


def divergence_brute(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))) for text, lang, source in rows]
    df, count = Counter(), defaultdict(Counter)
    for lang, source, t in words:
        df.update((lang, x) for x in set(t))
        count[lang, source].update(t)
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for (own, t), n in df.items() if own == lang and n >= least)
        groups = {s: count[lang, s] for l, s in {(r[1], r[2]) for r in rows} if l == lang}

        def p(times):
            n = sum(times[t] for t in kept)
            return {t: 1 + 1000000000 * (times[t] + 5) // (n + 5 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
            terms = [(q[t] - shares[s][t], t.encode()) for t in kept if groups[s][t] and shares[s][t] > q[t]]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("automaton, cells", [(100_000, 1 << 17), (3, 20), (0, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, automaton, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "ENTRIES", 40)
    rnd = random.Random(3)
    rows = [(prose(rnd, rnd.choice((0, 3, 30))), rnd.choice(["en", "fr", None]), rnd.choice(["web", "books", "news", None, ""])) for _ in range(300)]
    rows += [(None, "xx", "web"), ("", "xx", "code"), ("!?", "yy", "alone"), ("alpha\x00alpha,alpha", "fr", "new")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "count": F.lit("x")}).repartition(4)
    got = divergence.divergence(docs, 30, 4, automaton)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == divergence_brute(rows, 30, 4)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "BYTES", 10)
    texts = [b"aa bb cc dd ee ff gg", b"", b"x" * 30 + b" y", b"zz"]
    found = list(divergence.pieces(texts))
    assert sorted(" ".join(found).split()) == sorted(b" ".join(texts).decode().split())
    assert all(f.startswith(" ") and f.endswith(" ") for f in found)


# ---- token files ---------------------------------------------------------------

ODD = "abzAZéÉİıßſΣσςŉǅ'’.,!?; \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　̸́̇=<>-_0123٣²½ⅷक़़中文😀﻿‍\x00"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_pieces_equal_the_library():
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(40))) for _ in range(8000)]
    texts += ["<|startoftext|>a b.<|endoftext|>", "it's don't. WE'LL, 'S", "a<|endoftext|>.", "", " ", "x" * 3000 + ".", "word " * 500, "ab̸. İ?"]
    own, known = tokenfiles.PieceEncoder(default_path()), library()
    got = [x for at in range(0, len(texts), 50) for x in own.encode(texts[at : at + 50])]
    assert got == [np.array(known.encode(t, add_special_tokens=False).ids, "<i4").tobytes() for t in texts]


def test_token_files(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(3 * i, prose(rnd, rnd.choice((0, 2, 60)))) for i in range(400)] + [(5000, None), (5001, ""), (7, "same"), (7, "same"), (None, "nameless one"), (5002, "long " * 40000)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "part": F.lit(2)}).repartition(5)
    folder = str(tmp_path / "ids")
    tokenfiles.write_ids(docs, folder)
    known = library()
    ids = lambda t: [*known.encode(t or "", add_special_tokens=False).ids, 2]
    at, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = ids(text)
        want.append((doc, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = tokenfiles.token_index(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    # the files themselves: ascending ids, integers in stripes with a row index
    files = sorted(p for p in (tmp_path / "ids").iterdir() if p.suffix == ".orc")
    found = [d for f in files for d in pa.orc.ORCFile(str(f)).read(["doc_id"])["doc_id"].to_pylist()]
    assert found == [w[0] for w in want] and len(files) > 1
    assert all(pa.orc.ORCFile(str(f)).row_index_stride == 1000 for f in files)
    some = tokenfiles.lookup(spark, folder, [30, 5002, 31])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    text = dict(rows)
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {d: ids(text[d]) for d in (30, 5002)}
    tokenfiles.write_ids(docs.limit(0), folder)
    assert tokenfiles.token_index(spark, folder).count() == 0


# ---- earlier operators -----------------------------------------------------------


def test_width_beyond_the_common_prefixes_is_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        suffixes.removals(docs, 80)


def test_conditions_on_redacted_text_are_planned_quickly(spark):
    docs = spark.createDataFrame([(1, "mail a.b@example.com now"), (2, None), (3, "")], "doc_id long, text string")
    out = pii.redacted(docs)
    began = time.time()
    got = out.where("text <> ''").where(~F.col("text").contains("@")).select("doc_id", "text")
    got._jdf.queryExecution().executedPlan()
    assert time.time() - began < 20
    assert [(r.doc_id, r.text) for r in got.collect()] == [(1, "mail [email] now")]


@pytest.mark.parametrize("tile", [1024, 5])
def test_crowded_keys_lose_no_link(spark, monkeypatch, tile):
    """Texts that share one long passage and differ in a part around the bound: links that only crowded keys show."""
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash, "TILE_SETS", tile)
    monkeypatch.setattr(simhash, "MIXERS", ())
    monkeypatch.setattr(simhash, "GUESS", 0)
    rnd = random.Random(2)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, texts = words(60), []
    for _ in range(40):
        base = [*passage, *words(rnd.choice((8, 12, 16)))]
        texts += [base, [*base[:-4], *words(rnd.choice((2, 5, 8)))]]
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.components(docs, 5, 0.2).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < len(root)


# ---- html ---------------------------------------------------------------------

P0 = "The river rose quickly after the storm, and the villages along its lower banks were cut off from the road for three days."
P1 = "Engineers who had warned about the old dam said that the new measurements, taken last spring, were ignored by the council."


@pytest.mark.parametrize(
    "source, blocks",
    [
        (f"<article><h1>W</h1><p><a href=1>{P0}</a></p><p>{P1}</p></article>", ["W", P0, P1]),
        (f"<article><h1>W</h1><p>{P0}</p><p>{P1}</p><ul><li><a href=1>The first report of the dam</a><li><a href=2>The second report of the dam</a></ul></article>", ["W", P0, P1, "The first report of the dam", "The second report of the dam"]),
        (f"<article><h1>W</h1><p>{P0}</p><p>Choose <label>the first</label> one.</p><p>{P1}</p></article>", ["W", P0, "Choose the first one.", P1]),
        (f"<div><p>{P0}</p><p>{P1}</p></div><div>Copyright 2024. All rights reserved.</div>", [P0, P1]),
        (f"<div><p>{P0}</p><p>{P1}</p></div><section><h2>Comments</h2><p>Anna: I was there and saw it all, what a mess it was.</p></section>", [P0, P1]),
        (f"<div><p>We use cookies to improve your experience. Accept all</p></div><div><p>{P0}</p><p>{P1}</p></div>", [P0, P1]),
    ],
)
def test_html_parts_without_names(source, blocks):
    assert html.texts_of([html.parse(source)], html.trained())[0].split("\n\n") == blocks


def test_html_title_in_the_header_of_an_article():
    got = html.texts_of([html.parse(f"<article><header><h1>Title of it</h1></header><p>{P0}</p><p>{P1}</p></article>")], html.trained())[0]
    assert got.split("\n\n") == ["Title of it", P0, P1]


def test_html_labels_in_forms_and_lines_that_are_no_notices():
    seen = lambda source: [t for t in html.parse(source).texts if t]
    assert seen("<form><label>name</label><p>a</p></form><label>b</label> c<p>d") == ["a", "b c", "d"]
    plain = "They baked cookies for all, and their rights were reserved by no one who had comments on it."
    assert plain in html.texts_of([html.parse(f"<article><p>{P0}</p><p>{plain}</p></article>")], html.trained())[0]


def test_html_held_out_pages_without_names():
    rnd = random.Random(4711)
    pages = [html.parse(html.labelled_page(rnd, nameless=True)) for _ in range(200)]
    single, _ = html.marginals(html.Forest.of(pages, html.trained().index), html.trained().weights, html.trained().pairs)
    block = np.concatenate([p.kind for p in pages]) == 1
    right = (single[:, 1] > 0.5) == np.concatenate([p.labels for p in pages])
    assert right[block].mean() > 0.95


def test_sets_leave_a_task_in_small_batches():
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(n))}) for n in (0, 5, 12)]
    got = [b["doc_id"].to_pylist() for b in simhash.sliced(iter(batches), 5)]
    assert got == [[0, 1, 2, 3, 4], [0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]]
