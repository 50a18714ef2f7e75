"""The operators of tarn.llm on the cases that are hard for them: many sources, many scripts, hot copies, odd pages, thousands of spans."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import audio, common, html, langid, lattice, mixing, pii, sharding
from tests.llm.test_llm import documents, mix_brute

# ---- mixing ---------------------------------------------------------------


def taken_brute(rows):
    """Words taken by document place: all finish times sorted, cut where the budget ends."""
    size, total, target, budget = mix_brute(rows)
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"{rows[k][0]}:{mixing.SEED}".encode()).hexdigest(), rows[k][0]))
    places = {s: i for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    cum, items = Counter(), []
    for k in order:
        s = rows[k][3]
        cum[s] += size[k]
        items += [((cum[s] + p * total[s]) / target[s], places[s], p, k) for p in range(2) if size[k] and target[s]]
    used, taken = 0, Counter()
    for _, _, _, k in sorted(items):
        used += size[k]
        if used > budget:
            break
        taken[k] += size[k]
    return taken


def eighteen_sources():
    """Fifteen small sources of documents of ten words, three of weight 1 that are one document of a hundred words each."""
    names = [f"s{i:02d}" for i in range(18)]
    big = {names[1], names[4], names[7]}
    rows = []
    for s in names:
        for n in [100] if s in big else [10] * 4:
            rows.append((len(rows), " ".join(["w"] * n), "en", s))
    return rows


def test_mixing_cut_far_out(spark):
    rows = eighteen_sources()
    got = mixing.mix(documents(spark, rows)).collect()
    brute = taken_brute(rows)
    assert {r.doc_id: r.taken for r in got} == {k: brute[k] for k in range(len(rows))}


@pytest.mark.parametrize("seed", range(6))
def test_mixing_equals_sorting(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "ITEMS", 40)
    rnd = random.Random(seed)
    names = [None, *[f"n{i}" for i in range(rnd.choice((1, 3, 20)))]]
    rows = [(i, " ".join(["w"] * rnd.choice((0, 1, 5, 40, 900))), "en", rnd.choice(names[: rnd.choice((1, len(names)))])) for i in range(150)]
    brute = taken_brute(rows)
    assert {r.doc_id: r.taken for r in mixing.mix(documents(spark, rows)).collect()} == {k: brute[k] for k in range(len(rows))}


# ---- language ID ------------------------------------------------------------

SCRIPTS = {"latin": range(0x61, 0x7B), "cyrillic": range(0x430, 0x450), "armenian": range(0x561, 0x587), "georgian": range(0x10D0, 0x10F1), "han1": range(0x4E00, 0x4F00), "han2": range(0x4F00, 0x5000)}


def script_text(rnd, name):
    letters = [chr(c) for c in SCRIPTS[name]]
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 7))) for _ in range(rnd.randint(8, 40)))


def test_language_id_of_any_script():
    rnd = random.Random(1)
    model = langid.fit([(script_text(rnd, s), s) for s in SCRIPTS for _ in range(60)])
    for s in SCRIPTS:
        assert np.mean([lang == s for lang, _ in langid.predict(model, [script_text(rnd, s) for _ in range(40)])]) > 0.95


def test_language_with_a_hot_copy_is_learned(spark):
    rnd = random.Random(2)
    en = lambda: " ".join(rnd.choices("the of and to in that it was for on with as his they be at one have".split(), k=12))
    de = lambda: " ".join(rnd.choices("der die und das von mit sich des auf ist im dem nicht ein auch als an werden".split(), k=12))
    rows = [(i, en(), "en", "a") for i in range(400)] + [(1000 + i, de(), "de", "b") for i in range(40)]
    hot = spark.range(100_000).select((F.col("id") + 10_000).alias("doc_id"), F.lit(de()).alias("text"), F.lit("de").alias("lang"), F.lit("b").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    model = langid.fit_documents(documents(spark, rows, extra=False).unionByName(hot))
    assert model.langs == ["de", "en"]
    assert [lang for lang, _ in langid.predict(model, [de(), en(), de(), en()])] == ["de", "en", "de", "en"]


def grams_of(text):
    s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text} ".lower()))
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "}


def test_language_id_is_kernel_ridge_regression():
    """The same margins as sets of n-grams, the whole landmark kernel and a plain solution of the ridge equations give."""
    rnd = random.Random(3)
    samples = [(script_text(rnd, s), s) for s in ("latin", "cyrillic", "han1") for _ in range(30)]
    model = langid.fit(samples)
    langs = sorted({s for _, s in samples})
    marks = [t for lang in langs for t in [t for t, own in samples if own == lang][: langid.LANDMARKS_PER_LANG]]
    known = set().union(*map(grams_of, marks))
    k = lambda a, b: len(a & b & known) / math.sqrt(max(1, len(a & known)) * max(1, len(b)))
    sets = [grams_of(t) for t in marks]
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in sets] for a in sets]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    phi = np.hstack([np.array([[k(grams_of(t), b) for b in sets] for t, _ in samples]) @ root, np.ones((len(samples), 1))])
    y = np.array([[1.0 if s == lang else -1.0 for lang in langs] for _, s in samples])
    penalty = np.diag([langid.RIDGE * len(samples) / 10] * len(marks) + [1e-9])
    beta = np.linalg.solve(phi.T @ phi + penalty, phi.T @ y)
    tests = [script_text(rnd, s) for s in ("latin", "cyrillic", "han1", "georgian")] + ["Abc 12 абв", "x" * 30]
    margins = np.array([[k(grams_of(t), b) for b in sets] for t in tests]) @ root @ beta[:-1] + beta[-1]
    shares = np.exp(langid.SHARPNESS * (margins - margins.max(1, keepdims=True)))
    for (lang, score), m, s in zip(langid.predict(model, tests), margins, shares):
        assert lang == langs[int(m.argmax())] and abs(score - s.max() / s.sum()) < 1e-3


def test_gram_table_finds_every_code():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(1, 1 << 62, 5000))
    table = langid.GramTable(codes)
    asked = np.concatenate([codes, rng.integers(1, 1 << 62, 5000)])
    place, column = table.find(asked)
    assert sorted(place.tolist()) == list(range(len(codes))) and (codes[column] == asked[place]).all()
    assert len(langid.GramTable(codes[:0]).find(asked)[0]) == 0


# ---- PII --------------------------------------------------------------------


def test_pii_of_ten_thousand_numbers(spark):
    text = " ".join(f"call me, phone (555) 123-{k % 10000:04d} or mail john{k}@ex.org today" for k in range(5000))
    docs = documents(spark, [(1, text, "en", "a"), (2, "no data", "en", "a")])
    got = {r.doc_id: r for r in pii.report(pii.find_spans(docs)).collect()}
    assert got[1].n_email == 5000 and got[1].spans.count("phone") == 5000 and got[2].spans == ""
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[1] == " ".join(["call me, phone [phone] or mail [email] today"] * 5000) and clean[2] == "no data"


def test_pii_redacts_what_the_spans_say(spark):
    rnd = random.Random(4)
    parts = ["Tel. 01 23 45 67 89", "Handy 0171 2345678", "móvil 912 345 678", "a.b@c.org", "🙂é", "order 912 345 678", "+49 (30) 1234 5678", "10.0.0.1", "4111 1111 1111 1111", "card 4111 1111 1111 1112", " ", "\n", "x" * 600]
    texts = ["".join(rnd.choice(parts) + rnd.choice((" ", ". ", "")) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    spans = {r.doc_id: [(s.start, s.stop, pii.KINDS[s.kind]) for s in r.spans] for r in pii.find_spans(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    loose = 0
    for i, t in enumerate(texts):
        out, at, reach = [], 0, -1
        for a, b, kind in spans[i]:
            if a >= reach:
                out += [t[at:a], f"[{kind}]"]
            reach = max(reach, b)
            at = reach
        assert clean[i] == "".join(out) + t[at:]
        loose += "Tel. [phone]" in clean[i]
    assert loose > 20


# ---- audio ------------------------------------------------------------------


def test_audio_digests_and_features_by_definition(spark):
    """Every column once more, one sample and one frame at a time."""
    rnd = random.Random(5)
    texts = [None, "", "x", "é🙂" * 40, "".join(rnd.choices("ab cdé\n", k=9000)), "z" * 64]
    got = {r.doc_id: r for r in audio.media_columns(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    taps, up, down = audio.TAPS, audio.UP, audio.DOWN
    n = np.arange(up * taps) - (up * taps - 1) / 2
    low_pass = np.sinc(n / max(up, down)) / max(up, down) * np.kaiser(up * taps, 8.0) * up
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and bytes(r.media) == media
        x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
        # zeros between the samples, the low-pass, every `down`-th value
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        length = len(x) * up // down
        frames = max(1, 1 + (length - audio.FRAME) // audio.HOP) if length >= audio.FRAME else 1
        y = np.convolve(np.concatenate([wide, np.zeros(up * (down * audio.FRAME + taps))]), low_pass)[::down]
        rate = 8000 * up / down
        mel = lambda f: 2595 * math.log10(1 + f / 700)
        edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20), mel(rate / 2), audio.MELS + 2)]
        bank = np.array([[max(0, min((f - a) / (b - a), (c - f) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:])] for f in np.linspace(0, rate / 2, audio.FFT // 2 + 1)])
        cuts = [y[k * audio.HOP : k * audio.HOP + audio.FRAME] for k in range(frames)]
        cuts = [c - c.mean() for c in cuts]
        mels = np.array([np.log(np.abs(np.fft.rfft(c * np.hanning(audio.FRAME), audio.FFT)) ** 2 @ bank + 1e-6) for c in cuts])
        stored = np.array(r.tensors).reshape(-1, audio.MELS)
        assert len(stored) % audio.SHAPE[0] == 0 and np.allclose(stored[:frames], mels, atol=2e-2) and np.allclose(stored[frames:], audio.FLOOR)
        energy = [10 * math.log10((c**2).mean() + 1e-10) for c in cuts]
        level, spans, start, high = np.mean(energy), [], None, False
        for k, e in enumerate([*energy, -1e9]):
            if start is None and e >= level + audio.CLOSE_DB and k < frames:
                start, high = k, False
            if start is not None and e < level + audio.CLOSE_DB:
                spans += [(int(1000 * start * audio.HOP / rate), int(1000 * ((k - 1) * audio.HOP + audio.FRAME) / rate))] if high else []
                start = None
            high = high or e >= level + audio.OPEN_DB
        if frames > 2:
            assert [tuple(s) for s in r.spans] == spans
        assert [s.start_ms for s in r.tensor_spans] == [int(1000 * a * audio.HOP / rate) for a in range(0, frames, audio.SHAPE[0])]


def test_audio_tensors(spark, tmp_path):
    docs = documents(spark, [(1, "ab" * 30_000, "en", "a"), (2, None, "en", "a")])
    table = audio.tensor_table(audio.media_columns(docs).toArrow())
    assert table["tensor"].type.shape == list(audio.SHAPE) and set(table["doc_id"].to_pylist()) == {1, 2}
    audio.write_tensors(docs, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where(F.size("tensor") == audio.SHAPE[0] * audio.MELS).count() == table.num_rows


# ---- sharding -------------------------------------------------------------


def test_shards_are_written_once_and_whole(spark, tmp_path):
    rows = [(7, "y" * 30, "en", "a")] * 200 + [(8, "z" * 5000, "en", "a")] + [(i, "q" * (i % 50), "en", None) for i in range(100, 400)] + [(None, None, "en", "a")]
    docs = documents(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "s"), 400)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.drop("shard_key").collect())) == sorted(map(str, docs.collect()))
    assert all(r.n <= 400 or r.docs == 1 for r in back.groupBy("shard_key").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("docs")).collect())


def test_directory_covers_all_hashes_once(spark):
    rows = [(i, "x" * (i % 97), "en", "a") for i in range(700)]
    found = sharding.shard_directory(documents(spark, rows), 900).collect()
    bits = sorted(r.shard for r in found)
    assert all(not b.startswith(a) for a, b in zip(bits, bits[1:]))
    assert sum(r.shard_docs for r in found) == 700 and all(r.depth == len(r.shard) and r.shard_bytes <= 900 for r in found)


# ---- embeddings -------------------------------------------------------------


@pytest.mark.parametrize("width", [64, 768])
def test_lattice_recall_near_the_threshold(spark, width):
    rng = np.random.default_rng(width)
    n = 400
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, width))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = rng.uniform(0.9301, 0.95, (n, 1))
    pairs = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * z])
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(pairs)], "node long, label int, embedding array<double>").repartition(4)
    found = {(min(r), max(r)) for r in lattice.candidate_links(classes).collect()}
    assert sum((i, i + n) in found for i in range(n)) >= 0.9 * n


def test_vectors_of_any_length(spark):
    base = [0.1, 0.7, -0.3, 0.2]
    rows = [(1, [v * 1e200 for v in base], 1), (2, [v * 1e-200 for v in base], 1), (3, base, 1), (4, [-v for v in base], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


# ---- html -------------------------------------------------------------------


def odd_pages():
    """Pages with the same article in ways of writing that differ, and the text of each."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9)))
    prose = lambda: (" ".join(word() for _ in range(rnd.randint(14, 40))) + ".").capitalize()
    for _ in range(200):
        heads = ("<html><head><title>T</title></head><body>", "<HTML><HEAD><TITLE>T</TITLE><BODY>", "<title>T<x></title>", "<!doctype html><meta charset=utf-8><body class=page>", "<html lang=en><head><script>if (a<b) x='</p>'</script><body>", "")
        blocks = [prose() for _ in range(rnd.randint(2, 6))]
        title = prose()
        out = []
        for b in blocks:
            words = b.split(" ")
            words[1] = rnd.choice(("<b>{}</b>", "<i class=x>{}</i>", "{}<!-- > no -->", "<a href='/x?a=1&b=2'>{}</a>", "{}", "{}<br>")).format(words[1])
            body = rnd.choice((" ", "\n  ", "&#32;", " \t ")).join(words)
            out.append(rnd.choice(("<p>{}</p>", "<p>{}", "<P CLASS='t'>{}</P>", "<p title='a > b'>{}</p>")).format(body))
        article = rnd.choice(("<article>{}</article>", "<main><article>{}</article></main>", "<div class='content'><article>{}</article></div>", "<section><article id=main>{}</article></section>")).format(f"<h1>{title}</h1>" + "".join(out))
        nav = "<nav><ul>" + "".join(f"<li><a href=/{word()}>{word()}</a>" for _ in range(5)) + "</ul></nav>"
        after = rnd.choice(("<footer>&copy; x &middot; {}</footer>", "<div class=ad>{}</div><footer>{}</footer>", "<aside><h3>{}</h3></aside>", "<section id='comments'><h3>{}</h3><p>{}</p></section>")).replace("{}", prose())
        form = rnd.choice(("", "<form><label>Mail<input></label><button>Go</button></form>"))
        yield rnd.choice(heads) + nav + article + form + after + rnd.choice(("</body></html>", "")), [title, *[re.sub(r"\s+", " ", b) for b in blocks]]


def test_html_odd_pages(spark):
    pages = list(odd_pages())
    rows = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html.extract(rows).collect()}
    wrong = [i for i, (_, want) in enumerate(pages) if got[i] != want]
    assert len(wrong) <= 4, (len(wrong), pages[wrong[0]][0], got[wrong[0]])


def test_html_of_the_pages_table(spark, sf):
    """The pages keep their main text in an article element, which the model is not told."""
    rows = common.table(spark, sf, "pages").collect()
    got = {r.page_id: r.text for r in html.op1_html(spark, sf).collect()}
    for r in rows:
        page = html.parse(r.html.replace("<html", '<html data-y="0"', 1).replace("<article>", '<article data-y="1">'))
        assert got[r.page_id] == "\n\n".join(t for t, k, y in zip(page.texts, page.kind, page.labels) if k and y)


def test_html_deep_nesting():
    assert [t for t in html.parse("<ul><li>a" + "<span>" * 100 + "<li>b" + "<div>" * 5000 + "c").texts if t] == ["a", "b", "c"]


# ---- components -------------------------------------------------------------


def test_components_tell_when_rounds_end(spark):
    with pytest.raises(RuntimeError):
        common.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), max_rounds=1)


def components_brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(4))
def test_forests_connect_the_same_nodes(seed, monkeypatch):
    monkeypatch.setattr(common, "EDGES", (4, 16, 64, 1 << 18)[seed])
    rnd = random.Random(seed)
    edges = [(rnd.randrange(90) - 20, rnd.randrange(90) - 20) for _ in range(rnd.choice((3, 60, 100)))]
    batches = [pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges[i : i + 7]], pa.int64()) for k in range(2)], ["a", "b"]) for i in range(0, len(edges), 7)]
    got = [(a.as_py(), b.as_py()) for batch in common.forests(iter(batches)) for a, b in zip(batch["a"], batch["b"])]
    brute = components_brute(edges)
    assert {x: r for x, r in components_brute(got).items()} == {x: r for x, r in brute.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert all(a > b for a, b in got) and not list(common.forests(iter([])))


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(-500, 500), rnd.randrange(-500, 500)) for _ in range(500)] + [(2000, k) for k in range(2001, 2100)] + [(3000 + k, 3001 + k) for k in range(70)]
    rnd.shuffle(edges)
    edges = [e for e in edges if e[0] != e[1]]
    got = [(r.node, r.component) for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()]
    assert len(got) == len(dict(got)) and dict(got) == components_brute(edges)
    assert common.connected_components(spark.createDataFrame([(None, 1), (7, 7)], "a long, b long")).collect() == []
