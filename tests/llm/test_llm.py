"""The operators of tarn.llm against brute force, on small inputs with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import tempfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import audio, bpe, common, html, induced, langid, lattice, mixing, pii, sharding, simhash, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source); with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    if extra:
        for name in ("size", "h", "bucket", "fp", "component_id", "mark", "id", "row", "own_id", "base", "spans", "t", "copies", "key", "n"):
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


EDGE = [(1, None, "en", "a"), (2, "", None, None), (None, "the small text here", "en", "a"), (3, "  \n\t ", "de", "b"), (4, "word", "en", None), (4, "word", "en", None), (5, "word", "fr", "b"), (6, "é漢🙂 " * 3000, None, "c")]
EMPTY = []


# ---- mixing ---------------------------------------------------------------


def mix_brute(rows):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (_, t, _, _) in enumerate(rows)}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, r in enumerate(rows) if r[3] == s) for s in sources}
    weight = {s: float(mixing.WEIGHTS[i % 3]) for i, s in enumerate(sources)}
    budget, target, left = 1.5 * sum(total.values()), {}, set(sources)
    while left:
        rest = budget - sum(target.values())
        unit = rest / sum(weight[s] for s in left)
        over = [s for s in left if 2.0 * total[s] <= weight[s] * unit]
        for s in over or left:
            target[s] = min(2.0 * total[s], weight[s] * unit) if over else weight[s] * unit
        left -= set(over or left)
    return size, total, target, budget


def test_mixing_targets_and_budget(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), "en", rnd.choice(["a", "a", "a", "b", "c", None, "dé"])) for i in range(400)]
    got = mixing.mix(documents(spark, rows)).collect()
    size, total, target, budget = mix_brute(rows)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = rows[r.doc_id][3]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert sum(taken.values()) <= budget
    assert all(abs(taken[s] - target[s]) <= 301 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(documents(spark, rows)).collect()))


def test_mixing_edges(spark):
    got = mixing.mix(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(documents(spark, EMPTY)).count() == 0
    mixed = mixing.mixed_documents(documents(spark, EDGE))
    assert "row" in mixed.columns and mixed.where("size = 'clash'").count() == mixed.count() > 0


# ---- sharding -------------------------------------------------------------


def test_sharding_against_splitting(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.choice([0, 10, 200, 900]), "en", "a") for i in range(500)]
    limit = 2000
    got = sharding.assign(documents(spark, rows), limit).collect()
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16):032b}" for i, *_ in rows}
    expected, todo = {}, [("", [r[0] for r in rows])]
    while todo:
        prefix, ids = todo.pop()
        if sum(len(rows[i][1]) for i in ids) <= limit:
            expected |= dict.fromkeys(ids, prefix)
        else:
            for b in "01":
                todo.append((prefix + b, [i for i in ids if bits[i][len(prefix)] == b]))
    assert {r.doc_id: r.shard for r in got} == expected
    held = Counter()
    for r in got:
        held[r.shard] += r.n_bytes
    assert all(r.shard_bytes == held[r.shard] <= limit for r in got)


def test_sharding_repeated_keys(spark):
    rows = [(7, "y" * 30, "en", "a")] * 200 + [(8, "z" * 5000, "en", "a")] + EDGE
    got = sharding.assign(documents(spark, rows), 100).collect()
    assert len(got) == len(rows)
    held = Counter()
    for r in got:
        held[r.shard] += r.n_bytes
    assert all(v <= 100 or "#big" in k for k, v in held.items())
    assert all(held[r.shard] == r.shard_bytes for r in got)
    assert sharding.assign(documents(spark, EMPTY)).count() == 0


# ---- BPE --------------------------------------------------------------------


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    own, library = bpe.coder(path), Tokenizer.from_file(path)
    rnd = random.Random(3)
    chars = "abcABC'123 \t\n\r\x0b\x1c\x85\xa0ÉéßſİıΣςﬁ漢字🙂👩‍👧1²½-_.,!?</w>​"
    texts = ["<|endoftext|>", "a <|endoftext|>B", "a" * 3000, "é" * 2000, "the" * 700, ""] + ["".join(rnd.choices(chars, k=rnd.randint(1, 50))) for _ in range(2000)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.encode(None) == []
    # a cut never lies inside a token
    assert all(not own.cut(t[: -len(own.suffix)].encode()) for t in list(own.vocab)[:5000] if t.endswith(own.suffix) and len(t) > 5 and t.isascii())


def test_bpe_edges(spark):
    got = bpe.digest_documents(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in got if r.doc_id in (1, 2, 3))
    assert bpe.encode_documents(documents(spark, EMPTY)).count() == 0


# ---- language ID ------------------------------------------------------------


def test_language_id(spark, sf):
    docs = common.table(spark, sf, "documents")
    got = langid.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark):
    model = langid.fit([("the house and the tree of the man", "en"), ("das haus und der baum des mannes", "de")] * 3)
    assert langid.predict(model, [None, "", "123 !?", "the tree"])[:3] == [("und", 0.0)] * 3
    assert langid.predict(model, ["der baum und das haus " * 100_000])[0][0] == "de"
    assert len(langid.identify(documents(spark, EDGE), model).collect()) == len(EDGE)
    kept = langid.keep_identified(documents(spark, EDGE), model, 0.0)
    assert kept.columns == documents(spark, EDGE).columns
    assert kept.where("lang is null").count() == 0 and kept.where("doc_id in (1, 2, 3)").count() == 0
    nothing = langid.fit_documents(documents(spark, EMPTY))
    assert langid.predict(nothing, ["text"]) == [("und", 0.0)]


# ---- PII --------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for i, k in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[k], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            out += [(m.start(), i, m.end())] * ok
    return sorted(out)


def test_pii_base_equals_patterns(spark):
    rnd = random.Random(5)
    parts = ["a", "b@", "c.", "@", "..", ".", "é", "🙂", " ", "-", "1", "25", "255", "+", "4", "(", ")", "9.", "_", "%", "d", "com", " 4532015112830366 ", "4111 1111 1111 1111", "\n", "1.2.3.4"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(1500)] + [t for _, t, *_ in EDGE]
    texts += ["a@b.c_d@e.f", "a@b.c..d@e.f x@y.z.", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1", "1" * 20000, "1 " * 20000, "a." * 20000 + "@b." + "c." * 20000, "+" + "1 " * 20000, "+12345678 9 " * 4000]
    got = {r.doc_id: r for r in pii.find_spans(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.stop) for s in got[i].base] == base_spans(t), t
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}


def test_pii_selects_by_context(spark):
    texts = ["call me, phone (555) 123-4567 today", "see order 555-123-4567 today", "mail john.doe [at] example [dot] com please", "plain words at home. Nothing else", "mail a.b@c.org or +1 (555) 123-4567"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.spans for r in pii.report(pii.find_spans(docs)).collect()}
    assert got == {0: "phone:15:29", 1: "", 2: "email:5:36", 3: "", 4: "email:5:14,phone:18:35"}
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[4] == "mail [email] or [phone]" and clean[1] == texts[1]
    assert pii.redacted(docs).columns == docs.columns
    assert pii.op4_pii.__name__ and pii.find_spans(documents(spark, EMPTY)).count() == 0


# ---- SimHash ----------------------------------------------------------------


def fingerprint_brute(text, width):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints():
    rnd = random.Random(6)
    for _ in range(300):
        t = "".join(rnd.choices(["A", "b", "É", " ", "\x0b", "\x1c", "\xa0", "word ", "\n"], k=rnd.randint(0, 60)))
        assert simhash.fingerprint(t, 4) == fingerprint_brute(t, 4)
    assert simhash.fingerprint(None, 4) == 0


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.choice([0, 1, 2, 4]))) for b in base for _ in range(12)] + [base[0]] * 30
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long")
    groups = {r.node: r.component for r in common.connected_components(simhash.links(distinct)).collect()}
    root = {f: f for f in set(signed)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(groups.get(f, f) == find(f) for f in root)


def test_simhash_edges(spark):
    docs = documents(spark, EDGE + [(9, None, "en", "a")])
    got = simhash.components(docs, 4).collect()
    assert len(got) == len(EDGE) + 1
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == by[9] == 1 and by[4] == by[5] == 4
    kept = simhash.keep_one(docs, 4)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, 1), (False, 4), (False, 6)]
    assert simhash.components(documents(spark, EMPTY)).count() == 0


# ---- audio ------------------------------------------------------------------


def test_audio_round_trip_and_features(spark):
    for t in (None, "", "x" * 64, "y" * 65, "é🙂" * 9000):
        payload, n = audio.payload_of(t)
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] == (t or "").encode() and not any(payload[n:])
        assert audio.read_back(audio.store(payload)) == (payload, audio.RATE)
    x = np.sin(2 * np.pi * 300 * np.arange(8000) / 8000).astype(np.float32)
    y = audio.resample(x, 0, 6000)
    shift = (audio.UP * audio.TAPS - 1) / 2 / audio.UP / 8000
    z = np.sin(2 * np.pi * 300 * (np.arange(6000) / 6000 - shift))
    assert np.abs(y - z)[100:-100].max() < 0.01
    assert np.allclose(np.concatenate([audio.resample(x, 0, 1000), audio.resample(x, 1000, 6000)]), y, atol=1e-6)
    assert audio.hysteresis(np.array([0, 2, 3, 2, 0, 2, 2, 0.0]), 3, 2) == [(1, 4)]
    got = audio.media_columns(documents(spark, EDGE))
    table = audio.tensor_table(got.toArrow())
    assert table["tensor"].type.shape == list(audio.SHAPE)
    rows = got.select("doc_id", "n_bytes", "payload_sha256", "tail_crc32", "media", "feature").collect()
    assert len(rows) == len(EDGE) and len({r[1:] for r in rows if r.doc_id in (4, 5)}) == 1
    assert audio.media_columns(documents(spark, EMPTY)).count() == 0


# ---- suffix order -----------------------------------------------------------


def test_induced_sorting(monkeypatch):
    rng = np.random.default_rng(0)
    for it in range(300):
        t = rng.integers(1, (int(rng.integers(2, 7)) if it % 3 else 200), int(rng.integers(1, 300)))
        t = np.tile(t[: max(1, len(t) // 7)], 8) if it % 5 == 0 else np.repeat(t, 20)[:300] if it % 7 == 0 else t
        text = np.concatenate([t, [0]]).astype(np.uint8)
        monkeypatch.setattr(induced, "AT_ONCE", int(rng.choice([3, 17, 1 << 18])))
        with tempfile.TemporaryDirectory() as d:
            got = np.concatenate(list(induced.Inducer(text, Path(d), True, int(rng.choice([5, 50, 10**6]))).falling()))
        b = text.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:], reverse=True)
        assert got["pos"].tolist() == order
        for k in range(1, len(order)):
            x, y = b[order[k - 1] :][:64], b[order[k] :][:64]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert got["lcp"][k] == n


def removed_brute(docs, width):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            first[b[p : p + width]] = min(first.get(b[p : p + width], 1 << 62), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                m[p : p + width] = 1
        runs = int((np.diff(np.concatenate([[0], m])) == 1).sum())
        out.append((i, len(b), int(m.sum()), runs, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("width", [8, 50])
def test_suffix_dedup(spark, width):
    rnd = random.Random(width)
    pool = ["".join(rnd.choices("ab cé", k=rnd.randint(1, 90))) for _ in range(12)] + ["a" * 200, "ab" * 80, "x" * 49, "x" * 50, "x" * 51, "\x00" * 60]
    docs = [(rnd.randint(0, 60), "".join(rnd.choices(pool, k=rnd.randint(0, 5)))) for _ in range(80)] + [(None, pool[0] * 3), (3, None), (4, "")]
    got = suffixes.digest(documents(spark, [(i, t, "en", "a") for i, t in docs]), width).collect()
    assert sorted(str(tuple(r)) for r in got) == removed_brute(docs, width)
    assert suffixes.digest(documents(spark, EMPTY), width).count() == 0


# ---- embeddings -------------------------------------------------------------


def test_e8_nearest():
    rng = np.random.default_rng(1)
    minimal = lattice.minimal_vectors()
    assert minimal.shape == (240, 8) and len({tuple(v) for v in minimal}) == 240
    x = rng.standard_normal((500, 8)) * 3
    p = lattice.nearest_e8(x)
    assert np.all(np.isclose(p * 2, np.rint(p * 2)))
    own = np.square(x - p).sum(1)
    other = np.square(x[:, None] - (p[:, None] + minimal[None])).sum(2).min(1)
    assert (own <= other + 1e-9).all() and own.max() <= 1 + 1e-9


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TILE", 10)
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((20, 32))
    rows = [(100 + i, (centers[i % 20] + 0.05 * rng.standard_normal(32)).tolist(), i % 3 if i % 20 else 1) for i in range(240)]
    rows += [(1000 + k, v, lab) for k, (v, lab) in enumerate([(None, 1), ([], 1), ([0.0] * 32, 1), ([float("nan")] * 32, 1), ([None] + [1.0] * 31, 1), (rows[0][1], None), (rows[0][1][:31], 1)])]
    rows += [(5, rows[0][1], rows[0][2]), (6, rows[0][1], rows[0][2]), (6, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash")).withColumn("copies", F.lit(0))
    got = lattice.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fine = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = lambda a: [b[0] for b in fine if b is not a and b[2] == a[2] and len(b[1]) == len(a[1]) and a[1] @ b[1] >= 0.93]
    expected = Counter((a[0], len(links(a))) for a in fine)
    assert Counter((r.vec_id, r.n_links) for r in got if r.vec_id is not None and (r.vec_id < 1000 or r.vec_id == 1006)) == expected
    assert all(r.n_links == 0 for r in got if r.vec_id is None or 1000 <= r.vec_id < 1006)
    near = {a[0]: links(a) for a in fine}
    for r in got:
        if r.vec_id in near:
            reach, todo = set(), [r.vec_id]
            while todo:
                if (x := todo.pop()) not in reach:
                    reach.add(x)
                    todo += near[x]
            assert r.component_id == min(reach) and r.kept == (r.vec_id == min(reach))
    assert lattice.near_duplicates(df.limit(0)).count() == 0


# ---- html -------------------------------------------------------------------


def test_html_marginals_are_exact():
    """Message passing against the sum over all labellings of a small tree."""
    page = html.parse("<div class=nav><p>a b<p>c d</div><article><p>e f</article>")
    model = html.trained()
    f = html.Forest.of([page], model.index)
    single, _ = html.marginals(f, model.weights, model.pairs)
    n, total = len(page.parent), np.zeros((len(page.parent), 2))
    own = np.bincount(f.node, model.weights[f.feature], n)
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        w = math.exp(sum(own[k] * y[k] for k in range(n)) + sum(model.pairs[page.kind[k]][y[page.parent[k]]][y[k]] for k in range(1, n)))
        for k in range(n):
            total[k, y[k]] += w
    assert np.allclose(single, total / total.sum(1, keepdims=True))


def test_html_held_out_pages():
    rnd = random.Random(999)
    pages = [html.parse(html.labelled_page(rnd)) for _ in range(100)]
    single, _ = html.marginals(html.Forest.of(pages, html.trained().index), html.trained().weights, html.trained().pairs)
    y, block = np.concatenate([p.labels for p in pages]), np.concatenate([p.kind for p in pages]) == 1
    assert ((single[:, 1] > 0.5) == y)[block].mean() > 0.97


def test_html_article(spark):
    source = '<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies here.</div><article><h1>The  &lt;title&gt;</h1><p>First line,\n with &amp; more words.</p><div class="ad">Buy this now.</div><p><b>Second<br>line.<script>x("</p>")</script></article><div id="comments"><p>I like this text very much.</p></div><footer>&copy; me</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", source), (2, None, None), (3, "", ""), (4, "x", "<p>" * 3000), (1, "u", source)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(pages).collect()
    text = "The <title>\n\nFirst line, with & more words.\n\nSecond line."
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, text, len(text))] * 2 + [(2, "", 0), (3, "", 0), (4, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


# ---- components -------------------------------------------------------------


def test_html_optional_and_missing_end_tags():
    long = "The prose of this article goes on, with commas, and it has no end tag where one may be left out. " * 3
    seen = lambda source: [t for t in html.parse(source).texts if t]
    assert seen(f"<html><head><title>T</title><meta charset=utf-8><style>p{{}}</style><body><article><p>{long}</p></article>") == [long.strip()]
    assert seen(f"<head><script>x</script><noscript><p>no</p></noscript><p>{long}") == [long.strip()]
    assert seen(f"<head>\n {long}") == [long.strip()]
    assert html.texts_of([html.parse(f"<html><head><title>T</title><body><article><h1>On it</h1><p>{long}</p><p>{long}</p></article>")], html.trained())[0].count("prose") == 6
    for tag in ("svg", "object", "canvas", "video", "audio", "noscript"):
        assert seen(f"<div>a<{tag}><g>b<i>c</div><p>d</p><{tag}>e</{tag}>f") == ["a", "d", "f"]
        assert seen(f"<div>a<{tag}><div>b</div><!-- </{tag}> --><script>'</div>'</script><{tag}>c</{tag}>d</{tag}>e</div>") == ["ae"]
    assert seen("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold.</p>") == ["Let x=2 hold."]
    assert seen("<form><select><option>a<option>b<p>c</p></form>d") == ["c", "d"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, None)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 100 for k in range(100, 160)) and 200 not in got
