"""The pipeline's stages against what their operators say, on a small table."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tarn.llm import bpe, langid, mixing, pii, simhash
from tarn.llm.common import table


def test_stages(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "simhash near-dedup", "pii", "mixing", "bpe"]
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf).cache())
        assert kept[-1].columns == columns
    ids = [Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    model = langid.fit_documents(docs)
    accepted = {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE}
    assert set(ids[1]) == accepted
    groups = simhash.components(kept[1], 5, corpus_pipeline.DISTANCE).collect()
    assert ids[2] == Counter({r.component_id for r in groups})
    assert ids[3] == ids[2]
    found = {r.doc_id: r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii.report(pii.find_spans(kept[3])).collect()}
    assert not any(found.values())
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert ids[4] == Counter({k: v for k, v in copies.items() if v})
    coded = {r.doc_id: list(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, kept[4], sf).collect()}
    own = bpe.coder(bpe.default_path())
    assert coded == {r.doc_id: own.encode(r.text) for r in kept[4].select("doc_id", "text").distinct().collect()}
    assert corpus_pipeline.run(spark, sf).count() == sum(ids[4].values())


def test_stages_on_empty_and_odd_rows(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    odd = table(spark, sf, "documents").limit(40).withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, F.col("lang")), "source": F.when(F.col("doc_id") % 3 == 0, F.col("source")), "text": F.when(F.col("doc_id") % 5 != 0, F.col("text"))})
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, sf)
    assert odd.count() > 0


@pytest.mark.parametrize("few", [64, 3])
def test_near_copies_of_similarity_08(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    line, texts = words(30), []
    for k in range(60):
        base = words(rnd.choice((40, 120, 300))) + (line if k % 2 else [])
        texts.append(base)
        for _ in range(rnd.choice((1, 1, 4))):
            near = list(base)
            for i in rnd.sample(range(len(near)), max(1, len(near) * rnd.choice((1, 2, 3, 4)) // 100)):
                near[i] = words(1)[0]
            texts.append(near)
    texts += [["short"], ["short", "text"], ["Short"], *[line + words(5) for _ in range(20)]]
    rnd.shuffle(texts)
    sets = [frozenset(tuple(w.lower() for w in t[i : i + 5]) for i in range(max(1, len(t) - 4))) for t in texts]
    root, hidden = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
                hidden += (simhash.fingerprint(" ".join(texts[i]), 5) ^ simhash.fingerprint(" ".join(texts[j]), 5)).bit_count() > 6
    assert hidden > 20
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert {r.doc_id: r.component_id for r in simhash.components(docs, 5, corpus_pipeline.DISTANCE).collect()} == dict(enumerate(root))
