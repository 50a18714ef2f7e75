"""Findings of round 3 about the training-data operators."""

import random

from tarn.llm import simhash

WIDTH = 5


def families(seed: int) -> list[list[str]]:
    """Texts of passages that few, some and most of them share: their crowded keys have several frequencies."""
    rnd = random.Random(seed)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    everywhere, some, texts = words(30), [words(30) for _ in range(4)], []
    for k in range(100):
        own = [*everywhere, *some[k % 4], *some[(k // 4) % 4]]
        texts.append([*own, *words(rnd.choice((4, 10, 16, 20, 24)))])
    return texts


def roots(texts: list[list[str]]) -> dict[int, int]:
    sets = [frozenset(tuple(t[i : i + WIDTH]) for i in range(len(t) - WIDTH + 1)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return dict(enumerate(root))


def frame(spark, texts):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_first_shared_key_is_by_the_order_of_the_sets(spark, monkeypatch):
    """pairs whose least crowded key by value is a late one of the prefixes were left out by its place."""
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash, "MIXERS", ())
    monkeypatch.setattr(simhash, "GUESS", 0)
    for seed in range(2):
        texts = families(seed)
        got = {r.doc_id: r.component_id for r in simhash.components(frame(spark, texts), WIDTH, 0.2).collect()}
        assert got == roots(texts) and 1 < len(set(got.values())) < len(got)


def test_copies_are_one_set_in_the_sample(spark):
    """shingles of one text with many copies aren't common, and take no place among the common ones."""
    copies = [[f"w{i}" for i in range(20)]] * 8
    others = [["a", "b", "c", "d", "e", f"x{i}"] for i in range(3)]
    hashes, times = simhash.common_shingles(frame(spark, copies + others), WIDTH)
    assert hashes.tolist() == simhash.shingle_hashes("a b c d e", WIDTH).tolist() and times.tolist() == [3]


def test_fingerprints_of_all_texts_are_linked(spark, monkeypatch):
    """SimHash links come from all texts, not from those with crowded keys alone."""
    seen = []
    own = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, distance: seen.append((distinct.count(), distance)) or own(distinct, distance))
    texts = [[f"w{k}_{i}" for i in range(30)] for k in range(12)]
    assert len(simhash.components(frame(spark, texts), WIDTH, 0.2).collect()) == 12
    assert seen == [(12, simhash.GUESS)]
