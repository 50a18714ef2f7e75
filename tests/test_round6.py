"""Later findings of round 3: fuzzy scores and the learned ranker."""

import random
from difflib import SequenceMatcher

import pytest

from tarn.operators import fuzzy


def words_of(rnd: random.Random, n: int) -> list[str]:
    return list(dict.fromkeys("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 14))) for letters in ("ab", "abcdef", "aé日😀", "xyz_") for _ in range(n)))


@pytest.mark.parametrize("pairs", (1, 1 << 20))
def test_best_similarities_by_few_bounds(monkeypatch, pairs):
    """letters were counted anew for each token of a comment, and each pair had a SequenceMatcher of its own."""
    monkeypatch.setattr(fuzzy, "PAIRS", pairs)
    rnd = random.Random(3)
    own, known = [*words_of(rnd, 12), "a" * 30, "é" * 5 + "a" * 25], [*words_of(rnd, 25), "a" * 40, "b" * 12 + "a" * 12]
    plain = lambda a: max((SequenceMatcher(None, a, b).ratio() for b in known if fuzzy.worth(a, b)), default=0.0)
    made = []
    monkeypatch.setattr(fuzzy, "SequenceMatcher", lambda *x: made.append(x) or SequenceMatcher(*x))
    fuzzy.ratio.cache_clear()
    assert fuzzy.Tokens(known).bests(own) == [plain(a) for a in own]
    assert not made and fuzzy.Tokens([]).bests(own[:2]) == [0.0, 0.0]


def test_ratio_of_long_texts_and_none():
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcd") for _ in range(260))
    for a, b in ((long[:50], long), (long, long[:50]), ("", ""), ("", "a"), ("a", ""), ("abab", "baba")):
        assert fuzzy.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
