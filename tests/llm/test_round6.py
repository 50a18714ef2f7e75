"""Findings of round 4 about the training-data operators."""

import numpy as np
import pytest

from tarn.llm import suffixes

WIDTH = 50


def blob(docs: list[tuple[int, bytes]]) -> bytes:
    """All segments of the documents, as they reach a shard."""
    rows = [(i, a, t[a : a + n + WIDTH - 1]) for i, t in docs for a, n in zip(*(x.tolist() for x in suffixes.segments(np.frombuffer(t, np.uint8), WIDTH)[1:]))]
    ids, places, data = zip(*rows)
    return suffixes.packed(np.array(ids, np.int64), np.zeros(len(ids), np.int32), np.array(places, np.int32), np.array([len(d) for d in data], np.uint16), b"".join(data))


def removed(blobs: list[bytes]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for ids, _, starts, stops in suffixes.stretches_of(blobs, WIDTH):
        for i, a, z in zip(ids.tolist(), starts.tolist(), stops.tolist()):
            out.setdefault(i, set()).update(range(a, z))
    return out


@pytest.mark.parametrize("at_once", (1, 300, 1 << 18))
def test_segments_without_a_common_window_are_not_sorted(monkeypatch, at_once):
    """all segments of a key that several segments have were sorted, also where a phrase shorter than a window was all that they had in common."""
    monkeypatch.setattr(suffixes, "HASHED_BYTES", at_once, raising=False)
    rng = np.random.default_rng(11)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    phrase, passage = letters(40), letters(90)
    sorted_bytes = []
    own = suffixes.Inducer
    monkeypatch.setattr(suffixes, "Inducer", lambda text, folder: sorted_bytes.append(len(text)) or own(text, folder))
    docs = [(i, letters(60) + phrase + letters(60)) for i in range(30)]
    assert removed([blob(docs)]) == {} and not sorted_bytes
    more = [(40, letters(70) + passage + letters(30)), (41, passage[5:] + letters(50)), (35, letters(80) + passage[:-8])]
    texts = dict(docs + more)
    got = removed([blob(docs[:9] + more[:2]), blob(docs[9:] + more[2:])])
    windows = lambda t: {t[k : k + WIDTH]: k for k in range(len(t) - WIDTH + 1)}
    want: dict[int, set[int]] = {}
    for i, t in texts.items():
        before = {w for j, u in texts.items() if j < i for w in windows(u)}
        if gone := {b for w, k in windows(t).items() if w in before for b in range(k, k + WIDTH)}:
            want[i] = gone
    assert got == want and set(want) == {40, 41}
    # the segments of the passage alone
    assert sum(sorted_bytes) < sum(len(t) for _, t in more) * 4
