"""Suffix sorting by induction with queues on disk.

Suffixes that start a rising run after a falling one (LMS suffixes) are sorted first: the pieces between them get
names, and the string of names is sorted in turn. All other suffixes are induced from them in two sweeps over the
first characters, in which a queue hands on (suffix, common prefix) tuples: a suffix that is taken out in its order
puts the suffix before it into the queue of that one's character. Queues, text and results live in files, of which
a bounded part is in memory.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Common prefixes are counted up to this length; suffixes that agree so far may stand in any order.
CAP = 64
#: Tuples that queues keep in memory together before they go to disk, and tuples taken out at once.
IN_MEMORY = 4_000_000
AT_ONCE = 1 << 18
#: Strings over larger alphabets are not induced again, but sorted by doubling.
SYMBOLS = 1024

TUPLE = np.dtype([("pos", np.int64), ("lcp", np.uint8)])


class DiskQueue:
    """First in, first out for each key; keys are taken in rising or falling order, so the whole is a priority queue."""

    def __init__(self, folder: Path, name: str, in_memory: int = IN_MEMORY):
        self.folder, self.name, self.in_memory = folder, name, in_memory
        self.chunks: dict[int, list[np.ndarray]] = defaultdict(list)
        self.on_disk: dict[int, int] = defaultdict(int)  # tuples
        self.held = 0

    def path(self, key: int) -> Path:
        return self.folder / f"{self.name}-{key}"

    def push(self, key: int, tuples: np.ndarray) -> None:
        if len(tuples):
            self.chunks[key].append(tuples)
            self.held += len(tuples)
            if self.held > self.in_memory:
                self.spill()

    def spill(self) -> None:
        for key, chunks in self.chunks.items():
            if chunks:
                with self.path(key).open("ab") as f:
                    for c in chunks:
                        f.write(c.tobytes())
                        self.on_disk[key] += len(c)
        self.chunks.clear()
        self.held = 0

    def stream(self, key: int) -> Iterator[np.ndarray]:
        """Takes all tuples of the key out in order, those that are pushed meanwhile too."""
        while self.on_disk[key] or self.chunks[key]:
            if self.on_disk[key]:
                n, self.on_disk[key] = self.on_disk[key], 0
                os.rename(self.path(key), taken := self.folder / f"{self.name}-taken")
                with taken.open("rb") as f:
                    while len(part := np.fromfile(f, TUPLE, AT_ONCE)):
                        n -= len(part)
                        yield part
                taken.unlink()
            else:
                chunks, self.chunks[key] = self.chunks[key], []
                self.held -= sum(map(len, chunks))
                yield from gathered(chunks)

    def falling(self, key: int) -> Iterator[np.ndarray]:
        """Takes all tuples of the key out, the last first."""
        for c in reversed(list(gathered(self.chunks[key]))):
            yield c[::-1]
        self.held -= sum(map(len, self.chunks.pop(key, [])))
        if n := self.on_disk[key]:
            with self.path(key).open("rb") as f:
                for at in reversed(range(0, n, AT_ONCE)):
                    f.seek(at * TUPLE.itemsize)
                    yield np.fromfile(f, TUPLE, min(AT_ONCE, n - at))[::-1]
            self.path(key).unlink()
            self.on_disk[key] = 0


def gathered(chunks: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The chunks in order, small ones joined up to AT_ONCE."""
    pending, n = [], 0
    for c in chunks:
        pending.append(c)
        n += len(c)
        if n >= AT_ONCE:
            yield np.concatenate(pending)
            pending, n = [], 0
    if pending:
        yield np.concatenate(pending)


def tuples(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), TUPLE)
    out["pos"], out["lcp"] = pos, lcp
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Per position: its suffix is smaller than the next one (S-type). The last character is a sentinel, smaller than all, and S-type."""
    n = len(text)
    out = np.empty(n, bool)
    differ = np.flatnonzero(text[:-1] != text[1:])  # ends of runs of equal characters
    up = text[differ] < text[differ + 1]
    lengths = np.diff(np.concatenate([[-1], differ]))
    out[: n - 1] = np.repeat(up, lengths)[: n - 1]
    out[n - 1] = True
    return out


def words(text: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on as one number; beyond the end they are zero."""
    padded = text if len(text) and pos.max(initial=0) + 8 <= len(text) else np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return np.ascontiguousarray(view[pos]).view(">u8").ravel().astype(np.uint64)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefixes of the suffixes at a and b, up to CAP."""
    out, on = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, CAP, 8):
        if not len(on):
            break
        x = words(text, np.minimum(a[on] + at, len(text) - 1)) ^ words(text, np.minimum(b[on] + at, len(text) - 1))
        high = np.zeros(len(x), np.int64)
        left = x.copy()
        for s in (32, 16, 8):  # bytes of the highest set one
            big = left >= np.uint64(1) << np.uint64(s)
            high[big] += s // 8
            left[big] >>= np.uint64(s)
        out[on] += np.where(x == 0, 8, 7 - high)
        on = on[x == 0]
    return np.minimum(out, CAP).astype(np.uint8)


def groups(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the last being the major one: the place at which each element's group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.concatenate([at, [len(new)]])))


def refined(rank: np.ndarray, on: np.ndarray, key: np.ndarray) -> None:
    """Ranks are places in the order. Those of the elements `on` (whole groups of equal ranks) are refined by the key."""
    order = np.lexsort((key, rank[on]))
    own, r, k = on[order], rank[on][order], key[order]
    rank[own] = r + groups(k, r) - groups(r)


def padded_words(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes of each piece from `at` on; what lies beyond its end is the largest byte."""
    over = np.clip(lengths - at, 0, 8).astype(np.uint64)
    pad = np.where(over == 0, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (np.uint64(8) - np.maximum(over, 1)))) - np.uint64(1))
    return words(text, starts + at) | pad


def named(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the pieces from each start to the next one, both ends included, in their order; equal pieces have one place.
    Of two pieces of which one begins the other, the shorter is larger."""
    lengths = np.diff(np.concatenate([starts, [len(text) - 1]])) + 1
    lengths[-1] = 1  # the sentinel
    w = padded_words(text, starts, lengths, 0)
    order = np.argsort(w)
    rank = np.empty(len(starts), np.int64)
    rank[order] = groups(w[order])
    at, on = 8, np.flatnonzero(lengths >= 8)  # one that ends here is padded once more, against longer ones
    while len(on):
        refined(rank, on, padded_words(text, starts[on], lengths[on], at))
        at += 8
        on = np.flatnonzero(lengths >= at)
    return rank


def by_doubling(rank: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string of places, of which at least `depth` count (all if None). Only ties are sorted again."""
    rank, step, n = rank.copy(), 1, len(rank)
    while depth is None or step < depth:
        on = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(on):
            break
        refined(rank, on, np.where(on + step < n, rank[np.minimum(on + step, n - 1)] + 1, 0))
        step *= 2
    return np.argsort(rank, kind="stable")


class Inducer:
    """Suffix order of a text of bytes 1 .. 254 and a last 0, from the largest suffix to the smallest."""

    def __init__(self, text: np.ndarray, folder: Path, exact: bool = False, in_memory: int = IN_MEMORY):
        assert len(text) and text[-1] == 0
        self.text, self.folder, self.in_memory = text, folder, in_memory
        self.up = rising(text)
        self.depth = None if exact else CAP // 2  # names are at least two characters apart

    def lms(self) -> np.ndarray:
        """Positions of the LMS suffixes in their order."""
        starts = np.flatnonzero(self.up[1:] & ~self.up[:-1]) + 1
        places = named(self.text, starts)
        seen = np.zeros(len(starts), np.int64)
        seen[places] = 1
        count = int(seen.sum())
        if count == len(starts):
            return starts[np.argsort(places)]
        if count < min(SYMBOLS, 253) and len(starts) > 64:
            # the string of names is a text of the same kind: the sentinel's name is 0 and the least
            sub = self.folder / "names"
            sub.mkdir()
            names = (np.cumsum(seen) - 1)[places].astype(np.uint8)
            order = np.concatenate([c["pos"] for c in Inducer(names, sub, self.depth is None, self.in_memory).falling()])[::-1]
            sub.rmdir()
            return starts[order]
        return starts[by_doubling(places, self.depth)]

    def run_length(self, pos: int) -> int:
        part = self.text[pos : pos + CAP]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def induce(self, queue: DiskQueue, batch: np.ndarray, least: np.ndarray, s_type: bool) -> None:
        """Puts the suffixes before those of the batch into the queue, if they are of the type; least: per character,
        the smallest common prefix since the last suffix that went to its queue."""
        lcp = batch["lcp"]
        before = batch["pos"] - 1
        fits = before >= 0
        fits[fits] = self.up[before[fits]] == s_type
        at = np.flatnonzero(fits)
        low = lcp.min()
        if not len(at):
            np.minimum(least, low, out=least)
            return
        chars = self.text[before[at]]
        present = np.unique(chars)
        absent = np.ones(256, bool)
        absent[present] = False
        least[absent] = np.minimum(least[absent], low)
        for c in present.tolist():
            own = at[chars == c]
            # minima over the stretches that end with each of the own suffixes, and over what follows the last
            cuts = np.concatenate([[0], own + 1])
            mins = np.minimum.reduceat(lcp[: own[-1] + 1], cuts[:-1])
            mins[0] = min(mins[0], least[c])
            least[c] = lcp[cuts[-1] :].min() if cuts[-1] < len(lcp) else 255
            queue.push(c, tuples(before[own], np.minimum(mins.astype(np.int64) + 1, CAP).astype(np.uint8)))

    def falling(self) -> Iterator[np.ndarray]:
        """Tuples of all suffixes from the largest on, lcp with the one before (the next larger; 0 for the first)."""
        text = self.text
        order = self.lms()
        lcp = np.zeros(len(order), np.uint8)
        if len(order) > 1:
            lcp[1:] = common(text, order[:-1], order[1:])
        first = text[order]
        bounds = np.searchsorted(first, np.arange(257))
        # falling suffixes, in rising order of characters
        queue, done = DiskQueue(self.folder, "l", self.in_memory), DiskQueue(self.folder, "d", self.in_memory)
        least = np.zeros(256, np.uint8)
        for c in range(256):
            last = -1
            started = False
            for batch in queue.stream(c):
                if not started:
                    batch["lcp"][0], started = 0, True  # another first character comes before
                done.push(c, batch)
                last = int(batch["pos"][-1])
                self.induce(queue, batch, least, False)
            a, b = bounds[c], bounds[c + 1]
            if a < b:
                own = tuples(order[a:b], lcp[a:b])
                own["lcp"][0] = min(self.run_length(last), self.run_length(int(order[a]))) if last >= 0 else 0
                for at in range(0, len(own), AT_ONCE):
                    self.induce(queue, own[at : at + AT_ONCE], least, False)
        # rising suffixes, in falling order of characters
        queue = DiskQueue(self.folder, "s", self.in_memory)
        least = np.zeros(256, np.uint8)
        for c in range(255, -1, -1):
            last, started = -1, False
            if c == 0:
                queue.push(0, tuples(np.array([len(text) - 1]), np.zeros(1, np.uint8)))
            for batch in queue.stream(c):
                if not started:
                    batch["lcp"][0], started = 0, True
                last = int(batch["pos"][-1])
                yield batch
                self.induce(queue, batch, least, True)
            shift = None  # what the suffix taken before had in common with the one that comes now
            for batch in done.falling(c):
                batch = batch.copy()
                own = batch["lcp"].copy()
                batch["lcp"][1:] = own[:-1]
                if shift is None:
                    batch["lcp"][0] = min(self.run_length(last), self.run_length(int(batch["pos"][0]))) if last >= 0 else 0
                else:
                    batch["lcp"][0] = shift
                shift = own[-1]
                yield batch
                self.induce(queue, batch, least, True)
