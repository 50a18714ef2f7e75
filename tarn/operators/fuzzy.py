"""Fuzzy matching of a comment's tokens with a candidate's. The similarity has no built-in; it runs in Arrow batches, on the few pairs that a bound leaves."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..functions import words

LETTERS = 128
#: Length from which SequenceMatcher leaves out characters that are frequent in the second text.
POPULAR = 200
#: Steps by which counts of letters are compared, the rest letter by letter; pairs of tokens compared at once.
STEPS, PAIRS = 8, 1 << 20


def kept(a: Column, least: int) -> Column:
    return F.filter(F.array_distinct(T.stripped(a)), lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$"))


def comment_tokens(c: Column, least: int = 3, focus: bool = False) -> Column:
    """Distinct tokens to look for; focus leaves out those of plain text and of hints."""
    pairs = F.flatten(F.transform(T.replacement_pairs(c), lambda p: F.concat(T.filtered_terms(p["old"]), T.filtered_terms(p["new"]))))
    parts = [T.terms_of(T.inline_code(c)), T.terms_of(T.quoted_spans(c)), pairs, F.flatten(F.transform(T.path_mentions(c), T.path_parts))]
    if not focus:
        parts = [T.filtered_terms(T.clean_comment(c)), *parts, T.terms_of(T.review_intent_hints(c))]
    return kept(F.concat(*parts), least)


def candidate_tokens(c: Column, least: int = 3, plain: bool = False) -> Column:
    """Distinct tokens of a candidate's path and changed lines; plain takes all its lines, for texts that are no diffs."""
    body = T.meaningful_lines(c) if plain else F.array_union(T.added_lines(c), T.removed_lines(c))
    return kept(F.concat(T.path_parts(T.context_path(c)), T.tokens_of_lines(body)), least)


def matching(a: str, b: str) -> int:
    """Characters in the blocks that SequenceMatcher finds: the longest common one, the first of them in a and then in b, and so on at both its sides."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        at = n = 0
        for i in range(len(a)):
            if i + n >= len(a):
                break
            while i + n < len(a) and a[i : i + n + 1] in b:
                at, n = i, n + 1
        if n:
            j = b.index(a[at : at + n])
            total += n
            if at and j:
                todo.append((a[:at], b[:j]))
            if at + n < len(a) and j + n < len(b):
                todo.append((a[at + n :], b[j + n :]))
    return total


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    """SequenceMatcher's ratio."""
    return SequenceMatcher(None, a, b).ratio() if len(b) >= POPULAR or not b else 2.0 * matching(a, b) / (len(a) + len(b))


def worth(a: str, b: str) -> bool:
    """Pairs too different in length, or in their first character and their letters, don't count."""
    if abs(len(a) - len(b)) > max(2, len(a) // 2):
        return False
    if a[0] == b[0] or len(a) < 5:
        return True
    x, y = set(a), set(b)
    return len(x & y) >= max(2, min(len(x), len(y)) // 2)


def codes(text: str) -> np.ndarray:
    """The characters as numbers below LETTERS; other scripts may share a number, which only loosens a bound."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS


def letters(tokens: list[str], sizes: np.ndarray) -> np.ndarray:
    """How often each token has each letter."""
    at = np.repeat(np.arange(len(tokens)), sizes) * LETTERS + codes("".join(tokens))
    return np.bincount(at, minlength=len(tokens) * LETTERS).reshape(-1, LETTERS)


class Tokens:
    """Tokens to compare with, and how often each has each letter."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.sizes = tokens, np.array([len(t) for t in tokens], int)
        self.counts = letters(tokens, self.sizes)

    def shared(self, counts: np.ndarray) -> np.ndarray:
        """How many letters each of the rows of counts has in common with each token: the least of both counts is the number of steps that both reach."""
        out = np.zeros((len(counts), len(self.tokens)), np.float32)
        for step in range(1, min(STEPS, int(counts.max(initial=0)), int(self.counts.max(initial=0))) + 1):
            own, known = counts >= step, self.counts >= step
            some = own.any(0) & known.any(0)
            out += own[:, some].astype(np.float32) @ known[:, some].T.astype(np.float32)
        for letter in np.flatnonzero((counts > STEPS).any(0) & (self.counts > STEPS).any(0)):
            out += np.maximum(np.minimum.outer(counts[:, letter], self.counts[:, letter]) - STEPS, 0)
        return out.astype(int)

    def bests(self, queries: list[str]) -> list[float]:
        """For each query the largest ratio with a token that is worth it; those that can reach most come first, until none can reach more."""
        if not self.tokens:
            return [0.0] * len(queries)
        step = max(1, PAIRS // len(self.tokens))
        return [x for at in range(0, len(queries), step) for x in self._bests(queries[at : at + step])]

    def _bests(self, queries: list[str]) -> list[float]:
        sizes = np.array([len(a) for a in queries], int)
        bound = 2.0 * self.shared(letters(queries, sizes)) / np.maximum(self.sizes + sizes[:, None], 1)
        # see worth: those of other lengths don't count
        bound[np.abs(self.sizes - sizes[:, None]) > np.maximum(2, sizes // 2)[:, None]] = 0.0
        order = np.argsort(-bound, axis=1, kind="stable")
        out = []
        for a, row, reach in zip(queries, order.tolist(), np.take_along_axis(bound, order, 1).tolist()):
            best = 0.0
            for j, most in zip(row, reach):
                if most <= best:
                    break
                if worth(a, self.tokens[j]):
                    best = max(best, ratio(a, self.tokens[j]))
            out.append(best)
        return out

    def best(self, a: str) -> float:
        return self.bests([a])[0]


def best_similarity(a: str, tokens: list[str]) -> float:
    return Tokens(tokens).best(a) if tokens else 0.0


@F.pandas_udf(ArrayType(DoubleType()))
def best_similarities(query: pd.Series, doc: pd.Series) -> pd.Series:
    """Per query token the best similarity among the document's tokens; an equal token is 1."""

    def one(q, d) -> list[float]:
        have = set(d)
        others = [a for a in q if a not in have]
        found = iter(Tokens(list(d)).bests(others)) if others else iter(())
        return [1.0 if a in have else next(found) for a in q]

    return pd.Series([one(q, d) for q, d in zip(query, doc)])


def fuzzy_scores(samples: DataFrame, candidates: DataFrame, least: int = 3, focused: bool = False, plain: bool = False) -> DataFrame:
    """sample_id, pos, score from the shares of exact (0.999) and near (0.84) tokens and the mean similarity; 0 where either side has no token."""
    c = T.none_if_null(F.col("comment"))
    query = samples.select("sample_id", comment_tokens(c, least).alias("q"), comment_tokens(c, least, True).alias("f"), T.any_needle(F.lower(c), words.TYPO_OR_NAMING).alias("typo"))
    docs = candidates.select("sample_id", "pos", candidate_tokens(T.none_if_null(F.col("text")), least, plain).alias("d"))
    x = docs.join(query, "sample_id").withColumn("best", best_similarities("q", "d"))
    if focused:
        x = x.withColumn("fbest", best_similarities("f", "d"))

    def mixed(best: str, exact, near, mean) -> Column:
        n = F.greatest(F.size(best), F.lit(1))
        share = lambda t: F.size(F.filter(best, lambda s: s >= t)) / n
        return exact * share(0.999) + near * share(0.84) + mean * F.aggregate(best, F.lit(0.0), lambda a, s: a + s) / n

    score = F.when(F.col("typo"), mixed("best", 0.25, 0.45, 0.30)).otherwise(mixed("best", 0.45, 0.35, 0.20))
    if focused:
        focus = mixed("fbest", 0.25, 0.40, 0.35)
        blended = 0.60 * score + 0.40 * focus
        blended = F.when(F.col("typo"), 0.45 * blended + 0.55 * focus).otherwise(blended)
        score = F.when(F.size("f") > 0, blended).otherwise(score)
    return x.select("sample_id", "pos", F.when((F.size("q") > 0) & (F.size("d") > 0), score).otherwise(0.0).alias("score"))
