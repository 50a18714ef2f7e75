"""Descriptions of samples, and learned choices between rankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from . import groupwise as G
from . import metrics as M
from . import ranker

THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def slice_columns(comment: Column, contexts: Column) -> dict[str, Column]:
    """The axes by which results are cut."""
    n = F.size(T.split_words(comment))
    return {
        "code_fence": comment.contains("```"),
        "suggestion": F.lower(comment).contains("suggestion"),
        "mention": comment.contains("@"),
        "quoted_span": F.size(T.quoted_spans(comment)) > 0,
        "short_comment": n <= 6,
        "long_comment": n >= 30,
        "context_bucket": G.context_bucket(contexts),
    }


def sample_meta(comment: Column, contexts: Column) -> dict[str, Column]:
    """Twenty numbers that describe a sample to a router."""
    bucket, s, low = G.context_bucket(contexts), slice_columns(comment, contexts), F.lower(comment)
    out = {f"context_bucket_{name}": bucket == b for name, b in (("<=10", "<=10"), ("11_20", "11-20"), ("21_40", "21-40"), ("gt40", ">40"))}
    out |= {k: s[k] for k in ("code_fence", "suggestion", "mention", "quoted_span", "short_comment", "long_comment")}
    out |= {"question": comment.contains("?")} | {k: T.any_needle(low, needles) for k, needles in words.META_FLAGS}
    return {k: v.cast("double") for k, v in out.items()} | {"word_count": F.size(T.split_words(comment)).cast("double"), "context_count": contexts.cast("double")}


def described(samples: DataFrame, candidates: DataFrame) -> DataFrame:
    """sample_id and the columns of sample_meta."""
    n = candidates.groupBy("sample_id").agg(F.count("*").alias("contexts"))
    x = samples.join(n, "sample_id")
    return x.select("sample_id", *[c.alias(k) for k, c in sample_meta(T.none_if_null(F.col("comment")), F.col("contexts")).items()])


def router_rows(meta: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[str]]:
    """sample_id, features of both rankers' leads, label: whether b's best candidate is gold and a's is not."""
    leads = meta
    for s in "ab":
        t = G.top_stats(pairs.select("sample_id", "pos", "context_id", F.col(s).alias("score")))
        leads = leads.join(t.select("sample_id", *[F.col(c).alias(f"{s}_{c}") for c in ("top_id", "top", "second", "margin")]), "sample_id")
    hits = pairs.where("is_gold").select("sample_id", "context_id")
    gold = hits.groupBy("sample_id").agg(F.collect_set("context_id").alias("gold"))
    x = leads.join(gold, "sample_id", "left")
    hit = lambda s: F.coalesce(F.array_contains("gold", F.col(f"{s}_top_id")), F.lit(False))
    names = [c for c in meta.columns if c != "sample_id"] + [f"{s}_{c}" for s in "ab" for c in ("top", "second", "margin")] + ["same_top"]
    x = x.withColumn("same_top", (F.col("a_top_id") == F.col("b_top_id")).cast("double")).withColumn("label", (hit("b") & ~hit("a")).cast("int"))
    return x.select("sample_id", "label", *names), names


def score_router(train_meta: DataFrame, train_pairs: DataFrame, dev_meta: DataFrame, dev_pairs: DataFrame, c: float = 0.25, k: int = 3) -> tuple[dict, DataFrame]:
    """A model of when b beats a, and threshold, n, hit_1, ... of routing the dev samples by its probability."""
    rows, names = router_rows(train_meta, train_pairs)
    model = ranker.fit(rows, names, c)
    dev, _ = router_rows(dev_meta, dev_pairs)
    p = dev.select("sample_id", (1 / (1 + F.exp(-ranker.linear_score(model)))).alias("p"))
    points = [F.struct(F.lit(t).alias("threshold"), F.when(F.col("p") >= t, F.col("b")).otherwise(F.col("a")).alias("score")) for t in THRESHOLDS]
    scored = dev_pairs.join(p, "sample_id").select("sample_id", "pos", "is_gold", F.explode(F.array(*points)).alias("g")).select("sample_id", "pos", "is_gold", "g.*")
    return model, M.summary(M.outcomes(scored, k, ("threshold",)), ("threshold",))


def best_models(scores: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """sample_id, best: the ranker with the best outcome (top 1, then reciprocal rank, then top k); the first in order wins ties.

    scores: model, sample_id, pos, score, is_gold."""
    place = F.element_at(F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))]), F.col("model"))
    o = M.outcomes(scores, k, ("model",)).withColumn("place", place)
    return o.groupBy("sample_id").agg(F.max(F.struct("hit_1", "rr", "hit_k", (-F.col("place")).alias("p"), "model")).alias("b")).select("sample_id", F.col("b.model").alias("best"))


def chosen(scores: DataFrame, choice: DataFrame) -> DataFrame:
    """The rows of scores (model, sample_id, ...) of each sample's chosen ranker (sample_id, model)."""
    return scores.join(choice, ["sample_id", "model"])


def rules(slices: dict[str, Column]) -> dict[str, Column]:
    """The 17 fixed rules for a second ranker: never, each flag set or not, each size of pool."""
    out = {"always_a": F.lit(False)}
    for flag in ("code_fence", "suggestion", "mention", "quoted_span", "short_comment", "long_comment"):
        out |= {f"route_b_if_{flag}_yes": slices[flag], f"route_b_if_{flag}_no": ~slices[flag]}
    names = {"<=10": "le=10", "11-20": "11_20", "21-40": "21_40", ">40": "gt40"}
    return out | {f"route_b_if_context_bucket_{name}": slices["context_bucket"] == b for b, name in names.items()}


def tag_rules(samples: DataFrame, column: str) -> DataFrame:
    """rule, sample_id: one rule for each distinct value of an array column, with the samples that it routes."""
    return samples.select(F.explode(F.array_distinct(column)).alias("rule"), "sample_id")


def model_features(scores: DataFrame, models: list[str]) -> DataFrame:
    """sample_id and, per ranker, its best score and margin, and for each ordered pair of two the differences of both and
    whether they agree on the best candidate. scores: model, sample_id, pos, context_id, score."""
    ranked = M.ranked_by(scores.where(F.col("model").isin(*models)), ("model",)).where("rank <= 2")
    each = ranked.groupBy("model", "sample_id").agg(*G.lead_columns(F.col("rank"))).select("sample_id", "model", F.struct("top_id", "top", G.margin("zero").alias("margin")).alias("lead"))
    leads = each.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "lead"))).alias("leads"))
    return leads.where(all_led(models)).select("sample_id", *lead_features(models))


def all_led(models: list[str]) -> Column:
    """Whether leads holds every ranker."""
    return F.forall(F.array(*map(F.lit, models)), lambda m: F.array_contains(F.map_keys("leads"), m))


def lead_features(models: list[str]) -> list[Column]:
    """The columns of model_features out of leads, a map from ranker to struct<top_id, top, margin>."""
    lead = lambda m, v: F.col("leads")[m][{"top1_score": "top"}.get(v, v)]
    pairs = []
    for a in models:
        for b in models:
            if a != b:
                pairs += [(lead(a, v) - lead(b, v)).alias(f"{a}_minus_{b}_{v}") for v in ("top1_score", "margin")]
                pairs.append((lead(a, "top_id") == lead(b, "top_id")).cast("double").alias(f"{a}_same_top1_as_{b}"))
    return [*[lead(m, v).alias(f"{m}_{v}") for m in models for v in ("top1_score", "margin")], *pairs]


def sample_router(pairs: DataFrame, norms: tuple[str, ...], conditions: dict[str, Column], thresholds: tuple[float, ...], k: int = 3, digits: int | None = None) -> DataFrame:
    """norm, condition, threshold, n, hit_1, ...: ranker b where the condition holds and its margin exceeds a's by the threshold at least."""
    from . import scores as S

    out = None
    for norm in norms:
        both = pairs.join(S.margins(pairs, "a", norm), "sample_id").join(S.margins(pairs, "b", norm), "sample_id")
        gain = F.col("margin_b") - F.col("margin_a")
        gain = gain if digits is None else F.round(gain, digits)
        points = [F.struct(F.lit(norm).alias("norm"), F.lit(c).alias("condition"), F.lit(float(t)).alias("threshold"), F.when(use & (gain >= t), F.col("b")).otherwise(F.col("a")).alias("score")) for c, use in conditions.items() for t in thresholds]
        rows = both.select("sample_id", "pos", "is_gold", F.explode(F.array(*points)).alias("g")).select("sample_id", "pos", "is_gold", "g.*")
        out = rows if out is None else out.unionByName(rows)
    by = ("norm", "condition", "threshold")
    return M.summary(M.outcomes(out, k, by), by)
