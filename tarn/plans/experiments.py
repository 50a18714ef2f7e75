"""Experiments: lexical ranking, the learned ranker with its scores, strict holdout, and intent classification."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from ..operators import bayes, fuzzy, groupwise, lexical, metrics, ranker, semantic, splits
from ..operators import scores as S
from ..sources import files


def lexical_run(samples: DataFrame, candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """sample_id, pos, context_id, is_gold, score of the weighted lexical features."""
    scored = lexical.base_features(samples, candidates).select("sample_id", "pos", lexical.lexical_score(weights).alias("score"))
    return candidates.select("sample_id", "pos", "context_id", "is_gold").join(scored, ["sample_id", "pos"])


def semantic_inputs(samples: DataFrame, candidates: DataFrame, query_mode: str = "normalized", context_mode: str = "full") -> tuple[DataFrame, DataFrame]:
    q = samples.select("sample_id", T.query_text(T.none_if_null(F.col("comment")), query_mode).alias("text"))
    return q, candidates.select("sample_id", "pos", T.context_text(T.none_if_null(F.col("text")), context_mode).alias("text"))


def canonical_features(samples: DataFrame, candidates: DataFrame, train: DataFrame, rank: int = semantic.RANK) -> DataFrame:
    """Base features with the semantic word score, its file mean and the fuzzy score; train(sample_id) is what the vectors are fitted on."""
    base = lexical.base_features(samples, candidates)
    own_s, own_c = samples.join(train, "sample_id", "left_semi"), candidates.join(train, "sample_id", "left_semi")
    model = semantic.fit(semantic.corpus(own_s, own_c), rank=rank)
    sem = semantic.score(*semantic_inputs(samples, candidates), model)
    with_path = sem.join(candidates.select("sample_id", "pos", "path"), ["sample_id", "pos"])
    means = S.file_prior(with_path, "mean").select("sample_id", "pos", F.col("score").alias("semantic_file_score"))
    fuzz = fuzzy.fuzzy_scores(samples, candidates, 2, plain=True).select("sample_id", "pos", F.col("score").alias("fuzzy_comment_score"))
    out = base.join(sem.select("sample_id", "pos", F.col("score").alias("semantic_score")), ["sample_id", "pos"]).join(means, ["sample_id", "pos"]).join(fuzz, ["sample_id", "pos"])
    return out.join(candidates.select("sample_id", "pos", "context_id", "path", F.col("is_gold").cast("int").alias("label")), ["sample_id", "pos"])


EXTERNAL = ("semantic_score", "semantic_file_score", "fuzzy_comment_score")
CANONICAL = "raw_plus_relative_plus_context_slices_plus_file_context"


def train_ranker(features: DataFrame, split: DataFrame, names: tuple[str, ...] = words.BASE_FEATURES + EXTERNAL, transform: str = CANONICAL, c_values: tuple[float, ...] = ranker.C_VALUES) -> tuple[dict, DataFrame]:
    """The selected model, and sample_id, pos, score of all rows; split: sample_id, split (train, dev or test)."""
    matrix = groupwise.feature_matrix(features, list(names), transform).join(features.select("sample_id", "pos", "label"), ["sample_id", "pos"]).join(split, "sample_id").cache()
    columns = groupwise.column_names(list(names), transform)
    model = ranker.select(matrix.where("split = 'train'"), matrix.where("split = 'dev'"), columns, c_values)
    return model, matrix.select("sample_id", "pos", ranker.linear_score(model).alias("score"))


def holdout(features: DataFrame, samples: DataFrame, column: str, target: str, **options) -> dict:
    """Metrics on the test samples of one target of a ranker that never saw it. samples: sample_id, split and the column."""
    inside = F.col(column).eqNullSafe(F.lit(target))
    use = samples.where(F.when(F.col("split") == "test", inside).otherwise(~inside)).select("sample_id", "split")
    model, scored = train_ranker(features.join(use.select("sample_id"), "sample_id", "left_semi"), use, **options)
    test = scored.join(use.where("split = 'test'").select("sample_id"), "sample_id", "left_semi").join(features.select("sample_id", "pos", (F.col("label") > 0).alias("is_gold")), ["sample_id", "pos"])
    return metrics.summary(metrics.outcomes(test)).first().asDict() | {"target": target, "C": model["C"]}


MODES = ("none", "full", "random", "retrieved")


def intent_texts(samples: DataFrame, candidates: DataFrame, mode: str, top_k: int = 1, seed: int = 42) -> DataFrame:
    """sample_id, text for a classifier: the comment with no candidate, all, top_k in a hashed order (random) or the top_k by score (retrieved)."""
    none = F.lit("")
    if mode == "none":
        joined = samples.select("sample_id", none.alias("more"))
    elif mode in MODES:
        rows = candidates.withColumn("k", F.col("pos"))
        if mode == "random":
            rows = candidates.withColumn("k", F.row_number().over(groupwise.pool().orderBy(splits.draw(seed, "sample_id", "context_id"), "pos"))).where(F.col("k") <= top_k)
        elif mode == "retrieved":
            rows = candidates.withColumn("k", groupwise.rank(F.col("score"))).where(F.col("k") <= top_k)
        joined = rows.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda r: r["text"]), "\n").alias("more"))
    else:
        raise ValueError(f"Unsupported context mode: {mode}")
    text = F.concat(F.lit("comment: "), T.none_if_null(F.col("comment")), F.lit("\ncontext: "), F.coalesce("more", none))
    return samples.join(joined, "sample_id", "left").select("sample_id", T.strip(text).alias("text"))


def intent_run(rows: DataFrame) -> DataFrame:
    """accuracy, macro_f1, weighted_f1 on the rows of split test of naive Bayes trained on the others. rows: row_id, text, label, split."""
    model = bayes.fit(rows.where("split <> 'test'"))
    pred = bayes.predict(rows.where("split = 'test'").select("row_id", "text"), model)
    return metrics.classification(rows.select("row_id", F.col("label").alias("gold")).join(pred, "row_id"))


def best_mode(rows_by_mode: dict[str, DataFrame]) -> tuple[str, dict]:
    """The mode with the best macro F1, and its metrics; the first one wins ties. Each mode's rows have a split test to judge by."""
    best = None
    for mode, rows in rows_by_mode.items():
        got = intent_run(rows).first().asDict()
        if best is None or got["macro_f1"] > best[1]["macro_f1"]:
            best = (mode, got)
    return best


def refit_holdout(samples: DataFrame, candidates: DataFrame, column: str, target: str, **options) -> dict:
    """holdout with all that is learned fitted without the target: vectors and ranker see the other values' training samples only.

    samples: sample_id, comment, split and the column; candidates as everywhere."""
    inside = F.col(column).eqNullSafe(F.lit(target))
    train = samples.where((F.col("split") == "train") & ~inside).select("sample_id")
    use = samples.where(F.when(F.col("split") == "test", inside).otherwise(~inside)).select("sample_id")
    own_s, own_c = samples.join(use, "sample_id", "left_semi"), candidates.join(use, "sample_id", "left_semi")
    return holdout(canonical_features(own_s, own_c, train), samples, column, target, **options)


def uses(column: Column, targets: list[str]) -> Column:
    """The holdouts (numbers of targets) that use a sample: its target's for testing, all others for training and dev."""
    inside = [column.eqNullSafe(F.lit(v)) for v in targets]
    used = F.array(*[F.when(F.when(F.col("split") == "test", own).otherwise(~own), F.lit(i)) for i, own in enumerate(inside)])
    return F.filter(used, lambda t: t.isNotNull())


def dataset_uses(samples: DataFrame, column: str, targets: list[str]) -> DataFrame:
    """sample_id, split, fold, target: a row for each holdout that uses a sample."""
    return samples.select("sample_id", "split", "fold", F.explode(uses(F.col(column), targets)).alias("target"))


def nested_holdout(
    features: DataFrame, samples: DataFrame, column: str, targets: list[str], folds: int, anchor_names: tuple[str, ...], names: tuple[str, ...],
    transform: str = CANONICAL, c_values: tuple[float, ...] = ranker.C_VALUES, k: int = 3, per_target: Callable[[str], DataFrame] | None = None,
) -> dict:
    """Holdouts of all targets at once, each a ranker with the score of another one, the anchor, as a feature.

    For each target, training and dev are the other values' samples, and test its own. The anchor's C is picked on dev. Its training scores
    are out of fold: a fold's samples get those of an anchor that did not see the fold; dev and test get those of the anchor of all folds.
    All anchors are fitted in one go, then all inner ones, then all final rankers: the number of passes doesn't grow with targets and folds.

    features: sample_id, pos, path, label and the names; samples: sample_id, split, fold (0 to folds - 1, groups kept together) and the
    column; per_target gives sample_id, pos and further features of one target's holdout, such as scores of vectors fitted without it.
    Gives anchor (target, sample_id, pos, split, fold, score), scores (of the test samples), summary (target, n, hit_1, hit_k,
    mrr, mrr_k) and models and anchors, one per target.
    """
    n = len(targets)

    def matrix(rows: DataFrame, used: tuple[str, ...]) -> DataFrame:
        """The rows with the matrix's columns in place of those that it was made of."""
        if not groupwise.TRANSFORMS[transform]:
            return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used})
        made = groupwise.feature_matrix(rows, list(used), transform)
        return made.join(rows.drop(*[c for c in made.columns if c not in ("sample_id", "pos")]), ["sample_id", "pos"])

    def dealt(rows: DataFrame) -> DataFrame:
        """A row for each holdout, each with pools of its own."""
        return rows.withColumn("of", F.col("sample_id")).withColumn("sample_id", F.concat_ws("|", F.col("target").cast("string"), "of"))

    def selected(train: DataFrame, dev: DataFrame, used: tuple[str, ...], fit: Callable[[float, int], ranker.Fit], cached: bool, each: int = 0) -> list[dict]:
        fits = [fit(c, t) for t in range(n) for c in c_values]
        models = ranker.fit_many(train, groupwise.column_names(list(used), transform), fits, cached=cached, each=each)
        of = [t for t in range(n) for _ in c_values]
        found = ranker.dev_metrics(dev, models, [F.col("target") == t for t in of], k)
        none = {"hit_1": 0.0, "mrr": 0.0}
        return [models[ranker.best_of([(i, found.get(i, none)) for i in range(len(fits)) if of[i] == t])] for t in range(n)]

    # the rows that all passes read are kept once, where they are the same in every holdout; no score is joined back to them
    if per_target is None:
        value = F.col(column)
        place = F.coalesce(*[F.when(value.eqNullSafe(F.lit(v)), F.lit(i)) for i, v in enumerate(targets)], F.lit(-1))
        own = features.join(samples.select("sample_id", "split", "fold", value.alias("holdout_value"), place.alias("holdout")), "sample_id")
        kept = matrix(own, anchor_names).persist()
        m = dealt(kept.withColumn("target", F.explode(uses(F.col("holdout_value"), targets))).drop("holdout_value", "holdout"))
        # a training row is the same for all anchors but its own value's, so it is read once for all of them
        train, fit = kept.where("split = 'train'"), lambda c, t, f=None: ranker.Fit(c, fold=f, without=t)
    else:
        parts = [per_target(v).withColumn("target", F.lit(i)) for i, v in enumerate(targets)]
        own = features.join(dataset_uses(samples, column, targets), "sample_id").join(reduce(DataFrame.unionByName, parts), ["target", "sample_id", "pos"])
        m = matrix(dealt(own), anchor_names).persist()
        train, fit = m.where("split = 'train'"), lambda c, t, f=None: ranker.Fit(c, t, f)
    outer = selected(train, m.where("split = 'dev'"), anchor_names, fit, True)
    fits = [fit(outer[t]["C"], t, f) for t in range(n) for f in range(folds)]
    inner = ranker.fit_many(train, outer[0]["feature_names"], fits, cached=True)
    at = F.col("target")
    which = F.when(F.col("split") == "train", n + at * folds + F.col("fold")).otherwise(at)
    anchor = m.withColumn("anchor_score", ranker.score_by(outer + inner, which))
    final = matrix(anchor, (*names, "anchor_score"))
    if per_target is None and not groupwise.TRANSFORMS[transform]:
        # no feature needs the holdout's pools: a training row carries its anchor score for each target, and is read once for all of them
        scores = F.array(*[ranker.score_by(outer + inner, F.lit(n + t * folds) + F.col("fold")) for t in range(n)])
        train, fit, each = matrix(train.withColumn("anchor_score", scores), names), (lambda c, t: ranker.Fit(c, without=t)), n
    else:
        train, fit, each = final.where("split = 'train'"), ranker.Fit, 0
    models = selected(train, final.where("split = 'dev'"), (*names, "anchor_score"), fit, each > 0, each)
    test = ranker.scored(final.where("split = 'test'"), models, [at == t for t in range(n)], ["target", "of", "sample_id", "pos", "label"])
    value = F.element_at(F.array(*map(F.lit, targets)), at + 1).alias("target")
    judged = test.select(value, F.col("of").alias("sample_id"), "pos", "score", (F.col("label") > 0).alias("is_gold"))
    summary = metrics.summary(metrics.outcomes(judged, k, ("target",)), ("target",))
    named = anchor.select(value, F.col("of").alias("sample_id"), "pos", "split", "fold", F.col("anchor_score").alias("score"))
    return {"anchor": named, "scores": judged, "summary": summary, "models": dict(zip(targets, models)), "anchors": dict(zip(targets, outer))}


def anchor_coverage(anchor: DataFrame, candidates: DataFrame, samples: DataFrame, column: str, targets: list[str]) -> DataFrame:
    """target, split, samples, candidates, missing, repeated: whether every candidate that a holdout uses has exactly one anchor score.

    A holdout's pool is one row with its positions, on either side, so no row of a candidate is dealt out for each holdout. Scores of
    candidates that the holdout doesn't use are in rows without a split. (sample_id, pos) is unique in candidates."""
    value = F.element_at(F.array(*map(F.lit, targets)), F.col("target") + 1).alias("target")
    pos = F.col("pos").cast("long")
    pools = candidates.where("pos is not null").groupBy("sample_id").agg(F.collect_list(pos).alias("due"))
    due = pools.join(dataset_uses(samples, column, targets), "sample_id").select(value, "split", "sample_id", "due")
    got = anchor.where("pos is not null").groupBy("target", "sample_id").agg(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), pos))).alias("got"), F.collect_list(F.when(F.col("score").isNull(), pos)).alias("without"))
    none = F.array().cast("array<bigint>")
    both = due.join(got, ["target", "sample_id"], "full").select("target", "split", "sample_id", *[F.coalesce(c, none).alias(c) for c in ("due", "got", "without")])
    twice = F.filter("got", lambda x, i: (i > 0) & (F.get("got", i - 1) == x))
    more = both.withColumns({"twice": twice, "extra": F.array_except(F.concat("got", "without"), "due")})
    counts = lambda split, places, repeated: F.struct(split.alias("split"), F.size(places).alias("n"), F.size(F.array_except(places, "got")).alias("missing"), repeated.alias("repeated"))
    own = counts(F.col("split"), F.col("due"), F.size(F.array_intersect("due", "twice")))
    other = counts(F.lit(None).cast("string"), F.col("extra"), F.size("extra"))
    rows = more.select("target", "sample_id", F.explode(F.filter(F.array(own, other), lambda x: x["n"] > 0)).alias("x")).select("target", "sample_id", "x.*")
    return rows.groupBy("target", "split").agg(F.count_distinct("sample_id").alias("samples"), *[F.sum(c).alias(d) for c, d in (("n", "candidates"), ("missing", "missing"), ("repeated", "repeated"))])


def save_holdout(result: dict, path: str) -> None:
    """scores and anchor in a folder for each target, the summary, and the models as JSON with their target."""
    spark = result["summary"].sparkSession
    for name in ("scores", "anchor"):
        result[name].write.mode("overwrite").partitionBy("target").parquet(f"{path}/{name}")
    result["summary"].write.mode("overwrite").parquet(f"{path}/summary")
    rows = [(t, part, json.dumps(m)) for part in ("models", "anchors") for t, m in result[part].items()]
    spark.createDataFrame(rows, "target string, part string, model string").write.mode("overwrite").parquet(f"{path}/models")


def out_of_fold_semantic(samples: DataFrame, candidates: DataFrame, folds: int) -> DataFrame:
    """sample_id, pos, score: every sample's semantic scores from vectors of the other folds. samples has the column fold."""
    out = None
    for f in range(folds):
        rest, part = samples.where(F.col("fold") != f), samples.where(F.col("fold") == f)
        model = semantic.fit(semantic.corpus(rest, candidates.join(rest.select("sample_id"), "sample_id", "left_semi")))
        got = semantic.score(*semantic_inputs(part, candidates.join(part.select("sample_id"), "sample_id", "left_semi")), model).select("sample_id", "pos", "score")
        out = got if out is None else out.unionByName(got)
    return out


def feature_subsets(names: list[str], low: int, high: int, must: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """All subsets of the names, sorted, of low to high members, that hold the names in must."""
    if unknown := set(must) - set(names):
        raise KeyError(f"unknown features: {sorted(unknown)}")
    sizes = range(low, min(high, len(names)) + 1)
    return [c for n in sizes for c in combinations(sorted(names), n) if set(must) <= set(c)]


def subset_search(features: DataFrame, split: DataFrame, base: tuple[str, ...], subsets: list[tuple[str, ...]], path: str, **options) -> DataFrame:
    """name, metrics: the ranker of the base features with each subset, by its dev metrics. Each result is appended as soon as
    it is there, and what an earlier run has written is not computed again."""
    spark = features.sparkSession
    done = files.finished(spark, path)
    for s in subsets:
        name = "+".join(s) or "base"
        if name not in done:
            model, _ = train_ranker(features, split, (*base, *s), **options)
            files.append_result(spark, path, name, {k: v for k, v in model["dev_metrics"].items() if isinstance(v, (int, float))})
    return spark.read.parquet(path)
