"""Multinomial naive Bayes as term tables. Unseen tokens count with add-one smoothing; equal scores go to the first label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


@dataclass
class Model:
    labels: DataFrame  # label, docs, tokens, prior, vocabulary
    terms: DataFrame  # label, token, n


def fit(rows: DataFrame) -> Model:
    """From rows (text, label)."""
    docs = rows.groupBy("label").agg(F.count("*").alias("docs"))
    terms = rows.select("label", F.explode(T.tokenize(T.none_if_null(F.col("text")))).alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))
    tokens = terms.groupBy("label").agg(F.sum("n").alias("tokens"))
    vocabulary = terms.agg(F.greatest(F.count_distinct("token"), F.lit(1)).alias("vocabulary"))
    labels = docs.join(tokens, "label", "left").crossJoin(F.broadcast(vocabulary))
    prior = F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy()))
    return Model(labels.select("label", "docs", F.coalesce("tokens", F.lit(0)).alias("tokens"), "vocabulary", prior.alias("prior")), terms)


def predict(rows: DataFrame, model: Model, key: str = "row_id") -> DataFrame:
    """key, pred, score of rows (key, text). The table of labels is small: one row for each."""
    tokens = rows.select(key, F.explode(T.tokenize(T.none_if_null(F.col("text")))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("f"))
    seen = tokens.join(model.terms, "token").join(F.broadcast(model.labels.select("label", "tokens", "vocabulary")), "label")
    total = F.col("tokens") + F.col("vocabulary")
    # a token's part is that of an unseen one, and for the label's own terms the difference to it
    gain = seen.groupBy(key, "label").agg(F.sum(F.col("f") * (F.log((F.col("n") + 1) / total) - F.log(1 / total))).alias("gain"))
    length = tokens.groupBy(key).agg(F.sum("f").alias("f"))
    each = rows.select(key).join(length, key, "left").crossJoin(F.broadcast(model.labels)).join(gain, [key, "label"], "left")
    score = F.col("prior") + F.coalesce("f", F.lit(0)) * F.log(1 / total) + F.coalesce("gain", F.lit(0.0))
    best = each.groupBy(key).agg(F.min(F.struct((-score).alias("s"), F.col("label"))).alias("b"))
    return best.select(key, F.col("b.label").alias("pred"), (-F.col("b.s")).alias("score"))
