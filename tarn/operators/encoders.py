"""Encoders as plug-ins: any function from texts to vectors, run once per distinct text, with its vectors kept by the text's digest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import semantic

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dims: int = 64) -> Encoder:
    """The given example: each word adds 1 or -1 at a place, both named by its MD5."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in re.findall("[A-Za-z0-9_]+", t):
                digest = hashlib.md5(w.lower().encode()).hexdigest()
                out[i, int(digest[:8], 16) % dims] += 1 if digest[8] < "8" else -1
        return out

    return encode


def encoded(texts: DataFrame, load: Callable[[], Encoder], batch: int = 256) -> DataFrame:
    """h (SHA-256), v (unit vector; zeros stay) of the distinct texts(text); a null text is left out.

    load() gives the encoder and is called once a task; let it keep large weights in its module, and a worker loads them once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for f in frames:
            encode = encode or load()
            for at in range(0, len(f), batch):
                part = f[at : at + batch]
                v = np.asarray(encode(part["text"].tolist()), float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"h": part["h"].to_numpy(), "v": list(v / np.where(norm > 1e-12, norm, 1.0))})

    own = texts.where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"))
    return own.mapInPandas(run, "h string, v array<double>")


def encode_into(texts: DataFrame, load: Callable[[], Encoder], path: str, batch: int = 256) -> DataFrame:
    """h, v of a table at path, which first gets the texts that it doesn't have. One encoder, one path."""
    spark = texts.sparkSession
    try:
        known = spark.read.parquet(path).select("h")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    new = texts if known is None else texts.withColumn("h", F.sha2("text", 256)).join(known, "h", "left_anti")
    encoded(new.select("text"), load, batch).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def scores(queries: DataFrame, candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """sample_id, pos, score: cosine of query and candidate text (columns text) by vectors(h, v); 0 where one has no vector."""
    q = queries.select("sample_id", F.sha2("text", 256).alias("qh"))
    c = candidates.select("sample_id", "pos", F.sha2("text", 256).alias("ch"))
    x = c.join(q, "sample_id").join(vectors.select(F.col("h").alias("qh"), F.col("v").alias("qv")), "qh", "left").join(vectors.select(F.col("h").alias("ch"), F.col("v").alias("cv")), "ch", "left")
    return x.select("sample_id", "pos", F.coalesce(semantic.dot("qv", "cv"), F.lit(0.0)).alias("score"))
