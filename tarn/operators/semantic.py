"""Semantic scores: TF-IDF with a truncated SVD, dense vectors, and pseudo-relevance feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import words
from . import lexical
from . import scores as S

#: Tasks of a pass over the weights: each gives a vector for every term, so their number may not grow with the texts.
PASSES = 16
#: Texts whose vectors are in memory together.
ENCODED = 1000
MAX_FEATURES, MIN_DF, MAX_DF, RANK = 40_000, 2, 0.98, 128


def corpus(samples: DataFrame, candidates: DataFrame, query_mode: str = "normalized", context_mode: str = "full") -> DataFrame:
    """text: the distinct query and candidate texts."""
    q = samples.select(T.query_text(T.none_if_null(F.col("comment")), query_mode).alias("text"))
    return q.unionByName(candidates.select(T.context_text(T.none_if_null(F.col("text")), context_mode).alias("text"))).distinct()


def counted(texts: pa.RecordBatch, analyzer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """text, term, tf, terms: how often each term is in each text, by text; text and term are numbers of rows and of `terms`. texts: parts (see lexical.parts)."""
    parts = texts["parts"]
    if analyzer == "char_wb":
        parts = pa.array([list(lexical.terms_of(x, analyzer).elements()) for x in parts.to_pylist()], pa.list_(pa.string()))
    flat = parts.flatten().dictionary_encode()
    lengths = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    terms = max(len(flat.dictionary), 1)
    key, tf = np.unique(np.repeat(np.arange(len(parts)), lengths) * terms + flat.indices.to_numpy().astype(np.int64), return_counts=True)
    return key // terms, key % terms, tf, flat.dictionary


def with_parts(texts: DataFrame, analyzer: str, *keys: str | Column) -> DataFrame:
    return texts.where("text is not null").select(*keys, lexical.parts(F.col("text"), analyzer).alias("parts"))


def frequencies(texts: DataFrame, analyzer: str) -> DataFrame:
    """term, df, tf: texts that have the term, and how often they do; a batch of texts gives a row for each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, term, tf, terms = counted(batch, analyzer)
            sums = np.bincount(term, tf, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(term, minlength=len(terms))), pa.array(sums)], ["term", "df", "tf"])

    return with_parts(texts, analyzer).mapInArrow(run, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


@dataclass
class Terms:
    """A vocabulary as tasks hold it, by number of the term."""

    terms: pa.Array
    idf: np.ndarray
    vectors: np.ndarray | None = None


@dataclass
class Model:
    vocabulary: DataFrame  # term, idf, vector
    analyzer: str

    def terms(self) -> Terms:
        rows = self.vocabulary.select("term", "idf", "v").toArrow().combine_chunks()
        vectors = pc.list_flatten(rows["v"]).to_numpy().reshape(rows.num_rows, -1)
        return Terms(pa.array(rows["term"].to_pylist(), pa.string()), rows["idf"].to_numpy(), vectors)


def weights_of(batch: pa.RecordBatch, analyzer: str, known: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, i, w of the known terms, by text: (1 + log tf) * idf, each text of length 1."""
    text, term, tf, terms = counted(batch, analyzer)
    place = pc.fill_null(pc.index_in(terms, value_set=known.terms), -1).to_numpy().astype(np.int64)
    i = place[term]
    text, i, tf = text[i >= 0], i[i >= 0], tf[i >= 0]
    w = (1 + np.log(tf)) * known.idf[i]
    norm = np.sqrt(np.bincount(text, w * w, batch.num_rows))
    return text, i, w / norm[text]


def fit(texts: DataFrame, analyzer: str = "word", rank: int = RANK, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF, seed: int = 42, rounds: int = 6) -> Model:
    """Terms by document frequency, with sublinear weights, and their vectors in the space of the largest singular values.

    The subspace is found by orthogonal iteration: the texts are dealt out once, to PASSES tasks, which keep their weights, and each round is one pass
    in which a partition multiplies by its part of the weights and their transpose. The vocabulary and the terms' vectors, at most
    max_features of them, are broadcast, and orthogonalized on the driver. A text's terms never leave its task but to be counted.
    """
    spark = texts.sparkSession
    own = texts.distinct().cache()
    n = own.count()
    df = frequencies(own, analyzer).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    vocab = df.orderBy(F.col("tf").desc(), "term").limit(max_features).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).orderBy("term").toPandas()
    if len(vocab) < 2:
        own.unpersist()
        raise ValueError("fewer than two terms are left")
    k = min(rank, len(vocab) - 1)
    shared = spark.sparkContext.broadcast(Terms(pa.array(vocab["term"], pa.string()), vocab["idf"].to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            text, i, w = weights_of(batch, analyzer, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(seen + text), pa.array(i.astype(np.int32)), pa.array(w)], ["h", "i", "w"])
            seen += batch.num_rows

    # parts are made behind the shuffle, which moves texts alone; h is the text's number in its task
    weights = with_parts(own.repartition(PASSES, F.xxhash64("text")), analyzer).mapInArrow(weigh, "h long, i int, w double").cache()
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(vocab), k)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(gram_times(weights, basis))[0]
    weights.unpersist()
    own.unpersist()
    vectors = pa.ListArray.from_arrays(np.arange(0, basis.size + 1, k, dtype=np.int32), basis.ravel())
    rows = pa.table({"term": pa.array(vocab["term"], pa.string()), "idf": vocab["idf"].to_numpy(), "v": vectors})
    return Model(spark.createDataFrame(rows, "term string, idf double, v array<double>"), analyzer)


def gram_times(weights: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The weights' transpose times the weights times the basis; rows (h, i, w), with all of a text's behind one another in one partition.

    A partition holds no more than a vector for each term, and a batch of rows; a text's vectors are few enough for a core's cache."""
    shared = weights.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, held = shared.value, None
        total = np.zeros_like(basis)

        def add_text(i: np.ndarray, w: np.ndarray) -> None:
            total[i] += w[:, None] * (w @ basis[i])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, i, w = (batch[c].to_numpy(zero_copy_only=False) for c in ("h", "i", "w"))
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            bounds = [0, *ends.tolist(), len(h)]
            # the last text may go on in the next batch
            for a, z in zip(bounds, bounds[1:]):
                if held is not None and a == 0 and held[0] == h[0]:
                    own = h[0], np.concatenate([held[1], i[:z]]), np.concatenate([held[2], w[:z]])
                else:
                    if held is not None:
                        add_text(*held[1:])
                    own = h[a], i[a:z], w[a:z]
                held = own
        if held is not None:
            add_text(*held[1:])
            terms = np.flatnonzero(total.any(axis=1))
            for at in range(0, len(terms), 1000):
                some = terms[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x.tobytes() for x in total[some]], pa.binary())], ["i", "v"])

    def add(frames):
        total: dict[int, np.ndarray] = {}
        for f in frames:
            for i, v in zip(f["i"], f["v"]):
                total[i] = total.get(i, 0) + np.frombuffer(v)
        yield pd.DataFrame({"i": list(total), "v": [x.tobytes() for x in total.values()]}, columns=["i", "v"])

    out = np.zeros_like(basis)
    for r in weights.mapInArrow(run, "i int, v binary").repartition("i").mapInPandas(add, "i int, v binary").collect():
        out[r["i"]] = np.frombuffer(r["v"])
    shared.unpersist()
    return out


def encode(texts: DataFrame, model: Model) -> DataFrame:
    """h, v: unit vectors of texts(text), the digest of each; texts without a known term are not in the result.

    The vocabulary is broadcast; a text's terms and weights stay in its task, and only its vector comes out."""
    shared, analyzer = texts.sparkSession.sparkContext.broadcast(model.terms()), model.analyzer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value.vectors
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODED):
                batch = whole.slice(at, ENCODED)
                text, i, w = weights_of(batch, analyzer, shared.value)
                rows, starts = np.unique(text, return_index=True)
                out = np.zeros((len(rows), vectors.shape[1]))
                for k, (a, z) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(text)])):
                    out[k] = w[a:z] @ vectors[i[a:z]]
                norm = np.sqrt((out * out).sum(axis=1))
                out /= np.where(norm > 1e-12, norm, 1.0)[:, None]
                v = pa.ListArray.from_arrays(np.arange(0, out.size + 1, vectors.shape[1], dtype=np.int32), out.ravel())
                yield pa.RecordBatch.from_arrays([batch["h"].take(pa.array(rows)), v], ["h", "v"])

    return with_parts(texts, analyzer, F.sha2("text", 256).alias("h")).mapInArrow(run, "h string, v array<double>")


def unit(vectors: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("v", F.when(norm > 1e-12, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score(queries: DataFrame, candidates: DataFrame, model: Model) -> DataFrame:
    """sample_id, pos, score: cosine of query and candidate text (columns text); each distinct text is encoded once."""
    q = queries.select("sample_id", F.sha2("text", 256).alias("qh"))
    c = candidates.select("sample_id", "pos", F.sha2("text", 256).alias("ch"))
    vectors = encode(queries.select("text").unionByName(candidates.select("text")).distinct(), model)
    x = c.join(q, "sample_id").join(vectors.select(F.col("h").alias("qh"), F.col("v").alias("qv")), "qh", "left").join(vectors.select(F.col("h").alias("ch"), F.col("v").alias("cv")), "ch", "left")
    return x.select("sample_id", "pos", F.coalesce(dot("qv", "cv"), F.lit(0.0)).alias("score"))


def dense_scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """sample_id, pos, score: cosine of given vectors v of queries and candidates."""
    q = unit(queries.select("sample_id", "v")).withColumnRenamed("v", "qv")
    return unit(candidates.select("sample_id", "pos", "v")).join(q, "sample_id").select("sample_id", "pos", dot("qv", "v").alias("score"))


def feedback_terms(queries: DataFrame, scores: DataFrame, k: int = 1, max_terms: int = 12, max_paths: int = 2, by_file: bool = False) -> DataFrame:
    """sample_id, terms, paths that the k best candidates add to the query.

    queries: sample_id, query (its text). scores: sample_id, pos, path, text, score. A candidate's path gives 8 terms
    of weight 2 and its changed lines 16 of weight 1, divided by its rank; terms of two candidates come first.
    """
    top = S.feedback_contexts(scores, k, by_file).join(queries.select("sample_id", T.filtered_terms(F.col("query")).alias("base")), "sample_id")
    stop = T.literal_list(words.STOP_WORDS + words.CODE_WORDS)
    fit_for = lambda a: F.filter(a, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t) & ~F.array_contains("base", t))
    t = T.none_if_null(F.col("text"))
    changed = T.filtered_terms(F.array_join(F.array_sort(F.array_union(T.added_lines(t), T.removed_lines(t))), " "))
    rows = top.select("sample_id", "rank", F.lower("path").alias("path"), F.slice(fit_for(F.array_distinct(T.path_parts(F.col("path")))), 1, 8).alias("p"), F.slice(fit_for(changed), 1, 16).alias("c"))
    each = rows.select("sample_id", "rank", F.explode(F.concat(F.transform("p", lambda x: F.struct(x.alias("term"), (2.0 / F.col("rank")).alias("w"))), F.transform("c", lambda x: F.struct(x.alias("term"), (1.0 / F.col("rank")).alias("w"))))).alias("x"))
    terms = each.groupBy("sample_id", "x.term").agg(F.sum("x.w").alias("w"), F.count_distinct("rank").alias("docs"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy((F.col("docs") >= 2).desc(), F.col("w").desc(), F.length("term").desc(), F.col("term").desc()))
    best = terms.withColumn("k", place).where(F.col("k") <= max_terms).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda r: r["term"]).alias("terms"))
    paths = rows.where("path <> ''").groupBy("sample_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda r: r["path"])), 1, max_paths).alias("paths"))
    none = F.array().cast("array<string>")
    return queries.select("sample_id").join(best, "sample_id", "left").join(paths, "sample_id", "left").select("sample_id", F.coalesce("terms", none).alias("terms"), F.coalesce("paths", none).alias("paths"))


def feedback_query(queries: DataFrame, added: DataFrame, max_terms: int = 12) -> DataFrame:
    """sample_id, text: the query with feedback terms, paths and the paths' parts."""
    base = T.filtered_terms(F.col("query"))
    stop = T.literal_list(words.STOP_WORDS + words.CODE_WORDS)
    parts = F.filter(F.array_distinct(F.flatten(F.transform("paths", T.path_parts))), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t) & ~F.array_contains(base, t))
    text = F.concat_ws(" ", F.when(F.col("query") != "", F.col("query")), T.labelled("feedback_terms", F.col("terms")), T.labelled("feedback_paths", F.col("paths")), T.labelled("feedback_path_parts", F.slice(parts, 1, max_terms)))
    return queries.join(added, "sample_id").select("sample_id", T.strip(text).alias("text"))


def rescored(first: DataFrame, queries: DataFrame, new: DataFrame, candidates: DataFrame, again: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """sample_id, pos, score, changed: the second pass of feedback, in which only samples whose query changed are scored again.

    first: sample_id, pos, score of queries(sample_id, text); new: the queries behind feedback (see feedback_query); candidates:
    sample_id, pos, text. again(queries, candidates) scores with what the first pass scored with, such as score with its model."""
    now = new.select("sample_id", F.col("text").alias("now"))
    changed = queries.join(now, "sample_id").where(~F.col("text").eqNullSafe(F.col("now"))).select("sample_id", F.col("now").alias("text"))
    own = candidates.join(changed.select("sample_id"), "sample_id", "left_semi")
    second = again(changed, own).select("sample_id", "pos", F.col("score").alias("second"))
    x = first.join(second, ["sample_id", "pos"], "left")
    return x.select("sample_id", "pos", F.coalesce("second", "score").alias("score"), F.col("second").isNotNull().alias("changed"))


def save(model: Model, path: str) -> None:
    """The vocabulary (term, idf, vector) as Parquet, a folder for the analyzer."""
    model.vocabulary.withColumn("analyzer", F.lit(model.analyzer)).write.mode("overwrite").partitionBy("analyzer").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path)
    return Model(rows.drop("analyzer"), rows.select("analyzer").first()["analyzer"])
