"""Lexical scoring inside pools: BM25, TF-IDF cosine, the overlap features and their weighted sum.

Tables: samples(sample_id, comment) and candidates(sample_id, pos, text), with (sample_id, pos) unique. Statistics
such as document frequencies are those of the pool. Only a pool's query terms travel with their pool after the first
join, so the wide token table is never shuffled whole for BM25.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words

KEY = ["sample_id", "pos"]
#: Texts, and characters of them, of a pool whose TF-IDF one row takes; larger pools are dealt to tasks by text and term.
POOL_TEXTS, POOL_CHARS = 256, 1 << 18
#: Pools of an Arrow batch, as each may have so many characters; characters of a task, as its texts are short and their terms are not.
POOLS, TASK_CHARS = 64, 1 << 21


def query_terms(samples: DataFrame) -> DataFrame:
    """sample_id, token, q: how often each retrieval token occurs in the cleaned comment."""
    tokens = T.tokenize_retrieval(T.clean_comment(T.none_if_null(F.col("comment"))))
    return samples.select("sample_id", F.explode(tokens).alias("token")).groupBy("sample_id", "token").agg(F.count("*").alias("q"))


def bm25(samples: DataFrame, candidates: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """sample_id, pos, bm25 of every candidate; 0 where no query token occurs."""
    query = query_terms(samples)
    wanted = query.groupBy("sample_id").agg(F.collect_list("token").alias("wanted"))
    docs = candidates.select(*KEY, T.tokenize_retrieval(T.none_if_null(F.col("text"))).alias("tokens")).join(wanted, "sample_id", "left")
    found = F.filter("tokens", lambda t: F.coalesce(F.array_contains("wanted", t), F.lit(False)))
    # texts are cut into tokens once: all uses below read the same columns, so that they share this exchange
    docs = docs.select(*KEY, F.size("tokens").alias("len"), found.alias("found")).repartition(*KEY)
    pools = docs.groupBy("sample_id").agg(F.count("found").alias("n"), F.avg("len").alias("avg_len"))
    # a candidate without any query token is there with the token ''
    tf = docs.select(*KEY, "len", F.explode_outer("found").alias("t")).select(*KEY, "len", F.coalesce("t", F.lit("")).alias("token"))
    tf = tf.groupBy("sample_id", "pos", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    # counted in a combining aggregate and met in a join that Spark can split, however many candidates of a pool have a token
    df = tf.groupBy("sample_id", "token").agg(F.count("len").alias("df"))
    tf = tf.join(query.join(df, ["sample_id", "token"]), ["sample_id", "token"], "left").join(pools, "sample_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.when(F.col("avg_len") > 0, F.col("len") / F.col("avg_len")).otherwise(0.0)
    part = F.col("q") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))
    return tf.groupBy(*KEY).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25"))


def word_grams(c: Column) -> Column:
    """Words of two or more word characters in lower case, and pairs of neighbours."""
    w = T.find_all(F.lower(c), r"(?U)\b\w\w+\b")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def char_grams(word: Column) -> Column:
    """Substrings of 3 to 5 characters of the word with a blank on either side."""
    w = F.concat(F.lit(" "), word, F.lit(" "))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: w.substr(i, F.lit(n)))
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.length(w) >= n, grams(n)).otherwise(none) for n in (3, 4, 5)])


def term_counts(texts: DataFrame, analyzer: str) -> DataFrame:
    """sample_id, pos, term, tf of texts(sample_id, pos, text)."""
    if analyzer == "word":
        return texts.select(*KEY, F.explode(word_grams(F.col("text"))).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))
    if analyzer != "char_wb":
        raise ValueError(f"Unsupported analyzer: {analyzer}")
    # words first, as they repeat: each is cut into its substrings once per text
    found = texts.select(*KEY, F.explode(T.split_words(F.lower("text"))).alias("word")).groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    return found.select(*KEY, "n", F.explode(char_grams(F.col("word"))).alias("term")).groupBy(*KEY, "term").agg(F.sum("n").alias("tf"))


def parts(c: Column, analyzer: str) -> Column:
    """What terms_of makes the terms of a text of: the terms themselves, or words to be cut."""
    if analyzer not in ("word", "char_wb"):
        raise ValueError(f"Unsupported analyzer: {analyzer}")
    return word_grams(c) if analyzer == "word" else T.split_words(F.lower(c))


def terms_of(found: list[str], analyzer: str) -> Counter:
    """How often each term is in a text with these parts."""
    if analyzer == "word":
        return Counter(found)
    out: Counter = Counter()
    for word, times in Counter(found).items():
        w = f" {word} "
        for g in (w[i : i + k] for k in (3, 4, 5) for i in range(len(w) - k + 1)):
            out[g] += times
    return out


def tfidf(samples: DataFrame, candidates: DataFrame, analyzer: str = "word", name: str = "word_tfidf") -> DataFrame:
    """sample_id, pos and the cosine of comment and candidate, fitted on the pool with its comment; 0 without common terms."""
    query = samples.join(candidates.select("sample_id").distinct(), "sample_id", "left_semi")
    texts = candidates.select(*KEY, T.none_if_null(F.col("text")).alias("text")).unionByName(query.select("sample_id", F.lit(-1).cast(dict(candidates.dtypes)["pos"]).alias("pos"), T.none_if_null(F.col("comment")).alias("text")))
    size = texts.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sized = texts.join(size, "sample_id")
    small = (F.col("n") <= POOL_TEXTS) & (F.col("chars") <= POOL_CHARS)
    cos = pool_cosines(sized.where(small), analyzer, name).unionByName(cosines(sized.where(~small).select(*KEY, "text"), analyzer, name))
    return candidates.select(*KEY).join(cos, KEY, "left").select(*KEY, F.coalesce(name, F.lit(0.0)).alias(name))


def pool_cosines(texts: DataFrame, analyzer: str, name: str) -> DataFrame:
    """sample_id, pos, cosine of the pools of bounded size: each is one row, whose terms are never dealt out."""
    one = texts.where("pos is not null").select("sample_id", F.struct("pos", parts(F.col("text"), analyzer).alias("parts")).alias("t"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    pools = one.repartition(tasks, "sample_id").groupBy("sample_id").agg(F.collect_list("t").alias("texts"))
    kind = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, POOLS):
                batch = whole.slice(at, POOLS)
                rows, places, out = [], [], []
                for i, texts in enumerate(batch["texts"].to_pylist()):
                    counts: dict[int, Counter] = {}
                    for t in texts:
                        counts.setdefault(t["pos"], Counter()).update(terms_of(t["parts"], analyzer))
                    n, df = len(texts), Counter(g for c in counts.values() for g in c)
                    idf = {g: math.log((1 + n) / (1 + k)) + 1 for g, k in df.items()}
                    asked = {g: k * idf[g] for g, k in counts.get(-1, Counter()).items()}
                    length = math.sqrt(sum(v * v for v in asked.values()))
                    for pos, c in counts.items():
                        norm = math.sqrt(sum((k * idf[g]) ** 2 for g, k in c.items()))
                        dot = sum(v * c[g] * idf[g] for g, v in asked.items() if g in c)
                        rows.append(i)
                        places.append(pos)
                        out.append(dot / (norm * length) if norm * length else None)
                pos_type = batch["texts"].type.value_type.field("pos").type
                yield pa.RecordBatch.from_arrays([batch["sample_id"].take(pa.array(rows, pa.int64())), pa.array(places, pos_type), pa.array(out, pa.float64())], ["sample_id", "pos", name])

    return pools.mapInArrow(run, f"sample_id {kind['sample_id']}, pos {kind['pos']}, {name} double")


def cosines(texts: DataFrame, analyzer: str, name: str) -> DataFrame:
    """sample_id, pos, cosine of pools of any size, by text and term."""
    n = texts.groupBy("sample_id").agg(F.count("*").alias("n"))
    # keys without nulls here, as the joins ask for it on one side only: both uses of the counts then share one exchange
    counts = term_counts(texts.where("sample_id is not null and pos is not null"), analyzer).where("term is not null")
    # a term's idf and the comment's weight come from a combining aggregate, and meet the term's rows in a join that Spark can split
    terms = counts.groupBy("sample_id", "term").agg(F.count("*").alias("df"), F.max(F.when(F.col("pos") == -1, F.col("tf"))).alias("qtf"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    terms = terms.join(n, "sample_id").select("sample_id", "term", idf.alias("idf"), (F.col("qtf") * idf).alias("qw"))
    w = counts.join(terms, ["sample_id", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    sums = w.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"))
    q = terms.groupBy("sample_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    return sums.join(q, "sample_id").select(*KEY, F.try_divide(F.col("dot"), F.col("norm") * F.col("qnorm")).alias(name))


def overlap_features(samples: DataFrame, candidates: DataFrame) -> DataFrame:
    """The features that compare comment and candidate by sets of tokens, lines, paths and spans; one join, no other shuffle."""
    c = T.none_if_null(F.col("comment"))
    inline = T.inline_code(c)
    pairs = F.filter(F.transform(T.replacement_pairs(c), lambda p: F.struct(T.normalize_line(p["old"]).alias("old"), T.normalize_line(p["new"]).alias("new"))), lambda p: (p["old"] != "") & (p["new"] != ""))
    sets = lambda a: F.array_distinct(T.non_empty(F.transform(a, T.normalize_line)))
    query = samples.select(
        "sample_id",
        F.array_distinct(T.tokenize_retrieval(T.clean_comment(c))).alias("q_tokens"),
        T.meaningful_lines(c).alias("q_lines"),
        F.array_distinct(T.tokenize_retrieval(F.array_join(inline, " "))).alias("q_inline"),
        sets(inline).alias("q_inline_lines"),
        F.transform(T.quoted_spans(c), F.lower).alias("q_quoted"),
        sets(T.quoted_spans(c)).alias("q_quoted_lines"),
        pairs.alias("q_pairs"),
        T.path_mentions(c).alias("q_paths"),
        F.array_distinct(T.path_parts(F.array_join(T.path_mentions(c), " "))).alias("q_path_tokens"),
    )
    t = T.none_if_null(F.col("text"))
    docs = candidates.select(
        *KEY,
        F.array_distinct(T.tokenize_retrieval(t)).alias("d_tokens"),
        T.meaningful_lines(t).alias("d_lines"),
        T.added_lines(t).alias("d_added"),
        T.removed_lines(t).alias("d_removed"),
        F.lower(T.context_path(t)).alias("d_path"),
        F.lower(t).alias("d_low"),
    )
    col = F.col
    x = docs.join(query, "sample_id").withColumn("d_path_tokens", T.path_parts(col("d_path")))
    pair_count = lambda test: F.size(F.filter("q_pairs", test)).cast("double")
    has = lambda a, v: F.array_contains(col(a), v)
    return x.select(
        *KEY,
        T.overlap_count(col("q_lines"), col("d_lines")).alias("line_overlap"),
        T.overlap_ratio(col("q_tokens"), col("d_tokens")).alias("lexical_overlap"),
        T.overlap_ratio(col("q_inline"), col("d_tokens")).alias("inline_code_overlap"),
        T.overlap_ratio(col("q_path_tokens"), col("d_path_tokens")).alias("path_token_overlap"),
        F.exists("q_paths", lambda p: col("d_path").contains(p)).cast("double").alias("path_exact_match"),
        T.overlap_ratio(col("q_inline"), col("d_path_tokens")).alias("inline_path_overlap"),
        T.overlap_count(col("q_inline_lines"), col("d_lines")).alias("inline_line_overlap"),
        T.overlap_count(col("q_lines"), col("d_added")).alias("added_line_overlap"),
        T.overlap_count(col("q_lines"), col("d_removed")).alias("removed_line_overlap"),
        T.overlap_ratio(col("q_tokens"), T.tokens_of_lines(F.array_union("d_added", "d_removed"))).alias("changed_token_overlap"),
        T.overlap_ratio(col("q_tokens"), T.tokens_of_lines(col("d_added"))).alias("added_token_overlap"),
        T.overlap_ratio(col("q_tokens"), T.tokens_of_lines(col("d_removed"))).alias("removed_token_overlap"),
        F.size(F.filter("q_quoted", lambda s: col("d_low").contains(s))).cast("double").alias("quoted_span_exact"),
        T.overlap_count(col("q_quoted_lines"), col("d_lines")).alias("quoted_line_exact"),
        T.overlap_count(col("q_quoted_lines"), col("d_added")).alias("quoted_added_line_exact"),
        T.overlap_count(col("q_quoted_lines"), col("d_removed")).alias("quoted_removed_line_exact"),
        pair_count(lambda p: has("d_removed", p["old"]) & has("d_added", p["new"])).alias("replacement_pair_match"),
        pair_count(lambda p: has("d_removed", p["old"])).alias("replacement_old_removed"),
        pair_count(lambda p: has("d_added", p["new"])).alias("replacement_new_added"),
    )


def base_features(samples: DataFrame, candidates: DataFrame) -> DataFrame:
    """sample_id, pos and all base features in their fixed order."""
    out = overlap_features(samples, candidates).join(bm25(samples, candidates), KEY)
    out = out.join(tfidf(samples, candidates, "word", "word_tfidf"), KEY).join(tfidf(samples, candidates, "char_wb", "char_tfidf"), KEY)
    return out.select(*KEY, *words.BASE_FEATURES)


def lexical_score(weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the features; weights override the defaults by name."""
    unknown = set(weights or {}) - set(words.LEXICAL_WEIGHTS)
    if unknown:
        raise ValueError(f"Unknown weights: {sorted(unknown)}")
    out = F.col("bm25")
    for name, w in (words.LEXICAL_WEIGHTS | (weights or {})).items():
        out = out + F.lit(float(w)) * F.col(name)
    return out


#: Weights of the ablations.
ABLATIONS = {
    "lexical_base": {"inline_code_overlap": 0.0, "inline_path_overlap": 0.0, "inline_line_overlap": 0.0, "path_token_overlap": 0.0, "path_exact_match": 0.0, "word_tfidf": 0.0, "char_tfidf": 0.0, "quoted_span_exact": 0.0, "quoted_line_exact": 0.0},
    "inline_code": {"inline_code_overlap": 1.5, "inline_path_overlap": 0.75, "inline_line_overlap": 2.5, "path_token_overlap": 0.0, "path_exact_match": 0.0, "word_tfidf": 0.0, "char_tfidf": 0.0, "quoted_span_exact": 0.0, "quoted_line_exact": 0.0},
    "inline_code+path": {"inline_code_overlap": 1.5, "inline_path_overlap": 0.75, "inline_line_overlap": 2.5, "path_token_overlap": 2.0, "path_exact_match": 2.0, "word_tfidf": 0.0, "char_tfidf": 0.0, "quoted_span_exact": 0.0, "quoted_line_exact": 0.0},
    "inline_code+char_tfidf": {"inline_code_overlap": 1.5, "inline_path_overlap": 0.75, "inline_line_overlap": 2.5, "path_token_overlap": 0.0, "path_exact_match": 0.0, "word_tfidf": 0.0, "char_tfidf": 1.0, "quoted_span_exact": 0.0, "quoted_line_exact": 0.0},
    "inline_code+word_char_tfidf": {"inline_code_overlap": 1.5, "inline_path_overlap": 0.75, "inline_line_overlap": 2.5, "path_token_overlap": 0.0, "path_exact_match": 0.0, "word_tfidf": 1.5, "char_tfidf": 1.0, "quoted_span_exact": 0.0, "quoted_line_exact": 0.0},
    "inline_code+word_char_tfidf+quoted": {"inline_code_overlap": 1.5, "inline_path_overlap": 0.75, "inline_line_overlap": 2.5, "path_token_overlap": 0.0, "path_exact_match": 0.0, "word_tfidf": 1.5, "char_tfidf": 1.0, "quoted_span_exact": 3.0, "quoted_line_exact": 2.0},
}


def ablation_scores(features: DataFrame, variants: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """score_name, sample_id, pos, score for every variant of the weights, from features computed once."""
    each = [F.struct(F.lit(n).alias("score_name"), lexical_score(w).alias("score")) for n, w in (variants or ABLATIONS).items()]
    return features.select(*KEY, F.explode(F.array(*each)).alias("v")).select("v.score_name", *KEY, "v.score")
