"""The registered queries of the ranking operators, each over its whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from ..operators import bayes, diffs, fuzzy, lexical, routing, semantic, splits, stats, validate
from ..operators import groupwise as G
from ..operators import metrics as M
from ..operators import scores as S
from ..sources import pools
from . import experiments

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL parts that several queries share ---------------------------------

STRIP = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
CLEAN = lambda x: rf"regexp_replace({STRIP(f'''replace({x}, chr(13), '')''')}, '```[A-Za-z0-9_+-]*', '```', 'g')"
NORMAL = lambda x: f"lower({STRIP(rf'''regexp_replace(regexp_replace(regexp_replace({STRIP(x)}, '```[A-Za-z0-9_+-]*', '', 'g'), '^[+\- ]+', ''), '\s+', ' ', 'g')''')})"
LINES = lambda x: f"list_distinct(list_filter(list_transform(string_split({x}, chr(10)), lambda z: {NORMAL('z')}), lambda z: z <> ''))"
TOKENS = lambda x: (
    f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*'), lambda z: list_concat([lower(z)], "
    f"list_filter(string_split(lower(regexp_replace(z, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), lambda p: p <> '' and p <> lower(z)))))"
)
RATIO = lambda q, d: f"coalesce(len(list_intersect(list_distinct({q}), list_distinct({d}))) / nullif(len(list_distinct({q})), 0)::double, 0)"

DOCUMENT_POOLS = """
samples as (select cast(item_id as varchar) as sample_id, text as comment from benchmark),
candidates as (
  select s.sample_id, row_number() over (partition by s.sample_id order by d.doc_id) as pos, cast(d.doc_id as varchar) as context_id, d.source, d.lang,
         d.source || '/' || d.lang || '.txt' as path, 'path: ' || d.source || '/' || d.lang || '.txt' || chr(10) || d.text as text, contains(d.text, s.comment) as is_gold
  from documents d join samples s on cast(d.doc_id % (select count(*) from benchmark) as varchar) = s.sample_id)"""
CONVERSATION_POOLS = """
turns as (select *, row_number() over (partition by conv_id order by turn) as k from conversations),
samples as (select cast(conv_id as varchar) as sample_id, text as comment from turns where k = 1),
candidates as (select cast(conv_id as varchar) as sample_id, k - 1 as pos, role || '::hunk_' || turn as context_id, role as path, text, k = 2 as is_gold from turns where k > 1)"""
BM25 = f"""
docs as (select sample_id, pos, {TOKENS('text')} as tokens from candidates),
pools as (select sample_id, count(*) as n, avg(len(tokens)) as avg_len from docs group by sample_id),
terms as (select sample_id, unnest({TOKENS(CLEAN('comment'))}) as token from samples),
q as (select sample_id, token, count(*) as q from terms group by all),
hits as (select sample_id, pos, len(tokens) as len, unnest(tokens) as token from docs),
tf as (select h.sample_id, h.pos, h.token, count(*) as tf, any_value(h.len) as len, any_value(q.q) as q from hits h join q on h.sample_id = q.sample_id and h.token = q.token group by h.sample_id, h.pos, h.token),
df as (select *, count(*) over (partition by sample_id, token) as df from tf),
bm as (select sample_id, pos, sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as s from df join pools using (sample_id) group by sample_id, pos),
bm25 as (select c.sample_id, c.pos, coalesce(s, 0) as bm25 from candidates c left join bm using (sample_id, pos))"""
BY = ", ".join(pools.ORDER)
LINEITEM_POOLS = f"""
x as (
  select l_orderkey as sample_id, row_number() over (partition by l_orderkey order by {BY}) as pos, l_linenumber, l_extendedprice as a, l_quantity as b, l_returnflag as path,
         l_linenumber as hunk, l_discount >= 0.08 as is_gold, 'c' || row_number() over (partition by l_orderkey order by {BY}) as context_id from lineitem)"""
OUTCOMES = lambda score, src, keys="": (
    f"ranked_ as (select *, row_number() over (partition by {keys}sample_id order by {score} desc, pos) as r from {src}),\n"
    f"first_ as (select {keys}sample_id, count(*) as candidates, coalesce(min(case when is_gold then r end), 0) as first_rank from ranked_ group by {keys}sample_id),\n"
    f"outcomes as (select *, (first_rank = 1)::int as hit_1, (first_rank between 1 and 3)::int as hit_k, case when first_rank > 0 then 1.0::double / first_rank else 0 end as rr, case when first_rank between 1 and 3 then 1.0::double / first_rank else 0 end as rr_k from first_)"
)
SUMMARY = "count(*) as n, round(avg(hit_1), 9) as hit_1, round(avg(hit_k), 9) as hit_k, round(avg(rr), 9) as mrr, round(avg(rr_k), 9) as mrr_k"
R9 = lambda df: df.withColumns({n: F.round(n, 9) for n, t in df.dtypes if t == "double" and n not in ("weight", "threshold")})
R6 = lambda df, *names: df.withColumns({n: F.round(n, 6) for n in names})


# ---- lexical --------------------------------------------------------------


@query(f"with {DOCUMENT_POOLS}, {BM25} select b.sample_id, b.pos, context_id, round(bm25, 6) as bm25, row_number() over (partition by b.sample_id order by round(bm25, 6) desc, b.pos) as rank from bm25 b join candidates using (sample_id, pos)")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, candidates = pools.document_pools(spark, sf_dir)
    scored = R6(lexical.bm25(samples, candidates).join(candidates.select("sample_id", "pos", "context_id"), ["sample_id", "pos"]), "bm25")
    return scored.select("sample_id", "pos", "context_id", "bm25", G.rank(F.col("bm25")).alias("rank"))


@query(f"with {DOCUMENT_POOLS}, {BM25}, s as (select b.sample_id, b.pos, is_gold, round(bm25, 6) as score from bm25 b join candidates using (sample_id, pos)), {OUTCOMES('score', 's')} select {SUMMARY} from outcomes")
def bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, candidates = pools.document_pools(spark, sf_dir)
    scored = R6(lexical.bm25(samples, candidates).withColumnRenamed("bm25", "score"), "score").join(candidates.select("sample_id", "pos", "is_gold"), ["sample_id", "pos"])
    return R9(M.summary(M.outcomes(scored)))


@query(
    f"""with {DOCUMENT_POOLS}, q as (select sample_id, {TOKENS(CLEAN('comment'))} as qt, {LINES('comment')} as ql from samples)
select c.sample_id, c.pos, cast(len(list_intersect(ql, {LINES('text')})) as double) as line_overlap, {RATIO('qt', TOKENS('text'))} as lexical_overlap
from candidates c join q using (sample_id)"""
)
def overlap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.overlap_features(*pools.document_pools(spark, sf_dir)).select("sample_id", "pos", "line_overlap", "lexical_overlap")


TFIDF = """
n as (select sample_id, count(*) as n from texts group by sample_id),
df as (select sample_id, term, count(*) as df from counts group by sample_id, term),
w as (select c.*, tf * (ln((1 + n) / (1 + df)::double) + 1) as w from counts c join df using (sample_id, term) join n using (sample_id)),
norms as (select sample_id, pos, sqrt(sum(w * w)) as norm from w group by sample_id, pos),
dots as (select d.sample_id, d.pos, sum(d.w * q.w) as dot from w d join w q on d.sample_id = q.sample_id and d.term = q.term and q.pos = -1 where d.pos >= 0 group by d.sample_id, d.pos)
select c.sample_id, c.pos, round(coalesce(dot / (a.norm * b.norm), 0), 6) as {name} from candidates c left join dots using (sample_id, pos)
left join norms a on a.sample_id = c.sample_id and a.pos = c.pos left join norms b on b.sample_id = c.sample_id and b.pos = -1"""
TEXTS = "texts as (select sample_id, pos, text from candidates union all select sample_id, -1, comment from samples where sample_id in (select sample_id from candidates))"


@query(
    f"""with {CONVERSATION_POOLS}, {TEXTS},
ws as (select sample_id, pos, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda z: length(z) > 1) as w from texts),
grams as (select sample_id, pos, unnest(w) as term from ws union all select sample_id, pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from ws),
counts as (select sample_id, pos, term, count(*) as tf from grams group by all), {TFIDF.format(name='word_tfidf')}"""
)
def word_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R6(lexical.tfidf(*pools.conversation_pools(spark, sf_dir), "word", "word_tfidf"), "word_tfidf")


@query(
    f"""with {CONVERSATION_POOLS}, {TEXTS},
ws as (select sample_id, pos, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda z: z <> '')) || ' ' as w from texts),
grams as (select sample_id, pos, substr(w, cast(i as int), cast(k as int)) as term from (select *, unnest(range(1, length(w) - k + 2)) as i from (select *, unnest([3, 4, 5]) as k from ws) where length(w) >= k)),
counts as (select sample_id, pos, term, count(*) as tf from grams group by all), {TFIDF.format(name='char_tfidf')}"""
)
def char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R6(lexical.tfidf(*pools.conversation_pools(spark, sf_dir), "char_wb", "char_tfidf"), "char_tfidf")


@query()
def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All base features and the weighted score, ranked."""
    samples, candidates = pools.conversation_pools(spark, sf_dir)
    f = lexical.base_features(samples, candidates).withColumn("score", lexical.lexical_score())
    return f.withColumn("rank", G.rank(F.col("score")))


@query()
def lexical_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, candidates = pools.conversation_pools(spark, sf_dir)
    s = lexical.ablation_scores(lexical.base_features(samples, candidates)).join(candidates.select("sample_id", "pos", "is_gold"), ["sample_id", "pos"])
    return R9(M.summary(M.outcomes(s, 3, ("score_name",)), ("score_name",)))


# ---- text functions -------------------------------------------------------


@query(
    f"""select doc_id, len(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) as tokens, len({TOKENS('text')}) as retrieval_tokens, len({LINES('text')}) as lines,
len(regexp_extract_all(text, '[A-Za-z0-9_./-]+\\.[A-Za-z0-9_]+')) as paths, sha256({CLEAN('text')}) as cleaned from documents"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return pools.table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokenize(t)).cast("long").alias("tokens"), F.size(T.tokenize_retrieval(t)).cast("long").alias("retrieval_tokens"), F.size(T.meaningful_lines(t)).cast("long").alias("lines"), F.size(T.path_mentions(t)).cast("long").alias("paths"), F.sha2(T.clean_comment(t), 256).alias("cleaned"))


COMMENTS = (
    (1, "Please rename `fooBar` to `foo_22` in src/app/main.py, see \"HTTPServer\" and 'x_y'"),
    (2, "typo: ``spelled wrong`` -> docs; `a` -> `b` and \"old name\" => \"new name\""),
    (3, "Can we remove this? @dev the import is redundant"),
    (4, "```python\nx = 1\n```\nThis raises an exception; why not sort by order?"),
    (5, ""),
)


def comments(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("id"), F.lit(c).alias("comment")) for i, c in COMMENTS]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query()
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four query modes of all conversations' first turns and of comments with code."""
    c = F.col("comment")
    rows = pools.conversation_pools(spark, sf_dir)[0].unionByName(comments(spark).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("sample_id"), "comment"))
    return rows.select("sample_id", *[T.query_text(c, m).alias(m) for m in ("normalized", "expanded", "procedural", "intent_expanded")])


@query()
def comment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all conversations' first turns and of comments with code."""
    c = F.col("comment")
    rows = pools.conversation_pools(spark, sf_dir)[0].select(F.col("sample_id").alias("id"), "comment").unionByName(comments(spark).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "comment"))
    return rows.select("id", F.to_json(T.inline_code(c)).alias("inline"), F.to_json(T.quoted_spans(c)).alias("quoted"), F.to_json(T.replacement_pairs(c)).alias("pairs"), F.to_json(T.path_mentions(c)).alias("paths"))


#: Every conversation's first turn, its first two words said once more in one of six kinds of quotes.
_TWO = r"regexp_extract(comment, '^\s*(\S+\s+\S+)', 1)"
QUOTING_SAMPLES = f"""
quoting as (select sample_id, comment || ' see ' || case cast(sample_id as bigint) % 6 when 0 then '"' || {_TWO} || '"' when 1 then '`' || {_TWO} || '`' when 2 then chr(39) || {_TWO} || '.py' || chr(39) when 3 then chr(39) || lower({_TWO}) || chr(39) when 4 then '``' || {_TWO} || '``' else {_TWO} || '/a.txt' end as comment from samples)"""


def quoting_samples(samples: DataFrame) -> DataFrame:
    two = F.regexp_extract("comment", r"(?U)^\s*(\S+\s+\S+)", 1)
    forms = [("\"", two, "\""), ("`", two, "`"), ("'", two, ".py'"), ("'", F.lower(two), "'"), ("``", two, "``"), ("", two, "/a.txt")]
    said = F.element_at(F.array(*[F.concat(F.lit(a), x, F.lit(z)) for a, x, z in forms]), (F.col("sample_id").cast("long") % 6 + 1).cast("int"))
    return samples.withColumn("comment", F.concat("comment", F.lit(" see "), said))


_SPANS = lambda pattern: f"list_filter(list_transform(regexp_extract_all(comment, '{pattern}', 1), lambda z: {STRIP('z')}), lambda z: z <> '')"
_SINGLE = _SPANS("''([^''\n]{1,120})''")
QUOTED_SQL = f"""list_sort(list_distinct(list_concat({_SPANS('`([^`]+)`')}, {_SPANS('``([^`\n]{1,120})``')}, {_SPANS('"([^"\n]{1,120})"')}, list_filter({_SINGLE}, lambda z: length(z) > 1 and (regexp_matches(z, '[A-Z_./()-]') or not contains(z, ' '))))))"""


@query(f"""with {CONVERSATION_POOLS}, {QUOTING_SAMPLES} select sample_id, {_SPANS('`([^`]+)`')} as inline, {QUOTED_SQL} as quoted, list_transform(regexp_extract_all(comment, '[A-Za-z0-9_./-]+\\.[A-Za-z0-9_]+'), lambda z: lower(z)) as paths from quoting""")
def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline code, quoted spans (distinct, sorted) and paths of all first turns with quotes in them."""
    c = F.col("comment")
    rows = quoting_samples(pools.conversation_pools(spark, sf_dir)[0])
    return rows.select("sample_id", T.inline_code(c).alias("inline"), F.sort_array(T.quoted_spans(c)).alias("quoted"), T.path_mentions(c).alias("paths"))


@query("select p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') as label from part")
def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.table(spark, sf_dir, "part").select("p_partkey", T.normalize_label(F.concat_ws(" ", "p_type", "p_brand")).alias("label"))


@query(
    f"""with {CONVERSATION_POOLS}, {QUOTING_SAMPLES}, n as (select sample_id, count(*) as contexts from candidates group by sample_id)
select sample_id, contains(comment, '```') as code_fence, contains(lower(comment), 'suggestion') as suggestion, contains(comment, '@') as mention, len({QUOTED_SQL}) > 0 as quoted_span,
len(list_filter(regexp_split_to_array(comment, '\\s+'), lambda z: z <> '')) <= 6 as short_comment, len(list_filter(regexp_split_to_array(comment, '\\s+'), lambda z: z <> '')) >= 30 as long_comment,
case when contexts <= 10 then '<=10' when contexts <= 20 then '11-20' when contexts <= 40 then '21-40' else '>40' end as context_bucket from quoting join n using (sample_id)"""
)
def sample_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, candidates = pools.conversation_pools(spark, sf_dir)
    x = quoting_samples(samples).join(candidates.groupBy("sample_id").agg(F.count("*").alias("contexts")), "sample_id")
    s = routing.slice_columns(F.col("comment"), F.col("contexts"))
    return x.select("sample_id", *[c.alias(k) for k, c in s.items()])


# ---- group-relative columns -----------------------------------------------


@query(
    f"""with {LINEITEM_POOLS}, r as (select *, row_number() over (partition by sample_id order by a desc, pos) as rank, count(*) over (partition by sample_id) as n, row_number() over (partition by sample_id, path order by a desc, pos) as file_rank,
count(*) over (partition by sample_id, path) as file_n, max(a) over (partition by sample_id, path) as file_max, max(a) over (partition by sample_id) as top from x)
select sample_id, pos, rank, round(a / top, 6) as max_norm, round(case when n = 1 then 1 else 1 - (rank - 1) / (n - 1)::double end, 6) as rank_share, file_max,
round(case when file_n = 1 then 1 else 1 - (file_rank - 1) / (file_n - 1)::double end, 6) as file_rank_share from r"""
)
def relative_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, a = pools.lineitem_pools(spark, sf_dir), F.col("a")
    out = x.select("sample_id", "pos", G.rank(a).alias("rank"), G.max_norm(a).alias("max_norm"), G.rank_share(a).alias("rank_share"), F.max(a).over(G.pool(*G.FILE)).alias("file_max"), G.rank_share(a, G.FILE).alias("file_rank_share"))
    return R6(out, "max_norm", "rank_share", "file_rank_share")


@query(
    f"""with {LINEITEM_POOLS}, s as (select *, avg(a) over w as m, stddev_pop(a) over w as sd, min(a) over w as lo, max(a) over w as hi, count(*) over w as n, row_number() over (partition by sample_id order by a desc, pos) as r from x window w as (partition by sample_id))
select sample_id, pos, round(case when sd < 1e-6 then a - m else (a - m) / sd end, 4) as zscore, round(case when hi - lo < 1e-6 then 0 else (a - lo) / (hi - lo) end, 6) as minmax, round(case when n = 1 then 1 else 1 - (r - 1) / (n - 1)::double end, 6) as rank,
round(case when hi - lo < 1e-6 then 1 else (a - lo) / (hi - lo) end, 6) as minmax_ones from s"""
)
def normalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, a = pools.lineitem_pools(spark, sf_dir), F.col("a")
    out = x.select("sample_id", "pos", *[G.normalized(a, m).alias(m) for m in ("zscore", "minmax", "rank")], G.normalized(a, "minmax", 1.0).alias("minmax_ones"))
    return R6(out, "minmax", "rank", "minmax_ones").withColumn("zscore", F.round("zscore", 4))


_REL = lambda v: (
    f"{v} as {v}, round({v} / max({v}) over (partition by sample_id), 6) as {v}_max_norm, round(case when n = 1 then 1 else 1 - (row_number() over (partition by sample_id order by {v} desc, pos) - 1) / (n - 1)::double end, 6) as {v}_rank_pct, "
    f"case when n between 11 and 20 then {v} else 0 end as {v}_x_ctx_11_20, case when n between 21 and 40 then {v} else 0 end as {v}_x_ctx_21_40, case when n > 40 then {v} else 0 end as {v}_x_ctx_gt40, max({v}) over (partition by sample_id, path) as {v}_file_max, "
    f"round(case when m = 1 then 1 else 1 - (row_number() over (partition by sample_id, path order by {v} desc, pos) - 1) / (m - 1)::double end, 6) as {v}_within_file_rank_pct"
)


@query(f"with {LINEITEM_POOLS}, y as (select *, count(*) over (partition by sample_id) as n, count(*) over (partition by sample_id, path) as m from x) select sample_id, pos, {_REL('a')}, {_REL('b')} from y")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.feature_matrix(pools.lineitem_pools(spark, sf_dir), ["a", "b"], experiments.CANONICAL)
    return R6(m, *[f"{v}_{s}" for v in "ab" for s in ("max_norm", "rank_pct", "within_file_rank_pct")])


@query(
    f"""with {LINEITEM_POOLS}, r as (select *, row_number() over (partition by sample_id order by a desc, pos) as r from x)
select sample_id, max(case when r = 1 then context_id end) as top_id, max(case when r = 1 then a end) as top, coalesce(max(case when r = 2 then a end), max(case when r = 1 then a end)) as second,
round(max(case when r = 1 then a end) - coalesce(max(case when r = 2 then a end), max(case when r = 1 then a end)), 4) as margin from r group by sample_id"""
)
def top_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_stats(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a"))).withColumn("margin", F.round("margin", 4))


# ---- metrics --------------------------------------------------------------


@query(f"with {LINEITEM_POOLS}, {OUTCOMES('a', 'x')} select sample_id, candidates, first_rank, hit_1, hit_k, rr, rr_k from outcomes")
def ranking_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.outcomes(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a")))


@query(f"with {LINEITEM_POOLS}, {OUTCOMES('a', 'x')} select {SUMMARY} from outcomes")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R9(M.summary(M.outcomes(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a")))))


@query(f"with {LINEITEM_POOLS}, {OUTCOMES('a', 'x')} select min(candidates) as min_candidates, quantile_cont(candidates, 0.5) as median_candidates, max(candidates) as max_candidates, cast(sum(candidates) as bigint) as total_candidates, count(*) filter (first_rank > 3) as beyond_k, count(*) filter (first_rank = 0) as without_gold, round(avg(rr), 9) as mrr, round(avg(rr_k), 9) as mrr_k from outcomes")
def ranking_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R9(M.diagnostics(M.outcomes(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a")))))


_AXES = "select 'priority' as axis, o_orderpriority as label, hit_1, hit_k, rr from outcomes join orders on o_orderkey = sample_id union all select 'status', o_orderstatus, hit_1, hit_k, rr from outcomes join orders on o_orderkey = sample_id"


@query(f"with {LINEITEM_POOLS}, {OUTCOMES('a', 'x')}, s as ({_AXES}) select axis, label, count(*) as n, round(avg(hit_1), 9) as hit_1, round(avg(hit_k), 9) as hit_k, round(avg(rr), 9) as mrr from s group by axis, label having count(*) >= 20")
def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.outcomes(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a"))).join(pools.table(spark, sf_dir, "orders"), F.col("sample_id") == F.col("o_orderkey"))
    return R9(M.slices(o, {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}, 20))


@query(
    f"""with {LINEITEM_POOLS}, pairs as (select 'a' as sys, *, a as score from x union all select 'b', *, b from x), {OUTCOMES('score', 'pairs', 'sys, ')},
s as (select sys, o_orderpriority as label, count(*) as n, avg(hit_1) as hit_1, avg(hit_k) as hit_k, avg(rr) as mrr from outcomes join orders on o_orderkey = sample_id group by all)
select 'priority' as axis, n.label, n.n, round(n.hit_1 - b.hit_1, 6) as hit_1_delta, round(n.hit_k - b.hit_k, 6) as hit_k_delta, round(n.mrr - b.mrr, 6) as mrr_delta from s n join s b using (label) where n.sys = 'b' and b.sys = 'a'"""
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, orders = pools.lineitem_pools(spark, sf_dir), pools.table(spark, sf_dir, "orders")
    a, b = (M.slices(M.outcomes(x.withColumn("score", F.col(c))).join(orders, F.col("sample_id") == F.col("o_orderkey")), {"priority": F.col("o_orderpriority")}) for c in "ab")
    return R6(M.compare(a, b), "hit_1_delta", "hit_k_delta", "mrr_delta")


@query(f"with {LINEITEM_POOLS} select sample_id, list(context_id order by a desc, pos) as ranked_context_ids from x group by sample_id")
def full_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rankings(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a")))


@query(f"with {LINEITEM_POOLS}, r as (select *, row_number() over (partition by sample_id order by a desc, pos) as r from x) select sample_id, list(context_id order by r) as ranked_context_ids from r where r <= 3 group by sample_id")
def top_k_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rankings(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a")), 3)


@query(
    """with p as (select o_orderstatus as gold, case when o_totalprice > 200000 then 'F' when o_orderpriority like '1%' then 'P' else 'O' end as pred from orders),
l as (select gold as label from p union select pred from p),
c as (select label, (select count(*) from p where gold = label) as support, (select count(*) from p where pred = label) as predicted, (select count(*) from p where gold = label and pred = label) as tp from l),
f as (select *, case when support + predicted > 0 then 2.0::double * tp / (support + predicted) else 0 end as f1 from c)
select round(sum(tp)::double / sum(support), 9) as accuracy, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from f"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_orderpriority").startswith("1"), "P").otherwise("O")
    out = M.classification(pools.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("gold"), pred.alias("pred")))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "macro_f1", "weighted_f1")})


@query("select o_orderpriority, avg(o_totalprice) as mean, coalesce(stddev_samp(o_totalprice), 0) as stdev, quantile_cont(o_totalprice, 0.5) as median, list_sort(list(o_totalprice))[cast(count(*) // 2 as int) + 1] as upper_median from orders group by o_orderpriority".replace("avg(o_totalprice)", "round(avg(o_totalprice), 4)").replace("coalesce(stddev_samp(o_totalprice), 0)", "round(coalesce(stddev_samp(o_totalprice), 0), 4)").replace("quantile_cont(o_totalprice, 0.5)", "round(quantile_cont(o_totalprice, 0.5), 4)"))
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.spread(pools.table(spark, sf_dir, "orders"), "o_totalprice", ("o_orderpriority",))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "stdev", "median")})


@query("with t as (select l_returnflag, count(*) as test_samples, avg(l_discount) as d, avg(l_tax) as t from lineitem group by 1) select 'd' as metric, round(avg(d), 9) as macro, round(sum(d * test_samples) / sum(test_samples), 9) as weighted from t union all select 't', round(avg(t), 9), round(sum(t * test_samples) / sum(test_samples), 9) from t")
def target_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pools.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("test_samples"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return M.averages(t, ["d", "t"]).withColumns({c: F.round(c, 9) for c in ("macro", "weighted")})


@query("select event_type as value, count(*) as n, round(count(*)::double / (select count(*) from events), 9) as share from events group by event_type")
def value_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.usage(pools.table(spark, sf_dir, "events"), "event_type").withColumn("share", F.round("share", 9))


# ---- score algebra --------------------------------------------------------

_MM = "case when max({v}) over (partition by sample_id) - min({v}) over (partition by sample_id) < 1e-6 then 0 else ({v} - min({v}) over (partition by sample_id)) / (max({v}) over (partition by sample_id) - min({v}) over (partition by sample_id)) end"


@query(f"with {LINEITEM_POOLS} select sample_id, pos, round({_MM.format(v='a')} + 0.5 * {_MM.format(v='b')}, 6) as score from x")
def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pools.lineitem_pools(spark, sf_dir)
    return R6(S.fuse([(x.withColumn("score", F.col("a")), 1.0), (x.withColumn("score", F.col("b")), 0.5)]), "score")


_GRID_W = ", ".join(str(w) for w in S.WEIGHTS)


@query(
    f"""with {LINEITEM_POOLS}, n as (select *, {_MM.format(v='a')} as am, {_MM.format(v='b')} as bm, count(*) over (partition by sample_id) as cnt,
row_number() over (partition by sample_id order by a desc, pos) as ar, row_number() over (partition by sample_id order by b desc, pos) as br from x),
g as (select sample_id, pos, is_gold, 'raw' as mode, w as weight, round(a + w * b, 6) as score from n, (select unnest([{_GRID_W}]::double[]) as w)
union all select sample_id, pos, is_gold, 'minmax', w, round(am + w * bm, 6) from n, (select unnest([{_GRID_W}]::double[]) as w)
union all select sample_id, pos, is_gold, 'rank', w, round((case when cnt = 1 then 1 else 1 - (ar - 1) / (cnt - 1)::double end) + w * (case when cnt = 1 then 1 else 1 - (br - 1) / (cnt - 1)::double end), 6) from n, (select unnest([{_GRID_W}]::double[]) as w)),
{OUTCOMES('score', 'g', 'mode, weight, ')} select mode, weight, {SUMMARY} from outcomes group by mode, weight"""
)
def fusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded before they are ranked, so that both engines see the same ties."""
    return R9(S.two_way_grid(pools.lineitem_pools(spark, sf_dir), modes=("raw", "minmax", "rank"), digits=6))


@query(f"with {LINEITEM_POOLS}, l as (select sample_id, path, list_reverse_sort(list(a)) as v, avg(a) as mean, max(a) as top from x group by all) select sample_id, pos, round(mean, 7) as mean, top as max, round((v[1] + coalesce(v[2], 0)) / least(2, len(v)), 7) as top2_mean from x join l using (sample_id, path)")
def file_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, a = pools.lineitem_pools(spark, sf_dir), F.col("a")
    out = x.select("sample_id", "pos", *[S.file_aggregate(a, m).alias(m) for m in ("mean", "max", "top2_mean")])
    return out.withColumns({c: F.round(c, 7) for c in ("mean", "top2_mean")})


@query(f"with {LINEITEM_POOLS}, f as (select *, avg(a) over (partition by sample_id, path) as m from x), g as (select *, min(m) over (partition by sample_id) as lo, max(m) over (partition by sample_id) as hi from f) select sample_id, pos, round(case when hi - lo < 1e-6 then 1 else (m - lo) / (hi - lo) end, 6) as score from g")
def file_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.file_prior(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a")), "mean", "minmax")
    return R6(out.select("sample_id", "pos", "score"), "score")


@query(f"with {LINEITEM_POOLS} select i.sample_id, i.pos, round(max(j.b - 0.25 * abs(i.hunk - j.hunk)), 6) as score from x i join x j on i.sample_id = j.sample_id and i.path = j.path group by i.sample_id, i.pos")
def neighbour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.neighbours(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("b")), 0.25)
    return R6(out.select("sample_id", "pos", "score"), "score")


@query(
    f"""with {LINEITEM_POOLS}, r as (select *, row_number() over (partition by sample_id order by a desc, pos) <= 3 as inside, min(a) over (partition by sample_id) as lo, max(a) over (partition by sample_id) as hi from x),
t as (select *, min(a) over (partition by sample_id, inside) as alo, max(a) over (partition by sample_id, inside) as ahi, min(b) over (partition by sample_id, inside) as blo, max(b) over (partition by sample_id, inside) as bhi from r)
select sample_id, pos, round(case when inside then 0.7 * (case when bhi <= blo then 1 else (b - blo) / (bhi - blo) end) + 0.3 * (case when ahi <= alo then 1 else (a - alo) / (ahi - alo) end) else -1 + 0.01 * (case when hi <= lo then 1 else (a - lo) / (hi - lo) end) end, 6) as score from t"""
)
def top_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R6(S.rerank_top(pools.lineitem_pools(spark, sf_dir), 3, 0.7), "score")


@query(
    f"""with {LINEITEM_POOLS}, n as (select *, count(*) over (partition by sample_id) as n from x),
g as (select sample_id, pos, is_gold, 'always' as condition, b as score from n union all select sample_id, pos, is_gold, 'never', a from n union all select sample_id, pos, is_gold, 'gt4', case when n > 4 then b else a end from n),
{OUTCOMES('score', 'g', 'condition, ')} select condition, {SUMMARY} from outcomes group by condition"""
)
def routing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pools.lineitem_pools(spark, sf_dir).withColumn("n", G.size())
    return R9(S.route_grid(x, {"always": F.lit(True), "never": F.lit(False), "gt4": F.col("n") > 4}))


@query(
    f"""with {LINEITEM_POOLS}, m as (select *, {_MM.format(v='a')} as am, {_MM.format(v='b')} as bm from x),
v as (select sample_id, list_reverse_sort(list(am)) as al, list_reverse_sort(list(bm)) as bl from m group by sample_id),
d as (select sample_id, round((bl[1] - coalesce(bl[2], 0)) - (al[1] - coalesce(al[2], 0)), 9) as gain from v),
g as (select x.sample_id, pos, is_gold, t as threshold, case when gain >= t then b else a end as score from x join d using (sample_id), (select unnest([0.0, 0.1, 0.25]::double[]) as t)),
{OUTCOMES('score', 'g', 'threshold, ')} select threshold, {SUMMARY} from outcomes group by threshold"""
)
def margin_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R9(S.margin_router(pools.lineitem_pools(spark, sf_dir), "minmax", (0.0, 0.1, 0.25), digits=9))


@query(
    f"""with {LINEITEM_POOLS}, r as (select sample_id, count(*) as n, list(context_id order by a desc, pos) as base, list(context_id order by b desc, pos) as aux from x group by sample_id)
select sample_id, case when n > 3 then list_concat([base[1]], list_filter(aux, lambda z: z <> base[1])) else base end as ranked_context_ids from r"""
)
def hybrid_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pools.lineitem_pools(spark, sf_dir)
    a, b = (M.rankings(x.withColumn("score", F.col(c))) for c in "ab")
    use = x.groupBy("sample_id").agg((F.count("*") > 3).alias("applies"))
    return S.hybrid(a, [b], use)


@query(
    f"""with {LINEITEM_POOLS}, f as (select *, max(b) over (partition by sample_id, path) as v, min(pos) over (partition by sample_id, path) as fp from x),
g as (select *, min(v) over (partition by sample_id) as lo, max(v) over (partition by sample_id) as hi from f),
s as (select *, case when hi <= lo then 1 else (v - lo) / (hi - lo) end as share from g),
p as (select *, dense_rank() over (partition by sample_id order by share desc, fp) as place from s)
select sample_id, pos, round(b + 2.0 * share - case when place > 1 then 0.5 else 0 end, 6) as score from p"""
)
def hierarchical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.hierarchical(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("b")), F.lit(True), "max", 2.0, 1, 0.5)
    return R6(out.select("sample_id", "pos", "score"), "score")


@query(
    f"""with {LINEITEM_POOLS}, r as (select *, row_number() over (partition by sample_id order by a desc, pos) as r from x),
o as (select *, row_number() over (partition by sample_id, lower(path) order by r) > 1 as again from r),
p as (select *, row_number() over (partition by sample_id order by again, r) as rank from o) select sample_id, pos, rank from p where rank <= 3"""
)
def feedback_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feedback_contexts(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a")), 3, True).select("sample_id", "pos", "rank")


# ---- classification, splits, statistics, checks -----------------------------

_NB_ROWS = "rows_ as (select doc_id as row_id, text, cast(quality as varchar) as label from documents join labels using (doc_id))"


@query(
    f"""with {_NB_ROWS}, t as (select row_id, label, unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) as token from rows_),
lab as (select label, count(*) as docs from rows_ group by label), tc as (select label, token, count(*) as n from t group by all), tot as (select label, sum(n) as tokens from tc group by label),
v as (select count(distinct token) as v from tc), f as (select row_id, token, count(*) as f from t group by all),
s as (select f.row_id, l.label, sum(f.f * ln((coalesce(tc.n, 0) + 1) / (tokens + v)::double)) as s from f cross join lab l join tot using (label) cross join v left join tc on tc.label = l.label and tc.token = f.token group by f.row_id, l.label),
e as (select r.row_id, l.label, ln(l.docs / (select sum(docs) from lab)::double) + coalesce(s.s, 0) as score from rows_ r cross join lab l left join s on s.row_id = r.row_id and s.label = l.label)
select row_id, arg_max(label, score) as pred from e group by row_id"""
)
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pools.table(spark, sf_dir, "documents").join(pools.table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "text", F.col("quality").cast("string").alias("label"))
    return bayes.predict(rows.select("row_id", "text"), bayes.fit(rows)).select("row_id", "pred")


_DRAW = lambda seed, *c: "cast(('0x' || substr(md5(concat_ws('|', " + ", ".join(f"coalesce(cast({x} as varchar), '')" for x in c) + f", '{seed}')), 1, 13)) as bigint)::double / 4503599627370496"


@query(
    f"""with {_NB_ROWS}, k as (select *, row_number() over (partition by label order by {_DRAW(5, 'row_id')}, row_id) as k, count(*) over (partition by label) as n from rows_),
h as (select *, greatest(1, floor(n * 0.7)) as train, greatest(1, floor(n * 0.1)) as dev from k),
sp as (select row_id, text, label, k > (case when train + dev >= n then greatest(1, n - 2) + 1 else train + dev end) as test from h),
t as (select row_id, label, test, unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) as token from sp),
lab as (select label, count(*) as docs from sp where not test group by label), tc as (select label, token, count(*) as n from t where not test group by all), tot as (select label, sum(n) as tokens from tc group by label),
v as (select count(distinct token) as v from tc), f as (select row_id, token, count(*) as f from t where test group by all),
s as (select f.row_id, l.label, sum(f.f * ln((coalesce(tc.n, 0) + 1) / (tokens + v)::double)) as s from f cross join lab l join tot using (label) cross join v left join tc on tc.label = l.label and tc.token = f.token group by f.row_id, l.label),
e as (select r.row_id, r.label as gold, l.label, ln(l.docs / (select sum(docs) from lab)::double) + coalesce(s.s, 0) as score from sp r cross join lab l left join s on s.row_id = r.row_id and s.label = l.label where r.test),
p as materialized (select row_id, any_value(gold) as gold, arg_max(label, score) as pred from e group by row_id), names as (select gold as label from p union select pred from p),
c as (select label, (select count(*) from p where gold = label) as support, (select count(*) from p where pred = label) as predicted, (select count(*) from p where gold = label and pred = label) as tp from names),
f1 as (select *, case when support + predicted > 0 then 2.0::double * tp / (support + predicted) else 0 end as f1 from c)
select round(sum(tp)::double / sum(support), 9) as accuracy, round(avg(f1), 9) as macro_f1, round(sum(f1 * support) / sum(support), 9) as weighted_f1 from f1"""
)
def intent_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and F1 of naive Bayes on the labelled documents' quality, on rows that it was not trained on."""
    rows = pools.table(spark, sf_dir, "documents").join(pools.table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("row_id"), "text", F.col("quality").cast("string").alias("label"))
    return R9(experiments.intent_run(splits.stratified_split(rows, "label", 5, "row_id")))


@query(
    f"""with g as (select o_custkey, count(*) as n, {_DRAW(7, 'o_custkey')} as draw from orders group by o_custkey),
b as (select *, coalesce(sum(n) over (order by draw, o_custkey rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from g)
select o_orderkey, o_custkey, case when before < greatest(1, round_even(total * 0.1, 0)) then 'dev' else 'train' end as split from orders join b using (o_custkey)"""
)
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_group(pools.table(spark, sf_dir, "orders"), 0.1, 7, "o_custkey").select("o_orderkey", "o_custkey", "split")


@query(
    f"""with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {_DRAW(3, 'o_orderkey')}, o_orderkey) as k, count(*) over (partition by o_orderpriority) as n from orders)
select o_orderkey, o_orderpriority from r where k <= greatest(1, round_even(n * 0.25, 0))"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_sample(pools.table(spark, sf_dir, "orders"), "o_orderpriority", 0.25, 3, "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(
    f"""with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {_DRAW(5, 'o_orderkey')}, o_orderkey) as k, count(*) over (partition by o_orderstatus) as n from orders),
s as (select *, greatest(1, floor(n * 0.7)) as train, greatest(1, floor(n * 0.1)) as dev from r), t as (select *, train + dev >= n as rare from s)
select o_orderkey, case when k <= (case when rare then greatest(1, n - 2) else train end) then 'train' when k <= (case when rare then greatest(1, n - 2) + 1 else train + dev end) then 'dev' else 'test' end as split from t"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(pools.table(spark, sf_dir, "orders"), "o_orderstatus", 5, order="o_orderkey").select("o_orderkey", "split")


@query("with o as (select *, case when o_totalprice > 250000 then 'test' else 'train' end as split, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey), c as (select n_name, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test from o group by n_name) select * from c where train >= 5 and test >= 1")
def holdout_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pools.table(spark, sf_dir, "orders").join(pools.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(pools.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return splits.holdout_targets(o.withColumn("split", F.when(F.col("o_totalprice") > 250000, "test").otherwise("train")), "split", "n_name", 5, 1)


@query("select l.* from orders l where not exists (select 1 from customer c where c.c_custkey = l.o_custkey and c.c_acctbal < 0)")
def leakage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = pools.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return splits.without_test_groups(pools.table(spark, sf_dir, "orders"), test, "o_custkey")


@query(f"with {LINEITEM_POOLS}, {OUTCOMES('a', 'x')} select o_custkey as group_key, round(sum(rr), 9) as total, count(*) as n from outcomes join orders on o_orderkey = sample_id group by o_custkey")
def cluster_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.outcomes(pools.lineitem_pools(spark, sf_dir).withColumn("score", F.col("a"))).join(pools.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_key")), "sample_id")
    return stats.cluster_sums(o, "rr").withColumn("total", F.round("total", 9))


_DIGEST = lambda n, seed: f"md5(concat_ws('|', cast(key as varchar), {n}, '{seed}'))"
_TIMES = " + ".join(f"(u >= {p!r})::int" for p in stats.POISSON)


def _statistics_sql(value: str) -> str:
    """Both tests of one metric, by the same digests."""
    return f"""(with d as (select a.o_custkey as key, sum(b.v - a.v)::double as total, count(*) as n from o a join o b using (sample_id) where a.sys = 'a' and b.sys = 'b' and a.metric = '{value}' and b.metric = '{value}' group by a.o_custkey),
w as (select *, ('0x' || substr({_DIGEST('r // 4', 42)}, cast(r % 4 * 8 + 1 as int), 8))::bigint::double / 4294967296 as u from d, (select unnest(range(0, 4000)) as r)),
m as (select r, sum(({_TIMES}) * total) / sum(({_TIMES}) * n) as mean from w group by r),
h as (select total, k, {_DIGEST('k', 43)} as h from d, (select unnest(range(0, 94)) as k) where total <> 0),
c as (select k, p, total, ('0x' || substr(h, cast(p + 1 as int), 1))::int as four from h, (select unnest(range(0, 32)) as p)),
f as (select k * 128 + p * 4 + b as flip, abs(sum(case when (four >> b) & 1 = 1 then total else -total end)) as s from c, (select unnest(range(0, 4))::int as b) group by k, p, b),
seen as (select sum(total) / sum(n) as mean, sum(n) as n from d)
select '{value}' as metric, round((select mean from seen), 6) as mean, round((select quantile_cont(mean, 0.025) from m), 6) as ci_low, round((select quantile_cont(mean, 0.975) from m), 6) as ci_high,
round(case when (select mean from seen) = 0 then 1 else (1 + (select count(*) from f where flip < 12000 and s / (select n from seen) >= abs((select mean from seen)) - 1e-12)) / 12001.0::double end, 6) as p_value)"""


@query(
    f"""with {LINEITEM_POOLS}, pairs as (select 'a' as sys, *, a as score from x union all select 'b', *, b from x), {OUTCOMES('score', 'pairs', 'sys, ')},
o as (select sys, sample_id, o_custkey, 'hit_1' as metric, hit_1::double as v from outcomes join orders on o_orderkey = sample_id union all select sys, sample_id, o_custkey, 'rr', rr from outcomes join orders on o_orderkey = sample_id)
{_statistics_sql('hit_1')} union all {_statistics_sql('rr')}"""
)
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval and sign-flip p-value of ranker b against a, by customers."""
    x, orders = pools.lineitem_pools(spark, sf_dir), pools.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("group_key"))
    # both rankers' outcomes of a pool in one row
    first = x.select("sample_id", "is_gold", *[G.rank(F.col(c)).alias(c) for c in "ab"]).groupBy("sample_id")
    both = first.agg(*[F.coalesce(F.min(F.when(F.col("is_gold"), F.col(c))), F.lit(0)).alias(c) for c in "ab"])
    rr = lambda c: F.when(F.col(c) > 0, 1 / F.greatest(F.col(c), F.lit(1))).otherwise(0.0)
    delta = both.select("sample_id", ((F.col("b") == 1).cast("double") - (F.col("a") == 1).cast("double")).alias("hit_1"), (rr("b") - rr("a")).alias("rr"))
    sums = delta.join(orders, "sample_id").groupBy("group_key").agg(F.sum("hit_1").alias("hit_1"), F.sum("rr").alias("rr"), F.count("*").alias("n"))
    return R6(stats.comparisons(sums, {"hit_1": "hit_1", "rr": "rr"}), "mean", "ci_low", "ci_high", "p_value")


@query("with d as (select sha256(length(text)::varchar || ':' || text || '|' || length(lang)::varchar || ':' || lang) as fingerprint, source from documents), s as (select fingerprint, list_sort(list(distinct source)) as s from d group by fingerprint having count(distinct source) > 1), p as (select unnest(flatten(list_transform(s, lambda a: list_transform(list_filter(s, lambda b: b > a), lambda b: {'l': a, 'r': b})))) as p from s) select p.l as left_split, p.r as right_split, count(*) as shared from p group by all")
def split_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal documents that two sources share."""
    return validate.split_overlap(validate.fingerprints(pools.table(spark, sf_dir, "documents"), "text", "lang"), "fingerprint", "source")


@query(f"with {LINEITEM_POOLS}, y as (select sample_id, pos, case when b > 40 then 'z' else context_id end as other, case when l_linenumber = 7 then null else a end as score from x where l_linenumber <> 1) select x.sample_id, x.pos, case when y.sample_id is null then 'missing' when x.context_id <> y.other then 'other context' when y.score is null then 'not finite' end as problem from x left join y using (sample_id, pos) where y.sample_id is null or x.context_id <> y.other or y.score is null")
def score_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pools.lineitem_pools(spark, sf_dir)
    y = x.where("l_linenumber <> 1").select("sample_id", "pos", F.when(F.col("b") > 40, "z").otherwise(F.col("context_id")).alias("context_id"), F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("a")).alias("score"))
    return validate.aligned(x, y)


@query(f"with {LINEITEM_POOLS}, r as (select sample_id, count(*) as n, count(*) filter (pos <= 4) as k from x group by sample_id) select sample_id, 'truncated' as problem from r where k < n")
def ranking_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pools.lineitem_pools(spark, sf_dir)
    return validate.incomplete_rankings(x, M.rankings(x.where("pos <= 4").withColumn("score", F.col("a"))))


@query()
def learned_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a logistic ranker on base features and their relative forms, on conversations that it was not trained on."""
    samples, candidates = pools.conversation_pools(spark, sf_dir)
    features = lexical.base_features(samples, candidates).join(candidates.select("sample_id", "pos", "path", F.col("is_gold").cast("int").alias("label")), ["sample_id", "pos"])
    d = splits.draw(13, "sample_id")
    split = samples.select("sample_id", F.when(d < 0.7, "train").when(d < 0.8, "dev").otherwise("test").alias("split"))
    _, scored = experiments.train_ranker(features, split, words.BASE_FEATURES, "raw_plus_relative", (1.0,))
    rows = scored.join(candidates.select("sample_id", "pos", "is_gold"), ["sample_id", "pos"]).join(split, "sample_id")
    return R9(M.summary(M.outcomes(rows, 3, ("split",)), ("split",)))


# ---- vectors, fuzzy, diffs --------------------------------------------------


@query(
    """with q as (select label, arg_min(embedding, vec_id) as qv, min(vec_id) as qid from embeddings group by label)
select cast(e.label as varchar) as sample_id, e.vec_id as pos, round(list_inner_product(e.embedding::double[], qv::double[]) / sqrt(list_inner_product(e.embedding::double[], e.embedding::double[]) * list_inner_product(qv::double[], qv::double[])), 6) as score from embeddings e join q using (label)"""
)
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pools.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("sample_id"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("v"))
    queries = e.groupBy("sample_id").agg(F.min_by("v", "pos").alias("v"))
    return R6(semantic.dense_scores(queries, e), "score")


@query()
def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, candidates = pools.conversation_pools(spark, sf_dir)
    model = semantic.fit(semantic.corpus(samples, candidates))
    return semantic.score(*experiments.semantic_inputs(samples, candidates), model)


@query()
def feedback_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, candidates = pools.conversation_pools(spark, sf_dir)
    q = samples.select("sample_id", T.query_text(F.col("comment")).alias("query"))
    scored = candidates.join(lexical.bm25(samples, candidates).withColumnRenamed("bm25", "score"), ["sample_id", "pos"])
    return semantic.feedback_query(q, semantic.feedback_terms(q, scored, 2))


@query()
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.fuzzy_scores(*pools.conversation_pools(spark, sf_dir), 2, plain=True)


PATCH = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,2 +1,3 @@
 x = 1
+y = 2
---old
@@ -10 +11,0 @@ def f():
-z
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ bad header
-all
"""


@query(
    """select cast(item_id as varchar) as instance_id, ord, replace(t.path, '%', cast(item_id as varchar)) as path, header, old_start, old_count, new_start, new_count, replace(context_id, '%', cast(item_id as varchar)) as context_id, replace(t.text, '%', cast(item_id as varchar)) as text from benchmark, (values
(1, 'src/a%.py', '@@ -1,2 +1,3 @@', 1, 2, 1, 3, 'src/a%.py::hunk_1', 'path: src/a%.py' || chr(10) || '@@ -1,2 +1,3 @@' || chr(10) || ' x = 1' || chr(10) || '+y = 2' || chr(10) || '---old'),
(2, 'src/a%.py', '@@ -10 +11,0 @@ def f():', 10, 1, 11, 0, 'src/a%.py::hunk_2', 'path: src/a%.py' || chr(10) || '@@ -10 +11,0 @@ def f():' || chr(10) || '-z'),
(3, 'gone.py', '@@ bad header', 0, 0, 0, 0, 'gone.py::hunk_1', 'path: gone.py' || chr(10) || '@@ bad header' || chr(10) || '-all')) t(ord, path, header, old_start, old_count, new_start, new_count, context_id, text)"""
)
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch with all kinds of headers for each benchmark item, its file named after the item."""
    items = pools.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("instance_id"))
    return diffs.hunks(items.select("instance_id", F.replace(F.lit(PATCH), F.lit("src/a"), F.concat(F.lit("src/a"), "instance_id")).alias("patch"))).drop("source")


def language_table() -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in words.LANGUAGES.items())


@query(f"with t as (select row_number() over () - 1 as k, ext, lang from (values {language_table()}, ('.zig', null)) t(ext, lang)) select doc_id, coalesce(t.lang, t.ext) as language from documents join t on doc_id % (select count(*) from t) = k")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known ending, and an unknown one, dealt out to the documents."""
    exts = [*words.LANGUAGES, ".zig"]
    ext = F.element_at(F.array(*map(F.lit, exts)), (F.pmod("doc_id", F.lit(len(exts))) + 1).cast("int"))
    return pools.table(spark, sf_dir, "documents").select("doc_id", T.language_of_path(F.concat(F.lit("a/b"), ext)).alias("language"))
