"""Unified diffs as tables of hunks, and the hunk that a review annotation is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def _sections(body: Column) -> Column:
    """path and hunks of each section of a patch, a file's lines up to the next one's. Every step is a transform, so nothing is computed twice."""
    cut = F.transform(F.split(body, r"(?<=\n)(?=diff --git )", -1), lambda s: F.split(s, r"(?<=\n)(?=@@ )", -1))
    # the file headers are in the first piece, unless a hunk opens the patch
    apart = F.transform(cut, lambda p: F.when(p[0].startswith("@@ "), F.struct(F.array(F.lit("")).alias("heads"), p.alias("hunks"))).otherwise(F.struct(F.split(p[0], "\n", -1).alias("heads"), F.slice(p, 2, F.size(p)).alias("hunks"))))
    marks = lambda lines: F.filter(F.transform(F.filter(lines, lambda x: x.startswith("--- ") | x.startswith("+++ ")), lambda x: T.strip(F.substring(x, 5, 1 << 30))), lambda m: m != "/dev/null")
    named = F.transform(apart, lambda x: F.struct(F.when(x["heads"][0].startswith("diff --git "), T.split_words(x["heads"][0])).alias("words"), F.try_element_at(marks(x["heads"]), F.lit(-1)).alias("mark"), x["hunks"].alias("hunks")))
    paths = F.transform(named, lambda x: F.struct(T.normalize_path(F.when(F.size(x["words"]) >= 4, F.try_element_at(x["words"], F.lit(-1)))).alias("diff"), T.normalize_path(x["mark"]).alias("mark"), x["hunks"].alias("hunks")))
    filled = lambda c: F.when(c != "", c)
    return F.transform(paths, lambda x: F.struct(F.coalesce(filled(x["mark"]), filled(x["diff"]), F.lit("unknown")).alias("path"), x["hunks"].alias("hunks")))


def hunks(patches: DataFrame, numbering: str = "file") -> DataFrame:
    """instance_id, ord, path, header, old_start, old_count, new_start, new_count, context_id, source, text of every hunk.

    patches: instance_id, patch. Lines that begin with --- or +++ are file headers only outside a hunk. A malformed
    hunk header has zeros. numbering: ids count hunks within their file ('file') or within the patch ('patch').
    """
    # a patch stays one row: it is cut at the lines that open a file, and these sections at their hunk headers
    body = F.regexp_replace(T.none_if_null(F.col("patch")), T.LINE_END, "\n")
    found = F.flatten(F.transform(_sections(body), lambda x: F.transform(x["hunks"], lambda h: F.struct(x["path"].alias("path"), h.alias("h")))))
    h = patches.select("instance_id", F.posexplode(found).alias("at", "x"))
    h = h.select("instance_id", (F.col("at") + 1).cast("long").alias("ord"), "x.path", F.substring_index("x.h", "\n", 1).alias("header"), T.strip(F.col("x.h")).alias("body"))
    p = T.hunk_header(F.col("header"))
    number = F.row_number().over(Window.partitionBy("instance_id", "path").orderBy("ord")) if numbering == "file" else F.col("ord")
    fields = [F.coalesce(p[c], F.lit(0)).alias(c) for c in ("old_start", "old_count", "new_start", "new_count")]
    return h.select("instance_id", "ord", "path", "header", *fields, F.concat("path", F.lit("::hunk_"), number.cast("string")).alias("context_id"), F.lit("diff_hunk").alias("source"), F.concat(F.lit("path: "), "path", F.lit("\n"), "body").alias("text"))


def content_lines(c):
    """Distinct lines that count for matching: without hunk headers, mentions and diff signs."""
    bare = F.transform(T.lines(F.regexp_replace(c, "\r", "")), T.strip)
    kept = F.filter(bare, lambda s: (s != "") & ~s.startswith("@@ ") & ~F.lower(s).startswith("@user") & ~F.lower(s).startswith("@author"))
    return F.array_distinct(T.non_empty(F.transform(kept, lambda s: F.when(s.rlike(r"^[+\- ]"), T.strip(F.substring(s, 2, 1 << 30))).otherwise(s))))


def trimmed(c):
    return T.strip(F.array_join(F.transform(T.lines(F.regexp_replace(c, "\r", "")), lambda s: F.regexp_replace(s, rf"(?U){T.SPACE}+\z", "")), "\n"))


def match_reviews(reviews: DataFrame, found: DataFrame) -> DataFrame:
    """review_id, gold_context_ids, method, reason of every review: the one hunk that it is about, or why there is none.

    reviews: review_id, instance_id, path, diff_hunk, line, original_line, original_start_line. Evidence is tried in
    order: the hunk's text, its header, the line numbers, and the share of common lines (at least 0.5, and 0.1 ahead
    of the next). Two hunks with the same evidence end the search as ambiguous.
    """
    needle = T.strip(T.none_if_null(F.col("diff_hunk")))
    r = reviews.withColumn("rpath", T.normalize_path(F.col("path"))).withColumn("needle", needle).drop("path")
    h = found.select(F.col("instance_id").alias("hi"), T.normalize_path(F.col("path")).alias("hp"), "ord", "header", "old_start", "old_count", "new_start", "new_count", "context_id", "text")
    x = r.join(h, (F.col("instance_id") == F.col("hi")) & (F.col("rpath") == F.col("hp")), "left")
    there = F.col("context_id").isNotNull()
    content = trimmed(F.col("needle"))
    first = T.strip(F.coalesce(F.try_element_at(T.lines(F.col("needle")), F.lit(1)), F.lit("")))
    within = lambda line, start, count: F.coalesce((F.col(count) > 0) & (F.col(line) >= F.col(start)) & (F.col(line) < F.col(start) + F.col(count)), F.lit(False))
    n_lines, c_lines = content_lines(F.col("needle")), content_lines(F.concat_ws("\n", "header", "text"))
    share = F.when((F.size(n_lines) > 0) & (F.size(c_lines) > 0), F.size(F.array_intersect(n_lines, c_lines)) / F.size(n_lines)).otherwise(0.0)
    tests = {
        "diff_hunk_content": (content != "") & trimmed(F.col("text")).contains(content),
        "diff_hunk_header": T.strip(F.col("header")) == first,
        "new_line": within("line", "new_start", "new_count"),
        "old_line": within("original_line", "old_start", "old_count"),
        "old_start_line": within("original_start_line", "old_start", "old_count"),
    }
    aggs = [F.count_if(there).alias("n")]
    for name, test in tests.items():
        ok = F.coalesce(there & test, F.lit(False))
        aggs += [F.count_if(ok).alias(f"n_{name}"), F.max(F.when(ok, F.col("context_id"))).alias(f"id_{name}")]
    aggs.append(F.sort_array(F.collect_list(F.when(there, F.struct(share.alias("s"), F.col("context_id").alias("id")))), asc=False).alias("top"))
    g = x.groupBy("review_id").agg(*aggs)
    out = F.when(F.col("n") == 0, F.struct(F.lit(None).cast("string").alias("id"), F.lit("unresolved").alias("m"), F.lit("path_not_found").alias("why")))
    for name in tests:
        n = F.col(f"n_{name}")
        out = out.when(n == 1, F.struct(F.col(f"id_{name}").alias("id"), F.lit(name).alias("m"), F.lit(None).cast("string").alias("why")))
        out = out.when(n > 1, F.struct(F.lit(None).cast("string").alias("id"), F.lit("unresolved").alias("m"), F.lit(f"ambiguous_{name}").alias("why")))
    best, second = F.col("top")[0], F.try_element_at("top", F.lit(2))
    clear = (F.size("top") == 1) | (best["s"] - second["s"] >= 0.1)
    out = out.when((best["s"] >= 0.5) & clear, F.struct(best["id"].alias("id"), F.lit("content_overlap").alias("m"), F.lit(None).cast("string").alias("why")))
    out = out.when(best["s"] >= 0.5, F.struct(F.lit(None).cast("string").alias("id"), F.lit("unresolved").alias("m"), F.lit("ambiguous_content_overlap").alias("why")))
    out = out.otherwise(F.struct(F.lit(None).cast("string").alias("id"), F.lit("unresolved").alias("m"), F.lit("no_unique_match").alias("why")))
    g = g.withColumn("r", out)
    ids = F.when(F.col("r.id").isNotNull(), F.array("r.id")).otherwise(F.array().cast("array<string>"))
    return g.select("review_id", ids.alias("gold_context_ids"), F.col("r.m").alias("method"), F.col("r.why").alias("reason"))


def match_first(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """sample_id, gold_context_ids by the older rule: every candidate that holds the hunk's text, else the first of the review's file.

    reviews: sample_id, path, diff_hunk. candidates: sample_id, pos, context_id, text."""
    needle = T.strip(T.none_if_null(F.col("diff_hunk")))
    x = reviews.select("sample_id", needle.alias("needle"), F.concat(F.lit("path: "), F.col("path"), F.lit("\n")).alias("head")).join(candidates, "sample_id", "left")
    inside = F.coalesce((F.col("needle") != "") & F.col("text").contains(F.col("needle")), F.lit(False))
    own = F.coalesce((F.col("head") != "path: \n") & F.col("text").startswith(F.col("head")), F.lit(False))
    ids = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "context_id")))), lambda s: s["context_id"])
    g = x.groupBy("sample_id").agg(ids(inside).alias("a"), ids(own).alias("b"))
    return g.select("sample_id", F.when(F.size("a") > 0, F.col("a")).otherwise(F.slice("b", 1, 1)).alias("gold_context_ids"))
