"""Text functions as Column -> Column: tokens, lines, spans, paths, changed lines and query texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

# White space as Python's str methods see it: Java's class with the Unicode flag, and the four separators it lacks.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
TOKEN = "[A-Za-z_][A-Za-z0-9_]*"
FENCE = "```[A-Za-z0-9_+-]*"
INLINE = "`([^`]+)`"
DOUBLE_TICK = "``([^`\n]{1,120})``"
DOUBLE_QUOTED = '"([^"\n]{1,120})"'
SINGLE_QUOTED = "'([^'\n]{1,120})'"
PATH = r"[A-Za-z0-9_./-]+\.[A-Za-z0-9_]+"
REPLACEMENT = "([\"'`]{1,2})([^\"'`\n]{1,120})\\1\\s*(?:--?>|=>)\\s*([\"'`]{1,2})([^\"'`\n]{1,120})\\3"


def none_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def split_words(c: Column) -> Column:
    """As a split at runs of white space, without empty pieces."""
    return non_empty(F.split(c, rf"(?U){SPACE}+", -1))


def non_empty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def lines(c: Column) -> Column:
    """Lines without their ends; an end that closes the text opens no further line."""
    pieces = F.split(c, LINE_END, -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokenize(c: Column) -> Column:
    return find_all(F.lower(c), TOKEN)


def split_identifier(c: Column) -> Column:
    """Parts of an identifier: at _ and -, and between a lower-case letter or digit and a capital."""
    snake = F.regexp_replace(F.regexp_replace(c, "-", "_"), "(?<=[a-z0-9])(?=[A-Z])", "_")
    return non_empty(F.split(F.lower(snake), "_", -1))


def tokenize_retrieval(c: Column) -> Column:
    """Each token in lower case, followed by those of its parts that differ from it; repeats are kept."""
    return F.flatten(F.transform(find_all(c, TOKEN), lambda t: F.concat(F.array(F.lower(t)), F.filter(split_identifier(t), lambda p: p != F.lower(t)))))


def clean_comment(c: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(c, "\r", "")), FENCE, "```")


def clean_review(c: Column) -> Column:
    """A review comment as it enters a dataset: without carriage returns, what follows an author line, or a leading mention."""
    cut = F.split(strip(F.regexp_replace(c, "\r", "")), "(?i)\n@author:", 2)[0]
    return strip(F.regexp_replace(cut, rf"(?U)^@\w+:{SPACE}*", ""))


def normalize_line(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(c), FENCE, ""), r"^[+\- ]+", "")
    return F.lower(strip(collapse(bare)))


def normalized_lines(c: Column) -> Column:
    """Non-empty normalized lines in order, repeats kept."""
    return non_empty(F.transform(lines(c), normalize_line))


def meaningful_lines(c: Column) -> Column:
    return F.array_distinct(normalized_lines(c))


def is_marker(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^(?:path: |@@|\+\+\+|---)"))


def changed_lines(c: Column, sign: str) -> Column:
    """Distinct normalized lines that begin with the sign, without file and hunk markers."""
    own = F.filter(lines(c), lambda x: x.startswith(sign) & ~is_marker(x))
    return F.array_distinct(non_empty(F.transform(own, normalize_line)))


def added_lines(c: Column) -> Column:
    return changed_lines(c, "+")


def removed_lines(c: Column) -> Column:
    return changed_lines(c, "-")


def tokens_of_lines(a: Column) -> Column:
    return tokenize_retrieval(F.array_join(F.array_sort(a), " "))


def context_path(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?m)^path:\s*(.+)$", 1))


def path_parts(c: Column) -> Column:
    return non_empty(F.split(F.lower(c), "[/._-]+", -1))


def path_mentions(c: Column) -> Column:
    return F.transform(find_all(c, PATH), F.lower)


def stripped(a: Column) -> Column:
    return non_empty(F.transform(a, strip))


def inline_code(c: Column) -> Column:
    return stripped(find_all(c, INLINE, 1))


def looks_like_code(c: Column) -> Column:
    return (F.length(strip(c)) > 1) & (c.rlike(r"[A-Z_./()\-]") | ~c.contains(" "))


def quoted_spans(c: Column) -> Column:
    single = F.filter(stripped(find_all(c, SINGLE_QUOTED, 1)), looks_like_code)
    return F.array_distinct(F.concat(inline_code(c), stripped(find_all(c, DOUBLE_TICK, 1)), stripped(find_all(c, DOUBLE_QUOTED, 1)), single))


def replacement_pairs(c: Column) -> Column:
    """array<struct<old, new>> of spelled-out replacements."""
    old, new = (F.transform(find_all(c, REPLACEMENT, k), strip) for k in (2, 4))
    return F.filter(F.arrays_zip(old.alias("old"), new.alias("new")), lambda p: (p["old"] != "") & (p["new"] != ""))


def distinct_stripped(a: Column) -> Column:
    """Distinct non-empty stripped values, in the order of their first occurrence."""
    return F.array_distinct(stripped(a))


def overlap_ratio(query: Column, doc: Column) -> Column:
    """Share of the distinct query values that the document has; 0 for an empty query."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, doc)), F.size(F.array_distinct(query))), F.lit(0.0))


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def any_needle(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def hints(c: Column, sets: tuple) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*[F.when(any_needle(low, needles), F.lit(text)) for needles, text in sets]), lambda x: x.isNotNull())


def review_intent_hints(c: Column) -> Column:
    return hints(c, words.REVIEW_HINTS)


def intent_expansion_hints(c: Column) -> Column:
    return hints(c, words.EXPANSION_HINTS)


def literal_list(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def filtered_terms(c: Column) -> Column:
    """Retrieval tokens of more than one character that are neither digits nor stop words, each once."""
    stop = literal_list(words.STOP_WORDS)
    return F.array_distinct(F.filter(tokenize_retrieval(c), lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t)))


def terms_of(a: Column) -> Column:
    return F.flatten(F.transform(a, filtered_terms))


def labelled(label: str, a: Column) -> Column:
    """'label v1 v2', or null for an empty array; concat_ws skips it."""
    return F.when(F.size(a) > 0, F.concat(F.lit(label + " "), F.array_join(a, " ")))


def base_query(c: Column) -> Column:
    cleaned = clean_comment(c)
    text = F.array_join(normalized_lines(cleaned), " ")
    return F.when(text != "", text).otherwise(F.lower(cleaned))


def query_text(c: Column, mode: str = "normalized") -> Column:
    """The comment as a retrieval query, in one of four modes."""
    base = base_query(c)
    if mode == "normalized":
        return base
    inline, quoted, paths, pairs = distinct_stripped(inline_code(c)), distinct_stripped(quoted_spans(c)), distinct_stripped(path_mentions(c)), replacement_pairs(c)
    parts = F.flatten(F.transform(paths, path_parts))
    if mode == "expanded":
        spans = lambda label, a: F.when(F.size(a) > 0, F.concat_ws(" ", F.lit(label), F.array_join(F.transform(a, F.lower), " "), F.lit(label + "_tokens"), F.array_join(tokenize_retrieval(F.array_join(F.transform(a, F.lower), " ")), " ")))
        swap = F.transform(pairs, lambda p: F.concat_ws(" ", F.lit("replace"), F.lower(p["old"]), F.lit("with"), F.lower(p["new"]), F.array_join(tokenize_retrieval(F.concat_ws(" ", p["old"], p["new"])), " ")))
        out = F.concat_ws(" ", F.when(base != "", base), spans("inline", inline), spans("quoted", quoted), labelled("paths", paths), F.when(F.size(paths) > 0, F.concat(F.lit("path_parts "), F.array_join(parts, " "))), F.when(F.size(pairs) > 0, F.array_join(swap, " ")), F.when(F.size(review_intent_hints(c)) > 0, F.array_join(review_intent_hints(c), " ")))
        return strip(out)
    distinct_parts = F.array_distinct(parts)
    focus, target = filtered_terms(base), F.array_distinct(terms_of(F.concat(inline, quoted)))
    if mode == "procedural":
        swaps = F.flatten(F.transform(pairs, lambda p: F.concat(filtered_terms(p["old"]), filtered_terms(p["new"]), F.array(F.lit("replace")))))
        action = F.array_distinct(F.concat(swaps, terms_of(review_intent_hints(c))))
        out = F.concat_ws(" ", labelled("focus", focus), labelled("targets", target), labelled("paths", paths), labelled("path_parts", distinct_parts), labelled("actions", action))
        return F.when(out != "", strip(out)).otherwise(query_text(c, "expanded"))
    if mode == "intent_expanded":
        swaps = F.transform(pairs, lambda p: F.concat_ws(" ", F.lit("replace"), F.lower(p["old"]), F.lit("with"), F.lower(p["new"]), F.lit("rename"), F.lower(p["old"]), F.lower(p["new"])))
        swapped = F.array_distinct(F.flatten(F.transform(pairs, lambda p: filtered_terms(F.concat_ws(" ", p["old"], p["new"])))))
        more = F.concat(review_intent_hints(c), intent_expansion_hints(c))
        out = F.concat_ws(" ", F.when(base != "", base), labelled("focus", focus), labelled("symbols", target), labelled("paths", paths), labelled("path_parts", distinct_parts), F.when(F.size(pairs) > 0, F.array_join(swaps, " ")), labelled("replacement_terms", swapped), F.when(F.size(more) > 0, F.array_join(more, " ")))
        return strip(out)
    raise ValueError(f"Unsupported semantic query mode: {mode}")


def context_text(c: Column, mode: str = "full") -> Column:
    """A candidate's text for retrieval: its path, the path's parts and its lines, without markers."""
    path = context_path(c)
    if mode == "full":
        body = non_empty(F.transform(F.filter(lines(c), lambda x: ~is_marker(x)), normalize_line))
    elif mode == "path_plus_diff":
        body = F.concat(F.array_sort(added_lines(c)), F.array_sort(removed_lines(c)))
    else:
        raise ValueError(f"Unsupported semantic context mode: {mode}")
    some = lambda x: F.when(x != "", x)
    out = F.concat_ws(" ", some(F.lower(path)), some(F.array_join(path_parts(path), " ")), some(F.array_join(body, " ")))
    return F.when(out != "", out).otherwise(F.lower(c))


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(none_if_null(c)), r"\\", "/"), "^[ab]/", "")


def normalize_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def hunk_header(c: Column) -> Column:
    """struct<old_start, old_count, new_start, new_count>, or null for a malformed header; a missing count is 1, a given 0 stays 0."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda k: F.regexp_extract(strip(c), pattern, k)
    count = lambda k: F.when(part(k) == "", F.lit(1)).otherwise(part(k).try_cast("int"))
    start = lambda k: part(k).try_cast("int")
    return F.when(strip(c).rlike(pattern), F.struct(start(1).alias("old_start"), count(2).alias("old_count"), start(3).alias("new_start"), count(4).alias("new_count")))


def context_id_parts(c: Column) -> Column:
    """struct<path, hunk> of ids like path::hunk_3, null for others."""
    pattern = r"^(.+)::hunk_(\d+)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("path"), F.regexp_extract(c, pattern, 2).cast("int").alias("hunk")))


def group_key(repo: Column, pull: Column, instance: Column) -> Column:
    """repo::pr_N where both are known, else instance::id."""
    return F.when((none_if_null(repo) != "") & pull.isNotNull(), F.concat(repo, F.lit("::pr_"), pull.cast("string"))).otherwise(F.concat(F.lit("instance::"), none_if_null(instance)))


def attribute(c: Column) -> Column:
    """Stripped, with blank and null as 'unknown'."""
    return F.when(strip(none_if_null(c)) != "", strip(c)).otherwise(F.lit("unknown"))


def language_of_path(c: Column) -> Column:
    """Language by extension; an unknown extension is itself, none is 'unknown'."""
    ext = F.lower(F.regexp_extract(none_if_null(c), r"[^/](\.[^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in words.LANGUAGES.items() for x in kv])
    return F.when(ext.isin("", "."), F.lit("unknown")).otherwise(F.coalesce(F.try_element_at(table, ext), ext))


def metric_context(attributes: Column) -> Column:
    """A sentence of the structural attributes (a map) that say something."""
    value = lambda k: F.coalesce(F.try_element_at(attributes, F.lit(k)), F.lit(""))
    out = F.concat_ws("; ", *[F.when(~value(k).isin("", "0", "-1", "-5"), F.concat(F.lit(f"{label}: "), value(k))) for k, label in words.ATTRIBUTE_LABELS.items()])
    return F.when(out != "", out).otherwise(F.lit(words.NO_ATTRIBUTES))


def prefixed(c: Column, prefix: str = "") -> Column:
    """Stripped text for an encoder, after a prefix if there is one."""
    return F.concat(F.lit(prefix.strip() + " " if prefix.strip() else ""), strip(c))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the values' JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
