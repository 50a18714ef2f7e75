"""Text functions against Python's own string functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T

ALPHABET = ["a", "B", "fooBar", "HTTPServer", "_x2", "é", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1e", "\x85", " ", "\xa0", " ", "+", "-", "@@ ", "path: ", "`", "``", "```py", '"', "'", "->", "=>", "src/a.py", "e.g", "7", "suggestion", "rename"]


def texts(n=400, seed=1):
    rnd = random.Random(seed)
    return ["", "\n", " \x1c "] + ["".join(rnd.choices(ALPHABET, k=rnd.randint(1, 25))) for _ in range(n)]


def run(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def normal(line):
    line = re.sub("```[A-Za-z0-9_+-]*", "", line.strip())
    return re.sub(r"\s+", " ", re.sub(r"^[+\- ]+", "", line)).strip().lower()


def parts(token):
    return [p.lower() for chunk in token.replace("-", "_").split("_") if chunk for p in re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", chunk).split()]


def retrieval(t):
    return [x for w in re.findall("[A-Za-z_][A-Za-z0-9_]*", t) for x in [w.lower(), *[p for p in parts(w) if p != w.lower()]]]


@pytest.mark.parametrize(
    "column, expected",
    [
        (T.strip, lambda t: t.strip()),
        (T.lines, lambda t: t.splitlines()),
        (T.split_words, lambda t: t.split()),
        (T.normalize_line, normal),
        (T.tokenize_retrieval, retrieval),
        (T.meaningful_lines, lambda t: list(dict.fromkeys(x for x in map(normal, t.splitlines()) if x))),
        (T.inline_code, lambda t: [m.strip() for m in re.findall("`([^`]+)`", t) if m.strip()]),
        (T.path_mentions, lambda t: [m.lower() for m in re.findall(r"[A-Za-z0-9_./-]+\.[A-Za-z0-9_]+", t)]),
        (T.path_parts, lambda t: [p.lower() for p in re.split("[/._-]+", t) if p]),
        (T.normalize_label, lambda t: re.sub("[^a-z0-9]+", "_", t.lower()).strip("_")),
    ],
)
def test_like_python(spark, column, expected):
    values = texts()
    for t, got in zip(values, run(spark, values, column)):
        assert got == expected(t), repr(t)


def spans(t):
    found = lambda p: [m.strip() for m in re.findall(p, t) if m.strip()]
    code = [m for m in found("'([^'\n]{1,120})'") if len(m) > 1 and (re.search(r"[A-Z_./()\-]", m) or " " not in m)]
    return list(dict.fromkeys(found("`([^`]+)`") + found("``([^`\n]{1,120})``") + found('"([^"\n]{1,120})"') + code))


def test_spans_and_pairs(spark):
    c = "see `fooBar` or \"quoted text\" not 'plain words' but 'x_y'; `a` -> `b`, 'old' => 'new'"
    assert run(spark, [c], T.quoted_spans)[0] == ["fooBar", "a", "b", "quoted text", "x_y", "old", "new"]
    values = [c, "``two words`` and `one`", *texts(seed=9)]
    for t, got in zip(values, run(spark, values, T.quoted_spans)):
        assert got == spans(t), repr(t)
    assert [(p.old, p.new) for p in run(spark, [c], T.replacement_pairs)[0]] == [("a", "b"), ("old", "new")]


def test_changed_lines_and_path(spark):
    t = "path: src/App.py\n@@ -1 +1 @@\n+ Added  Line\n-gone\n--- a/x\n+++ b/x\n same\n+Added line"
    assert run(spark, [t], T.added_lines)[0] == ["added line"]
    assert run(spark, [t], T.removed_lines)[0] == ["gone"]
    assert run(spark, [t], T.context_path)[0] == "src/App.py"
    assert run(spark, [t], lambda c: T.context_text(c, "path_plus_diff"))[0] == "src/app.py src app py added line gone"
    assert run(spark, ["", "x"], T.context_text) == ["", "x"]


def test_query_modes(spark):
    c = "Please rename `fooBar` to \"HTTPServer\" in src/app.py"
    assert run(spark, [c], T.query_text)[0] == c.lower()
    expanded = run(spark, [c], lambda x: T.query_text(x, "expanded"))[0]
    assert expanded == "please rename `foobar` to \"httpserver\" in src/app.py inline foobar inline_tokens foobar quoted foobar httpserver quoted_tokens foobar httpserver paths src/app.py path_parts src app py rename naming identifier"
    procedural = run(spark, [c], lambda x: T.query_text(x, "procedural"))[0]
    assert procedural == "focus rename foobar httpserver src app py targets foobar foo bar httpserver paths src/app.py path_parts src app py actions rename naming identifier"
    intent = run(spark, [c], lambda x: T.query_text(x, "intent_expanded"))[0]
    assert intent.endswith("symbols foobar foo bar httpserver paths src/app.py path_parts src app py rename naming identifier intent rename naming identifier symbol variable function class api")
    with pytest.raises(ValueError):
        T.query_text(F.col("t"), "other")


def test_headers_ids_and_keys(spark):
    got = run(spark, ["@@ -10,0 +10,3 @@", "@@ -10 +10,0 @@ def f", "@@ bad"], T.hunk_header)
    assert [tuple(g) if g else None for g in got] == [(10, 0, 10, 3), (10, 1, 10, 0), None]
    assert [tuple(g) if g else None for g in run(spark, ["a::b::hunk_12", "x"], T.context_id_parts)] == [("a::b", 12), None]
    assert run(spark, ["a.py", "b/c.TSX", "noext", "x.zig", "a.b/c", ""], T.language_of_path) == ["Python", "TypeScript", "unknown", ".zig", "unknown", "unknown"]
    assert run(spark, [" b/x\\y ", "a/q", "c"], T.normalize_path) == ["x/y", "q", "c"]
    assert run(spark, ["  ", "r "], T.attribute) == ["unknown", "r"]
    assert run(spark, ["@dev: fix\n@Author: me", "keep"], T.clean_review) == ["fix", "keep"]
