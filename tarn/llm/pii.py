"""Personal data by boosting over span candidates, in DataFrame and SQL functions alone.

Generators with high recall propose spans: the four base kinds by their patterns, and looser forms (numbers without
a country code, in any groups, spelled-out addresses, card numbers with a wrong check digit, IPv6) that may overlap them. Boosted
trees score every loose candidate by its format and its context, and thresholds calibrated per generator select.
The trees are trained on a generated, labelled set and become one SQL expression, so all rows stay in the JVM.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Base kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

# Equal to the contract's patterns in what they match, but without repeated groups, which recurse for every repeat,
# and without starts in the middle of a run, which make the time grow with the square of the run's length.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Over a text in which separators that follow one another have been replaced; shorter runs hold too few digits.
CARD = r"[0-9][0-9\x20-]{10,}[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DOUBLE_SEPARATOR = r"(?<=[\x20-])[\x20-]|[\x20-](?=[\x20-])"

# loose generators: name -> (kind, pattern, test that a text needs to pass first)
LOOSE = {
    "national": ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "spelled": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z]{2,8}(?![A-Za-z0-9])", r"[\[(\x20]at[\])\x20]"),
    "unchecked": ("card", CARD, CARD),
    "grouped": ("phone", r"(?<![0-9A-Za-z+.,:/-])(?:\(0?[0-9]{1,4}\)[\x20/]?)?[0-9]{2,5}(?:[\x20./-][0-9]{2,8}){1,4}(?![0-9A-Za-z])", r"[0-9]{2}[\x20./)-][0-9]{2}"),
    "ipv6": ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
}

WORDS = {
    "phone": r"(?:phone|tel|mobile|call|fax|whatsapp|sms|handy|m[oó]vil|t[eé]l[eé]fono?|rufnummer|appelez)[^a-z]{0,6}[a-z]{0,4}[^a-z]{0,4}$",
    "mail": r"(?:mail|contact|write|reach|schreib|correo|courriel|adresse|address)[^a-z]{0,6}[a-z]{0,4}[^a-z]{0,4}$",
    "card": r"(?:card|visa|mastercard|credit|debit|amex|karte|carte|tarjeta|payment)[^a-z]{0,6}[a-z]{0,7}[^a-z]{0,4}$",
    "host": r"(?:\bip|ipv6|host|server|client|address|addr)[^a-z]{0,6}[a-z]{0,4}[^a-z]{0,4}$",
    "other": r"(?:order|invoice|version|isbn|issn|ref|serial|page|item|sku|ticket|tracking|case|build|part|lot|batch|id|no|nr|#)[^a-z]{0,4}$",
}
FEATURES = ("generator", "digits", "chars", "seps", "luhn", "w_phone", "w_mail", "w_card", "w_host", "w_other", "near_before", "near_after", "paren", "brackets", "first_digit")

TREES, DEPTH, RATE = 25, 3, 0.3
#: Share of the redactions that must be right in the calibration part, for each generator.
PRECISION = 0.98
TRAIN_SEED = 5
TRAIN_TEXTS = 1200
BLOCK = 256
#: Code points of the pieces that a text with spans is cut into before it is put together again.
CUT = 512


def sums(lens: str) -> str:
    """SQL for the running sums of an int array, in blocks, so that appending does not copy all that came before."""
    grow = "cast(array() as array<int>), (a, x) -> concat(a, array(coalesce(try_element_at(a, -1), 0) + x))"
    blocks = f"transform(sequence(0, (size({lens}) - 1) div {BLOCK}), b -> aggregate(slice({lens}, b * {BLOCK} + 1, {BLOCK}), {grow}))"
    ends = f"concat(array(0), aggregate(transform({blocks}, v -> element_at(v, -1)), {grow}))"
    long = f"flatten(zip_with({blocks}, slice({ends}, 1, (size({lens}) - 1) div {BLOCK} + 1), (v, o) -> transform(v, y -> y + o)))"
    return f"case when size({lens}) = 0 then cast(array() as array<int>) when size({lens}) <= {BLOCK} then aggregate({lens}, {grow}) else {long} end"


def reach(values: str) -> str:
    """SQL for the running maxima of an int array, in blocks like those of the running sums."""
    grow = "cast(array() as array<int>), (a, x) -> concat(a, array(greatest(coalesce(try_element_at(a, -1), x), x)))"
    blocks = f"transform(sequence(0, (size({values}) - 1) div {BLOCK}), b -> aggregate(slice({values}, b * {BLOCK} + 1, {BLOCK}), {grow}))"
    ends = f"concat(array(-2147483648), aggregate(transform({blocks}, v -> element_at(v, -1)), {grow}))"
    long = f"flatten(zip_with({blocks}, slice({ends}, 1, (size({values}) - 1) div {BLOCK} + 1), (v, o) -> transform(v, y -> greatest(y, o))))"
    return f"case when size({values}) = 0 then cast(array() as array<int>) when size({values}) <= {BLOCK} then aggregate({values}, {grow}) else {long} end"


def unions(df: DataFrame, spans: str, out: str) -> DataFrame:
    """df with `out`: the spans (an array of structs with start and stop, sorted by start) in runs that overlap, each an array.

    A run goes on while a span starts before the largest stop so far; so every span is in one run, in time that grows with their number."""
    df = df.withColumn(f"{out}_r", F.expr(f"transform({spans}, x -> x.stop)"))
    df = df.withColumn(f"{out}_r", F.expr(reach(f"{out}_r")))
    none = "cast(array() as array<int>)"
    begins = let("filter(sequence(0, size(v.s) - 1), i -> i = 0 or get(v.s, i).start >= get(v.r, i - 1))", s=spans, r=f"{out}_r")
    df = df.withColumn(f"{out}_b", F.expr(f"case when size({spans}) = 0 then {none} else {begins} end"))
    runs = let("transform(v.b, (b, k) -> slice(v.s, b + 1, coalesce(get(v.b, k + 1), size(v.s)) - b))", b=f"{out}_b", s=spans)
    return df.withColumn(out, F.expr(runs)).drop(f"{out}_r", f"{out}_b")


def free_of(df: DataFrame, spans: str, base: str, out: str) -> DataFrame:
    """df with `out`: those of the spans that overlap no base span; all are structs with start and stop.

    Both kinds are sorted by start together. A span is free if no base span before it reaches beyond its start and the
    next base span after it starts at its stop or later, which two running maxima tell."""
    df = df.withColumn(f"{out}_a", F.expr(f"case when size({spans}) = 0 then null else sort_array(concat(transform({base}, b -> named_struct('start', b.start, 'i', -1, 'stop', b.stop)), transform({spans}, (x, i) -> named_struct('start', x.start, 'i', i, 'stop', x.stop)))) end"))
    df = df.withColumn(f"{out}_l", F.expr(f"transform({out}_a, x -> case when x.i < 0 then x.stop else -1 end)")).withColumn(f"{out}_l", F.expr(reach(f"{out}_l")))
    df = df.withColumn(f"{out}_h", F.expr(f"reverse(transform({out}_a, x -> case when x.i < 0 then -x.start else -2147483647 end))")).withColumn(f"{out}_h", F.expr(f"reverse({reach(f'{out}_h')})"))
    fine = let("transform(filter(v.a, (x, k) -> x.i >= 0 and get(v.l, k) <= x.start and -get(v.h, k) >= x.stop), x -> get(v.s, x.i))", a=f"{out}_a", l=f"{out}_l", h=f"{out}_h", s=spans)
    return df.withColumn(out, F.expr(f"case when size({spans}) = 0 then {spans} else {fine} end")).drop(f"{out}_a", f"{out}_l", f"{out}_h")


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def let(body: str, **values: str) -> str:
    """SQL of the body, in which v.name stands for a value that is computed once.

    An array that a lambda looks into by place would otherwise be computed again for each element, as Spark puts the
    expressions of columns that are used once into those that use them."""
    return f"get(transform(array(named_struct({', '.join(f"'{k}', {x}" for k, x in values.items())})), v -> {body}), 0)"


def found(df: DataFrame, name: str, text: str, pattern: str, test: str) -> DataFrame:
    """df with the column `name`: array<struct<m, before, after, start>> of the pattern's matches in the column text,
    for texts that pass the test (a SQL condition). start counts code points; before and after are the texts between matches."""
    none = "cast(array() as array<string>)"
    df = df.withColumn(f"{name}_m", F.expr(f"case when {test} then regexp_extract_all({text}, {quoted(pattern)}, 0) else {none} end"))
    df = df.withColumn(f"{name}_p", F.expr(f"case when size({name}_m) > 0 then split({text}, {quoted(pattern)}, -1) else {none} end"))
    lengths = let("transform(v.m, (x, i) -> length(get(v.p, i)) + coalesce(length(get(v.m, i - 1)), 0))", m=f"{name}_m", p=f"{name}_p")
    df = df.withColumn(f"{name}_l", F.expr(f"case when size({name}_m) > 0 then {lengths} else cast(array() as array<int>) end"))
    df = df.withColumn(f"{name}_s", F.expr(sums(f"{name}_l")))
    zipped = let("transform(v.m, (x, i) -> named_struct('m', x, 'before', right(get(v.p, i), 40), 'after', left(get(v.p, i + 1), 4), 'start', get(v.s, i)))", m=f"{name}_m", p=f"{name}_p", s=f"{name}_s")
    empty = "cast(array() as array<struct<m: string, before: string, after: string, start: int>>)"
    return df.withColumn(name, F.expr(f"case when size({name}_m) > 0 then {zipped} else {empty} end")).drop(*[f"{name}_{x}" for x in "mpls"])


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(x: str) -> str:
    """SQL: the digits of x pass the check."""
    d = f"reverse({digits(x)})"
    value = f"transform(split({d}, ''), (c, i) -> case when c = '' then 0 when i % 2 = 0 then cast(c as int) when c >= '5' then 2 * cast(c as int) - 9 else 2 * cast(c as int) end)"
    return f"(aggregate({value}, 0, (a, v) -> a + v) % 10 = 0)"


PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
VALID = {
    "email": "true",
    "ip": rf"x.m rlike r'^{PART}\.{PART}\.{PART}\.{PART}$'",
    "card": f"length({digits('x.m')}) between 12 and 19 and {luhn('x.m')}",
    "phone": f"length({digits('x.m')}) between 9 and 15",
}


def base_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, t and one array column per base kind, with all matches of its pattern."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    df = found(df, "email", "t", EMAIL, "contains(t, '@')")
    df = found(df, "ip", "t", IP, r"t rlike r'[0-9]\.[0-9]+\.[0-9]'")
    df = df.withColumn("long_run", F.col("t").rlike(CARD))
    df = df.withColumn("ct", F.expr(f"case when long_run then regexp_replace(t, {quoted(DOUBLE_SEPARATOR)}, 'x') else '' end"))
    df = found(df, "card", "ct", CARD, "long_run")
    df = found(df, "phone", "t", PHONE, "contains(t, '+')")
    return df


def feature_sql(generator: int, x: str) -> dict[str, str]:
    low = f"lower({x}.before)"
    out = {
        "generator": str(generator),
        "digits": f"length({digits(f'{x}.m')})",
        "chars": f"length({x}.m)",
        "seps": rf"length(regexp_replace({x}.m, r'[^\x20().:-]', ''))",
        "luhn": f"int({luhn(f'{x}.m')})" if generator == list(LOOSE).index("unchecked") else "0",
        "near_before": rf"int({x}.before rlike r'[0-9A-Za-z$€£#/=]$')",
        "near_after": rf"int({x}.after rlike r'^[0-9A-Za-z%€/=]')",
        "paren": f"int(contains({x}.m, '('))",
        "brackets": rf"int({x}.m rlike r'[\[(](at|dot)[\])]')",
        "first_digit": f"coalesce(try_cast(substring({digits(f'{x}.m')}, 1, 1) as int), -1)",
    } | {f"w_{k}": f"int({low} rlike {quoted(v)})" for k, v in WORDS.items()}
    return {k: out[k] for k in FEATURES}


def loose_candidates(df: DataFrame) -> DataFrame:
    """df of base_candidates with `loose`: array<struct<kind, start, stop, f array<double>>> of all loose generators."""
    parts = []
    for i, (name, (kind, pattern, test)) in enumerate(LOOSE.items()):
        if name == "unchecked":
            source, keep = "card", f"not ({VALID['card']}) and length({digits('x.m')}) between 13 and 19"
        else:
            df = found(df, source := f"c_{name}", "t", pattern, f"t rlike {quoted(test)}")
            keep = f"length({digits('x.m')}) between 8 and 12" if name == "grouped" else "true"
        f = ", ".join(f"cast({v} as double)" for v in feature_sql(i, "x").values())
        parts.append(f"transform(filter({source}, x -> {keep}), x -> named_struct('kind', {KINDS.index(kind)}, 'start', x.start, 'stop', x.start + length(x.m), 'f', array({f})))")
    return df.withColumn("loose", F.expr(f"concat({', '.join(parts)})"))


@dataclass
class Tree:
    feature: int
    cut: float
    low: Tree | float
    high: Tree | float

    def sql(self, f: str) -> str:
        low, high = (x.sql(f) if isinstance(x, Tree) else f"{x!r}D" for x in (self.low, self.high))
        return f"case when get({f}, {self.feature}) <= {self.cut!r}D then {low} else {high} end"

    def value(self, x: np.ndarray) -> np.ndarray:
        low, high = (v.value(x) if isinstance(v, Tree) else np.full(len(x), v) for v in (self.low, self.high))
        return np.where(x[:, self.feature] <= self.cut, low, high)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree | float:
    """The tree that lowers the logistic loss most in second order; leaves are shrunk by RATE."""
    leaf = lambda m: float(RATE * g[m].sum() / (h[m].sum() + 1.0))
    every, best = np.ones(len(x), bool), (1e-6, None, None)
    total = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1] if depth else 0):
        values = np.unique(x[:, j])
        for cut in ((values[1:] + values[:-1]) / 2)[:64]:
            m = x[:, j] <= cut
            if 3 <= m.sum() <= len(x) - 3:
                gain = g[m].sum() ** 2 / (h[m].sum() + 1.0) + g[~m].sum() ** 2 / (h[~m].sum() + 1.0) - total
                if gain > best[0]:
                    best = (gain, j, float(cut))
    if best[1] is None:
        return leaf(every)
    m = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(x[m], g[m], h[m], depth - 1), grow(x[~m], g[~m], h[~m], depth - 1))


@dataclass
class Model:
    start: float
    trees: list[Tree | float]
    thresholds: list[float]  # per generator, on the sum of the trees; infinite where none is precise enough

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(t.value(x) if isinstance(t, Tree) else np.full(len(x), t) for t in self.trees)

    def sql(self, f: str) -> str:
        return f"({self.start!r}D + " + " + ".join(t.sql(f) if isinstance(t, Tree) else f"{t!r}D" for t in self.trees) + ")"

    def accepts(self, f: str) -> str:
        cuts = ", ".join("double('infinity')" if not np.isfinite(t) else f"{t!r}D" for t in self.thresholds)
        return f"{self.sql(f)} > get(array({cuts}), cast(get({f}, 0) as int))"


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees on the even rows; on the odd ones, the lowest threshold per generator that reaches PRECISION."""
    fit_on = np.arange(len(x)) % 2 == 0
    p = min(max(y[fit_on].mean(), 1e-3), 1 - 1e-3)
    model = Model(float(np.log(p / (1 - p))), [], [])
    margin = np.full(int(fit_on.sum()), model.start)
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        model.trees.append(t := grow(x[fit_on], y[fit_on] - q, q * (1 - q), DEPTH))
        margin = margin + (t.value(x[fit_on]) if isinstance(t, Tree) else t)
    held = model.margin(x)
    for i in range(len(LOOSE)):
        own = ~fit_on & (x[:, 0] == i)
        cuts = [c for c in np.unique(held[own]) if y[own & (held >= c)].mean() >= PRECISION]
        model.thresholds.append(float(min(cuts)) - 1e-9 if cuts else float("inf"))
    return model


def training_texts(n: int = TRAIN_TEXTS, seed: int = TRAIN_SEED) -> list[tuple[str, int]]:
    """Generated texts with one loose candidate each, and whether it is personal data."""
    rnd, out = random.Random(seed), []
    d = lambda k: "".join(rnd.choices("0123456789", k=k))
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 9)))
    said = {"phone": ("phone", "tel", "call", "mobile", "fax", "Tel.", "phone number", "téléphone", "teléfono", "Telefon"), "mail": ("mail", "e-mail", "contact", "write to", "reach me", "courriel"), "card": ("card", "visa", "credit card", "card number", "payment card"), "host": ("ip", "host", "server", "address", "client")}
    said["groups"] = said["phone"]
    other = ("order", "invoice", "version", "ISBN", "ref", "serial", "page", "item", "ticket", "tracking", "case no", "batch", "id")
    for _ in range(n):
        kind, real = rnd.choice(("phone", "mail", "card", "host", "groups")), rnd.random() < 0.5
        if kind == "phone":
            a, b, c, s = str(rnd.randint(2, 9)) + d(2), d(3), d(4), rnd.choice(" .-")
            m = rnd.choice((f"({a}) {b}{s}{c}", f"{a}{s}{b}{s}{c}"))
        elif kind == "groups":
            s = rnd.choice(("  ", " ", " ", ".", "-"))[-1]
            sizes = rnd.choice(((2, 2, 2, 2, 2), (4, 7), (3, 3, 3), (5, 6), (3, 2, 2, 2), (4, 3, 4), (2, 4, 4)) if real else ((4, 2, 2), (2, 2, 4), (4, 4), (3, 3, 3), (2, 3, 3), (5, 5), (3, 4, 3), (2, 2, 2, 2, 2), (2, 5, 3)))
            m = s.join(d(k) for k in sizes)
            m = f"0{m[1:]}" if real and rnd.random() < 0.6 else m
        elif kind == "mail":
            at, dot = rnd.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" at ", " dot "))) if real else (" at ", rnd.choice((".", ". ")))
            m = f"{word()}{rnd.choice(('.', '_', ''))}{word()}{at}{word()}{dot}{rnd.choice(('com', 'org', 'net', 'de') if real else (word()[:8],))}"
        elif kind == "card":
            m = rnd.choice((f"{rnd.choice('3456' if real else '0123456789')}{d(15)}", f"{rnd.choice('3456' if real else '0123456789')}{d(3)} {d(4)} {d(4)} {d(4)}", d(rnd.randint(13, 19))))
        else:
            m = ":".join("".join(rnd.choices("0123456789abcdef", k=rnd.randint(1, 4))) for _ in range(8))
        sure = kind in ("host",) or (kind == "mail" and real)
        lead = rnd.choice(said[kind]) if real and not (sure and rnd.random() < 0.5) else rnd.choice(other) if rnd.random() < 0.6 else word()
        if kind == "host":
            real, lead = (True, lead) if rnd.random() < 0.9 else (False, "fingerprint")
        if kind == "groups" and not real and rnd.random() < 0.5:
            lead = word()
        tail = rnd.choice(("", " ", ". ", ", ")) if real or rnd.random() < 0.7 else rnd.choice(("%", "/", "="))
        pre = rnd.choice((" ", ": ", " = ", " no. ")) if real or rnd.random() < 0.7 else rnd.choice(("=", "#", "/", "$"))
        out.append((f"{word()} {word()} {lead}{pre}{m}{tail}{'' if tail and tail in '%/=' else ' '}{word()}", int(real)))
    return out


_MODELS: dict[tuple[int, int], Model] = {}


def trained(spark: SparkSession) -> Model:
    """The model, trained once in a process: candidates and features of the generated texts come from the same SQL as all others."""
    key = (TRAIN_TEXTS, TRAIN_SEED)
    if key not in _MODELS:
        texts = training_texts()
        rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t, _ in texts])).alias("doc_id", "text"))
        got = loose_candidates(base_candidates(rows)).select("doc_id", F.explode("loose.f").alias("f")).orderBy("doc_id", "f").collect()
        _MODELS[key] = fit(np.array([r["f"] for r in got], float), np.array([texts[r["doc_id"]][1] for r in got], float))
    return _MODELS[key]


@lru_cache(maxsize=1)
def listed() -> str:
    return "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def joined(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, s -> concat(get({listed()}, s.kind), ':', s.start, ':', s.stop)))"


def find_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, base and spans of every row of docs: arrays of struct<start, kind, stop>, sorted; kind indexes KINDS.

    base are the matches of the four patterns that hold; spans adds the selected loose candidates that overlap no
    base span. Loose ones that overlap each other are one span, of the kind with the highest score (then the earlier start),
    so that nothing that was selected is left out. Null texts are empty; whole texts are searched, in time that grows with their length; repeated rows each give a row; other
    columns of docs are not looked at.
    """
    model = model or trained(docs.sparkSession)
    df = loose_candidates(base_candidates(docs))
    for i, k in enumerate(KINDS):
        df = df.withColumn(f"b_{k}", F.expr(f"transform(filter({k}, x -> {VALID[k]}), x -> named_struct('start', x.start, 'kind', {i}, 'stop', x.start + length(x.m)))"))
    df = df.withColumn("base", F.expr(f"sort_array(concat({', '.join(f'b_{k}' for k in KINDS)}))"))
    df = df.withColumn("likely", F.expr(f"filter(loose, x -> {model.accepts('x.f')})"))
    df = df.withColumn("scored", F.expr(f"case when size(likely) = 0 then cast(array() as array<struct<start: int, kind: int, stop: int, score: double>>) else transform(likely, x -> named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop, 'score', {model.sql('x.f')})) end"))
    df = unions(free_of(df, "scored", "base", "free").withColumn("free", F.expr("sort_array(free)")), "free", "runs")
    best = "array_max(transform(r, x -> named_struct('score', x.score, 'start', -x.start, 'kind', x.kind))).kind"
    df = df.withColumn("extra", F.expr(f"transform(runs, r -> named_struct('start', get(r, 0).start, 'kind', {best}, 'stop', array_max(transform(r, x -> x.stop))))"))
    return df.select("doc_id", "base", F.expr("case when size(extra) = 0 then base else sort_array(concat(base, extra)) end").alias("spans"))


def report(found_spans: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found_spans.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))


def blocks_of(text: str) -> str:
    """SQL: the text in pieces of CUT code points, cut in two steps, as reaching a place in a text takes time that grows with the place."""
    cut = lambda x, n: f"transform(sequence(0, greatest(length({x}) - 1, 0) div {n}), i -> substring({x}, i * {n} + 1, {n}))"
    return f"flatten(transform({cut(text, CUT * CUT)}, big -> {cut('big', CUT)}))"


def between(a: str, b: str) -> str:
    """SQL: the code points from place a to before place b, out of v.blocks."""
    one = f"substring(get(v.blocks, {a} div {CUT}), {a} % {CUT} + 1, {b} - {a})"
    several = f"concat(substring(get(v.blocks, {a} div {CUT}), {a} % {CUT} + 1), array_join(slice(v.blocks, {a} div {CUT} + 2, {b} div {CUT} - {a} div {CUT} - 1), ''), substring(coalesce(get(v.blocks, cast({b} div {CUT} as int)), ''), 1, {b} % {CUT}))"
    return f"case when {b} <= {a} then '' when {a} div {CUT} = {b} div {CUT} then {one} else {several} end"


def redacted(docs: DataFrame, model: Model | None = None, mask: str = "[{}]") -> DataFrame:
    """The rows of docs with every span in the text replaced by its kind's name; all columns stay.

    Spans that overlap are one, with the name of the first. Texts without spans, null ones too, stay as they are.
    Later conditions on the text are cheap to plan: the optimizer doesn't see through the result.
    """
    rows = docs.select(F.struct("*").alias("row"), F.struct("*").alias("doc_id"), F.col("text"))
    got = find_spans(rows.select("doc_id", "text"), model).select(F.col("doc_id").alias("row"), "spans")
    got = unions(got, "spans", "groups")
    got = got.withColumn("runs", F.expr("transform(groups, r -> named_struct('start', get(r, 0).start, 'kind', get(r, 0).kind, 'stop', array_max(transform(r, x -> x.stop))))"))
    names = "array(" + ", ".join(f"'{mask.format(k)}'" for k in KINDS) + ")"
    got = got.withColumn("blocks", F.expr(f"case when size(runs) > 0 then {blocks_of('row.text')} end"))
    pieces = f"transform(v.runs, (s, i) -> concat({between('coalesce(get(v.runs, i - 1).stop, 0)', 's.start')}, get({names}, s.kind)))"
    rest = between("element_at(v.runs, -1).stop", "length(v.t)")
    whole = let(f"concat(array_join({pieces}, ''), {rest})", runs="runs", blocks="blocks", t="row.text")
    text = F.expr(f"case when size(runs) = 0 then row.text else {whole} end")
    done = F.struct(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    # a generator is a barrier: a later condition on the text isn't pushed into the one large expression that makes it
    return got.select(F.explode(F.array(done)).alias("row")).select("row.*")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_spans(table(spark, sf_dir, "documents")))
