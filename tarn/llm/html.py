"""Main text of web pages by a tree-structured graphical model.

A page's DOM is a tree of block elements with the text blocks as leaves. Every node has a hidden label, content or
not; its own features give a potential, and each parent-child pair another. Sum-product message passing, upward and
then downward, yields every node's exact marginal, and the text blocks that are likely content are the text. The
potentials are trained on labelled pages by the gradient of the likelihood, which the same message passing gives.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pagephrases import NAMES, PHRASES, PLAIN, REMARKS

TRAIN_PAGES = 800
TRAIN_SEED = 11
STEPS = 250
PENALTY = 1e-4
#: Of the features of words: few blocks have each, and most pairs of words mean nothing.
WORD_PENALTY = 1e-3
#: Pages whose trees are passed over together.
BATCH = 64
SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is dropped unread, up to their end tag.
RAW = frozenset("script style textarea title iframe noembed xmp".split())
#: Elements that are dropped with all in them, up to their end tag or their parent's.
DROPPED = frozenset("noscript template svg object canvas audio video annotation annotation-xml".split())
#: A start tag of any other element, or text, ends head.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that hold no blocks: a block's start tag closes them.
CHOICES = ("select", "datalist", "optgroup", "option")
#: Elements of forms and head: nothing in them is text of the page. A label outside a form is inline text.
MUTE = frozenset("button select option optgroup datalist label legend input head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mspace mpadded mphantom merror menclose mfenced semantics".split())
#: A start tag of one of these closes an open p.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt td th tr body".split())
#: A start tag closes an open element of the same set, up to the container named.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|aria-label|data-y|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
TAG = re.compile(r"[A-Za-z][^\s/>]*")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Stems of class, id and role names that stand for a part of a page.
STEMS = {
    "nav": ("nav", "menu", "breadcrumb", "crumb", "toc", "pagination", "pager", "tabs", "skip", "toolbar"),
    "head": ("header", "masthead", "topbar", "logo", "branding", "banner", "hero"),
    "foot": ("footer", "foot", "colophon", "copyright", "legal", "bottom", "contentinfo"),
    "side": ("sidebar", "aside", "widget", "rail", "complementary", "column", "secondary", "tagcloud", "archive"),
    "ad": ("ad", "ads", "adv", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "promoted", "banner", "outbrain", "taboola", "dfp", "affiliate"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "privacy", "dialog", "toast", "announcement", "disclaimer", "warning"),
    "comment": ("comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "feedback", "reader", "readers", "reviews", "response", "responses"),
    "social": ("share", "sharing", "social", "follow", "like", "tweet", "facebook", "addthis", "related", "recommended", "recommend", "more", "popular", "trending", "tags", "rating", "vote"),
    "form": ("form", "search", "login", "register", "input", "field", "contact"),
    "body": ("article", "content", "post", "entry", "story", "main", "text", "body", "prose", "page", "blog", "news", "articlebody"),
    "meta": ("meta", "byline", "author", "date", "published", "info", "caption", "credit"),
}
STEM_OF = {}
for _group, _words in STEMS.items():
    for _word in _words:
        STEM_OF.setdefault(_word, []).append(_group)


@dataclass
class Page:
    """Nodes in page order; a parent comes before its children. Elements have an empty text."""

    parent: list[int]
    depth: list[int]
    kind: list[int]  # 0 element, 1 text block: which pair potential leads to it
    features: list[tuple[str, ...]]
    texts: list[str]
    labels: list[int]  # what data-y says, in training pages


_ELEMENTS: dict[tuple[str, str], tuple[tuple[str, ...], int]] = {}


def element_features(tag: str, attributes: str) -> tuple[tuple[str, ...], int]:
    """Names of the features of an element, and its data-y (-1: none). Remembered, as pages repeat their tags."""
    key = (tag, attributes)
    if (known := _ELEMENTS.get(key)) is not None:
        return known
    out, y, words = [f"tag={tag}"], -1, set()
    for m in NAMED.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "data-y":
            y = int(value == "1")
        elif name in ("class", "id", "role", "aria-label", "itemprop"):
            words |= {w.lower() for w in PARTS.findall(value)}
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("hidden")
    groups = {g for w in words for g in STEM_OF.get(w, STEM_OF.get(w.removesuffix("s"), ()))}
    out += [f"name={g}" for g in groups]
    if groups and groups <= {"body"}:
        out.append("only body")
    known = (tuple(out), y)
    if len(_ELEMENTS) > 50_000:
        _ELEMENTS.clear()
    _ELEMENTS[key] = known
    return known


WORD = re.compile(r"[^\W\d_]+")
SPEAKER = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)?(?: \([^()]*\))?: ")
#: Elements that say what the blocks in them are for.
LANDMARKS = ("article", "main", "nav", "header", "footer", "aside", "form")
#: Blocks of at most so many words are features as a whole.
SHORT = 4
#: A first block of at most so many words, such as a heading, tells its pairs of words to the elements that begin with it.
LINE = 12
#: Features that fewer blocks of the training pages have are left out.
LEAST_BLOCKS = 4


def block_features(text: str, linked: int, tag: str, breaks: int, within: str) -> tuple[str, ...]:
    """Names of the features of a text block: length, links, punctuation, the elements around it, its pairs of words."""
    n = len(text)
    share = linked / n if n else 0
    density = 0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.8 else 3
    stop = "stop" if text[-1:] in ".!?…:»”\"" else "open"
    size = min(n, 1 << 9).bit_length()
    words = WORD.findall(text.lower())
    out = [f"in={tag}", f"chars={size}", f"links={density}", f"end={stop}", f"{tag}/links={density}", f"commas={min(3, text.count(','))}", f"breaks={min(2, breaks)}", f"within={within}", f"{within}/links={density}/chars={size // 2}"]
    out += {f"two={a} {b}" for a, b in zip(words, words[1:])}
    if words and len(words) <= SHORT:
        out.append("is=" + " ".join(words))
    if SPEAKER.match(text):
        out.append("speaker")
    if "©" in text:
        out.append("©")
    return tuple(out)


MARKUP = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*))")


def end_of(text: str, at: int, tag: str, opened: dict[str, list[int]]) -> int:
    """Where the element `tag` whose content begins at `at` ends: after its end tag, or before that of an open element around it."""
    inner: dict[str, int] = {}
    while m := MARKUP.search(text, at):
        if not m[2]:
            stop = text.find("-->", m.end())
            at = len(text) if stop < 0 else stop + 3
            continue
        name = m[2].lower()
        rest = ATTRIBUTES.match(text, m.end())
        stop = rest.end() if rest else text.find(">", m.end()) + 1 or len(text)
        if m[1]:
            if inner.get(name):
                inner[name] -= 1
            elif name == tag:
                return stop
            elif opened.get(name):
                return m.start()
        elif not text.endswith("/>", m.end(), stop) and name not in VOID:
            if name in RAW:
                ends = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(text, stop)
                stop = ends.end() if ends else len(text)
            else:
                inner[name] = inner.get(name, 0) + 1
        at = stop
    return len(text)


def parse(source: str | None) -> Page:
    """The tree of block elements and text blocks. Takes any text; time and memory grow with its length."""
    page = Page([-1], [0], [0], [("root",)], [""], [1])
    stack: list[tuple[str, int, int, str]] = [("#root", 0, 1, "#root")]  # tag, node (of the nearest block element), label, that element's tag
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
    pieces: list[str] = []
    filled = {-1}  # nodes with a text block in them
    state = {"linked": 0, "breaks": 0, "mute": 0, "a": 0}

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                _, node, y, tag = stack[-1]
                page.parent.append(node)
                page.depth.append(page.depth[node] + 1)
                page.kind.append(1)
                around = max(((opened[t][-1], t) for t in LANDMARKS if opened.get(t)), default=(0, "none"))[1]
                page.features.append(block_features(text, state["linked"], tag, state["breaks"], around))
                page.texts.append(text)
                page.labels.append(y)
                told = tuple(f"first/{f}" for f in page.features[-1] if f.startswith(("two=", "is="))) if len(text.split()) <= LINE else ()
                while node not in filled:
                    filled.add(node)
                    page.features[node] += told
                    node = page.parent[node]
            pieces.clear()
        state["linked"] = state["breaks"] = 0

    def pop() -> None:
        tag, _, _, around = stack[-1]
        mute = tag in MUTE and around == tag
        if tag not in INLINE and (mute or tag != "label"):
            flush()
        stack.pop()
        opened[tag].pop()
        if mute:
            state["mute"] -= 1
        elif tag == "a":
            state["a"] -= 1

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            pop()
        pop()

    text, at, size = source or "", 0, len(source or "")
    while at < size:
        lt = text.find("<", at)
        end = size if lt < 0 else lt
        if end > at:
            if opened.get("head") and not text[at:end].isspace():
                close("head")
            if not state["mute"]:
                piece = text[at:end]
                pieces.append(piece)
                if state["a"]:
                    state["linked"] += len(piece)
            at = end
        if lt < 0:
            break
        after = text[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            comment = text.startswith("<!--", lt)
            stop = text.find("-->" if comment else ">", lt + 2)
            at = size if stop < 0 else stop + (3 if comment else 1)
            continue
        closing = after == "/"
        m = TAG.match(text, lt + 1 + closing)
        if not m:
            if closing:
                stop = text.find(">", lt)
                at = size if stop < 0 else stop + 1
            else:
                if not state["mute"]:
                    pieces.append("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        rest = ATTRIBUTES.match(text, m.end())
        if rest:
            stop = rest.end()
        else:
            stop = text.find(">", m.end()) + 1
            if not stop:
                break
        attributes, at = text[m.end() : stop - 1], stop
        if closing:
            if opened.get(tag):
                close(tag)
            continue
        if opened.get("head") and tag not in IN_HEAD:
            close("head")
        if tag in DROPPED:
            if not attributes.endswith("/"):
                at = end_of(text, at, tag, opened)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
                at = ends.end() if ends else size
            continue
        if tag == "br":
            if not state["mute"]:
                pieces.append(" ")
                state["breaks"] += 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for choice in CHOICES:
                if opened.get(choice):
                    close(choice)
        if tag in CLOSES_P and opened.get("p"):
            close("p")
        if tag in SIBLINGS:
            own, limits = SIBLINGS[tag]
            at_own, at_limit = (max((opened[t][-1] for t in some if opened.get(t)), default=-1) for some in (own, limits))
            if at_own > at_limit:
                while len(stack) > at_own:
                    pop()
        opened.setdefault(tag, []).append(len(stack))
        _, node, y, around = stack[-1]
        if tag in INLINE or tag == "label" and not opened.get("form"):
            stack.append((tag, node, y, around))
            state["a"] += tag == "a"
            continue
        flush()
        if tag in MUTE:
            state["mute"] += 1
            stack.append((tag, node, y, tag))
            continue
        features, own_y = element_features(tag, attributes.strip())
        y = own_y if own_y >= 0 else y
        page.parent.append(node)
        page.depth.append(page.depth[node] + 1)
        page.kind.append(0)
        page.features.append(features)
        page.texts.append("")
        page.labels.append(y)
        stack.append((tag, len(page.parent) - 1, y, tag))
    flush()
    return page


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # per feature: log odds of content
    pairs: np.ndarray  # 2 (kind of child) x 2 (label of parent) x 2 (label of child)


@dataclass
class Forest:
    """The trees of some pages as arrays."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]  # nodes of each depth, in page order, so the children of a node are neighbours
    families: list[tuple[np.ndarray, np.ndarray]]  # per depth: the nodes' parents, and where the children of each begin
    node: np.ndarray  # (node, feature) pairs
    feature: np.ndarray

    @classmethod
    def of(cls, pages: list[Page], index: dict[str, int]) -> Forest:
        offsets = np.cumsum([0] + [len(p.parent) for p in pages])
        parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + o) for p, o in zip(pages, offsets)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        starts = [np.flatnonzero(np.diff(parent[level], prepend=-2)) for level in levels]
        families = [(parent[level[at]], at) for level, at in zip(levels, starts)]
        known = [[index[f] for f in fs if f in index] for p in pages for fs in p.features]
        node = np.repeat(np.arange(len(known)), [len(k) for k in known])
        return cls(parent, np.concatenate([np.array(p.kind) for p in pages]), levels, families, node, np.array([f for k in known for f in k], np.int64))


def marginals(f: Forest, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of every node and P(label of parent, label) of every node with a parent, by sum-product message passing."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(f.node, weights[f.feature], n)
    up = own  # own potential and what the children say
    message = np.zeros((n, 2))  # to the parent
    for level, (parents, starts) in zip(reversed(f.levels[1:]), reversed(f.families[1:])):
        said = up[level][:, None, :] + pairs[f.kind[level]]
        message[level] = np.logaddexp(said[:, :, 0], said[:, :, 1])
        up[parents] += np.add.reduceat(message[level], starts)
    belief = up.copy()
    both = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = belief[f.parent[level]] - message[level]  # the parent without what this child said
        joint = rest[:, :, None] + pairs[f.kind[level]] + up[level][:, None, :]
        own_belief = np.logaddexp(joint[:, 0], joint[:, 1])
        total = np.logaddexp(own_belief[:, 0], own_belief[:, 1])[:, None]
        both[level] = np.exp(joint - total[:, :, None])
        belief[level] = own_belief - total
    root = f.levels[0]
    belief[root] -= np.logaddexp(belief[root, 0], belief[root, 1])[:, None]
    return np.exp(belief), both


def fit(pages: list[Page], steps: int = STEPS) -> Model:
    """Weights and pair potentials that make the labels likely, by gradient steps with a ridge penalty."""
    seen_in = Counter(f for p in pages for fs in p.features for f in fs)
    names = sorted(f for f, n in seen_in.items() if n >= LEAST_BLOCKS)
    index = {name: i for i, name in enumerate(names)}
    f = Forest.of(pages, index)
    y = np.concatenate([np.array(p.labels) for p in pages])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    theta = np.zeros(len(names) + 8)
    penalty = np.array([WORD_PENALTY if name.startswith(("two=", "is=", "first/")) else PENALTY for name in names] + [PENALTY] * 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        single, both = marginals(f, theta[:-8], theta[-8:].reshape(2, 2, 2))
        expected = np.zeros((2, 2, 2))
        for k in (0, 1):
            expected[k] = both[child][f.kind[child] == k].sum(0)
        slope = np.concatenate([np.bincount(f.feature, (y - single[:, 1])[f.node], len(names)), (seen - expected).ravel()]) / len(pages) - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(index, theta[:-8], theta[-8:].reshape(2, 2, 2))


def texts_of(pages: list[Page], model: Model) -> list[str]:
    """The text blocks that are more likely content than not, in page order, two line ends between them."""
    if not pages:
        return []
    single, _ = marginals(Forest.of(pages, model.index), model.weights, model.pairs)
    out, at = [], 0
    for p in pages:
        likely = single[at : at + len(p.parent), 1] > 0.5
        out.append("\n\n".join(t for t, k, c in zip(p.texts, p.kind, likely) if k and c))
        at += len(p.parent)
    return out


def labelled_page(rnd: random.Random, nameless: bool = False) -> str:
    """One generated page; data-y marks its elements as content (1) or not (0). A nameless one has no class, id or role.

    What is not content has a line of its kind in it then, or an element that says what it is."""
    word = lambda: "".join(rnd.choices("abcdefghilmnoprstuvé", k=rnd.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 11))))

    real = rnd.random() < 0.5
    known = [w.lower() for lines in PHRASES.values() for line in lines for w in WORD.findall(line)]
    line = lambda kind: rnd.choice(PHRASES[kind])

    def sentence(low: int, high: int) -> str:
        words = [word() for _ in range(rnd.randint(low, high))]
        if real:
            words = [rnd.choice(PLAIN) if rnd.random() < 0.5 else rnd.choice(known) if rnd.random() < 0.04 else w for w in words]
        words = [w + "," if rnd.random() < 0.08 else w for w in words]
        return " ".join(words).capitalize() + rnd.choice((".", ".", ".", "", "!", "?"))

    prose = lambda: " ".join(sentence(1, 18) for _ in range(rnd.choice((1, 1, 1, 2, 3, 5, 8))))
    link = lambda: f'<a href="/{word()}">{sentence(1, rnd.choice((1, 2, 6)))}</a>'
    no, yes = ' data-y="0"', ' data-y="1"'

    def named(*names: str) -> str:
        name = rnd.choice(names)
        if nameless:
            return ""
        if rnd.random() < 0.05:
            name = word()
        if rnd.random() < 0.3:
            name = rnd.choice((f"{name}-{word()}", f"{word()}_{name}", f"{name} {word()}", f"main-{name}" if name in STEMS["nav"] else f"site-{name}"))
        return f" {rnd.choice(('class', 'class', 'id'))}=\"{name}\""

    def links(n: int) -> str:
        return rnd.choice((lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(link() for _ in range(n)), lambda: "".join(f"<div>{link()}</div>" for _ in range(n))))()

    def loose() -> str:
        """What stands in parts that are no content, prose among it."""
        return rnd.choice((lambda: links(rnd.randint(1, 9)), lambda: prose(), lambda: f"<p>{prose()}</p>", lambda: f"<h3>{sentence(1, 4)}</h3>{links(rnd.randint(1, 5))}", lambda: f"<h4>{sentence(1, 4)}</h4><p>{prose()}</p><p>{link()}</p>", lambda: f"<span>{sentence(1, 8)}</span>"))()

    def some() -> str:
        """As often as not nothing but paragraphs, as in an article."""
        return "".join(f"<p>{prose()}</p>" for _ in range(rnd.randint(1, 3))) if rnd.random() < 0.4 else "".join(loose() for _ in range(rnd.randint(1, 3)))

    def lines(kind: str) -> str:
        """Lines of a kind in one of several forms, other text behind some of them."""
        one = lambda: f'<a href="/{word()}">{line(kind)}</a>' if rnd.random() < 0.25 else line(kind)
        first = rnd.choice((lambda: f"<h2>{line(kind)}</h2>", lambda: f"<h3>{line(kind)}</h3>", lambda: f"<p>{one()}</p>", lambda: f"<p>{one()} {one()}</p>", lambda: one(), lambda: f"<div>{one()}</div>", lambda: f"<ul><li>{one()}</li><li>{one()}</li></ul>", lambda: f"<span>{one()}</span>"))()
        return first + (some() if rnd.random() < 0.4 else "")

    def remark() -> str:
        said = f"{rnd.choice(REMARKS)} {prose()}" if rnd.random() < 0.4 else prose()
        who = rnd.choice(NAMES)
        return rnd.choice((f"<p>{who}: {said}</p>", f"<p><b>{who}</b>: {said}</p>", f"<div><b>{who}</b><p>{said}</p></div>", f"<p>{said}</p>"))

    def boiler(kind: str) -> str:
        plain = rnd.random() < 0.35
        if nameless or rnd.random() < 0.25:
            if kind == "form":
                return f"<form{no}><p>{line(kind)}</p><label>{line(kind)}</label><input name=q><button>{word()}</button>{lines(kind)}</form>"
            own = {"nav": ("nav",), "header": ("header",), "footer": ("footer",), "side": ("aside",)}.get(kind, ())
            if own and rnd.random() < 0.5:
                return f"<{own[0]}{no}>{lines(kind) if rnd.random() < 0.5 else links(rnd.randint(2, 9)) if kind == 'nav' else some()}</{own[0]}>"
            if kind == "nav":
                return f"<div{no}>{links(rnd.randint(2, 9)) if rnd.random() < 0.6 else lines(kind)}</div>"
            tag = rnd.choice(("div", "div", "section"))
            if kind == "comments":
                return f"<{tag}{no}><{(h := rnd.choice(('h2', 'h3', 'p')))}>{line(kind)}</{h}>{''.join(remark() for _ in range(rnd.choice((1, 2, 3, 4, 5, 20))))}</{tag}>"
            return f"<p{no}>{line(kind)}</p>" if rnd.random() < 0.2 else f"<{tag}{no}>{lines(kind)}</{tag}>"
        if kind == "nav":
            return f"<nav{'' if plain else named('nav', 'menu')}{no}>{links(rnd.randint(2, 9))}</nav>" if rnd.random() < 0.6 else f"<div{named(*STEMS['nav'])}{no}>{links(rnd.randint(2, 9))}</div>"
        if kind == "header":
            return f"<header{'' if plain else named('header', 'masthead')}{no}>{rnd.choice((f'<h1>{sentence(1, 3)}</h1>', f'<div>{sentence(1, 4)}</div>', ''))}{some()}</header>" if rnd.random() < 0.6 else f"<div{named(*STEMS['head'])}{no}>{loose()}</div>"
        if kind == "footer":
            return f"<footer{'' if plain else named('footer')}{no}>{rnd.choice((f'&copy; {word()}.example &middot; ', ''))}{some()}</footer>" if rnd.random() < 0.6 else f"<div{named(*STEMS['foot'])}{no}>{loose()}</div>"
        if kind == "side":
            return f"<aside{'' if plain else named(*STEMS['side'])}{no}>{some()}</aside>" if rnd.random() < 0.5 else f"<div{named(*STEMS['side'])}{no}>{some()}</div>"
        if kind == "comments":
            each = lambda: rnd.choice((f"<div{named('comment', 'reply')}><p>{prose()}</p></div>", f"<li><b>{word()}</b> <p>{prose()}</p></li>", f"<article{named('comment')}><p>{prose()}</p></article>", f"<p>{prose()}</p>"))
            return f"<{(t := rnd.choice(('div', 'section', 'ol')))}{named('comments', 'comment', 'commentlist', 'disqus', 'respond', 'discussion', 'reader-comments')}{no}>{f'<h3>{sentence(1, 3)}</h3>' if rnd.random() < 0.5 else ''}{''.join(each() for _ in range(rnd.randint(1, 5)))}</{t}>"
        if kind == "form":
            return f"<form{no}><p>{sentence(1, 9)}</p><label>{word()}</label><input name=q><button>{word()}</button></form>"
        group = {"ad": "ad", "notice": "notice", "social": "social"}[kind]
        tag = rnd.choice(("div", "div", "section", "aside", "p"))
        return f"<{tag}{named(*STEMS[group])}{no}>{prose() if tag == 'p' else some()}</{tag}>"

    def block() -> str:
        draw = rnd.random()
        if draw < 0.74:
            inner = prose()
            if rnd.random() < 0.15:
                inner += f" {link()} " + prose()
            if rnd.random() < 0.1:
                return f"<p{yes}><b>{inner}<br>"
            if rnd.random() < 0.06:
                return f'<p{yes}><a href="/{word()}">{inner}</a></p>'
            if rnd.random() < 0.03:
                return f"<p{yes}>{sentence(1, 4)} <label>{word()} {word()}</label> {inner}</p>"
            return f"<p{yes}>{inner}</p>" if rnd.random() < 0.9 else f"<div{yes}>{inner}</div>"
        if draw < 0.82:
            return f"<h2{yes}>{sentence(1, 7)}</h2>"
        if draw < 0.9:
            linked = rnd.random() < 0.45
            return f"<{(t := rnd.choice(('ul', 'ol')))}{yes}>" + "".join(f"<li>{link() if linked else sentence(1, 12)}</li>" for _ in range(rnd.randint(1, 6))) + f"</{t}>"
        if draw < 0.94:
            return f"<blockquote{yes}><p>{prose()}</p></blockquote>"
        if draw < 0.97:
            return f"<table{yes}>" + "".join(f"<tr><td>{word()}</td><td>{sentence(1, 4)}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>"
        return f"<pre{yes}>{sentence(3, 12)}</pre>"

    inside = [block() for _ in range(rnd.choice((0, 1, 2, 3, 5, 8, 14)))]
    if rnd.random() < 0.08:
        # many short or equal blocks: their small potentials must not add up against the article
        again = f"<p{yes}>{prose() if rnd.random() < 0.3 else sentence(1, 3)}</p>"
        inside += [again if rnd.random() < 0.7 else f"<p{yes}>{sentence(1, 4)}</p>" for _ in range(rnd.randint(15, 60))]
    for _ in range(rnd.choice((0, 0, 0, 1, 2))):
        inside.insert(rnd.randint(0, len(inside)), boiler(rnd.choice(("ad", "social", "notice", "form", "ad", "side"))))
    title = f"<h1{yes}>{sentence(1, 9)}</h1>"
    if rnd.random() < 0.15:
        title = f"<header{yes}>{title}</header>"
    body = title * (rnd.random() < 0.9) + "".join(inside) + (boiler("comments") if rnd.random() < 0.12 else "")
    wrap = rnd.random()
    main = f"<article{yes}>{body}</article>" if wrap < 0.55 else f"<main{yes}>{body}</main>" if wrap < 0.7 else f"<div{named('content', 'article', 'post', 'entry', 'story', 'main')}{yes}>{body}</div>"
    if rnd.random() < 0.25:
        main = rnd.choice((f"<main{yes}>{main}</main>", f"<div{named('content', 'main', 'page')}{yes}>{main}</div>", f"<div{yes}>{main}</div>", f"<section{yes}>{main}</section>"))
    before = [boiler(k) for k in ("header", "nav", "notice", "ad", "side", "form") if rnd.random() < (0.7 if k == "nav" else 0.35)]
    after = [boiler(k) for k in ("comments", "side", "social", "ad", "notice", "nav", "footer") if rnd.random() < (0.8 if k == "footer" else 0.3)]
    if rnd.random() < 0.15:
        rnd.shuffle(before)
    if rnd.random() < 0.1:
        cell = lambda kind: f"<td{named(*STEMS[kind])}{no}>{some()}</td>" if rnd.random() < 0.7 else ""
        main = f"<table{yes}><tr>{cell(rnd.choice(('nav', 'side')))}<td{rnd.choice(('', named('main', 'content', 'text')))}{yes}>{body}</td>{cell(rnd.choice(('side', 'ad')))}</tr></table>"
    if rnd.random() < 0.06:
        # the article's blocks stand among the others, with no element around them
        main = f"<div{yes}>{body}</div>" if rnd.random() < 0.5 else body
    if rnd.random() < 0.15:
        grid = lambda parts: "".join(f"<div{named('col', 'row', 'box', 'grid')}>{x}</div>" for x in parts)
        before, main, after = [grid(before)], f"<div{named('col', 'row', 'box', 'wrapper')}{yes}>{main}</div>", [grid(after)]
    head = rnd.choice(("<head><title>{t}</title><style>p{{}}</style></head><body>", "<head><title>{t}</title><body>", "<head><meta charset=utf-8><title>{t}</title></head>", "<title>{t}</title>", "<body>"))
    close = rnd.choice(("</body></html>", "</body></html>", "</body></html>", "</body>", ""))
    return f"{rnd.choice(('<!DOCTYPE html>', '<!doctype html>', ''))}<html>{head.format(t=word())}{''.join(before)}{main}{''.join(after)}{close}"


_MODELS: dict[tuple[int, int], Model] = {}


def trained() -> Model:
    """The model of the generated labelled pages, fitted once in a process."""
    key = (TRAIN_PAGES, TRAIN_SEED)
    if key not in _MODELS:
        rnd = random.Random(TRAIN_SEED)
        _MODELS[key] = fit([parse(labelled_page(rnd, nameless=i % 2 == 1)) for i in range(TRAIN_PAGES)])
    return _MODELS[key]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages, from its whole html.

    Null and empty html give an empty text; anything else is parsed as far as it goes, unclosed and stray tags too.
    Repeated rows each give a row; other columns of pages are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = texts_of([parse(h.as_py()) for h in part["html"]], shared.value)
                yield pa.RecordBatch.from_arrays([part["page_id"].cast(pa.int64()), part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
