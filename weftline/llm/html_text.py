"""Main text of web pages: content marginals of DOM nodes by sum-product on the tree, trained from labelled pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from random import Random
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import batched

MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
#: Elements by what they do to the tree and to text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style title noscript template iframe object svg math canvas audio video textarea select option datalist".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style title textarea noscript iframe".split()}
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
#: An opening tag of the first closes an open one of the second, up to the nearest of the third.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TAGS = tuple("article main section div nav header footer aside form button fieldset label p h1 h2 h3 ul ol li a table td blockquote pre figure figcaption span b body html address details dialog time small".split())
#: Words of class, id and role that speak for one kind of node; fixed values.
HINTS = (
    r"content|article|post|entry|story|main|body|text|prose",
    r"nav|menu|breadcrumb|tabs?|pagination|pager|toc",
    r"side|sidebar|rail|widget|aside",
    r"ad|ads|advert\w*|adv|banner|sponsor\w*|promo\w*|outbrain|taboola",
    r"cookie\w*|consent|gdpr|notice|popup|modal|overlay|alert|paywall|announcement",
    r"comments?|replies|reply|respond|discussion|disqus|commentlist|feedback",
    r"foot|footer|copyright|colophon|legal",
    r"head|header|masthead|topbar|logo|branding",
    r"share|sharing|social|follow|related|recommended|recirc|more|tags?|popular|trending|newsletter|subscribe|signup|login|search",
    r"meta|byline|author|date",
)
_HINTS = [re.compile(rf"(?<![a-z0-9])(?:{h})(?![a-z0-9])", re.I) for h in HINTS]
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"(?<=[a-z])(?=[A-Z])|_")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
NUMBERS = 9
FEATURES = len(TAGS) + 2 + len(HINTS) + 2


class Tree(NamedTuple):
    """Nodes of a page, parents before children: parent, depth, tag and attributes, text (of text nodes), block number, inside a link, label."""

    parent: list[int]
    depth: list[int]
    kind: list[tuple[str, str]]
    text: list[str | None]
    block: list[int]
    linked: list[bool]
    label: list[int]


def parse(html: str) -> Tree:
    """A lenient tree of what is shown: unclosed and stray tags, comments and unseen elements are dealt with as browsers do, roughly.

    Takes time in proportion to the page, however deep. Once a quote in a tag turns out never to close, quotes are signs like any others in the rest
    of the page, and tags end at the next ">". A "<" that begins no tag, and one without a ">" after it, is text. Character references are decoded
    within one text node.
    """
    tree = Tree([-1], [0], [("html", "")], [None], [0], [False], [0])
    stack, block, links, unseen = [(0, "html")], 0, 0, 0
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are

    def add(top: int, kind: tuple[str, str], text: str | None, label: int) -> int:
        for column, value in zip(tree, (top, tree.depth[top] + 1, kind, text, block, links > 0, label)):
            column.append(value)
        return len(tree.parent) - 1

    def add_text(s: str) -> None:
        if unseen or not s:
            return
        s = unescape(s) if "&" in s else s
        if s.isspace():
            if tree.text[-1] is not None and tree.block[-1] == block:
                tree.text[-1] += " "
            return
        add(stack[-1][0], ("#text", ""), s, tree.label[stack[-1][0]])

    def push(node: int, tag: str) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((node, tag))

    def pop(to: int) -> None:
        nonlocal block, links, unseen
        while len(stack) > to:
            _, tag = stack.pop()
            places[tag].pop()
            if tag in BLOCK:
                block += 1
            links -= tag == "a"
            unseen -= tag in UNSEEN

    def find(tags: tuple[str, ...], stop: tuple[str, ...]) -> int | None:
        """Place of the innermost open element of ``tags``, unless one of ``stop`` is open within it."""
        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        k = last(tags)
        return k if k and k >= last(stop) else None

    pos, quotes = 0, True
    while m := MARKUP.search(html, pos):
        tag, after = m[2], m.end()
        if tag is None and html.startswith("--", m.start() + 2):
            end = html.find("-->", m.start() + 2)
            end = len(html) if end < 0 else end + 3
        else:
            end = ATTRIBUTES.match(html, after).end() if tag is not None and quotes else -1
            if end < 0 or not html.startswith(">", end):
                quotes = quotes and tag is None
                end = html.find(">", after)
            if end < 0:
                break
            end += 1
        if m.start() > pos:
            add_text(html[pos : m.start()])
        pos = end
        if tag is None:
            continue
        attributes = html[after : end - 1]
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag == "p" and find(("p",), ()) is None:
                block += tag == "p"
            elif (k := find((tag,), ("table",) if tag not in ("table", "body", "html", "div", "article", "main", "section") else ())) is not None and tag not in ("body", "html"):
                pop(k)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                unseen_head = find(("head",), ())
                if unseen_head is not None:
                    pop(unseen_head)
                if not places.get("body"):
                    push(add(0, (tag, attributes), None, 0), tag)
            continue
        if tag == "br" or tag in ("td", "th", "img", "input", "wbr") and not unseen:
            if tag != "wbr" and tree.text[-1] is not None:
                tree.text[-1] += " "
        if tag in VOID:
            block += tag == "hr"
            continue
        if tag in RAW:
            end = RAW[tag].search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if tag in CLOSES_P and (k := find(("p",), ("button", "table", "td", "th", "object"))) is not None:
            pop(k)
        if tag in CLOSES:
            while (k := find(tuple(CLOSES[tag][0].split()), CLOSES[tag][1])) is not None:
                pop(k)
        if tag == "a" and (k := find(("a",), ("table", "td"))) is not None:
            pop(k)
        block += tag in BLOCK
        links += tag == "a"
        unseen += tag in UNSEEN
        top = stack[-1][0]
        if unseen:
            push(top, tag)
            continue
        label = 0 if "data-y=0" in attributes else 1 if "data-y=1" in attributes else tree.label[top]
        push(add(top, (tag, attributes), None, label), tag)
    add_text(html[pos:])
    return tree


@lru_cache(10_000)
def _features(tag: str, attributes: str) -> tuple[int, ...]:
    """Features that a node's tag and attributes have."""
    out = [TAGS.index(tag) if tag in TAGS else len(TAGS) if tag != "#text" else len(TAGS) + 1]
    names = " ".join(_WORDS.sub(" ", x.strip("\"'")) for x in _ATTRIBUTE.findall(attributes))
    if names:
        out += [len(TAGS) + 2 + k for k, h in enumerate(_HINTS) if h.search(names)]
    if _HIDDEN.search(attributes):
        out.append(FEATURES - 1)
    if tag in ("article", "main") and not any(k > len(TAGS) + 2 for k in out[1:]):
        out.append(FEATURES - 2)  # of the kinds that names speak for, none but content
    return tuple(out)


def by_level(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes of each depth from 0."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])


class Forest(NamedTuple):
    parent: np.ndarray
    levels: list[np.ndarray]
    sets: np.ndarray  # features of each kind of node
    kind: np.ndarray
    numbers: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    parents, kinds, seen, numbers = [], [], {}, []
    base = 0
    for t in trees:
        parents.append(np.array(t.parent) + np.where(np.array(t.parent) >= 0, base, 0))
        kinds += [seen.setdefault(_features(*k), len(seen)) for k in t.kind]
        numbers += [(len(x), len(x) if a else 0, x.rstrip()[-1:] in ".!?…\"”»:;", "©" in x) if x is not None else (0, 0, 0, 0) for x, a in zip(t.text, t.linked)]
        base += len(t.parent)
    parent = np.concatenate(parents)
    raw = np.array(numbers, float)
    levels = by_level(np.concatenate([np.array(t.depth) for t in trees]))
    total = raw.copy()
    for at in reversed(levels[1:]):
        np.add.at(total, parent[at], total[at])
    size, share = total[:, 0], total[:, 1] / np.maximum(total[:, 0], 1)
    text = raw[:, 0] > 0
    numeric = np.stack([np.ones(len(parent)), np.log1p(size) / 8, share, (size > 0) & (size < 40), size > 200, share > 0.6, text & (raw[:, 2] > 0), text & (raw[:, 3] > 0), text & (size < 25)], axis=1).astype(float)
    sets = np.zeros((len(seen), FEATURES))
    for f, k in seen.items():
        sets[k, list(f)] = 1
    return Forest(parent, levels, sets, np.array(kinds), numeric)


class Model(NamedTuple):
    """Weights of node features and the potentials of (parent, child) labels."""

    tags: np.ndarray
    numbers: np.ndarray
    pair: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of content of each node; and the log odds of a node without its parent, and of its parent without it."""
        unary = (f.sets @ self.tags)[f.kind] + f.numbers @ self.numbers
        (w00, w01), (w10, w11) = self.pair
        up, message = unary.copy(), np.zeros(len(unary))
        for at in reversed(f.levels[1:]):
            message[at] = np.logaddexp(w10, w11 + up[at]) - np.logaddexp(w00, w01 + up[at])
            np.add.at(up, f.parent[at], message[at])
        belief, above = up.copy(), np.zeros(len(up))
        for at in f.levels[1:]:
            above[at] = belief[f.parent[at]] - message[at]
            belief[at] = up[at] + np.logaddexp(w01, w11 + above[at]) - np.logaddexp(w00, w10 + above[at])
        return 1 / (1 + np.exp(-np.clip(belief, -500, 500))), up, above


def train(pages: list[str], steps: int = 200, rate: float = 0.15) -> Model:
    """Fit by gradient steps on the exact likelihood of labelled pages: expected counts come from the same message passing.

    Labels: ``data-y=1`` or ``data-y=0`` attributes, which hold for what is within.
    """
    trees = [parse(p) for p in pages]
    f, y = forest(trees), np.concatenate([np.array(t.label) for t in trees])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[f.parent[child]], y[child]), 1)
    w = [np.zeros(FEATURES), np.zeros(NUMBERS), np.zeros((2, 2))]
    squares = [np.full_like(x, 1e-3) for x in w]
    for _ in range(steps):
        p, up, above = Model(*w).marginals(f)
        odds = np.stack([w[2][0, 0] + 0 * up[child], w[2][0, 1] + up[child], w[2][1, 0] + above[child], w[2][1, 1] + above[child] + up[child]], axis=1)
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        both = (odds / odds.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2)
        rest = y - p
        kinds = np.bincount(f.kind, rest, len(f.sets))
        slopes = [f.sets.T @ kinds, f.numbers.T @ rest, seen - both]
        for k, (x, g) in enumerate(zip(w, slopes)):
            g = g / len(trees) - 0.02 * x
            squares[k] += g * g
            w[k] = x + rate * g / np.sqrt(squares[k]) * (1 + len(squares) / 3)
    return Model(*w)


def labelled_pages(n: int = 400, seed: int = 1) -> list[str]:
    """Pages of many layouts with their labels, made by a rule: the training set."""
    r = Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?"])
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    some = lambda p, *xs: r.choice(xs) if r.random() < p else ""

    def named(tags: str, names: str) -> tuple[str, str]:
        tag = r.choice(tags.split())
        name = r.choice(names.split())
        return tag, r.choice([f'class="{name}"', f'id="{name}"', f'class="{word()} {name}"'] + ([""] if tag != "div" else []))

    def boilerplate(tags: str, names: str, inner: str) -> str:
        tag, name = named(tags, names)
        return f"<{tag} {name} data-y=0>{inner}</{tag}>"

    def within() -> str:
        return r.choice([
            lambda: boilerplate("div aside", "ad advert ads promo sponsored banner", prose(1, 2)),
            lambda: boilerplate("div aside section", "related more recommended popular", f"<h3>{words(1, 3)}</h3>{items(2, 5)}"),
            lambda: boilerplate("div ul", "share social follow tags", items(2, 4) if r.random() < 0.5 else " ".join(link() for _ in range(3))),
            lambda: boilerplate("form div", "newsletter subscribe signup", f"<p>{sentence()}</p><label>{word()}</label><input><button>{word()}</button>"),
            lambda: boilerplate("nav div", "toc breadcrumb", items(2, 4)),
        ])()

    def paragraph() -> str:
        t = prose(1, 5)
        if r.random() < 0.3:
            t = f"{t} {r.choice(['<b>%s</b>', '<i>%s</i>', '<a href=#>%s</a>', '<span>%s</span>']) % words(1, 4)} {sentence()}"
        kind = r.random()
        if kind < 0.08:
            return f"<p><b>{t}<br>"
        if kind < 0.16:
            return f"<h2>{words(2, 6)}</h2><p>{t}</p>"
        if kind < 0.22:
            return r.choice(["<ul>%s</ul>", "<ol>%s</ol>"]) % "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5)))
        if kind < 0.26:
            return f"<blockquote><p>{t}</p></blockquote>"
        if kind < 0.29:
            return "<table>" + "".join(f"<tr><td>{word()}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.33:
            return f"<p>{sentence(1, 4)}</p>"
        if kind < 0.37:
            return f"<div>{t}</div>"
        if kind < 0.39:
            return f"<pre>{words(3, 9)}</pre>"
        return f"<p>{t}</p>"

    def comments() -> str:
        one = lambda: r.choice(["<div class=comment><p>%s</p></div>", "<li><p>%s</p></li>", "<article class=comment><p>%s</p></article>", "<p>%s</p>", "<div><b>%s</b></div>"]) % prose(1, 3)
        inner = f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6)))
        return boilerplate("div section ol", "comments comment-list discussion responses replies commentlist disqus", inner + some(0.4, f"<form><textarea></textarea><button>{word()}</button></form>"))

    out = []
    for _ in range(n):
        tag, name = r.choice([("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="entry-content"'), ("div", 'class="article-body"'), ("div", 'id="story"'), ("section", 'class="post-text"'), ("div", 'id="main"'), ("div", "")])
        body = [paragraph() for _ in range(r.choice([1, 1, 2, 3, 5, 8]))] if r.random() < 0.85 else [r.choice(["<p><b>%s<br>", "<p>%s</p>", "<p>%s"]) % sentence(1, 14)]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randint(0, len(body)), within())
        head = r.choice([f"<h1>{words(2, 8)}</h1>", f"<header><h1>{words(2, 8)}</h1></header>", f"<h1>{words(2, 8)}</h1><p>{sentence(1, 3)}</p>", ""])
        content = f"<{tag} {name} data-y=1>{head}{''.join(body)}{some(0.1, comments())}</{tag}>"
        side = some(0.4, boilerplate("aside div", "sidebar side rail widget", f"<h3>{words(1, 2)}</h3>{items(2, 6)}{some(0.5, f'<p>{sentence()}</p>')}"))
        above = [some(0.35, boilerplate("div section", "cookie-notice consent notice alert popup announcement", f"<p>{prose(1, 2)}</p><button>{word()}</button>")),
                 some(0.5, boilerplate("header div", "header masthead topbar", f"<h1>{words(1, 2)}</h1>{some(0.6, f'<nav data-y=0>{items(3, 7)}</nav>')}{some(0.4, f'<p>{sentence(2, 6)}</p>')}")),
                 some(0.7, boilerplate("nav div", "nav menu navigation", items(3, 9))), some(0.5, boilerplate("div", "ad ads advert banner", r.choice([sentence(), prose(1, 2)])))]
        if r.random() < 0.3:
            r.shuffle(above)
        below = some(0.35, comments()) + some(0.3, boilerplate("form div", "search login subscribe", f"<p>{sentence()}</p><input><button>{word()}</button>"))
        foot = some(0.85, boilerplate("footer div", "footer foot copyright", r.choice([f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{prose(1, 2)}</p>{items(1, 4)}", f"<p>&copy; 2020 {words(1, 3)}</p>"])))
        inner = content + below + side if r.random() < 0.7 else side + content + below
        wrap = r.choice(["%s", "%s", '<div id="page">%s</div>', '<div class="container"><div class="row">%s</div></div>'])
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{''.join(above)}{wrap % inner}{foot}</body></html>")
    return out


@lru_cache(1)
def trained() -> Model:
    return train(labelled_pages())


#: On a page where no text is content more likely than not: how likely its likeliest prose must be, how long prose is, and which share of that is enough for the rest.
LIKELY, PROSE, SHARE = 0.15, 40, 0.5


def _least(tree: Tree, marginal: list[float]) -> float:
    """The marginal from which a text node of a page counts as content: a half; on a page without any such, a share of that of its likeliest prose outside links."""
    texts = [(p, x, a) for p, x, a in zip(marginal, tree.text, tree.linked) if x is not None]
    if any(p >= 0.5 for p, _, _ in texts):
        return 0.5
    best = max((p for p, x, a in texts if not a and len(x) >= PROSE and x.rstrip()[-1:] in ".!?…\"”»:;"), default=0.0)
    return SHARE * best if best >= LIKELY else 0.5


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page: blocks of the text nodes that are content, see ``_least``."""
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    marginal, _, _ = model.marginals(forest(trees))
    out, base = [], 0
    for t in trees:
        blocks: list[list[str]] = []
        last = None
        own = marginal[base : base + len(t.parent)].tolist()
        least = _least(t, own)
        for text, block, p in zip(t.text, t.block, own):
            if text is not None and p >= least:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        base += len(t.parent)
        texts = (" ".join("".join(b).split()) for b in blocks)
        out.append("\n\n".join(x for x in texts if x))
    return out


def main_text(pages: DataFrame, html: str = "html", model: Model | None = None, at_once: int = 256) -> DataFrame:
    """``pages`` with text and n_chars (which replace columns of these names): the main text of the whole html, and its code points.

    Null or empty html, and pages without content, have an empty text; a page of which nothing is content more likely than not, but that holds prose, gives its likeliest. Character references are decoded, white space within a
    block becomes one blank, blocks are joined by two line feeds in page order; no other character is dropped. Pages may be of any length and depth.
    Repeated rows are extracted again, no rows give no rows. The model is trained on the driver, from
    pages that ``labelled_pages`` makes, and sent to the tasks (about 1 KB).
    """
    model = model or trained()
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = batched(pages).select(F.struct(*kept).alias("row"), F.col(html).alias("html"))
    kind = rows.select("row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    for f in kind:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, at_once):
                x = b.slice(s, at_once)
                texts = extract(x.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([x.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    out = rows.mapInArrow(run, kind)
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "text", "n_chars")
