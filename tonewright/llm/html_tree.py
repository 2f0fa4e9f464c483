"""Main-text extraction with a tree-structured graphical model over the DOM.

A page is parsed to a tree of elements and text nodes. Every node has two states, content and boilerplate;
its unary potential is a linear function of features (tag, words of class and id, link density, length, own
and ancestors' kinds), and each parent-child edge has a 2 x 2 potential chosen by the child's kind of tag.
Sum-product messages go from the leaves up and from the root down, level by level for all pages of a batch
at once, and give exact marginals. Text nodes with a content marginal of 0.5 or more are kept, joined to
blocks at block-level tags, in page order.

Potentials are fitted by gradient ascent on the likelihood of labelled pages: pages written by a grammar of
layouts in this module (`labelled_pages`), whose nodes' labels are known as they are written. The fit runs
once a process, from a fixed seed.

Scripts, styles, templates, comments, form controls and the head are markup, never text. An unfinished tag at
the end of a page is dropped. `p`, `li`, `td` and the like end where HTML says that another start tag ends them.

Defined cases: null or empty html gives an empty text; a page without tags is content if the model says so of
its text; repeated rows are repeated in the result; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import collections
import html as entities
import random
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.shared import read_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What shows no text of the page, or is a form.
SKIPPED = frozenset("script style template head title textarea select option button input iframe video audio datalist noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mi mn mo ms mtext mrow msup msub mfrac msqrt tspan".split())
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tag -> open tags it ends, and the tags that stop the search for them.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_STOPS = frozenset("table td th caption button object html".split())
#: Where a token may begin: a comment, a tag, a declaration.
OPENING = re.compile(r"<(?:(!--)|(/?)(?=[a-zA-Z])|[!?])")
NAME_END = re.compile(r"[\s/>]")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNFINISHED = re.compile(r"<[/!a-zA-Z]")
SPACES = re.compile(r"\s+")
BUCKETS = 4096
KINDS = ("text", "inline", "para", "heading", "list", "table", "box", "frame", "root")
KIND_OF = (
    dict.fromkeys(INLINE, 1)
    | dict.fromkeys("p blockquote pre dd dt figcaption".split(), 2)
    | dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 3)
    | dict.fromkeys("ul ol li dl menu dir".split(), 4)
    | dict.fromkeys("table tbody thead tfoot tr td th caption".split(), 5)
    | dict.fromkeys("div section figure center details main article".split(), 6)
    | dict.fromkeys("nav header footer aside form body fieldset dialog".split(), 7)
    | {"html": 8}
)


@dataclass
class Page:
    """Nodes in document order; a text node has tag None and its decoded text."""

    parent: list[int] = field(default_factory=list)
    tag: list = field(default_factory=list)
    names: list = field(default_factory=list)
    text: list = field(default_factory=list)
    label: list = field(default_factory=list)

    def add(self, parent: int, tag, names=(), text: str = "", label: int = -1) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1


def name_words(attributes: str) -> tuple[tuple[str, ...], int]:
    """Words of class, id, role and aria-label, and a label if the markup holds one (training pages do)."""
    words, label = [], -1
    if "=" in attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role", "aria-label"):
                words += [w.lower() for w in NAME_PART.findall(a or b or c)]
            elif key == "data-gold":
                label = int(a or b or c)
    return tuple(words), label


class Tokens:
    """Tags, comments and declarations of a page, in order. What was found out at one place is kept for the next ones,

    so that openings which never close cost a look, not a scan to the end each.
    """

    def __init__(self, html: str):
        self.html = html
        self.next: dict[re.Pattern, tuple[int, int]] = {}  # from where to where there is none
        self.ends: dict[int, int] = {}  # of a quote outside quotes: the tag's end, or -1

    def first(self, pattern: re.Pattern, at: int) -> int:
        """Place of the pattern's first match from a place on, or the page's end."""
        since, place = self.next.get(pattern, (0, -1))
        if not since <= at <= place:
            found = pattern.search(self.html, at)
            place = found.start() if found else len(self.html)
            self.next[pattern] = (at, place)
        return place

    def tag_end(self, at: int) -> int:
        """After the > that ends a tag, quoted parts left out; -1 if a quote or the tag isn't closed."""
        path, end = [], -1
        while True:
            at = self.first(SPECIAL, at)
            if at == len(self.html):
                break
            if self.html[at] == ">":
                end = at + 1
                break
            if at in self.ends:
                end = self.ends[at]
                break
            path.append(at)
            at = self.html.find(self.html[at], at + 1) + 1
            if not at:
                break
        self.ends.update(dict.fromkeys(path, end))
        return end

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, slash, name and attributes of the next token; comments and declarations have no name."""
        html = self.html
        while found := OPENING.search(html, at):
            start = found.start()
            if found[1]:
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, "", "", ""
            if found[2] is None:
                end = html.find(">", start)
                return start, len(html) if end < 0 else end + 1, "", "", ""
            named = self.first(NAME_END, found.end())
            if (end := self.tag_end(named)) > 0:
                return start, end, found[2], html[found.end() : named].lower(), html[named : end - 1]
            at = start + 1
        return None


def parse(html: str) -> Page:
    """A forgiving tree builder: enough of HTML's implied end tags for block structure."""
    page = Page()
    stack = [page.add(-1, "html")]
    tags = ["html"]
    at, size = 0, len(html)
    gold = [-1]
    tokens = Tokens(html)
    depths: collections.defaultdict[str, list[int]] = collections.defaultdict(list)  # of open tags, by name
    paragraphs: list[int] = []  # depths of open p and of what stops the search for it
    blocks: list[int] = []  # depths of open tags that end a p

    def write(raw: str) -> None:
        if raw and not raw.isspace():
            page.add(stack[-1], None, (), entities.unescape(raw) if "&" in raw else raw, gold[-1])
        elif raw:
            page.add(stack[-1], None, (), " ", gold[-1])

    def enter(name: str, node: int, label: int) -> None:
        for kept, held in ((depths[name], True), (paragraphs, name == "p" or name in P_STOPS), (blocks, name in P_ENDERS)):
            if held:
                kept.append(len(tags))
        stack.append(node)
        tags.append(name)
        gold.append(label)

    def close(depth: int) -> None:
        for name in tags[depth:]:
            depths[name].pop()
        for kept in (paragraphs, blocks):
            while kept and kept[-1] >= depth:
                kept.pop()
        del stack[depth:], tags[depth:], gold[depth:]

    while at < size:
        found = tokens.after(at)
        if not found:
            rest = html[at:]
            cut = UNFINISHED.search(rest, rest.rfind(">") + 1)
            write(rest[: cut.start()] if cut else rest)
            break
        start, end, slash, name, attributes = found
        write(html[at:start])
        at = end
        if not name:
            continue
        if slash:
            if depths[name]:
                depth = depths[name][-1]
                if name not in INLINE or not blocks or blocks[-1] < depth:
                    close(depth)
            elif name == "p":
                page.add(stack[-1], "p")
            elif name == "br":
                page.add(stack[-1], "br")
            continue
        if name in ("html", "body"):
            if name == "body" and not depths["body"]:
                enter("body", page.add(stack[-1], "body", name_words(attributes)[0]), gold[-1])
            continue
        if name in P_ENDERS:
            if paragraphs and tags[paragraphs[-1]] == "p":
                close(paragraphs[-1])
            if name[0] == "h" and name[1:].isdigit() and tags[-1][0] == "h" and tags[-1][1:].isdigit():
                close(len(tags) - 1)
        if name in ENDED_BY:
            ends, stops = ENDED_BY[name]
            stop = max((depths[t][-1] for t in stops if depths[t]), default=0)
            inner = [depths[t][k] for t in ends if (k := bisect_right(depths[t], stop)) < len(depths[t])]
            if inner:
                close(min(inner))
        words, label = name_words(attributes)
        node = page.add(stack[-1], name, words, "", label)
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(html, at)
            if name == "xmp":  # text as it stands, without markup or references
                page.add(node, None, (), html[at : end.start() if end else size], gold[-1])
            at = size if not end else end.start()
            if end:
                closing = html.find(">", at)
                at = size if closing < 0 else closing + 1
            continue
        if name not in VOID and not attributes.rstrip().endswith("/"):
            enter(name, node, label if label >= 0 else gold[-1])
    return page


def bucket(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % BUCKETS


_BUCKETS: dict[tuple[str, str], int] = {}


def cached_bucket(kind: str, word: str) -> int:
    key = (kind, word)
    found = _BUCKETS.get(key)
    if found is None:
        if len(_BUCKETS) > 50_000:
            _BUCKETS.clear()
        found = _BUCKETS[key] = bucket(kind, word)
    return found


@dataclass
class Forest:
    """All nodes of a batch of pages: parents, depths, kinds, features (sparse and dense)."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    dense: np.ndarray
    skipped: np.ndarray
    levels: list


DENSE = 10


def assemble(pages: list[Page]) -> Forest:
    parents, kinds, rows, columns, skips, lengths, punctuation, words = [], [], [], [], [], [], [], []
    base = 0
    for page in pages:
        skip: list[bool] = []
        for i, (p, tag, names) in enumerate(zip(page.parent, page.tag, page.names, strict=True)):
            parents.append(p + base if p >= 0 else -1)
            above = skip[p] if p >= 0 else False
            skip.append(above or tag in SKIPPED)
            if tag is None:
                kinds.append(0)
                text = page.text[i]
                shown = 0 if above else len(text) if not text.isspace() else 0
                lengths.append(shown)
                punctuation.append(sum(map(text.count, ".,;:!?")) if shown else 0)
                words.append(text.count(" ") + 1 if shown else 0)
                rows.append(base + i)
                columns.append(cached_bucket("under", page.tag[p]))
                for w in page.names[p]:
                    rows.append(base + i)
                    columns.append(cached_bucket("under name", w))
            else:
                kinds.append(KIND_OF.get(tag, 6))
                lengths.append(0)
                punctuation.append(0)
                words.append(0)
                rows.append(base + i)
                columns.append(cached_bucket("tag", tag))
                for w in names:
                    rows.append(base + i)
                    columns.append(cached_bucket("name", w))
        skips += skip
        base += len(page.parent)
    parent = np.array(parents, np.int64)
    kind = np.array(kinds, np.int64)
    depth = np.zeros(base, np.int64)
    links = np.zeros(base, bool)
    tags = [t for page in pages for t in page.tag]
    for i, p in enumerate(parents):  # parents come before children
        if p >= 0:
            depth[i] = depth[p] + 1
            links[i] = links[p] or tags[i] == "a"
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    length = np.array(lengths, np.float64)
    totals = np.stack([length, length * links, np.array(punctuation, np.float64), np.array(words, np.float64), (length > 0).astype(np.float64)], axis=1)
    for level in levels[:0:-1]:
        np.add.at(totals, parent[level], totals[level])
    chars, linked, marks, count, texts = totals.T
    seen = np.maximum(chars, 1)
    dense = np.stack([
        np.ones(base), np.log1p(chars) / 6, linked / seen, np.minimum(marks / seen * 20, 2), np.log1p(count) / 5,
        np.log1p(texts) / 4, (chars == 0) * 1.0, np.minimum(depth, 12) / 12, (chars < 25) * 1.0, (chars > 200) * 1.0,
    ], axis=1)
    return Forest(parent, depth, kind, np.array(rows, np.int64), np.array(columns, np.int64), dense, np.array(skips, bool), levels)


@dataclass
class TreeModel:
    """Unary weights (buckets and dense features; per state the difference content - boilerplate) and edge potentials by kind."""

    sparse: np.ndarray
    dense: np.ndarray
    edges: np.ndarray  # kind of child, parent state, child state

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of each node, and edge marginals (node, parent state, own state)."""
        n = len(f.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = np.bincount(f.rows, self.sparse[f.columns], n) + (f.dense * self.dense[np.minimum(f.kind, 2)]).sum(1)
        edge = self.edges[f.kind]
        up = unary.copy()  # unary plus messages of the children
        message = np.zeros((n, 2))
        for level in f.levels[:0:-1]:
            total = edge[level] + up[level][:, None, :]
            message[level] = np.logaddexp(total[:, :, 0], total[:, :, 1])
            np.add.at(up, f.parent[level], message[level])
        belief = up.copy()
        pair = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            outside = belief[f.parent[level]] - message[level]
            joint = outside[:, :, None] + edge[level] + up[level][:, None, :]
            pair[level] = joint
            belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        pair -= pair.max(axis=(1, 2), keepdims=True)
        pair = np.exp(pair)
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        return content, pair


def complete_labels(page: Page) -> np.ndarray:
    """Labels of all nodes: a text has its nearest marked ancestor's; an element is content if any text below is."""
    label = np.zeros(len(page.parent), np.int64)
    for i in range(len(page.parent) - 1, 0, -1):
        if page.tag[i] is None and page.label[i] == 1 and not page.text[i].isspace():
            label[i] = 1
        if label[i]:
            label[page.parent[i]] = 1
    inside = [False] * len(page.parent)
    for i, p in enumerate(page.parent):
        marked = page.label[i]
        inside[i] = marked == 1 or (marked != 0 and p >= 0 and inside[p])
        if inside[i] and page.tag[i] is not None:
            label[i] = 1
        if page.tag[i] is None and page.text[i].isspace():
            label[i] = int(p >= 0 and inside[p])
    return label


def fit(pages: list[Page], rounds: int = 250) -> TreeModel:
    """Gradient ascent on the labelled pages' log likelihood (observed less expected counts), with Adam."""
    f = assemble(pages)
    y = np.concatenate([complete_labels(p) for p in pages])
    model = TreeModel(np.zeros(BUCKETS), np.zeros((3, DENSE)), np.zeros((len(KINDS), 2, 2)))
    group = np.minimum(f.kind, 2)
    has = f.parent >= 0
    observed = np.zeros((len(f.parent), 2, 2))
    observed[np.flatnonzero(has), y[f.parent[has]], y[has]] = 1
    states = [[np.zeros_like(v), np.zeros_like(v)] for v in (model.sparse, model.dense, model.edges)]
    for k in range(1, rounds + 1):
        content, pair = model.marginals(f)
        gap = y - content
        sparse = np.bincount(f.columns, gap[f.rows], BUCKETS)
        dense = np.stack([(f.dense[group == g] * gap[group == g, None]).sum(0) for g in range(3)])
        edges = np.zeros_like(model.edges)
        np.add.at(edges, f.kind[has], (observed - pair)[has])
        size = len(pages)
        for value, grad, (first, second) in zip((model.sparse, model.dense, model.edges), (sparse, dense, edges), states, strict=True):
            grad = grad / size - 0.0003 * value
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return model


def labelled_pages(count: int = 360, seed: int = 5) -> list[str]:
    """Pages of many layouts, with data-gold="1" on the article's text and data-gold="0" on the rest."""
    rng = random.Random(seed)
    syllables = "ka lo mi ter an sol ve ri do shen ul ba net gor pli es ta rum ine cor".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return words(3, 16).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose(few: int = 1, many: int = 6) -> str:
        text = " ".join(sentence() for _ in range(rng.randint(few, many)))
        if rng.random() < 0.3:
            parts = text.split(" ")
            at = rng.randrange(len(parts))
            tag = rng.choice(["a href='/x'", "b", "em", "i", "strong", "code", "span"])
            parts[at] = f"<{tag}>{parts[at]}</{tag.split()[0]}>"
            text = " ".join(parts)
        return text

    def names(*options: str) -> str:
        chosen = rng.choice(options)
        return "" if not chosen else f' {rng.choice(["class", "class", "id"])}="{chosen}"'

    def menu(label: str = "nav") -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(3, 12))]
        style = rng.randrange(3)
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style == 0 else " | ".join(items) if style == 1 else "".join(f"<span>{x}</span>" for x in items)
        return rng.choice([f"<nav{names('', 'menu', 'main-nav')}>{body}</nav>", f"<div{names('nav', 'navbar', 'menu', 'top-menu', 'breadcrumbs', 'site-navigation')}>{body}</div>"])

    def part(kind: str) -> str:
        if kind == "menu":
            body = menu()
        elif kind == "header":
            body = f"<header{names('', 'site-header', 'masthead')}><a href='/'>{words(1, 3)}</a><p>{words(2, 7)}</p>{menu() if rng.random() < 0.5 else ''}</header>"
        elif kind == "footer":
            inner = rng.choice([f"&copy; {rng.randint(1999, 2030)} {words(1, 4)} &middot; {sentence()}", f"<p>{sentence()}</p>{menu()}", f"<p>{words(2, 5)}. {words(2, 9)}.</p>"])
            body = rng.choice([f"<footer{names('', 'site-footer')}>{inner}</footer>", f"<div{names('footer', 'site-footer', 'copyright', 'colophon')}>{inner}</div>"])
        elif kind == "aside":
            inner = f"<h3>{words(1, 4)}</h3>" + rng.choice([menu(), f"<p>{prose()}</p>", f"<ul><li><a href='/'>{words(2, 8)}</a></li><li><a href='/'>{words(2, 8)}</a></li></ul>"])
            body = rng.choice([f"<aside{names('', 'sidebar', 'widget')}>{inner}</aside>", f"<div{names('sidebar', 'widget', 'side-column', 'related', 'related-posts', 'recommended', 'share', 'social', 'tags', 'newsletter')}>{inner}</div>"])
        elif kind == "advert":
            inner = rng.choice([sentence(), f"<p>{prose(1, 4)}</p>", f"<a href='/buy'>{words(2, 8)}</a>"])
            body = f"<{(t := rng.choice(['div', 'div', 'section', 'aside']))}{names('ad', 'ads', 'advert', 'advertisement', 'banner-ad', 'sponsored', 'promo', 'ad-slot')}>{inner}</{t}>"
        elif kind == "notice":
            inner = rng.choice([prose(1, 3), f"<p>{prose(1, 3)}</p><button>{word()}</button>", f"{prose(1, 2)} <a href='/p'>{word()}</a>"])
            body = f"<{(t := rng.choice(['div', 'div', 'section', 'aside', 'dialog']))}{names('cookie', 'cookie-notice', 'notice', 'consent', 'gdpr-banner', 'popup', 'modal', 'alert', 'paywall', 'subscribe', 'disclaimer')}>{inner}</{t}>"
        elif kind == "form":
            body = f"<form{names('', 'search', 'login', 'signup', 'newsletter-form')}><label>{words(1, 3)}</label><input name='q'><p>{words(2, 9)}</p><button>{word()}</button></form>"
        else:
            each = [f"<{(t := rng.choice(['li', 'div', 'article']))}{names('comment', 'comment-body', 'reply')}><b>{word()}</b> <p>{prose(1, 4)}</p></{t}>" for _ in range(rng.randint(1, 5))]
            body = f"<{(t := rng.choice(['section', 'div', 'div', 'ol']))}{names('comments', 'comment-list', 'disqus-thread', 'responses', 'discussion', 'user-comments')}><h3>{words(1, 3)}</h3>{''.join(each)}</{t}>"
        return gold(body, 0)

    def gold(body: str, value: int) -> str:
        """Marks the outermost tag."""
        return re.sub(r"^<(\w+)", rf'<\1 data-gold="{value}"', body, count=1)

    pages = []
    for _ in range(count):
        blocks = []
        if rng.random() < 0.8:
            blocks.append(rng.choice([f"<h1>{words(2, 10)}</h1>", f"<h1{names('title', 'entry-title', 'headline')}>{words(2, 10)}</h1>", f"<h2>{words(2, 8)}</h2>"]))
        loose = rng.random() < 0.35
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            pick = rng.random()
            if pick < 0.7:
                blocks.append(f"<p><b>{prose()}<br>" if loose and rng.random() < 0.3 else f"<p>{rng.choice([prose(), prose(), sentence(), words(1, 3) + '.'])}</p>")
            elif pick < 0.78:
                blocks.append(f"<h{(k := rng.randint(2, 4))}>{words(1, 7)}</h{k}>")
            elif pick < 0.86:
                t = rng.choice(["ul", "ol"])
                blocks.append(f"<{t}>" + "".join(f"<li>{rng.choice([prose(1, 2), words(1, 6)])}</li>" for _ in range(rng.randint(2, 6))) + f"</{t}>")
            elif pick < 0.9:
                blocks.append(f"<blockquote><p>{prose()}</p></blockquote>" if rng.random() < 0.5 else f"<pre>{words(3, 20)}</pre>")
            elif pick < 0.94:
                blocks.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif pick < 0.97:
                blocks.append(f"<figure><img src='x.png'><figcaption>{sentence()}</figcaption></figure>")
            else:
                blocks.append(f"<div>{prose()}</div>")
        inside = []
        for b in blocks:
            inside.append(b)
            if rng.random() < 0.05:
                inside.append(part(rng.choice(["advert", "aside", "notice", "form"])))
        if rng.random() < 0.15:
            inside.append(part("comments"))
        body = "".join(inside)
        holder = rng.choice(["article", "article", "article", "main", "div", "section"])
        named = names("", "post", "entry") if holder in ("article", "main") else names("content", "article", "post", "entry-content", "post-body", "main-text", "story", "article-body")
        main = gold(f"<{holder}{named}>{body}</{holder}>", 1)
        if rng.random() < 0.3:
            main = f"<div{names('wrapper', 'container', 'page', 'main', 'row', 'content')}>{main}{part('comments') if rng.random() < 0.4 else ''}{part('aside') if rng.random() < 0.4 else ''}</div>"
        before = [part(k) for k in rng.sample(["menu", "menu", "header", "advert", "notice", "form", "aside"], rng.randint(0, 4))]
        after = [part(k) for k in rng.sample(["footer", "footer", "comments", "aside", "advert", "menu", "notice", "form"], rng.randint(0, 4))]
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
        if rng.random() < 0.08:
            page = page[: int(len(page) * rng.uniform(0.6, 1))]
        pages.append(page)
    return pages


_MODEL: list[TreeModel] = []


def trained_model() -> TreeModel:
    if not _MODEL:
        _MODEL.append(fit([parse(p) for p in labelled_pages()]))
    return _MODEL[0]


def blocks_of_text(page: Page, keep) -> list[str]:
    """Kept text nodes joined to blocks: a block-level tag ends a block, a line break is white space."""
    blocks, current = [], []
    order = range(len(page.parent))
    home: list[int] = []  # nearest block-level ancestor or self
    last = None
    for i in order:
        tag, parent = page.tag[i], page.parent[i]
        if tag is None or tag in INLINE:
            home.append(home[parent] if parent >= 0 else i)
        else:
            home.append(i)
            last = None  # a block's start ends the block before it
        if tag == "br" and current:
            current.append(" ")
        if tag is None and keep[i]:
            if last != home[i] and current:
                blocks.append(current)
                current = []
            last = home[i]
            current.append(page.text[i])
    if current:
        blocks.append(current)
    joined = (SPACES.sub(" ", "".join(b)).strip() for b in blocks)
    return [b for b in joined if b]


def extract(pages: list[str | None], model: TreeModel) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    f = assemble(parsed)
    content, _ = model.marginals(f)
    keep = (content >= 0.5) & ~f.skipped
    out, at = [], 0
    for page in parsed:
        size = len(page.parent)
        out.append("\n\n".join(blocks_of_text(page, keep[at : at + size])))
        at += size
    return out


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_model())

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            html = batch.column(2).to_pylist()
            start = held = 0
            for i, page in enumerate(html):
                held += len(page or "")
                if held > 400_000 or i == len(html) - 1:
                    texts += extract(html[start : i + 1], shared.value)
                    start, held = i + 1, 0
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
