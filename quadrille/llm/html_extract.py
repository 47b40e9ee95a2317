"""Main-text extraction from HTML: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.common import table

#: Fixed values of HTML: elements without content, elements whose content is text up to their end tag, elements that show none of
#: their content or are controls of forms, elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("noscript template iframe select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that a start tag of the key's group ends.
ENDS = {t: frozenset(["p"]) for t in BLOCK - {"html", "body", "option"}} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: Elements that such an end doesn't reach across.
SCOPE = frozenset("table ul ol dl article section main aside nav header footer div form body html blockquote".split())
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
#: A step through a tag: to its end, or over a value, quoted or not, or over a quote that begins none.
STEP = re.compile(r"[^>\"'=]*+(?:(>)|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

#: Attribute tokens that tell of the main text, and of the rest of a page.
GOOD = frozenset("article body content entry main post story text page prose blog news articlebody".split())
BAD = frozenset(
    "ad ads advert advertisement aside banner breadcrumb breadcrumbs bottom byline comment comments complementary contact contentinfo consent cookie cookies "
    "copyright discussion disqus donate footer form gdpr header hidden legal links login masthead menu meta modal nav navbar navigation navigation newsletter "
    "notice overlay pager pagination paywall popup privacy promo promotion recommended related replies reply respond search share sharing sidebar side "
    "signup skip social sponsor sponsored subscribe tags teaser toolbar top tracking warning widget".split()
)
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav aside header footer form dialog menu search fieldset".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    good: int
    bad: int
    y: int = -1
    own: int = 0  # characters of its own text
    links: int = 0  # of these, in links
    words: int = 0
    stops: int = 0
    kids: int = 0
    place: int = 0
    begin: int = 0  # first block of its subtree, and the one after the last
    end: int = 0
    total: list = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order, and each block's node and text. Inline elements belong to the block around them."""
    nodes = [Node("#page", -1, 0, 0, 0)]
    blocks: list[tuple[int, str]] = []
    stack, parts = [0], []
    in_link = linked = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.links += min(linked, len(text))
                node.words += text.count(" ") + 1
                node.stops += text.count(".") + text.count(",")
                blocks.append((stack[-1], text))
            parts, linked = [], 0

    def leave(upto: int) -> None:
        close()
        while len(stack) > upto:
            gone = nodes[stack.pop()]
            gone.end = len(blocks)
            if stack:
                open_tags[gone.tag] -= 1

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    at, size = 0, len(page)
    open_tags: dict[str, int] = {}  # open elements of each name
    endless: set[str] = set()  # names without an end tag further on
    while at < size:
        found = OPEN.search(page, at)
        if not found:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        name = found[2]
        if not name:  # a comment, a declaration, or what is read as a comment
            stop = page.find("-->", found.start() + 2) + 3 if found[3] else page.find(">", found.end()) + 1
            at = stop if stop > found.start() + 2 else size
            continue
        at = found.end()
        while step := STEP.match(page, at):
            at = step.end()
            if step[1]:
                break
        else:
            break  # a tag that the page ends in is none, as in a browser
        name, attributes, closing = name.lower(), page[found.end() : at - 1], found[1]
        if name in RAW or name in HIDDEN:
            if not closing and name not in endless:
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name in RAW:
                    at = size
                else:
                    endless.add(name)
            continue
        if name not in BLOCK:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 0 if closing else 1
            continue
        in_link = 0
        if closing:
            if open_tags.get(name):
                leave(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == name))
            else:
                close()
            continue
        ends = ENDS.get(name, frozenset())
        if any(open_tags.get(t) for t in ends):
            for k in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[k]].tag
                if tag in ends:
                    leave(k)
                    if not any(open_tags.get(t) for t in ends):
                        break
                elif tag in SCOPE:
                    break
        close()
        if name == "hr":
            continue
        parent = nodes[stack[-1]]
        good, bad, y = name in GOOD_TAGS, name in BAD_TAGS, parent.y
        if attributes:
            for groups in NAMES.findall(attributes):
                names = {w.lower() for w in SPLIT.split("".join(groups)) if w} | {"".join(groups).lower()}
                good += len(names & GOOD)
                bad += len(names & BAD)
            if mark := re.search(r"data-y=\"(\d)\"", attributes):
                y = int(mark[1])
        nodes.append(Node(name, stack[-1], parent.depth + 1, int(good), int(bad), y, place=parent.kids, begin=len(blocks)))
        parent.kids += 1
        stack.append(len(nodes) - 1)
        open_tags[name] = open_tags.get(name, 0) + 1
    leave(0)
    return nodes, blocks


FEATURES = 24


def described(nodes: list[Node]):
    """A row of features for each node: its own, its subtree's, its ancestors' and its siblings'."""
    import numpy as np

    n = len(nodes)
    total = [[x.own, x.links, x.words, x.stops, 1, x.tag == "p", x.tag in ("li", "td", "a")] for x in nodes]
    for k in range(n - 1, 0, -1):
        up, own = total[nodes[k].parent], total[k]
        for i in range(7):
            up[i] += own[i]
    page = total[0][0] or 1
    above_good, above_bad = [0] * n, [0] * n
    by_tag: dict[tuple[int, str], int] = {}
    beside: dict[int, float] = {}
    for k in range(1, n):
        x = nodes[k]
        by_tag[x.parent, x.tag] = by_tag.get((x.parent, x.tag), 0) + 1
        beside[x.parent] = max(beside.get(x.parent, 0), total[k][0])
    out = np.zeros((n, FEATURES))
    for k, x in enumerate(nodes):
        if k:
            above_good[k] = above_good[x.parent] + x.good
            above_bad[k] = above_bad[x.parent] + x.bad
        own, links, words, stops, size, paras, items = total[k]
        up = total[x.parent] if k else total[0]
        out[k] = (
            x.good, x.bad, above_good[k] - x.good, above_bad[k] - x.bad, x.depth, own / size, links / (own or 1), own / page, (up[0] - own) / page,
            stops / (words or 1), own / (words or 1), paras / size, items / size, np.log1p(own), np.log1p(x.own), x.links / (x.own or 1), x.kids,
            x.place, x.place / ((nodes[x.parent].kids if k else 1) or 1), by_tag.get((x.parent, x.tag), 1), own / (beside.get(x.parent, own) or 1),
            x.tag == "p", x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), x.tag in ("li", "td", "th", "dd", "dt", "option"),
        )
    return out


class Boosted:
    """Gradient-boosted regression trees for the log-odds, on features cut into bins."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32):
        self.n_trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x, y) -> Boosted:
        import numpy as np

        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, grid)) for c in x.T]
        binned = self.binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw, self.trees = np.full(len(y), self.base), []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            feature, cut, value = (np.zeros(2 ** (self.depth + 1), t) for t in (int, int, float))
            node = np.ones(len(y), int)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(node == k)
                    cut[k] = self.bins
                    if len(rows) < 8:
                        continue
                    best = 1e-3
                    g0, h0 = grad[rows].sum(), hess[rows].sum()
                    for f in range(x.shape[1]):
                        g = np.cumsum(np.bincount(binned[rows, f], grad[rows], self.bins))
                        h = np.cumsum(np.bincount(binned[rows, f], hess[rows], self.bins))
                        gain = g**2 / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0**2 / (h0 + 1)
                        if (at := int(gain[:-1].argmax())) is not None and gain[at] > best:
                            best, feature[k], cut[k] = gain[at], f, at
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            g = np.bincount(node, grad, 2 ** (self.depth + 1))
            h = np.bincount(node, hess, 2 ** (self.depth + 1))
            value = self.rate * g / (h + 1)
            raw += value[node]
            self.trees.append((feature, cut, value))
        return self

    def binned(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def log_odds(self, x):
        import numpy as np

        binned, rows = self.binned(x), np.arange(len(x))
        raw = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            raw += value[node]
        return raw


#: What one more change between kept and left parts of a page costs, in log-odds.
CHANGE = 1.0


def decoded(nodes: list[Node], odds) -> list[bool]:
    """Whether each node's own text is kept.

    A node's subtree is kept whole, left out whole, or (at a cost) divided among its children and
    its own text. So no text is kept below a part that is left out, nor left out below one that is kept.
    """
    n = len(nodes)
    odds = [float(o) for o in odds]
    gain = [odds[k] * (1 + (x.own > 0) + x.own**0.5 / 4) for k, x in enumerate(nodes)]
    whole = gain[:]
    parts = [abs(g) if x.own else 0.0 for g, x in zip(gain, nodes, strict=True)]
    best = [0.0] * n
    for k in range(n - 1, -1, -1):
        best[k] = max(whole[k], -whole[k], parts[k] - CHANGE)
        if k:
            whole[nodes[k].parent] += whole[k]
            parts[nodes[k].parent] += best[k]
    kept: list[bool | None] = [None] * n  # None: divided
    out = [False] * n
    for k, x in enumerate(nodes):
        above = kept[x.parent] if k else None
        if above is None:
            kept[k] = None if best[k] > abs(whole[k]) else whole[k] > 0
            out[k] = gain[k] > 0 if kept[k] is None else bool(kept[k])
        else:
            kept[k] = out[k] = above
    return out


def sample_pages(n: int, seed: int = 11) -> list[str]:
    """Made pages of many layouts; data-y tells which elements belong to the main text (1) or not (0)."""
    import random

    r = random.Random(seed)
    letters = ["ba", "ne", "tor", "li", "su", "kem", "ar", "o", "vin", "dal", "e", "mi", "ro", "tes", "in"]
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 14).capitalize() + r.choice("..,.")
    para = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    named = lambda *c: r.choice([f' class="{r.choice(c)}"', f' id="{r.choice(c)}"', f' class="{word()} {r.choice(c)}"', ""])
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"

    def rest(kind: str) -> str:
        if kind == "nav":
            return r.choice([f'<nav data-y="0"{named("menu", "nav")}>{menu()}</nav>', f'<div data-y="0" class="{r.choice(("menu", "navbar", "navigation", "breadcrumbs"))}">{menu()}</div>'])
        if kind == "header":
            return f'<header data-y="0"><div{named("logo", "banner")}>{words(1, 4)}</div>{r.choice(["", menu(), "<p>" + para(1, 1) + "</p>"])}</header>' if r.random() < 0.6 else f'<div data-y="0" class="{r.choice(("site-header", "masthead", "top-banner"))}"><h1>{words(1, 3)}</h1><p>{sentence()}</p></div>'
        if kind == "footer":
            text = f"&copy; {word()}.example &middot; {para(1, 3)}"
            return r.choice([f'<footer data-y="0">{text}</footer>', f'<footer data-y="0"><p>{text}</p>{menu()}</footer>', f'<div data-y="0" class="{r.choice(("footer", "site-footer", "copyright"))}">{text}</div>'])
        if kind == "side":
            inner = "".join(f"<div{named('widget')}><h3>{words(1, 3)}</h3>{r.choice([menu(), '<p>' + para(1, 3) + '</p>'])}</div>" for _ in range(r.randint(1, 3)))
            return r.choice([f'<aside data-y="0"{named("sidebar")}>{inner}</aside>', f'<div data-y="0" class="{r.choice(("sidebar", "side-bar", "related", "widget-area"))}">{inner}</div>'])
        if kind == "ad":
            return f'<div data-y="0" class="{r.choice(("ad", "ads", "advert", "ad-slot", "promo", "sponsored", "banner"))}">{r.choice([para(1, 3), "<p>" + para(1, 2) + "</p>", link()])}</div>'
        if kind == "notice":
            return f'<div data-y="0" class="{r.choice(("cookie-notice", "consent", "notice", "cookie banner", "gdpr", "popup modal"))}"><p>{para(1, 3)}</p><button>{word()}</button></div>'
        if kind == "form":
            return f'<form data-y="0" action="/{word()}"{named("newsletter", "search", "subscribe")}><label>{words(1, 6)}</label><input name="q">{r.choice(["", "<p>" + sentence() + "</p>"])}<button>{word()}</button></form>'
        one = lambda: f'<{tag}{named("comment", "reply")}><p>{r.choice(["<b>" + word() + "</b> ", ""])}{para(1, 4)}</p></{tag}>'
        tag = r.choice(["div", "li", "article"])
        return f'<{(outer := r.choice(["section", "div", "ul" if tag == "li" else "div"]))} data-y="0" {r.choice(["class", "id"])}="{r.choice(("comments", "comment-list", "discussion", "replies"))}">{r.choice(["", "<h3>" + words(1, 2) + "</h3>"])}{"".join(one() for _ in range(r.randint(1, 6)))}</{outer}>'

    def main() -> str:
        out = [f"<h1>{words(2, 9)}</h1>"] if r.random() < 0.8 else []
        loose = r.random() < 0.4  # without closing tags
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind, text = r.random(), para()
            if kind < 0.75:
                text = r.choice([text, text, f"<b>{text}" + ("<br>" if loose else "</b>"), f"{text} {link()} {sentence()}"])
                out.append(f"<p>{text}" + ("" if loose else "</p>"))
            elif kind < 0.83:
                out.append(f"<h2>{words(1, 6)}</h2><p>{text}</p>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            else:
                out.append(f"<pre>{text}\n  {text}</pre>")
            if r.random() < 0.06:
                out.append(rest(r.choice(["ad", "ad", "form", "notice", "side"])))
        return "".join(out)

    pages = []
    for _ in range(n):
        body = main()
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        name = named("content", "post", "entry-content", "article-body", "main", "story") if r.random() < 0.8 else ""
        body = f'<{tag} data-y="1"{name}>{body}</{tag}>'
        if r.random() < 0.25:
            body = body[: body.rindex("</")] + rest("comments") + body[body.rindex("</") :]
        around = ["nav", "header", "ad", "notice", "side", "form"]
        before = [rest(k) for k in r.sample(around, r.randint(0, 4))]
        after = [rest(k) for k in r.sample(["side", "ad", "comments", "footer", "form", "nav"], r.randint(0, 4))]
        if r.random() < 0.5:
            body = f'<div{named("wrapper", "container", "page", "layout")}>' + body + (after.pop() if after else "") + "</div>"
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var a='<p>';</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    return pages


#: Made pages that the trees learn from: a fixed number, whatever the input.
LEARNED_FROM = 500


@lru_cache(maxsize=1)
def learned() -> Boosted:
    import numpy as np

    xs, ys = [], []
    for page in sample_pages(LEARNED_FROM):
        nodes, _ = parse(page)
        x = described(nodes)
        some = [k for k, node in enumerate(nodes) if node.y >= 0]
        xs.append(x[some])
        ys.append([nodes[k].y for k in some])
    return Boosted().fit(np.vstack(xs), np.concatenate(ys).astype(float))


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    import numpy as np

    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    rows = [described(nodes) for nodes, _ in parsed]
    odds = np.split(model.log_odds(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1])
    out = []
    for (nodes, blocks), o in zip(parsed, odds, strict=True):
        keep = decoded(nodes, o)
        out.append("\n\n".join(text for k, text in blocks if keep[k]))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages(page_id, url, html), in the task that reads it.

    A null or empty html gives an empty text, as does a page without main text. Character
    references are decoded, white space in a block becomes one space, blocks are joined by two
    line ends; markup that isn't well formed is read as a browser would: paragraphs and list
    items end where the next begins, a quote counts only where a value begins, a slash doesn't end a
    script, and a tag that the page ends in is dropped. Reading takes time in proportion to the page. Repeated rows stay; further columns are ignored.

    The trees are learned on the driver from LEARNED_FROM made pages of many layouts and sent to
    the tasks (some hundred kB, whatever the input).
    """
    model = pages.sparkSession.sparkContext.broadcast(learned())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part["html"].to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
