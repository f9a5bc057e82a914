"""Main text of web pages by a tree-structured graphical model.

Every element and text of a page is a node of a tree with a hidden label, content or not. A node's own evidence is a
log-linear potential of features (tag, words in class and id, length, link density, place in the page); a parent and
a child are tied by a two-by-two potential that depends on the child's tag. Sum-product messages go up from the leaves
and down from the root; what they meet in is each node's exact marginal probability of content. Texts of a marginal
above one half are kept.

The potentials are trained by gradient ascent of the conditional likelihood of labelled pages: its gradient is observed
minus expected features, and the expectations come from the same messages. Labelled pages are a small generated set
that covers menus, sidebars, notices, adverts, forms and comments, and those of a bounded sample of the table's own pages
that mark up one article element, which labels them, but for notices, adverts, comments and the like within it. At most
TRAIN_PAGES of these are used, pages of less than 20,000 characters; in two of three the article becomes another wrapper, so that what is learned is more than its tag.

All pages of a batch are one forest, and a message pass is one array operation per depth of the trees.

Text: character references are decoded, white space in a block becomes one space, blocks are joined in page order by a
newline. Defined results: a null or empty page and one without content give ''; malformed markup closes as browsers do
for p, li and table parts, and at the end of the page otherwise; a tag without an end is dropped with what it swallows; elements
below DEEPEST levels become siblings; pages may be of any length, and are read in time in proportion to it; repeated rows are extracted one by one; an empty table
gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, read, without

TRAIN_PAGES, SEEDED, ROUNDS, RATE = 300, 1, 120, 0.5
#: Texts below these never show. Fixed values.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "textarea", "select", "option", "button"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = {
    "html", "body", "div", "p", "article", "main", "section", "nav", "aside", "header", "footer", "form", "fieldset", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "address",
    "hr", "details", "summary", "center", "caption",
}
#: Open elements that a start tag closes, up to a boundary. Fixed values.
CLOSES = {
    **dict.fromkeys(BLOCKS - {"html", "body"}, ({"p"}, {"div", "article", "main", "section", "td", "li", "body", "aside", "blockquote"})),
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
TAGS = [
    "#text", "html", "body", "div", "p", "article", "main", "section", "nav", "aside", "header", "footer", "form", "ul", "ol", "li", "a", "h1", "h2", "h3",
    "span", "b", "table", "td", "blockquote", "pre", "figure", "other", "#hidden",
]
#: Words of class, id and role attributes that are features of their own; parts of words match too.
HINTS = [
    "nav", "menu", "head", "foot", "side", "cookie", "notice", "banner", "promo", "spons", "advert", "ad", "comment", "reply", "form", "subscri", "newsletter",
    "share", "social", "related", "breadcrumb", "widget", "content", "article", "post", "entry", "main", "story", "body", "text", "legal", "popup", "modal",
]
_HINTS = [re.compile(rf"(?:^|[\s_-]){hint}" + (r"(?:s|vert)?(?=$|[\s_-])" if hint == "ad" else "")) for hint in HINTS]
WIDE = ["link_share", "long_text", "short_text", "many_stops", "after_article", "in_hidden"]
N_TAGS, N_FEATURES = len(TAGS), len(TAGS) + len(HINTS) + len(WIDE)
_TAG = {t: i for i, t in enumerate(TAGS)}
_NAME, _STOP = re.compile(r"[A-Za-z][^\s/>]*"), re.compile("[>\"']")
#: Elements may lie this deep; deeper ones become children of the last that may, as in browsers.
DEEPEST = 512
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[\s ]+")


def parse(page: str) -> tuple[list[str], list[int], list[str], list[str]]:
    """Tags ('#text' for texts), parents, names (class, id, role) and texts of a page's nodes, in page order."""
    tags, parents, names, texts, open_ = ["html"], [-1], [""], [""], [0]
    counts: dict[str, int] = {"html": 1}
    at, shown, lower, n = 0, 0, None, len(page)
    #: From where on the page has no such character, once that is known: no search goes over the rest twice.
    none = {"'": n, '"': n}

    def add(tag: str, name: str = "", text: str = "") -> int:
        tags.append(tag)
        parents.append(open_[-1])
        names.append(name)
        texts.append(text)
        return len(tags) - 1

    def close(depth: int) -> None:
        for node in open_[depth:]:
            counts[tags[node]] -= 1
        del open_[depth:]

    def tag_end(begin: int) -> int:
        """The place of the '>' that ends a tag, quoted ones passed over; the page's end if there is none."""
        while m := _STOP.search(page, begin):
            quote, begin = m[0], m.end()
            if quote == ">":
                return m.start()
            if begin < none[quote]:
                other = page.find(quote, begin)
                if other < 0:
                    none[quote] = begin
                else:
                    begin = other + 1
        return n

    while (begin := page.find("<", at)) >= 0:
        mark = page[begin + 1 : begin + 2]
        name = _NAME.match(page, begin + 2 if mark == "/" else begin + 1)
        if not name and mark not in ("!", "?"):
            at = begin + 1
            continue
        if begin > shown:
            add("#text", text=page[shown:begin])
        if not name:
            opening, closing = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, begin)), ("<", ">"))
            stop = page.find(closing, begin + len(opening))
            stop = n if stop < 0 else stop
            if opening == "<![CDATA[":
                add("#text", text=html.escape(page[begin + 9 : stop]))
            at = shown = min(stop + len(closing), n)
            continue
        tag, stop = name[0].lower(), tag_end(name.end())
        attributes = page[name.end() : stop]
        # A tag that nothing ends is dropped with all that it swallows, as in browsers.
        at = shown = min(stop + 1, n)
        if stop == n:
            break
        if mark == "/":
            for depth in range(len(open_) - 1, 0, -1) if counts.get(tag) else ():
                if tags[open_[depth]] == tag:
                    close(depth)
                    break
                if tag not in BLOCKS and tags[open_[depth]] in BLOCKS - {"p"}:
                    break
        elif tag != "html":
            closes, stops = CLOSES.get(tag, ((), ()))
            if any(counts.get(c) for c in closes):
                for depth in range(len(open_) - 1, 0, -1):
                    own = tags[open_[depth]]
                    if own in stops:
                        break
                    if own in closes:
                        close(depth)
            node = add(tag, " ".join(filter(None, (x for g in _NAMES.findall(attributes) for x in g))).lower() if "=" in attributes else "")
            if tag in RAW and not attributes.endswith("/"):
                lower = page.lower() if lower is None else lower
                stop = lower.find(f"</{tag}", at)
                stop = n if stop < 0 else stop
                if tag not in HIDDEN:
                    add("#text", text=page[at:stop])
                end = page.find(">", stop)
                at = shown = n if end < 0 else end + 1
            elif tag not in VOID and not attributes.endswith("/") and len(open_) < DEEPEST:
                open_.append(node)
                counts[tag] = counts.get(tag, 0) + 1
    if shown < n:
        add("#text", text=page[shown:])
    return tags, parents, names, texts


class Forest:
    """The nodes of some pages: arrays of tags, parents, depths and features."""

    def __init__(self, pages: list[str]):
        self.texts: list[str] = []
        tags, parents, hints, self.first = [], [], [], [0]
        self.tags: list[str] = []
        for page in pages:
            t, p, names, texts = parse(page)
            base = len(tags)
            tags += t
            parents += [base + x if x >= 0 else -1 for x in p]
            hints += names
            self.texts += texts
            self.first.append(len(tags))
        self.tags, n = tags, len(tags)
        self.parent = np.array(parents, np.int64)
        hidden = np.array([t in HIDDEN for t in tags], bool)
        self.depth = np.zeros(n, np.int64)
        up, inside_link = self.parent.tolist(), np.zeros(n, bool)
        link = np.array([t == "a" for t in tags], bool)
        depth = [0] * n
        for i, p in enumerate(up):  # parents come first
            if p >= 0:
                depth[i] = depth[p] + 1
                if hidden[p]:
                    hidden[i] = True
                if link[p] or inside_link[p]:
                    inside_link[i] = True
        self.depth, self.hidden = np.array(depth), hidden
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 1)))
        size = np.array([len(x.strip()) for x in self.texts], float) * ~hidden
        stops = np.array([x.count(".") + x.count(",") + x.count("!") + x.count("?") for x in self.texts], float) * ~hidden
        linked = size * inside_link
        for level in self.levels[:0:-1]:
            for total in (size, stops, linked):
                np.add.at(total, self.parent[level], total[level])
        kind = np.array([_TAG["#hidden"] if h else _TAG.get(t, _TAG["other"]) for t, h in zip(tags, hidden)])
        self.kind = kind
        pairs = []
        seen: dict[str, list[int]] = {}
        for i, name in enumerate(hints):
            if name:
                if name not in seen:
                    seen[name] = [j for j, hint in enumerate(_HINTS) if hint.search(name)]
                pairs += [(i, j) for j in seen[name]]
        #: Nodes and hints of their names, as pairs: few nodes have any.
        self.hinted = np.array(pairs, np.int64).reshape(-1, 2)
        wide = np.zeros((n, len(WIDE)), np.float32)
        wide[:, 0] = np.divide(linked, size, out=np.zeros(n), where=size > 0)
        wide[:, 1] = size > 200
        wide[:, 2] = (size > 0) & (size < 30)
        wide[:, 3] = stops > 3
        ends = np.array([t == "article" or t == "main" for t in tags], bool)
        wide[:, 4] = self._after(ends)
        wide[:, 5] = hidden
        self.wide = wide

    def evidence(self, weights: np.ndarray) -> np.ndarray:
        """Each node's features times their weights: its tag's, its hints', and the others'."""
        out = weights[self.kind] + self.wide @ weights[N_TAGS + len(HINTS) :]
        np.add.at(out, self.hinted[:, 0], weights[N_TAGS + self.hinted[:, 1]])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Each feature summed over all nodes, times their values."""
        tags = np.bincount(self.kind, values, N_TAGS)
        hints = np.bincount(self.hinted[:, 1], values[self.hinted[:, 0]], len(HINTS))
        return np.concatenate((tags, hints, values @ self.wide))

    def _after(self, ends: np.ndarray) -> np.ndarray:
        """1 for nodes outside of and after an article or main element of their page."""
        inside = ends.copy()
        for level in self.levels[1:]:
            inside[level] |= inside[self.parent[level]]
        out = np.zeros(len(ends))
        for a, b in zip(self.first, self.first[1:]):
            out[a:b] = (np.maximum.accumulate(ends[a:b]) if b > a else 0) & ~inside[a:b]
        return out


class Model:
    """Weights of node features, and of (child's tag, parent's label, child's label)."""

    def __init__(self):
        self.node = np.zeros(N_FEATURES)
        self.edge = np.zeros((N_TAGS, 2, 2))

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each node (n x 2) and of each node with its parent (n x 2 x 2), by sum-product up and down."""
        n = len(f.kind)
        own = np.zeros((n, 2))
        own[:, 1] = f.evidence(self.node)
        edge = self.edge[f.kind]
        up, to_parent = own.copy(), np.zeros((n, 2))
        for level in f.levels[:0:-1]:
            to_parent[level] = np.logaddexp.reduce(edge[level] + up[level][:, None, :], axis=2)
            np.add.at(up, f.parent[level], to_parent[level])
        down, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            p = f.parent[level]
            rest = down[p] + up[p] - to_parent[level]
            both = rest[:, :, None] + edge[level]
            down[level] = np.logaddexp.reduce(both, axis=1)
            both = both + up[level][:, None, :]
            joint[level] = np.exp(both - np.logaddexp.reduce(both, axis=(1, 2), keepdims=True))
        total = up + down
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True)), joint

    def train(self, f: Forest, labels: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
        """Gradient ascent (with per-weight step sizes) of the conditional likelihood of all labels."""
        inner = np.flatnonzero(f.parent >= 0)
        seen = np.zeros((len(labels), 2, 2))
        seen[inner, labels[f.parent[inner]], labels[inner]] = 1
        sums_node, sums_edge = np.full(N_FEATURES, 1e-6), np.full(self.edge.shape, 1e-6)
        for _ in range(rounds):
            marginal, joint = self.messages(f)
            g = f.sums(labels - marginal[:, 1]) / len(labels) - 1e-5 * self.node
            h = np.zeros_like(self.edge)
            np.add.at(h, f.kind[inner], (seen - joint)[inner])
            h = h / len(labels) - 1e-5 * self.edge
            sums_node += g * g
            sums_edge += h * h
            self.node += rate * g / np.sqrt(sums_node)
            self.edge += rate * h / np.sqrt(sums_edge)
        return self


#: Parts of an article that are none of its text, by tag and by words of class, id and role; and what else an article may be wrapped in.
NO_TEXT = {"nav", "aside", "form", "footer", "header"}
_NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|nav|menu|sidebar|cookie|notice|banner|promo|sponsored|comments?|reply|replies|newsletter|subscribe|share|sharing|social|related|widget|breadcrumbs?|popup|modal)(?=$|[\s_-])")
WRAPPERS = ['div class="post-content"', 'div class="story"', "div", "main", "section", 'div id="content"', "div", 'div class="story"']


def marked(page: str, number: int) -> str:
    """A page with one article element: its content marked, and the element turned into another wrapper in two of three pages."""
    wrapper = WRAPPERS[number // 3 % len(WRAPPERS)] if number % 3 else None
    page = re.sub(r"<article\b([^>]*)>", lambda m: "<x-main>" + (f"<{wrapper}>" if wrapper else m[0]), page, count=1, flags=re.I)
    return re.sub(r"</article\s*>", lambda m: (f"</{wrapper.split()[0]}>" if wrapper else m[0]) + "</x-main>", page, count=1, flags=re.I)


def seed_pages() -> list[tuple[str, str]]:
    """Generated labelled pages: (html, tag that is its content, written x-main). All other text is none."""
    words = "the of and plain long text that runs on with commas, stops and so forth. It says what it says."
    rich = lambda k: "".join(f'<p>{words} {words} part {i}, <a href="/p{i}">with a link</a> <b>in it</b>.</p>' for i in range(k))
    plain = lambda k: "".join(f"<p>{words if i % 3 else 'Briefly said.'} Part {i}.</p>" for i in range(k))
    said = ["It was late.", "Two of the four pumps had failed by then, and a third one was running hot.", "Why did no one call?", "The engineers were asked to come back on Monday, with new parts.",
            "Costs rose to nine million; most of it was paid by the county.", "Few people knew the reason, and those who did kept silent about it until the report was out.", "That was all.",
            "A second test, made in June, gave the same figures as the first one.", "In short, it works.", "They went home by train, tired but glad that the long search was over."]
    extras = {
        "nav": '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>',
        "menu": '<div class="menu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></div>',
        "header": f'<header><h1>Site name</h1><p>{words}</p></header>',
        "masthead": f'<div id="header"><h1><a href="/">Site name</a></h1><p>{words}</p></div>',
        "side": f'<div class="sidebar"><h3>More</h3><p>{words}</p><ul><li><a href="/c">Read on</a></li></ul></div>',
        "aside": f"<aside><p>{words} {words}</p></aside>",
        "cookie": f'<div id="cookie-notice"><p>{words}</p><button>OK</button></div>',
        "banner": f'<div class="banner">{words}</div>',
        "ad": f'<div class="ad">{words} {words}</div>',
        "advert": f'<div class="advert sponsored"><p>{words}</p></div>',
        "form": f'<form action="/s"><label>Search here</label><input><p>{words}</p></form>',
        "newsletter": f'<div class="newsletter-form"><p>{words}</p></div>',
        "comments": f'<section id="comments"><h3>Comments</h3><div class="comment"><p>{words} {words}</p></div><div class="comment"><p>{words}</p></div></section>',
        "share": '<div class="share social"><a href="/x">Share</a></div>',
        "related": f'<div class="related"><h3>Related</h3><p><a href="/y">{words}</a></p></div>',
        "footer": f"<footer><p>&copy; {words}</p></footer>",
        "thread": '<div class="comments">' + f'<div class="comment"><p>{words}</p></div>' * 12 + "</div>",
        "links": '<div class="sidebar"><ul>' + '<li><a href="/c">Read on</a></li>' * 15 + "</ul></div>",
        "notes": f"<aside>{'<p>' + words + '</p>'}{'<p>Briefly said.</p>' * 5}</aside>",
    }
    shells = [
        lambda b: f"<x-main><article><h1>Title of it</h1>{b}</article></x-main>",
        lambda b: f'<x-main><main id="content"><h1>Title of it</h1>{b}</main></x-main>',
        lambda b: f'<x-main><div class="post-content"><h2>Title of it</h2>{b}</div></x-main>',
        lambda b: f'<x-main><div class="article-body">{b}</div></x-main>',
        lambda b: f"<x-main><article>{b}<ul><li>An item of the text</li><li>Another one, longer</li></ul><blockquote>{words}</blockquote></article></x-main>",
        lambda b: f"<x-main><div><h1>Title of it</h1>{b}<pre>code of it</pre><table><tr><td>cell one</td><td>cell two</td></tr></table></div></x-main>",
        lambda b: f'<x-main><section class="story"><h1>Title of it</h1><p>See <a href="/z">this link</a> and <b>that</b>.</p>{b}</section></x-main>',
        lambda b: "<x-main><article><h1>Short one</h1><p>Brief.</p></article></x-main>",
        lambda b: f'<x-main><div class="content"><div class="entry"><h2>Title of it</h2>{b}</div></div></x-main>',
        lambda b: f'<x-main><div id="main"><div class="text"><div>{b}</div></div></div></x-main>',
        lambda b: f'<x-main><div class="story"><h1>Title of it</h1>{b}</div></x-main>',
        lambda b: f"<x-main><div><h1>Title of it</h1>{b}</div></x-main>",
        lambda b: f"<x-main><div>{b}</div></x-main>",
        lambda b: f"<x-main><section><h2>Title of it</h2>{b}</section></x-main>",
        lambda b: f'<x-main><main><div class="story-body"><h1>Title of it</h1><div class="section">{b}</div></div></main></x-main>',
    ]
    out, kinds = [], list(extras)
    for i, shell in enumerate(shells):
        for j in range(len(kinds)):
            before = "".join(extras[kinds[(i + j + k) % len(kinds)]] for k in (0, 4))
            after = "".join(extras[kinds[(i + 2 * j + k) % len(kinds)]] for k in (2, 7))
            inside = extras[kinds[(i * 3 + j) % len(kinds)]] if j % 3 == 0 else ""
            # From one paragraph to many, with and without links in them.
            para = (plain if (i + j // 4) % 2 else rich)((4, 2, 12, 3, 1, 30, 6)[(i + j) % 7])
            main = shell(para + (f"<x-not>{inside}</x-not>" if inside else ""))
            body = f"<div class='page'>{before}{main}{after}</div>" if j % 2 else f"{before}{main}{after}"
            out.append(f"<html><head><title>t</title></head><body>{body}</body></html>")
        # Small pages: a menu, a few short paragraphs, what stands among or after them, a footer.
        for j, k in enumerate((1, 2, 3, 5, 8)):
            for n, names in enumerate(((), ("ad",), ("share",), ("comments",), ("ad", "share", "thread"))):
                parts = [f"<p>{said[(i * 5 + j * 3 + n + q) % len(said)]}</p>" for q in range(k)]
                noise = [extras[name] for name in names]
                if n and (i + j + n) % 2:
                    parts[1:1] = [f"<x-not>{noise[0]}</x-not>"]
                    parts += [f"<x-not>{x}</x-not>" for x in noise[1:]]
                    noise = []
                out.append(f"<html><body>{extras[('nav', 'menu')[j % 2]]}{shell(''.join(parts))}{''.join(noise)}{extras['footer']}</body></html>")
    return [(x, "x-main") for x in out * SEEDED]


def seed_labels(pages: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Labels of generated pages, one array per page, and the pages without their marks."""
    plain, labels = [], []
    for page in pages:
        tags, parents, names, _ = parse(page)
        state, keep = [0] * len(tags), []
        for i, (t, p) in enumerate(zip(tags, parents)):
            above = state[p] if p >= 0 else 0
            state[i] = 1 if t == "x-main" else 0 if t == "x-not" or t in HIDDEN or t in NO_TEXT or names[i] and _NOISE.search(names[i]) else above
            if t not in ("x-main", "x-not"):
                keep.append(state[i])
        plain.append(re.sub(r"</?x-(?:main|not)>", "", page))
        labels.append(np.array(keep, np.int64))
    return plain, labels


def train(pages: DataFrame, column: str = "html", most: int = TRAIN_PAGES) -> Model:
    """The model of a table: generated labelled pages and at most `most` of its own that hold one article element."""
    once = (F.size(F.split(F.lower(F.col(f"`{column}`")), "<article")) == 2) & (F.length(f"`{column}`") < 20000)
    # By a hash of the page: the same ones however the table is cut into files. Of some four times as many candidates the
    # least are taken, so that what comes to the driver doesn't grow with the table.
    share = max(1, pages.count() // (4 * most))
    some = pages.where(F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(share)) == 0).where(once).select(F.col(f"`{column}`").alias("page"))
    chosen = some.orderBy(F.xxhash64("page"), "page").limit(most)
    rows = chosen.collect()
    plain, labels = seed_labels([p for p, _ in seed_pages()] + [marked(r[0], i) for i, r in enumerate(rows)])
    return Model().train(Forest(plain), np.concatenate(labels))


def texts(f: Forest, content: np.ndarray) -> list[str]:
    """The main text of each page: texts of content nodes, by block."""
    out = []
    for a, b in zip(f.first, f.first[1:]):
        blocks: list[list[str]] = [[]]
        owner: dict[int, int] = {}
        last = None
        # A text within inline elements (links, emphasis) shows with the block that it runs in.
        for i in range(a, b):
            tag, p = f.tags[i], int(f.parent[i])
            block = i if tag in BLOCKS or p < 0 else owner[p]
            owner[i] = block
            if block != last:
                blocks.append([])
                last = block
            if tag == "#text" and content[i if p == block else block] and not f.hidden[i]:
                blocks[-1].append(f.texts[i])
            elif tag == "br":
                blocks[-1].append(" ")
        lines = [_SPACE.sub(" ", html.unescape("".join(x))).strip() for x in blocks if x]
        out.append("\n".join(x for x in lines if x))
    return out


def extract(pages: DataFrame, model: Model, column: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of the column, all other columns kept; a column named like the added one is replaced."""
    pages = without(pages, into) if into != column else pages
    at = pages.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 100):
                part = batch.slice(a, 100)
                f = Forest([x or "" for x in part.column(at).to_pylist()])
                found = texts(f, model.messages(f)[0][:, 1] > 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, into])

    return arrow_map(pages, run, T.StructType([*pages.schema.fields, T.StructField(into, T.StringType())]))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
