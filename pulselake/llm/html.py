"""Main-text extraction: gradient-boosted trees over DOM-node features and a decoding that keeps nodes and ancestors consistent."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boost import Trees, fit_trees

#: Elements without end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style noscript template head title iframe svg math object canvas audio video select option button textarea input datalist map".split())
#: Elements that start a block of their own.
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}}
#: Attribute tokens that tell furniture, reader talk and main text.
FURNITURE = frozenset(
    "ad ads adv advert advertisement adverts banner bar breadcrumb breadcrumbs byline consent cookie cookies copyright cta disclaimer donate dropdown "
    "follow foot footer form gdpr head header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notification overlay pager pagination "
    "paywall popup privacy promo promoted promotion rail recommended related share sharing sidebar side signup skip social sponsor sponsored sponsors subscribe "
    "tag tags teaser toc toolbar top trending warning widget widgets alert aside".split()
)
TALK = frozenset("comment comments commentlist disqus discussion reply replies respond responses review reviews thread".split())
MAIN = frozenset("article articlebody body content copy entry hentry main maincontent page post postbody prose story storybody text".split())
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.,;:!?]")


class Page(HTMLParser):
    """Element nodes in page order, with the text events of the page: (node, text), text None at the border of a block."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.attrs, self.depth = ["#root"], [-1], [""], [0]
        self.stack = [0]
        self.hidden = 0
        self.events: list[tuple[int, str | None]] = []
        self.feed(html)
        self.close()

    def _pop_to(self, k: int) -> None:
        for i in self.stack[k:]:
            self.hidden -= self.tag[i] in HIDDEN
            if self.tag[i] in BLOCK:
                self.events.append((0, None))
        del self.stack[k:]

    def _close_open(self, names: set[str], scope: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t in names:
                self._pop_to(k)
                return
            if t in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.events.append((0, None))
            if tag == "body":
                self._close_open({"head"}, set())
            if tag != "br":
                self._close_open({"p"}, {"td", "th", "button", "table", "div", "article", "section", "li", "blockquote"} if tag != "p" else {"td", "th", "button", "table"})
        if tag in _CLOSES:
            self._close_open(_CLOSES[tag], _SCOPE[tag])
        if tag in VOID:
            if tag == "input":
                self._node(tag, attrs)
            return
        self.stack.append(self._node(tag, attrs))
        self.hidden += tag in HIDDEN

    def _node(self, tag: str, attrs: list) -> int:
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.depth.append(self.depth[self.stack[-1]] + 1)
        text = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label", "data-testid"))
        if any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) or (k == "aria-hidden" and v == "true") for k, v in attrs):
            text += " hidden"
        self.attrs.append(text)
        return len(self.tag) - 1

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t == tag:
                self._pop_to(k)
                break
            if t in BLOCK and tag not in BLOCK and tag not in HIDDEN:
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden and data:
            self.events.append((self.stack[-1], data))


_KINDS = ["article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "a", "span"]
N_FEATURES = len(_KINDS) + 27


@lru_cache(20_000)
def _attr_counts(text: str) -> tuple[int, int, int]:
    tokens = _TOKEN.findall(_CAMEL.sub(" ", text).lower())
    return sum(t in FURNITURE for t in tokens), sum(t in TALK for t in tokens), sum(t in MAIN for t in tokens)


def features(page: Page) -> np.ndarray:
    """One row for each node: tag, attribute tokens, own and inherited; density, links and punctuation of the subtree; depth, place and siblings."""
    n = len(page.tag)
    parent = page.parent
    own = np.zeros((n, 4))
    chars = own[:, 0]
    is_link = [False] * n
    for i in range(1, n):
        is_link[i] = page.tag[i] == "a" or is_link[parent[i]]
    before = np.zeros(n)
    seen = 0
    first = [-1] * n
    for node, text in page.events:
        if text is None:
            continue
        size = len(text)
        own[node, 0] += size
        own[node, 1] += size if is_link[node] else 0
        own[node, 2] += len(_SENTENCE.findall(text))
        own[node, 3] += text.count(" ")
        if first[node] < 0:
            first[node] = seen
        seen += size
    sub = own.copy()
    tags = np.ones(n)
    counts = np.zeros((n, 5))
    for i, t in enumerate(page.tag):
        if t == "p":
            counts[i, 0] = 1
        elif t == "a":
            counts[i, 1] = 1
        elif t == "li":
            counts[i, 2] = 1
        elif t == "input" or t == "button" or t == "textarea" or t == "select":
            counts[i, 3] = 1
        elif t in ("h1", "h2", "h3"):
            counts[i, 4] = 1
    kids = [0] * n
    alike: dict[tuple[int, str], tuple[int, float]] = {}
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub[p] += sub[i]
        tags[p] += tags[i]
        counts[p] += counts[i]
        kids[p] += 1
        m, longest = alike.get((p, page.tag[i]), (0, 0.0))
        alike[p, page.tag[i]] = m + 1, max(longest, sub[i, 0])
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    total = max(1.0, sub[0, 0])
    x = np.zeros((n, N_FEATURES))
    k = len(_KINDS)
    inherited = np.zeros((n, 4))
    for i in range(n):
        t = page.tag[i]
        if t in _KIND_AT:
            x[i, _KIND_AT[t]] = 1
        p = parent[i]
        a = _attr_counts(page.attrs[i]) if page.attrs[i] else (0, 0, 0)
        x[i, k : k + 3] = a
        if p >= 0:
            inherited[i, :3] = inherited[p, :3] + a
            inherited[i, 3] = inherited[p, 3] + (t in ("article", "main"))
            x[i, k + 3 : k + 7] = inherited[p]
            m, longest = alike[p, t]
            x[i, k + 7] = kids[p]
            x[i, k + 8] = m
            x[i, k + 9] = sub[i, 0] / max(1.0, sub[p, 0])
            x[i, k + 10] = longest
            x[i, k + 26] = 1.0 if page.tag[p] in ("nav", "footer", "aside", "form", "header") else 0.0
    size = np.maximum(1.0, sub[:, 0])
    x[:, k + 11] = page.depth
    x[:, k + 12] = sub[:, 0]
    x[:, k + 13] = own[:, 0]
    x[:, k + 14] = sub[:, 1] / size
    x[:, k + 15] = sub[:, 2] / size * 100
    x[:, k + 16] = sub[:, 3]
    x[:, k + 17] = size / tags
    x[:, k + 18] = tags
    x[:, k + 19 : k + 24] = counts
    x[:, k + 24] = np.maximum(0, first) / total
    x[:, k + 25] = sub[:, 0] / total
    return x


_KIND_AT = {t: i for i, t in enumerate(_KINDS)}


#: What dropping a node under a kept parent costs in log-likelihood.
SWITCH = 2.0


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """Which nodes are main text. A node that is out takes its subtree along; among such choices the likeliest one.

    Dynamic programming from the leaves: keeping a node adds its evidence and leaves its children free,
    dropping it adds the evidence against every node below it.
    """
    n = len(page.tag)
    judged = [t in BLOCK or bool(a) for t, a in zip(page.tag, page.attrs)]
    keep = np.zeros(n)
    drop = np.zeros(n)
    odds = np.clip(log_odds, -6, 6)
    for i in range(n):
        if judged[i]:
            keep[i], drop[i] = -np.log1p(np.exp(-odds[i])), -np.log1p(np.exp(odds[i]))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i] - SWITCH)
        drop[p] += drop[i]
    inside = [True] * n
    for i in range(1, n):
        t = page.tag[i]
        inside[i] = inside[page.parent[i]] and (t in ("html", "body") or (t not in HIDDEN and keep[i] >= drop[i] - SWITCH))
    return inside


def main_text(page: Page, inside: list[bool]) -> str:
    """Blocks of the kept nodes in page order, white space made one space."""
    blocks, run = [], []
    for node, text in page.events:
        if text is None:
            if run:
                blocks.append("".join(run))
                run = []
        elif inside[node]:
            run.append(text)
    if run:
        blocks.append("".join(run))
    return " ".join(w for b in blocks for w in b.split())


def training_pages(n: int = 500, seed: int = 7, named: float = 1.0) -> Iterator[tuple[Page, list[bool]]]:
    """Pages put together by rule from invented words, with the truth for each node. ``named``: share of the classes and ids that tell what they are; the others are invented words.

    Layouts differ in element and attribute names, depth, and in which furniture stands where, inside the article too.
    """
    rnd = random.Random(seed)
    syllables = "ba de ki lo mu ra se ti no pe sha tor in an er on ly al re".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    def sentence(lo: int = 1, hi: int = 25) -> str:
        return " ".join(word() for _ in range(rnd.randint(lo, hi))).capitalize() + rnd.choice([".", ".", ".", "?", "!", "&amp;", ", &c."])

    def prose(hi: int = 6) -> str:
        return " ".join(sentence() for _ in range(rnd.randint(1, hi)))

    def links(m: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()} {word() if rnd.random() < 0.4 else ""}</a></li>' for _ in range(m)) + "</ul>"

    def cls(*names: str) -> str:
        name = rnd.choice(names) if named >= 1 or rnd.random() < named else word()
        name = rnd.choice([name, name, f"{name}-{word()}", f"site-{name}", f"{word()} {name}", f"js-{name}"])
        return f' {rnd.choice(["class", "class", "id"])}="{name}"'

    def furniture() -> str:
        kind = rnd.randrange(12)
        box = rnd.choice(["div", "div", "section", "aside", "p"])
        if kind == 0:
            return f"<nav{cls('menu', 'nav') if rnd.random() < 0.5 else ''}>{links(rnd.randint(2, 9))}</nav>"
        if kind == 1:
            return f"<div{cls('menu', 'nav', 'navigation', 'breadcrumb', 'pagination', 'links')}>{links(rnd.randint(2, 9))}</div>"
        if kind == 2:
            return f"<{box}{cls('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo', 'advertisement')}>{prose(3)}</{box}>"
        if kind == 3:
            return f"<aside{cls('sidebar', 'related', 'widget') if rnd.random() < 0.6 else ''}>{'<h3>' + sentence(1, 5) + '</h3>' if rnd.random() < 0.6 else ''}{links(4) if rnd.random() < 0.5 else '<p>' + prose(3) + '</p>'}</aside>"
        if kind == 4:
            return f"<div{cls('sidebar', 'related', 'recommended', 'widget', 'teaser', 'trending')}><h3>{sentence(1, 5)}</h3>{rnd.choice([links(4), '<p>' + prose(3) + '</p>'])}</div>"
        if kind == 5:
            return f"<{box}{cls('cookie', 'notice', 'consent', 'gdpr', 'popup', 'newsletter', 'alert')}>{prose(3)} <button>{word()}</button></{box}>"
        if kind == 6:
            return f"<form{cls('search', 'login', 'signup', 'subscribe') if rnd.random() < 0.5 else ''}><label>{sentence(1, 5)}</label><input name='q'><p>{prose(2)}</p><button>{word()}</button></form>"
        if kind == 7:
            one = rnd.choice(["div", "li", "article"])
            items = "".join(f"<{one}{cls('comment', 'reply')}><b>{word()}</b><p>{prose(4)}</p></{one}>" for _ in range(rnd.randint(1, 6)))
            outer = rnd.choice(["div", "section", "ol"])
            return f"<{outer}{cls('comments', 'discussion', 'responses', 'respond', 'reviews')}><h3>{sentence(1, 4)}</h3>{items}</{outer}>"
        if kind == 8:
            return f"<div{cls('share', 'social', 'follow', 'toolbar', 'tags')}>{''.join(f'<a href=#>{word()}</a> ' for _ in range(rnd.randint(2, 6)))}</div>"
        if kind == 9:
            return f"<div{cls('byline', 'meta', 'disclaimer', 'copyright', 'legal', 'privacy')}>{sentence(3, 12)}</div>"
        if kind == 10:
            return f"<header{cls('header', 'masthead') if rnd.random() < 0.5 else ''}><a href=/>{word()}</a><p>{sentence(1, 8)}</p></header>"
        return f"<footer{cls('footer') if rnd.random() < 0.4 else ''}>{rnd.choice(['&copy; ', ''])}{word()}.example &middot; {prose(2)}</footer>"

    def content() -> str:
        out = [f"<h1>{sentence(2, 9)}</h1>"] if rnd.random() < 0.85 else []
        long = rnd.choice([3, 6, 6, 40])
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 9, 16, 30])):
            r = rnd.random()
            if r < 0.50:
                out.append(f"<p>{prose(long) if rnd.random() < 0.8 else sentence(1, 2)}</p>")
            elif r < 0.62:
                inner = [sentence(), f'<a href="/x">{word()} {word() if rnd.random() < 0.5 else ""}</a>', f"<b>{word()}</b>", sentence(), f"<em>{word()}</em>", "<br>"]
                out.append(f"<p>{' '.join(rnd.sample(inner, rnd.randint(2, 6)))}</p>")
            elif r < 0.70:
                out.append(f"<p><b>{prose(2)}<br><p>{prose(long)}</p>")
            elif r < 0.76:
                out.append(f"<h2>{sentence(1, 7)}</h2>")
            elif r < 0.82:
                out.append("<ul>" + "".join(f"<li>{prose(2)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif r < 0.86:
                out.append(f"<blockquote><p>{prose(3)}</p></blockquote>")
            elif r < 0.90:
                out.append(f"<div>{prose()}</div>")
            elif r < 0.94:
                out.append(f'<p>{sentence()} <a href="/x">{word()}</a> {sentence()}</p>')
            elif r < 0.97:
                out.append("<table><tr>" + "".join(f"<td>{sentence(1, 5)}</td>" for _ in range(4)) + "</tr></table>")
            else:
                out.append(f"<pre>{word()} {word()}\n{word()}</pre>")
        return "".join(out)

    mark = "data-truth"
    for _ in range(n):
        body = content()
        parts = re.split(r"(?<=</p>)", body)
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            parts.insert(rnd.randint(0, len(parts)), f"<i-out>{furniture()}</i-out>")
        style = rnd.randrange(6)
        open_, close = [
            ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div{cls('article', 'content', 'post', 'entry', 'story', 'main')}>", "</div>"),
            (f"<div><div{cls('content', 'text', 'body')}>", "</div></div>"), ("<section><div>", "</div></section>"),
        ][style]
        main = f"<i-in>{open_}{''.join(parts)}{close}</i-in>"
        around = [furniture() for _ in range(rnd.randint(1, 6))]
        at = rnd.randint(0, len(around))
        wrap = rnd.choice([("", ""), ("<div>", "</div>"), ('<div class="wrapper">', "</div>"), ('<div id="page">', "</div>")])
        html = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{wrap[0]}{''.join(around[:at])}{main}{''.join(around[at:])}{wrap[1]}</body></html>"
        page = Page(html)
        truth = [False] * len(page.tag)
        wraps = {i for i in range(len(page.tag)) if page.tag[i] == "i-in"}
        above = set()
        for i in wraps:
            while i >= 0:
                above.add(i)
                i = page.parent[i]
        for i, t in enumerate(page.tag):
            p = page.parent[i]
            truth[i] = i in above or (p >= 0 and truth[p] and t != "i-out" and not (p in above and p not in wraps))
        yield page, truth


@lru_cache(1)
def trained(n: int = 500, seed: int = 7) -> Trees:
    """The trees, fit on ``n`` pages made by ``training_pages``; the same at every call."""
    xs, ys = [], []
    for page, truth in training_pages(n, seed):
        x = features(page)
        real = [i for i, t in enumerate(page.tag) if (t in BLOCK or page.attrs[i]) and t not in ("html", "body", "#root")]
        xs.append(x[real])
        ys.append(np.array([truth[i] for i in real], float))
    return fit_trees(np.concatenate(xs), np.concatenate(ys))


def extract(html: str | None, trees: Trees) -> str:
    """Main text of one page; null and empty give an empty text."""
    return extract_all([html], trees)[0]


def extract_all(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [Page(h or "") for h in pages]
    rows = [features(p) for p in parsed]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p, x in zip(parsed, rows):
        out.append(main_text(p, decode(p, odds[at : at + len(x)])))
        at += len(x)
    return out


def extract_pages(pages: DataFrame, html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """``pages`` without ``html_col`` and with ``text``, the main text of the whole page (empty if none).

    Null and empty pages give an empty text; broken markup is read as far as it goes; repeated rows are rows of their own;
    a column ``text`` that ``pages`` has already is replaced; an empty table gives an empty one. Row by row, without a shuffle; the
    model is a few thousand numbers.
    """
    model = trees or trained()
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                text = extract_all(part.column(len(kept)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(text, pa.string())], [*kept, "text"])

    return pages.select(*kept, html_col).mapInArrow(run, schema)
