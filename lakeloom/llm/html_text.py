"""Main text of web pages by gradient-boosted trees over the nodes of their trees.

Each node's chance to belong to the article comes from trees over its tag, attribute words, subtree text and link
density, depth and siblings. Decoding is hierarchical: of all choices in which no node is kept below a dropped one,
the likeliest stands. The trees are fitted on pages that ``example_page`` makes up, whose parts are known."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices
from lakeloom.llm.dom import FEATURES, Page, consistent

#: Made-up pages to fit on, trees, depth, bins a feature, and step.
PAGES, TREES, DEPTH, BINS, STEP = 1600, 70, 5, 24, 0.25
MARK = ""  # stands in front of article text in made-up pages


# ---- pages whose parts are known ---------------------------------------------------------------------------------


def example_page(rng: random.Random) -> str:
    """A page with an article, whose text pieces begin with MARK, among parts that are not the article."""
    sides = ("ad", "share", "related", "sidebar", "cookie", "comments", "comment", "nav", "header", "footer", "newsletter")
    syllables = "an the er on ti re is or en at es in st nd th ar la de que os ung ein ver ment eau".split()

    def words(n: int, stop: str = ".") -> str:
        out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        if rng.random() < 0.1:
            out = [w.upper() + rng.choice(["!!", ""]) for w in out]
        for k in range(4, n, rng.randint(5, 12)):
            out[k] += rng.choice(",.,;")
        return " ".join(out).capitalize() + stop

    def attribute(names: list[str], often: float = 0.8) -> str:
        if rng.random() > often:
            return ""
        name = rng.choice(names) + rng.choice(["", "", "-wrap", "-1", "-box", " clearfix", "_inner", "-area"])
        if names[0] in sides and rng.random() < 0.2:
            name += " " + rng.choice(homely)
        more = rng.choice(["", "", "", ' data-k="1"', ' style="margin:0"', ' role="presentation"'])
        return f' {rng.choice(["class", "class", "id"])}="{name}"{more}'

    def distracted(names: list[str], often: float, misleading: list[str]) -> str:
        """An attribute whose words may also point the other way, as theme and state classes do."""
        if rng.random() < 0.45:
            own = " ".join([rng.choice(names)] * (rng.random() < 0.4) + rng.sample(misleading, rng.choice([1, 1, 2])))
            return f' {rng.choice(["class", "class", "class", "id"])}="{own}"'
        return attribute(names, often)

    # words of side parts on articles, and words of articles on side parts
    astray = "has-sidebar with-sidebar no-sidebar comments-open comment-enabled single-comment entry-related article-more read-more legal-text legal-notice feedback-page feedback discussion discussion-post thread thread-starter privacy privacy-policy share-page social-post sticky-header has-header no-footer with-nav nav-open menu-closed search-result review review-text response form-page sponsored-free ad-free has-ads related-work topbar-fixed notice-page message warning-text alert-story tag-news tags-on popular top-story bottom-line button-free input-guide register-info subscribe-ok follow-up widget-ready modal-closed dialog-text site-main logo-story link-list banner-on cookie-recipe login-free promo-story".split()
    homely = "content inner-content text body page-text article-link post-list entry-meta story-list main-nav title headline copy text-box lead page-body prose".split()

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(rng.randint(1, 3), "")}</a></li>' for k in range(n))

    def paragraph(mark: str) -> str:
        text = mark + words(rng.choice([1, 3, 8, 15, 30, 60, 90]))
        shape = rng.random()
        if shape < 0.15:
            return f"<p><b>{text}<br>"
        if shape < 0.25:
            return f'<p>{text} <a href="/x">{mark}{words(2, "")}</a> {mark}{words(6)}</p>'
        if shape < 0.3:
            inline = rng.choice(["em", "strong", "code", "span", "i", "button", "math"])
            return f"<p>{text} <{inline}>{mark}{words(2, '')}</{inline}> {mark}{words(7)}</p>"
        if shape < 0.34:
            return f"<div>{text}<br><br>{mark}{words(20)}<br>{mark}{words(12)}</div>"
        if shape < 0.37:
            return f"<p><span style='color:red'><span>{text}</span></span></p>"
        return f"<p>{text}</p>"

    def article() -> str:
        m, out = MARK, [f"<h1>{MARK}{words(rng.randint(1, 9), '')}</h1>"]
        if rng.random() < 0.1:
            out = []
        elif rng.random() < 0.1:
            out = [f"<header>{out[0]}</header>"]
        if rng.random() < 0.1:  # a list of links is what some articles are
            return "".join(out) + (paragraph(m) if rng.random() < 0.3 else "") + "<ul>" + "".join(f'<li><a href="/{k}">{m}{words(rng.randint(1, 6), "")}</a></li>' for k in range(rng.randint(3, 12))) + "</ul>"
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            if kind < 0.75:
                out.append(paragraph(m))
            elif kind < 0.82:
                out.append(f"<h2>{m}{words(4, '')}</h2>{paragraph(m)}")
            elif kind < 0.88:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{m}{words(rng.randint(2, 14))}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.92:
                out.append(f"<blockquote>{paragraph(m) if rng.random() < 0.5 else m + words(20)}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{m}{words(2, '')}</td><td>{m}{words(3, '')}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                out.append("<dl>" + "".join(f"<dt>{m}{words(2, '')}</dt><dd>{m}{words(9)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>" if rng.random() < 0.5 else f"<details><summary>{m}{words(3, '')}</summary>{paragraph(m)}</details>")
            elif kind < 0.975:
                out.append(f"<figure><img src=x><figcaption>{m}{words(8)}</figcaption></figure>")
            else:
                out.append(f"<div>{m}{words(25)}</div>" if rng.random() < 0.5 else f"<pre>{m}{words(12)}</pre>")
            if rng.random() < 0.07:
                inside = "".join(paragraph(m) for _ in range(rng.randint(1, 3)))
                head = f"<{(h := rng.choice(['h2', 'h3']))}>{m}{words(3, '')}</{h}>" if rng.random() < 0.6 else ""
                out.append(f"<{(tag := rng.choice(['div', 'div', 'section']))}{distracted(['section', 'part', 'note', 'box'], 0.6, astray)}>{head}{inside}</{tag}>")
            if rng.random() < 0.03:
                out.append("<ul>" + "".join(f'<li><a href="/{k}">{m}{words(rng.randint(1, 6), "")}</a></li>' for k in range(rng.randint(3, 9))) + "</ul>")
            if rng.random() < 0.03:
                inner = f"{m}{words(rng.randint(1, 6), '')}"
                out.append(rng.choice([f"<xmp>{inner}</xmp>", f"<svg width=9><text>{inner}</text></svg>", f"<canvas>{inner}</canvas>", f"<video src=v>{inner}</video>", f"<audio src=a><p>{inner}</p></audio>"]))
            if rng.random() < 0.07:
                out.append(rng.choice([advert, share, related, newsletter])())
        if not out:
            out.append(paragraph(m))
        return "".join(out)

    def advert() -> str:
        tag = rng.choice(["div", "div", "aside", "section", "p"])
        inner = words(rng.randint(2, 25)) if tag == "p" or rng.random() < 0.7 else f"<p>{words(rng.randint(3, 25))}</p>"
        return f"<{tag}{attribute(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-banner'], 1)}>{inner}</{tag}>"

    def share() -> str:
        return f"<div{attribute(['share', 'social', 'sharing', 'share-buttons'], 1)}>{links(3) if rng.random() < 0.5 else words(3, '')}</div>"

    def related() -> str:
        inner = f"<h3>{words(2, '')}</h3><ul>{links(rng.randint(2, 6))}</ul>"
        return f"<{(t := rng.choice(['div', 'aside', 'section']))}{attribute(['related', 'recommended', 'more-links', 'popular', 'trending'], 1 if t != 'aside' else 0.5)}>{inner}</{t}>"

    def newsletter() -> str:
        label = f"<label>{words(2, '')}</label>" if rng.random() < 0.6 else f"<p>{words(rng.randint(4, 15))}</p>"
        return f"<form{attribute(['newsletter', 'subscribe', 'search-form', 'login', 'contact-form'], 0.6)}>{label}<input name=q><button>{words(1, '')}</button></form>"

    def sidebar() -> str:
        tag = rng.choice(["aside", "aside", "div", "section"])
        inner = rng.choice([lambda: f"<ul>{links(4)}</ul>", lambda: f"<h3>{words(2, '')}</h3><p>{words(rng.randint(5, 40))}</p>", lambda: f"<p>{words(20)}</p><ul>{links(3)}</ul>", lambda: words(rng.randint(3, 20))])()
        return f"<{tag}{attribute(['sidebar', 'side', 'widget', 'rail', 'sidebar-right', 'complementary'], 0.4 if tag == 'aside' else 1)}>{inner}</{tag}>"

    def notice() -> str:
        tag = rng.choice(["div", "div", "section", "p", "aside"])
        text = words(rng.randint(4, 35))
        inner = text if tag == "p" else rng.choice([f"<p>{text}</p>", text, f"<p>{text}</p><button>ok</button>"])
        return f"<{tag}{attribute(['cookie', 'cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'privacy-banner', 'modal', 'paywall'], 1)}>{inner}</{tag}>"

    def comments() -> str:
        tag, one = rng.choice(["div", "section", "ol", "aside"]), rng.choice(["div", "article", "li"])
        each = "".join(f"<{one}{attribute(['comment', 'reply', 'comment-body', 'review'], 0.7)}><b>{words(1, '')}</b><p>{words(rng.randint(2, 60))}</p></{one}>" for _ in range(rng.randint(1, 5)))
        head = f"<h3>{words(2, '')}</h3>" if rng.random() < 0.5 and tag != "ol" else ""
        return f"<{tag}{attribute(['comments', 'comment-list', 'discussion', 'responses', 'disqus', 'respond', 'replies'], 1)}>{head}{each}</{tag}>"

    def navigation() -> str:
        inner = f"<ul>{links(rng.randint(2, 9))}</ul>" if rng.random() < 0.7 else "".join(f'<a href="/{k}">{words(1, "")}</a> ' for k in range(rng.randint(2, 8)))
        if rng.random() < 0.6:
            return f"<nav{attribute(['nav', 'menu', 'main-menu'], 0.3)}>{inner}</nav>"
        return f"<div{attribute(['nav', 'menu', 'navigation', 'breadcrumbs', 'topbar', 'main-menu', 'pagination', 'tabs'], 1)}>{inner}</div>"

    def top() -> str:
        inner = f"{words(3, '')}" if rng.random() < 0.4 else f"<div{attribute(['logo', 'branding', 'site-title'])}>{words(2, '')}</div>"
        if rng.random() < 0.25:
            inner = f"<h1>{words(rng.randint(1, 3), '')}</h1>"
        if rng.random() < 0.4:
            inner += navigation()
        if rng.random() < 0.2:
            inner += f"<p>{words(rng.randint(3, 12))}</p>"
        return f"<header{attribute(['header', 'top', 'masthead'], 0.4)}>{inner}</header>" if rng.random() < 0.6 else f"<div{attribute(['header', 'masthead', 'site-header', 'banner', 'top'], 1)}>{inner}</div>"

    def bottom() -> str:
        inner = f"&copy; {words(rng.randint(1, 10), '')} &middot; {words(rng.randint(2, 20))}" if rng.random() < 0.6 else f"<p>{words(rng.randint(3, 25))}</p><ul>{links(3)}</ul>"
        return f"<footer{attribute(['footer', 'bottom'], 0.3)}>{inner}</footer>" if rng.random() < 0.65 else f"<div{attribute(['footer', 'site-footer', 'copyright', 'legal', 'bottom'], 1)}>{inner}</div>"

    def fragment() -> str:
        """Nothing but an article, with or without the elements of a page around it."""
        kind = rng.random()
        inner = MARK + words(rng.randint(3, 80)) if kind < 0.15 else "".join(paragraph(MARK) for _ in range(rng.randint(1, 4))) if kind < 0.7 else article()
        return inner if rng.random() < 0.5 else f"<html><body>{inner}</body></html>"

    def columns() -> str:
        """A page laid out by table cells, as was once usual: menu, article, and links at its side."""
        menu = "".join(f'<a href="/{k}">{words(1, "")}</a><br>' for k in range(rng.randint(3, 9)))
        body = "".join(rng.choice([paragraph(MARK), f"{MARK}{words(40)}<br><br>"]) for _ in range(rng.randint(2, 6)))
        head = f"<center><h2>{MARK}{words(4, '')}</h2></center>" if rng.random() < 0.6 else ""
        return f"<html><body bgcolor=white><table width=100%><tr><td{attribute(['menu', 'nav', 'left'], 0.4)}>{menu}</td><td>{head}{body}</td></tr></table><hr><font size=1>{words(6)}</font></body></html>" if rng.random() < 0.5 else f"<table><tr><td>{menu}</td><td><font size=2>{head}{body}</font></td></tr></table>"

    whole = rng.random()
    if whole < 0.06:
        return fragment()
    if whole < 0.09:
        return columns()
    tag = rng.choice(["article", "article", "article", "main", "div", "section", "bare"])
    inner = article()
    if rng.random() < 0.12:
        inner = "".join(f"<section{attribute(['chapter', 'part', 'block', 'row'], 0.5)}>{article()}</section>" for _ in range(rng.randint(2, 4)))
    if tag == "bare":
        core = inner
    else:
        often = 1.0 if tag in ("div", "section") and rng.random() < 0.8 else 0.4
        core = f"<{tag}{distracted(['content', 'article', 'post', 'entry', 'main', 'story', 'article-body', 'post-content', 'entry-content', 'main-content'], often, astray)}>{inner}</{tag}>"
    if rng.random() < 0.25:
        core = core.replace(f"</{tag}>", "") + comments() + f"</{tag}>" if tag in ("main", "div") and rng.random() < 0.4 else core + comments()
    if rng.random() < 0.3 and tag != "main":
        core = f"<main{attribute(['main', 'content'], 0.3)}>{core}</main>"
    around_before = [f() for f, p in ((top, 0.35), (navigation, 0.7), (notice, 0.25), (advert, 0.55), (sidebar, 0.15)) if rng.random() < p]
    around_after = [f() for f, p in ((sidebar, 0.3), (related, 0.25), (newsletter, 0.2), (advert, 0.25), (comments, 0.12), (notice, 0.15), (navigation, 0.1), (bottom, 0.85)) if rng.random() < p]
    if rng.random() < 0.3:
        rng.shuffle(around_before)
    body = "".join(around_before) + core + "".join(around_after)
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        body = f"<div{distracted(['wrapper', 'container', 'page', 'layout', 'row', 'site', 'outer'], 0.7, astray)}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a made-up page's nodes that hold text: 1 if any of it is the article's."""
    page = Page(source)
    for k, (node, text) in enumerate(page.parts):
        if text and MARK in text:
            page.chars[node] -= text.count(MARK)
            page.parts[k] = (node, text.replace(MARK, ""))
            page.groups[node] |= 1 << 30
    good = [bool(g >> 30 & 1) for g in page.groups]
    page.groups = [g & ~(1 << 30) for g in page.groups]
    for k in range(len(good) - 1, 0, -1):
        good[page.parent[k]] |= good[k]
    x = page.features()
    some = x[:, FEATURES.index("log chars")] > 0
    return x[some], np.array(good, dtype=np.float64)[some]


# ---- trees -------------------------------------------------------------------------------------------------------


class Trees:
    """Boosted regression trees on the logistic loss. Each tree is complete: split features and limits by level."""

    def __init__(self) -> None:
        self.start, self.feature, self.limit, self.leaf = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        width, n_features = BINS + 1, x.shape[1]
        flat = binned + np.arange(n_features) * width
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, limit = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                n_nodes, first = 2**level, 2**level - 1
                key = (flat + (node * n_features * width)[:, None]).ravel()
                size = n_nodes * n_features * width
                sums = [np.bincount(key, np.repeat(v, n_features), size).reshape(n_nodes, n_features, width).cumsum(axis=2) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 2) | (ht - hl < 2)] = 0
                best = gain.reshape(n_nodes, -1).argmax(axis=1)
                for k in range(n_nodes):
                    f, b = divmod(int(best[k]), width)
                    if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                        feature[first + k], limit[first + k] = f, cuts[f][b]
                at = first + node
                node = 2 * node + (x[np.arange(len(y)), feature[at]] > limit[at])
            leaf = STEP * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            score += leaf[node]
            self.feature.append(feature), self.limit.append(limit), self.leaf.append(leaf)
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds by row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > limit[at])
            out += leaf[node]
        return out


@lru_cache(maxsize=2)
def fitted(pages: int = PAGES, seed: int = 5) -> Trees:
    rng = random.Random(seed)
    parts = [labelled(example_page(rng)) for _ in range(pages)]
    return Trees().fit(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    rows = [p.features() for p in pages]
    odds, at, out = trees.odds(np.concatenate(rows)), 0, []
    for page, x in zip(pages, rows, strict=True):
        own = np.clip(odds[at : at + len(x)], -6, 6)
        own[x[:, FEATURES.index("log chars")] == 0] = 0
        out.append(page.text(consistent(page.parent, own)))
        at += len(x)
    return out


def _extracted(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        texts = main_texts(b.column("html").to_pylist(), trees)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, trees: Trees | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all but the html, if none are named) as a struct ``row``; text and n_chars.

    text: the blocks of the article in page order, one a line, white space inside a block as one blank, character
    references decoded; empty for a null or empty html and where nothing looks like an article. n_chars: its code
    points. Repeated rows give equal texts; an empty table gives an empty result; clashing names stay inside row."""
    trees = trees or fitted()
    source = pages.select(F.struct(*(keep or [c for c in pages.columns if c != html_col])).alias("row"), F.col(html_col).cast("string").alias("html"))
    row = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(lambda batches: _extracted(batches, trees), f"row {row}, text string, n_chars long")
