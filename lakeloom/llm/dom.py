"""Pages as trees of nodes with features, for main-text extraction."""

from __future__ import annotations

import html
import re

import numpy as np

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript noembed noframes iframe title desc metadata head select textarea datalist".split())
RAW = frozenset("script style noembed noframes iframe title textarea".split())
#: Elements whose content is text as it stands.
PLAIN = frozenset(("xmp",))
#: Elements that make no nodes and no block bounds, nor does what they hold.
HIDDEN = frozenset("noscript template svg math select".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements in svg and math that hold HTML again.
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
INLINE = frozenset("a abbr button object acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Start tags that end svg and math: those of the HTML standard, and others that name no part of a drawing or formula.
ENDS_FOREIGN = CLOSES_P | frozenset("b big body br code dd dt em embed head i img li listing meta nobr ruby s small span strong strike sub sup tt u var tr td th tbody thead tfoot".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

#: Tags that are features by themselves.
TAGS = "html body main article section div p h1 h2 h3 ul ol li dl table tr td th blockquote pre figure figcaption header footer nav aside form label fieldset menu address span".split()
#: Words in class, id and role that are features, by group.
TOKENS = {
    "content": "article content post entry main story text body page prose copy paragraph lead headline title".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs tabs toolbar pagination pager toc links topbar".split(),
    "frame": "header footer masthead banner top bottom copyright colophon legal contentinfo site logo branding".split(),
    "side": "sidebar side aside widget widgets rail complementary related recommended recommendations popular trending more tags".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense".split(),
    "notice": "cookie cookies consent notice notices alert gdpr privacy popup modal overlay dialog warning message paywall announcement".split(),
    "comment": "comment comments reply replies respond discussion discuss disqus responses reviews feedback commenter thread".split(),
    "form": "form search login signup signin subscribe subscription newsletter register contact input field".split(),
    "share": "share sharing social follow facebook twitter buttons button toolbox print".split(),
}
_GROUP = {w: k for k, (_, words) in enumerate(TOKENS.items()) for w in words}
_TAG = {t: k for k, t in enumerate(TAGS)}
FEATURES = [*(f"tag {t}" for t in TAGS), *(f"own {g}" for g in TOKENS), *(f"above {g}" for g in TOKENS), *(f"above {t}" for t in ("article", "main", "nav", "header", "footer", "aside", "form"))]
FEATURES += ["log chars", "log own chars", "link share", "log nodes", "chars a node", "stops", "paragraphs", "depth", "place", "siblings", "siblings of its tag", "share of parent's chars", "link share before", "link share after", "log chars before", "log chars after", "share of page's chars", "headings below", "share of parent's headings", "log longest own chars"]
_ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form")

_MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")
_ASIDE = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
_TOKEN = re.compile(_ASIDE + r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: The same where a quotation mark is never closed: a tag ends at the next >.
_BROKEN = re.compile(_ASIDE + r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_BARE_VALUE = re.compile(r"=\s*[^\s\"'][^\s]*\Z")


def _self_closing(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value without quotes."""
    return attributes.endswith("/") and not _BARE_VALUE.search(_QUOTED.sub('""', attributes))


def _unclosed(source: str, name: str) -> set[int]:
    """Where the start tags stand that have no end tag."""
    open_: list[int] = []
    passed = r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>])(?![^>]*/>).*?(?:</\1(?=[\s/>])|\Z)"
    for m in re.finditer(rf"{passed}|<(/?){name}(?=[\s/>])", source, re.I | re.S):
        if m[2] == "":
            open_.append(m.start())
        elif m[2] and open_:
            open_.pop()
    return set(open_)


class Page:
    """Nodes of a page in page order; parts are its texts and block bounds.

    parent, tag (-1: none of TAGS), groups (bits of TOKENS), chars, linked, stops: by node. parts: (node, text), or
    (node, None) where a block begins or ends."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.groups, self.chars, self.linked, self.stops = [-1], [_TAG["html"]], [0], [0], [0], [0]
        self.parts: list[tuple[int, str | None]] = []
        names, nodes = ["html"], [0]  # open elements
        foreign = [False]  # by open element: whether what stands in it is SVG or MathML
        where: dict[str, list[int]] = {"html": [0]}  # the places of open elements by name
        blocks: list[int] = [0]  # the places of open elements that an inline end tag does not close
        fences: list[int] = []  # open elements beyond which no end tag but their own reaches
        lost: dict[str, set[int]] = {}
        links, silent, hidden, open_select, at = 0, 0, 0, 0, 0
        token = _TOKEN

        def last(of: tuple[str, ...] | frozenset[str]) -> int:
            """The place of the last open element of these names; -1: none."""
            return max((where[x][-1] for x in of if where.get(x)), default=-1)

        def text(raw: str) -> None:
            if silent or not raw:
                return
            if "&" in raw:
                raw = html.unescape(raw)
            node = nodes[-1]
            self.parts.append((node, raw))
            n = len(raw) - raw.count(" ")
            self.chars[node] += n
            self.linked[node] += n * (links > 0)
            self.stops[node] += raw.count(".") + raw.count(",")

        def close(down_to: int) -> None:
            nonlocal links, silent, hidden, open_select
            while len(names) > down_to:
                name, node = names.pop(), nodes.pop()
                foreign.pop()
                where[name].pop()
                if blocks[-1] == len(names):
                    blocks.pop()
                links -= name == "a"
                silent -= name in SILENT
                if name not in INLINE and not hidden:
                    self.parts.append((node, None))
                hidden -= name in HIDDEN
                if fences and fences[-1] == len(names):
                    fences.pop()
                if open_select == len(names):
                    open_select = 0

        while True:
            found = _MARKUP.search(source, at)
            if found is None:
                text(source[at:])
                break
            m = token.match(source, found.start())
            if m is None and token is _TOKEN and source.find(">", found.end()) >= 0:
                if source[found.end()] != "/" or source[found.end() + 1 : found.end() + 2].isalpha():
                    token = _BROKEN  # quotation marks are of no use from here on: each tag would read to the end again
                    m = token.match(source, found.start())
            if m is None:
                if source.find(">", found.end()) < 0:
                    text(source[at : found.start()])
                    break  # a tag that never ends, and nothing after it
                text(source[at : found.end()])
                at = found.end()
                continue
            text(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if len(own := where.get(name, ())) > (name == "html"):
                    k = own[-1]
                    # an inline end tag closes nothing beyond the block it stands in
                    if not (fences and k < fences[-1]) and (name not in INLINE or blocks[-1] <= k):
                        close(k)
                elif name == "p" and not hidden:
                    self.parts.append((nodes[-1], None))
                continue
            if foreign[-1]:
                if name in ENDS_FOREIGN:
                    while foreign[-1]:
                        close(len(names) - 1)
                elif _self_closing(m[3]):
                    continue
            if name in FOREIGN and _self_closing(m[3]):
                continue
            if open_select and (name in CLOSES_P or name in ("input", "textarea", "select")) and name != "hr":
                close(open_select)
            if name in VOID:
                if hidden:
                    pass
                elif name == "br":
                    self.parts.append((nodes[-1], " "))
                elif name == "hr":
                    self.parts.append((nodes[-1], None))
                continue
            if name in ("html", "body") and len(names) > 1 and where.get(name):
                continue
            if name == "body":
                while where.get("head"):
                    close(where["head"][0])
            if name in RAW and not foreign[-1]:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            plain = None
            if name in PLAIN and not foreign[-1]:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(source, at)
                plain = source[at : end.start() if end else len(source)].replace("&", "&amp;")
                at = end.start() if end else len(source)
            if (name in CLOSES_P or name in PLAIN) and where.get("p"):
                k = where["p"][-1]
                if max(blocks[-1], last(FOREIGN)) <= k:
                    close(k)
            if name in SAME:
                while (k := last(SAME[name])) > max(last(FENCE[name]), last(HIDDEN), 0):
                    close(k)
                    if name != "tr":
                        break
            if name in HIDDEN and name not in FOREIGN and not foreign[-1]:
                if name not in lost:
                    lost[name] = _unclosed(source, name)
                if m.start() not in lost[name]:
                    fences.append(len(names))
                elif name == "select":
                    open_select = len(names)
                else:
                    continue  # else the rest of the page would be in it
            attributes = m[3]
            groups = 0
            if attributes and not attributes.isspace():
                for a in _ATTRIBUTE.finditer(attributes):
                    for w in _WORD.findall(a[1] or a[2] or a[3] or ""):
                        k = _GROUP.get(w.lower())
                        if k is not None:
                            groups |= 1 << k
            if m[3].endswith("/") and name in ("path", "circle"):
                continue
            block = name not in INLINE
            links += name == "a"
            silent += name in SILENT
            hidden += name in HIDDEN
            foreign.append(name in FOREIGN or (foreign[-1] and name not in HOLDS_HTML))
            if (block or groups) and not hidden:
                node = len(self.parent)
                for column, value in ((self.parent, nodes[-1]), (self.tag, _TAG.get(name, -1)), (self.groups, groups), (self.chars, 0), (self.linked, 0), (self.stops, 0)):
                    column.append(value)
            else:
                node = nodes[-1]
            where.setdefault(name, []).append(len(names))
            if block and not foreign[-2] and name not in FOREIGN:
                blocks.append(len(names))
            names.append(name)
            nodes.append(node)
            if block and not hidden:
                self.parts.append((node, None))
            if plain:
                text(plain)
        close(1)

    def text(self, keep: np.ndarray | list[bool]) -> str:
        """The blocks of the kept nodes in page order, one a line."""
        blocks, held = [], []
        for node, raw in [*self.parts, (0, None)]:
            if raw is None:
                if held and (block := " ".join("".join(held).split())):
                    blocks.append(block)
                held = []
            elif keep[node]:
                held.append(raw)
        return "\n".join(blocks)

    def features(self) -> np.ndarray:
        """A row of FEATURES for each node."""
        n = len(self.parent)
        parent = np.array(self.parent)
        own, linked, stops = (np.array(x, dtype=np.float64) for x in (self.chars, self.linked, self.stops))
        total, linked_all, stops_all, nodes, paragraphs = own.copy(), linked.copy(), stops.copy(), np.ones(n), (np.array(self.tag) == _TAG["p"]).astype(np.float64)
        depth, above_tag, above_group = np.zeros(n), np.zeros((n, len(_ABOVE))), np.zeros((n, len(TOKENS)))
        tag = self.tag
        bits = np.array([[g >> k & 1 for k in range(len(TOKENS))] for g in self.groups], dtype=np.float64).reshape(n, -1)
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            total[p] += total[k]
            linked_all[p] += linked_all[k]
            stops_all[p] += stops_all[k]
            nodes[p] += nodes[k]
            paragraphs[p] += paragraphs[k]
        above = [_TAG[t] for t in _ABOVE]
        for k in range(1, n):
            p = self.parent[k]
            depth[k] = depth[p] + 1
            above_tag[k] = above_tag[p]
            if tag[p] in above:
                above_tag[k, above.index(tag[p])] = 1
            above_group[k] = np.maximum(above_group[p], bits[p])
        place, siblings, same = np.zeros(n), np.ones(n), np.ones(n)
        before, after = np.full(n, -1), np.full(n, -1)
        children: dict[int, list[int]] = {}
        for k in range(1, n):
            children.setdefault(self.parent[k], []).append(k)
        for own_children in children.values():
            count: dict[int, int] = {}
            for k in own_children:
                count[tag[k]] = count.get(tag[k], 0) + 1
            for i, k in enumerate(own_children):
                place[k], siblings[k], same[k] = i / len(own_children), len(own_children), count[tag[k]]
                before[k], after[k] = own_children[i - 1] if i else -1, own_children[i + 1] if i + 1 < len(own_children) else -1
        headings, longest = np.isin(self.tag, [_TAG[t] for t in ("h1", "h2", "h3")]).astype(np.float64), own.copy()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            headings[p] += headings[k]
            longest[p] = max(longest[p], longest[k])
        link = linked_all / np.maximum(total, 1)
        link_at = lambda at: np.where(at < 0, -1, link[at])
        chars_at = lambda at: np.where(at < 0, -1, np.log1p(total[at]))
        one = np.zeros((n, len(TAGS)))
        for k, t in enumerate(tag):
            if t >= 0:
                one[k, t] = 1
        rest = [np.log1p(total), np.log1p(own), link, np.log1p(nodes), total / nodes, stops_all / np.maximum(total, 1), paragraphs, depth, place, siblings, same]
        rest += [total / np.maximum(total[np.maximum(parent, 0)], 1), link_at(before), link_at(after), chars_at(before), chars_at(after)]
        rest += [total / max(total[0], 1), headings, headings / np.maximum(headings[np.maximum(parent, 0)], 1), np.log1p(longest)]
        return np.column_stack([one, bits, above_group, above_tag, *rest])


def consistent(parent: list[int], odds: np.ndarray) -> list[bool]:
    """The likeliest choice of kept nodes in which nothing is kept below a node that is not.

    odds: log odds of each node. A node is kept if what it and the best choices below it gain outweighs dropping all."""
    gain = [max(float(o), -1e9) for o in odds]
    for k in range(len(parent) - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    keep = [False] * len(parent)
    for k in range(len(parent)):
        keep[k] = gain[k] > 0 and (k == 0 or keep[parent[k]])
    return keep
