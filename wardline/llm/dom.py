"""A forgiving reader of HTML into a tree of block elements, and features of its nodes."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

#: Element kinds of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style template svg iframe select textarea button title head".split())
#: Blocks that may stand in a paragraph without ending it.
FALLBACK = set("noscript object audio video canvas".split())
#: Marks of formulas: their text belongs to the block around them.
MATH = set("""math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle
    msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml""".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
TAGS = "body article main section div p h1 h2 h3 ul li table tr td blockquote pre figure nav header footer aside form dl address details".split()
#: Families of attribute tokens.
FAMILIES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs tabs pagination pager toc sitemap skip",
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion banner",
    "comment": "comment comments reply replies respond responses disqus discussion thread feedback reader",
    "footer": "footer foot copyright legal colophon bottom",
    "header": "header head masthead logo topbar top brand",
    "side": "sidebar side aside widget related recommended recommendations popular trending more rail",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall privacy message",
    "share": "share sharing social follow tags tag meta byline",
    "form": "form login signin signup search contact input",
    "content": "content article post entry story body main text maincontent page blog news prose",
    "hidden": "hidden none invisible",
}
_FAMILY = {token: i for i, tokens in enumerate(FAMILIES.values()) for token in tokens.split()}
_TAG_AT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_NAME_END = re.compile(r"[\s/>]")
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-label|itemprop|data-y)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
N_OWN = 6
AREAS = "article main nav header footer aside form".split()

_TAG = {name: i for i, name in enumerate(TAGS)} | {"ol": TAGS.index("ul")} | dict.fromkeys(("h4", "h5", "h6"), TAGS.index("h3"))
_ONE_HOT = np.eye(len(TAGS) + 1)[:, : len(TAGS)]
_AREA = [TAGS.index(name) for name in AREAS]


class _Ends:
    """Which tags of a page end, found in one pass from its end: a tag does not if one of its quotes is never closed."""

    def __init__(self, source: str) -> None:
        self.source, self.name_end = source, 0
        self.at = [m.start() for m in re.finditer("[>\"']", source)]
        self.ok = [False] * (len(self.at) + 1)
        later: dict[str, int] = {}
        for n in range(len(self.at) - 1, -1, -1):
            char = source[self.at[n]]
            self.ok[n] = char == ">" or (char in later and self.ok[later[char] + 1])
            later[char] = n

    def tag(self, start: int) -> bool:
        """Whether the tag that begins at ``start`` (growing from call to call) ends."""
        name = start + (2 if self.source[start + 1] != "/" else 3)
        if self.name_end < name:  # names of tags in one run of letters end together
            m = _NAME_END.search(self.source, name)
            self.name_end = m.start() if m else len(self.source)
        return self.ok[bisect_left(self.at, self.name_end)]


def tokens(source: str) -> Iterator[tuple[int, int, str | None, re.Match | None]]:
    """(start, end, text, tag) of the markup of a page: comments and declarations (neither), CDATA (text) and tags.

    Every character is looked at a bounded number of times, however broken the page: what cannot end is found out once.
    A consumer that skips ahead sends the place to go on from.
    """
    last, ends, at, cdata = source.rfind(">"), None, 0, True
    while (at := source.find("<", at)) >= 0:
        token, text, tag = -1, None, None
        if source.startswith("<!--", at):
            token = source.find("-->", at + 4)
            token = len(source) if token < 0 else token + 3
        elif at > last:  # nothing but a comment can end
            at = source.find("<!--", at)
            if at < 0:
                return
            continue
        elif source[at + 1] in "!?":
            close = source.find("]]>", at + 9) if cdata and source.startswith("<![CDATA[", at) else -1
            if close >= 0:
                token, text = close + 3, source[at + 9 : close]
            else:
                cdata = cdata and not source.startswith("<![CDATA[", at)
                token = source.find(">", at) + 1
        elif (c := source[at + 1 : at + 3].lstrip("/")[:1]) and c.isascii() and c.isalpha() and source[at + 1 : at + 3] != "//" and (ends is None or ends.tag(at)):
            tag = _TAG_AT.match(source, at)
            if tag:
                token = tag.end()
            elif ends is None:
                ends = _Ends(source)
        if token < 0:
            at += 1
            continue
        ahead = yield at, token, text, tag
        at = token if ahead is None else ahead


class Page:
    """Nodes in page order: tag, parent, depth, families, own text pieces and link letters, label of training pages (if ``labels``)."""

    def __init__(self, source: str, labels: bool = True) -> None:
        self.tag, self.parent, self.depth, self.family, self.label = ["body"], [-1], [0], [np.zeros(len(FAMILIES))], [None]
        self.text: list[list[str]] = [[]]
        self.pieces: list[tuple[int, str]] = []  # (node, text) in page order
        self.links, self.inline, self.breaks = [0], [0], [0]
        stack, linked, at, end = [0], False, 0, len(source)

        def add(raw: str) -> None:
            if not raw:
                return
            node = stack[-1]
            text = html.unescape(raw) if "&" in raw else raw
            self.pieces.append((node, text))
            self.text[node].append(text)
            if linked:
                self.links[node] += len(text.strip())

        reader, ahead, open_ended = tokens(source), None, set()
        while True:
            try:
                start, stop, piece, m = reader.send(ahead)
            except StopIteration:
                add(source[at:])
                break
            ahead = None
            add(source[at:start])
            at = stop
            if m is None:
                add(piece or "")
                continue
            closing, tag, rest = m.group(1) == "/", m.group(2).lower(), m.group(3)
            if tag in DROPPED and tag != "head":
                if not closing and not rest.endswith("/"):
                    close = None if tag in open_ended else re.compile(rf"</{tag}\b", re.I).search(source, at)
                    stop = source.find(">", close.end()) if close else -1
                    if stop < 0:
                        open_ended.add(tag)  # nor does a later one end
                        stop = end if tag in ("script", "style", "textarea", "title") else at - 1
                    at = ahead = min(stop + 1, end)
                continue
            if tag in ("html", "head") or tag in MATH:
                continue
            if tag == "body":
                if not closing:
                    self.family[0] = self._families(rest)
                continue
            if tag in INLINE:
                if tag == "a":
                    linked = not closing
                if not closing:
                    self.inline[stack[-1]] += 1
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    add(" ")
                    self.breaks[stack[-1]] += 1
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if (tag == "p" and self.tag[stack[k]] not in FALLBACK) or (tag in ("li", "td", "th", "tr", "dt", "dd") and self.tag[stack[k]] in SCOPE[tag]):
                        break
                continue
            if self.tag[stack[-1]] == "p" and tag not in FALLBACK:
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in SCOPE.get(tag, ()) or tag not in CLOSES:
                    break
                if name in CLOSES[tag]:
                    del stack[k:]
                    if tag != "tr":
                        break
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tag.append(tag)
            self.family.append(self._families(rest) if rest else np.zeros(len(FAMILIES)))
            self.label.append(self._label(rest) if labels and "data-y" in rest else None)
            self.text.append([])
            self.links.append(0)
            self.inline.append(0)
            self.breaks.append(0)
            if not rest.endswith("/"):
                stack.append(len(self.tag) - 1)

    @staticmethod
    def _families(rest: str) -> np.ndarray:
        out = np.zeros(len(FAMILIES))
        for m in _ATTR.finditer(rest):
            name = m.group(1).lower()
            if name == "data-y":
                continue
            value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out[-1] = 1
            elif name != "style":
                for token in _PART.findall(value):
                    if token in _FAMILY:
                        out[_FAMILY[token]] = 1
        return out

    @staticmethod
    def _label(rest: str) -> int | None:
        m = re.search(r'(?<![\w-])data-y="(\d)"', rest)
        return int(m.group(1)) if m else None

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.zeros((n, N_OWN))  # letters, words, sentence marks, link letters, tags, breaks
        for i, parts in enumerate(self.text):
            if parts:
                t = "".join(parts)
                own[i, :3] = len(t) - t.count(" "), len(t.split()), sum(map(t.count, ".!?;:,"))
        own[:, 3], own[:, 4], own[:, 5] = self.links, np.array(self.inline) + 1, self.breaks
        total = own.copy()
        children, paragraphs = np.zeros(n), np.zeros(n)
        below = np.array(self.family)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            total[p] += total[i]
            children[p] += 1
            paragraphs[p] += paragraphs[i] + (self.tag[i] == "p" and own[i, 1] >= 8)
        above = np.array(self.family)
        index = np.zeros(n)
        seen = np.zeros(n)
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            above[i] = np.maximum(above[i], above[parent[i]])
            index[i] = seen[parent[i]]
            seen[parent[i]] += 1
            key = (int(parent[i]), self.tag[i])
            alike[key] = alike.get(key, 0) + 1
        same = np.array([alike.get((int(p), t), 1) for p, t in zip(self.parent, self.tag)], dtype=float)
        siblings = np.where(parent >= 0, children[np.maximum(parent, 0)], 1)
        page = max(total[0, 0], 1)
        up = np.maximum(parent, 0)
        tags = _ONE_HOT[[_TAG.get(t, len(TAGS)) for t in self.tag]]
        inside = tags[:, _AREA].copy()
        for i in range(1, n):
            inside[i] = np.maximum(inside[i], inside[parent[i]])
        before = np.cumsum(own[:, 0]) - own[:, 0]
        return np.column_stack([
            np.log1p(own[:, :3]), np.log1p(total[:, :3]), total[:, 0] / page, total[:, 3] / np.maximum(total[:, 0], 1), total[:, 0] / total[:, 4],
            total[:, 2] / np.maximum(total[:, 1], 1), total[:, 1] / np.maximum(children, 1), np.array(self.depth), index, siblings, index / np.maximum(siblings, 1), same / np.maximum(siblings, 1),
            children, paragraphs, before / page, total[up, 0] / page, total[up, 3] / np.maximum(total[up, 0], 1), paragraphs[up], tags, tags[up], inside, below, above])


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The best choice of kept nodes such that nothing is kept below a dropped node."""
    s = np.clip(odds, -6, 6)
    n = len(parent)
    drop, keep = -s.copy(), s.copy()
    for i in range(n - 1, 0, -1):
        drop[parent[i]] += drop[i]
        keep[parent[i]] += max(keep[i], drop[i])
    kept = np.zeros(n, dtype=bool)
    for i in range(n):
        kept[i] = (i == 0 or kept[parent[i]]) and keep[i] > drop[i]
    return kept


def main_text(page: Page, kept: np.ndarray) -> str:
    """Texts of the kept blocks in page order; a child block ends its parent's block."""
    out: list[str] = []
    last, held = -1, []
    for node, text in [*page.pieces, (-2, "")]:
        if node != last:
            if held and kept[last]:
                joined = " ".join("".join(held).split())
                if joined:
                    out.append(joined)
            last, held = node, []
        held.append(text)
    return " ".join(out)
