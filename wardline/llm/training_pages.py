"""Generated pages with known main text, to train the node classifier.

Each page mixes an article with the usual surroundings under varying mark-up: semantic tags, named
divisions, or bare ones.  Words are random syllables, so nothing depends on a language.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu én ßa ñe th st er an on".split()


class Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 22).capitalize() + "." for _ in range(self.r.randint(low, high)))

    def one(self, *options: str) -> str:
        return self.r.choice(options)

    def maybe(self, p: float) -> bool:
        return self.r.random() < p

    def box(self, inner: str, keep: int, tag: str, *names: str) -> str:
        """An element as a semantic tag, a named division or a bare one."""
        u, name = self.r.random(), self.one(*names) if names else ""
        attr = self.one("class", "id")
        if u < 0.45:
            return f'<{tag} data-y="{keep}">{inner}</{tag}>'
        if u < 0.6:
            return f'<{tag} {attr}="{name}" data-y="{keep}">{inner}</{tag}>'
        if u < 0.95 and name:
            return f'<{self.one("div", "div", "section")} {attr}="{name}" data-y="{keep}">{inner}</div>'.replace("<section", "<div")
        return f'<div data-y="{keep}">{inner}</div>'

    def leaf(self, tag: str, text: str, keep: int) -> str:
        return f'<{tag} data-y="{keep}">{text}' + ("" if tag in ("p", "li") and self.maybe(0.15) else f"</{tag}>")

    def items(self, n: int, keep: int, linked: bool) -> str:
        def item() -> str:
            t = self.words(1, 3) if linked else self.words(2, 15)
            return self.leaf("li", f'<a href="/{self.word()}">{t}</a>' if linked else t, keep)

        tag = self.one("ul", "ul", "ol")
        return f'<{tag} data-y="{keep}">' + "".join(item() for _ in range(n)) + f"</{tag}>"

    def prose(self, n: int) -> str:
        out = []
        for _ in range(n):
            u = self.r.random()
            if u < 0.74:
                t = self.sentences(1, 7)
                if self.maybe(0.25):
                    t = f"<b>{t}</b>" if self.maybe(0.5) else t.replace(" ", f' <a href="/x">{self.word()}</a> ', 1)
                out.append(self.leaf("p", t, 1))
            elif u < 0.82:
                out.append(self.leaf(self.one("h2", "h3"), self.words(2, 7), 1))
            elif u < 0.88:
                out.append(self.items(self.r.randrange(2, 6), 1, False))
            elif u < 0.92:
                out.append(f'<blockquote data-y="1">{self.leaf("p", self.sentences(1, 3), 1)}</blockquote>')
            elif u < 0.95:
                out.append(self.leaf("pre", self.words(4, 20), 1))
            elif u < 0.98:
                cells = "".join('<tr data-y="1">' + "".join(self.leaf("td", self.words(1, 3), 1) for _ in range(3)) + "</tr>" for _ in range(3))
                out.append(f'<table data-y="1">{cells}</table>')
            else:
                out.append(self.leaf("p", self.words(1, 4), 1))
        return "".join(out)

    def junk(self, kind: str) -> str:
        short = lambda: self.leaf(self.one("p", "div", "span"), self.words(1, 14), 0)
        if kind == "nav":
            return self.box(self.items(self.r.randrange(2, 9), 0, True), 0, "nav", "menu", "nav", "navbar", "navigation", "breadcrumbs")
        if kind == "header":
            inner = self.leaf(self.one("div", "h1", "p"), self.words(1, 4), 0) + (short() if self.maybe(0.5) else "") + (self.junk("nav") if self.maybe(0.4) else "")
            return self.box(inner, 0, "header", "header", "masthead", "site-header", "topbar")
        if kind == "footer":
            inner = f"&copy; {self.words(2, 20)}" if self.maybe(0.6) else short() + short() + (self.items(3, 0, True) if self.maybe(0.4) else "")
            return self.box(inner, 0, "footer", "footer", "site-footer", "copyright", "bottom")
        if kind == "aside":
            inner = self.leaf("h3", self.words(1, 3), 0) + (self.items(self.r.randrange(2, 6), 0, True) if self.maybe(0.6) else self.leaf("p", self.sentences(1, 3), 0))
            return self.box(inner, 0, "aside", "sidebar", "side", "related", "widget", "popular")
        if kind == "ad":
            inner = self.sentences(1, 3) if self.maybe(0.6) else self.leaf("p", self.sentences(1, 3), 0)
            return f'<{self.one("div", "div", "aside", "section")} {self.one("class", "id")}="{self.one("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "ad-slot")}" data-y="0">{inner}</div>'.replace("<aside", "<div").replace("<section", "<div")
        if kind == "notice":
            inner = self.leaf("p", self.sentences(1, 3), 0) + ("<button>" + self.word() + "</button>" if self.maybe(0.5) else "")
            return f'<div {self.one("class", "id", "role")}="{self.one("cookie-notice", "cookie-banner", "consent", "notice", "alert", "newsletter", "subscribe", "popup")}" data-y="0">{inner}</div>'
        if kind == "form":
            return f'<form {self.one("", "class=search", "id=login", "class=newsletter")} data-y="0"><label>{self.words(1, 3)}</label><input name="q">{short() if self.maybe(0.6) else ""}<button>{self.word()}</button></form>'
        if kind == "comments":
            one = lambda: f'<{self.one("div", "li", "article")} class="{self.one("comment", "reply", "comment-body")}" data-y="0">{self.leaf("p", self.sentences(1, 4), 0)}</div>'.replace("<li", "<div").replace("<article", "<div")
            inner = self.leaf("h3", self.words(1, 3), 0) + "".join(one() for _ in range(self.r.randrange(1, 6)))
            return f'<{self.one("section", "div")} {self.one("class", "id")}="{self.one("comments", "responses", "discussion", "comment-list", "reader-comments")}" data-y="0">{inner}</section>'.replace("<div", "<section", 1)
        return f'<div class="{self.one("share", "social", "tags", "related-posts", "post-meta", "pagination")}" data-y="0">{self.words(1, 8)}</div>'

    def page(self) -> str:
        head = self.leaf(self.one("h1", "h1", "h2"), self.words(2, 12), 1)
        u = self.r.random()
        if u < 0.14:  # very short
            inner = head + self.leaf("p", "<b>" + self.words(1, 8) + self.one("", ".", "<br>"), 1)
        elif u < 0.2:  # one long text without sentences
            inner = head + self.leaf("p", " ".join([self.words(1, 3)] * self.r.randrange(20, 800)), 1)
        else:
            inner = head + self.prose(self.r.randrange(1, 14))
        if self.maybe(0.15):
            inner = f'<header data-y="1">{head}</header>' + inner[len(head) :]
        for kind, p in (("ad", 0.15), ("share", 0.2), ("aside", 0.1), ("comments", 0.08), ("footer", 0.06), ("form", 0.05)):
            if self.maybe(p):
                cut = inner.find("<p data-y", self.r.randrange(len(inner))) if self.maybe(0.5) else -1
                inner = inner + self.junk(kind) if cut < 0 else inner[:cut] + self.junk(kind) + inner[cut:]
        main = self.box(inner, 1, self.one("article", "article", "main"), "content", "article", "post", "entry-content", "story", "main-content", "post-body")
        around = "".join(self.junk(k) for k, p in (("nav", 0.2), ("ad", 0.25)) if self.maybe(p)) + main
        around += "".join(self.junk(k) for k, p in (("share", 0.2), ("comments", 0.3), ("aside", 0.4), ("ad", 0.2)) if self.maybe(p))
        if self.maybe(0.5):
            around = self.box(around, 1, self.one("main", "section", "div"), "main", "wrapper", "container", "page")
        top = "".join(self.junk(k) for k, p in (("notice", 0.25), ("header", 0.4), ("nav", 0.6), ("ad", 0.35), ("form", 0.15)) if self.maybe(p))
        end = "".join(self.junk(k) for k, p in (("aside", 0.15), ("form", 0.1), ("footer", 0.85), ("notice", 0.1)) if self.maybe(p))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a='<p>';</script></head><body>{top}{around}{end}" + ("</body></html>" if self.maybe(0.8) else "")


def pages(n: int, seed: int) -> list[str]:
    w = Writer(seed)
    return [w.page() for _ in range(n)]
