"""Invented labelled pages for the HTML extractor: articles among menus, notices, adverts, forms and comments.

Every element carries ``data-y``: 1 within the main text, 0 elsewhere. The words are syllables at random, so nothing can be
learned from what a page says, only from how it is built.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba re to li ne su ka mo vi da pe ru so ti la en or an ist ung".split()
_MAIN_NAMES = ["content", "main-content", "post", "post-body", "entry-content", "article-body", "story", "article", "text", "blog-post", "page-content", "body-copy"]
_NEUTRAL = ["wrapper", "container", "row", "col", "inner", "page", "layout", "site", "grid", "box", "block", "section", "outer", "wrap"]
_AD = ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad-slot"]
_SIDE = ["sidebar", "side", "widget", "related", "recommended", "recent-posts", "rail", "aside", "more-stories", "trending"]
_NAV = ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "main-menu"]
_HEAD = ["header", "masthead", "site-header", "top", "branding", "logo"]
_FOOT = ["footer", "site-footer", "bottom", "copyright", "colophon", "foot"]
_NOTE = ["cookie", "notice", "consent", "cookie-banner", "gdpr", "popup", "modal", "alert", "overlay", "newsletter", "subscribe"]
_COMMENT = ["comments", "comment-list", "responses", "discussion", "disqus", "replies", "comment"]
_SHARE = ["share", "social", "sharing", "share-bar", "toolbar", "meta-links"]


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.words(2, 22).replace(" ", ", ", self.r.randint(0, 1)).capitalize() + self.r.choice("...!?") for _ in range(self.r.randint(low, high)))

    def tag(self, name: str, inner: str, y: int, names: list[str] | None = None, chance: float = 0.7) -> str:
        attributes = f' data-y="{y}"'
        if names and self.r.random() < chance:
            attributes += f' {self.r.choice(["class", "class", "class", "id"])}="{self.r.choice(names)}"'
        return f"<{name}{attributes}>{inner}</{name}>"

    def link(self, y: int, low: int = 1, high: int = 4) -> str:
        return self.tag("a", self.words(low, high), y)

    def inline(self, y: int, text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 3 and self.r.random() < 0.3:
            k = self.r.randrange(len(parts))
            parts[k] = self.tag(self.r.choice(["a", "em", "strong", "b", "span"]), parts[k], y)
        return " ".join(parts)

    def links(self, y: int = 0, most: int = 12) -> str:
        return self.tag(self.r.choice(["ul", "ul", "ol"]), "".join(self.tag("li", self.link(y) if self.r.random() < 0.9 else self.words(1, 3), y) for _ in range(self.r.randint(2, most))), y)

    def nav(self) -> str:
        kind = self.r.random()
        if kind < 0.6:
            return self.tag("nav", self.links(), 0, _NAV, 0.4)
        if kind < 0.8:
            return self.tag("div", self.links(), 0, _NAV, 0.9)
        return self.tag(self.r.choice(["div", "p", "nav"]), " | ".join(self.link(0) for _ in range(self.r.randint(2, 8))), 0, _NAV, 0.6)

    def ad(self) -> str:
        inner = self.prose(1, 3) if self.r.random() < 0.6 else self.tag(self.r.choice(["p", "span", "a"]), self.words(2, 15), 0)
        return self.tag(self.r.choice(["div", "div", "aside", "section", "p"]), inner, 0, _AD, 0.95)

    def note(self) -> str:
        inner = self.tag("p", self.prose(1, 3), 0) if self.r.random() < 0.5 else self.prose(1, 2)
        return self.tag(self.r.choice(["div", "section", "aside"]), inner + (self.tag("button", self.words(1, 2), 0) if self.r.random() < 0.5 else ""), 0, _NOTE, 0.95)

    def header(self) -> str:
        inner = self.tag(self.r.choice(["h1", "div", "p", "a", "span"]), self.words(1, 4), 0)
        inner += self.tag("p", self.words(3, 8), 0) if self.r.random() < 0.3 else ""
        inner += self.nav() if self.r.random() < 0.5 else ""
        return self.tag("header", inner, 0, _HEAD, 0.3) if self.r.random() < 0.6 else self.tag("div", inner, 0, _HEAD, 0.95)

    def footer(self) -> str:
        inner = "".join(self.r.choice([lambda: self.tag("p", "© " + self.words(2, 20), 0), lambda: "© " + self.words(1, 4) + " · " + self.prose(1, 1), lambda: self.links(most=6), lambda: self.prose(1, 2), lambda: self.link(0), lambda: self.words(2, 6) + "."])() for _ in range(self.r.randint(1, 3)))
        if self.r.random() < 0.1:
            return self.tag("div", inner, 0, _NEUTRAL, 0.5)
        return self.tag("footer", inner, 0, _FOOT, 0.3) if self.r.random() < 0.7 else self.tag("div", inner, 0, _FOOT, 0.95)

    def side(self) -> str:
        inner = "".join(self.tag(self.r.choice(["h3", "h2", "h4"]), self.words(1, 3), 0) + self.r.choice([lambda: self.links(most=8), lambda: self.tag("p", self.prose(1, 2), 0), lambda: self.tag("p", self.link(0, 2, 8), 0)])() for _ in range(self.r.randint(1, 3)))
        return self.tag("aside", inner, 0, _SIDE, 0.5) if self.r.random() < 0.6 else self.tag(self.r.choice(["div", "section"]), inner, 0, _SIDE, 0.95)

    def form(self) -> str:
        inner = self.tag("label", self.words(1, 4), 0) + '<input data-y="0" type="text">' + self.tag("button", self.words(1, 2), 0)
        inner += self.tag("select", "".join(self.tag("option", self.words(1, 2), 0) for _ in range(3)), 0) if self.r.random() < 0.2 else ""
        inner = (self.tag("p", self.prose(1, 2), 0) if self.r.random() < 0.3 else "") + inner
        return self.tag("form", inner, 0, ["search", "login", "newsletter", "subscribe", "contact"], 0.5)

    def comments(self) -> str:
        one = lambda: self.tag(self.r.choice(["div", "li", "article"]), self.tag("span", self.words(1, 2), 0, ["author", "user", "comment-author"]) + self.tag("p", self.prose(1, 4), 0), 0, ["comment", "comment-body", "reply", "response"], 0.8)
        inner = self.tag(self.r.choice(["h2", "h3"]), self.words(1, 3), 0) + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.tag(self.r.choice(["section", "div", "ol"]), inner + (self.form() if self.r.random() < 0.3 else ""), 0, _COMMENT, 0.95)

    def share(self) -> str:
        return self.tag(self.r.choice(["div", "ul", "p"]), " ".join(self.link(0, 1, 2) for _ in range(self.r.randint(2, 5))), 0, _SHARE, 0.95)

    def paragraph(self) -> str:
        text = self.inline(1, self.prose(1, 8) if self.r.random() < 0.8 else self.words(1, 6) + ".")
        kind = self.r.random()
        if kind < 0.12:
            return f'<p data-y="1"><b data-y="1">{text}<br data-y="1">'
        if kind < 0.17:
            return f'<p data-y="1">{text}'
        return self.tag("p", text, 1)

    def article(self) -> str:
        def part() -> str:
            kind = self.r.random()
            if kind < 0.75:
                return self.paragraph()
            if kind < 0.83:
                return self.tag(self.r.choice(["h2", "h3"]), self.words(1, 8), 1)
            if kind < 0.89:
                return self.tag(self.r.choice(["ul", "ol"]), "".join(self.tag("li", self.inline(1, self.prose(1, 2)), 1) for _ in range(self.r.randint(2, 6))), 1)
            if kind < 0.93:
                return self.tag("blockquote", self.tag("p", self.prose(1, 3), 1), 1)
            if kind < 0.95:
                return self.tag("pre", self.words(4, 30), 1)
            if kind < 0.97:
                return self.tag("figure", '<img data-y="1" src="x">' + self.tag("figcaption", self.words(3, 12), 1), 1)
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.words(1, 3), 1) for _ in range(3)), 1) for _ in range(self.r.randint(2, 4))), 1)

        parts = [part() for _ in range(self.r.choice([1, 2, 3, 4, 6, 8, 12, 20]))]
        if self.r.random() < 0.85:
            parts.insert(0, self.tag(self.r.choice(["h1", "h1", "h1", "h2"]), self.words(2, 14), 1))
        if self.r.random() < 0.3:
            for _ in range(self.r.randint(1, 2)):
                parts.insert(self.r.randint(1, len(parts)), self.r.choice([self.ad, self.share, self.note, self.side, self.form])())
        return "".join(parts)

    def table(self) -> str:
        """A page laid out by a table: a row above, links beside the main text, a row below."""
        row = lambda *cells: self.tag("tr", "".join(cells), 0)
        links = "<br data-y=\"0\">".join(self.link(0) for _ in range(self.r.randint(2, 9)))
        cells = [self.tag("td", links if self.r.random() < 0.6 else self.links(), 0), self.tag("td", self.article(), 1, _MAIN_NAMES, 0.2)]
        rows = [row(*(cells if self.r.random() < 0.7 else cells[::-1]))]
        if self.r.random() < 0.7:
            rows.insert(0, row(self.tag("td", " | ".join(self.link(0) for _ in range(self.r.randint(2, 7))) if self.r.random() < 0.5 else self.words(1, 5), 0)))
        if self.r.random() < 0.7:
            small = self.r.choice(["© " + self.words(2, 12), self.words(2, 8) + ".", self.prose(1, 1)])
            rows.append(row(self.tag("td", self.tag("font", small, 0) if self.r.random() < 0.5 else small, 0)))
        return self.tag("table", "".join(rows), 0)

    def main(self) -> str:
        kind = self.r.random()
        if kind < 0.42:
            return self.tag("article", self.article(), 1, _MAIN_NAMES, 0.3)
        if kind < 0.55:
            return self.tag("main", self.article(), 1, _MAIN_NAMES, 0.3)
        if kind < 0.8:
            return self.tag(self.r.choice(["div", "div", "section", "td"]), self.article(), 1, _MAIN_NAMES, 0.8)
        if kind < 0.86:  # title and text in boxes of their own
            title = self.tag(self.r.choice(["h1", "h2"]), self.words(2, 14), 1)
            return self.tag("div", (self.tag("div", title, 1) if self.r.random() < 0.5 else title) + self.tag("div", self.article(), 1, _MAIN_NAMES, 0.6), 1, _NEUTRAL, 0.5)
        if kind < 0.93:  # no box at all
            return self.article()
        return self.table()

    def page(self) -> str:
        main = self.main()
        if self.r.random() < 0.2:
            main = self.tag("div", main, 0, _NEUTRAL)
        if self.r.random() < 0.2:
            main = self.tag("main", main, 0, _NEUTRAL, 0.3)
        before = [f() for f in (self.header, self.nav, self.ad, self.note, self.side, self.form) if self.r.random() < 0.4]
        after = [f() for f in (self.comments, self.side, self.ad, self.note, self.form, self.share, self.nav, self.footer) if self.r.random() < 0.4]
        if self.r.random() < 0.2:  # main text and sidebar within one wrapper
            wrapped = [main, self.side()]
            main = self.tag("div", "".join(wrapped if self.r.random() < 0.7 else wrapped[::-1]), 0, _NEUTRAL)
        body = "".join([*before, main, *after])
        if self.r.random() < 0.3:
            body = self.tag("div", body, 0, _NEUTRAL)
        end = "</body></html>" if self.r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html data-y="0"><head data-y="0"><title data-y="0">{self.words(2, 10)}</title><style data-y="0">p{{margin:0}}</style></head><body data-y="0">{body}{end}'
