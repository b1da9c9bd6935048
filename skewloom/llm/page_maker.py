"""Labelled practice pages for the block labeller: every block is made together with its label."""

from __future__ import annotations

import html as entities
import random

SYLLABLES = "an be ca de er fo gi ha in ja ko la mi no or pa qui re sa ti un ve wi ya zo st th ing tion ble ou ly nd ed é ü ñ".split()
SITE_WORDS = "home about contact login register search news blog shop help privacy terms cookies share tweet reply subscribe newsletter copyright reserved sponsored advertisement related popular tags categories archive next previous comments policy accept".split()
#: Names that page parts carry in class or id.
NAMES = {
    "header": ("header", "site-header", "masthead", "top", "topbar", "branding", "page-header"),
    "menu": ("nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "pagination", "links", "toc"),
    "side": ("sidebar", "aside", "widget", "widgets", "side", "rail", "left-col", "right-col", "secondary"),
    "ad": ("ad", "ads", "advert", "adbox", "advertisement", "promo", "sponsor", "sponsored", "banner"),
    "notice": ("notice", "cookie", "cookies", "cookie-notice", "consent", "alert", "popup", "modal", "gdpr", "cookie-banner"),
    "form": ("form", "signup", "subscribe", "newsletter", "search", "login", "contact-form"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses", "reader-comments", "user-comments"),
    "related": ("related", "more", "recommended", "read-next", "popular", "trending", "teasers"),
    "share": ("share", "social", "sharing", "share-buttons", "follow"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "colophon", "legal", "page-footer"),
    "main": ("content", "main", "article", "post", "entry", "entry-content", "story", "body", "text", "article-body", "post-content", "main-content", "page"),
}
TAGS = {"header": "header", "menu": "nav", "side": "aside", "ad": "aside", "form": "form", "footer": "footer"}


def r_top(r: random.Random) -> int:
    """Most words of a paragraph: mostly some dozens, at times hundreds."""
    return r.choice((8, 20, 40, 60, 90, 90, 150, 320))


class Maker:
    """One page; ``labels`` has one entry for each text block that a parser finds."""

    def __init__(self, rnd: random.Random):
        self.r, self.out, self.labels = rnd, [], []
        self.semantic = rnd.random() < 0.6
        self.named = rnd.random() < 0.7

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def phrase(self, low: int, high: int, site: float = 0.0, stop: bool = False) -> str:
        words = [self.r.choice(SITE_WORDS) if self.r.random() < site else self.word() for _ in range(self.r.randint(low, high))]
        said = " ".join(w + ("," if stop and self.r.random() < 0.08 else "") for w in words)
        if stop and len(words) > 10:
            said = ". ".join(s.capitalize() for s in (said[: len(said) // 2], said[len(said) // 2 :]))
        said = said.capitalize() + ("." if stop and self.r.random() < 0.95 else "")
        roll = self.r.random()
        if roll < 0.07:
            said = " ".join(w + self.r.choice(("###", "***", "$$$", "&&&", "%%%")) for w in said.split(" "))
        elif roll < 0.12:
            said = self.r.choice((" | ", " / ", " - ", "!! ", ", ")).join(said.split(" "))
        elif roll < 0.14:
            said = said.upper()
        return entities.escape(said, quote=False)

    def put(self, tag: str, text: str, main: bool, attrs: str = "") -> None:
        if self.r.random() < 0.15:
            text = f"<{self.r.choice(('b', 'em', 'strong', 'span', 'i'))}>{text}" + self.r.choice(("", "<br>", "</b>"))
        close = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        self.out.append(f"<{tag}{attrs}>{text}{close}")
        self.labels.append(main)

    def open(self, kind: str) -> str:
        tag = TAGS[kind] if kind in TAGS and (self.semantic or kind == "form") and self.r.random() < 0.9 else self.r.choice(("div", "div", "section"))
        attrs = ""
        if tag in ("div", "section") and (self.named or self.r.random() < 0.6) or self.r.random() < 0.3:
            name = self.r.choice(NAMES[kind])
            attrs = f' {self.r.choice(("class", "class", "id"))}="{name}"'
        self.out.append(f"<{tag}{attrs}>")
        return tag

    def links(self) -> str:
        """Links of one block, side by side."""
        between = self.r.choice((" ", " | ", " &middot; ", "&nbsp;", ""))
        return between.join(f'<a href="/{self.word()}">{self.phrase(1, 2, 0.5)}</a>' for _ in range(self.r.randint(2, 9)))

    def part(self, kind: str) -> None:
        tag = self.open(kind)
        if kind in ("menu", "footer", "share") and self.r.random() < 0.25:
            self.put(self.r.choice(("div", "p")), self.links(), False)
            self.out.append(f"</{tag}>")
            return
        if kind in ("menu", "related", "share") or kind in ("side", "header", "footer") and self.r.random() < 0.5:
            if kind != "menu" and self.r.random() < 0.5:
                self.put(self.r.choice(("h2", "h3", "h4", "p")), self.phrase(1, 5, 0.4), False)
            self.out.append("<ul>")
            for _ in range(self.r.randint(2, 9)):
                w = self.phrase(1, 6 if kind == "related" else 2, 0.4)
                self.put("li", f'<a href="/{self.word()}">{w}</a>', False)
            self.out.append("</ul>")
        if kind == "comments":
            if self.r.random() < 0.6:
                self.put(self.r.choice(("h2", "h3")), self.phrase(1, 3, 0.6), False)
            for _ in range(self.r.randint(1, 6)):
                inner = self.r.random() < 0.6
                if inner:
                    self.out.append(f'<div class="{self.r.choice(NAMES["comments"])}">')
                if self.r.random() < 0.4:
                    self.put(self.r.choice(("p", "h4", "div")), self.phrase(1, 3, 0.2), False)
                for _ in range(self.r.randint(1, 2)):
                    self.put("p", self.phrase(2, r_top(self.r), stop=True), False)
                if inner:
                    self.out.append("</div>")
        elif kind == "form":
            for _ in range(self.r.randint(1, 3)):
                self.put("label", self.phrase(1, 4, 0.4), False)
                self.out.append('<input type="text">')
            self.put("button", self.phrase(1, 2, 0.7), False)
        elif kind in ("ad", "notice", "footer", "side", "header"):
            for _ in range(self.r.randint(1, 2)):
                bare = kind in ("ad", "notice", "footer") and self.r.random() < 0.5
                said = self.phrase(2, 30, 0.15, stop=self.r.random() < 0.7)
                if bare:
                    self.put("div", said, False)
                else:
                    self.put(self.r.choice(("p", "p", "h3", "span") if kind != "header" else ("p", "h1", "div")), said, False)
                    if self.out[-1].startswith("<span"):
                        self.out.append("<hr>")
        self.out.append(f"</{tag}>")

    def story(self) -> None:
        style = self.r.random()
        if style < 0.08:
            close = start = ""
        elif style < 0.42:
            close, start = "</article>", "<article>"
        elif style < 0.55:
            close, start = "</main>", "<main>"
        else:
            close = "</div>"
            start = f'<div {self.r.choice(("class", "id"))}="{self.r.choice(NAMES["main"])}">' if style < 0.8 else "<div>"
        self.out.append(start)
        inside = self.r.random() < 0.3
        if inside:
            self.out.append(f'<div class="{self.r.choice(NAMES["main"])}">' if self.r.random() < 0.7 else "<section>")
        kind = "</div>" if inside and self.out[-1].startswith("<div") else "</section>"
        if self.r.random() < 0.85:
            self.put(self.r.choice(("h1", "h1", "h2")), self.phrase(2, 12, stop=self.r.random() < 0.3), True)
        for _ in range(self.r.randint(1, self.r.choice((3, 6, 12, 12, 25, 50)))):
            roll = self.r.random()
            if roll < 0.76:
                self.put("p", self.phrase(1, r_top(self.r), stop=True), True)
            elif roll < 0.83:
                self.put(self.r.choice(("h2", "h3")), self.phrase(1, 8), True)
            elif roll < 0.88:
                self.out.append("<ul>")
                for _ in range(self.r.randint(2, 5)):
                    self.put("li", self.phrase(2, 20, stop=self.r.random() < 0.5), True)
                self.out.append("</ul>")
            elif roll < 0.91:
                self.put(self.r.choice(("blockquote", "pre", "figcaption")), self.phrase(3, 40, stop=True), True)
            elif roll < 0.93:
                self.out.append("<table><tr>")
                for _ in range(self.r.randint(2, 6)):
                    self.put("td", self.phrase(1, 5), True)
                self.out.append("</tr></table>")
            else:
                self.part(self.r.choice(("ad", "ad", "related", "share", "form", "notice")))
        if inside:
            self.out.append(kind)
        if self.r.random() < 0.2:
            self.part("comments")
        self.out.append(close)

    def page(self) -> str:
        r = self.r
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.phrase(2, 8)}</title><style>p{{margin:0}}</style></head><body>")
        before = [("notice", 0.25), ("header", 0.5), ("menu", 0.8), ("ad", 0.5), ("side", 0.25)]
        after = [("share", 0.2), ("comments", 0.35), ("related", 0.3), ("side", 0.3), ("form", 0.25), ("ad", 0.3), ("notice", 0.1), ("menu", 0.15)]
        r.shuffle(after)
        bare, cells = r.random() < 0.15, r.random() < 0.12
        if cells:  # a page laid out as one table: links in its first row or column, the story in a cell
            self.out.append(f'<table{r.choice(("", " border=0", " width=100%"))}><tr>')
            self.put("td", self.links(), False)
            self.out.append(r.choice(("<td>", "</tr><tr><td>")))
        for kind, chance in before:
            if r.random() < (chance / 4 if bare or cells else chance):
                self.part(kind)
        self.story()
        if cells:
            self.out.append("</td>")
            if r.random() < 0.6:
                self.put("td", r.choice((self.links(), self.phrase(2, 20, 0.3))), False)
            self.out.append("</tr></table>")
        for kind, chance in after:
            if r.random() < (chance / 4 if bare or cells else chance):
                self.part(kind)
        if r.random() < (0.3 if bare else 0.85):
            self.part("footer")
        if r.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out)


def pages(n: int, seed: int) -> list[tuple[str, list[bool]]]:
    """``n`` pages with the labels of their blocks."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        m = Maker(rnd)
        out.append((m.page(), m.labels))
    return out
