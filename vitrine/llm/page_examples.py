"""Made-up pages with known main text, to train the block labeller on many layouts.

The given pages carry no labels. A page is put together from an article and from
menus, headers, footers, sidebars, notices, adverts, forms and comments, under tags and class
words that such parts usually have, or none.
"""
from __future__ import annotations

import random

SYLLABLES = "an be co da el fi go ha in jo ka le mo na or pa qui re sa ti un ve wo xa ya zo ter ing tion heit lich ment eau ado ción".split()
MENU = "Home About Contact News Sports Login Register Search Shop Help FAQ Blog Archive Products Services Careers Start Kontakt Accueil Inicio".split()
LEGAL = ["All rights reserved", "Privacy policy", "Terms of use", "Copyright 2024", "Imprint", "© Example", "Cookie settings", "Site map"]
#: Class words of each part of a page; an empty word leaves the attribute out.
CLASSES = {
    "main": ["content", "post", "entry", "article-body", "story", "main-content", "text", "page-content", "postBody", ""],
    "nav": ["nav", "menu", "navbar", "breadcrumbs", "main-menu", "pagination", "tabs", "toc", ""],
    "head": ["header", "site-header", "masthead", "top", "branding", "topbar", ""],
    "foot": ["footer", "site-footer", "bottom", "legal", "copyright", "colophon", ""],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "tags", "side-col", "most-read", "rail"],
    "note": ["cookie-notice", "banner", "alert", "consent", "gdpr", "modal", "popup", "paywall", "notice", "newsletter"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "advertisement", "adBox", "banner-ad", "commercial"],
    "form": ["search-form", "subscribe", "login", "contact-form", "signup", ""],
    "talk": ["comments", "comment", "replies", "discussion", "disqus", "comment-list", "responses"],
    "share": ["share", "social", "share-buttons", "follow", "toolbar", "byline-tools"],
}
TAGS = {
    "main": ["article", "main", "div", "section", "div"], "nav": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"],
    "side": ["aside", "div", "section"], "note": ["div", "section", "dialog", "aside"], "ad": ["div", "aside", "section", "ins"], "form": ["form"],
    "talk": ["section", "div", "ol"], "share": ["div", "ul"],
}


class Maker:
    """Pages from a seeded random source; texts from given sentences or made-up words."""

    def __init__(self, seed: int, sentences: list[str]):
        self.r = random.Random(seed)
        self.sentences = sentences

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def prose(self, low: int = 5, high: int = 60) -> str:
        if self.sentences and self.r.random() < 0.5:
            return self.r.choice(self.sentences)[: self.r.randint(60, 900)]
        text = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return text.capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def short(self) -> str:
        return self.r.choice([self.r.choice(MENU), self.word().capitalize(), " ".join(self.word() for _ in range(self.r.randint(1, 4)))])

    def open(self, part: str) -> tuple[str, str]:
        tag, word = self.r.choice(TAGS[part]), self.r.choice(CLASSES[part])
        if tag in ("div", "section", "ins", "ul", "ol") and not word and part != "main":
            word = CLASSES[part][0]
        noise = self.r.choice(["", "", f" {self.word()}", f" {self.word()}-{self.word()}"])
        name = self.r.choice(["class", "class", "id"])
        attribute = f' {name}="{word}{noise}"' if word and self.r.random() < 0.9 else ""
        if not attribute and tag in ("div", "section", "ins", "ul", "ol") and part != "main":
            attribute = f' class="{word or part}"'
        return f"<{tag}{attribute}>", f"</{tag}>"

    def links(self, n: int) -> list[tuple[str, int]]:
        if self.r.random() < 0.7:
            return [("<ul>", -1), *[(f'<li><a href="/{self.word()}">{self.short()}</a></li>', 0) for _ in range(n)], ("</ul>", -1)]
        return [(f'<div><a href="#">{self.short()}</a></div>', 0) for _ in range(n)]

    def article(self) -> list[tuple[str, int]]:
        out = [(f"<{h}>{self.prose(2, 10)}</{h}>", 1) for h in ["h1"] if self.r.random() < 0.9]
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14])):
            kind = self.r.random()
            if kind < 0.7:
                out.append((f"<p>{self.r.choice(['', '<b>', '<i>'])}{self.prose()}{self.r.choice(['</p>', '</p>', ''])}", 1))
            elif kind < 0.78:
                out.append((f"<h2>{self.prose(1, 8)}</h2>", 1))
            elif kind < 0.86:
                out += [("<ul>", -1), *[(f"<li>{self.prose(1, 15)}</li>", 1) for _ in range(self.r.randint(1, 6))], ("</ul>", -1)]
            elif kind < 0.9:
                out.append((f"<blockquote>{self.prose()}</blockquote>", 1))
            elif kind < 0.94:
                out += [("<table>", -1), *[(f"<tr><td>{self.short()}</td><td>{self.word()}</td></tr>", 1) for _ in range(self.r.randint(1, 5))], ("</table>", -1)]
            elif kind < 0.97:
                out.append((f"<pre>{self.prose(3, 30)}</pre>", 1))
            else:
                out += self.part(self.r.choice(["ad", "share", "side"]))
        return out

    def part(self, kind: str) -> list[tuple[str, int]]:
        a, b = self.open(kind)
        r = self.r
        if kind == "nav":
            inner = self.links(r.randint(2, 9))
        elif kind == "head":
            inner = [(f"<{r.choice(['h1', 'div', 'p', 'span'])}>{self.short()}", 0), *(self.part("nav") if r.random() < 0.5 else [])]
        elif kind == "foot":
            inner = [(f"<p>{r.choice([r.choice(LEGAL), self.prose(3, 20)])}</p>", 0) for _ in range(r.randint(1, 4))] + (self.links(4) if r.random() < 0.4 else [])
            inner = inner if r.random() < 0.7 else [(self.prose(1, 12), 0)]
        elif kind == "side":
            inner = [(f"<h3>{self.short()}</h3>", 0), *(self.links(r.randint(2, 6)) if r.random() < 0.6 else [(f"<p>{self.prose(4, 30)}</p>", 0)])]
        elif kind == "note":
            inner = [(f"<p>{r.choice(['We use cookies.', 'Please accept.', self.prose(5, 30)])}</p>", 0), (f"<button>{r.choice(['Accept', 'OK', 'Close'])}</button>", 0)]
        elif kind == "ad":
            inner = [(r.choice(["{}", "<p>{}</p>", "<a href='#'>{}</a>"]).format(self.prose(3, 40)), 0)]
        elif kind == "form":
            inner = [(f"<label>{self.short()}</label><input><button>{r.choice(['Send', 'Search', 'Login', 'Subscribe'])}</button>", 0)]
        elif kind == "talk":
            inner = [(f"<h3>{r.choice(['Comments', 'Replies', 'Responses', 'Discussion'])}</h3>", 0)]
            for _ in range(r.randint(1, 5)):
                inner += [(f'<div class="{r.choice(["comment", "reply", "comment-body"])}">', -1), (f"<b>{self.short()}</b><p>{self.prose(3, 50)}</p>", 0), ("</div>", -1)]
        else:
            inner = [(f"<a href='#'>{w}</a><br>", 0) for w in r.sample(["Share", "Tweet", "Like", "Print", "Email", "Follow us"], 3)]
        return [(a, -1), *inner, (b, -1)]

    def page(self) -> list[tuple[str, int]]:
        """Pieces of markup, each with whether its text belongs to the article (-1: no text)."""
        r = self.r
        out = [("<!DOCTYPE html><html><head>", -1), (f"<title>{self.prose(2, 8)}</title>", 0), ("<style>p{margin:0}</style></head><body>", -1)]
        wrap = r.choice([("", ""), ("", ""), ('<div id="page">', "</div>"), ('<div class="wrapper"><div class="row">', "</div></div>"), ("<main>", "</main>")])
        bare = r.random() < 0.08
        for kind in ("note", "head", "nav", "form", "ad", "share"):
            if not bare and r.random() < (0.7 if kind in ("head", "nav") else 0.35):
                out += self.part(kind)
        out.append((wrap[0], -1))
        if r.random() < 0.4:
            out += self.part(r.choice(["side", "nav", "ad"]))
        a, b = self.open("main") if r.random() < 0.85 else ("", "")
        tail = self.part("talk") if r.random() < 0.2 else []
        out += [(a, -1), *self.article(), *tail, (b, -1)]
        for kind in ("share", "side", "talk", "ad", "form"):
            if not bare and r.random() < 0.4:
                out += self.part(kind)
        out.append((wrap[1], -1))
        for kind in ("foot", "note"):
            if not bare and r.random() < (0.85 if kind == "foot" else 0.2):
                out += self.part(kind)
        return [*out, ("</body></html>", -1)]
