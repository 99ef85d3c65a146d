"""Labelled training pages made by rule: invented words in random layouts, each text known to be article or not.

A page has some of the parts of a web page (menu, header, sidebar, adverts, notices, forms, comments,
related links, footer) around an article, in semantic elements, in named boxes or in boxes that tell
nothing. Texts are pseudo-words of random letters with or without punctuation, so nothing is learned about a
language. Article text is marked by a first character that no page has otherwise.
"""

from __future__ import annotations

import random

MARK = ""
NAMES = {
    "content": ["content", "article-body", "post", "entry-content", "story", "main-content", "post-body", "text", "article__body"],
    "menu": ["nav", "menu", "main-menu", "breadcrumbs", "navbar", "top-nav", "pagination", "toc"],
    "head": ["header", "site-header", "masthead", "banner", "branding", "topbar"],
    "foot": ["footer", "site-footer", "copyright", "legal", "bottom-links"],
    "side": ["sidebar", "side", "widget", "related", "recommended", "popular-posts", "more-stories", "teaser-list"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor-box", "banner-ad"],
    "notice": ["cookie-notice", "consent", "gdpr", "alert", "popup", "subscribe", "newsletter", "paywall", "notice", "disclaimer"],
    "form": ["login-form", "search", "contact-form", "signup", "poll"],
    "comment": ["comments", "comment", "comment-list", "replies", "disqus_thread", "discussion", "reader-comments", "responses"],
    "social": ["share", "social-links", "share-buttons", "follow-us"],
    "plain": ["box", "c12", "wrap", "row", "col", "inner", "container", "x-9f", "page", "grid"],
}


class PageMaker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        letters = self.random.choice(["abcdefghijklmnopqrstuvwxyz", "éàèabcdefgimnorstu", "абвгдежзиклмнопрст", "äöüabcdefghiklmnrst"])
        self.letters = letters
        self.named = self.random.random() < 0.75
        self.semantic = self.random.random() < 0.6
        self.marks = self.random.choice([".", ".", "", "***", "%%% &amp;", "!?"])

    def word(self) -> str:
        return "".join(self.random.choices(self.letters, k=self.random.randint(2, 9)))

    def words(self, low: int, high: int) -> str:
        found = [self.word() for _ in range(self.random.randint(low, high))]
        found[0] = found[0].capitalize()
        for place in range(7, len(found), self.random.randint(6, 15)):
            found[place] += self.marks or ""
        return " ".join(found) + self.random.choice([self.marks or "", ".", ""])

    def attribute(self, kind: str) -> str:
        r = self.random
        if not self.named or r.random() < 0.12:
            return r.choice(["", "", f' class="{r.choice(NAMES["plain"])}"'])
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "u-x "])}{r.choice(NAMES[kind])}"'

    def box(self, kind: str, tags: list[str], inside: str) -> str:
        tag = self.random.choice(tags) if self.semantic else "div"
        if not self.semantic and not self.named:
            tag = self.random.choice(["div", tags[0]])
        return f"<{tag}{self.attribute(kind)}>{inside}</{tag}>"

    def wrapped(self, inside: str) -> str:
        for _ in range(self.random.choice([0, 0, 1, 1, 2, 3])):
            inside = f"<div{self.random.choice(['', self.attribute('plain')])}>{inside}</div>"
        return inside

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def links(self, low: int, high: int, list_: bool | None = None) -> str:
        count = self.random.randint(low, high)
        if list_ if list_ is not None else self.random.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(count)) + "</ul>"
        return self.random.choice([" ", " | "]).join(self.link() for _ in range(count))

    def menu(self) -> str:
        return self.box("menu", ["nav", "nav", "div"], self.links(2, 12))

    def header(self) -> str:
        parts = [self.random.choice([f"<h1>{self.words(1, 4)}</h1>", self.link(), f"<p>{self.words(2, 8)}</p>"])]
        if self.random.random() < 0.5:
            parts.append(self.menu())
        return self.box("head", ["header"], "".join(parts))

    def footer(self) -> str:
        parts = [f"<p>{self.words(2, 40)}</p>" if self.random.random() < 0.5 else "&copy; " * self.random.randint(0, 1) + self.words(2, 40)]
        if self.random.random() < 0.6:
            parts.append(self.links(2, 8))
        return self.box("foot", ["footer"], "".join(parts))

    def advert(self) -> str:
        texts = [f"<p>{self.words(3, 30)}</p>", self.words(3, 20), f"<h3>{self.words(1, 5)}</h3><p>{self.words(4, 25)}</p>{self.link()}"]
        return f"<div{self.named_always('advert')}>{self.random.choice(texts)}</div>"

    def named_always(self, kind: str) -> str:
        r = self.random
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "box "])}{r.choice(NAMES[kind])}"'

    def notice(self) -> str:
        inside = f"<p>{self.words(5, 40)}</p>" if self.random.random() < 0.7 else self.words(5, 30)
        if self.random.random() < 0.5:
            inside += f"<button>{self.words(1, 2)}</button>"
        role = self.random.choice(["", "", ' role="alert"'])
        return f"<{(tag := self.random.choice(['div', 'div', 'section', 'aside']))}{self.named_always('notice')}{role}>{inside}</{tag}>"

    def sidebar(self) -> str:
        parts = []
        for _ in range(self.random.randint(1, 3)):
            text = self.random.choice([self.links(3, 8), f"<p>{self.words(5, 40)}</p>"])
            parts.append(f"<h{(n := self.random.choice([2, 3, 4]))}>{self.words(1, 3)}</h{n}>{text}")
        return self.box("side", ["aside", "aside", "section"], "".join(parts))

    def form(self) -> str:
        inside = f"<label>{self.words(1, 4)}</label><input name=q>" * self.random.randint(1, 3)
        if self.random.random() < 0.5:
            inside = f"<p>{self.words(3, 25)}</p>" + inside
        return f"<form{self.attribute('form')}>{inside}<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        r, list_ = self.random, self.random.random() < 0.4
        parts = [f"<h{(n := r.choice([2, 3]))}>{self.words(1, 3)}</h{n}>"] if r.random() < 0.7 else []
        rows = []
        for _ in range(r.randint(1, 6)):
            author = r.choice([f"<b>{self.words(1, 2)}</b> ", f"<h4>{self.words(1, 2)}</h4>", f'<p class="author">{self.words(1, 2)}</p>', ""])
            text = r.choice([f"<p>{self.words(3, 60)}</p>", self.words(3, 40)])
            tag = "li" if list_ else r.choice(["div", "div", "article"])
            rows.append(f"<{tag}{r.choice(['', self.named_always('comment')])}>{author}{text}</{tag}>")
        parts.append(f"<ol>{''.join(rows)}</ol>" if list_ else "".join(rows))
        if r.random() < 0.3:
            parts.append(self.form())
        tag = r.choice(["section", "div", "div"])
        return f"<{tag}{self.named_always('comment')}>{''.join(parts)}</{tag}>"

    def social(self) -> str:
        return f"<div{self.named_always('social')}>{self.links(2, 5)}</div>"

    def inner_aside(self) -> str:
        return f"<aside{self.named_always('side')}><h3>{self.words(1, 4)}</h3>{self.links(2, 6)}</aside>"

    def inner_footer(self) -> str:
        return f"<footer><p>{self.words(2, 20)}</p>{self.links(1, 4)}</footer>"

    def article(self) -> str:
        """The article: paragraphs, headings, lists, quotes, tables; every text of its own begins with MARK."""
        r, m = self.random, MARK
        parts = []
        title = r.random() < 0.8
        long_ = r.random()
        count = 1 if long_ < 0.3 else r.randint(1, 4) if long_ < 0.55 else r.randint(3, 14)
        short = r.random() < 0.3
        for number in range(count):
            kind = r.random()
            low, high = r.choice([(1, 3), (3, 15)] if short else [(1, 3), (3, 15), (15, 80), (15, 80), (40, 200)])
            if kind < 0.78:
                text = m + self.words(low, high)
                if r.random() < 0.2:
                    text += f" {self.link()} {self.words(1, 12)}"
                if r.random() < 0.15:
                    text = f"{m}<b>{self.words(1, 6)}<br>" + text.replace(m, "")
                parts.append(f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}")
            elif kind < 0.85:
                parts.append(f"<h{(n := r.choice([2, 3]))}>{m}{self.words(1, 8)}</h{n}>")
            elif kind < 0.91:
                tag = r.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{m}{self.words(2, 25)}</li>" for _ in range(r.randint(1, 7))) + f"</{tag}>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>{m}{self.words(5, 40)}</p></blockquote>")
            elif kind < 0.96:
                parts.append(f"<pre>{m}{self.words(5, 40)}</pre>")
            elif kind < 0.98:
                rows = "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 9)}</td></tr>" for _ in range(r.randint(1, 5)))
                parts.append(f"<table>{rows}</table>")
            else:
                parts.append(f"<figure><figcaption>{m}{self.words(2, 15)}</figcaption></figure>")
            if number and r.random() < 0.06:
                parts.append(r.choice([self.advert, self.notice, self.social, self.form])())
        heading = f"<h{(n := r.choice([1, 1, 2]))}>{m}{self.words(1, 10)}</h{n}>" if title else ""
        if heading and self.semantic and r.random() < 0.2:
            heading = f"<header>{heading}</header>"
        end = ""
        for part, chance in ((self.social, 0.12), (self.comments, 0.1), (self.inner_aside, 0.05), (self.inner_footer, 0.04)):
            end += part() if r.random() < chance else ""
        inside = "".join(parts)
        if r.random() < 0.35:
            inside = f"<div{self.attribute('content')}>{inside}</div>"
        return self.box("content", ["article", "article", "article", "main", "section"], heading + inside + end)

    def page(self) -> str:
        r = self.random
        if r.random() < 0.04:
            # nothing but an article, or not even that
            return r.choice([self.article(), f"<p>{MARK}{self.words(1, 60)}</p>", f"{MARK}{self.words(1, 60)}"])
        before = [part() for part, chance in (
            (self.notice, 0.25), (self.header, 0.5), (self.menu, 0.6), (self.advert, 0.4), (self.form, 0.12),
        ) if r.random() < chance]
        after = [part() for part, chance in ((self.social, 0.15), (self.advert, 0.25), (self.comments, 0.4), (self.form, 0.12)) if r.random() < chance]
        middle = self.wrapped(self.article())
        if r.random() < 0.45:
            middle = "".join(r.sample([middle, self.sidebar()], 2))
        if r.random() < 0.3:
            middle = f"<main{self.attribute('plain')}>{middle}</main>"
        last = [part() for part, chance in ((self.footer, 0.75), (self.notice, 0.15)) if r.random() < chance]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join(before) + self.wrapped(middle + "".join(after)) + "".join(last)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title></head><body>{body}</body></html>"


def pages(count: int, seed: int = 0) -> list[str]:
    return [PageMaker(seed * 1_000_003 + number).page() for number in range(count)]
