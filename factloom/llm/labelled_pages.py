"""Labelled pages for training: pages of many layouts, whose elements say with data-content what is article (1) and what is not (0).

An element without the attribute has its parent's label. The pages are made by a seeded generator from layouts written by
hand: menus, headers, notices, adverts, sidebars, forms, comments and footers around and within articles.
"""

from __future__ import annotations

import random

#: Pages that training uses.
N_PAGES = 240


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        made = ["".join(self.r.choice(["ba", "lo", "ter", "in", "sch", "mi", "é", "on", "ka", "re", "ing", "su"]) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        return " ".join(made).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 16) + self.r.choice([".", ".", ".", "!", "?", ","]) for _ in range(self.r.randint(low, high)))

    def attribute(self, *names: str) -> str:
        name = self.r.choice(names)
        return f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def maybe(self, share: float, made: str) -> str:
        return made if self.r.random() < share else ""

    def links(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", ""]).join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n))

    def off(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        return f'<{tag} data-content="0"{self.attribute(*names)}>{inner}</{tag}>'

    def menu(self) -> str:
        return self.off(self.r.choice(["nav", "nav", "div", "ul"]), ("", "menu", "navbar", "nav-main", "breadcrumb", "navigation"), self.links(3, 9))

    def header(self) -> str:
        return self.off(self.r.choice(["header", "header", "div"]), ("header", "site-header", "masthead", "top-bar"), f"<h1>{self.words(1, 3)}</h1>" + self.maybe(0.5, f"<p>{self.words(2, 8)}</p>") + self.maybe(0.5, self.links(2, 6)))

    def advert(self) -> str:
        return self.off(self.r.choice(["div", "div", "aside", "section"]), ("ad", "ads", "advert", "sponsored", "promo", "banner-ad", "ad-slot"), self.r.choice([self.sentences(1, 3), f'<p>{self.sentences(1, 2)}</p><a href="/x">{self.words(1, 3)}</a>']))

    def notice(self) -> str:
        return self.off(self.r.choice(["div", "section", "aside"]), ("cookie", "cookie-notice", "consent", "notice", "alert", "banner", "popup", "disclaimer"), f"<p>{self.sentences(1, 3)}</p>" + self.maybe(0.6, f"<button>{self.words(1, 2)}</button>"))

    def sidebar(self) -> str:
        return self.off(self.r.choice(["aside", "aside", "div"]), ("sidebar", "related", "widget", "side", "recommended", "trending"), f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([self.links(3, 8), f"<p>{self.sentences(1, 3)}</p>"]))

    def form(self) -> str:
        return self.off("form", ("", "search", "newsletter", "subscribe", "login"), f'<label>{self.words(1, 4)}</label><input name="q"><p>{self.words(3, 9)}</p><button>{self.words(1, 2)}</button>')

    def share(self) -> str:
        return self.off("div", ("share", "social", "tags", "author-links"), self.links(2, 5))

    def comments(self) -> str:
        outer = self.r.choice(["section", "div", "div", "ol"])
        tag = "li" if outer == "ol" else self.r.choice(["div", "div", "article"])
        one = lambda: f'<{tag}{self.attribute("comment", "comment", "reply", "")}><b>{self.words(1, 2)}</b><p>{self.sentences(1, 4)}</p></{tag}>'
        return self.off(outer, ("comments", "comment-list", "discussion", "responses", "disqus"), f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5))))

    def footer(self) -> str:
        return self.off(self.r.choice(["footer", "footer", "div"]), ("footer", "site-footer", "copyright", "bottom"), f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}" + self.maybe(0.5, self.links(2, 6)))

    def block(self) -> str:
        r = self.r
        inline = lambda: r.choice(["", "", f'<b>{self.words(1, 3)}</b> ', f'<a href="/{r.randint(1, 9)}">{self.words(1, 3)}</a> ', f"<em>{self.words(1, 3)}</em> "])
        return r.choice(
            [f"<p>{inline()}{self.sentences(1, 8)}</p>"] * 8
            + [f"<p>{self.sentences(1, 3)}", f"<p><b>{self.words(1, 12)}.<br>", f"<p>{self.words(1, 2)}.</p>", f"<h2>{self.words(1, 6)}</h2>", f"<h3>{self.words(1, 6)}</h3>"]
            + [f"<ul><li>{self.sentences(1, 2)}</li><li>{self.sentences(1, 2)}</li></ul>", f"<ol><li>{self.words(2, 9)}<li>{self.words(2, 9)}</ol>", f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"]
            + [f"<pre>{self.words(3, 12)}</pre>", f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>", f'<figure><img src="x"><figcaption>{self.words(3, 9)}</figcaption></figure>', f"<div>{self.sentences(1, 4)}</div>", f"<div><p>{self.sentences(2, 5)}</p><p>{self.sentences(1, 3)}</p></div>"]
        )

    def article(self) -> str:
        r = self.r
        tag, names = r.choice([("article", ("", "", "post", "article"))] * 4 + [("main", ("", "content", "main"))] * 2 + [("div", ("content", "post", "entry-content", "article-body", "story", "main-content", "text"))] * 3 + [("section", ("", "article", "content"))])
        blocks = [self.block() for _ in range(r.randint(1, 10))]
        for part, share in ((self.advert, 0.15), (self.share, 0.15), (self.notice, 0.06), (self.sidebar, 0.08), (self.form, 0.06)):
            if r.random() < share:
                blocks.insert(r.randint(0, len(blocks)), part())
        if r.random() < 0.12:
            blocks.append(self.comments())
        if r.random() < 0.08:
            blocks.append(self.off("footer", ("",), self.words(1, 5)))
        title = r.choice([f"<h1>{self.words(1, 9)}</h1>"] * 3 + [f"<header><h1>{self.words(1, 9)}</h1></header>", ""])
        made = f'<{tag} data-content="1"{self.attribute(*names)}>{title}{"".join(blocks)}</{tag}>'
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            made = f'<{r.choice(["div", "div", "main", "section"])} data-content="0"{self.attribute("", "wrapper", "container", "page", "row", "layout")}>{made}{self.maybe(0.3, self.sidebar())}</div>'
        return made

    def page(self) -> str:
        before = [self.maybe(share, part()) for part, share in ((self.header, 0.5), (self.menu, 0.8), (self.form, 0.15), (self.notice, 0.35), (self.advert, 0.5), (self.sidebar, 0.15))]
        after = [self.maybe(share, part()) for part, share in ((self.share, 0.25), (self.sidebar, 0.4), (self.comments, 0.4), (self.advert, 0.2), (self.form, 0.2), (self.notice, 0.2), (self.footer, 0.85))]
        return f'<html><head><title>{self.words(1, 6)}</title></head><body data-content="0">{"".join(before)}{self.article()}{"".join(after)}</body></html>'


def labelled_pages(n: int = N_PAGES) -> list[str]:
    return [Writer(k).page() for k in range(n)]
