"""Labelled sample pages, made up from a seed, that the classifier of blocks is fitted on.

A page is a few wrappers around boilerplate and one article, in layouts drawn
at random: with and without landmark elements, with telling, meaningless and
misleading names, with notices and adverts inside of the article, comments
within or after it, forms around the whole page.  Words are random syllables,
so nothing of a language is learned.
"""

from __future__ import annotations

import random

#: Names of boilerplate containers by kind; an empty one is an element without a name.
NAV = ["nav", "menu", "main-menu", "navbar", "site-navigation", "breadcrumbs", "links", "top", ""]
TOP = ["header", "site-header", "masthead", "banner", "branding", "top", ""]
SIDE = ["sidebar", "side", "widget", "right-rail", "related-posts", "trending", "col-3", "secondary", ""]
FOOT = ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", ""]
NOTICE = ["cookie-notice", "alert", "notice", "gdpr-consent", "popup", "newsletter-signup", "msg", ""]
ADVERT = ["ad", "ads", "advert", "ad-container", "sponsored", "promo-box", "banner-ad", "adv", "dfp", "newsletter-cta", "ad-slot-7"]
TALK = ["comments", "comment-list", "respond", "discussion", "disqus_thread", "replies"]
SHARE = ["share", "share-buttons", "social", "post-meta", "tags", "related", "author-box", "tools", "related-stories", "share-this"]
#: Names that sound like boilerplate on wrappers, and on parts of the article.
WRAPPER = ["page", "wrap", "container", "site", "ad-free", "comments-open", "wrap side-right", "has-sidebar", "nav-fixed", "no-ads", "social-feed", "header-large", "promo-layout", "layout", ""]
MISLEADING = ["meta-analysis", "side-effects", "share-price", "search-results-study", "ad-hoc", "legal-history", "notice-period", "tags-explained"]
PLAIN = ["", "", "", "", "lead", "intro", "para", "text", "x1"]
CONTENT = ["content", "post", "entry-content", "article-body", "story", "main", "text", "prose", "c1", "col-9", ""]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.content: set[str] = set()

    def words(self, low: int, high: int) -> str:
        own = ["".join(self.rng.choice("aeiou") + self.rng.choice("bdfgklmnprstvw") for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high))]
        return " ".join(own)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 14).capitalize() + self.rng.choice("....!?") for _ in range(self.rng.randint(low, high)))

    def named(self, tag: str, names: list[str], inner: str) -> str:
        name = self.rng.choice(names)
        if names in (NAV, TOP, SIDE, NOTICE, TALK) and self.rng.random() < 0.1:
            role = {id(NAV): "navigation", id(TOP): "banner", id(SIDE): "complementary", id(NOTICE): "alert", id(TALK): "complementary"}[id(names)]
            return f"<{tag} role={role}>{inner}</{tag}>"
        if names in (NOTICE, ADVERT, SIDE) and self.rng.random() < 0.08:
            return f"<{tag} {self.rng.choice(('hidden', 'style=\"display: none\"', 'aria-hidden=true'))}>{inner}</{tag}>"
        if not name:
            return f"<{tag}>{inner}</{tag}>"
        return f"<{tag} {self.rng.choice(('class', 'class', 'id'))}=\"{name}\">{inner}</{tag}>"

    def of(self, text: str, tag: str = "p", names: list[str] | None = None) -> str:
        """An element of the article."""
        self.content.add(text)
        return self.named(tag, names or PLAIN, text)

    def links(self, n: int) -> str:
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li><a href='/x'>{self.words(1, 5)}</a></li>" for _ in range(n)) + "</ul>"
        return " ".join(f"<a href='/x'>{self.words(1, 3)}</a>" for _ in range(n))

    def blurb(self, low: int = 1, high: int = 3) -> str:
        """Boilerplate prose."""
        r = self.rng.random()
        text = self.sentences(low, high) if r < 0.7 else self.words(2, 12)
        return f"<p>{text}</p>" if self.rng.random() < 0.7 else text

    def paragraph(self) -> str:
        r = self.rng.random()
        if r < 0.08:
            return self.of(self.words(1, 3).capitalize() + self.rng.choice((".", ".", "")))
        text = self.sentences(1, 2) if r < 0.3 else self.sentences(2, 9)
        if r > 0.93:
            return self.of(text, names=MISLEADING)
        if r > 0.8:
            at = len(text) // 3
            linked = f"{text[:at]}<a href='/y'>{text[at : at + 12]}</a>{text[at + 12 :]}"
            self.content.add(text)
            return f"<p>{linked}</p>"
        return self.of(text)

    def body(self) -> str:
        out = []
        for _ in range(self.rng.choice((0, 1, 1, 2, 3, 4, 6, 8, 12))):
            r = self.rng.random()
            if r < 0.12:
                out.append(self.of(self.words(2, 7).capitalize(), self.rng.choice(("h2", "h3", "h4"))))
            if r < 0.2:
                out.append("<ul>" + "".join(self.of(self.words(1, 9), "li") for _ in range(self.rng.randint(2, 6))) + "</ul>")
            elif r < 0.24:
                out.append("<table>" + "".join("<tr>" + "".join(self.of(self.words(1, 3), "td") for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif r < 0.28:
                out.append(f"<figure><img src=i>{self.of(self.words(3, 12), 'figcaption')}</figure>")
            elif r < 0.34:
                out.append(f"<blockquote>{self.of(self.sentences(1, 4))}</blockquote>")
            elif r < 0.38:
                out.append(self.named("div", MISLEADING, self.paragraph() + self.paragraph()))
            elif r < 0.46:
                out.append(self.named(self.rng.choice(("div", "div", "p", "aside", "section")), ADVERT, self.sentences(1, 3)))
            elif r < 0.5:
                out.append(self.named("div", SHARE, self.links(self.rng.randint(2, 6))))
            out.append(self.paragraph())
        return "".join(out)

    def comments(self) -> str:
        tag = self.rng.choice(("div", "li", "article"))
        own = "".join(f"<{tag}{self.rng.choice((' class=comment', ''))}><b>{self.words(1, 2)}</b> {self.blurb(1, 5)}</{tag}>" for _ in range(self.rng.randint(1, 8)))
        return self.named(self.rng.choice(("div", "section", "ol" if tag == "li" else "div")), TALK, f"<h3>{self.words(1, 3)}</h3>{own}")

    def form(self) -> str:
        return f"<form action='/s'><label>{self.words(1, 3)}</label><input name=q><p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button></form>"

    def make(self) -> str:
        rng, some = self.rng, lambda p: self.rng.random() < p
        title = self.of(self.words(3, 9).capitalize(), "h1")
        body = self.body()
        if some(0.3):
            title = f"<header>{title}</header>"
        talk = self.comments() if some(0.45) else ""
        foot_in = f"<footer>{self.links(3)}{self.blurb(1, 1)}</footer>" if some(0.15) else ""
        within = some(0.5)
        r = rng.random()
        article = title + body + foot_in + (talk if within else "")
        if r < 0.35:
            article = f"<article>{article}</article>"
        elif r < 0.5:
            article = f"<main>{self.named('div', CONTENT, article)}</main>"
        elif r < 0.62:
            article = f"<main><article>{article}</article></main>"
        elif r < 0.85:
            article = self.named("div", CONTENT, article)
        elif r < 0.92:
            article = title + self.named("section", CONTENT, body + foot_in + (talk if within else ""))
        else:
            article = f"<table><tr><td>{self.links(5)}</td><td>{article}</td></tr></table>"
        before, after = [], []
        if some(0.7):
            tag = rng.choice(("header", "header", "div"))
            before.append(self.named(tag, TOP if tag == "header" or some(0.1) else TOP[:5], f"<{rng.choice(('p', 'h1', 'div', 'a'))}>{self.words(1, 5)}</a>" + (self.links(4) if some(0.4) else "")))
        if some(0.8):
            tag = rng.choice(("nav", "nav", "div"))
            before.append(self.named(tag, NAV if tag == "nav" or some(0.1) else NAV[:6], self.links(rng.randint(3, 9))))
        if some(0.4):
            (before if some(0.6) else after).append(self.named("div", NOTICE if some(0.3) else NOTICE[:6], self.blurb()))
        if some(0.5):
            (before if some(0.6) else after).append(self.named(rng.choice(("div", "div", "aside", "section")), ADVERT, self.blurb()))
        if some(0.5):
            tag = rng.choice(("aside", "div"))
            (before if some(0.3) else after).append(self.named(tag, SIDE if tag == "aside" or some(0.1) else SIDE[:6], f"<h3>{self.words(1, 4)}</h3>" + (self.links(6) if some(0.5) else self.blurb(1, 4)) + (self.form() if some(0.3) else "")))
        if some(0.25):
            (before if some(0.4) else after).append(self.form())
        if talk and not within:
            after.append(talk)
        if some(0.85):
            tag = rng.choice(("footer", "footer", "div"))
            after.append(self.named(tag, FOOT if tag == "footer" else FOOT[:4], rng.choice(("&copy; ", "© 2021 ", "", "")) + self.blurb() + (self.links(4) if some(0.4) else "")))
        page = "".join(before) + article + "".join(after)
        if some(0.12):
            page = f"<form id='aspnet'>{page}</form>"
        for _ in range(rng.randint(0, 2)):
            page = self.named("div", WRAPPER, page)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"


def labelled_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """(html, texts of the blocks that are content) of n pages."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        page = _Page(rng)
        out.append((page.make(), page.content))
    return out
