"""Labelled training pages for the extraction field.

Pages are drawn from a small grammar of page parts, by a fixed seed.  Each part
knows whether it belongs to the article, so labels need no hand work.  Parts
appear under semantic tags, or under plain containers with telling names, or
under both; words are invented, so that no language is favoured.  The sentence
statistics of comments, notices and adverts are those of articles, so the field
must learn them from where they stand.
"""

from __future__ import annotations

import random

from .html_extract import Block, blocks

PAGES = 700
SEED = 5

# Names that page parts go by.
ARTICLE = "article content post entry story main body text blog news page article-body post-content entry-content main-content".split()
MENU = "nav menu navbar navigation breadcrumb breadcrumbs tabs toolbar topnav main-menu pagination pager toc skip-links".split()
HEADER = "header masthead top banner site-header logo branding topbar page-header".split()
FOOTER = "footer site-footer bottom copyright legal credits foot colophon".split()
SIDE = "sidebar aside widget rail related recommended trending popular secondary side tags archive recent see-also more-stories".split()
NOTICE = "notice cookie cookies consent alert banner popup modal gdpr privacy warning message announcement overlay paywall cookie-banner disclaimer".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion adsense banner-ad ad-slot partner".split()
FORM = "form newsletter subscribe signup login search contact feedback survey search-form".split()
COMMENT = "comment comments reply replies discussion disqus respond responses reader-comments user-comments thread comment-list".split()
SHARE = "share social follow buttons meta byline sharing social-links author-box".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.keys: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choice("ka to mi re na su lo ve di pe ra no ti sha en".split()) for _ in range(self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(w + ("," if self.r.random() < 0.06 else "") for w in words).capitalize().rstrip(",")

    def prose(self, short: float = 0.25) -> str:
        sentences = self.r.randint(1, 2) if self.r.random() < short else self.r.randint(2, 8)
        return " ".join(self.phrase(1, 18) + "." for _ in range(sentences))

    def say(self, text: str, label: int) -> str:
        """Text with its label hidden in a private character."""
        mark = chr(0xE000 + label)
        if self.r.random() < 0.2 and " " in text:
            first, rest = text.split(" ", 1)
            text = f"<{t}>{first}</{t}> {rest}" if (t := self.r.choice(["b", "em", "strong", "i", "span"])) else text
        return mark + text

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def part(self, semantic: str | None, given: list[str], inner: str) -> str:
        tag = semantic if semantic and self.r.random() < 0.6 else self.r.choice(["div", "div", "section"])
        attribute = ""
        if tag in ("div", "section") or self.r.random() < 0.4:
            attribute = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(given)}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, label: int, low: int = 3, high: int = 8) -> str:
        items = [self.link(self.say(self.phrase(1, 4), label)) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<p>{x}</p>" if self.r.random() < 0.5 else f"<div>{x}</div>" for x in items)

    def article(self) -> str:
        out, r = [], self.r
        if r.random() < 0.85:
            heading = f"<h1>{self.say(self.phrase(2, 12), 1)}</h1>"
            out.append(f"<header>{heading}</header>" if r.random() < 0.05 else heading)
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.68:
                text = self.say(self.prose(), 1)
                if r.random() < 0.15:
                    text += " " + self.link(self.phrase(1, 3)) + " " + self.phrase(1, 6) + "."
                out.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else "<br>"))
            elif kind < 0.76:
                out.append(f"<h{(k := r.randint(2, 4))}>{self.say(self.phrase(1, 8), 1)}</h{k}>")
            elif kind < 0.84:
                out.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.say(self.phrase(1, 14), 1)}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{self.say(self.prose(), 1)}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<pre>{self.say(self.phrase(3, 12), 1)}</pre>")
            elif kind < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.say(self.phrase(1, 4), 1)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{self.say(self.phrase(3, 12), 1)}</figcaption></figure>")
            else:
                out.append(f"<div>{self.say(self.prose(), 1)}</div>")
            if r.random() < 0.07:
                out.append(r.choice([self.advert, self.notice, self.related, self.share, self.newsletter])())
        return "".join(out)

    def menu(self) -> str:
        return self.part("nav", MENU, self.links(0))

    def header(self) -> str:
        inner = f"<h{(k := self.r.randint(1, 3))}>{self.say(self.phrase(1, 4), 0)}</h{k}>" + (f"<p>{self.say(self.phrase(2, 9), 0)}</p>" if self.r.random() < 0.5 else "")
        return self.part("header", HEADER, inner + (self.menu() if self.r.random() < 0.4 else ""))

    def footer(self) -> str:
        text = self.r.choice(["&copy; ", "", "© 2020 "]) + self.phrase(2, 6) + self.r.choice([" &middot; " + self.prose(), ""])
        inner = self.say(text, 0) if self.r.random() < 0.5 else f"<p>{self.say(self.prose(), 0)}</p><p>{self.say(text, 0)}</p>"
        return self.part("footer", FOOTER, inner + (self.links(0) if self.r.random() < 0.3 else ""))

    def related(self) -> str:
        inner = f"<h3>{self.say(self.phrase(1, 4), 0)}</h3>" + (self.links(0) if self.r.random() < 0.5 else f"<p>{self.say(self.prose(), 0)}</p>")
        return self.part("aside", SIDE, inner)

    def notice(self) -> str:
        text = self.say(self.prose(), 0)
        tag = self.part(None, NOTICE, text if self.r.random() < 0.5 else f"<p>{text}</p><button>{self.say(self.phrase(1, 2), 0)}</button>")
        return tag.replace("<div", '<div role="alert"', 1) if self.r.random() < 0.3 else tag

    def advert(self) -> str:
        text = self.say(self.prose(), 0)
        return self.part("aside" if self.r.random() < 0.2 else None, ADVERT, text if self.r.random() < 0.6 else f"<p>{self.link(text)}</p>")

    def newsletter(self) -> str:
        inner = f"<p>{self.say(self.prose(), 0)}</p><label>{self.say(self.phrase(1, 3), 0)}</label><input><button>{self.say(self.phrase(1, 2), 0)}</button>"
        return f"<form>{inner}</form>" if self.r.random() < 0.5 else self.part("form", FORM, inner if self.r.random() < 0.5 else f"<form>{inner}</form>")

    def share(self) -> str:
        return self.part(None, SHARE, self.say(self.phrase(1, 6), 0) if self.r.random() < 0.5 else self.links(0, 2, 4))

    def comments(self) -> str:
        one = lambda: f'<{(t := self.r.choice(["div", "li", "article", "section"]))} class="{self.r.choice(COMMENT)}"><b>{self.say(self.word(), 0)}</b><p>{self.say(self.prose(), 0)}</p></{t}>'
        inner = f"<h{(k := self.r.randint(2, 4))}>{self.say(self.phrase(1, 3), 0)}</h{k}>" + "".join(one() for _ in range(self.r.randint(1, 4)))
        return f'<{(t := self.r.choice(["div", "section", "aside", "ul"]))} {self.r.choice(["class", "id"])}="{self.r.choice(COMMENT)}">{inner}</{t}>'

    def page(self) -> str:
        r = self.r
        inner = self.article()
        how = r.random()
        if how < 0.45:
            body = f"<article>{inner}</article>"
        elif how < 0.6:
            body = f"<main>{inner}</main>"
        elif how < 0.7:
            body = f"<main><article>{inner}</article></main>"
        elif how < 0.76:
            body = inner
        else:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(ARTICLE)}">{inner}</div>'
        chance = lambda p, part: part() if r.random() < p else ""
        before = [chance(0.7, self.menu), chance(0.4, self.header), chance(0.3, self.notice), chance(0.4, self.advert), chance(0.15, self.newsletter)]
        after = [chance(0.35, self.related), chance(0.4, self.comments), chance(0.2, self.advert), chance(0.25, self.newsletter), chance(0.15, self.share), chance(0.2, self.notice), chance(0.2, self.menu)]
        r.shuffle(before)
        r.shuffle(after)
        middle = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            middle = f'<div class="{r.choice(["wrapper", "container", "layout", "row", "site"])}">{middle}</div>'
        return f"<html><head><title>x</title></head><body>{middle}{chance(0.85, self.footer)}</body></html>"


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    """(blocks, labels) of each training page."""
    maker, out = _Maker(seed), []
    for _ in range(count):
        found = blocks(maker.page())
        labels = [int("" in b.text) for b in found]
        for b in found:
            b.text = b.text.replace("", "").replace("", "") or "x"
        out.append((found, labels))
    return out
