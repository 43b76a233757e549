"""Pages with known main text, from random layouts: the labels that the extractor's trees are fitted on.

Every layout draws its container, class names, order of furniture and amount of text at random; words are made of
random syllables, so nothing but structure, attributes and densities can tell the article from the rest.
"""

from __future__ import annotations

import random

MAIN = ["article", "main", 'div class="post-content"', 'div id="content"', 'div class="entry"', 'div class="story-body"', 'section class="article-text"', 'div role="main"', 'div itemprop="articleBody"', "div", 'td class="text"', 'div class="page-body"']
SIDE = ['aside', 'div class="sidebar"', 'div id="right-rail"', 'aside class="widget"', 'div class="related"', 'div class="recommended-stories"', 'section class="popular"', 'div class="see-also"']
ADS = ['div class="ad"', 'div class="ads"', 'div id="advert"', 'div class="banner"', 'div class="promo"', 'div class="sponsored"', 'aside class="advertisement"', 'section class="sponsor-box"', 'p class="ad"', 'div class="ad-slot"']
NOTES = ['div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div class="alert"', 'div role="alert"', 'section class="gdpr-banner"', 'div class="notification"', 'p class="notice"', 'div class="popup"', 'div class="modal"', 'div class="disclaimer"', 'dialog']
TALK = ['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="replies"', 'div id="discussion"', 'section class="user-comments"', 'div class="responses"', 'div class="comment-thread"', 'section class="reader-comments"']
NAV = ["nav", 'div class="menu"', 'ul id="navigation"', 'div class="breadcrumb"', 'nav class="breadcrumbs"', 'div class="navbar"', 'div class="topnav"', 'menu', 'div class="tags"', 'div class="pagination"', 'div class="share"', 'div class="social-links"']
HEAD = ["header", 'div class="header"', 'div id="masthead"', 'header class="site-header"', 'div class="topbar"', 'div class="site-title"']
FOOT = ["footer", 'div class="footer"', 'div id="bottom"', 'footer class="site-footer"', 'div class="copyright"', 'section class="footer-links"', 'div class="legal"']
FORM = ["form", 'form class="search"', 'div class="newsletter"', 'form id="subscribe"', 'div class="signup"', 'div class="login"', 'form class="comment-form"']


#: A private-use sign that marks the blocks of the main text; the fitting takes it out before it looks at a page.
MARK = "\ue000"


class Maker:
    def __init__(self, seed: int):
        self.r = r = random.Random(seed)
        # a page's own vocabulary and style, shared by its article and its furniture
        syllables = r.randint(1, 4)
        self.pool = ["".join(r.choice("bdfglmnprstvz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s"]) for _ in range(r.randint(1, syllables))) for _ in range(60)]
        self.stops = r.choice([[".", ".", ".", ""], [".", "!", ","], [" |", ".", ""], ["", ".", "?"]])
        self.length = r.choice([3, 8, 14, 30])
        self.linked, self.plain, self.inset = r.choice([0, 0, 0.1, 0.3]), r.random() < 0.5, r.choice([0, 0.07])

    def words(self, least: int, most: int) -> str:
        r, out, left = self.r, [], self.r.randint(least, most)
        while left > 0:
            k = min(left, r.randint(1, self.length))
            out.append(" ".join(r.choices(self.pool, k=k)).capitalize() + r.choice(self.stops))
            left -= k
        return " ".join(out)

    def tag(self, name: str, body: str) -> str:
        return f"<{name}>{body}</{name.split()[0]}>"

    def block(self, kind: str, least: int, most: int) -> str:
        """A block of the main text, which starts with the mark."""
        body = self.words(least, most)
        if self.r.random() < self.linked:
            body += f' <a href="/x">{self.words(1, 4)}</a>'
        if self.r.random() < 0.15:
            body = f"<{self.r.choice(['b', 'em', 'i', 'span', 'strong'])}>{body}"
        return f"<{kind}>{MARK}{body}</{kind}>" if self.r.random() < 0.9 or kind != "p" else f"<p>{MARK}{body}<br>"

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(self.block(r.choice(["h1", "h1", "h2"]), 2, 12))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            k = r.random() * (0.8 if self.plain else 1)
            size = r.choice([(1, 4), (4, 20), (20, 80), (40, 160)])
            if k < 0.8:
                out.append(self.block("p", *size))
            elif k < 0.85:
                out.append(self.block(r.choice(["h2", "h3", "h4"]), 1, 7))
            elif k < 0.89:
                out.append(self.tag(r.choice(["ul", "ol"]), "".join(self.block("li", 2, 20) for _ in range(r.randint(2, 6)))))
            elif k < 0.91:
                out.append(self.tag("blockquote", self.block("p", *size)))
            elif k < 0.925:
                out.append(self.block("pre", 3, 30))
            elif k < 0.94:
                out.append(self.tag("table", "".join(self.tag("tr", "".join(self.block("td", 1, 5) for _ in range(3))) for _ in range(r.randint(2, 4)))))
            elif k < 0.955:
                out.append(self.tag("figure", '<img src="a.png">' + self.block("figcaption", 3, 15)))
            elif k < 0.97:
                out.append(self.block("div", *size))
            else:
                out.append(self.tag(r.choice(["div", "section"]), "".join(self.block("p", *size) for _ in range(r.randint(1, 3)))))
            if r.random() < self.inset:
                out.append(self.junk(r.choice([ADS, ADS, SIDE, NAV, NOTES, FORM])))
        return "".join(out)

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def junk(self, kinds: list[str]) -> str:
        r, kind = self.r, self.r.choice(kinds)
        if kinds is NAV:
            body = self.links(r.randint(2, 9)) if r.random() < 0.7 else " ".join(f'<a href="/">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 8)))
        elif kinds is FORM:
            body = f'<label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button>' + (f"<p>{self.words(3, 20)}</p>" if r.random() < 0.5 else "")
        elif kinds is TALK:
            inner = r.choice(["div", "li", 'div class="comment"', "p", 'article class="comment"'])
            body = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(self.tag(inner, r.choice([f"<p>{self.words(2, 60)}</p>", self.words(2, 60), f"<b>{self.words(1, 2)}</b><p>{self.words(3, 90)}</p>"])) for _ in range(r.randint(1, 7)))
        elif kinds is SIDE:
            body = (f"<h3>{self.words(1, 4)}</h3>" if r.random() < 0.7 else "") + r.choice([self.links(r.randint(2, 7)), "".join(f"<p>{self.words(4, 40)}</p>" for _ in range(r.randint(1, 3)))])
        elif kinds is FOOT:
            body = r.choice(["&copy; ", ""]) + self.words(2, 25) + (self.links(3) if r.random() < 0.4 else "")
        elif kinds is HEAD:
            body = r.choice([self.words(1, 8), f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 12)}</p>"]) + (self.tag("nav", self.links(4)) if r.random() < 0.4 else "")
        else:
            body = r.choice([self.words(2, 40), f"<p>{self.words(3, 60)}</p>", f'{self.words(2, 9)} <a href="/">{self.words(1, 3)}</a>', f"<h4>{self.words(1, 3)}</h4><p>{self.words(3, 30)}</p>"])
        return self.tag(kind, body)

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: self.junk(kinds) if r.random() < p else ""
        before = [some(NOTES, 0.3), some(HEAD, 0.5), some(NAV, 0.7), some(ADS, 0.5), some(FORM, 0.2), some(NAV, 0.2)]
        after = [some(NAV, 0.25), some(SIDE, 0.4), some(TALK, 0.4), some(ADS, 0.25), some(FORM, 0.2), some(FOOT, 0.75), some(NOTES, 0.15)]
        side = some(SIDE, 0.25)
        if r.random() < 0.3:
            r.shuffle(before)
            r.shuffle(after)
        body = self.tag(r.choice(MAIN), some(NAV, 0.06) + self.main() + some(TALK, 0.08) + some(NAV, 0.08))
        if r.random() < 0.3:
            body = self.tag(r.choice(['div class="wrapper"', 'div id="page"', "div", 'div class="container"', "main"]), side + body + (some(SIDE, 0.3) if r.random() < 0.5 else ""))
        else:
            body = side + body
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{''.join(before)}<!-- c -->{body}{''.join(after)}{end}"
