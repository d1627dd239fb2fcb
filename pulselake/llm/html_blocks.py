"""Leaf blocks of HTML pages, and pages in other dress to learn from.

A block is the text between two tags that start or end a block-level element; its path holds the
block-level elements around it, with the words of their classes, ids and roles.  Scripts, styles,
the head, form controls and comments are no text.  Character references are decoded, white space
(Unicode's) becomes one space.  Tags that are not closed end where HTML ends them.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from html.parser import HTMLParser
from typing import NamedTuple

#: Elements of HTML by how they lay out text.
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend blockquote pre figure figcaption address "
    "details summary dialog center hr menu search hgroup ins".split()
)
UNSEEN = frozenset("head script style noscript template textarea select button iframe object svg math canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end when one of these starts within the same parent.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: An implied end does not reach through these.
SCOPES = frozenset("ul ol dl table menu".split())
_P_ENDS = BLOCKS - {"ins", "html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Block(NamedTuple):
    path: tuple[tuple[str, ...], ...]  # of each element around it: the tag, and the words of its names
    text: str
    linked: int  # characters within links


class BlockParser(HTMLParser):
    """Blocks of a page in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, ...]] = []
        self.blocks: list[Block] = []
        self.words: list[str] = []
        self.links = self.linked = 0
        self.unseen: list[str] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append(Block(tuple(self.stack), text, min(self.linked, len(text))))
        self.words, self.linked = [], 0

    def _close(self, tag: str, scopes: frozenset = frozenset()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                self.links = 0
                return
            if self.stack[i][0] in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen:
            if tag == self.unseen[-1] and tag not in VOID:
                self.unseen.append(tag)
            elif self.unseen == ["head"] and tag == "body":  # the head was not closed
                self.unseen.clear()
            if self.unseen:
                return
        if tag in UNSEEN:
            self.unseen.append(tag)
        elif tag in BLOCKS:
            self.end_block()
            if tag in _P_ENDS:
                self._close("p", SCOPES | {"td", "th", "div", "article", "section"})
            for other in IMPLIED.get(tag, ()):
                self._close(other, SCOPES)
            if tag not in VOID:
                names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop"))
                self.stack.append((tag, *(w.lower() for w in _NAME_WORD.findall(names))))
        elif tag == "a":
            self.links = 1
        elif tag == "br":
            self.words.append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in UNSEEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
        elif tag in BLOCKS:
            self.end_block()
            self._close(tag)
        elif tag == "a":
            self.links = 0

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.words.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    parser = BlockParser()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    return parser.blocks


#: Elements and names that HTML and common usage give to the parts of a page.
APART = frozenset("nav aside header footer form dialog menu search".split())
APART_NAMES = frozenset("ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget related footer header masthead cookie consent notice popup newsletter subscribe comment comments respond share social login".split())


def marked_main(block: Block) -> bool | None:
    """Whether the page's own markup calls the block part of an article; None if it marks neither."""
    inside = [e[0] in ("article", "main") for e in block.path]
    apart = any(e[0] in APART or not APART_NAMES.isdisjoint(e[1:]) for e in block.path)
    return None if not any(inside) and not apart else any(inside) and not apart


#: How pages name their parts; each is a start tag.
MAIN = (
    "article", "main", 'div class="content"', 'div id="main-content"', 'section class="post-body"', 'div class="entry-content"', 'div itemprop="articleBody"', 'div class="article-text"', 'div id="story"', 'td class="body-text"', 'div role="main"', 'div class="post"', 'div class="mw-parser-output"', "section",
)
HEADERS = ("header", 'div id="header"', 'div class="masthead"', 'div class="site-header"', 'div role="banner"', 'div class="top-bar"')
MENUS = ("nav", 'div class="menu"', 'div id="navbar"', 'ul class="navigation"', 'div class="main-nav"', 'div class="breadcrumbs"', 'div role="navigation"', 'div class="tabs"')
NOTICES = ('div class="cookie-notice"', 'div id="consent-banner"', 'div role="alert"', 'div class="notice"', 'div class="gdpr-popup"', 'div class="subscribe-modal"', 'div class="paywall-message"', 'dialog class="cookies"')
ADVERTS = ('div class="ad"', 'div class="advert"', 'div class="ad-slot"', 'div id="banner"', 'div class="sponsored"', 'aside class="promo"', 'ins class="ads"', 'div class="advertisement"', 'section class="sponsor-box"')
SIDES = ("aside", 'div class="sidebar"', 'div id="right-rail"', 'div class="widget"', 'section class="related"', 'div class="recommended-posts"', 'div class="tag-cloud"', 'div class="share-buttons"', 'div class="author-box"')
COMMENTS = ('section id="comments"', 'div class="comments"', 'ol class="commentlist"', 'div class="comment-thread"', 'div id="disqus"', 'div class="user-reviews"', 'div class="replies"')
FORMS = ("form", 'form class="newsletter"', 'form id="search"', 'form class="login"', 'fieldset class="contact-form"')
FOOTERS = ("footer", 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="bottom-links"')
SHORT = (
    "Home", "About", "Contact us", "Log in", "Sign up", "Search", "Menu", "Privacy policy", "Terms of use", "Accept all cookies", "We use cookies to improve this site.", "Read more", "Share", "Reply", "Subscribe to our newsletter", "All rights reserved.", "© 2024 Example", "Advertisement", "Related articles", "Most read", "Your e-mail", "Posted by guest", "3 comments",
)


def dressed(main: list[str], other: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page in another dress, and for each of its blocks whether it is main text.

    ``main`` are the paragraphs of an article in order, ``other`` texts that are none."""
    out: list[str] = ["<html><head><title>t</title></head><body>"]
    labels: list[bool] = []
    plain = rng.random() < 0.15  # names that say nothing

    def put(text: str, label: bool) -> str:
        labels.append(label)
        return htmllib.escape(text, quote=False)

    def aside() -> str:
        pool = rng.random()
        return rng.choice(SHORT) if pool < 0.4 or not other else rng.choice(other) if pool < 0.8 or not main else rng.choice(main)

    def part(start: str, inner) -> None:
        tag = start.split()[0]
        if plain and start not in ("article", "main"):
            start = f'{tag if tag in ("td", "ul", "ol", "form") else "div"} class="c{rng.randrange(100)}"'
            tag = start.split()[0]
        out.append(f"<{start}>")
        inner()
        out.append(f"</{tag}>")

    def links() -> None:
        out.append("<ul>")
        for _ in range(rng.randrange(1, 7)):
            out.append(f"<li><a href='/x'>{put(aside()[:60] or 'x', False)}</a></li>")
        out.append("</ul>")

    def texts(least: int = 1, most: int = 3) -> None:
        for _ in range(rng.randrange(least, most + 1)):
            kind = rng.choice(("p", "div", "span", "p", "h3", "a", "h2"))
            out.append(f"<div><{kind}>{put(aside(), False)}</{kind}></div>" if kind in ("span", "a") else f"<{kind}>{put(aside(), False)}</{kind}>")

    def bare() -> None:
        out.append(put(aside(), False))

    def controls() -> None:
        for _ in range(rng.randrange(1, 4)):
            out.append(f"<p><label>{put(rng.choice(SHORT), False)}</label><input name='x'><button>Send</button></p>")

    def comments() -> None:
        for _ in range(rng.randrange(1, 5)):
            out.append(f"<{(tag := rng.choice(('li', 'div', 'article')))} class='{rng.choice(('comment', 'comment-body', 'reply', 'review'))}'>")
            texts(1, 3)
            out.append(f"</{tag}>")

    def one_of(kinds: tuple[str, ...], inner) -> None:
        part(rng.choice(kinds), inner)

    def boilerplate(where: str) -> None:
        chances = {
            "top": ((NOTICES, rng.choice((texts, bare)), 0.3), (HEADERS, texts, 0.5), (MENUS, links, 0.7), (ADVERTS, rng.choice((bare, texts)), 0.5), (SIDES, links, 0.15), (FORMS, controls, 0.15)),
            "inside": ((ADVERTS, rng.choice((bare, texts)), 0.08), (FORMS, controls, 0.03), (SIDES, links, 0.04), (NOTICES, texts, 0.03), (COMMENTS, comments, 0.01)),
            "bottom": ((SIDES, rng.choice((links, texts)), 0.4), (COMMENTS, comments, 0.4), (FORMS, controls, 0.3), (ADVERTS, bare, 0.3), (NOTICES, texts, 0.2), (FOOTERS, rng.choice((bare, texts, links)), 0.8)),
        }[where]
        for kinds, inner, chance in chances:
            if rng.random() < chance:
                one_of(kinds, inner)

    def article() -> None:
        for i, text in enumerate(main):
            if i and rng.random() < 0.5:
                boilerplate("inside")
            kind = "h1" if i == 0 and rng.random() < 0.7 else rng.choices(("p", "h2", "blockquote", "li", "pre", "div", "td"), (70, 6, 4, 8, 2, 8, 2))[0]
            inner = put(text, True)
            inner = f"<a href='/y'>{inner}</a>" if rng.random() < 0.02 else inner
            out.append(f"<ul><li>{inner}</li></ul>" if kind == "li" else f"<table><tr><td>{inner}</td></tr></table>" if kind == "td" else f"<{kind}>{inner}</{kind}>")

    boilerplate("top")
    wrapped = rng.random() < 0.3
    out.append('<div class="wrapper">' if wrapped else "")
    start = rng.choice(MAIN)
    out.append("<table><tr>" if start.startswith("td") else "")
    one = lambda: part(start, article)
    if rng.random() < 0.2:
        part(rng.choice(('div class="container"', "main", 'div id="page"', 'div class="row"')), one)
    else:
        one()
    out.append("</tr></table>" if start.startswith("td") else "")
    out.append("</div>" if wrapped else "")
    boilerplate("bottom")
    out.append("</body></html>")
    return "".join(out), labels
