"""Blocks of text of a web page, each with the part of the page that it stands in."""
from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: Parts of a page; blocks of the highest part found are the article.
HIDDEN, APART, PLAIN, CONTENT, MAIN, ARTICLE = -2, -1, 0, 1, 2, 3

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]{0,4000}\"|'[^']{0,4000}'|[\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|textarea|title|iframe|xmp|noembed|noframes)\b{_ATTRIBUTES}>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<[!?][^>]*>"
    rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>{_ATTRIBUTES})>"
    r"|<[/!?a-z][^>]*\Z", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role|itemprop|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

# Fixed values of HTML: elements by what they are.
_VOID = set("area base col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
              "strike strong sub sup time tt u var img wbr input".split())
_UNREAD = set("head noscript template svg math object canvas audio video select datalist".split())
_ASIDE = set("nav footer aside form menu button dialog header".split())
_ENDED_BY_NEXT = set("p li dt dd td th tr option".split())
_OF_HEAD = set("meta link base noscript template basefont bgsound".split())
_BOXES = set("div section article main body html table tbody thead tr td ul ol dl figure fieldset details blockquote center".split())
# Parts of names of classes, ids and roles that say what an element is.
_OTHER = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
             "breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
             "subscribe subscription signup login search share sharing social related recommended recommendations comment comments "
             "commentlist respond disqus reply replies pagination pager widget toolbar footer header masthead copyright "
             "complementary contentinfo alert".split())
_ANYWHERE = set("ad ads advert adverts advertisement advertising sponsored comment comments share social related promo newsletter".split())
_ONLY_LAYOUT = set("has with no without layout".split())
_ARTICLE_PART = set("article post entry story content".split())
_CONTAINERS = set("article articlebody article-body article-content article-text post post-content post-body entry entry-content "
                  "story story-body content main main-content page-content".split())


def _says_other(name: str) -> bool:
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    if not parts or _ONLY_LAYOUT & set(parts):
        return False
    ends = {parts[0], parts[-1]}
    if ends & _ANYWHERE:
        return True
    return bool(ends & _OTHER) and not _ARTICLE_PART & set(parts)


@lru_cache(maxsize=20_000)
def _role(tag: str, attributes: str) -> int | None:
    """The part that an element opens, None where it opens none."""
    if tag in _UNREAD or attributes and _UNSEEN.search(attributes):
        return HIDDEN
    if tag in _ASIDE:
        return APART
    names: list[str] = []
    for kind, *values in _NAMED.findall(attributes) if "=" in attributes else ():
        if kind.lower() != "style":
            names += "".join(values).lower().split()
    if tag not in ("body", "html", "main") and any(map(_says_other, names)):
        return APART
    if tag == "article":
        return ARTICLE
    if tag == "main" or "main" in names and tag not in ("body", "html"):
        return MAIN
    if tag not in _INLINE and tag not in ("body", "html") and _CONTAINERS & set(names):
        return CONTENT
    return None


class _Page:
    def __init__(self) -> None:
        self.blocks: list[tuple[int, int, str]] = []
        self.held: list[str] = []
        self.open: list[tuple[str, int, int]] = []
        self.count: dict[str, int] = {}
        self.part, self.region, self.regions = PLAIN, 0, 0

    def flush(self) -> None:
        if self.held:
            text = "".join(self.held)
            self.held.clear()
            if self.part != HIDDEN:
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((self.part, self.region, text))

    def push(self, tag: str, part: int) -> None:
        if part != self.part:  # an element within one of its part belongs to that one's region
            self.region = next((r for _, p, r in reversed(self.open) if p == part), 0) if part > PLAIN else 0
            if part > PLAIN and not self.region:
                self.regions += 1
                self.region = self.regions
        self.open.append((tag, part, self.region))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.part = part

    def pop_to(self, length: int) -> None:
        while len(self.open) > length:
            self.count[self.open.pop()[0]] -= 1
        self.part, self.region = self.open[-1][1:] if self.open else (PLAIN, 0)

    def close(self, tag: str) -> None:
        if self.count.get(tag):
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self.pop_to(at)

    def part_of(self, tag: str, attributes: str) -> int:
        """The part in which the element's text stands, given where it is opened."""
        role, now = _role(tag, attributes), self.part
        if now == HIDDEN or role == HIDDEN:
            return HIDDEN
        if now == APART:
            # A form around the whole page does not set its article apart; a heading in an article's header is the article's.
            around = {t for t, p, _ in self.open if p == APART}
            if role in (ARTICLE, MAIN) and around == {"form"}:
                return role
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1][0] == "header":
                return max((p for _, p, _ in self.open), default=APART) if any(p > PLAIN for _, p, _ in self.open) else APART
            return APART
        if role is None:
            return now
        if role == ARTICLE and any(t == "article" and p == ARTICLE for t, p, _ in self.open):
            return APART  # an article within an article is a comment on it
        return role if role == APART else max(now, role)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "body":
            self.pop_to(0)
        if self.open and self.open[-1][0] == "head" and tag not in _OF_HEAD:
            self.pop_to(len(self.open) - 1)
        if tag in _VOID:
            return
        # A paragraph ends where the next block begins, a list item or cell where the next one does.
        top = self.open[-1][0] if self.open else ""
        if top == "p" or top in _ENDED_BY_NEXT and top == tag:
            self.pop_to(len(self.open) - 1)
        part = self.part_of(tag, attributes)
        if part != self.part or tag in _BOXES:
            self.push(tag, part)


def page_blocks(html: str) -> list[tuple[int, int, str]]:
    """``(part, region, text)`` of the page's blocks in order, white space in single blanks, hidden ones left out.

    Regions are the marked elements, numbered from 1; blocks outside have 0.
    Elements that are not closed, closed twice or cut off at the end are read as a browser
    does, as far as it matters here.
    """
    page, at = _Page(), 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            page.held.append(html[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            page.held.append(" ")
        elif tag in _INLINE:
            # Only inline elements that stand apart from the text around them matter.
            if not m["close"]:
                if m["attributes"] and tag not in _VOID and _role(tag, m["attributes"]) in (HIDDEN, APART):
                    page.flush()
                    page.push(tag, page.part_of(tag, m["attributes"]))
            elif page.open and page.open[-1][0] == tag:
                page.flush()
                page.pop_to(len(page.open) - 1)
        else:
            page.flush()
            if m["close"]:
                page.close(tag)
            else:
                page.start(tag, m["attributes"])
    page.held.append(html[at:])
    page.flush()
    return page.blocks
