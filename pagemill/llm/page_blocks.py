"""Text blocks of a page, each with what kind of element it stands in.

One scan over the markup that never goes back. End tags that may be left out are
implied. A block ends at every start and end of a block element and at line breaks.
"""

from __future__ import annotations

import html
import re

CONTENT, NEUTRAL, CHROME = 2, 1, 0

# fixed values: element names
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup"
    " option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe noembed noframes xmp svg math object select".split())
CHROME_TAGS = set("nav footer aside form menu dialog button fieldset search datalist canvas audio video head".split())
CLOSES_P = BLOCK - {"br", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}
SCOPE = {"p": "td th caption button table", "li": "ul ol menu", "dd": "dl", "dt": "dl", "td": "table", "th": "table",
         "tr": "table", "option": "select"}
IMPLIED = {"li": ["li"], "dd": ["dd", "dt"], "dt": ["dd", "dt"], "td": ["td", "th"], "th": ["td", "th"],
           "tr": ["td", "th", "tr"], "option": ["option"]}
# fixed values: words in class names and ids of what surrounds an article
SURROUNDINGS = (
    "ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies"
    "|consent|gdpr|notice|notices|newsletter|subscribe|subscription|signup|nav|navbar|navigation|menu|menus|breadcrumb"
    "|breadcrumbs|footer|masthead|sidebar|aside|related|recommended|recommendations|share|sharing|social|comment|comments"
    "|disqus|replies|respond|popup|modal|overlay|toolbar|pagination|pager|widget|widgets|skip|login"
)
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog".split())

TAG = re.compile(
    r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*)((?>[^<>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'<>][^\s<>]*|[="'])*+)>)"""
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>][^\s<>]*)))?""")
SURROUNDING = re.compile(rf"(?:^|[-_])(?:{SURROUNDINGS})(?:[-_]|$)")
NEGATED = re.compile(r"^(?:has|no|with|without|is|hide)[-_]")
INTERESTING = re.compile(r"class|id|role|hidden|style", re.I)


def surrounds(tag: str, attributes: str) -> bool:
    """Does the element hold something else than the article?"""
    if tag in CHROME_TAGS:
        return True
    if not INTERESTING.search(attributes):
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role") in ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    return any(SURROUNDING.search(n) and not NEGATED.match(n) for n in names)


class Scan:
    """blocks: (kind, text) in page order, without empty ones."""

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, int, int]] = []  # tag, open elements around it that surround, that are articles
        self.at: dict[str, list[int]] = {}
        self.surrounding = self.article = 0
        self.run(page)
        self.end_block()

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                kind = CHROME if self.surrounding else CONTENT if self.article else NEUTRAL
                self.blocks.append((kind, text))

    def pop_to(self, depth: int) -> None:
        self.end_block()
        while len(self.open) > depth:
            tag, self.surrounding, self.article = self.open.pop()
            self.at[tag].pop()

    def close(self, tag: str, scope: str) -> None:
        """Closes the innermost open `tag` that no element of the scope hides."""
        places = self.at.get(tag)
        if places:
            floor = max((self.at[s][-1] for s in scope.split() if self.at.get(s)), default=-1)
            if places[-1] > floor:
                self.pop_to(places[-1])

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.end_block()
            if tag in CLOSES_P:
                self.close("p", SCOPE["p"])
            for other in IMPLIED.get(tag, ()):
                self.close(other, SCOPE[other])
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            return
        hides = surrounds(tag, attributes) or (tag == "header" and not self.article)
        if hides:
            self.end_block()
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.surrounding, self.article))
        self.surrounding += hides
        self.article += tag in ("article", "main") or 'itemprop="articleBody"' in attributes

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        places = self.at.get(tag)
        if places:
            if tag in BLOCK:
                self.pop_to(places[-1])
            elif places[-1] == len(self.open) - 1:
                if self.open[-1][1] != self.surrounding:
                    self.end_block()
                name, self.surrounding, self.article = self.open.pop()
                self.at[name].pop()
            elif not any(self.at.get(b) and self.at[b][-1] > places[-1] for b in ("p", "li", "td", "div", "article", "section", "ul", "table")):
                self.pop_inline(places[-1])

    def pop_inline(self, depth: int) -> None:
        if self.open[depth][1] != self.surrounding:
            self.end_block()
        while len(self.open) > depth:
            tag, self.surrounding, self.article = self.open.pop()
            self.at[tag].pop()

    def run(self, page: str) -> None:
        at, lower = 0, None
        while True:
            next_tag = page.find("<", at)
            if next_tag < 0:
                self.parts.append(page[at:])
                return
            if next_tag > at:
                self.parts.append(page[at:next_tag])
            m = TAG.match(page, next_tag)
            if not m:
                self.parts.append("<")
                at = next_tag + 1
                continue
            at = m.end()
            if m[1]:
                stop = page.find("-->", at)
                if stop < 0:
                    return
                at = stop + 3
            elif m[2]:
                stop = page.find(">", at)
                if stop < 0:
                    return
                at = stop + 1
            elif m[3]:
                self.end(m[4].lower())
            else:
                tag = m[4].lower()
                if tag in RAW:
                    if tag in BLOCK:
                        self.end_block()
                    if not m[5].rstrip().endswith("/"):
                        lower = lower or page.lower()
                        if len(lower) != len(page):  # a letter grew: search without case
                            found = re.compile(rf"</{tag}\b", re.I).search(page, at)
                            stop = found.start() if found else -1
                        else:
                            stop = lower.find(f"</{tag}", at)
                        if stop < 0:
                            return
                        stop = page.find(">", stop)
                        if stop < 0:
                            return
                        at = stop + 1
                else:
                    self.start(tag, m[5])


def blocks(page: str) -> list[tuple[int, str]]:
    return Scan(page).blocks
