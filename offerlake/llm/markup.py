"""HTML to text lines: blocks of text with the zone they stand in."""

from __future__ import annotations

import html
import re

ARTICLE, OPEN, REMOVED = 0, 1, 2
NAMED, AGAIN = 3, 4  # while reading: under a mere name, and in an article below one

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title|object|math)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:/>|>.*?(?:</\1\s*[^>]*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.S | re.I)
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that never hold article text.
OUTSIDE = frozenset("nav footer aside form header head button select dialog menu".split())
# Words of class, id and role names that mark menus, notices, adverts, forms and comments.
NAMES = frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo "
    "cookie cookies consent disqus discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "popup promo promoted promotion recommended related respond reply replies search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget").split())
# Those that mark it inside an article too.
SURE = frozenset("ad ads advert adverts advertisement advertising comment comments disqus newsletter share sharing sponsored".split())
STATES = frozenset("has is no not with without".split())  # "with-sidebar" says what stands beside it
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)", re.I)
PART = re.compile(r"[a-z]+")


def _marked(attributes: str) -> tuple[bool, bool, bool]:
    """Whether the names may say boilerplate, whether they surely do, and whether they say main text.

    A class or id counts by its first and its last part, surely by its first only.
    """
    bad = sure = main = False
    for kind, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if kind.lower() == "role":
            main |= value == "main"
            sure |= not NAMES.isdisjoint(PART.findall(value))
            continue
        for parts in map(PART.findall, value.split()):
            if parts and parts[0] not in STATES:
                bad |= parts[0] in NAMES or parts[-1] in NAMES
                sure |= parts[0] in SURE
    return bad or sure, sure, main


def lines(page: str) -> list[tuple[int, str]]:
    """(zone, text) of every non-empty block in page order.

    ARTICLE: inside <article>, <main> or role=main; REMOVED: in an element or
    under a name that marks boilerplate; OPEN: anything else. A <header> inside
    the article is part of it, and only a SURE name removes there. An article
    below a mere name is one if the page has no other. Elements left open end
    with their parent.
    """
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # (tag, zone) of open block elements
    zone, at = OPEN, 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((zone, text))
        parts.clear()

    for m in TOKEN.finditer(page):
        parts.append(page[at: m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            if m.group(0)[:9].upper() == "<![CDATA[":
                parts.append(html.escape(m.group(0)[9:].removesuffix("]]>")))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS and tag not in OUTSIDE and not m.group(4).strip():
            continue
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS:
                        close()
                    zone = stack[i][1]
                    del stack[i:]
                    break
            else:
                if tag in BLOCKS:
                    close()
            continue
        if tag in BLOCKS:
            close()
        if tag in VOID or m.group(4).rstrip().endswith("/"):
            continue
        if tag == "p" and stack and stack[-1][0] == "p":  # a paragraph ends the one before
            zone = stack.pop()[1]
        bad, sure, main = _marked(m.group(4))
        before = zone
        inside = zone in (ARTICLE, AGAIN)
        if zone != REMOVED:
            if tag in ("article", "main") or main:
                zone = REMOVED if sure and tag == "div" else AGAIN if zone in (NAMED, AGAIN) else ARTICLE
            elif (tag in OUTSIDE and not (tag == "header" and inside)) or ((sure if inside else bad) and tag not in ("html", "body")):
                if tag not in BLOCKS:
                    close()
                zone = REMOVED if sure or tag in OUTSIDE else NAMED
        stack.append((tag, before))
    parts.append(page[at:])
    close()
    again = REMOVED if any(z == ARTICLE for z, _ in out) else ARTICLE
    return [({NAMED: REMOVED, AGAIN: again}.get(z, z), t) for z, t in out]
