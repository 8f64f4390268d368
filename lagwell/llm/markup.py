"""Text blocks of raw HTML: a tolerant scanner that keeps, per block, its text, link share, tags and hints around it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of HTML by role, and common class and id words.
RAW = "script|style|noscript|template|textarea|title|iframe"
BREAKING = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul button input label select".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
CLOSES_P = BREAKING - {"label", "button", "input", "select"}
AWAY_TAGS = frozenset("nav aside footer form menu dialog button label fieldset search input head option optgroup".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
AWAY_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar rail ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor "
    "sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments disqus discussion respond reply replies share sharing social "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup login widget widgets copyright toolbar skip".split()
)
#: Of these words, those that also name parts of an article count inside one only where nothing else is named; the last two never.
WEAK_WORDS = frozenset(
    "share sharing related notice notices reply replies respond rail skip widget widgets toolbar alert banner notification login copyright recommended "
    "recommendations masthead header discussion".split()
)
NEVER_INSIDE = frozenset("header discussion".split())
FILLERS = frozenset("box list links link area section block container wrapper wrap buttons button bar posts articles stories items inner outer".split())
HOME_TAGS = frozenset("article main".split())
HOME_WORDS = frozenset("article content post entry story main".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"'<>]*>))*)>|<[!?/][^>]*>|[^<]+|<",
    re.I | re.S,
)
_ATTR = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: float
    tag: str
    parent: int
    away: int  # element number of the innermost region that is no content; 0 for none
    home: int  # element number of the outermost region that is content; 0 for none


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    title: str = ""


def _hints(tag: str, attrs: str, inside_home: bool) -> tuple[bool, bool]:
    """(away, home) of one element."""
    words: set[str] = set()
    role, hidden = "", False
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                for token in value.split():
                    parts = set(_WORD.findall(token))
                    if inside_home and (weak := parts & WEAK_WORDS) and (weak & NEVER_INSIDE or parts - WEAK_WORDS - FILLERS):
                        parts -= weak
                    words |= parts
            elif name == "role":
                role = value
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
                hidden = True
    away = hidden or tag in AWAY_TAGS or role in AWAY_ROLES or bool(words & AWAY_WORDS and tag not in ("body", "html", "article", "main"))
    away |= tag == "header" and not inside_home
    return away, tag in HOME_TAGS or role == "main" or bool(words & HOME_WORDS)


def read(source: str) -> Page:
    page, text, linked, in_link, number = Page(), [], 0, 0, 0
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, number, away, home

    def close_block():
        nonlocal text, linked
        line = " ".join("".join(text).split())
        if line:
            tag, n, away, home = stack[-1]
            parent = stack[-2][1] if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "dt") and len(stack) > 1 else n
            page.blocks.append(Block(line, min(1.0, linked / len(line)), tag, parent, away, home))
        text, linked = [], 0

    outer: list[tuple[int, list[str], int]] = []  # text around open spans that are no content

    def end_spans(down_to: int = 0):
        """Close the blocks of open spans, innermost first, and go on with the text around them."""
        nonlocal text, linked
        while outer and outer[-1][0] >= down_to:
            close_block()
            opened, text, linked = outer.pop()
            text.append(" ")
            del stack[next((i for i, x in enumerate(stack) if x[1] == opened), len(stack)) :]

    for m in _TOKEN.finditer(source):
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                if m["raw"].lower() == "title" and not page.title:
                    page.title = " ".join(html.unescape(re.sub(r"^<[^>]*>|</title\s*>\Z", "", m[0], flags=re.I)).split())
                elif m["raw"].lower() == "textarea":
                    text.append(" ")
            elif m[0][0] != "<" or len(m[0]) == 1:
                piece = html.unescape(m[0]) if "&" in m[0] else m[0]
                text.append(piece)
                if in_link:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m["close"] else 1
            if in_link and (found := re.search(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", m["attrs"], re.I)):
                page.links.append(html.unescape(found[1] or found[2] or found[3] or ""))
        elif tag == "br":
            text.append(" ")
        if tag not in BREAKING and tag != "span":
            continue
        if m["close"]:
            if tag != "span":
                end_spans()
                close_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag == "span" and outer and outer[-1][0] == stack[i][1]:
                        end_spans(stack[i][1])
                    del stack[i:]
                    break
                if tag == "span" and stack[i][0] != "p":
                    break  # no span is open in this element
            continue
        away, home = _hints(tag, m["attrs"], stack[-1][3] > 0)
        if tag == "span":
            number += 1
            stack.append((tag, number, number if away else stack[-1][2], stack[-1][3]))
            if away and not stack[-2][2]:
                # a span that is no content is a block of its own; the text around it stays one block
                outer.append((number, text, linked))
                text, linked = [], 0
            continue
        end_spans()
        close_block()
        if tag in CLOSES_P and stack[-1][0] == "p":
            stack.pop()
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack[-1][0] == tag:
            stack.pop()
        number += 1
        if tag not in VOID:
            stack.append((tag, number, number if away else stack[-1][2], stack[-1][3] or (number if home else 0)))
    end_spans()
    close_block()
    return page
