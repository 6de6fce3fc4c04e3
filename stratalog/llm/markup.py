"""A tolerant reader of HTML pages: text blocks with their containers."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Fixed values of HTML: elements inside a line, void elements, elements whose content is not text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
#: Containers that never hold an article's text, and words of class, id or role that say the same. These words and
#: forms are weaker: they do not count on wrappers of the page, nor words on a paragraph within an article.
BOILER_TAGS = frozenset("head nav header footer aside script style noscript template svg button select option dialog iframe object canvas menu".split())
BOILER_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo related share sidebar social sponsor sponsored subscribe toolbar widget".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?"
    rf"|<(?P<raw>{RAW})\b[^>]*>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*>?)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORD = re.compile(r"[a-z]+")
_DIGITS, _NUMBER = re.compile(r"[0-9]+"), re.compile(r"[0-9]{3,}")
#: Elements that no word makes boilerplate, and the starts of an article.
NEVER, HEADS = frozenset("html body article main".split()), frozenset("article main h1".split())
#: What Block.boiler says: text, within a container marked by a word or a form, within an element of BOILER_TAGS.
CLEAN, WEAK, STRONG = 0, 1, 2
#: Containers above one another that have a path of their own; deeper ones share that of the last.
MOST_DEEP = 100


class Block(NamedTuple):
    path: str
    boiler: int
    text: str


class Page(NamedTuple):
    blocks: list[Block]
    opens: list[tuple[str, int]]
    links: list[str]
    title: str


def boiler_name(names: str) -> bool:
    """Whether one of the names (of class, id and role) consists of words for boilerplate only: "ad", "cookie-banner" and
    "nav2" do, "has-sidebar" and "article-header" do not."""
    return any((w := _WORD.findall(name)) and BOILER_WORDS.issuperset(w) for name in names.lower().split())


def read_page(source: str) -> Page:
    """Blocks in page order. A block ends at every element that is not inline; white space in it is one space. A
    container's path is its open elements with their first class or id, numbers as #; unclosed p, li and the like end where the
    next one begins, unclosed inline elements end with their block, and end tags without a start are ignored. opens has
    the containers in page order, each with the number of blocks before it. Time and memory are linear in the page, however it nests.

    A weak mark does not count on a container that holds more than half of the page's text and the start of its
    article (if the page has one: the first article, main or h1)."""
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []
    found: list[tuple[str, bool, tuple[int, ...], str]] = []
    marked = 0
    start: tuple[int, ...] | None = None
    opens: list[tuple[str, int]] = []
    links: list[str] = []
    text: list[str] = []
    title = ""
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                found.append((*(stack[-1][1:] if stack else ("", False, ())), line))

    for m in _TOKEN.finditer(source):
        if (t := m["text"]) is not None:
            text.append(t)
            continue
        if m["raw"]:
            if m["raw"].lower() == "title":
                title = title or " ".join(html.unescape(m["body"]).split())
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a" and not m["end"]:
                links += [html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m["attrs"] or "") if k.lower() == "href"]
            continue
        flush()
        if tag in VOID:
            continue
        if m["end"]:
            if open_tags[tag]:
                while (last := stack.pop()[0]) != tag:
                    open_tags[last] -= 1
                open_tags[tag] -= 1
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            open_tags[stack.pop()[0]] -= 1
        names = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m["attrs"] or "")}
        classes = names.get("class", "").split()
        label = _NUMBER.sub("#", classes[0]) if classes else _DIGITS.sub("#", names.get("id", ""))
        above = stack[-1] if stack else ("", "", False, ())
        strong = above[2] or (tag in BOILER_TAGS and not (tag == "header" and "/article" in above[1]))
        marks = above[3]
        if tag not in NEVER and not (tag == "p" and ("/article" in above[1] or "/main" in above[1])):
            if len(marks) < MOST_DEEP and (tag == "form" or names and boiler_name(f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}")):
                marks = (*marks, marked)
                marked += 1
        named = tag != "p" and len(stack) < MOST_DEEP
        path = f"{above[1]}/{tag}{'.' + label if label else ''}" if named else above[1]
        stack.append((tag, path, strong, marks))
        open_tags[tag] += 1
        if start is None and tag in HEADS:
            start = marks
        if named:
            opens.append((path, len(found)))
    flush()
    if marked:
        size = [0] * marked
        for _, _, marks, line in found:
            for i in marks:
                size[i] += len(line)
        whole = sum(len(x[3]) for x in found)
        wrappers = {i for i in range(marked) if 2 * size[i] > whole and (start is None or i in start)}
        found = [(path, strong, tuple(i for i in marks if i not in wrappers), line) for path, strong, marks, line in found]
    blocks = [Block(path, STRONG if strong else WEAK if marks else CLEAN, line) for path, strong, marks, line in found]
    return Page(blocks, opens, links, title)
