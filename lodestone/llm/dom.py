"""A forgiving HTML reader for text extraction: block elements with their texts in page order."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Element names by their part in HTML.
RAW = frozenset("script style textarea title template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = "math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mpadded mphantom mstyle menclose mtable mtr mtd"
INLINE = frozenset((MATH + " a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var").split())
HIDDEN = frozenset("head script style textarea title template iframe xmp noembed noframes button select option optgroup datalist svg map input".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
NONE, PARAGRAPH = frozenset(), frozenset(("p",))
SCOPE = frozenset("article aside body div footer form header html main nav section table td th".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
COMMENT_END = re.compile(r"--!?>")
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>][^\s>]*)))?")
NAMING = frozenset("class id role itemprop aria-label".split())
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


@dataclass
class Block:
    tag: str
    parent: int
    depth: int
    names: list[str]
    texts: list[int] = field(default_factory=list)  # numbers of the page's text runs that are its own
    links: int = 0  # characters of its own texts that lie in links
    marks: int = 0  # inline elements in it


@dataclass
class Page:
    blocks: list[Block]
    runs: list[str]
    owner: list[int]


def attribute_names(raw: str) -> tuple[list[str], bool]:
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif key in NAMING:
            names += [p.lower() for p in NAME_PART.findall(value)]
    return names, hidden


class Tags:
    """Tags and the text between them, in one pass whatever the page: what has been sought in vain is not sought again."""

    def __init__(self, source: str):
        self.source, self.at, self.quotes = source, 0, True

    def end(self, at: int) -> int:
        """The place of the > that ends a tag, -1 if none does; a quoted value may hold that sign, unless quotes turn out not to pair."""
        start = at
        while self.quotes:
            m = STOP.search(self.source, at)
            if m and m[1] is None:
                return m.start()
            close = self.source.find(m[1], m.end()) if m else -1
            if close < 0:
                self.quotes = False
            at = close + 1
        return self.source.find(">", start)

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, element name, is an end tag, attributes); comments, declarations and the page's end have no name."""
        source = self.source
        while self.at < len(source):
            begin = seek = self.at
            found = None
            while (open_ := source.find("<", seek)) >= 0:
                seek = open_ + 1
                if source.startswith("!--", seek):
                    m = COMMENT_END.search(source, seek + 3)
                    found = "", False, "", m.end() if m else len(source)
                elif source[seek : seek + 1] in ("!", "?") or source.startswith("/", seek) and not NAME.match(source, seek + 1):
                    to = source.find(">", seek)
                    found = ("", False, "", to + 1) if to >= 0 else None
                elif m := NAME.match(source, seek + source.startswith("/", seek)):
                    to = self.end(m.end())
                    found = (m[0].lower(), source[seek] == "/", source[m.end() : to], to + 1) if to >= 0 else None
                else:
                    continue
                break
            if found is None:  # no tag can end any more
                self.at = len(source)
                yield source[begin:], "", False, ""
                return
            self.at = found[3]
            yield source[begin:open_], *found[:3]

    def skip(self, name: str) -> None:
        """Past the end tag of an element whose content isn't markup."""
        end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(self.source, self.at)
        self.at = len(self.source) if end is None else (self.source.find(">", end.end()) + 1 or len(self.source))


def read(source: str) -> Page:
    """Blocks (the root first) and text runs; a run is the text between two block edges, white space made single."""
    blocks, runs, owner = [Block("html", -1, 0, [])], [], []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, block, hidden
    opened: Counter[str] = Counter()  # how often each name is in the stack
    parts: list[str] = []
    in_link = links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                block = stack[-1][1]
                blocks[block].texts.append(len(runs))
                blocks[block].links += min(links, len(text))
                runs.append(text)
                owner.append(block)
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)  # a head ends, with or without its end tag, at what cannot be in it
        if text and not stack[-1][2]:
            parts.append(text)
            if in_link:
                links += len(text)

    def push(name: str, block: int, hidden: bool) -> None:
        opened[name] += 1
        stack.append((name, block, hidden))

    def close(to: int) -> None:
        nonlocal in_link
        if any(name not in INLINE for name, _, _ in stack[to:]):
            flush()
        for name, _, _ in stack[to:]:
            opened[name] -= 1
            in_link -= name == "a"
        del stack[to:]

    tags = Tags(source)
    for text, name, ends, raw in tags:
        add(text)
        if not name:
            continue
        if ends:
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE or name not in SCOPE and stack[k][0] in SCOPE and name != "body":
                    break
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        wanted = SAME.get(name, NONE) | (PARAGRAPH if name in ENDS_P else NONE)
        if any(opened[x] for x in wanted):
            limit = LIMITS.get(name, NONE) | SCOPE - SAME.get(name, NONE)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in wanted:
                    close(k)
                    break
                if stack[k][0] in limit:
                    break
        if name in VOID:
            if name not in INLINE:
                add(" ") if name in ("br", "wbr", "img", "input") else flush()
            continue
        names, hidden = attribute_names(raw)
        hidden = hidden or stack[-1][2] or name in HIDDEN
        if name in RAW:
            tags.skip(name)
            continue
        if raw.rstrip().endswith("/") and (name in ("svg", "path") or name in MATH.split()):
            continue
        if name in INLINE:
            blocks[stack[-1][1]].marks += 1
            in_link += name == "a"
            push(name, stack[-1][1], hidden)
            continue
        flush()
        parent = stack[-1][1]
        blocks.append(Block(name, parent, blocks[parent].depth + 1, names))
        push(name, len(blocks) - 1, hidden)
    flush()
    return Page(blocks, runs, owner)
