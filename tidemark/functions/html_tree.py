"""The tree of one page, for rules that need its structure: read in one pass over the page, whatever is left open in it.

Elements stand in the order of their start tags, so a subtree is a run of elements and of pieces of text, and sums over
subtrees are differences of running sums. Scripts, styles and comments are no text. Everything here takes time in
proportion to the page (selectors: to the page and their own parts).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from html.entities import html5
from itertools import accumulate

REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});")
START = re.compile(r"<(?:!--|/?[a-zA-Z][^\s/>]*|[!?])")
NAME = re.compile(r"[^\s=>/]+")
BARE = re.compile(r"[^\s>]*")
SPACE = re.compile(r"\s*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(("script", "style", "noscript", "iframe"))
#: Start tags that end an element of another name (or the same), if that is the innermost one that is open.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
#: An end tag does not reach beyond an element of a higher rank.
RANKS = {"div": 1, "section": 1, "article": 1, "main": 1, "td": 2, "th": 2, "tr": 3, "tbody": 4, "thead": 4, "table": 5, "head": 6, "body": 6, "html": 7}
NONE: frozenset[str] = frozenset()
ENDED = {tag: frozenset(ENDS.get(tag, ())) | (frozenset(("p",)) if tag in ENDS_P else NONE) for tag in ENDS_P | set(ENDS)}
ON_LINES = frozenset("p div h1 h2 h3 h4 h5 h6 li".split())


def dereferenced(text: str) -> str:
    """text with its character references read: those that a semicolon ends, so that a name cut off stays as it stands."""
    if "&" not in text:
        return text
    return REFERENCE.sub(lambda m: unescape(m[0]) if m[1][0] == "#" else html5.get(f"{m[1]};", m[0]), text)


def without_marks(text: str) -> str:
    """text without what stands between < and >."""
    at = text.find("<")
    if at < 0:
        return text
    parts, done = [], 0
    while at >= 0 and (end := text.find(">", at + 2)) >= 0:
        parts.append(text[done:at])
        done = end + 1
        at = text.find("<", done)
    return "".join(parts) + text[done:]


@dataclass(slots=True)
class Kind:
    """What elements with one tag and the same attributes share; ended: the tags of open ones that it ends; named, ranked: depths of open ones."""

    number: int
    tag: str
    attributes: dict[str, str]
    ended: frozenset[str]
    void: bool
    named: list[int]
    ranked: list[int] | None


class Tree:
    """tags, attributes, parents and ends (the last element below) by element; texts, owners and heads by piece of text.

    A piece is a head if it stands before its owner's first child. kinds: elements of one kind share their tag and attributes.
    """

    def __init__(self, html: str) -> None:
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.heads: list[bool] = []
        self.first_piece: list[int] = []
        self.end_piece: list[int] = []
        self.kinds: list[int] = []
        self._open: list[int] = []
        self._named: dict[str, list[int]] = {}
        self._ranked: dict[int, list[int]] = {}
        self._absent: set[str] = set()
        self._kinds: list[Kind] = []
        self._known: dict[str, Kind] = {}
        self._start(self._kind("", {}))
        self._read(html)
        while self._open:
            self._end()
        self._by_tag: dict[str, list[int]] = {}
        for e, tag in enumerate(self.tags):
            self._by_tag.setdefault(tag, []).append(e)

    def _kind(self, tag: str, attributes: dict[str, str]) -> Kind:
        ranked = self._ranked.setdefault(RANKS[tag], []) if tag in RANKS else None
        kind = Kind(len(self._kinds), tag, attributes, ENDED.get(tag, NONE), tag in VOID, self._named.setdefault(tag, []), ranked)
        self._kinds.append(kind)
        return kind

    def _start(self, kind: Kind) -> None:
        tags, depth = self.tags, len(self._open)
        self.parents.append(self._open[-1] if depth else -1)
        self._open.append(len(tags))
        self.ends.append(len(tags))
        tags.append(kind.tag)
        self.attributes.append(kind.attributes)
        self.kinds.append(kind.number)
        self.first_piece.append(len(self.texts))
        self.end_piece.append(0)
        kind.named.append(depth)
        if kind.ranked is not None:
            kind.ranked.append(depth)

    def _end(self) -> None:
        i = self._open.pop()
        kind = self._kinds[self.kinds[i]]
        kind.named.pop()
        if kind.ranked is not None:
            kind.ranked.pop()
        self.ends[i], self.end_piece[i] = len(self.tags) - 1, len(self.texts)

    def _end_tag(self, tag: str) -> None:
        depths = self._named.get(tag)
        if not depths:
            return
        above = len(self._open) - depths[-1]
        if above > 1:
            rank = RANKS.get(tag, 0)
            if any(d and d[-1] > depths[-1] for r, d in self._ranked.items() if r > rank):
                return
        for _ in range(above):
            self._end()

    def _text(self, raw: str) -> None:
        if raw:
            owner = self._open[-1]
            self.texts.append(dereferenced(raw) if "&" in raw else raw)
            self.owners.append(owner)
            self.heads.append(owner == len(self.tags) - 1)

    def _found(self, html: str, what: str, at: int, pattern: re.Pattern | None = None) -> int:
        """Where what is next, or -1. What is absent once is not searched for again."""
        if what in self._absent:
            return -1
        if pattern:
            hit = pattern.search(html, at)
            place = hit.start() if hit else -1
        else:
            place = html.find(what, at)
        if place < 0:
            self._absent.add(what)
        return place

    def _read(self, html: str) -> None:
        done, opened, tags, find, search = 0, self._open, self.tags, html.find, START.search
        while token := search(html, done):
            begin, end = token.span()
            if begin > done:
                self._text(html[done:begin])
            mark = token.group()
            if mark == "<!--":
                end = self._found(html, "-->", end)
                done = end + 3 if end >= 0 else len(html)
            elif mark in ("<!", "<?"):
                done = find(">", end) + 1 or len(html)
            elif mark[1] == "/":
                done = find(">", end) + 1 or len(html)
                self._end_tag(mark[2:].lower())
            else:
                # a tag that stood on the page before, letter by letter, is not read again
                close = find(">", end) + 1
                kind = self._known.get(html[begin:close]) if close else None
                if kind is None:
                    done, attributes, alone = self._attributes(html, end)
                    if attributes is None:
                        continue
                    tag = mark[1:].lower()
                    if tag in DROPPED:
                        end = self._found(html, f"</{tag}", done, _end_of(tag))
                        if end >= 0 or tag in ("script", "style"):
                            done = self._found(html, ">", end) + 1 or len(html) if end >= 0 else len(html)
                        continue
                    kind = self._kind(tag, attributes)
                    if alone and done == close:
                        self._known[html[begin:close]] = kind
                else:
                    done = close
                while kind.ended and len(opened) > 1 and tags[opened[-1]] in kind.ended:
                    self._end()
                self._start(kind)
                if kind.void:
                    self._end()
        self._text(html[done:])

    def _attributes(self, html: str, at: int) -> tuple[int, dict[str, str] | None, bool]:
        """Where a start tag ends, its attributes (None if the page ends first), and whether what follows it has no part in them."""
        attributes: dict[str, str] = {}
        alone = True
        while True:
            at = SPACE.match(html, at).end()
            if at >= len(html):
                return at, None, False
            if html[at] == ">":
                return at + 1, attributes, alone
            name = NAME.match(html, at)
            if not name:
                at += 1
                continue
            at, value = SPACE.match(html, name.end()).end(), ""
            if html[at : at + 1] == "=":
                at = SPACE.match(html, at + 1).end()
                quote = html[at : at + 1]
                end = -1
                if quote in ("'", '"'):
                    end = self._found(html, quote, at + 1)
                    alone = alone and end >= 0
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = BARE.match(html, at)
                    value, at = bare.group(), bare.end()
            attributes.setdefault(name.group().lower(), dereferenced(value))

    def sums(self, by_piece: list[int]) -> list[int]:
        """The sum over each element's subtree."""
        running = [0, *accumulate(by_piece)]
        return [running[b] - running[a] for a, b in zip(self.first_piece, self.end_piece, strict=True)]

    def select(self, selector: str) -> list[int]:
        """The elements that a selector finds, in order."""
        found: set[int] = set()
        for steps in parsed(selector):
            tags = [tests[0][2] if tests and not tests[0][0] else None for _, tests in steps]
            if any(t is not None and t not in self._by_tag for t in tags):
                continue
            # bit i of a kind: it passes the tests of step i
            fit = [sum(1 << i for i, (_, tests) in enumerate(steps) if _fits(tests, k.tag, k.attributes)) for k in self._kinds]
            fit[0] = 0
            if len(steps) == 1 and tags[0] is not None:
                found.update(e for e in self._by_tag[tags[0]] if fit[self.kinds[e]])
                continue
            children, under = (sum(1 << i for i, (child, _) in enumerate(steps) if i and child == kind) for kind in (True, False))
            last = 1 << (len(steps) - 1)
            here, above = [0], [0]  # bit i: the element (or one above it) ends the first i + 1 steps
            for e in range(1, len(self.tags)):
                own, higher = fit[self.kinds[e]], above[self.parents[e]]
                if own:
                    own &= 1 | (here[self.parents[e]] << 1) & children | (higher << 1) & under
                    if own & last:
                        found.add(e)
                here.append(own)
                above.append(own | higher)
        return sorted(found)

    def below(self, e: int, found: list[int]) -> list[int]:
        """Those of found, which are in order, that lie below e."""
        return found[bisect_right(found, e) : bisect_right(found, self.ends[e])]

    def pieces(self, e: int, without: list[int] | None = None) -> list[str]:
        """The stripped texts below e, but of elements without, that aren't blank."""
        gone: set[int] = set()
        for x in without or ():
            gone.update(range(self.first_piece[x], self.end_piece[x]))
        return [t for i in range(self.first_piece[e], self.end_piece[e]) if i not in gone and (t := self.texts[i].strip())]

    def text(self, e: int, tails: bool) -> str:
        """The text below e; what paragraphs, headings and items begin with starts a line. tails: not only heads."""
        parts, begun = [], {e}
        for i in range(self.first_piece[e], self.end_piece[e]):
            if not (tails or self.heads[i]) or not (piece := self.texts[i].strip()):
                continue
            x, separator = self.owners[i], " " if parts else ""
            while x not in begun:
                begun.add(x)
                separator = "\n" if self.tags[x] in ON_LINES else " "
                x = self.parents[x]
            parts += [separator, piece]
        joined = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(parts)))
        return without_marks(joined).strip()


@lru_cache(maxsize=16)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


COMPOUND = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[\s*[\w-]+\s*(?:[~^$*|]?=\s*(?:"[^"]*"|'[^']*'|[^\]\s"']+)\s*)?\])*)""")
TEST = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s"']+))\s*)?\]""")


@lru_cache(maxsize=4096)
def parsed(selector: str) -> tuple:
    """Alternatives, each of steps (whether a child of the step before, tests). Knows tags, *, classes, ids, attributes, blanks, > and commas.

    Other selectors are a ValueError.
    """
    alternatives, steps, child, at, open_step = [], [], False, 0, True
    text = selector.strip()
    while at < len(text):
        hit = COMPOUND.match(text, at)
        if not hit.group() or not open_step:
            raise ValueError(f"no selector from place {at} on: {selector!r}")
        tests: list[tuple[str, str, str]] = [("", "", hit["tag"].lower())] if hit["tag"] and hit["tag"] != "*" else []
        for sign, name, attribute, how, *value in TEST.findall(hit["rest"]):
            tests.append(("class", "~=", name) if sign == "." else ("id", "=", name) if sign == "#" else (attribute.lower(), how, "".join(value)))
        steps.append((child, tuple(tests)))
        between = re.compile(r"\s*([>,])\s*|\s+").match(text, hit.end())
        at, open_step, child = hit.end(), False, False
        if between:
            at, open_step, child = between.end(), True, between.group(1) == ">"
            if between.group(1) == ",":
                alternatives.append(tuple(steps))
                steps = []
    if not steps or open_step:
        raise ValueError(f"an unfinished selector: {selector!r}")
    return (*alternatives, tuple(steps))


def _fits(tests: tuple[tuple[str, str, str], ...], tag: str, attributes: dict[str, str]) -> bool:
    for name, how, wanted in tests:
        if not name:
            if tag != wanted:
                return False
            continue
        value = attributes.get(name)
        if value is None:
            return False
        if how == "=" and value != wanted or how == "~=" and wanted not in value.split() or how == "|=" and value != wanted and not value.startswith(wanted + "-"):
            return False
        if how in ("*=", "^=", "$=") and (not wanted or not (wanted in value if how == "*=" else value.startswith(wanted) if how == "^=" else value.endswith(wanted))):
            return False
    return True
