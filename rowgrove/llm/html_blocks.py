"""HTML pages as sequences of leaf blocks with tag paths, and the features of a block.

A block is the text between two block-level tags. Inline tags don't end one, ``<br>`` is white space, character references are
decoded, white space becomes one space. The head, scripts, styles, templates, drawings and comments hold no blocks. Unclosed and
crossed tags are tolerated: an end tag without its start is ignored, and a start tag closes what it implies. Of an unclosed element
that would hold no blocks only the tag is skipped (a script or style reaches to the end).

Work and memory go with the page's length, however it is nested: the open elements form a tree of shared nodes, each with what it adds to the one above
(the path's features are a bit mask), and end tags that nothing open answers to are passed over at once.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

# Element names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br object canvas math mi mn mo ms mtext mspace mrow mfrac"
    " msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe title select".split())
#: Raw elements that may hold their own kind; raw elements that reach to the page's end where they aren't closed.
NESTING, ENDLESS = frozenset("noscript template svg select".split()), frozenset("script style".split())
#: Start tags that end an open element of the same or a listed kind, up to the enclosing list or table.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table body article section div main aside nav header footer form".split())

#: Quoted values and tags of more than 10,000 characters end at the next ``>``.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,10000}\"|'[^']{0,10000}'){0,10000}+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"[^\W_]+")
DIGIT = re.compile(r"\d")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

PATH_BUCKETS, WORD_BUCKETS, FIGURES = 1024, 1024, 14
#: Characters beyond which a block is no longer any longer to the labeller (its text is still taken whole).
LONG = 3_000


class Node:
    """An open element with those above it. Equal paths of one page share a node."""

    __slots__ = ("bits", "children", "depth", "flags", "kept", "parent", "tag")

    #: What an element or one above it is.
    P, LI, HEADING, LINK = 1, 2, 4, 8

    def __init__(self, parent: Node | None, tag: str, names: str):
        self.parent, self.tag, self.children = parent, tag, {}
        if parent is None:
            self.depth, self.flags, self.bits, self.kept = 0, 0, 0, ()
            return
        flag = Node.P if tag == "p" else Node.LI if tag == "li" else Node.LINK if tag == "a" else Node.HEADING if tag in HEADINGS else 0
        self.depth, self.flags = parent.depth + 1, parent.flags | flag
        self.bits = parent.bits | _bit(f"t {tag}")
        for x in names.split():
            if not x.isdigit():
                self.bits |= _bit(f"n {x}")
        self.kept = parent.kept if tag in INLINE else (*parent.kept[-1:], tag)

    def child(self, tag: str, names: str) -> Node:
        got = self.children.get((tag, names))
        if got is None:
            got = self.children[tag, names] = Node(self, tag, names)
        return got

    @property
    def mask(self) -> int:
        """Buckets of the path as bits: of its tags and names, of the last tag and of the last two."""
        last = self.kept[-1:] or ("",)
        return self.bits | _bit("last " + last[-1]) | _bit("two " + " ".join(self.kept or last))


@dataclass
class Block:
    text: str
    node: Node
    link_chars: int


@functools.lru_cache(maxsize=20_000)
def _bit(token: str) -> int:
    return 1 << zlib.crc32(token.encode("utf-8", "replace")) % PATH_BUCKETS


def _names(attributes: str) -> str:
    """Parts of the class, id and role names of a tag, and whether it is hidden."""
    out = []
    for key, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "style":
            out += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            out.append("hidden")
        elif key in ("class", "id", "role", "itemprop"):
            out += [x.lower() for x in NAME_PART.findall(value)]
    return " ".join(dict.fromkeys(out))


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the content of each element of this name ends, by where it begins; those without an end tag of their own aren't in it."""
    out, begun = {}, []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", page, re.I):
        if not m[1]:
            if not (name == "svg" and m[2].endswith("/>")):
                begun.append(m.end())
        elif begun:
            out[begun.pop()] = m.end()
    return out


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, none of them empty."""
    out: list[Block] = []
    top = root = Node(None, "", "")
    open_: Counter[str] = Counter()
    parts: list[str] = []
    held = {"links": 0, "node": root, "text": False}

    def flush() -> None:
        if held["text"]:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, held["node"], held["links"]))
        parts.clear()
        held["links"], held["text"] = 0, False

    def say(text: str) -> None:
        if not text:
            return
        if not held["text"] and not text.isspace():
            held["node"], held["text"] = top, True
        parts.append(text)
        if top.flags & Node.LINK:
            held["links"] += len(text)

    def pop_to(node: Node) -> Node:
        """Close open elements up to and with ``node``."""
        at = top
        while True:
            open_[at.tag] -= 1
            if at is node:
                return node.parent
            at = at.parent

    ends: dict[str, dict[int, int]] = {}
    open_ended: set[str] = set()
    at = 0
    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in INLINE:
                flush()
            node = top if open_[name] > 0 else root
            while node is not root:
                if node.tag == name:
                    top = pop_to(node)
                    break
                if name in INLINE and node.tag not in INLINE:
                    break
                node = node.parent
            continue
        if name in RAW or name == "head":
            if name not in INLINE:
                flush()
            if name == "svg" and m[3].endswith("/>"):
                continue
            if name in NESTING:
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = ends[name].get(at, at)
            elif name not in open_ended:
                end = re.compile(rf"</{re.escape(name)}\s*>" if name != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                if not end:
                    open_ended.add(name)
                at = end.end() if end else len(page) if name in ENDLESS else at
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            while top is not root and top.tag in INLINE:
                top = pop_to(top)
            if top.tag == "p":
                top = pop_to(top)
            if (shut := CLOSES.get(name)) and any(open_[x] > 0 for x in shut):
                node = top
                while node is not root and node.tag not in LIMITS:
                    if node.tag in shut:
                        top = pop_to(node)
                        break
                    node = node.parent
        if name not in VOID and not m[3].endswith("/>"):
            top = top.child(name, _names(m[3]) if "=" in m[3] or "hidden" in m[3] else "")
            open_[name] += 1
    say(page[at:])
    flush()
    return out


class _WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        bucket = self[word] = PATH_BUCKETS + zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS
        return bucket


class Features:
    """Sparse buckets and figures of blocks; remembers paths it has seen (bounded)."""

    def __init__(self, remembered: int = 50_000):
        self.paths: dict[int, list[int]] = {}
        self.words = _WordBuckets()
        self.remembered = remembered

    def path_buckets(self, mask: int) -> list[int]:
        got = self.paths.get(mask)
        if got is None:
            if len(self.paths) > self.remembered:
                self.paths.clear()
            raw = np.frombuffer(mask.to_bytes(PATH_BUCKETS // 8, "little"), np.uint8)
            got = self.paths[mask] = np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()
        return got

    def word_buckets(self, text: str) -> list[int]:
        if len(self.words) > 4 * self.remembered:
            self.words.clear()
        return sorted(set(map(self.words.__getitem__, set(WORD.findall(text.lower())))))

    def of(self, blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """(path buckets, word buckets, figures) of a page's blocks."""
        n = len(blocks)
        figures = np.zeros((n, FIGURES), np.float32)
        paths, words = [], []
        for i, b in enumerate(blocks):
            text, size = b.text, len(b.text)
            paths.append(self.path_buckets(b.node.mask))
            words.append(self.word_buckets(text))
            flags = b.node.flags
            count = text.count(" ") + 1
            signs = sum(map(text.count, ".,!?;:"))
            figures[i] = (
                np.log1p(min(size, LONG)) / 6, np.log1p(min(count, LONG / 6)) / 5, min(1.0, b.link_chars / size), min(1.0, 8 * signs / size), text[-1] in ".!?…", text[:1].isupper(),
                bool(DIGIT.search(text)), bool(flags & Node.P), bool(flags & Node.LI), bool(flags & Node.HEADING), min(b.node.depth, 40) / 10,
                i / n, (n - i) / n, text[:1] in "©" or "©" in text,
            )
        return paths, words, figures
