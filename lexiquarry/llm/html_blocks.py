"""Pages as sequences of leaf blocks, and the blocks as vectors.

A page is read once from front to back. What is above a block is kept as counts that follow the open elements, so time
and memory follow the page's length, however broken or deeply nested it is.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np

#: Elements that begin and end blocks; in the others text runs on. Elements without content.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: of the first two nothing is kept, of the others text.
RAW = frozenset("script style".split())
PLAIN = frozenset("textarea title".split())
#: Elements that a slash before the end of the start tag closes: in others it means nothing.
SELF_CLOSING = frozenset("svg math iframe canvas template noscript script style".split())
FOREIGN = frozenset("svg math".split())
#: Start tags that end an open paragraph, and elements that end others of their kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table body article section div nav aside form".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Za-z]+")
#: Attributes up to this length are kept with their names.
SHORT = 300

ABOVE, PAIRS, WORDS, NUMBERS = 128, 64, 64, 8
#: So many elements above a block are seen apart from those further up.
NEAR = 4
PATHS = 2 * ABOVE + PAIRS
FEATURES = PATHS + WORDS + NUMBERS


@dataclass(slots=True)
class Block:
    #: Hashed names of the elements above the block, of the nearest ones, and of the last three with their parents, as bits.
    above: int
    near: int
    pairs: int
    depth: int
    text: str
    linked: int


def _names(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashes of an element's tag, and of the words of its class, id and role."""
    found = {x for m in NAMES.finditer(attributes) for x in PART.findall(next(filter(None, m.groups()), "").lower())}
    return tuple({crc32(tag.encode()) % ABOVE, *(crc32(f".{x}".encode()) % ABOVE for x in found)})


_short_names = lru_cache(100_000)(_names)


@lru_cache(10_000)
def _pair(parent: str, tag: str) -> int:
    return 1 << crc32(f"{parent}>{tag}".encode()) % PAIRS


class _Reader:
    """Finds tags; a character that wasn't found is never looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ("<", ">", '"', "'")}

    def find(self, c: str, at: int) -> int:
        return self.page.find(c, at) if at <= self.last[c] else -1

    def end_of_tag(self, at: int) -> int:
        """Where the > of a tag is whose name ends at ``at``; one inside a quoted value doesn't count. -1: nowhere."""
        page, k = self.page, at
        while k <= self.last[">"]:
            m = STOP.search(page, k)
            if not m or m[0] == ">":
                return m.start() if m else -1
            k = m.end()
            before = page[max(at, k - 20) : k - 1].rstrip()
            if before.endswith("=") and (close := self.find(m[0], k)) >= 0:
                k = close + 1
        return self.find(">", at)

    def comment_end(self, at: int) -> int:
        """The end of a comment whose <!-- ends at ``at``."""
        page = self.page
        for short in (">", "->"):
            if page.startswith(short, at):
                return at + len(short)
        found = [(k, len(c)) for c in ("-->", "--!>") if (k := page.find(c, at) if at <= self.last[">"] else -1) >= 0]
        if not found:
            return len(page)
        k, n = min(found)
        return k + n


class _Open:
    """The open elements."""

    def __init__(self):
        self.tags: list[str] = []
        self.names: list[tuple[int, ...]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.counts = [0] * ABOVE
        self.above = 0

    def push(self, tag: str, names: tuple[int, ...]) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.names.append(names)
        self.where.setdefault(tag, []).append(k)
        if tag in BLOCK:
            self.blocks.append(k)
        if tag in SCOPE:
            self.scopes.append(k)
        for x in names:
            self.counts[x] += 1
            self.above |= 1 << x

    def cut(self, k: int) -> None:
        """Closes all elements from the k-th on."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.where[tag].pop()
            for x in self.names.pop():
                self.counts[x] -= 1
                if not self.counts[x]:
                    self.above &= ~(1 << x)
        for stack in (self.blocks, self.scopes):
            while stack and stack[-1] >= k:
                stack.pop()

    def last(self, tag: str) -> int:
        found = self.where.get(tag)
        return found[-1] if found else -1

    def near(self) -> int:
        out = 0
        for names in self.names[-NEAR:]:
            for x in names:
                out |= 1 << x
        return out

    def pairs(self) -> int:
        last = self.tags[-3:]
        out = 0
        for x, y in zip(last, last[1:]):
            out |= _pair(x, y)
        return out


def blocks(page: str) -> list[Block]:
    """Blocks with text, in order: white space is one space, character references are decoded.

    Comments, declarations, scripts and styles have no text; everything else that isn't a tag has. A script or style
    without an end, as a comment, goes on to the end of the page, as in browsers; no other element hides what follows.
    """
    out: list[Block] = []
    reader, above = _Reader(page), _Open()
    parts: list[str] = []
    links, at, n = 0, 0, len(page)
    ended: dict[str, int] = {}

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(above.above, above.near(), above.pairs(), len(above.tags), text, links))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        if above.blocks and above.blocks[-1] >= k:
            flush()
        above.cut(k)

    def add(text: str) -> None:
        nonlocal links
        parts.append(text)
        if above.where.get("a"):
            links += len(text)

    while at < n:
        k = reader.find("<", at)
        if k < 0:
            add(page[at:])
            break
        if k > at:
            add(page[at:k])
        if page.startswith("<!--", k):
            at = reader.comment_end(k + 4)
            continue
        if page.startswith(("<!", "<?"), k):
            end = reader.find(">", k)
            at = end + 1 if end >= 0 else n
            continue
        ending = page.startswith("/", k + 1)
        m = NAME.match(page, k + 1 + ending)
        end = reader.end_of_tag(m.end()) if m else -1
        if end < 0:
            add("<")
            at = k + 1
            continue
        tag, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        if ending:
            where = above.last(tag)
            if where >= 0:
                close(where)
            elif tag in BLOCK:
                flush()
            continue
        closed = attributes.endswith("/") and (tag in SELF_CLOSING or above.last("svg") >= 0 or above.last("math") >= 0)
        if tag in RAW or tag in PLAIN:
            if tag in BLOCK:
                flush()
            if closed:
                continue
            if ended.get(tag, 0) < at:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                ended[tag] = found.start() if found else n
            if tag in PLAIN:
                if ended[tag] == n:
                    continue
                above.push(tag, _short_names(tag, ""))
                add(page[at : ended[tag]])
                at = ended[tag]
            elif ended[tag] < n:
                end = reader.find(">", ended[tag])
                at = end + 1 if end >= 0 else n
            else:
                at = n
            continue
        if tag in ENDS_P and above.blocks and above.tags[above.blocks[-1]] == "p":
            close(above.blocks[-1])
        if tag in ENDS:
            where = max(above.last(t) for t in ENDS[tag])
            if where > (above.scopes[-1] if above.scopes else -1):
                close(where)
        if tag in BLOCK:
            flush()
        if tag == "br":
            parts.append(" ")
        elif tag not in VOID and not closed:
            above.push(tag, (_short_names if len(attributes) <= SHORT else _names)(tag, attributes))
    flush()
    return out


def _bits(values: list[int], n: int) -> np.ndarray:
    raw = b"".join(v.to_bytes(n // 8, "little") for v in values)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def features(found: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """Vectors of the blocks of a page from ``start`` to ``end``."""
    mine = found[start:end]
    out = np.zeros((len(mine), FEATURES), np.float32)
    n = len(found)
    if mine:
        out[:, :ABOVE] = _bits([b.above for b in mine], ABOVE)
        out[:, ABOVE : 2 * ABOVE] = _bits([b.near for b in mine], ABOVE)
        out[:, 2 * ABOVE : PATHS] = _bits([b.pairs for b in mine], PAIRS)
    for k, b in enumerate(mine):
        words = b.text.lower().encode().split()
        out[k, PATHS : PATHS + WORDS] = np.bincount([crc32(w) & 63 for w in words], minlength=WORDS) / max(1, len(words))
        size, at = len(b.text), start + k
        out[k, PATHS + WORDS :] = (np.log1p(size) / 5, np.log1p(len(words)) / 3, min(1.0, b.linked / size), b.text[-1] in ".!?", min(b.depth, 50) / 10, at / n, (n - at) / n, 1.0)
    return out
