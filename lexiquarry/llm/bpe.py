"""BPE encoding and decoding by an automaton compiled from the merges, one merge gadget after the other.

The automaton reads tokens. It starts with one state and an arc back to it for each byte. The gadget of the merge
(u, v) -> w takes the state p to which the u arcs lead and, if p has a v arc, to r:

*   p gets a copy without the v arc, and the u arcs now lead to the copy;
*   each state with a u arc gets a w arc to r.

After all merges the sequences of arcs from the start state are exactly the token sequences that BPE makes (compare
Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA", 2024). All arcs of a token lead to one
state, so a state is named by the token that leads to it. Copies share what they have in common: a state keeps only
the arcs it has lost and the merge at which it lost them, and r is the state of v as it was at its merge. An arc is
looked up by walking these versions.

Composed with the bytes of the tokens, the automaton becomes a transducer over bytes. After n bytes of a word its state
says, for each place within reach, which token the encoding of the bytes up to there ends with, and which tokens may be
under way since (the arcs of that token's state, along a tree of the tokens' bytes). Each state has one output, the last
token of the encoding of all bytes read; there is exactly one, as BPE encodes every byte string in one way. States and
transitions are made when they are first needed and kept in a table, so a byte costs one look-up. The outputs, read
back from the end of the word by the lengths of the tokens, are its encoding. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import beside

#: How byte-level vocabularies write bytes as characters; printable Latin-1 characters stand for themselves.
_SELF = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
BYTE_OF = {chr(b): b for b in _SELF} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_SELF))}
#: Fixed value: how byte-level tokenizers split texts into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Characters that the tokenizers library's Unicode tables don't know yet as letters or numbers, but regex's do.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_NEW = regex.compile(f"[{NEWER}]")
_OLD_WORDS = regex.compile(WORDS.pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[{NEWER}]|[^\p{{White_Space}}\p{{L}}\p{{N}}])").replace(r" ?\p{L}+", rf" ?(?:(?![{NEWER}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{NEWER}])\p{{N}})+"))
#: Words kept with their codes by a worker; when there are more, it starts anew.
KEPT_WORDS = 300_000
#: States of the byte table that a worker keeps; with more, it starts the table anew.
KEPT_STATES = 250_000
_NEVER = 1 << 62
#: Keys of a state that are no bytes.
LAST, INSIDE = -1, -2


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def split_words(text: str) -> list[str]:
    return (WORDS if _is_latin(text) or not _NEW.search(text) else _OLD_WORDS).findall(text)


class Automaton:
    """Deterministic over tokens, and over bytes; see the module. ``merges``: pairs of ids in order, with what they make."""

    def __init__(self, base: dict[bytes, int], merges: list[tuple[int, int, int]], labels: dict[int, bytes]):
        self.label = labels
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = dict.fromkeys(base.values(), 0)
        self.lost: dict[int, dict[int, int]] = {t: {} for t in base.values()}
        for time, (u, v, w) in enumerate(merges, 1):
            if w in self.made:
                raise ValueError(f"two merges make token {w}")
            if u in self.made and v in self.made and self._arc(u, v, time - 1):
                self.left[w], self.right[w], self.made[w], self.lost[w] = u, v, time, {}
                self.lost[u][v] = time
        self.next: dict[int, int] = {}
        self.token: list[int] = [-1]
        for t in self.made:
            node = 0
            for b in labels[t]:
                node = self.next.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = t
        self.more = [False] * len(self.token)
        for key in self.next:
            self.more[key >> 8] = True
        self.length = {t: len(labels[t]) for t in self.made}
        self._start()

    def _when_lost(self, state: int, t: int, time: int) -> int:
        """The merge up to ``time`` at which the state of a token, or one that it is a copy of, lost its t arc."""
        while True:
            when = self.lost[state].get(t, _NEVER)
            if when <= time:
                return when
            if state not in self.right:
                return _NEVER
            time = min(time, self.made[state] - 1)
            state = self.right[state]

    def _arc(self, state: int, t: int, time: int) -> bool:
        """Whether the state of a token has a t arc after the merge ``time``."""
        while self._when_lost(state, t, time) == _NEVER:
            if t not in self.left:
                return True
            time = min(time, self.made[t])
            t = self.left[t]
        return False

    def _start(self) -> None:
        """An empty table: the state before the first byte, after no token."""
        self.known: dict[tuple, dict] = {}
        self.arcs: dict[int, bool] = {}
        self.first = self._state((0,), -1)

    def _state(self, inside: tuple, last: int) -> dict:
        """A row of the table: the next row by byte; its output and what may be under way, under keys that are no bytes."""
        found = self.known.get(inside)
        if found is None:
            found = self.known[inside] = {LAST: last, INSIDE: inside}
        return found

    def _move(self, state: dict, byte: int) -> dict:
        """The state after a byte: (token before + 1, place in the tree of tokens) for each token that may be under way."""
        inside, last = [], -1
        follow, token, arcs = self.next.get, self.token, self.arcs
        for pending in state[INSIDE]:
            node = follow((pending & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            before, t = pending >> 32, token[node]
            if t >= 0:
                ok = arcs.get(before << 32 | t)
                if ok is None:
                    ok = arcs[before << 32 | t] = not before or self._arc(before - 1, t, _NEVER - 1)
                if ok:
                    last = t
            if self.more[node]:
                inside.append(before << 32 | node)
        if last < 0:
            raise ValueError(f"no token ends with the byte {byte}")
        inside.append(last + 1 << 32)
        state[byte] = found = self._state(tuple(inside), last)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word."""
        if len(self.known) > KEPT_STATES:
            self._start()
        state, states = self.first, []
        add, move = states.append, self._move
        for byte in word:
            state = state.get(byte) or move(state, byte)
            add(state)
        out, at, length = [], len(word), self.length
        while at:
            t = states[at - 1][LAST]
            out.append(t)
            at -= length[t]
        out.reverse()
        return out


class Tokenizer:
    """Encodes texts as the ids of a byte-level BPE file, and decodes them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that depend on what is around them aren't supported")
        vocab = model["vocab"]
        labels = {i: bytes(BYTE_OF[c] for c in t) for t, i in vocab.items() if all(c in BYTE_OF for c in t)}
        base = {b: i for i, b in labels.items() if len(b) == 1}
        if len(base) < 256:
            raise ValueError(f"{path}: {256 - len(base)} bytes have no token")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.automaton = Automaton(base, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], labels)
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        known = labels | {i: t.encode() for t, i in special.items()}
        self.label = [known.get(i, b"") for i in range(max(known) + 1)]
        self.special = special
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)))
        self.words = _Words(self.automaton)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        code = self.words.__getitem__
        if not any(t in text for t in self.special):
            return b"".join(map(code, split_words(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*map(code, split_words(text[at : m.start()])), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, *map(code, split_words(text[at:]))])

    def text(self, ids: bytes) -> str:
        """Emits the arcs' labels."""
        return b"".join(map(self.label.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = array("I", self.automaton.encode(word.encode())).tobytes()
        if len(word) < 100:
            self[word] = out
        return out


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    """Compiled once in each worker."""
    return Tokenizer(path)


def bpe(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes each whole text with the byte-level BPE file at ``path`` (on every machine), and decodes it again.

    Returns row (the input's columns), ids (binary, little-endian unsigned 32-bit integers), n_tokens and decoded.
    Special tokens' strings inside a text become their ids. Null or empty text: no ids, an empty text. Row by row, so
    repeated rows, repeated or null ids and extra columns need no rule; an empty table gives no rows.
    """

    tokenizer(path)  # a file that can't be used fails here and not in the tasks

    def func(values: list[str]) -> dict[str, pa.Array]:
        t = tokenizer(path)
        ids = [t.ids(v) for v in values]
        return {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "decoded": pa.array([t.text(i) for i in ids], pa.string())}

    return beside(docs, func, "ids binary, n_tokens long, decoded string", text)
