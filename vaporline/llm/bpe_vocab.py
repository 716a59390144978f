"""Byte-level BPE vocabularies: tables, merge order, and splitting into words.

A vocabulary file is the ``tokenizers`` JSON of a byte-level BPE model without
normaliser, whose pre-tokeniser is the byte-level one with its usual pattern.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import regex

#: The byte-level pre-tokeniser's pattern (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
#: One class of characters throughout: inside such text no pattern boundary lies.
_ONE_CLASS = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
#: Below this code point all Unicode versions in use agree on letters and digits.
_SETTLED = 0x0530
_NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else
    the next code point from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of one vocabulary file, and whether two tokens may stand together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary with the usual pattern")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        symbols = byte_symbols()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {bytes(symbols[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.specials.items()}
        self._merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self._symbols, self._path = symbols, path
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    # Only counting prefixes needs the merges' tables; encoding leaves them unmade.

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.id_of))

    @cached_property
    def rank(self) -> dict[tuple[int, int], int]:
        """The order of merges by the pair of tokens that they join."""
        of = lambda s: self.id_of[bytes(self._symbols[c] for c in s)]
        return {(of(a), of(b)): n for n, (a, b) in enumerate(self._merges)}

    @cached_property
    def parts(self) -> dict[int, tuple[int, int]]:
        """The pair that each token is made of."""
        out = {self.id_of[self.bytes_of[a] + self.bytes_of[b]]: (a, b) for a, b in self.rank}
        if len(out) < len(self.rank):
            raise ValueError(f"{self._path}: a token has two merges")
        return out

    @cached_property
    def wholes(self) -> dict[bytes, int]:
        """The tokens that are the encoding of their own bytes."""
        return {b: i for b, i in self.id_of.items() if self.whole(i)}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (0 left, 1 right) while ``token`` is
        built, from itself down to a byte, each with the rank that ends it."""
        found = self._edges.get((token, side))
        if found is None:
            found, until, at = [], _NEVER, token
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.rank[self.parts[at]], self.parts[at][side]
            self._edges[token, side] = found
        return found

    def _apart(self, left: int, right: int, until: int = _NEVER) -> bool:
        """No merge across the border of two tokens comes before rank ``until``.

        Merges run by rank, ties from the left, so two neighbours merge if their
        rank comes before what ends the left one and not after what ends the right.
        """
        rank = self.rank
        for x, x_end in self._edge(left, 1):
            for y, y_end in self._edge(right, 0):
                r = rank.get((x, y))
                if r is not None and r < x_end and r <= y_end and r < until:
                    return False
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether the two are the encoding of their joined bytes."""
        if len(self.fitting) > 1_000_000:
            self.fitting.clear()
        found = self.fitting[left, right] = self._apart(left, right)
        return found

    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        found = self._whole.get(token)
        if found is None:
            found = True
            if token in self.parts:
                left, right = self.parts[token]
                found = self.whole(left) and self.whole(right) and self._apart(left, right, self.rank[left, right])
            self._whole[token] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens, as the library cuts it."""
        if not text or max(text) < chr(_SETTLED):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary, kept by the worker process."""
    return Vocabulary(path)


def one_class(text: str) -> bool:
    """Whether a text is one run of letters, digits or other marks."""
    return _ONE_CLASS.fullmatch(text) is not None


def words_of(text: str, specials) -> list[list[str]] | None:
    """A text as lines of words if cutting it at each line feed and before each
    space is exact, else None.

    It is where all white space is single spaces and line feeds between other
    characters: a pre-token then never crosses a line feed and begins at each
    space, whatever stands around.
    """
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(s in text for s in specials):
        return None
    if " ".join(text.split()) != text.replace("\n", " "):  # other white space somewhere
        return None
    return [line.split(" ") for line in text.split("\n")]


#: Keys that a ``Bounded`` keeps between the tasks of a worker that says ``rest``.
AT_REST = 50_000


class Bounded(dict):
    """A dict of what ``make(key)`` gives; looked up by ``[]``, a known key costs no
    Python call. When it is full it starts anew and the full one is asked before
    ``make``, until the next is full; so keys that keep coming stay. Long keys are
    made anew each time."""

    def __init__(self, make, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def rest(self) -> None:
        """A task's end: with more than AT_REST keys it starts anew, so that a worker's
        later tasks and stages don't stand beside what this one looked up."""
        if len(self) + len(self.old) > AT_REST:
            self.old = {}
            self.clear()
