"""Exact token counts at every prefix of a text, by dynamic programming.

In byte-level BPE the encoding of a prefix is the encoding of a shorter prefix and
one more token, and that token is the only one, among the vocabulary's tokens that
end there, that fits behind the shorter prefix's last one. So one pass over a
pre-token gives the last token and the count at each of its prefixes, and from
these the count at every prefix of the text: truncation (the longest prefix within
a budget) and budgets are answered without encoding anything again.

A prefix counts as the text that it is: where it ends within white space, within a
contraction or within a special token's string, that is not cut as in the longer
text, and the counts respect this.

Defined results: a null text counts as empty (0 tokens); repeated rows give
repeated results; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporline.llm.bpe_vocab import Bounded, default_vocabulary, vocabulary, words_of
from vaporline.llm.common import ready, text_of


_SPACES = regex.compile(r"\s{2,}")


class PrefixCounter:
    """Prefix counts under one vocabulary; one for each worker process."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        # Of a word at a line's start and of a word behind a space: the counts at all its
        # prefixes, in as few bytes as they need, the last one being its total.
        self.bare = Bounded(lambda word: stored(self.cut(word)))
        self.spaced = Bounded(lambda word: stored(self.cut(" " + word)), most=500_000)

    def token_ends(self, piece: bytes) -> list[int]:
        """The count at every byte prefix of one pre-token, from 0 on."""
        v, count, last = self.vocab, [0], [-1]
        id_of, known, fits, longest = v.wholes.get, v.fitting.get, v.fits, v.longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = id_of(piece[start:end])
                if token is not None:
                    if start:
                        fit = known((last[start], token))
                        if fit is None:
                            fit = fits(last[start], token)
                        if not fit:
                            continue
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count

    def pre_token(self, piece: str) -> list[int]:
        """The count at every character prefix of one pre-token, from 0 on."""
        raw = piece.encode()
        at = self.token_ends(raw)
        if len(raw) != len(piece):
            at = [n for i, n in enumerate(at) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        if piece in ("'re", "'ve", "'ll"):  # cut short they are a mark and a letter
            at[2] = 2
        return at

    def cut(self, text: str) -> list[int]:
        """The count at every character prefix of a text without special tokens."""
        out, base = [0], 0
        for piece in self.vocab.split(text):
            at = self.pre_token(piece)
            out += [base + n for n in at[1:]] if base else at[1:]
            base += at[-1]
        if len(text) > len("".join(text.split())) + 1:  # a prefix that ends in a run of white space has it as one pre-token
            for run in _SPACES.finditer(text):
                a, b = run.span()
                out[a : b + 1] = [out[a] + n for n in self.pre_token(text[a:b])]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The count at every character prefix of any text, from 0 to its length."""
        specials = sorted(self.vocab.specials, key=len, reverse=True)
        if not any(s in text for s in specials):
            return np.array(self.cut(text))
        out, base = [np.zeros(1, np.int64)], 0
        for part in re.split("(" + "|".join(map(re.escape, specials)) + ")", text):
            if part in self.vocab.specials:  # short of its end it is ordinary text
                inside = np.array(self.cut(before + part[:-1])[len(before) + 1 :]) + base - own
                out += [inside, np.array([base + 1])]
                base += 1
            else:
                before, counts = part, np.array(self.cut(part))
                own = int(counts[-1])
                out.append(counts[1:] + base)
                base += own
        return np.concatenate(out)

    def count(self, text: str, budget: int | None = None) -> tuple[int, int]:
        """The tokens of a text, and how many characters its longest prefix has
        whose tokens don't exceed the budget (no budget: the whole text).

        Both are read from the counts stored at each word's prefixes: their last ones
        add up to the count before each word, and within the word on the border the
        stored ones say how much of it still fits. Nothing is encoded again."""
        lines = words_of(text, self.vocab.specials)
        if lines is None:
            at = self.prefixes(text)
            return int(at[-1]), len(text) if budget is None else int(np.flatnonzero(at <= budget)[-1])
        bare, spaced = self.bare, self.spaced.__getitem__
        each = [counts for line in lines for counts in (bare[line[0]], *map(spaced, line[1:]))]
        total = len(lines) - 1 + sum(map(LAST, each))
        if budget is None or total <= budget:
            return total, len(text)
        # No prefix within a word fits if what stands before the word fills the budget.
        base = start = 0
        each = iter(each)
        for n, line in enumerate(lines):
            for i in range(len(line)):
                counts, feed = next(each), int(not i and n > 0)  # a line feed is a token of its own
                if base + feed + counts[-1] >= budget:
                    fit = [k for k, c in enumerate(counts) if base + feed + c <= budget]
                    return total, start + feed + fit[-1] if fit else start
                base, start = base + feed + counts[-1], start + feed + len(counts) - 1
        raise AssertionError("the words' tokens don't sum to the text's")


def stored(counts: list[int]) -> bytes | array:
    """Prefix counts, a byte each if they fit."""
    return bytes(counts) if max(counts) < 256 else array("I", counts)


LAST = itemgetter(-1)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, *, budget: int = 512, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens
    over the budget) and fit_chars, the length in characters of the longest prefix
    within the budget. A map over partitions: no shuffle."""
    ready(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            found = [count(text.as_py(), budget) for text in batch.column(2)]
            n = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array([x[0] > budget for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table: doc_id and counts, an array whose element i (from 0) is the
    token count of the first i characters. Written once, it answers any budget
    (``within``) or cut (``counts[i]``) in the JVM. Four bytes a character before
    compression."""
    ready(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path).prefixes
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                counts = pa.array([prefixes(text.as_py()).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], counts], ["doc_id", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def within(counts: str, budget: int) -> Column:
    """Characters of the longest prefix within a budget, from a stored table."""
    return F.size(counts) - 1 - F.coalesce(F.array_position(F.transform(F.reverse(counts), lambda c: c <= budget), True) - 1, F.lit(0))
