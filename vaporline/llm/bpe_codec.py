"""BPE encoding and decoding, long text by tree concatenation.

A text is halved until its parts are short, the parts are encoded on their own,
and the halves are put together up the tree: at each join a window around it is
encoded again and grown until both sides agree with it exactly. What stands
outside the window is kept as it was.

A window agrees if at either end it has the very token that the half has there and
that end is one of these:

* the end of the halves themselves;
* a place before a space that another kind of character follows: a pre-token
  begins there whatever stands around it;
* within one run of letters, digits or marks that the window doesn't leave: there
  the whole run is one pre-token, and a token sequence is its encoding if any two
  neighbours are. Neighbours outside the window are so from the halves, those in
  the window from the window, and at its ends because the tokens are the same. No
  such end may lie within a special token's string, which isn't cut like other text.

Defined results: a null text counts as empty (no ids); special tokens' strings in
a text become those tokens (the library's default); repeated rows give repeated
results; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporline.llm.bpe_vocab import Bounded, default_vocabulary, one_class, vocabulary, words_of
from vaporline.llm.common import free_memory, fresh, ready, text_of

#: Texts of more bytes than this are halved.
LEAF_BYTES = 4096
#: Tokens of a side in a join's first window; it doubles.
FIRST_WINDOW = 8


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Codec:
    """Encoding and decoding under one vocabulary; one for each worker process."""

    def __init__(self, path: str, leaf_bytes: int = LEAF_BYTES, first_window: int = FIRST_WINDOW):
        self.vocab = vocabulary(path)
        self.leaf_bytes, self.first_window = leaf_bytes, first_window
        self.special_bytes = [s.encode() for s in self.vocab.specials]
        self.joinable = not any(c.isspace() for s in self.vocab.specials for c in s)
        self.windows = 0
        # Of a word at a line's start and of a word behind a space: its ids.
        self.bare = Bounded(lambda word: self.plain(word))
        self.spaced = Bounded(lambda word: self.plain(" " + word))
        self.feed = self.plain("\n")
        self.lengths = np.zeros(max(self.vocab.bytes_of) + 1, np.int64)
        for i, b in self.vocab.bytes_of.items():
            self.lengths[i] = len(b)

    def rest(self) -> None:
        """A task's end, where the worker's memory is for other stages, too."""
        self.bare.rest()
        self.spaced.rest()
        free_memory()

    def plain(self, text: str) -> bytes:
        """The library's ids, packed."""
        return packed(self.vocab.tokenizer.encode(text, add_special_tokens=False).ids) if text else b""

    def leaf(self, text: str) -> bytes:
        """The ids of a short text: word by word where that is exact."""
        spaced_start = text[:1] == " "
        lines = words_of(text[1:] if spaced_start else text, self.vocab.specials)
        if lines is None:
            return self.plain(text)
        bare, spaced = self.bare, self.spaced.__getitem__
        if spaced_start:
            first, *lines = lines
            return self.feed.join([b"".join(map(spaced, first)), *(b"".join([bare[line[0]], *map(spaced, line[1:])]) for line in lines)])
        return self.feed.join([b"".join([bare[line[0]], *map(spaced, line[1:])]) for line in lines])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed as 32-bit integers."""
        if len(text) <= self.leaf_bytes // 4 or len(raw := text.encode()) <= self.leaf_bytes:
            return self.leaf(text)
        if not self.joinable:
            return self.plain(text)
        cuts = self.cuts(raw)
        parts = [(self.leaf(raw[a:b].decode()), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(parts) > 1:  # neighbours are halves of the same part, as the cuts are a power of two
            parts = [self.join(raw, *pair) for pair in zip(parts[::2], parts[1::2], strict=True)]
        return parts[0][0]

    def cuts(self, raw: bytes) -> list[int]:
        """Places that halve a text again and again: at a space close behind the
        middle if there is one, never within a character."""
        at = [0, len(raw)]
        while len(raw) > (len(at) - 1) * self.leaf_bytes:
            middle = []
            for a, b in zip(at, at[1:], strict=False):
                m = raw.find(b" ", (a + b) // 2, min(b, (a + b) // 2 + 64))
                m = m if m >= 0 else (a + b) // 2
                while m < b and raw[m] & 0xC0 == 0x80:
                    m += 1
                middle.append(m)
            at = [x for pair in zip(at, middle, strict=False) for x in pair] + at[-1:]
        return at

    @staticmethod
    def before_word(raw: bytes, at: int) -> bool:
        """Whether a space and then another kind of character stand here."""
        return raw[at] == 32 and at + 1 < len(raw) and not raw[at + 1 : at + 5].decode(errors="ignore")[:1].isspace()

    def in_special(self, raw: bytes, at: int) -> bool:
        """Whether a place lies within a special token's string."""
        return any(raw.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in self.special_bytes)

    def join(self, raw: bytes, left: tuple, right: tuple) -> tuple:
        """Two neighbouring parts (ids, start, end) as one."""
        (a_ids, start, middle), (b_ids, _, end) = left, right
        if start == middle or middle == end:
            return a_ids + b_ids, start, end
        a, b = np.frombuffer(a_ids, np.int32), np.frombuffer(b_ids, np.int32)
        size = self.first_window
        while True:
            self.windows += 1
            k, n = min(size, len(a)), min(size, len(b))
            a_at = middle - np.cumsum(self.lengths[a[len(a) - k :]][::-1])[::-1]  # where each of the last k tokens starts
            b_at = middle + np.cumsum(self.lengths[b[:n]])  # where each of the first n tokens ends
            i, lo, lo_sure = self.first_edge(raw, a_at, start, k == len(a))
            j, hi, hi_sure = self.last_edge(raw, b_at, end, n == len(b))
            if lo is not None and hi is not None:
                text = raw[lo:hi].decode()
                sure = lo_sure and hi_sure or one_class(text) and b"'" not in raw[max(start, lo - 3) : lo] and (lo_sure or not text[0].isspace())
                if sure and (lo_sure or not self.in_special(raw, lo)) and (hi_sure or not self.in_special(raw, hi)):
                    ids = np.frombuffer(self.leaf(text), np.int32)
                    first = lo == start or ids[0] == a[len(a) - k + i]
                    last = hi == end or ids[-1] == b[j]
                    if first and last or lo == start and hi == end:
                        kept = len(a) - k + i
                        return a[:kept].tobytes() + ids.tobytes() + b[j + 1 :].tobytes(), start, end
            if k == len(a) and n == len(b):
                return self.leaf(raw[start:end].decode()), start, end
            size *= 2

    def first_edge(self, raw: bytes, at: np.ndarray, start: int, every: bool) -> tuple:
        """The window's start: (index of its first token, place, whether a pre-token
        surely begins there); the leftmost sure place, else the leftmost character."""
        if every:
            return 0, start, True
        whole = None
        for i, p in enumerate(at.tolist()):
            if self.before_word(raw, p):
                return i, p, True
            if whole is None and raw[p] & 0xC0 != 0x80:
                whole = i
        return (whole, int(at[whole]), False) if whole is not None else (0, None, False)

    def last_edge(self, raw: bytes, at: np.ndarray, end: int, every: bool) -> tuple:
        """The window's end, likewise: (index of its last token, place, whether)."""
        if every:
            return len(at) - 1, end, True
        whole = None
        for j in range(len(at) - 1, -1, -1):
            p = int(at[j])
            if self.before_word(raw, p):
                return j, p, True
            if whole is None and raw[p] & 0xC0 != 0x80:
                whole = j
        return (whole, int(at[whole]), False) if whole is not None else (0, None, False)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, leaf_bytes: int = LEAF_BYTES) -> Codec:
    return Codec(path, leaf_bytes)


def encode(docs: DataFrame, *, path: str | None = None, leaf_bytes: int = LEAF_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids. A map over partitions: no shuffle."""
    ready(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path, leaf_bytes).encode
        for batch in batches:
            for rows, values in portions(batch, enc):
                counts = np.array([len(v) // 4 for v in values], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), ids], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def encode_into(docs: DataFrame, *, path: str | None = None, leaf_bytes: int = LEAF_BYTES, text_col: str = "text") -> DataFrame:
    """The rows with all their columns and n_tokens and ids, which replace columns of
    these names. Only the texts pass through Python."""
    ready(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = codec(path, leaf_bytes)
        for texts in batches:
            yield pd.Series([np.frombuffer(found.encode(t), np.int32) for t in texts], dtype=object)
        found.rest()

    ids = F.pandas_udf(run, "array<int>")(text_of(text_col))
    kept = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    (name,) = fresh(docs, "ids_of_text")
    return docs.withColumn(name, ids).select(*kept, F.size(name).cast("long").alias("n_tokens"), F.col(name).alias("ids"))


#: A batch is answered in portions of about so many bytes of ids.
PORTION_BYTES = 16 << 20


def portions(batch: pa.RecordBatch, enc) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Encodes a batch's texts, a portion at a time."""
    values, size, start = [], 0, 0
    for i, text in enumerate(batch.column(1)):
        values.append(enc(text.as_py()))
        size += len(values[-1])
        if size >= PORTION_BYTES:
            yield batch.slice(start, i + 1 - start), values
            values, size, start = [], 0, i + 1
    if values:
        yield batch.slice(start), values


def decode(encoded: DataFrame, *, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with the column decoded, the text of their ids (null
    for null). A column of that name is replaced."""
    ready(encoded.sparkSession)
    path = path or default_vocabulary()
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    rows = encoded.select(*kept)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = codec(path).decode
        for batch in batches:
            texts = [None if ids is None else dec(ids) for ids in (x.values.to_numpy().tolist() if x.is_valid else None for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, decoded string")
