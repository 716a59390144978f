"""SimHash near-deduplication over a Gray-order hierarchical index.

A fingerprint is the bitwise majority of the hashes of a text's word shingles.
Fingerprints that differ in few bits are linked, and the connected components are
the groups of near copies.

Two fingerprints that differ in at most k bits are equal in at least one of k + 1
bands of bits, so each distinct fingerprint goes to k + 1 groups, one a band. In a
group the fingerprints are sorted by Gray rank, where neighbours differ in few bits.
Runs of neighbours form the nodes of a tree: a node has the bits in which all below
it agree, without those that its parent has already. All members of the group search
the tree at once, level by level: differences add up on the way down, and a node is
left with all below it as soon as they are more than k.

Defined results: a null text counts as empty; a text without words has fingerprint 0
and is linked like any other; copies and repeated rows have equal fingerprints and so
one component; a component's id is its smallest non-null id (null if it has none); an
empty table gives an empty result; extra columns are kept by ``kept_rows`` and not
read otherwise.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporline.llm.common import fresh, join_counted, ready, settle, text_of
from vaporline.llm.components import components

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42
#: Children of a node.
FAN = 8
#: A group of more fingerprints than this is split by further bits, which is exact.
GROUP_LIMIT = 1 << 15
#: Shingles hashed, or steps of a search, held in memory at once.
AT_ONCE = 1 << 20
ALL_BITS = (1 << 64) - 1


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text, unsigned. ASCII capitals count as small letters."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1]
    ends = ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        hashes = array("Q", [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + AT_ONCE].tolist(), ends[at : at + AT_ONCE].tolist(), strict=True)])
        ones += bit_counts(np.frombuffer(hashes, np.uint64))
    return majority(ones, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        bits = np.unpackbits(hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # sums of so many bits fit a byte
            ones += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return ones


def majority(ones: np.ndarray, total: int) -> int:
    """The fingerprint whose bits are set in over half of the hashes, unsigned."""
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_hash (64 bits of the text) and fp, the
    fingerprint as a signed long. A map over partitions: no shuffle."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), shingle_words, seed) for text in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def split_bits(bits: int, parts: int) -> list[int]:
    """A set of bits as so many masks of about equal size, low bits first."""
    each = [i for i in range(64) if bits >> i & 1]
    cut = [len(each) * n // parts for n in range(parts + 1)]
    return [sum(1 << i for i in each[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def grouped(distinct: DataFrame, most_bits: int, limit: int = GROUP_LIMIT) -> DataFrame:
    """(mask, pattern, fp): the groups in which a fingerprint searches.

    A group is a mask of bits and their pattern. Groups over the limit are split by
    a band of the bits that the mask doesn't have yet, again and again: members that
    differ in at most most_bits of these bits are still equal in one of the bands.
    """
    masks = split_bits(ALL_BITS, most_bits + 1)
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")
    done = None
    while True:
        sizes = settle(rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        if sizes.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(sizes, ["mask", "pattern"], "left_anti")
        done = small if done is None else done.unionByName(small)
        seen = [r.mask for r in sizes.select("mask").distinct().collect()]  # masks, of which each round has few
        finer = {m: [signed(m & ALL_BITS | b) for b in split_bits(ALL_BITS & ~m, most_bits + 1)] for m in seen}
        table = F.create_map(*[x for m, to in finer.items() for x in (F.lit(m), F.array(*map(F.lit, to)))])
        large = rows.join(sizes, ["mask", "pattern"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        rows = settle(large.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp"))


class GrayTree:
    """The hierarchical index over the fingerprints of one or more groups."""

    def __init__(self, group: np.ndarray, fps: np.ndarray, fan: int = FAN, labels: np.ndarray | None = None):
        """group: ascending; fps: unsigned; labels: pairs of equal labels aren't sought,
        and a node whose leaves all have the searching one's label is left."""
        rank = fps.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        order = np.lexsort((rank, group))
        self.fps, group = fps[order], group[order]
        self.order = order
        leaf = np.arange(len(fps) + 1)
        self.labels = None if labels is None else labels[order]
        #: Of each level, the least and the greatest label below each node.
        self.spans: list = []
        low = high = self.labels
        #: Of each level from the leaves up: where a node's children start, its leaves' end, bits in which these agree, their pattern.
        self.levels = []
        every, some, ends, of = self.fps, self.fps, leaf[1:], group
        while True:
            first = np.concatenate([[True], of[1:] != of[:-1]])
            place = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
            starts = np.flatnonzero(first | (place % fan == 0))
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            ends, of = ends[np.append(starts[1:], len(ends)) - 1], of[starts]
            agreed = ~(every ^ some)
            self.levels.append((np.append(starts, len(place)), ends, agreed, every & agreed))
            if labels is not None:
                low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
                self.spans.append((low, high))
            if len(np.unique(of)) == len(of):
                break
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)))
        self.root = np.repeat(np.arange(len(sizes)), sizes)

    def pairs(self, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of leaves of a group within most_bits, as arrays, in portions."""
        query = np.arange(len(self.fps))
        _, _, agreed, pattern = self.levels[-1]
        far = np.bitwise_count((self.fps ^ pattern[self.root]) & agreed[self.root])
        todo = [(len(self.levels) - 1, query, self.root, far)]
        while todo:
            level, query, node, far = todo.pop()
            starts = self.levels[level][0]
            width = starts[node + 1] - starts[node]
            if len(query) > 1 and width.sum() > AT_ONCE:
                half = len(query) // 2
                todo += [(level, query[:half], node[:half], far[:half]), (level, query[half:], node[half:], far[half:])]
                continue
            above = self.levels[level][2][node]
            child = np.repeat(starts[node] - np.cumsum(width) + width, width) + np.arange(width.sum())
            query, far, above = np.repeat(query, width), np.repeat(far, width), np.repeat(above, width)
            if level:
                _, ends, agreed, pattern = self.levels[level - 1]
                far = far + np.bitwise_count((self.fps[query] ^ pattern[child]) & agreed[child] & ~above)
                keep = (far <= most_bits) & (ends[child] > query + 1)  # else all below are too far, or searched for this one before
                if self.labels is not None:
                    low, high = self.spans[level - 1]
                    keep &= (low[child] != high[child]) | (low[child] != self.labels[query])
                if keep.any():
                    todo.append((level - 1, query[keep], child[keep], far[keep]))
            else:
                far = far + np.bitwise_count((self.fps[query] ^ self.fps[child]) & ~above)
                keep = (far <= most_bits) & (child > query)
                if self.labels is not None:
                    keep &= self.labels[query] != self.labels[child]
                if keep.any():
                    yield query[keep], child[keep]

    def forest(self, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of fingerprints that connect what the pairs connect, one less than
        there are members in each component."""
        label = np.arange(len(self.fps))
        for a, b in self.pairs(most_bits):
            while True:
                x, y = label[a], label[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                low = np.minimum(x, y)
                np.minimum.at(label, x, low)
                np.minimum.at(label, y, low)
                while (nearer := label[label]).tolist() != label.tolist() if len(label) < 64 else not np.array_equal(nearer := label[label], label):
                    label = nearer
        hung = np.flatnonzero(label != np.arange(len(label)))
        return self.fps[hung], self.fps[label[hung]]


def links(distinct: DataFrame, most_bits: int = MOST_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that connect all that
    differ in at most most_bits bits: of each group a spanning forest, so the links
    are fewer than k + 1 times the fingerprints however dense a group is."""
    rows = grouped(distinct, most_bits, limit).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, pattern, fps in whole_groups(batches):
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            group = np.cumsum(new)
            several = np.bincount(group)[group] > 1
            if several.any():
                a, b = GrayTree(group[several], fps[several].view(np.uint64)).forest(most_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns, the first two of which name a group (mask, pattern, fp), in portions that
    end where a group ends."""
    kept: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(map(np.concatenate, zip(*kept, strict=True)))

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        rows += batch.num_rows
        if rows >= AT_ONCE // 16:
            every = joined()
            mask, pattern = every[:2]
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))
            cut = change[-1] + 1 if len(change) else 0
            if cut:
                yield tuple(x[:cut] for x in every)
            kept = [tuple(x[cut:] for x in every)]
            rows = len(mask) - cut
    if rows:
        yield joined()


def classes(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", limit: int = GROUP_LIMIT) -> DataFrame:
    """One row a document: doc_id, text_hash, fingerprint (16 hexadecimal digits),
    component_id and root, the component's smallest fingerprint as a long."""
    rows = settle(fingerprints(docs, shingle_words=shingle_words, seed=seed, id_col=id_col, text_col=text_col))
    found = joined_classes(rows, lambda distinct: links(distinct, most_bits, limit))
    return found.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def joined_classes(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) of rows (doc_id, text_hash, fp), where
    links_of gives the links (a, b) of the distinct fp."""
    total = rows.count()
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")))
    roots = components(links_of(distinct.select("fp")))
    linked = settle(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "id", F.coalesce("root", "fp").alias("root")))
    least = settle(linked.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    known = join_counted(linked, least, "root", "members", distinct.count()).select("fp", "n", "component_id", "root")
    found = join_counted(rows, settle(known), "fp", "n", total)
    return found.select("doc_id", "text_hash", "fp", "component_id", "root")


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """One document of each component with all its columns: the one whose id is the
    component's, or any one where several rows have that id or none has one."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    return kept_of(docs, classes(docs, **options), id_col, text_col)


def kept_of(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``kept_rows`` of classes that are known."""
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key, hashed, root = fresh(docs, "key_of_kept", "hash_of_kept", "root_of_kept")
    kept = settle(found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed), F.col("root").alias(root)))
    several = settle(kept.groupBy(root).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(root))
    on = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text_of(text_col)) == F.col(hashed))
    lone = docs.join(kept.join(several, root, "left_anti"), on, "left_semi")
    if several.isEmpty():
        return lone
    tied = docs.join(kept.join(several, root, "left_semi").distinct(), on).dropDuplicates([root])
    return lone.unionByName(tied.select(*docs.columns))
