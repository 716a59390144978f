"""Groups of near copies: SimHash's Gray-order index where a link is a similarity.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity
of at least 4/5; the connected components are the groups. Fingerprints of such sets
differ in 0 to some 20 of 64 bits, so that bands of equal bits (``simhash.grouped``) would
put nearly everything together. The index is built within other groups instead, which
are exact: in any one order of all shingles, the first n - ceil(4n/5) + 1 shingles of a
set of n (its prefix) share one with the prefix of each set that is so similar. So the
sets whose prefixes share a shingle are a group.

No group gives all its pairs. First, each set is held against the few nearest of the
centres of its groups, and what is similar is joined; that is a fixed number of
comparisons a set, and it joins most of a large group of near copies. Then each group's Gray-order tree is searched for pairs of sets that aren't in
one component yet; subtrees in the component of the searching set are left whole, like
those that differ in more than MOST_BITS bits. A tree gives the pairs whose sizes and
parities allow the similarity: a set's parities tell of each of 512 classes of shingles
whether it has an odd number of them, and two sets differ in at least as many shingles as
parities, at a similarity of 4/5 in no more than a ninth of both sizes. Of these pairs,
those whose shared prefixes allow the similarity too are held against each other: what two
sets share up to the end of the prefix that ends first is shared by the prefixes, so the
overlap is at most what the prefixes share and what that set has behind its prefix. Every
comparison is of the whole sets. So no link between components is lost but those of more than
MOST_BITS bits: at a similarity of 4/5, 9.5 bits are expected, with a deviation of 2.8,
so that fewer than one pair in 10**7 has more than 26.

The order of shingles decides the work, not the result: those that are common in a
sample of the documents come last, so that few prefixes have them; the others are in the
order of their hashes. Texts of equal sets are one node from the start. A group of more
than GROUP_LIMIT sets is dealt into blocks, and the tree is built over each pair of them.

Defined results: words are as in ``simhash.fingerprint``, but each shingle counts once;
a text of fewer words than a shingle has is one shingle; a null text counts as empty;
texts without words have the empty set and are one group; ids and extra columns are as
in ``simhash.classes``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaporline.llm.common import free_memory, ready, settle, text_of
from vaporline.llm.components import components
from vaporline.llm.simhash import AT_ONCE, SEED, GrayTree, bit_counts, joined_classes, kept_of, majority, signed, whole_groups

SHINGLE_WORDS = 5
#: Fingerprints of similar sets differ in no more bits than this, those of sets and
#: centres that are tried first in no more than the second.
MOST_BITS, NEAR_BITS = 26, 16
#: Columns of the parities, 64 in each.
PARITIES = tuple(f"odd_{i}" for i in range(8))
#: How many others a set is held against first.
NEAREST = 4
#: Sets of a group, or of a block of a larger one.
GROUP_LIMIT = 1 << 15
#: Documents in the sample that common shingles are known from, and the most that are.
SAMPLE = 10_000
MOST_COMMON = 200_000
#: Up to so many keys of 8 bytes are broadcast, more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def shingles(text: str, width: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def key_of(found: np.ndarray) -> int:
    """What names a set: a hash of it, signed."""
    from xxhash import xxh64_intdigest

    return signed(xxh64_intdigest(found.tobytes()))


def prefix(found: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A set's first shingles in the order of (how often it is in the sample, hash)."""
    if len(common) and len(found):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(np.where(common[at] == found, often[at], 0), kind="stable")]
    return found[: len(found) - (4 * len(found) + 4) // 5 + 1] if len(found) else found


def parities(found: np.ndarray) -> np.ndarray:
    """Of each class of shingles, by their hash, whether a set has an odd number: as longs."""
    classes = 64 * len(PARITIES)
    odd = np.bincount((found % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least 4/5, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def common_shingles(texts: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, ascending, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), width).view(np.int64))], ["shingle"])

    chosen = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(total, 1))) < SAMPLE).select("text")
    counts = chosen.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = counts.orderBy(F.col("n").desc(), "shingle").limit(MOST_COMMON).toPandas()
    common = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], found["n"].to_numpy(np.int64)[order]


def described(texts: DataFrame, common: np.ndarray, often: np.ndarray, width: int) -> DataFrame:
    """(doc_id, text_hash, fp, n, bits, prefix, parities) of rows (doc_id, text_hash, text): fp
    names the text's set, n is its size, bits its fingerprint. A task gives a set's prefix and
    parities once, else no prefix and null."""
    schema = "doc_id long, text_hash long, fp long, n long, bits long, prefix array<long>, " + ", ".join(f"{p} long" for p in PARITIES)
    names = ["doc_id", "text_hash", "fp", "n", "bits", "prefix", *PARITIES]
    held = texts.sparkSession.sparkContext.broadcast((common, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = held.value
        seen: set[int] = set()
        for batch in batches:
            keys, sizes, bits, first, odd = [], [], [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py(), width)
                keys.append(key_of(found))
                sizes.append(len(found))
                bits.append(signed(majority(bit_counts(found), len(found))))
                first.append([] if keys[-1] in seen else prefix(found, common, often).view(np.int64))
                odd.append([None] * len(PARITIES) if keys[-1] in seen else parities(found).tolist())
                seen.add(keys[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.int64()), pa.array(first, pa.list_(pa.int64())), *(pa.array([o[k] for o in odd], pa.int64()) for k in range(len(PARITIES)))], names)
        free_memory()

    return texts.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def held_by_several(rows: DataFrame) -> DataFrame:
    """(shingle, fp): the shingles that several sets' prefixes have, with these sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order; the last one is held back until the next shows what it is.
        shingle, fp, joined = np.empty(0, np.int64), np.empty(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, fp = (np.concatenate([held, c.to_numpy(zero_copy_only=False)]) for held, c in zip((shingle, fp), batch.columns, strict=True))
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (fp[1:] != fp[:-1])])
            shingle, fp = shingle[new], fp[new]
            same = shingle[1:] == shingle[:-1]
            keep = np.concatenate([[joined], same]) | np.concatenate([same, [False]])
            joined = bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(shingle[:-1][keep[:-1]]), pa.array(fp[:-1][keep[:-1]])], ["shingle", "fp"])
            shingle, fp = shingle[-1:], fp[-1:]
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(fp)], ["shingle", "fp"])

    every = rows.select(F.explode("prefix").alias("shingle"), "fp")
    return every.repartition("shingle").sortWithinPartitions("shingle", "fp").mapInArrow(run, "shingle long, fp long")


def centres(shared: DataFrame) -> DataFrame:
    """(a, b): each set with the NEAREST centres that are nearest to it, of those of its
    groups, if sizes and bits allow the similarity. A group's centre is the set whose
    fingerprint is nearest to the majority of all fingerprints of the group (or block):
    variants of one text are more similar to it than to each other."""
    rows = shared.select("shingle", F.col("block").cast("long").alias("block"), "fp", "n", "bits").repartition("shingle", "block").sortWithinPartitions("shingle", "block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, block, fp, n, bits in whole_groups(batches):
            starts = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (block[1:] != block[:-1])]))
            sizes = np.diff(np.append(starts, len(fp)))
            ones = np.add.reduceat(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32), starts)
            middle = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            off = np.bitwise_count(bits.view(np.uint64) ^ np.repeat(middle, sizes)).astype(np.int64)
            order = np.lexsort((off, np.repeat(np.arange(len(starts)), sizes)))
            at = np.repeat(order[starts], sizes)
            far = np.bitwise_count((bits ^ bits[at]).view(np.uint64)).astype(np.int64)
            may = (fp != fp[at]) & (far <= NEAR_BITS) & (9 * np.minimum(n, n[at]) >= 4 * (n + n[at]))
            yield pa.RecordBatch.from_arrays([pa.array(fp[may]), pa.array(far[may]), pa.array(fp[at][may])], ["a", "far", "b"])

    pairs = rows.mapInArrow(run, "a long, far long, b long").distinct()
    place = F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))
    near = pairs.withColumn("place", place).where(F.col("place") <= NEAREST)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with root, the component of their set so far."""
    return shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def across(shared: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, over): all pairs of sets of different components whose bits, sizes, parities
    and shared prefixes allow the similarity, by the tree of each group or pair of blocks;
    over is by how much they share more than they must."""
    rows = labelled(shared, roots).join(sets.select("fp", *PARITIES), "fp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "n", "bits", "root", *PARITIES)
    rows = rows.withColumn("pattern", F.xxhash64("low", "high"))  # of one shingle, few and unlike
    rows = rows.select("shingle", "pattern", "bits", "fp", "n", "root", "block", (F.col("low") < F.col("high")).alias("two"), *PARITIES)
    rows = rows.repartition("shingle", "pattern").sortWithinPartitions("shingle", "pattern", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, pattern, bits, fp, n, root, block, two, *odd in whole_groups(batches):
            group = np.cumsum(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (pattern[1:] != pattern[:-1])])) - 1
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            open_ = (np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts))[group]  # of several components
            if not open_.any():
                continue
            bits, fp, n, root, block, two, group = (x[open_] for x in (bits, fp, n, root, block, two, group))
            tree = GrayTree(group, bits.view(np.uint64), labels=root)
            odd = [x[open_][tree.order] for x in odd]
            for x, y in counted(tree, fp[tree.order], n[tree.order], block[tree.order], two[tree.order], odd):
                yield pa.RecordBatch.from_arrays([*map(pa.array, (*x, *y))], ["a", "b", "least", "shared"])

    found = rows.mapInArrow(run, "a long, b long, least long, shared long")
    return found.groupBy("a", "b", "least").agg(F.sum("shared").alias("shared")).where("shared >= least").select("a", "b", (F.col("shared") - F.col("least")).alias("over"))


def counted(tree: GrayTree, fp: np.ndarray, n: np.ndarray, block: np.ndarray, two: np.ndarray, odd: list[np.ndarray]) -> Iterator[tuple]:
    """Of a tree's pairs whose sizes and parities allow the similarity: (a, b), the least
    number of shingles that their prefixes then share, and in how many of its groups they are."""
    for i, j in tree.pairs(MOST_BITS):
        both, large = n[i] + n[j], np.maximum(n[i], n[j])
        may = (9 * (both - large) >= 4 * both) & (~two[i] | (block[i] != block[j]))
        if not may.any():
            continue
        i, j, both, large = i[may], j[may], both[may], large[may]
        unlike = np.zeros(len(i), np.int64)
        for x in odd:
            unlike += np.bitwise_count((x[i] ^ x[j]).view(np.uint64))
        may = 9 * unlike <= both
        if not may.any():
            continue
        i, j, both, large = i[may], j[may], both[may], large[may]
        least = (4 * both + 8) // 9 - (4 * large + 4) // 5 + 1
        a, b = np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        yield (a[starts], b[starts]), (least[starts], np.diff(np.append(starts, len(a))))


def whole_sets(pairs: DataFrame, texts: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(fp, every): the whole sets of the pairs (a, b). Only the texts of these sets are
    read by Python: of each set the one with the smallest hash. Up to BROADCAST_KEYS such
    hashes are broadcast, so that the texts aren't shuffled; beyond, both sides are."""
    need = settle(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(sets.select("fp", "text_hash"), "fp").select("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if h not in seen:
                    seen.add(h)
                    found = shingles(t.as_py(), width)
                    yield pa.RecordBatch.from_arrays([pa.array([key_of(found)], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["fp", "every"])
        free_memory()

    need = F.broadcast(need) if need.count() <= BROADCAST_KEYS else need
    every = texts.select("text_hash", "text").join(need, "text_hash", "left_semi").mapInArrow(run, "fp long, every array<long>")
    return settle(every.groupBy("fp").agg(F.first("every").alias("every")))


def compared(pairs: DataFrame, every: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    both = pairs.join(every.select(F.col("fp").alias("a"), F.col("every").alias("of_a")), "a").join(every.select(F.col("fp").alias("b"), F.col("every").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = pa.array([similar(p.values.to_numpy(), q.values.to_numpy()) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return settle(both.mapInArrow(run, "a long, b long"))


def sharing_most(pairs: DataFrame) -> DataFrame:
    """(a, b): of each set the NEAREST pairs that share most."""
    each = pairs.withColumn("of", F.explode(F.array("a", "b")))
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.col("over").desc(), "a", "b"))
    return settle(each.withColumn("place", place).where(F.col("place") <= NEAREST).select("a", "b").distinct())


def still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, over): the pairs whose sets aren't in one component."""
    rows = pairs
    for side in ("a", "b"):
        rows = rows.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return settle(rows.where("root_a <> root_b").select("a", "b", "over"))


def links(rows: DataFrame, texts: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(a, b): pairs of similar sets, or of a set and its component's root, that connect all
    similar sets and no others; rows as of ``described``."""
    sets = settle(rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("text_hash").alias("text_hash"), *(F.max(p).alias(p) for p in PARITIES)))
    shared = held_by_several(rows).join(sets.select("fp", "n", "bits"), "fp").select("shingle", "fp", "n", "bits")
    shared = settle(shared)
    large = settle(shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > GROUP_LIMIT).select("shingle", F.ceil(F.col("held") / GROUP_LIMIT).cast("int").alias("blocks")))
    shared = shared.withColumn("blocks", F.lit(1)) if large.isEmpty() else settle(shared.join(large, "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = settle(centres(shared))
    roots = components(compared(pairs, whole_sets(pairs, texts, sets, width)))
    pairs = still_apart(across(shared, roots, sets), roots)
    every = whole_sets(pairs, texts, sets, width)
    first = sharing_most(pairs)
    roots = components(as_links(roots).unionByName(compared(first, every)))
    pairs = still_apart(pairs.join(first, ["a", "b"], "left_anti"), roots)
    return as_links(roots).unionByName(compared(pairs.select("a", "b"), every))


def as_links(roots: DataFrame) -> DataFrame:
    """Known components as pairs (a, b), so that these aren't sought again."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def kept_rows(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group with all its columns, chosen as by ``simhash.kept_rows``."""
    ready(docs.sparkSession)
    text = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    common, often = common_shingles(texts, docs.count(), shingle_words)
    rows = settle(described(texts, common, often, shingle_words))
    found = joined_classes(rows.select("doc_id", "text_hash", "fp"), lambda _: links(rows, texts, shingle_words))
    return kept_of(docs, found, id_col, text_col)
