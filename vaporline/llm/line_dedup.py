"""Line deduplication by pairwise alignment.

Lines are hashed, documents that share a run of lines are paired, the pair's lines are
aligned by patience diff, and blocks of common lines are deleted from the later document,
the one with the greater id. A block is a run of lines that are neighbours in both
documents; it is deleted if it has at least ``block_words`` words.

A rare line or run of lines pairs few documents, a common one would pair all that have
it. So every document is paired, through each of its shortest runs of ``block_words``
words, from each line on and up to each line, with one other only: the first document
that has the run. That is a pair a run however common runs are, and it loses nothing:
every line of a block that any earlier document has is in such a run within the block,
and the run's first holder has it too.

An alignment keeps the order and takes each line once, so it leaves blocks that cross
others and the second of two copies within a document. Runs that it leaves are looked up
in the earlier document, each at the places of its rarest line there. So the lines that
go are those of all common blocks with all earlier documents, whichever way the alignment
went. The first occurrence of a block is never deleted.

Defined results: lines end at line feeds and are compared with runs of white space as
one space and none at the ends; a null text has no lines and stays null; null ids come
last, ties of the id are put in order by a hash of the text; repeated rows (same id and
text) are one document and have the same result; a document that loses its last word is
dropped by ``deduplicated`` unless told otherwise, one that had none stays; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporline.llm.common import SPACE, WORD, fresh, join_counted, ready, settle

BLOCK_WORDS = 10
#: A document's key.
KEY = "struct<none:boolean,id:long,hash:long>"
#: Into how many parts the pairs of a document that all others share are dealt.
PARTS = 256


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ascending in the first, that ascends in the second."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        back[n] = at[i - 1] if i else -1
        if i == len(tails):
            tails.append(b)
            at.append(n)
        else:
            tails[i], at[i] = b, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned equal lines of two documents, as ascending pairs of positions.

    Common heads and tails are aligned; between them the lines that are unique in both
    are, as far as they keep their order; then the same between any two of these.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {line: j for j, line in enumerate(b[b0:b1], b0) if in_b[line] == 1 and in_a.get(line) == 1}
        kept = rising([(i, where[line]) for i, line in enumerate(a[a0:a1], a0) if line in where])
        if kept:
            out += kept
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def repeated(later: list, earlier: list, words: list[int], block_words: int) -> list[int]:
    """Positions of the later document's lines in common blocks of enough words."""
    out: set[int] = set()
    block, before = [], (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in block) >= block_words:
                out.update(block)
            block = []
        block.append(i)
        before = (i, j)
    where: dict = {}
    for i, k in shortest_runs(words, block_words):
        if any(n not in out for n in range(i, k)):
            if not where:
                for at, line in enumerate(earlier):
                    where.setdefault(line, []).append(at)
            rarest = min(range(i, k), key=lambda n: len(where.get(later[n], ())))
            if any(earlier[at - rarest + i : at - rarest + k] == later[i:k] for at in where.get(later[rarest], ()) if at >= rarest - i):
                out.update(range(i, k))
    return sorted(out)


def shortest_runs(words: list[int], block_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs of lines with block_words words, from each line
    on and up to each line."""
    sums = [0, *accumulate(words)]
    ahead = ((i, bisect_left(sums, sums[i] + block_words, i + 1)) for i in range(len(words)))
    back = ((bisect_right(sums, sums[k] - block_words) - 1, k) for k in range(1, len(sums)) if sums[k] >= block_words)
    return {(i, k) for i, k in (*ahead, *back) if k <= len(words) and i < k}


def document_key(id_col: str, text_col: str) -> Column:
    """Orders documents: by id, nulls last, then by a hash of the text."""
    i = F.col(id_col).cast("long")
    return F.struct(i.isNull().alias("none"), F.coalesce(i, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, lines, words): the key, hashes and word counts of each document's lines."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    empty = F.array().cast("array<string>")
    rows = docs.select(document_key(id_col, text_col).alias("doc"), F.coalesce(lines, empty).alias("each"))
    rows = rows.select("doc", F.transform("each", lambda x: F.xxhash64(x)).alias("lines"), F.transform("each", lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))
    return rows.dropDuplicates(["doc"])


def run_hashes(lines: DataFrame, block_words: int) -> DataFrame:
    """(doc, run): hashes of the shortest runs of lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            at, found = [], []
            for n, (hashes, words) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                each = np.array(hashes.as_py(), np.int64)
                some = {xxh64_intdigest(each[i:k].tobytes()) for i, k in shortest_runs(words.as_py(), block_words)}
                at += [n] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc", "run"])

    return lines.select("doc", "lines", "words").mapInArrow(run, f"doc {KEY}, run long")


def candidate_pairs(lines: DataFrame, block_words: int) -> DataFrame:
    """(later, earlier): each document with the first one of each of its shortest runs."""
    each = run_hashes(lines, block_words)
    first = settle(each.groupBy("run").agg(F.min("doc").alias("earlier"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_counted(each, first, "run", "n", total).where("doc <> earlier").select(F.col("doc").alias("later"), "earlier").distinct()


def deletions(lines: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, gone): positions, from 0 and ascending, of each document's lines that an
    earlier document has in a common block; only documents with any.

    An early document that very many share is dealt out to several tasks; each has its
    lines once, before the later documents that it is aligned with."""
    pairs = settle(candidate_pairs(lines, block_words))
    total = max(pairs.count(), 1)
    shares = F.greatest(F.lit(1), F.ceil(F.col("n") * PARTS / F.lit(total))).cast("int")
    often = settle(pairs.groupBy("earlier").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", shares))
    dealt = join_counted(pairs, often, "earlier", "n", total).select("later", "earlier", F.pmod(F.xxhash64("later"), F.col("shares")).cast("int").alias("share"))
    laters = dealt.join(lines.withColumnRenamed("doc", "later"), "later").select("earlier", "share", "later", "lines", "words")
    sides = lines.join(often, lines.doc == often.earlier).select("earlier", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast(KEY).alias("later"), "lines", F.lit(None).cast("array<int>").alias("words"))
    both = sides.unionByName(laters).repartition("earlier", "share").sortWithinPartitions("earlier", "share", F.col("later").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = []
        for batch in batches:
            _, _, later, lines, words = batch.columns
            found = []
            for x, w in zip(lines, words, strict=True):
                if not w.is_valid:  # the lines of the earlier document of the rows that follow
                    first = x.as_py()
                found.append(repeated(x.as_py(), first, w.as_py(), block_words) if w.is_valid else None)
            yield pa.RecordBatch.from_arrays([later, pa.array(found, pa.list_(pa.int32()))], ["doc", "gone"])

    found = both.mapInArrow(run, f"doc {KEY}, gone array<int>").where("size(gone) > 0")
    return found.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, words_removed and removed, the
    positions of the lines that go, joined by commas."""
    ready(docs.sparkSession)
    lines = settle(hashed_lines(docs, id_col, text_col))
    gone = deletions(lines, block_words)
    none = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    per_doc = lines.join(gone, "doc", "left").select("doc", F.size("lines").cast("long").alias("n_lines"), F.size(none).cast("long").alias("n_removed"), F.aggregate(none, F.lit(0).cast("long"), lambda s, i: s + F.get(F.col("words"), i)).alias("words_removed"), F.array_join(none.cast("array<string>"), ",").alias("removed"))
    times = docs.groupBy(document_key(id_col, text_col).alias("doc")).agg(F.count(F.lit(1)).alias("times"))
    rows = per_doc.join(times, "doc").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select(F.when(~F.col("doc.none"), F.col("doc.id")).alias("doc_id"), "n_lines", "n_removed", "words_removed", "removed")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, drop_emptied: bool = True) -> DataFrame:
    """The documents, with all columns, without the lines that earlier ones have."""
    ready(docs.sparkSession)
    lines = settle(hashed_lines(docs, id_col, text_col))
    key, gone = fresh(docs, "key_of_lines", "lines_gone")
    found = deletions(lines, block_words).select(F.col("doc").alias(key), F.col("gone").alias(gone))
    rows = docs.withColumn(key, document_key(id_col, text_col)).join(found, key, "left")
    split = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    rows = rows.withColumn(text_col, text)
    if drop_emptied:
        rows = rows.where(F.col(gone).isNull() | F.col(text_col).rlike(WORD))
    return rows.select(*docs.columns)
