"""Exact top-k search by inner product: MaxScore over dense integer vectors.

A query's terms are its components. In a shard (a block of candidates) a term's score
bounds are the least and the largest product that it can add there, from the shard's
least and greatest value in that component. A candidate that falls short of the sum of
the largest by more than that sum exceeds the query's threshold, its k-th score so
far, can't win. So the terms are split for each query: the essential ones are the
fewest, by the spread of their bounds, that can make a candidate fall that short. They
are traversed for all candidates of the shard; the others are probed, a few at a time,
for those candidates only that are still competitive. Shards of a task share the
thresholds, and the best k of all tasks are merged.

Queries and candidates meet in blocks: each block of queries with each block of
candidates once, so the query set is never broadcast and no task holds more than two
blocks.

Defined results: components become floor(256 x), of any size; a vector that is null or
has a null or non-finite component takes no part; missing components of a shorter
vector count as 0; a row is a candidate for every query but itself, so rows that repeat
an id are candidates of their own and, if queries, have k results each; a row with a
null id is a candidate, null in the result; ties go to the smaller id, null last; fewer
than k candidates give fewer rows; an empty table gives an empty result; other columns
aren't read. A score beyond 64 bits stops at the largest or smallest long.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaporline.llm.common import ready, settle

SCALE = 256
#: Vectors in a block of queries and of candidates, and in a shard of the latter.
QUERY_BLOCK = 4096
BLOCK = 1 << 16
SHARD = 2048
#: Terms probed at a time.
PROBE = 8
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class Best:
    """The k best (score, place) of each query so far; places are in the order of ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0)] * queries
        self.at: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def threshold(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, at: np.ndarray) -> None:
        scores, at = np.concatenate([self.scores[q], scores]), np.concatenate([self.at[q], at])
        order = np.lexsort((at, -scores))[: self.k]
        self.scores[q], self.at[q] = scores[order], at[order]


def search_shard(best: Best, own: np.ndarray, queries: np.ndarray, start: int, vectors: np.ndarray) -> None:
    """Bring a shard's candidates, which have the places from ``start`` on, into the best
    of all queries but the one that stands at the place ``own``. Vectors are doubles that
    hold integers, their products and sums below 2**53."""
    low, high = vectors.min(0), vectors.max(0)
    columns = np.ascontiguousarray(vectors.T)
    for q in range(len(queries)):
        query, bar = queries[q], best.threshold(q)
        ceiling, floor = np.maximum(query * low, query * high), np.minimum(query * low, query * high)
        if ceiling.sum() < bar:
            continue  # no candidate of the shard can win
        order = np.argsort(ceiling - floor, kind="stable")[::-1]
        if bar == -np.inf:
            essential = len(order)
        else:  # from the smallest spread on, until what is left could no longer sort out anything
            rest = np.cumsum(ceiling[order][::-1])[::-1]
            spread = np.cumsum((ceiling - floor)[order])
            essential = int(np.searchsorted(spread, max(ceiling.sum() - bar, 0.0), side="right")) + 1
            essential = min(max(essential, PROBE), len(order))
        scores = query[order[:essential]] @ columns[order[:essential]]
        alive = np.arange(len(vectors))
        if 0 <= own[q] - start < len(vectors):
            alive = np.delete(alive, own[q] - start)
        scores = scores[alive]
        at = essential
        while at < len(order):
            keep = scores + rest[at] >= bar
            alive, scores = alive[keep], scores[keep]
            if not len(alive):
                break
            terms = order[at : at + PROBE]
            scores = scores + vectors[np.ix_(alive, terms)] @ query[terms]
            at += PROBE
        if bar > -np.inf:
            keep = scores >= bar
            alive, scores = alive[keep], scores[keep]
        if len(alive) > 4 * best.k:  # ties of the k-th stay in
            keep = scores >= np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
            alive, scores = alive[keep], scores[keep]
        if len(alive):
            best.add(q, scores, start + alive)


def search_exactly(best: Best, own: np.ndarray, queries: list, vectors: list) -> None:
    """The same for components of any size, in Python's integers."""
    for q, query in enumerate(queries):
        got = ((-max(-LONG - 1, min(LONG, sum(map(int.__mul__, query, v)))), at) for at, v in enumerate(vectors) if at != own[q])
        first = heapq.nsmallest(best.k, got)
        best.scores[q] = np.array([-s for s, _ in first], object)
        best.at[q] = np.array([at for _, at in first], np.int64)


def whole(x: float) -> int:
    """floor(256 x), where 256 x may be beyond the largest double."""
    scaled = SCALE * x
    return math.floor(scaled) if math.isfinite(scaled) else SCALE * int(x)


def padded(rows: pa.Array, width: int) -> np.ndarray:
    """Vectors as doubles floor(256 x), exact, with zeros behind the shorter ones."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(float(SCALE) * rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(rows), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def search_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The best k candidates of a block for each query of a block. The candidates'
    places are in the order of (id, null last; row), so that ties go to the first."""
    order = np.lexsort((candidates.column("row").to_numpy(), candidates.column("id").fill_null(0).to_numpy(), candidates.column("id").is_null().to_numpy(zero_copy_only=False)))
    candidates = candidates.take(pa.array(order))
    place = {row: at for at, row in enumerate(candidates.column("row").to_pylist())}
    own = np.array([place.get(row, -1) for row in queries.column("row").to_pylist()], np.int64)
    best, qs, cs = Best(len(own), k), queries.column("v").combine_chunks(), candidates.column("v").combine_chunks()
    width = max((int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in (qs, cs)), default=0)
    with np.errstate(over="ignore"):
        q, c = padded(qs, width), padded(cs, width)
        small = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width * 2 < EXACT
    if width and small:
        for at in range(0, len(c), SHARD):
            search_shard(best, own, q, at, c[at : at + SHARD])
    else:
        search_exactly(best, own, *([[*map(whole, v), *[0] * (width - len(v))] for v in side.to_pylist()] for side in (qs, cs)))
    which = np.repeat(np.arange(len(own)), list(map(len, best.at)))
    at = np.concatenate([*best.at, np.zeros(0, np.int64)])
    scores = pa.array([int(s) for each in best.scores for s in each], pa.int64())
    of = queries.select(["row", "id"]).take(pa.array(which))
    return pa.table([of.column("row"), of.column("id"), candidates.column("id").take(pa.array(at)), candidates.column("row").take(pa.array(at)), scores], ["query_row", "query_id", "vec_id", "vec_row", "score"])


def vectors_taking_part(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v): the rows that take part under a number of their own, settled, since
    that number holds for one run only. Single floats stay single."""
    x = F.col(vector_col)
    if rows.schema[vector_col].dataType.elementType.typeName() != "float":
        x = x.cast("array<double>")
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return settle(rows.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("v")))


def top_k(vectors: DataFrame, *, k: int = 5, is_query: str = "id % 50 = 0", id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query, which are
    the rows whose ``id`` meets ``is_query``.

    The queries are a stated set. Each of the Q queries is copied to the blocks of
    candidates and each of the N candidates to the blocks of queries, so the shuffle
    moves Q N / block + N Q / query_block vectors, the least for blocks of this size.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors_taking_part(vectors, id_col, vector_col)
    total, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr(f"CAST(({is_query}) AS INT)")), F.lit(0))).first()
    parts = max(-(-total // block), min(spark.sparkContext.defaultParallelism, -(-total // SHARD)), 1)
    turns = max(-(-asked // query_block), 1)
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    turn = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(turns)).cast("int")
    everything = F.sequence(F.lit(0), F.lit(turns - 1))
    candidates = rows.select(part.alias("part"), F.explode(everything).alias("turn"), "row", "id", "v")
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), turn.alias("turn"), "row", "id", "v")

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return search_block(queries, candidates, k)

    found = queries.groupBy("part", "turn").cogroup(candidates.groupBy("part", "turn")).applyInArrow(run, "query_row long, query_id long, vec_id long, vec_row long, score long")
    by_score = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec_row")
    return found.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
