"""Mixing sources to target weights.

Words are counted per source, a repetition rate is derived for each source, and
every document is taken floor(rate) times plus one hash-seeded Bernoulli copy
whose probability is the fraction of the rate.

Defined results: a null text has size 0; a null source is a source of its own;
a draw is seeded by id and text, so rows that share an id or have none draw on their
own; repeated rows (same id and text) are documents of their own that draw alike; an empty table gives an empty result; a
source whose words all are zero has target 0 and rate 0. Input columns that have
the name of an output column are replaced by it.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporline.llm.common import WORD, fresh, text_of

#: A source's words are taken at most so many times.
MOST_REPEATS = 3
#: Sources no more than this many are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """How many runs of other than white space a text has."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(key: Column, text: Column, seed: int = 7) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of key and text: the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: Fraction = Fraction(1), most: int = MOST_REPEATS) -> DataFrame:
    """One row a source (source, source_size, target) from rows (source, size).

    Sources in code point order, null last, have the weights in turn. All targets
    sum to ``share`` of all words unless caps prevent it: a target stops at
    ``most`` times its source's words and what is left over goes to the others by
    weight, until none is above. The end of that rounds is a water level: sorted
    by cap per weight, sources are capped as long as the level that the others
    would then have isn't below their own. Cap sums and weights are whole numbers,
    so the level needs no loop and no order of addition.

    The windows run over one row a source, after the aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", turn.cast("long")).withColumn("cap", F.col("source_size") * most)
    level = Window.orderBy(F.expr("cap / CAST(weight AS DOUBLE)"), F.col("source").asc_nulls_last())
    before, every = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "source",
        "source_size",
        "weight",
        "cap",
        (F.sum("source_size").over(every) * share.numerator / F.lit(float(share.denominator)) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    )
    capped = F.col("cap") * F.col("open") <= F.col("left") * F.col("weight")
    # The first source that isn't capped sets the level for itself and all after it.
    first = F.min(F.when(~capped, F.struct(F.expr("cap / CAST(weight AS DOUBLE)"), F.col("source").isNull(), F.col("source"), F.col("left"), F.col("open")))).over(every)
    per = per.select("source", "source_size", "weight", "cap", capped.alias("capped"), F.expr("cap / CAST(weight AS DOUBLE)").alias("height"), first.alias("first"))
    after = (F.col("first").isNotNull()) & (~F.col("capped"))
    return per.select("source", "source_size", F.when(after, F.col("first.left") * F.col("weight") / F.col("first.open")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: Fraction = Fraction(1), most: int = MOST_REPEATS, seed: int = 7) -> DataFrame:
    """The documents with their mix: size, source_size, target, rate, copies, taken.

    One pass counts words per source (partial sums before the shuffle, so a hot
    source costs one row a task); the few source rows come back by broadcast if
    there are at most BROADCAST_SOURCES of them, else by a shuffle join that
    adaptive execution splits where a source is hot.
    """
    out = ["size", "source_size", "target", "rate", "copies", "taken"]
    kept = [c for c in docs.columns if c.lower() not in out]
    sized = docs.withColumn("size", words(text_of(text_col)))
    targets = source_targets(sized.select(F.col(source_col).alias("source"), "size"), weights, share, most)
    targets = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    few = docs.select(source_col).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    (drawn,) = fresh(docs, "drawn")
    mixed = docs.select(*kept, words(text_of(text_col)).alias("size"), draw(F.col(id_col), text_of(text_col), seed).alias(drawn)).join(F.broadcast(targets) if few else targets, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    mixed = mixed.select(*kept, drawn, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), rate.alias("rate"))
    whole = F.floor("rate")
    mixed = mixed.withColumn("copies", (whole + (F.col(drawn) < F.col("rate") - whole).cast("long")).cast("long"))
    return mixed.withColumn("taken", F.col("size") * F.col("copies")).drop(drawn)


def emit(docs: DataFrame, **options) -> DataFrame:
    """Each document as many times as the mix takes it, with the input's columns."""
    mixed = mix(docs.withColumns({f"__in_{c}": F.col(c) for c in docs.columns}), **options)
    times = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select(*[F.col(f"__in_{c}").alias(c) for c in docs.columns])
