"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salvor.runtime import cut, cut_counted, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
LEVELS, LEVEL_BITS = 5, 12
_BITS = LEVELS * LEVEL_BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; a null id counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, _BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def target_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the total by weight.

    Sources in code point order, null last, take the weights in turn. No target
    exceeds ``most`` times its source's size; the excess goes to the others by
    weight. In the order of size over weight this is one running sum: the first
    source that is not filled up sets the level for all later ones. One row per
    source is ordered here, never a row per document.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (left - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    free = F.col("most") > F.col("level") * F.col("weight")
    least = F.min(F.when(free, F.struct("place", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("least", least)
    target = F.when(F.col("least").isNull() | (F.col("place") < F.col("least.place")), F.col("most").cast("double"))
    return rows.select("source", "source_size", target.otherwise(F.col("least.level") * F.col("weight")).alias("target"))


def mix_sources(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds source_size, target and taken to rows of (doc_id, source, size).

    Every document is taken floor(target / source_size) times; the rest of the
    target goes to the documents whose hash lies below their source's threshold.
    The threshold comes from histograms: sizes are summed by source and hash
    bucket, the bucket in which the budget ends is split into finer buckets,
    and so on until it holds one document (at most five levels of 4096 buckets).
    That last document is taken if this comes nearer to the target. No row is
    sorted, and the result depends on ids and sizes only.

    Null source is a source of its own, null size counts as 0, null ids share
    the hash of the empty text; rows with the same id in a source are taken
    together. A source of size 0 has target 0. An empty table gives no rows.
    """
    items = items.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    items = cut(items.withColumn("hash", document_hash(F.col("doc_id"))), "items")
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = target_sizes(sizes, weights, most)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    state = targets.withColumn("whole", whole)
    state = state.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state, found = cut_counted(state.withColumn("start", F.lit(0).cast("long")), "budgets", rows=F.lit(True))
    sources = found["rows"]
    for level in range(LEVELS):
        state, found = cut_counted(_refine(items, state, sources, level), "budgets", open=F.col("rows") > 1)
        if not found["open"]:
            break
    shift = _BITS - LEVEL_BITS * (level + 1)
    end = F.when(F.col("rows").isNull(), F.lit(1 << _BITS).cast("long")).otherwise(
        F.col("start") * (1 << shift) + F.when(F.col("budget") > F.col("held") / 2, 1 << shift).otherwise(0)
    )
    state = state.select(F.col("source").alias("_source"), "source_size", "target", "whole", end.alias("end"))
    joined = items.join(small(state, sources), F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * (F.col("whole") + (F.col("hash") < F.col("end")).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _refine(items: DataFrame, state: DataFrame, sources: int, level: int) -> DataFrame:
    """The bucket of this level in which each source's budget ends.

    ``start`` is the bucket's number, ``budget`` what is left at its start,
    ``rows`` and ``held`` what it holds; null where the budget is never reached.
    """
    shift = _BITS - LEVEL_BITS * (level + 1)
    open_ones = state if level == 0 else state.where("rows is not null")
    open_ones = open_ones.select(F.col("source").alias("_source"), "budget", "start")
    inside = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("start"))
    buckets = (
        items.join(small(open_ones, sources), inside)
        .groupBy("_source", F.shiftright("hash", shift).alias("bucket"))
        .agg(F.sum("size").alias("held"), F.count("*").alias("rows"), F.first("budget").alias("budget"))
    )
    until = F.sum("held").over(Window.partitionBy("_source").orderBy("bucket"))
    ended = buckets.withColumn("until", until).where(F.col("until") > F.col("budget"))
    first = ended.groupBy("_source").agg(F.min_by(F.struct("bucket", "held", "rows", "until", "budget"), "bucket").alias("at"))
    rest = state.drop("rows", "held", "budget", "start").join(first, F.col("source").eqNullSafe(F.col("_source")), "left")
    return rest.select(
        "source", "source_size", "target", "whole",
        (F.col("at.budget") - (F.col("at.until") - F.col("at.held"))).alias("budget"),
        F.col("at.bucket").alias("start"), F.col("at.rows").alias("rows"), F.col("at.held").alias("held"),
    )
