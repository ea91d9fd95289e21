"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.runtime import cut, cut_counted, small

PREFIX_CHARS = 256


def full_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _outlined(docs: DataFrame, prefix_chars: int) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(body).cast("long")
    return docs.withColumn("_exact_size", size).withColumn("_exact_prefix", F.xxhash64(F.substring(body, 1, prefix_chars)))


def _alike(docs: DataFrame, prefix_chars: int) -> tuple[DataFrame, int]:
    """Length and prefix of the texts that share both with another one, and how many there are."""
    rows = _outlined(docs.select("text"), prefix_chars)
    by_size = rows.groupBy("_exact_size").agg(F.count("*").alias("n")).where("n > 1").select("_exact_size")
    by_size, found = cut_counted(by_size, "sizes", rows=F.lit(True))
    alike = rows.select("_exact_size", "_exact_prefix").join(small(by_size, found["rows"]), "_exact_size", "left_semi")
    alike = alike.groupBy("_exact_size", "_exact_prefix").agg(F.count("*").alias("n")).where("n > 1")
    alike, found = cut_counted(alike.select("_exact_size", "_exact_prefix", F.lit(True).alias("_exact_alike")), "prefixes", rows=F.lit(True))
    return alike, found["rows"]


def _marked(docs: DataFrame, alike: DataFrame, rows: int, prefix_chars: int) -> DataFrame:
    return _outlined(docs, prefix_chars).join(small(alike, rows), ["_exact_size", "_exact_prefix"], "left")


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, all_digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Rows fall together when they agree in length, in the hash of their first
    ``prefix_chars`` characters and then in the SHA-256 of the whole text. Only
    rows that share length and prefix with another one have their whole text
    hashed; ``digest`` is null for the rest, unless ``all_digests`` asks for it.

    Null text counts as empty, so null and empty texts are one group. The
    largest doc_id stays; null ids are smaller than any, and a group of null ids
    only keeps them all. Rows that repeat both doc_id and text are all marked as
    kept (``exact_dedup`` returns one of them). Other columns are not read. An
    empty table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    alike, n = _alike(rows, prefix_chars)
    digest = full_digest(F.coalesce(F.col("text"), F.lit("")))
    marked = _marked(rows, alike, n, prefix_chars)
    marked = marked.select("doc_id", F.coalesce("_exact_alike", F.lit(False)).alias("alike"), (digest if all_digests else F.when(F.col("_exact_alike"), digest)).alias("digest"))
    marked = cut(marked, "digests")
    groups = marked.where("alike").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups, found = cut_counted(groups, "groups", rows=F.lit(True))
    # Rows whose digest is theirs alone need no join.
    joined = marked.where("alike").join(small(groups, found["rows"]), "digest", "left")
    lone = marked.where("not alike").select("digest", "doc_id", "alike", F.lit(None).cast(joined.schema["keep_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    both = joined.unionByName(lone)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    both = both.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest")
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    One row of each group of equal texts stays, that with the largest doc_id;
    among rows that repeat both id and text any one of them. Whole texts are
    hashed only where length and prefix are shared.
    """
    names = docs.columns
    alike, n = _alike(docs, prefix_chars)
    keyed = _marked(docs, alike, n, prefix_chars).withColumn("_exact_digest", F.when(F.col("_exact_alike"), full_digest(F.coalesce(F.col("text"), F.lit("")))))
    marked = cut(keyed.where("_exact_alike").select("doc_id", F.col("_exact_digest").alias("digest")), "digests")
    counted = marked.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    largest = counted.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    largest, found = cut_counted(largest, "groups", rows=F.lit(True))
    gone = counted.join(small(largest, found["rows"]), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone, found = cut_counted(gone.where(~kept | (F.col("copies") > 1)).select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest"), kept.alias("_gone_kept")), "gone", rows=F.lit(True), repeated=F.col("_gone_kept"))
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_exact_digest") == F.col("_gone_digest"))
    if not found["repeated"]:
        return keyed.join(small(gone, found["rows"]), same, "left_anti").select(names)
    joined = keyed.join(small(gone, found["rows"]), same, "left")
    once = joined.where("_gone_kept").dropDuplicates(["doc_id", "_exact_digest"]).select(names)
    return joined.where("_gone_kept is null").select(names).unionByName(once)
