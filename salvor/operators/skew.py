"""Building blocks that keep one heavy key from filling one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salvor.runtime import cut, cut_counted

# A key with more rows than this is split; at most MAX_HUBS keys can qualify,
# so the table of split keys has a proven bound and may be broadcast.
HUB_ROWS = 200_000
MAX_HUBS = 100_000


@dataclass(frozen=True)
class Hubs:
    """Heavy keys of one join column and the number of slots each is split into."""

    table: DataFrame | None
    widest: int = 1

    def slot_of(self, edges: DataFrame, key: str, other: str, slot: str) -> DataFrame:
        """Give each row of the heavy side a slot by the hash of its other end."""
        if self.table is None:
            return edges.withColumn(slot, F.lit(0))
        hubs = F.broadcast(self.table.select(F.col("hub").alias(key), "slots"))
        return edges.join(hubs, key, "left").withColumn(
            slot, F.pmod(F.xxhash64(other), F.coalesce("slots", F.lit(1))).cast("int")
        ).drop("slots")

    def spread(self, df: DataFrame, key: str, slot: str) -> DataFrame:
        """Copy each row of the light side once per slot of its key."""
        if self.table is None:
            return df.withColumn(slot, F.lit(0))
        hubs = F.broadcast(self.table.select(F.col("hub").alias(key), "slots"))
        return df.join(hubs, key, "left").withColumn(
            slot, F.explode(F.sequence(F.lit(0), (F.coalesce("slots", F.lit(1)) - 1).cast("int")))
        ).drop("slots")


def find_hubs(
    edges: DataFrame, keys: list[str], total: int, hub_rows: int = HUB_ROWS, max_hubs: int = MAX_HUBS
) -> list[Hubs]:
    """Heavy keys of each column, from pre-aggregated counts over the edges.

    Keys are counted by parts of their hash first. Only a part beyond the limit can hold
    a key beyond it, so few rows are counted by key.
    """
    limit = max(hub_rows, math.ceil(total / max_hubs))
    if total <= limit:
        return [Hubs(None) for _ in keys]
    parts = 8 * math.ceil(total / limit)

    def sided(*names: str) -> DataFrame:
        part = lambda k: F.pmod(F.xxhash64(k), F.lit(parts))
        one = lambda k: {"side": F.lit(k), "part": part(k), "hub": F.col(k)}
        rows = [F.struct(*[v.alias(n) for n, v in one(k).items() if n in names]) for k in keys]
        return edges.select(F.explode(F.array(*rows)).alias("c")).select("c.*")

    full, n = cut_counted(
        sided("side", "part").groupBy("side", "part").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit).select("side", "part"),
        "full",
        all=F.lit(True),
    )
    if not n["all"]:
        return [Hubs(None) for _ in keys]
    # No more parts are over the limit than sides times the total over the limit.
    counts = (
        sided("side", "part", "hub").join(F.broadcast(full), ["side", "part"], "left_semi")
        .groupBy("side", "hub")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .withColumn("slots", F.ceil(F.col("n") / limit).cast("int"))
    )
    counts = cut(counts, "hubs")
    widest = {r["side"]: r["w"] for r in counts.groupBy("side").agg(F.max("slots").alias("w")).collect()}
    return [
        Hubs(counts.filter(F.col("side") == k).select("hub", "slots"), widest[k])
        if k in widest
        else Hubs(None)
        for k in keys
    ]


def in_ranges(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Write ``df`` range-partitioned by ``keys`` with its range number as ``_range``.

    A key with many rows spans several ranges, so no task holds more than about
    one range of it. The written numbers stay fixed whatever is recomputed later.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id())
    return cut(ranged, "ranged")


def running_sum(
    df: DataFrame, group: list[str], order: list[str], weight: Column, name: str,
    parts: int | None = None,
) -> DataFrame:
    """Running sum of ``weight`` inside each group, up to and including each row.

    ``order`` must make rows unique within a group. A row's value is the sum in
    its own range plus the totals of the group's earlier ranges.
    """
    ranged = in_ranges(df.withColumn("_w", weight.cast("bigint")), group + order, parts)
    totals = ranged.groupBy(*group, "_range").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.sum("_w").over(
        Window.partitionBy(*group, "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.withColumn("_place", inside)
        .join(starts, [*group, "_range"])
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_range", "_start", "_place", "_w")
    )


def number_rows(
    df: DataFrame, group: list[str], order: list[str], name: str, parts: int | None = None
) -> DataFrame:
    """Number rows 1..n inside each group without bringing a group into one task."""
    return running_sum(df, group, order, F.lit(1), name, parts)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group.

    Spark cuts each map task's share to ``limit`` rows per group before the
    shuffle, so a heavy group sends at most ``limit`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", rank).filter(F.col("place") <= limit)


def previous_in_key(df: DataFrame, key: str, at: str, tie: str, name: str) -> DataFrame:
    """``lag(at)`` per key in (at, tie) order, with a heavy key spread over ranges.

    Inside a range an ordinary lag is used; the first row of a key in a range
    takes the greatest ``at`` of the key's earlier ranges.
    """
    ranged = in_ranges(df, [key, at, tie])
    last = ranged.groupBy(key, "_range").agg(F.max(at).alias("_last"))
    carried = last.select(
        key, "_range", F.lag("_last").over(Window.partitionBy(key).orderBy("_range")).alias("_carry")
    )
    inside = F.lag(at).over(Window.partitionBy(key, "_range").orderBy(at, tie))
    return (
        ranged.withColumn("_inside", inside)
        .join(carried, [key, "_range"])
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_range", "_inside", "_carry")
    )
