"""Streaming forms of the time-window rules.

Every trigger writes its rows to a log and judges them by the batch form, together
with the few earlier rows of their keys that still count. A key whose rows come
out of order is judged from the log before the result is returned, so neither the
number nor the order of files changes the result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvor.operators.rates import (
    CLIENT_LIMIT,
    CONFIRMATION_TTL_SECONDS,
    GLOBAL_LIMIT,
    WINDOW_SECONDS,
    admit,
    match_confirmations,
    micros,
    retry_after,
    slide_counts,
    window_load,
)
from salvor.runtime import scratch_path


def read_files(
    spark: SparkSession, folder: str, schema: str, name: str = "*.parquet", files_per_trigger: int = 100
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


class Judged(NamedTuple):
    """A stream's rows and the rule for them.

    ``rows``: key, at, rank, tie and what else the rule reads; (at, rank, tie) is a
    key's order, ``tie`` is unique. ``judge`` adds ``verdict`` to a table of rows.
    ``held`` gives those of the judged rows that later rows of the key need: judged
    again before these, they have the same verdicts. ``result`` names the columns.
    """

    rows: DataFrame
    judge: Callable[[DataFrame], DataFrame]
    held: Callable[[DataFrame], DataFrame]
    result: Callable[[DataFrame], DataFrame]


def _place() -> Column:
    return F.struct("at", "rank", "tie")


def _matched(rows: DataFrame, keys: DataFrame, how: str, *also: str) -> DataFrame:
    """``rows`` joined by key; null is a key like any other."""
    keys = keys.select(F.col("key").alias("_key"), *also)
    return rows.join(keys, F.col("key").eqNullSafe(F.col("_key")), how).drop("_key")


def stream_admission(
    events: DataFrame, key: str, at: str, tie: str, limit: int = CLIENT_LIMIT,
    window_seconds: int = WINDOW_SECONDS,
) -> Judged:
    """Sliding-window admission on a stream, to be run by ``run_available``.

    Held are the admitted rows of a key's last window, at most ``limit``.
    """
    span = window_seconds * 1_000_000
    rows = events.select(
        F.col(key).cast("string").alias("key"), micros(F.col(at)).alias("at"), F.lit(0).alias("rank"),
        F.col(tie).cast("bigint").alias("tie"),
    )

    def judge(rows: DataFrame) -> DataFrame:
        done = admit(rows.withColumn("until", F.col("at") + span), limit)
        wait = F.when(~F.col("admitted"), retry_after(F.col("wait"))).alias("retry_after")
        return done.select("key", "at", F.lit(0).alias("rank"), "tie", F.struct("admitted", wait).alias("verdict"))

    def held(judged: DataFrame) -> DataFrame:
        last = judged.groupBy("key").agg(F.max("at").alias("_last"))
        admitted = _matched(judged.where("verdict.admitted"), last, "inner", "_last")
        return admitted.where(F.col("at") > F.col("_last") - span).drop("_last")

    def result(found: DataFrame) -> DataFrame:
        return found.select(F.col("key").alias(key), F.col("tie").alias(tie), "verdict.*")

    return Judged(rows, judge, held, result)


def stream_confirmations(events: DataFrame, ttl_seconds: int = CONFIRMATION_TTL_SECONDS) -> Judged:
    """Judge uses of one-time tokens on a stream of issues and uses, run by ``run_available``.

    ``events``: token, kind (``issue`` or ``use``), client, operation, ts, tie. The
    first issue of a token counts. Held are a token's issue and the use that consumed it.
    """
    rows = events.select(
        F.col("token").alias("key"), F.unix_micros("ts").alias("at"),
        F.when(F.col("kind") == "issue", 0).otherwise(1).alias("rank"), F.col("tie").cast("bigint").alias("tie"),
        "client", "operation",
    )

    def judge(rows: DataFrame) -> DataFrame:
        issues = rows.where("rank = 0").groupBy("key").agg(F.min_by(F.struct("at", "tie", "client", "operation"), _place()).alias("i"))
        uses = rows.where("rank = 1").select(F.col("tie").alias("use_id"), F.col("key").alias("token"), "client", "operation", "at")
        lives = issues.select(F.col("key").alias("token"), "i.client", "i.operation", "i.at")
        done = match_confirmations(lives, uses, ttl_seconds).select(F.col("use_id").alias("tie"), "verdict").distinct()
        first = issues.select("key", "i.at", F.lit(0).alias("rank"), "i.tie", "i.client", "i.operation", F.lit("issued").alias("verdict"))
        return rows.where("rank = 1").join(done, "tie").unionByName(first)

    def held(judged: DataFrame) -> DataFrame:
        return judged.where(F.col("verdict").isin("issued", "valid", "mismatch"))

    def result(found: DataFrame) -> DataFrame:
        return found.where("verdict <> 'issued'").select(F.col("tie").alias("use_id"), F.col("key").alias("token"), "verdict")

    return Judged(rows, judge, held, result)


def run_available(stream: Judged, label: str) -> DataFrame:
    """Run a stream over all input that is there now and read back its verdicts.

    Every table is written under its trigger's number, so a repeated trigger
    replaces what it wrote. A key that has had a row at or before the last one of
    an earlier trigger is late; from then on its rows are only logged, and at the
    end all its rows are judged together.
    """
    spark, schema = stream.rows.sparkSession, stream.rows.schema
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    done: dict[str, DataFrame] = {}

    def store(df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{out}/{name}/{batch}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def step(arrived: DataFrame, batch: int) -> None:
        arrived.write.mode("overwrite").parquet(f"{out}/log/{batch}")
        rows = spark.read.schema(schema).parquet(f"{out}/log/{batch}")
        span = rows.groupBy("key").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
        before, held = done.get("keys"), done.get("held")
        if before is None:
            done["keys"] = store(span.select("key", "last", F.lit(False).alias("late")), "keys", batch)
            now = store(stream.judge(rows), "judged", batch)
        else:
            seen = before.select("key", F.lit(None).cast(span.schema["first"].dataType).alias("first"), "last", "late", F.lit(False).alias("new"))
            both = seen.unionByName(span.select("key", "first", "last", F.lit(False).alias("late"), F.lit(True).alias("new")))
            old_last, first = F.max(F.when(~F.col("new"), F.col("last"))), F.max("first")
            late = F.max("late") | F.coalesce(first <= old_last, F.lit(False))
            done["keys"] = store(both.groupBy("key").agg(F.max("last").alias("last"), late.alias("late")), "keys", batch)
            behind = done["keys"].where("late")
            kept = _matched(held.drop("verdict"), span, "left_semi")
            now = store(stream.judge(_matched(rows.unionByName(kept), behind, "left_anti")), "all", batch)
            # What was held is at or before the key's last place.
            placed = _matched(now, before, "left", "last")
            store(placed.where(F.col("last").isNull() | (_place() > F.col("last"))).drop("last"), "judged", batch)
        holds = stream.held(now)
        if held is not None:
            holds = holds.unionByName(_matched(held, span, "left_anti"))
        done["held"] = store(holds, "held", batch)

    query = (
        stream.rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not done:
        return stream.result(stream.judge(spark.createDataFrame([], schema)))
    behind = done["keys"].where("late")
    judged = spark.read.schema(done["held"].schema).parquet(f"{out}/judged/*")
    again = stream.judge(_matched(spark.read.schema(schema).parquet(f"{out}/log/*"), behind, "left_semi"))
    return stream.result(_matched(judged, behind, "left_anti").unionByName(again))


def run_global_rate(
    events: DataFrame, at: str, label: str, limit: int = GLOBAL_LIMIT, window_seconds: int = WINDOW_SECONDS,
    slide_seconds: int = 60,
) -> DataFrame:
    """Events per sliding window of a stream, over all input that is there now.

    A trigger counts its own rows by slide and writes the counts under its number,
    so a repeated trigger replaces what it wrote. Counts add up, so nothing is
    kept from one trigger to the next, no row is late whatever its time, and the
    windows are made when the counts are read.
    """
    spark = events.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    spark.createDataFrame([], "slide bigint, n bigint").write.parquet(f"{out}/none")

    def count(rows: DataFrame, batch: int) -> None:
        slide_counts(rows, at, slide_seconds).write.mode("overwrite").parquet(f"{out}/{batch}")

    query = events.writeStream.foreachBatch(count).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("slide bigint, n bigint").parquet(f"{out}/*")
    return window_load(found, limit, window_seconds, slide_seconds)
