"""Request limits over event tables: sliding admission, confirmations, cooldown, rates."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.operators.skew import running_sum
from salvor.runtime import cut

# The default limits.
CLIENT_LIMIT = 20
GLOBAL_LIMIT = 80
WINDOW_SECONDS = 600
COOLDOWN_SECONDS = 1
CONFIRMATION_TTL_SECONDS = 120
PENDING_LIMIT = 20

_RUN = (
    "part int, key string, at bigint, tie bigint, until bigint, admitted boolean, wait bigint, "
    "live array<bigint>, first_key string, first_at bigint"
)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def retry_after(wait: Column) -> Column:
    """Whole seconds until the oldest held place frees up, at least one."""
    return F.greatest(F.lit(1), F.ceil(wait / 1_000_000)).cast("bigint")


def admit_run(at: np.ndarray, until: np.ndarray, live: list[int], limit: int):
    """Admit events of one key in order while fewer than ``limit`` places are held.

    A place is held while its end lies after the current instant. ``live`` is a
    heap of ends and is updated in place. Returns (admitted, wait) arrays. Events
    that arrive while all places are held are skipped in one step.
    """
    admitted = np.zeros(len(at), dtype=bool)
    wait = np.zeros(len(at), dtype=np.int64)
    i = 0
    while i < len(at):
        while live and live[0] <= at[i]:
            heapq.heappop(live)
        if len(live) < limit:
            admitted[i] = True
            heapq.heappush(live, int(until[i]))
            i += 1
        else:
            free = max(i + 1, int(np.searchsorted(at, live[0], side="left")))
            wait[i:free] = live[0] - at[i:free]
            i = free
    return admitted, wait


def _first_pass(limit: int):
    """Admit all runs of one sorted range, starting with no place held.

    Reads Arrow batches one by one and keeps at most ``limit`` ends. The last row
    tells what the next range needs to know about this one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        key, live, first = None, [], None
        last_at = 0
        for batch in batches:
            if batch.empty:
                continue
            keys, at, until = batch["key"].to_numpy(), batch["at"].to_numpy(), batch["until"].to_numpy()
            if first is None:
                first = (keys[0], int(at[0]))
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            admitted, wait = [], []
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                if keys[lo] != key:
                    key, live = keys[lo], []
                a, w = admit_run(at[lo:hi], until[lo:hi], live, limit)
                admitted.append(a)
                wait.append(w)
            last_at = int(at[-1])
            yield batch.assign(
                part=part, admitted=np.concatenate(admitted), wait=np.concatenate(wait),
                live=None, first_key=None, first_at=None,
            )[_names()]
        if first is not None:
            yield _marker(part, key, last_at, live, first)

    return run


def _names() -> list[str]:
    return [f.strip().split(" ")[0] for f in _RUN.split(",")]


def _marker(part: int, key: str, at: int, live: list[int], first: tuple[str, int]) -> pd.DataFrame:
    held = sorted(x for x in live if x > at)
    row = dict(part=part, key=key, at=at, tie=None, until=None, admitted=None, wait=None,
               live=held, first_key=first[0], first_at=first[1])
    frame = pd.DataFrame([row], columns=_names())
    return frame.astype({"tie": "Int64", "until": "Int64", "wait": "Int64", "admitted": "boolean"})


def _again(limit: int):
    """Redo the first key of a range, now with the places held on entry."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "tie"])
        live = [int(x) for x in rows["held"].iloc[0]]
        heapq.heapify(live)
        admitted, wait = admit_run(rows["at"].to_numpy(), rows["until"].to_numpy(), live, limit)
        first = (rows["key"].iloc[0], int(rows["at"].iloc[0]))
        part = int(rows["part"].iloc[0])
        out = rows.assign(admitted=admitted, wait=wait, live=None, first_key=None, first_at=None)[_names()]
        return pd.concat([out, _marker(part, first[0], int(rows["at"].iloc[-1]), live, first)])

    return run


def admit(events: DataFrame, limit: int, parts: int | None = None) -> DataFrame:
    """Exact capacity admission per key over a whole table.

    ``events``: key string, at bigint, tie bigint (unique), until bigint (end of
    the place an admitted event holds). Adds ``admitted`` and ``wait`` (time until
    a place frees up, zero when admitted).

    Events are range-partitioned by (key, at, tie), so a heavy key is cut into
    consecutive ranges of ordinary size. All ranges run at once, each as if no
    place were held on entry. A range whose key continues from the range before
    is then redone with the places really held, until nothing changes. Only the
    held ends (at most ``limit`` numbers per range) reach the driver.
    """
    spark = events.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        events.select("key", "at", "tie", "until")
        .repartitionByRange(parts, "key", "at", "tie")
        .sortWithinPartitions("key", "at", "tie")
    )
    base = cut(ranged.mapInPandas(_first_pass(limit), _RUN), "admit")
    marks = {r["part"]: r for r in base.filter(F.col("live").isNotNull()).collect()}
    order = sorted(marks)
    assumed: dict[int, list[int]] = {p: [] for p in order}
    ends = {p: (marks[p]["key"], list(marks[p]["live"])) for p in order}
    redone: list[tuple[set[int], DataFrame]] = []
    while True:
        held: dict[int, list[int]] = {}
        for before, p in zip(order, order[1:]):
            key, live = ends[before]
            now = [x for x in live if x > marks[p]["first_at"]] if key == marks[p]["first_key"] else []
            if now != assumed[p]:
                held[p] = now
        if not held:
            break
        # One row per changed range, each with at most ``limit`` ends.
        rows = [(p, marks[p]["first_key"], live) for p, live in held.items()]
        entry = F.broadcast(spark.createDataFrame(rows, "part int, key string, held array<bigint>"))
        todo = base.filter(F.col("live").isNull()).select("part", "key", "at", "tie", "until")
        again = cut(
            todo.join(entry, ["part", "key"]).groupBy("part").applyInPandas(_again(limit), _RUN), "admit"
        )
        redone = [(done - set(held), frame) for done, frame in redone] + [(set(held), again)]
        for r in again.filter(F.col("live").isNotNull()).collect():
            if marks[r["part"]]["key"] == r["key"]:
                ends[r["part"]] = (r["key"], list(r["live"]))
        assumed.update(held)
    columns = ["key", "at", "tie", "until", "admitted", "wait"]
    out = base.filter(F.col("live").isNull())
    replaced = [(p, marks[p]["first_key"]) for done, _ in redone for p in done]
    if replaced:
        old = F.broadcast(spark.createDataFrame(replaced, "part int, key string"))
        out = out.join(old, ["part", "key"], "left_anti")
    out = out.select(*columns)
    for done, frame in redone:
        if done:
            valid = F.broadcast(spark.createDataFrame([(p,) for p in done], "part int"))
            kept = frame.filter(F.col("live").isNull()).join(valid, "part", "left_semi")
            out = out.unionByName(kept.select(*columns))
    return out


def sliding_admission(
    events: DataFrame, key: str, at: str, tie: str, limit: int = CLIENT_LIMIT,
    window_seconds: int = WINDOW_SECONDS, parts: int | None = None,
) -> DataFrame:
    """At most ``limit`` admitted per key in ``(now - window, now]``; rejected ones do not count."""
    us = micros(F.col(at))
    runs = events.select(
        F.col(key).cast("string").alias("key"), us.alias("at"), F.col(tie).cast("bigint").alias("tie"),
        (us + window_seconds * 1_000_000).alias("until"),
    )
    done = admit(runs, limit, parts)
    return done.select(
        F.col("key").alias(key), F.col("tie").alias(tie), "admitted",
        F.when(~F.col("admitted"), retry_after(F.col("wait"))).alias("retry_after"),
    )


def pending_confirmations(
    issues: DataFrame, limit: int = PENDING_LIMIT, parts: int | None = None
) -> DataFrame:
    """Which confirmations could be issued, with at most ``limit`` live per client.

    ``issues``: key, at, tie, until, where ``until`` is the expiry or the use that
    consumed the confirmation, whichever is first.
    """
    return admit(issues, limit, parts).select("key", "tie", "admitted")


def attempt_rate(
    events: DataFrame, key: str, at: str, tie: str, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """Number of attempts of the same key in ``(at - window, at]`` for every event.

    A count over a time range is a difference of two running counts. Each event
    adds two probes, one at its own instant and one at the window's start; one
    range-partitioned running sum answers all of them, so neither a heavy key nor
    a burst within one window is held in one task.
    """
    us = micros(F.col(at))
    rows = events.select(F.col(key).alias("key"), us.alias("at"), F.col(tie).alias("tie"))
    probes = F.explode(
        F.array(
            F.struct(F.lit(0).alias("kind"), F.col("at").alias("when")),
            F.struct(F.lit(1).alias("kind"), F.col("at").alias("when")),
            F.struct(F.lit(2).alias("kind"), (F.col("at") - window_seconds * 1_000_000).alias("when")),
        )
    )
    # At the same instant events (kind 0) come before the probes that count them.
    laid = rows.select("key", "tie", probes.alias("p")).select("key", "tie", "p.kind", "p.when")
    laid = laid.withColumn("rank", F.when(F.col("kind") == 0, 0).otherwise(1))
    counted = running_sum(
        laid, ["key"], ["when", "rank", "kind", "tie"], F.when(F.col("kind") == 0, 1).otherwise(0), "n"
    )
    return (
        counted.filter(F.col("kind") > 0)
        .groupBy("key", "tie")
        .agg(
            (F.max(F.when(F.col("kind") == 1, F.col("n"))) - F.max(F.when(F.col("kind") == 2, F.col("n"))))
            .alias("attempts")
        )
        .select(F.col("key").alias(key), F.col("tie").alias(tie), "attempts")
    )


def cooldown(
    events: DataFrame, key: str, at: str, tie: str, seconds: int = COOLDOWN_SECONDS, finished: str | None = None
) -> DataFrame:
    """Whether each operation starts ``seconds`` or more after the last admitted one finished.

    An operation that is refused holds nothing back. ``finished`` names the column
    with the end of an operation (its start, where it is not given); so this is
    admission with one place that is held until the end of the cooldown.
    """
    end = F.greatest(micros(F.col(finished)), micros(F.col(at))) if finished else micros(F.col(at))
    rows = events.select(
        F.col(key).cast("string").alias("key"), micros(F.col(at)).alias("at"), F.col(tie).alias("tie"), (end + seconds * 1_000_000).alias("until")
    )
    done = admit(rows, 1)
    return done.select(
        F.col("key").alias(key), F.col("tie").alias(tie), F.col("admitted").alias("allowed"),
        F.when(~F.col("admitted"), retry_after(F.col("wait"))).alias("retry_after"),
    )


def match_confirmations(
    issues: DataFrame, uses: DataFrame, ttl_seconds: int = CONFIRMATION_TTL_SECONDS
) -> DataFrame:
    """Judge every use of a one-time token.

    ``issues``: token (unique), client, operation, at; ``uses``: use_id, token,
    client, operation, at. A use is valid when it is the first one while the token
    lives (``issue <= use < issue + ttl``) and names the same client and operation;
    the first use consumes the token even when it names others. A token that is not
    issued yet, or whose life is over, is as unknown as one that never was.
    """
    lives = issues.select(
        "token", F.col("client").alias("_client"), F.col("operation").alias("_operation"),
        F.col("at").alias("_issued"),
    )
    j = uses.join(lives, "token", "left").withColumn(
        "_alive",
        F.coalesce(
            (F.col("at") >= F.col("_issued")) & (F.col("at") < F.col("_issued") + ttl_seconds * 1_000_000),
            F.lit(False),
        ),
    )
    first = (
        j.filter("_alive").groupBy("token").agg(F.min(F.struct("at", "use_id")).alias("f"))
        .select(F.col("f.use_id").alias("use_id"), F.lit(True).alias("_first"))
    )
    same = (F.col("client") == F.col("_client")) & (F.col("operation") == F.col("_operation"))
    verdict = (
        F.when(~F.col("_alive"), "unknown_token")
        .when(F.col("_first").isNull(), "replayed")
        .when(~same, "mismatch")
        .otherwise("valid")
    )
    return j.join(first, "use_id", "left").select("use_id", "token", verdict.alias("verdict"))


def slide_counts(events: DataFrame, at: str, slide_seconds: int = 60) -> DataFrame:
    """slide, n: events from every slide's start to the next one's; counts of parts add up."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    start = (us - F.pmod(us, F.lit(slide_seconds * 1_000_000))) / 1_000_000
    return events.select(start.cast("bigint").alias("slide")).groupBy("slide").agg(F.count(F.lit(1)).alias("n"))


def window_load(
    slides: DataFrame, limit: int = GLOBAL_LIMIT, window_seconds: int = WINDOW_SECONDS, slide_seconds: int = 60
) -> DataFrame:
    """Events in every sliding window from ``slide_counts``; a slide may have several rows."""
    starts = F.sequence(
        F.col("slide") - (window_seconds - slide_seconds), F.col("slide"), F.lit(slide_seconds).cast("bigint")
    )
    return (
        slides.select(F.explode(starts).alias("window_start"), "n")
        .groupBy("window_start")
        .agg(F.sum("n").alias("events"))
        .withColumn("over_limit", F.col("events") > limit)
    )


def global_rate(
    events: DataFrame, at: str, limit: int = GLOBAL_LIMIT, window_seconds: int = WINDOW_SECONDS,
    slide_seconds: int = 60,
) -> DataFrame:
    """Events in every sliding window, and whether they exceed the limit.

    Rows are first counted per slide; only those few counts are copied into the
    windows they belong to.
    """
    return window_load(slide_counts(events, at, slide_seconds), limit, window_seconds, slide_seconds)


__all__ = [
    "admit", "attempt_rate", "cooldown", "global_rate", "match_confirmations",
    "pending_confirmations", "retry_after", "slide_counts", "sliding_admission", "window_load",
]
