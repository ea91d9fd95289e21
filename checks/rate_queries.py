"""Registered queries over request limits, in batch and streaming form."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.run_queries import key_of
from salvor.operators import rates as R
from salvor.plans.workload import table
from salvor.streaming import guard

DAY = 86400
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def admission_sliding(spark, folder):
    done = R.sliding_admission(table(spark, folder, "events"), "user_id", "ts", "event_id", 2, DAY)
    return done.select(
        F.col("user_id").cast("bigint").alias("user_id"), "event_id", "admitted", "retry_after"
    )


def pending_confirmations(spark, folder):
    at = R.micros(F.col("ts"))
    issues = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), at.alias("at"), F.col("event_id").alias("tie"),
        F.least(at + 5 * DAY * 1_000_000, at + F.floor(F.col("value") * 3600) * 1_000_000).alias("until"),
    )
    return R.pending_confirmations(issues, 3)


def attempt_rate(spark, folder):
    return R.attempt_rate(table(spark, folder, "events"), "user_id", "ts", "event_id", DAY)


def cooldown_gap(spark, folder):
    """An operation lasts as many minutes as its value; a day of rest follows."""
    events = table(spark, folder, "events")
    end = F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.floor(F.col("value") * 60))
    return R.cooldown(events.withColumn("finished", end), "user_id", "ts", "event_id", DAY, "finished").select(
        F.col("user_id").cast("bigint").alias("user_id"), "event_id", "allowed", "retry_after"
    )


def token_events(events):
    """Views and clicks issue confirmations, other events use them; the first issue of
    a token counts. Two users share the token space, so some uses name another client."""
    kind = F.col("event_type")
    return events.select(
        F.concat_ws("-", F.floor(F.col("user_id") / 2).cast("string"), F.floor(key_of() / 10).cast("string")).alias("token"),
        F.when(kind.isin("view", "click"), "issue").otherwise("use").alias("kind"),
        F.col("user_id").cast("string").alias("client"),
        F.when(F.col("value") >= 4, "execute").otherwise("approve").alias("operation"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("tie"),
    )


def confirmation_match(spark, folder):
    rows = token_events(table(spark, folder, "events")).withColumn("at", F.unix_micros("ts"))
    issues = (
        rows.filter("kind = 'issue'").groupBy("token")
        .agg(F.min(F.struct("at", "tie", "client", "operation")).alias("i"))
        .select("token", "i.client", "i.operation", "i.at")
    )
    uses = rows.filter("kind = 'use'").select(F.col("tie").alias("use_id"), "token", "client", "operation", "at")
    return R.match_confirmations(issues, uses, 10 * DAY)


def global_rate(spark, folder):
    return R.global_rate(table(spark, folder, "events"), "ts", limit=3)


def _stream(spark, folder):
    # A glob may be one file or a folder of part files; a plain path must be a folder.
    return guard.read_files(spark, f"{folder}/events.parque[t]", EVENTS)


def stream_admission(spark, folder):
    done = guard.stream_admission(_stream(spark, folder), "user_id", "ts", "event_id", 2, DAY)
    return guard.run_available(done, "stream-admission").select(
        F.col("user_id").cast("bigint").alias("user_id"), "event_id", "admitted", "retry_after"
    )


def stream_confirmations(spark, folder):
    return guard.run_available(
        guard.stream_confirmations(token_events(_stream(spark, folder)), 10 * DAY), "stream-confirmations"
    )


def stream_global_rate(spark, folder):
    return guard.run_global_rate(_stream(spark, folder), "ts", "stream-rate", limit=3)


QUERIES = {
    f.__name__: f
    for f in (
        admission_sliding, pending_confirmations, attempt_rate, cooldown_gap, confirmation_match,
        global_rate, stream_admission, stream_confirmations, stream_global_rate,
    )
}
