"""Registered queries over run ledgers, approvals, receipts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from salvor.operators import catalog as CT
from salvor.operators import ledger as L
from salvor.operators.skew import number_rows
from salvor.plans.workload import asset_urn, catalog, table
from salvor.runtime import shuffled
from salvor.sources.sinks import receipt_verdicts


def key_of(props="props"):
    return F.get_json_object(props, "$.k").cast("int")


def event_ledger(spark, folder):
    """Events read as a run ledger: a run per user, ten steps per run."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "pending").when(kind == "error", "failed")
        .when(kind == "purchase", "verified").otherwise("running")
    )
    step = F.floor(key_of() / 10).cast("int")
    return table(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("step-"), step.cast("string")).alias("step_id"),
        asset_urn("step", step).alias("target_urn"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(kind == "error", "StepValidationFailure").alias("error_type"),
        F.when(kind == "error", F.col("props")).alias("error_detail"),
        F.when(kind == "purchase", "executed_sql_transform").alias("action"),
    )


def ledger_latest(spark, folder):
    return L.latest_steps(event_ledger(spark, folder)).select(
        "run_id", "step_id", "status", "attempts", "last_seq", "error_type", "error_detail", "action"
    )


def run_summary(spark, folder):
    return L.run_summary(L.latest_steps(event_ledger(spark, folder)))


def initial_ledger(spark, folder):
    steps = catalog(spark, folder).book.steps
    first = L.initial_ledger(steps, F.col("request_id"), F.lit("2024-02-01").cast("timestamp"))
    return first.select("run_id", "step_id", "target_urn", "seq", "status")


def resume_frontier(spark, folder):
    c = catalog(spark, folder)
    status = (
        F.when(F.col("availability") == "healthy", "verified")
        .when(F.col("availability") == "unavailable", "pending").otherwise("failed")
    )
    steps = c.book.targets.join(shuffled(c.assets.select("urn", "availability")), "urn").select(
        "request_id", F.col("urn").alias("step"), status.alias("status")
    )
    deps = c.book.parents.filter(F.col("role") == "dependency").select(
        "request_id", F.col("urn").alias("step"), F.col("upstream_urn").alias("needs")
    )
    return L.resume_frontier(steps, deps, ["request_id"])


def failure_records(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    failed = L.failure_event(docs, F.concat(F.lit("Error_"), F.col("lang")), F.col("text"))
    return failed.select("doc_id", "status", "error_type", "error_detail")


def inventory(spark, folder):
    customers = table(spark, folder, "customer").select(
        asset_urn("customer", F.col("c_custkey")).alias("urn"), (F.col("c_acctbal") >= 1000).alias("available")
    )
    suppliers = table(spark, folder, "supplier").select(
        asset_urn("supplier", F.col("s_suppkey")).alias("urn"), (F.col("s_acctbal") >= 1000).alias("available")
    )
    return customers.unionByName(suppliers)


def missing_preconditions(spark, folder):
    return L.missing_preconditions(catalog(spark, folder).book.preconditions, inventory(spark, folder))


def asset_health(spark, folder):
    return CT.asset_health(catalog(spark, folder).assets, inventory(spark, folder))


def inventory_after_outage(spark, folder):
    a = catalog(spark, folder).assets
    listed = a.select("urn", "platform")
    return CT.inventory_without(listed, a.filter(F.col("availability") == "unavailable"))


def approval_gate(spark, folder):
    plans = catalog(spark, folder).book.plans
    kind = F.split_part("request_id", F.lit("-"), F.lit(1))
    runs = plans.select(
        F.col("request_id").alias("run_id"), "plan_id",
        F.when(kind == "ghost", "older").otherwise(F.col("graph_fingerprint")).alias("graph_fingerprint"),
        F.when(F.col("target_count") % 2 == 0, "completed").otherwise("approved").alias("status"),
    )
    approvals = plans.filter(kind != "supplier").select(
        F.col("request_id").alias("run_id"),
        F.when(kind == "customer", "plan-other").otherwise(F.col("plan_id")).alias("approved_plan_id"),
        F.when(kind == "region", "   ").otherwise(F.concat(F.lit("  "), kind, F.lit("-officer "))).alias("approved_by"),
    )
    return L.approval_gate(runs, approvals, F.lit(catalog(spark, folder).fingerprint))


def context_evidence(spark, folder):
    runs = table(spark, folder, "customer").select(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("run_id"), F.lit("fp").alias("graph_fingerprint")
    )
    return L.context_evidence(runs, event_receipts(spark, folder))


def event_receipts(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
        F.when(kind.isin("purchase", "click", "view"), L.SLICE_OPERATION)
        .when(kind == "signup", CT.INVALIDATED).otherwise("other").alias("operation"),
        (F.col("value") >= 2).alias("verified"),
        F.when(key_of() < 85, "fp").otherwise("older").alias("fingerprint"),
        (kind != "error").alias("readable"),
        F.col("props").alias("body"),
    )


def writeback_outcomes(spark, folder):
    s = run_summary(spark, folder)
    n = F.col("attempts")
    runs = s.select(
        "run_id",
        F.when(F.col("verified_steps") >= 2, "completed").otherwise(F.col("status")).alias("status"),
        (n % 7 != 0).alias("has_credential"),
        F.when(n % 3 == 0, "verified").alias("previous"),
        (n % 2 == 0).alias("marker_seen"),
        F.when(n % 5 == 0, "CatalogError").alias("failure"),
    )
    return L.writeback_outcomes(runs)


def report_lines(spark, folder):
    steps = L.latest_steps(event_ledger(spark, folder))
    runs = L.run_summary(steps).select(
        "run_id", F.concat(F.lit("plan-"), F.col("run_id")).alias("plan_id"), "status",
        F.lit("fp").alias("graph_fingerprint"), F.lit("captured_datahub_fixture").alias("context_mode"),
        "verified_steps", "total_steps", F.lit("not_configured").alias("outcome"),
        F.lit(L.OUTCOME_TEXT["absent"]).alias("outcome_detail"),
        F.when(F.col("attempts") > 20, "duty-officer").alias("approved_by"),
    )
    placed = number_rows(steps, ["run_id"], ["step_id"], "position")
    checks = placed.select(
        "run_id", "position", F.lit(0).alias("pos"), (F.col("status") == "verified").alias("passed"),
        F.lit("exists").alias("kind"),
        F.when(F.col("status") == "verified", "target exists").otherwise("target is missing").alias("detail"),
    )
    waves = placed.select("run_id", F.ceil(F.col("position") / 3).cast("int").alias("wave"), "target_urn")
    return L.report_lines(runs, placed, checks, waves)


def receipt_conflicts(spark, folder):
    turns = table(spark, folder, "conversations").withColumn(
        "run_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    )
    incoming = turns.groupBy("run_id").agg(F.max_by("text", "turn").alias("body"))
    # Some runs come twice in the batch, with another body or with the same one.
    other = turns.filter(F.col("conv_id") % 4 == 0).groupBy("run_id").agg(F.min_by("text", "turn").alias("body"))
    incoming = incoming.unionByName(other).unionByName(incoming.filter(F.col("run_id").endswith("5")))
    stored = turns.filter(F.col("role") == "assistant").groupBy("run_id").agg(F.max_by("text", "turn").alias("body"))
    return receipt_verdicts(incoming, stored)


QUERIES = {
    f.__name__: f
    for f in (
        ledger_latest, run_summary, initial_ledger, resume_frontier, failure_records,
        missing_preconditions, asset_health, inventory_after_outage, approval_gate, context_evidence,
        writeback_outcomes, report_lines, receipt_conflicts,
    )
}
