"""Registered queries over what sinks wrote, contracts, inventories and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.table_queries import TABLES, raw_customers, raw_orders
from salvor import schemas
from salvor.functions.text import json_string
from salvor.operators import builders as B
from salvor.operators import catalog as CT
from salvor.operators import validate as V
from salvor.plans.workload import assets, edges, table
from salvor.runtime import scratch_path
from salvor.sources import documents, sinks, tables

LEDGER = "run_id string, step_id string, seq bigint, status string, at timestamp, day date"


def full_order(spark, folder):
    """The first rows of the customers in the order of all columns, by place."""
    rows = tables.in_full_order(table(spark, folder, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"))
    path = scratch_path(spark, "ordered")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table_inventory(spark, folder):
    found = tables.table_inventory({name: table(spark, folder, name) for name in TABLES})
    counts = None
    for name in TABLES:
        one = table(spark, folder, name).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return found.join(counts, "table_name").select("table_name", F.array_join("columns", ",").alias("columns"), "row_count")


def missing_tables(spark, folder):
    """Parts that are wanted as tables against those that any order line names."""
    name = lambda c: F.concat(F.lit("part."), F.col(c).cast("string")).alias("table_name")
    wanted = table(spark, folder, "part").select(name("p_partkey"))
    there = table(spark, folder, "lineitem").filter(F.col("l_quantity") >= 49).select(name("l_partkey")).distinct()
    return tables.missing_tables(wanted, there)


def receipt_files(spark, folder):
    """Receipts written as JSON lines, with a broken line for every error, and read back."""
    kind, path = F.col("event_type"), scratch_path(spark, "receipts")
    run = F.concat(F.lit("run-"), F.col("user_id").cast("string"))
    good = F.to_json(F.struct(run.alias("run_id"), (F.col("value") >= 2).alias("verified"), kind.alias("operation")))
    lines = table(spark, folder, "events").select(F.when(kind == "error", F.concat(F.lit('{"run_id":'), run)).otherwise(good).alias("value"))
    lines.write.text(path)
    read = documents.read_receipts(spark, path, "run_id string, verified boolean, operation string")
    return read.groupBy("readable", "operation", "verified").agg(F.count(F.lit(1)).alias("receipts"), F.count_distinct("run_id").alias("runs"))


def receipt_store(spark, folder):
    path = scratch_path(spark, "receipts")
    turns = table(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("run_id"), F.col("text").alias("body"))
    sinks.write_receipts(turns, path)
    return spark.read.schema("run_id string, body string").json(path).select("run_id", F.sha2("body", 256).alias("sha256"))


def receipts_appended(spark, folder):
    """What is stored after a batch with new, known, repeated and contradicting receipts."""
    path = scratch_path(spark, "receipts")
    docs = table(spark, folder, "documents").select((F.col("doc_id") % 300).alias("k"), F.col("doc_id"), "source", "lang")
    body = lambda c: docs.select(F.concat(F.lit("run-"), F.col("k").cast("string")).alias("run_id"), c.alias("body"), "k", "doc_id")
    stored = body(F.col("source")).filter("k % 3 = 0").groupBy("run_id").agg(F.min("body").alias("body"))
    stored.write.parquet(path)
    incoming = body(F.when(F.col("k") % 2 == 0, F.lit("same")).otherwise(F.col("lang"))).select("run_id", "body")
    sinks.append_new_receipts(incoming, stored, path)
    return spark.read.schema("run_id string, body string").parquet(path)


def ledger_store(spark, folder):
    path = scratch_path(spark, "ledger")
    rows = table(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("step_id"),
        F.col("event_id").alias("seq"), F.lit("running").alias("status"), F.col("ts").cast("timestamp").alias("at"),
    )
    sinks.write_ledger(rows, path)
    back = spark.read.schema(LEDGER).parquet(path)
    return back.groupBy(F.col("day").cast("string").alias("day"), "step_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"))


def bundle_store(spark, folder):
    path = scratch_path(spark, "bundle")
    reports = table(spark, folder, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderstatus").alias("status"),
        F.lit("/home/me/report.json").alias("report_json_path"),
    )
    sinks.write_bundle(reports, path, "reports/report.json", "reports/report.md")
    schema = "run_id string, status string, report_json_path string, report_markdown_path string"
    return spark.read.schema(schema).json(path)


def document_store(spark, folder):
    """A report document is written once, and again when its content changes."""
    store, out = sinks.TableStore(spark, scratch_path(spark, "store")), []
    for attempt, where in enumerate(("true", "true", "o_orderstatus = 'F'"), start=1):
        count = table(spark, folder, "orders").filter(where).agg(F.count(F.lit(1)).alias("n"))
        made = store.write_document("reports.orders", count.select(F.concat(F.lit('{"orders":'), F.col("n").cast("string"), F.lit("}"))))
        out.append((attempt, made.executed, made.digest))
    return spark.createDataFrame(out, "attempt int, executed boolean, digest string")


def rebuild_evidence(spark, folder):
    """Every registered build over all orders and customers, twice."""
    estate = B.Estate(sinks.TableStore(spark, scratch_path(spark, "estate")), raw_orders(spark, folder), raw_customers(spark, folder), 0.5)
    rows = B.rebuild_all(estate, "first").withColumn("round", F.lit(1)).unionByName(B.rebuild_all(estate, "second").withColumn("round", F.lit(2)))
    return rows.select("round", "adapter", "action", "executed", "idempotency_key", "target", "output_sha256")


def step_checks(spark, folder):
    """One row per declared check of every asset."""
    found = assets(spark, folder).select(F.lit("plan").alias("plan_id"), F.col("urn").alias("step_id"), F.col("urn").alias("target_urn"), "validations")
    return V.step_specs(found).select("target_urn", "pos", "kind", "required")


def step_lookup(spark, folder):
    found = assets(spark, folder).select(F.col("urn").alias("target_urn"), "display_name", "adapter")
    return schemas.step_for_urn(found, "urn:li:dataset:(urn:li:dataPlatform:part,estate.part.7,PROD)")


def asset_contract(spark, folder):
    """Assets with faults put in: empty names, wrong states, risks and check kinds."""
    n = F.hash("urn")
    number = F.regexp_extract("display_name", r"(\d+)$", 1).try_cast("int")
    faulty = assets(spark, folder).withColumns({
        "platform": F.when(number % 11 == 0, "").otherwise(F.col("platform")),
        "availability": F.when(number % 7 == 0, "lost").otherwise(F.col("availability")),
        "risk": F.when(number % 5 == 0, "dire").otherwise(F.col("risk")),
    })
    bad = schemas.rejected_assets(faulty.filter(n.isNotNull()))
    return bad.select("urn", F.array_join("broken_rules", "; ").alias("broken_rules"))


def edge_contract(spark, folder):
    """Order lines as edges whose evidence names the wrong end for some quantities."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"), F.col("l_suppkey").cast("string").alias("supplier"), "l_quantity")
    up = F.when(F.col("l_quantity") != 13, F.col("part"))
    down = F.col("supplier")
    evidence = F.struct(
        F.lit("catalog").alias("source"), F.lit("lineage").alias("tool"),
        F.when(F.col("l_quantity") == 17, F.lit("other")).otherwise(F.col("part")).alias("upstream_urn"),
        F.when(F.col("l_quantity") > 48, F.lit(None)).otherwise(down).alias("downstream_urn"),
    )
    bad = schemas.rejected_edges(lines.select("l_orderkey", "l_linenumber", up.alias("upstream_urn"), down.alias("downstream_urn"), evidence.alias("evidence")))
    return bad.select("l_orderkey", "l_linenumber", F.array_join("broken_rules", "; ").alias("broken_rules"))


def catalog_resets(spark, folder):
    """A reset per event, failed where the event is an error."""
    resets = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("project"), (F.col("event_id") * 3).alias("seq"),
        F.when(F.col("event_type") == "error", "IOError").alias("error_type"),
    )
    return CT.reset_receipts(resets)


def json_texts(spark, folder):
    """Texts as JSON strings, by the digest of what they decode to again."""
    texts = table(spark, folder, "documents").select("doc_id", json_string(F.col("text")).alias("j"), "text")
    back = F.get(F.from_json(F.concat(F.lit("["), F.col("j"), F.lit("]")), "array<string>"), 0)
    return texts.select("doc_id", F.sha2(back, 256).alias("sha256"), F.col("j").contains("\n").alias("has_line_end"))


def lineage_rows(spark, folder):
    """The catalog's edges written as rows and read back by a reader that splits files."""
    from salvor.sources.catalog_json import read_edge_rows, write_edge_rows

    path = scratch_path(spark, "edges")
    write_edge_rows(edges(spark, folder), path)
    return read_edge_rows(spark, path).select("upstream_urn", "downstream_urn").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        full_order, table_inventory, missing_tables, receipt_files, receipt_store, receipts_appended, ledger_store,
        bundle_store, document_store, rebuild_evidence, step_checks, step_lookup, asset_contract, edge_contract,
        catalog_resets, json_texts, lineage_rows,
    )
}
