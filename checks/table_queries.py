"""Registered queries over tables: scans, sinks, rebuilds, digests, contracts, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from salvor import schemas
from salvor.functions.digests import default_kinds, lane_state, moved_state, multiset_digest, state_digest
from salvor.functions.scope import safe_run_name, scope_violations, urn_parts
from salvor.operators import builders as B
from salvor.operators import validate as V
from salvor.plans.workload import AS_OF, SCOPE, assets, table
from salvor.runtime import cut, scratch_path
from salvor.sources import documents, sinks, tables

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def raw_orders(spark, folder, as_of=None):
    where = None if as_of is None else F.col("o_orderdate") <= F.lit(as_of).cast("timestamp_ntz")
    columns = [
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
    ]
    return tables.scan_parquet(spark, f"{folder}/orders.parquet", columns, where)


def raw_customers(spark, folder):
    columns = [
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
    ]
    return tables.scan_parquet(spark, f"{folder}/customer.parquet", columns)


def snapshot_scan(spark, folder):
    return raw_orders(spark, folder)


def csv_scan(spark, folder):
    path = scratch_path(spark, "csv")
    raw_customers(spark, folder).write.option("header", True).csv(path)
    return tables.scan_csv(spark, path, "customer_id bigint, customer_name string, segment string")


def snapshot_sink(spark, folder):
    source, path = scratch_path(spark, "csv"), scratch_path(spark, "snapshot")
    raw_orders(spark, folder).write.option("header", True).csv(source)
    typed = tables.scan_csv(spark, source, "order_id bigint, customer_id bigint, amount double")
    sinks.write_snapshot(typed, path, ["order_id"])
    return spark.read.parquet(path)


def inline_values(spark, folder):
    forecast = tables.inline_values(
        spark, ["priority", "units"],
        [("1-URGENT", 42), ("2-HIGH", 17), ("3-MEDIUM", 11), ("4-NOT SPECIFIED", 5), ("5-LOW", 3)],
    )
    orders = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return orders.join(forecast, "priority").select(
        "priority", "orders", (F.col("orders") * F.col("units")).alias("forecast_units")
    )


def restore_as_of(spark, folder):
    """Orders as they were at a recovery point."""
    return B.stg_orders(raw_orders(spark, folder, AS_OF))


def stg_orders(spark, folder):
    return B.stg_orders(raw_orders(spark, folder))


def customer_revenue(spark, folder):
    return B.customer_revenue(raw_customers(spark, folder), stg_orders(spark, folder))


def _revenue_digest(spark, folder):
    return multiset_digest(customer_revenue(spark, folder)).first()["digest"]


def customer_value_feature(spark, folder):
    return B.customer_value(customer_revenue(spark, folder)).withColumn(
        "input_fingerprint", F.lit(_revenue_digest(spark, folder))
    )


def executive_dashboard(spark, folder):
    return B.executive_revenue(customer_revenue(spark, folder), _revenue_digest(spark, folder))


def model_record(spark, folder):
    """Measured by how often the value band agrees with a balance that is not negative."""
    records = B.customer_value(customer_revenue(spark, folder))
    fingerprint = multiset_digest(records).first()["digest"]
    truth = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_acctbal") >= 0).alias("solvent"))
    hit = ((F.col("value_band") == "high") == F.col("solvent")).cast("int")
    model = B.churn_model(records.join(truth, "customer_id"), fingerprint, F.avg(hit))
    return model.withColumn("accuracy", F.col("metrics")["accuracy"]).drop("metrics")


def table_fingerprint(spark, folder):
    out = None
    for name in TABLES:
        one = multiset_digest(table(spark, folder, name)).select(
            F.lit(name).alias("table_name"), "row_count", "digest"
        )
        out = one if out is None else out.unionByName(one)
    return out


def digest_upkeep(spark, folder):
    """Digests of orders by priority, kept up to date while orders arrive and open ones of old date are closed."""
    orders, by = table(spark, folder, "orders"), ["o_orderpriority"]
    late = F.col("o_orderdate") > F.lit(AS_OF).cast("timestamp_ntz")
    kinds = {c: k for c, k in default_kinds(orders).items() if c not in by}
    state = cut(lane_state(orders.where(~late), kinds, by), "lanes")
    state = cut(moved_state(state, orders.where(late), orders.where(F.lit(False)), kinds, by), "lanes")
    closed = orders.where((F.col("o_orderstatus") == "O") & ~late)
    state = moved_state(state, closed.withColumn("o_orderstatus", F.lit("F")), closed, kinds, by)
    return state_digest(state, list(kinds), by)


def idempotent_materialize(spark, folder):
    store = sinks.TableStore(spark, scratch_path(spark, "store"))
    rows = []
    for attempt in (1, 2):
        restored = store.materialize("raw.orders", raw_orders(spark, folder))
        staged = store.materialize("analytics.stg_orders", B.stg_orders(store.read("raw.orders")))
        revenue = store.materialize(
            "analytics.customer_revenue",
            B.customer_revenue(raw_customers(spark, folder), store.read("analytics.stg_orders")),
        )
        for made, adapter in ((restored, "snapshot_restore"), (staged, "sql_transform"), (revenue, "sql_transform")):
            rows.append((attempt, made.table_name, B.action_label(adapter, made.executed), made.row_count, made.digest))
    return spark.createDataFrame(
        rows, "attempt int, table_name string, action string, row_count bigint, digest string"
    )


def scope_check(spark, folder):
    return scope_violations(assets(spark, folder, mixed=True), SCOPE)


def urn_parse(spark, folder):
    return assets(spark, folder, mixed=True).select("urn", *urn_parts(F.col("urn")))


def run_names(spark, folder):
    names = (
        table(spark, folder, "pages").select(F.col("url").alias("run_id"))
        .unionByName(table(spark, folder, "customer").select(F.col("c_name").alias("run_id")))
        .unionByName(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("run_id")))
        .unionByName(table(spark, folder, "benchmark").select(F.col("text").alias("run_id")))
    )
    return names.groupBy("run_id").agg(F.count(F.lit(1)).alias("uses")).select(
        "run_id", "uses", safe_run_name(F.col("run_id")).alias("safe")
    )


def request_contract(spark, folder):
    part = table(spark, folder, "part")
    requests = part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("request_id"),
        F.col("p_name").alias("incident_type"),
        F.when(F.col("p_brand") == "Brand#2", F.array().cast("array<string>"))
        .otherwise(F.array("p_brand", "p_type", "p_brand")).alias("unavailable_asset_urns"),
        F.lit(None).cast("timestamp").alias("target_recovery_point"),
        F.when(F.col("p_size") > 5, F.col("p_size")).alias("max_blast_radius_depth"),
        F.when(F.col("p_type") == "PROMO", "demo").when(F.col("p_type") == "LARGE", "bold").alias("risk_mode"),
        F.when(F.col("p_retailprice") < 930, "").otherwise("duty-officer").alias("requester"),
    )
    bad = schemas.rejected_requests(schemas.normalize_requests(requests))
    return bad.select(
        "request_id", F.array_join("unavailable_asset_urns", ",").alias("seeds"),
        "max_blast_radius_depth", F.array_join("broken_rules", "; ").alias("broken_rules"),
    )


def duplicate_assets(spark, folder):
    named = table(spark, folder, "part").select(F.concat(F.lit("urn:part:"), F.col("p_name")).alias("urn"))
    return schemas.duplicate_urns(named)


EXPECTED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def validate_tables(spark, folder):
    facts = None
    for name in [*EXPECTED, "revenue"]:
        if name == "revenue":
            rules = V.RULES | {"revenue_below_a_million": "total_revenue < 1000000"}
            one = V.table_facts(customer_revenue(spark, folder), name, rule=list(rules), measure="total_revenue", rules=rules)
        else:
            one = V.table_facts(table(spark, folder, name), name, EXPECTED[name])
        facts = one if facts is None else facts.unionByName(one)
    # The digest claimed for a table comes from the table itself, but orders' from an older copy.
    older = V.table_facts(raw_orders(spark, folder, AS_OF), "orders").select("digest").first()[0]
    facts = facts.withColumn(
        "claimed_digest", F.when(F.col("target_urn") == "orders", older).otherwise(F.col("digest"))
    )
    checks = [
        ("exists", {}, True), ("schema", {}, True), ("row_count", {"minimum": "1500"}, True),
        ("row_count", {"minimum": "many"}, False), ("checksum", {}, True),
        ("business_rule", {"rule": "revenue_nonnegative"}, False), ("business_rule", {"rule": "other"}, False),
        ("business_rule", {"rule": "revenue_below_a_million"}, False),
        ("tidiness", {}, False),
    ]
    names = [*EXPECTED, "revenue", "warehouse"]
    rows = [(n, i, k, p, r) for n in names for i, (k, p, r) in enumerate(checks)]
    specs = spark.createDataFrame(
        rows, "target_urn string, pos int, kind string, parameters map<string,string>, required boolean"
    )
    return V.evaluate(specs, facts, F.lit("2024-02-01").cast("timestamp")).drop("evidence")


def rule_report(spark, folder):
    return V.rule_report(
        table(spark, folder, "lineitem"),
        {
            "quantity_positive": "l_quantity > 0",
            "discount_below_five_percent": "l_discount < 0.05",
            "ships_before_1998": "l_shipdate < timestamp_ntz'1998-01-01 00:00:00'",
            "known_flag": "l_returnflag IN ('A', 'N')",
        },
    )


def _artifacts(spark, folder):
    """Every event's properties and every document as an artifact."""
    events = table(spark, folder, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("target_urn"),
        F.concat(F.lit('{"input_fingerprint":"'), F.col("event_type"), F.lit('","metrics":'), F.col("props"), F.lit("}")).alias("document"),
        F.lit("click").alias("input_digest"),
        F.col("ts").cast("timestamp").alias("modified_at"),
    )
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("target_urn"),
        F.col("text").alias("document"), F.col("lang").alias("input_digest"),
        F.lit(None).cast("timestamp").alias("modified_at"),
    )
    return events.unionByName(docs).withColumn("present", F.lit(True))


def validate_artifacts(spark, folder):
    facts = _artifacts(spark, folder)
    checks = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).cast("map<string,string>").alias("parameters"),
                F.lit(required).alias("required"),
            )
            for kind, params, required in (
                ("artifact_load", {"as": "object"}, True),
                ("metric_threshold", {"metric": "k", "minimum": "50"}, True),
                ("metric_threshold", {"metric": "z", "minimum": "1"}, False),
                ("input_fingerprint", {"of": "input"}, False),
                ("freshness", {"maximum_age_seconds": "1296000"}, False),
            )
        ]
    )
    specs = facts.select("target_urn", F.posexplode(checks).alias("pos", "c")).select(
        "target_urn", "pos", "c.kind", "c.parameters", "c.required"
    )
    return V.evaluate(specs, facts, F.lit("2024-02-01").cast("timestamp"))


def artifact_checks(spark, folder):
    return validate_artifacts(spark, folder).drop("evidence")


def validation_gate(spark, folder):
    return V.gate(validate_artifacts(spark, folder), ["target_urn"])


def artifact_keys(spark, folder):
    found = _artifacts(spark, folder).select(documents.object_keys(F.col("document")).alias("k"))
    return found.groupBy(F.coalesce(F.array_join("k", ","), F.lit("not an object")).alias("keys")).agg(
        F.count(F.lit(1)).alias("artifacts")
    )


def event_freshness(spark, folder):
    return V.event_freshness(
        table(spark, folder, "events"), "ts", ["user_id"], F.lit("2024-01-31").cast("timestamp"), 86400.0
    )


def file_freshness(spark, folder):
    out = None
    for name in TABLES:
        one = documents.newest_change(spark, f"{folder}/{name}.parquet").select(
            F.lit(name).alias("table_name"), "modified_at"
        )
        out = one if out is None else out.unionByName(one)
    return out


def estate_state(spark, folder):
    """Wanted parts and suppliers against those that any order line names."""
    lines = table(spark, folder, "lineitem")
    label = lambda kind, col: F.concat(F.lit(f"{kind}."), F.col(col).cast("string")).alias("table_name")
    wanted = table(spark, folder, "part").select(label("part", "p_partkey")).unionByName(
        table(spark, folder, "supplier").select(label("supplier", "s_suppkey"))
    )
    used = lines.select(label("part", "l_partkey")).distinct().unionByName(
        lines.select(label("supplier", "l_suppkey")).distinct()
    )
    return B.inspect(wanted, used.withColumn("available", F.lit(True)))


def estate_counts(spark, folder):
    return B.inspect_counts(estate_state(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_scan, csv_scan, snapshot_sink, inline_values, stg_orders, restore_as_of, customer_revenue,
        customer_value_feature, executive_dashboard, model_record, table_fingerprint, digest_upkeep,
        idempotent_materialize, scope_check, urn_parse, run_names, request_contract, duplicate_assets,
        validate_tables, rule_report, artifact_checks, validation_gate, artifact_keys, event_freshness,
        file_freshness, estate_state, estate_counts,
    )
}
