"""Registered queries over the catalog feed: aspects, proofs, receipts, screens, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.run_queries import key_of
from salvor.functions.scope import scope_violations
from salvor.operators import catalog as CT
from salvor.operators.graph import cycle_core as core_of
from salvor.operators.graph import build_graph, one_cycle, recovery_waves, target_parents
from salvor.operators.ledger import SLICE_OPERATION
from salvor.plans.workload import SCOPE, SOURCE, asset_urn, assets, catalog, edges, table
from salvor.runtime import cut

NAMES = CT.CatalogNames(
    domain_urn="urn:li:domain:estate", tag_urn="urn:li:tag:estate-managed",
    marker_urn="urn:li:tag:estate-recovery-verified",
)


def aspect_feed(spark, folder):
    c = catalog(spark, folder)
    return CT.aspect_feed(c.assets, c.edges, NAMES)


def aspect_counts(spark, folder):
    controls = CT.control_aspects(spark, NAMES, SCOPE.domain, SCOPE.tag, "estate-recovery-verified")
    return aspect_feed(spark, folder).unionByName(controls).groupBy("aspect_name").agg(
        F.count(F.lit(1)).alias("aspects"), F.sum("item_count").alias("items")
    )


def lineage_items(spark, folder):
    return CT.lineage_items(catalog(spark, folder).edges)


def _status_feed(spark, folder):
    """Finished orders hide their customer, other orders bring it back."""
    orders = table(spark, folder, "orders").select(
        asset_urn("customer", F.col("o_custkey")).alias("urn"), "o_orderkey", "o_orderstatus"
    )
    gone = orders.filter(F.col("o_orderstatus") == "F")
    back = orders.filter(F.col("o_orderstatus") != "F")
    return CT.soft_delete(gone, F.col("o_orderkey")).unionByName(
        CT.soft_delete(back, F.col("o_orderkey"), removed=False)
    )


def aspect_latest(spark, folder):
    return CT.latest_aspects(_status_feed(spark, folder))


def active_assets(spark, folder):
    return CT.active_assets(CT.latest_aspects(_status_feed(spark, folder)))


def _writeback_targets(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(
        asset_urn("customer", F.col("o_custkey")).alias("target_urn"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderkey").alias("seq"),
    )


def writeback_verify(spark, folder):
    targets = _writeback_targets(spark, folder)
    plain = table(spark, folder, "orders").filter(F.col("o_orderstatus") != "F").select(
        asset_urn("customer", F.col("o_custkey")).alias("entity_urn"), F.lit("globalTags").alias("aspect_name"),
        F.lit('{"tags":[{"tag":"urn:li:tag:estate-managed"}]}').alias("document"),
        F.lit(1).cast("bigint").alias("item_count"), F.col("o_orderkey").alias("seq"),
    )
    latest = CT.latest_aspects(CT.writeback(targets, NAMES).unionByName(plain))
    return CT.verify_writeback(targets, latest, NAMES)


def writeback_refusals(spark, folder):
    targets = assets(spark, folder, mixed=True).filter(F.col("platform") == "part").select(
        F.col("urn").alias("target_urn"),
        F.when(F.col("availability") == "unavailable", F.col("display_name")).otherwise(
            F.concat(F.lit("run "), F.col("display_name"))
        ).alias("run_id"),
    )
    known = table(spark, folder, "lineitem").filter(F.col("l_quantity") == 50).select(
        asset_urn("part", F.col("l_partkey")).alias("urn")
    ).distinct()
    return CT.writeback_refusals(targets, known, SCOPE)


def writeback_gate(spark, folder):
    """Every asset and every requested seed as a target, the whole catalog as known."""
    c = catalog(spark, folder)
    name = F.when(F.col("owner").isNull(), F.concat(F.lit("run "), F.col("display_name"))).otherwise(F.col("display_name"))
    targets = assets(spark, folder, mixed=True).select(F.col("urn").alias("target_urn"), name.alias("run_id")).unionByName(
        c.requests.select(F.explode("unavailable_asset_urns").alias("target_urn"), F.col("request_id").alias("run_id"))
    )
    return CT.writeback_refusals(targets, c.assets.select("urn"), SCOPE)


def entity_evidence(spark, folder):
    c = catalog(spark, folder)
    seen = c.edges.select(F.col("downstream_urn").alias("urn")).distinct()
    return CT.missing_entities(c.assets, seen)


def lineage_page(spark, folder):
    return CT.read_page(catalog(spark, folder).edges, CT.page_limit(250))


def lineage_evidence(spark, folder):
    c = catalog(spark, folder)
    return CT.unproven_edges(c.edges, CT.read_page(c.edges))


def context_receipt(spark, folder):
    c = catalog(spark, folder)
    seen = c.edges.select(F.col("downstream_urn").alias("urn"))
    return CT.context_receipt(c.assets, seen, c.edges, CT.read_page(c.edges), F.lit(SOURCE))


def slice_receipts(spark, folder):
    names = {"purchase": "seed", "view": "context", "click": "writeback"}
    operation = F.lit(None).cast("string")
    for event, name in names.items():
        operation = F.when(F.col("event_type") == event, name).otherwise(operation)
    parts = table(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), operation.alias("operation"),
        (F.col("value") >= 2).alias("verified"), F.col("event_id").alias("seq"),
    )
    return CT.slice_receipts(parts, list(names.values()))


def operation_state(spark, folder):
    receipts = table(spark, folder, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("project"),
        F.col("event_type").alias("operation"), F.col("event_id").alias("seq"),
        F.when(F.col("value") >= 10, "completed").when(F.col("value") >= 2, "started").otherwise("failed").alias("status"),
    )
    return CT.operation_state(receipts)


def slice_evidence(spark, folder):
    events = table(spark, folder, "events")
    project = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    kind, k = F.col("event_type"), key_of()
    place = F.concat(F.lit("/receipts/"), project)
    paths = F.create_map(
        *[
            x
            for key, name in CT.COMPONENTS.items()
            for x in (F.lit(key), F.concat(F.when(k == 7, "/elsewhere").otherwise(place), F.lit("/" + name)))
        ]
    )
    receipts = events.select(
        project.alias("project"),
        F.when(k == 8, "someone").otherwise(project).alias("named_project"),
        F.when(kind == "signup", CT.INVALIDATED).otherwise(SLICE_OPERATION).alias("operation"),
        (F.col("value") >= 2).alias("verified"),
        F.when(k < 90, "fp").otherwise("older").alias("fingerprint"),
        (kind != "error").alias("readable"), paths.alias("paths"), F.col("event_id").alias("seq"),
    )
    projects = table(spark, folder, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("project"), F.lit("fp").alias("fingerprint"),
        F.concat(F.lit("/receipts/user-"), F.col("c_custkey").cast("string")).alias("folder"),
    )
    files = list(CT.COMPONENTS.values())
    name = F.when(k < 5, files[0]).when(k < 10, files[1]).when(k < 15, files[2]).otherwise("other.json")
    components = events.select(project.alias("project"), name.alias("file_name"))
    return CT.slice_evidence(receipts, projects, components)


def readiness(spark, folder):
    evidence = slice_evidence(spark, folder).select("project", F.lit("slice").alias("check"), "ready")
    ops = operation_state(spark, folder).select(
        "project", F.col("operation").alias("check"), (F.col("status") != "failed").alias("ready")
    )
    return CT.readiness(evidence.unionByName(ops), ["project"])


def fixture_check(spark, folder):
    out = None
    for mixed in (False, True):
        a = assets(spark, folder, mixed=mixed)
        one = CT.fixture_check(a, scope_violations(a, SCOPE)).withColumn("mixed", F.lit(mixed))
        out = one if out is None else out.unionByName(one)
    return out


def secret_screen(spark, folder):
    kind = F.col("event_type")
    name = (
        F.when(kind == "purchase", "Authorization").when(kind == "error", "set-cookie")
        .when(kind == "view", "API key").otherwise("note")
    )
    events = table(spark, folder, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("payload_id"),
        F.to_json(F.create_map(name, F.col("props"))).alias("body"),
    )
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("payload_id"),
        F.to_json(F.create_map(F.when(F.col("lang") == "es", "to_ken").otherwise(F.col("source")), F.col("text"))).alias("body"),
    )
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("payload_id"),
        F.to_json(F.create_map(F.col("role"), F.col("text"))).alias("body"),
    )
    # The same screen over bodies whose keys and values hold escapes.
    escaped = table(spark, folder, "customer").select(
        F.concat(F.lit("escaped-"), F.col("c_custkey").cast("string")).alias("payload_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit('{"\\u0074oken":"x"}'))
        .when(F.col("c_custkey") % 3 == 1, F.lit('{"to\\u00e9ken":"x"}'))
        .otherwise(F.concat(F.lit('{"note":"a \\u0074oken = \\" of '), F.col("c_name"), F.lit('"}'))).alias("body"),
    )
    return CT.secret_screen(events.unionByName(docs).unionByName(turns).unionByName(escaped), "body", 'token = "')


def graph_diff(spark, folder):
    date = F.col("o_orderdate")
    old = date <= F.lit("1998-06-30").cast("timestamp_ntz")
    new = date > F.lit("1996-06-30").cast("timestamp_ntz")
    calm = assets(spark, folder, orders_where=old).withColumn("risk", F.lit("low"))
    return CT.graph_diff(
        calm, assets(spark, folder, orders_where=new),
        edges(spark, folder, orders_where=old), edges(spark, folder, orders_where=new),
    )


def stale_plans(spark, folder):
    """Plans made stale when the first orders leave the catalog and the last ones come in."""
    from salvor.operators.graph import build_graph
    from salvor.plans import staleness
    from salvor.plans.compile import normalize_requests

    date, graphs = F.col("o_orderdate"), []
    for where in (date <= F.lit("2001-03-31").cast("timestamp_ntz"), date > F.lit("1995-03-31").cast("timestamp_ntz")):
        graphs.append(build_graph(assets(spark, folder, orders_where=where), edges(spark, folder, orders_where=where)))
    requests = normalize_requests(catalog(spark, folder).requests)
    return staleness.stale_plans(requests, staleness.select(requests, graphs[0]), *graphs)[0]


def dangling_edges(spark, folder):
    """The lineage still names orders that a point-in-time catalog does not have."""
    from salvor.operators.graph import dangling_pairs

    old = F.col("o_orderdate") <= F.lit("1998-06-30").cast("timestamp_ntz")
    found = dangling_pairs(assets(spark, folder, orders_where=old), catalog(spark, folder).edges)
    return found.select(
        "upstream_urn", "downstream_urn", F.array_join("missing_urns", ",").alias("missing_urns")
    )


def _closed_lineage(spark, folder):
    """The whole lineage closed by an edge from each region back to its poorest
    customer; one request covers all assets."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    c = catalog(spark, folder)
    back = (
        customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey").agg(F.min(F.struct("c_acctbal", "c_custkey")).alias("c"))
        .select(
            asset_urn("region", F.col("n_regionkey")).alias("upstream_urn"),
            asset_urn("customer", F.col("c.c_custkey")).alias("downstream_urn"),
        )
    )
    inner = c.edges.select("upstream_urn", "downstream_urn").unionByName(back)
    graph = build_graph(c.assets, inner)
    targets = c.assets.select(F.lit("all").alias("request_id"), "urn")
    parents = cut(target_parents(targets, graph), "parents")  # every round reads them
    _, stuck, _ = recovery_waves(targets, parents, graph)
    return core_of(stuck, parents, graph), parents, graph


def cycle_core(spark, folder):
    return _closed_lineage(spark, folder)[0]


def cycle_path(spark, folder):
    return one_cycle(*_closed_lineage(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        aspect_feed, aspect_counts, lineage_items, aspect_latest, active_assets, writeback_verify,
        writeback_refusals, writeback_gate, entity_evidence, lineage_page, lineage_evidence, context_receipt,
        slice_receipts, operation_state, slice_evidence, readiness, fixture_check, secret_screen,
        graph_diff, stale_plans, dangling_edges, cycle_core, cycle_path,
    )
}
