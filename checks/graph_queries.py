"""Registered queries over the lineage catalog."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from salvor.operators import graph as G
from salvor.operators.skew import number_rows
from salvor.plans import compile as C
from salvor.plans import identity
from salvor.plans.workload import REGISTRY, SCOPE, SOURCE, asset_urn, catalog, table
from salvor.runtime import cut, shuffled


def graph_fingerprint(spark, folder):
    c = catalog(spark, folder)
    return identity.graph_digest(c.assets, c.edges, SOURCE)


def fingerprint_upkeep(spark, folder):
    """The fingerprint of the catalog from that of an earlier one, in which all assets were there and the
    edges into those that are not were still missing; only what changed since is hashed anew."""
    c = catalog(spark, folder)
    gone = F.col("availability") != "healthy"
    changed = c.assets.where(gone)
    ends = shuffled(changed.select(F.col("urn").alias("downstream_urn")).distinct())
    before = identity.graph_state(c.assets.withColumn("availability", F.lit("healthy")), c.edges.join(ends, "downstream_urn", "left_anti"))
    stored = identity.GraphState(cut(before.assets, "lanes"), cut(before.edges, "lanes"))
    after = identity.moved_graph(
        stored, changed, changed.withColumn("availability", F.lit("healthy")),
        c.edges.join(ends, "downstream_urn", "left_semi"), c.edges.where(F.lit(False)),
    )
    return identity.graph_state_digest(after, SOURCE)


def lineage_edges(spark, folder):
    return G.distinct_edges(catalog(spark, folder).edges).select("upstream_urn", "downstream_urn")


def lineage_roots(spark, folder):
    return G.lineage_roots(catalog(spark, folder).edges)


def upstream_groups(spark, folder):
    return catalog(spark, folder).edges.groupBy("downstream_urn").agg(
        F.count(F.lit(1)).alias("upstream_count"),
        F.min("upstream_urn").alias("first_upstream"),
        F.max("upstream_urn").alias("last_upstream"),
    )


def unknown_seeds(spark, folder):
    c = catalog(spark, folder)
    return G.unknown_seeds(C.normalize_requests(c.requests), c.assets)


def _known(c):
    requests = C.normalize_requests(c.requests)
    return requests.join(G.unknown_seeds(requests, c.assets).select("request_id"), "request_id", "left_anti")


def blast_radius(spark, folder):
    c = catalog(spark, folder)
    return G.blast_radius(G.request_seeds(_known(c)), c.graph)


def prerequisite_closure(spark, folder):
    c = catalog(spark, folder)
    return G.prerequisite_closure(G.blast_radius(G.request_seeds(_known(c)), c.graph), c.graph)


def target_parents(spark, folder):
    return catalog(spark, folder).book.parents.select(
        "request_id", "urn", "upstream_urn", F.col("up_availability").alias("availability"), "role"
    )


def recovery_waves(spark, folder):
    c = catalog(spark, folder)
    waves, _, _ = G.recovery_waves(c.book.targets, c.book.parents, c.graph)
    return waves.select("request_id", "urn", "wave")


def recovery_order(spark, folder):
    waves = catalog(spark, folder).book.waves.select("request_id", "urn", "order_key")
    return number_rows(waves, ["request_id"], ["order_key"], "position").drop("order_key")


def unresolved_prerequisites(spark, folder):
    return C.unresolved(catalog(spark, folder).book.parents)


def missing_adapters(spark, folder):
    return catalog(spark, folder).book.missing


def selection_evidence(spark, folder):
    book = catalog(spark, folder).book
    return C.selections(book.targets, book.parents)


def plan_selection(spark, folder):
    c = catalog(spark, folder)
    return C.plan_selections(c.assets, C.selections(c.book.targets, c.book.parents), "region-1")


def beyond_depth(spark, folder):
    c = catalog(spark, folder)
    return C.beyond_depth(c.book.requests, c.book.targets, c.graph)


def plan_verdicts(spark, folder):
    return catalog(spark, folder).book.plans.select(
        "request_id", "plan_id", "verdict", "target_count", "wave_count"
    )


def plan_details(spark, folder):
    """What each refused plan was refused for."""
    return catalog(spark, folder).book.plans.select("request_id", "verdict", "detail")


def scope_refusals(spark, folder):
    """The same plans under a scope that only takes suppliers."""
    c = catalog(spark, folder)
    narrow = replace(SCOPE, prefix=f"{SCOPE.prefix}s")
    book = C.compile_plans(c.requests, c.assets, c.edges, REGISTRY, narrow, c.fingerprint, c.graph)
    return book.plans.select("request_id", "verdict", "detail", "target_count")


def lineage_refusals(spark, folder):
    """The same plans when every region also feeds an asset that the catalog lacks."""
    c = catalog(spark, folder)
    region = table(spark, folder, "region")
    lost = region.select(
        asset_urn("region", F.col("r_regionkey")).alias("upstream_urn"),
        asset_urn("ghost", F.col("r_regionkey")).alias("downstream_urn"),
    )
    ends = ["upstream_urn", "downstream_urn"]
    dangling = G.dangling_pairs(c.assets, c.edges.select(ends).unionByName(lost))
    book = C.compile_plans(c.requests, c.assets, c.edges, REGISTRY, SCOPE, c.fingerprint, c.graph, dangling)
    return book.plans.select("request_id", "verdict", "detail", "target_count")


def step_ids(spark, folder):
    return catalog(spark, folder).book.steps.select("plan_id", "target_urn", "step_id", "idempotency_key")


def plan_steps(spark, folder):
    return catalog(spark, folder).book.steps.select(
        "plan_id", "step_id", "position", "wave", "target_urn", "adapter", "risk",
        "requires_approval", "dependency_count", "precondition_count",
    )


def step_dependencies(spark, folder):
    return catalog(spark, folder).book.dependencies


def healthy_preconditions(spark, folder):
    return catalog(spark, folder).book.preconditions


QUERIES = {
    f.__name__: f
    for f in (
        graph_fingerprint, fingerprint_upkeep, lineage_edges, lineage_roots, upstream_groups, unknown_seeds, blast_radius,
        prerequisite_closure, target_parents, recovery_waves, recovery_order, unresolved_prerequisites,
        missing_adapters, selection_evidence, plan_selection, beyond_depth, plan_verdicts, plan_details,
        scope_refusals, lineage_refusals, step_ids,
        plan_steps, step_dependencies, healthy_preconditions,
    )
}
