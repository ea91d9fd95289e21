"""Compile many recovery requests against one catalog snapshot.

Refusals are rows, not errors: a bad request never stops the others. Each plan
carries the first broken rule in a fixed order of precedence.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.functions.scope import Scope, scope_violations
from salvor.operators import graph as G
from salvor.operators.skew import number_rows
from salvor.plans import identity
from salvor.runtime import cut, cut_counted, shuffled, sized
from salvor.schemas import normalize_requests

# Refusal codes in order of precedence; ``ok`` comes last.
VERDICTS = [
    "out_of_scope",
    "invalid_lineage",
    "unknown_asset",
    "cycle",
    "missing_adapter",
    "unresolved_prerequisite",
    "ok",
]
# The reasons written for each selection decision.
REASONS = {
    "recovery_target": "selected outage asset or downstream impact",
    "healthy_precondition": "required upstream asset is healthy and must pass preflight",
    "excluded": "not connected to the selected outage scope",
}


class PlanRefused(ValueError):
    """Raised on demand for a refused plan; ``code`` is its verdict."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


def missing_adapters(targets: DataFrame, assets: DataFrame, registry: list[str]) -> DataFrame:
    """Targets whose adapter is absent or not registered."""
    problem = F.when(
        F.coalesce(F.length("adapter"), F.lit(0)) == 0, "recovery target has no adapter"
    ).when(~F.col("adapter").isin(registry), "adapter is not registered")
    bad = assets.select("urn", "adapter", problem.alias("problem")).filter("problem IS NOT NULL")
    return targets.select("request_id", "urn").join(shuffled(bad), "urn").select(
        "request_id", "urn", "adapter", "problem"
    )


def unresolved(parents: DataFrame) -> DataFrame:
    return parents.filter(F.col("role") == "unresolved").select(
        "request_id", "urn", F.col("upstream_urn").alias("prerequisite_urn"),
        F.col("up_availability").alias("availability"),
    )


def selections(targets: DataFrame, parents: DataFrame) -> DataFrame:
    """Targets and healthy preconditions of every request, with reasons.

    All other assets are excluded; ``excluded_assets`` lists them for one plan,
    because writing them for all would be requests times assets.
    """
    chosen = targets.select("request_id", "urn", F.lit("recovery_target").alias("decision"))
    healthy = (
        parents.filter(F.col("role") == "precondition")
        .select("request_id", F.col("upstream_urn").alias("urn"))
        .distinct()
        .withColumn("decision", F.lit("healthy_precondition"))
    )
    return chosen.unionByName(healthy).withColumn("reason", _reason(F.col("decision")))


def _reason(decision: Column) -> Column:
    return F.when(decision == "recovery_target", REASONS["recovery_target"]).when(
        decision == "healthy_precondition", REASONS["healthy_precondition"]
    ).otherwise(REASONS["excluded"])


def plan_selections(assets: DataFrame, chosen: DataFrame, request_id: str) -> DataFrame:
    """The decision for every asset of the snapshot for one plan."""
    mine = chosen.filter(F.col("request_id") == request_id).select("urn", "decision")
    return (
        assets.select("urn")
        .join(shuffled(mine), "urn", "left")
        .withColumn("decision", F.coalesce("decision", F.lit("excluded")))
        .withColumn("reason", _reason(F.col("decision")))
    )


def beyond_depth(requests: DataFrame, targets: DataFrame, graph: G.LineageGraph) -> DataFrame:
    """How many assets each request's depth limit cut off just past its edge."""
    edge = targets.join(
        requests.select("request_id", F.col("max_blast_radius_depth").alias("max_depth")), "request_id"
    ).filter(F.col("distance") == F.col("max_depth"))
    step = graph.up_hubs.spread(edge.select("request_id", "urn"), "urn", "slot")
    links = graph.known.select(
        F.col("upstream_urn").alias("urn"), F.col("up_slot").alias("slot"), "downstream_urn"
    )
    past = links.join(shuffled(step), ["urn", "slot"]).groupBy("request_id", F.col("downstream_urn").alias("urn")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        past.join(shuffled(targets.select("request_id", "urn")), ["request_id", "urn"], "left_anti")
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("beyond_depth"))
    )


@dataclass
class PlanBook:
    requests: DataFrame
    fingerprint: str
    targets: DataFrame
    parents: DataFrame
    waves: DataFrame
    cycles: DataFrame
    missing: DataFrame
    plans: DataFrame
    plan_count: int
    assets: DataFrame

    @cached_property
    def steps(self) -> DataFrame:
        """The ordered steps of accepted plans."""
        return _steps(self.ok, self.waves, self.parents, self.assets)

    @property
    def ok(self) -> DataFrame:
        """Accepted plans; broadcast only when the counted number of plans is small."""
        accepted = self.plans.filter(F.col("verdict") == "ok").select("request_id", "plan_id")
        return sized(accepted, self.plan_count)

    @property
    def selections(self) -> DataFrame:
        chosen = selections(self.targets, self.parents)
        return chosen.join(self.ok, "request_id").select("plan_id", *chosen.columns)

    @property
    def dependencies(self) -> DataFrame:
        """One row per (step, dependency), for plans that were accepted."""
        deps = self.parents.filter(F.col("role") == "dependency").join(self.ok, "request_id")
        return deps.select(
            "plan_id",
            identity.step_id(F.col("plan_id"), F.col("urn")).alias("step_id"),
            identity.step_id(F.col("plan_id"), F.col("upstream_urn")).alias("dependency_step_id"),
            F.col("upstream_urn").alias("dependency_urn"),
        )

    @property
    def preconditions(self) -> DataFrame:
        healthy = self.parents.filter(F.col("role") == "precondition").join(self.ok, "request_id")
        return healthy.select(
            "plan_id",
            identity.step_id(F.col("plan_id"), F.col("urn")).alias("step_id"),
            F.col("upstream_urn").alias("precondition_urn"),
        )

    def raise_on_refusal(self, request_id: str) -> None:
        row = self.plans.filter(F.col("request_id") == request_id).first()
        if row is None:
            raise KeyError(request_id)
        if row["verdict"] != "ok":
            raise PlanRefused(row["verdict"], row["detail"] or "")


def _first(df: DataFrame, *columns: str) -> str | None:
    row = df.select(*columns).orderBy(*columns).first()
    return None if row is None else str(row[0])


def compile_plans(
    requests: DataFrame,
    assets: DataFrame,
    edges: DataFrame,
    registry: list[str],
    scope: Scope,
    fingerprint: str,
    graph: G.LineageGraph | None = None,
    dangling_edges: DataFrame | None = None,
) -> PlanBook:
    """Verdicts, targets and order of all requests.

    ``dangling_edges`` are edges with an end that is no asset, where the caller
    knows them already, as from a check of the next catalog; otherwise the
    graph's own are looked up. One such edge, or one asset out of scope, refuses
    every plan.
    """
    requests = normalize_requests(requests)
    graph = graph or G.build_graph(assets, edges)
    outside = _first(scope_violations(assets, scope), "urn")
    if dangling_edges is None:
        dangling_edges = G.dangling_edges(graph)
    dangling = _first(dangling_edges, "upstream_urn", "downstream_urn")
    refused_all = outside is not None or dangling is not None

    unknown = G.unknown_seeds(requests, assets).groupBy("request_id").agg(
        F.array_join(F.sort_array(F.collect_list("urn")), ", ").alias("unknown")
    )
    unknown = cut(unknown, "unknown")
    usable = requests.join(unknown, "request_id", "left_anti")
    if refused_all:
        usable = usable.limit(0)

    reach = G.blast_radius(G.request_seeds(usable), graph)
    targets = G.prerequisite_closure(reach, graph)
    parents = cut(G.target_parents(targets, graph), "parents")
    waves, stuck, stuck_rows = G.recovery_waves(targets, parents, graph)
    cycles = G.cycle_core(stuck, parents, graph) if stuck_rows else stuck
    missing = missing_adapters(targets, assets, registry)

    counts = targets.groupBy("request_id").agg(F.count(F.lit(1)).alias("target_count"))
    depth = waves.groupBy("request_id").agg(F.max("wave").alias("wave_count"))
    on_cycle = cycles.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("cycle_size"), F.min("urn").alias("cycle_urn")
    )
    no_adapter = missing.groupBy("request_id").agg(
        F.min(F.struct("urn", "problem")).alias("bad_adapter")
    )
    # The first refused pair follows step order, then the prerequisite's URN.
    open_inputs = unresolved(parents).join(shuffled(waves), ["request_id", "urn"], "left").groupBy("request_id").agg(
        F.min(F.struct("order_key", "prerequisite_urn", "urn", "availability")).alias("open_input")
    )
    plans = identity.with_plan_id(requests, F.lit(fingerprint))
    for extra in (unknown, counts, depth, on_cycle, no_adapter, open_inputs):
        plans = plans.join(extra, "request_id", "left")
    verdict = (
        F.when(F.lit(outside is not None), "out_of_scope")
        .when(F.lit(dangling is not None), "invalid_lineage")
        .when(F.col("unknown").isNotNull(), "unknown_asset")
        .when(F.col("cycle_size").isNotNull(), "cycle")
        .when(F.col("bad_adapter").isNotNull(), "missing_adapter")
        .when(F.col("open_input").isNotNull(), "unresolved_prerequisite")
        .otherwise("ok")
    )
    detail = (
        F.when(F.lit(outside is not None), F.lit(outside))
        .when(F.lit(dangling is not None), F.lit(dangling))
        .when(F.col("unknown").isNotNull(), F.col("unknown"))
        .when(F.col("cycle_size").isNotNull(), F.col("cycle_urn"))
        .when(F.col("bad_adapter").isNotNull(), F.col("bad_adapter.urn"))
        .when(
            F.col("open_input").isNotNull(),
            F.concat_ws(
                " ", F.col("open_input.urn"), F.lit("requires"),
                F.col("open_input.prerequisite_urn"), F.lit("with state"),
                F.col("open_input.availability"),
            ),
        )
    )
    plans, n = cut_counted(
        plans.select(
            "request_id", "plan_id", F.lit(identity.COMPILER_VERSION).alias("compiler_version"),
            F.lit(fingerprint).alias("graph_fingerprint"), verdict.alias("verdict"),
            detail.alias("detail"), F.coalesce("target_count", F.lit(0)).alias("target_count"),
            F.coalesce("wave_count", F.lit(0)).alias("wave_count"),
        ),
        "plans",
        all=F.lit(True),
    )
    return PlanBook(
        requests, fingerprint, targets, parents, waves, cycles, missing, plans, n["all"], assets
    )


def _steps(ok: DataFrame, waves: DataFrame, parents: DataFrame, assets: DataFrame) -> DataFrame:
    ordered = number_rows(waves.join(ok, "request_id"), ["plan_id"], ["order_key"], "position")
    fan_in = parents.groupBy("request_id", "urn").agg(
        F.count_if(F.col("role") == "dependency").alias("dependency_count"),
        F.count_if(F.col("role") == "precondition").alias("precondition_count"),
    )
    plan, urn = F.col("plan_id"), F.col("urn")
    return (
        ordered.join(shuffled(fan_in), ["request_id", "urn"], "left")
        .join(
            shuffled(
                assets.select(
                    "urn", "adapter", "parameters_json", "validations",
                    F.coalesce("risk", F.lit("low")).alias("risk"),
                    F.coalesce("requires_approval", F.lit(False)).alias("requires_approval"),
                )
            ),
            "urn",
        )
        .select(
            "request_id", "plan_id", identity.step_id(plan, urn).alias("step_id"), "position",
            "wave", urn.alias("target_urn"), "adapter", "parameters_json", "validations", "risk",
            "requires_approval",
            F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"),
            F.coalesce("precondition_count", F.lit(0)).alias("precondition_count"),
            identity.idempotency_key(plan, identity.step_id(plan, urn)).alias("idempotency_key"),
        )
    )
