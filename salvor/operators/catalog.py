"""Catalog feed: metadata aspects, upserts, soft deletes, proofs, receipts, readiness, diff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.functions.digests import multiset_digest
from salvor.functions.scope import Scope, in_namespace, safe_run_name
from salvor.functions.text import json_array, json_bool, json_object, json_string
from salvor.operators.ledger import SLICE_OPERATION
from salvor.operators.skew import HUB_ROWS, find_hubs, first_per_group
from salvor.plans.identity import asset_json, validations_json
from salvor.runtime import cut_counted, shuffled

# Fixed value: results per root that a lineage read-back returns at most.
PAGE_LIMIT = 100
# Keys that must not occur in a stored payload, letters only.
SECRET_KEYS = [
    "apikey", "authorization", "cookie", "datahubtoken", "refreshtoken", "secret", "setcookie",
    "token", "accesstoken",
]
INVALIDATED = "datahub_vertical_slice_invalidated"
RESET = "datahub_fixture_reset"
# The texts of the evidence check, by verdict.
EVIDENCE_TEXT = {
    "missing": "verified DataHub vertical-slice receipt is missing",
    "unreadable": "DataHub vertical-slice receipt is unreadable or invalid",
    "invalidated": "DataHub vertical-slice evidence was invalidated by reset; run a fresh complete vertical slice",
    "unproven": "DataHub vertical-slice receipt does not prove this project",
    "unbound": "current fixture cannot be fingerprinted for evidence binding",
    "stale": "DataHub vertical-slice receipt is stale for the current fixture",
    "bad_paths": "DataHub vertical-slice receipt has invalid component paths",
    "component": "DataHub evidence component is missing: ",
    "ready": "seed, MCP context read, writeback, and reread receipt verified",
}
# Receipt components and their file names, in checking order.
COMPONENTS = {
    "seed_receipt_path": "datahub-seed-receipt.json",
    "context_receipt_path": "context-read-receipt.json",
    "writeback_receipt_path": "writeback-receipt.json",
}


@dataclass(frozen=True)
class CatalogNames:
    """URNs and words of one project's catalog entries."""

    domain_urn: str
    tag_urn: str
    marker_urn: str
    property_prefix: str = "estate"
    title: str = "Estate"

    @property
    def control_urns(self) -> list[str]:
        return [self.domain_urn, self.tag_urn, self.marker_urn]


def asset_properties(prefix: str) -> dict[str, Column]:
    """The eight text properties of an asset; nested values are JSON text."""
    c = F.col
    return {
        f"{prefix}.adapter": F.when(F.length("adapter") > 0, c("adapter")).otherwise("none"),
        f"{prefix}.adapter_parameters": F.coalesce("parameters_json", F.lit("{}")),
        f"{prefix}.artifact_type": c("artifact_type"),
        f"{prefix}.availability": c("availability"),
        f"{prefix}.platform": c("platform"),
        f"{prefix}.requires_approval": F.lower(json_bool(c("requires_approval"))),
        f"{prefix}.risk": c("risk"),
        f"{prefix}.validations": validations_json(c("validations")),
    }


def _tags(*tags: Column) -> Column:
    return json_object({"tags": json_array(F.array(*tags))})


def _tag(urn: str, context: Column | None = None) -> Column:
    fields = {"tag": json_string(F.lit(urn))}
    if context is not None:
        fields["context"] = json_string(context)
    return json_object(fields)


def aspect_feed(assets: DataFrame, edges: DataFrame, names: CatalogNames) -> DataFrame:
    """All aspects a seed writes: ``entity_urn, aspect_name, document, item_count``.

    Upstream lineage keeps only its size here; its entries are rows of
    ``lineage_items``, because a hub's list has no bound.
    """
    c = F.col
    props = asset_properties(names.property_prefix)
    properties = json_object(
        {
            "customProperties": json_object({k: json_string(v) for k, v in props.items()}),
            "description": json_string(
                F.concat(F.lit(f"{names.title} "), c("artifact_type"), F.lit(" recovery fixture."))
            ),
            "name": json_string(c("display_name")),
        }
    )
    owners = F.when(
        F.length("owner") > 0,
        json_object(
            {
                "owners": json_array(
                    F.array(json_object({"owner": json_string(c("owner")), "type": F.lit('"TECHNICAL_OWNER"')}))
                )
            }
        ),
    )
    one = lambda name, doc: F.struct(F.lit(name).alias("aspect_name"), doc.alias("document"))
    per_asset = assets.select(
        c("urn").alias("entity_urn"),
        F.explode(
            F.array(
                one("status", F.lit('{"removed":false}')),
                one("datasetProperties", properties),
                one("globalTags", _tags(_tag(names.tag_urn))),
                one("domains", json_object({"domains": json_array(F.array(json_string(F.lit(names.domain_urn))))})),
                one("ownership", owners),
            )
        ).alias("a"),
    ).select("entity_urn", "a.aspect_name", "a.document", F.lit(1).cast("bigint").alias("item_count"))
    lineage = edges.groupBy(c("downstream_urn").alias("entity_urn")).agg(
        F.count(F.lit(1)).alias("item_count")
    ).select("entity_urn", F.lit("upstreamLineage").alias("aspect_name"),
             F.lit('{"type":"TRANSFORMED"}').alias("document"), "item_count")
    lineage = lineage.join(shuffled(assets.select(c("urn").alias("entity_urn"))), "entity_urn", "left_semi")
    return per_asset.filter(c("document").isNotNull()).unionByName(lineage)


def control_aspects(spark, names: CatalogNames, domain: str, tag: str, marker: str) -> DataFrame:
    rows = [
        (names.domain_urn, "domainProperties", domain),
        (names.tag_urn, "tagProperties", tag),
        (names.marker_urn, "tagProperties", marker),
    ]
    df = spark.createDataFrame(rows, "entity_urn string, aspect_name string, name string")
    return df.select(
        "entity_urn", "aspect_name", json_object({"name": json_string(F.col("name"))}).alias("document"),
        F.lit(1).cast("bigint").alias("item_count"),
    )


def lineage_items(edges: DataFrame) -> DataFrame:
    """The entries of every upstream-lineage aspect, one row each."""
    return edges.select(
        F.col("downstream_urn").alias("entity_urn"), F.col("upstream_urn").alias("item_urn"),
        F.lit("TRANSFORMED").alias("item_type"),
    )


def latest_aspects(feed: DataFrame) -> DataFrame:
    """Upsert view: the last write of an aspect replaces it as a whole."""
    rest = [c for c in feed.columns if c not in ("entity_urn", "aspect_name")]
    newest = F.max_by(F.struct(*[F.col(c) for c in rest]), "seq").alias("w")
    return feed.groupBy("entity_urn", "aspect_name").agg(newest).select("entity_urn", "aspect_name", "w.*")


def soft_delete(assets: DataFrame, seq: Column, removed: bool = True) -> DataFrame:
    """Status aspects that hide assets or bring them back; writing one twice changes nothing."""
    document = '{"removed":true}' if removed else '{"removed":false}'
    return assets.select(
        F.col("urn").alias("entity_urn"), F.lit("status").alias("aspect_name"),
        F.lit(document).alias("document"), F.lit(1).cast("bigint").alias("item_count"), seq.alias("seq"),
    )


def active_assets(latest: DataFrame) -> DataFrame:
    removed = F.get_json_object("document", "$.removed") == "true"
    return latest.filter((F.col("aspect_name") == "status") & ~removed).select("entity_urn")


def writeback(targets: DataFrame, names: CatalogNames) -> DataFrame:
    """Tag aspects that mark verified runs. ``targets``: target_urn, run_id, seq."""
    document = _tags(_tag(names.tag_urn), _tag(names.marker_urn, F.col("run_id")))
    return targets.select(
        F.col("target_urn").alias("entity_urn"), F.lit("globalTags").alias("aspect_name"),
        document.alias("document"), F.lit(2).cast("bigint").alias("item_count"), "seq",
    )


def writeback_refusals(targets: DataFrame, assets: DataFrame, scope: Scope) -> DataFrame:
    """Write-backs that must not happen, with the first broken rule."""
    known = assets.select(F.col("urn").alias("target_urn"), F.lit(True).alias("_known"))
    reason = (
        F.when(~safe_run_name(F.col("run_id")), "invalid_run_id")
        .when(~in_namespace(F.col("target_urn"), scope.prefix), "outside_namespace")
        .when(F.col("_known").isNull(), "absent_from_catalog")
    )
    return (
        targets.join(known, "target_urn", "left")
        .select("target_urn", "run_id", reason.alias("reason"))
        .filter("reason IS NOT NULL")
    )


def verify_writeback(targets: DataFrame, latest: DataFrame, names: CatalogNames) -> DataFrame:
    """Re-read the tags of every target and look for the marker."""
    tags = latest.filter(F.col("aspect_name") == "globalTags").select(
        F.col("entity_urn").alias("target_urn"),
        F.from_json("document", "tags array<struct<tag:string,context:string>>").alias("d"),
    )
    seen = F.exists("d.tags", lambda t: t["tag"] == names.marker_urn)
    return targets.join(tags, "target_urn", "left").select(
        "target_urn", "run_id", F.coalesce(seen, F.lit(False)).alias("verified")
    )


def missing_entities(wanted: DataFrame, observed: DataFrame) -> DataFrame:
    """Wanted URNs that the read-back did not return."""
    return wanted.select("urn").join(observed.select("urn"), "urn", "left_anti")


def page_limit(advertised: int | None = None) -> int:
    return PAGE_LIMIT if advertised is None or advertised < 1 else min(PAGE_LIMIT, advertised)


def read_page(edges: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """The first ``limit`` downstream assets of every root, as a read-back returns them."""
    return first_per_group(
        edges.select("upstream_urn", "downstream_urn").distinct(), ["upstream_urn"],
        [F.col("downstream_urn")], limit,
    )


def unproven_edges(
    edges: DataFrame, observed: DataFrame, limit: int = PAGE_LIMIT, hub_rows: int = HUB_ROWS
) -> DataFrame:
    """Expected edges without an observation; ``truncated`` roots filled their page.

    A root with very many unproven edges is split into slots before the flag is joined.
    """
    pairs = ["upstream_urn", "downstream_urn"]
    missing, n = cut_counted(
        edges.select(*pairs).distinct().join(observed.select(*pairs), pairs, "left_anti"),
        "unproven",
        all=F.lit(True),
    )
    (hubs,) = find_hubs(missing, ["upstream_urn"], n["all"], hub_rows)
    full = observed.groupBy("upstream_urn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
    flags = hubs.spread(full.select("upstream_urn", F.lit(True).alias("truncated")), "upstream_urn", "slot")
    slotted = hubs.slot_of(missing, "upstream_urn", "downstream_urn", "slot")
    return slotted.join(flags, ["upstream_urn", "slot"], "left").select(
        *pairs, F.coalesce("truncated", F.lit(False)).alias("truncated")
    )


def context_receipt(
    wanted: DataFrame, seen_entities: DataFrame, edges: DataFrame, observed: DataFrame, fingerprint: Column
) -> DataFrame:
    """One row: what was proven by a context read, and the digest of the evidence."""
    entities = wanted.select("urn").join(
        seen_entities.select("urn", F.lit(1).alias("_seen")).distinct(), "urn", "left"
    ).agg(F.count(F.lit(1)).alias("asset_count"), F.count("_seen").alias("proven_assets"))
    pairs = ["upstream_urn", "downstream_urn"]
    lineage = edges.select(*pairs).distinct().join(
        observed.select(*pairs, F.lit(1).alias("_seen")).distinct(), pairs, "left"
    ).agg(F.count(F.lit(1)).alias("edge_count"), F.count("_seen").alias("proven_edges"))
    digest = multiset_digest(observed.select(*pairs)).select(F.col("digest").alias("evidence_digest"))
    # One row on every side.
    joined = entities.join(F.broadcast(lineage), F.lit(True)).join(F.broadcast(digest), F.lit(True))
    return joined.select(
        "*", fingerprint.alias("fingerprint"),
        ((F.col("asset_count") == F.col("proven_assets")) & (F.col("edge_count") == F.col("proven_edges")))
        .alias("verified"),
    )


def slice_receipts(parts: DataFrame, wanted: list[str]) -> DataFrame:
    """End-to-end verdict per run. ``parts``: run_id, operation, verified, seq (latest wins)."""
    newest = parts.filter(F.col("operation").isin(wanted)).groupBy("run_id", "operation").agg(
        F.max_by("verified", "seq").alias("verified")
    )
    return newest.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("operations"),
        (F.bool_and("verified") & (F.count(F.lit(1)) == len(wanted))).alias("verified"),
    )


def operation_state(receipts: DataFrame) -> DataFrame:
    """The latest receipt of every project and operation."""
    rest = [c for c in receipts.columns if c not in ("project", "operation")]
    return receipts.groupBy("project", "operation").agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), "seq").alias("r")
    ).select("project", "operation", "r.*")


def reset_receipts(resets: DataFrame) -> DataFrame:
    """Receipts of a catalog reset, in the order they are written.

    ``resets``: project, seq, error_type (null when the reset went through). The
    project's slice evidence is invalidated before anything changes, then the
    reset is started, then it completes or fails; a failed one may be half done.
    """
    failed = F.col("error_type").isNotNull()
    row = lambda n, operation, status: F.struct(
        (F.col("seq") + n).alias("seq"), F.lit(operation).alias("operation"), status.alias("status")
    )
    end = F.when(failed, "failed").otherwise("completed")
    rows = F.array(
        row(0, INVALIDATED, F.lit("invalidated")),
        row(1, RESET, F.lit("started")),
        row(2, RESET, end),
    )
    return resets.select("project", "error_type", F.explode(rows).alias("r")).select(
        "project", "r.seq", "r.operation", "r.status", (F.col("r.status") == "completed").alias("completed"),
        ((F.col("r.status") == "failed") & failed).alias("partial_mutation_possible"),
        F.when(F.col("r.status") == "failed", F.col("error_type")).alias("error_type"),
    )


def slice_evidence(receipts: DataFrame, projects: DataFrame, components: DataFrame) -> DataFrame:
    """Evidence check per project, by the first rule its newest slice receipt breaks.

    ``receipts``: project, named_project, operation, verified, fingerprint,
    readable, paths map<string,string>, seq; ``projects``: project, fingerprint
    (null for a catalog that has none), folder; ``components``: project, file_name (the files that exist).
    """
    newest = receipts.groupBy("project").agg(
        F.max_by(
            F.struct("named_project", "operation", "verified", "fingerprint", "readable", "paths"), "seq"
        ).alias("r")
    )
    known = components.filter(F.col("file_name").isin(list(COMPONENTS.values())))
    # At most one entry per known component name.
    files = known.groupBy("project").agg(F.collect_set("file_name").alias("files"))
    j = projects.join(newest, "project", "left").join(files, "project", "left")
    wrong_path = lambda key, name: ~F.try_element_at("r.paths", F.lit(key)).eqNullSafe(
        F.concat(F.col("folder"), F.lit("/" + name))
    )
    verdict = (
        F.when(F.col("r").isNull(), EVIDENCE_TEXT["missing"])
        .when(~F.coalesce("r.readable", F.lit(False)), EVIDENCE_TEXT["unreadable"])
        .when(
            (F.col("r.operation") == INVALIDATED) & (F.col("r.named_project") == F.col("project")),
            EVIDENCE_TEXT["invalidated"],
        )
        .when(
            ~(
                F.col("r.operation").eqNullSafe(F.lit(SLICE_OPERATION))
                & F.col("r.named_project").eqNullSafe(F.col("project"))
                & F.col("r.verified").eqNullSafe(F.lit(True))
            ),
            EVIDENCE_TEXT["unproven"],
        )
        .when(F.col("fingerprint").isNull(), EVIDENCE_TEXT["unbound"])
        .when(~F.col("r.fingerprint").eqNullSafe(F.col("fingerprint")), EVIDENCE_TEXT["stale"])
    )
    for key, name in COMPONENTS.items():
        verdict = verdict.when(wrong_path(key, name), EVIDENCE_TEXT["bad_paths"]).when(
            ~F.coalesce(F.array_contains("files", name), F.lit(False)), EVIDENCE_TEXT["component"] + name
        )
    detail = verdict.otherwise(EVIDENCE_TEXT["ready"])
    return j.select("project", (detail == EVIDENCE_TEXT["ready"]).alias("ready"), detail.alias("detail"))


def fixture_check(assets: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: is every asset in scope, and how many there are."""
    total = assets.agg(F.count(F.lit(1)).alias("n"))
    bad = violations.agg(F.count(F.lit(1)).alias("bad"))
    return total.join(F.broadcast(bad), F.lit(True)).select(
        F.lit("fixture").alias("check"), (F.col("bad") == 0).alias("ready"),
        F.when(F.col("bad") == 0, F.concat(F.lit("validated "), F.col("n").cast("string"), F.lit(" namespaced fixture assets")))
        .otherwise(F.lit("fixture is invalid or out of scope: NamespaceViolationError")).alias("detail"),
    )


def readiness(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Overall verdict: ready when every check is."""
    return checks.groupBy(*keys).agg(
        F.bool_and("ready").alias("ready"), F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("ready")).alias("failed_checks"),
    )


# A JSON string, and the colon behind it when it is a key. Possessive, so that a
# text with very many escapes is matched in a loop and not by recursion.
_JSON_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?)'


def _decoded(literal: Column) -> Column:
    """The text of a JSON string literal; one without an escape is not parsed."""
    plain = F.substr(literal, F.lit(2), F.length(literal) - 2)
    parsed = F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")
    return F.when(literal.contains("\\"), F.coalesce(F.get(parsed, 0), plain)).otherwise(plain)


def secret_screen(payloads: DataFrame, body: str, token: str | None = None) -> DataFrame:
    """Payloads with a forbidden key, or with the token inside a string value.

    Keys and values are compared as decoded text, however they are escaped.
    """
    strings = F.col("_strings")
    words = F.transform(
        F.filter(strings, lambda s: s.endswith(":")),
        lambda s: F.regexp_replace(F.lower(_decoded(F.regexp_replace(s, r"\s*:$", ""))), "[^a-z]", ""),
    )
    bad = F.array_sort(F.array_intersect(words, F.array(*[F.lit(k) for k in SECRET_KEYS])))
    leaked = F.lit(False)
    if token:
        leaked = F.exists(strings, lambda s: ~s.endswith(":") & _decoded(s).contains(F.lit(token)))
    keep = [c for c in payloads.columns if c != body]
    found = F.struct(F.array_join(bad, ",").alias("forbidden_keys"), leaked.alias("token_found"))
    # A filter over the finding would be pushed below it and scan every text twice;
    # a generator that gives no row for a clean payload scans it once.
    hits = F.filter(F.array(found), lambda f: (f["forbidden_keys"] != "") | f["token_found"])
    return (
        payloads.withColumn("_strings", F.regexp_extract_all(F.col(body), F.lit(_JSON_STRING), F.lit(1)))
        .select(*keep, F.explode(hits).alias("f"))
        .select(*keep, "f.forbidden_keys", "f.token_found")
    )


def graph_diff(old_assets: DataFrame, new_assets: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Added, removed and changed assets and edges between two snapshots.

    Records are compared by the first 16 bytes of their digest.
    """
    digest = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 32))

    def diff(old: DataFrame, new: DataFrame, keys: list[str], item: str) -> DataFrame:
        j = old.withColumnRenamed("h", "old_h").join(new.withColumnRenamed("h", "new_h"), keys, "full_outer")
        change = (
            F.when(F.col("old_h").isNull(), "added")
            .when(F.col("new_h").isNull(), "removed")
            .when(F.col("old_h") != F.col("new_h"), "changed")
        )
        cols = [F.col(keys[0]).alias("urn"), (F.col(keys[1]) if len(keys) > 1 else F.lit("")).alias("downstream_urn")]
        return j.select(F.lit(item).alias("item"), *cols, change.alias("change")).filter("change IS NOT NULL")

    def a(df: DataFrame) -> DataFrame:
        return df.select("urn", digest(asset_json()).alias("h"))

    def e(df: DataFrame) -> DataFrame:
        pairs = ["upstream_urn", "downstream_urn"]
        return df.groupBy(*pairs).agg(F.max(digest(F.to_json("evidence"))).alias("h"))

    return diff(a(old_assets), a(new_assets), ["urn"], "asset").unionByName(
        diff(e(old_edges), e(new_edges), ["upstream_urn", "downstream_urn"], "edge")
    )


def asset_health(assets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Graph nodes with what the inventory says about them; unknown means not available."""
    return assets.join(inventory.select("urn", "available"), "urn", "left").select(
        "urn", "display_name", "artifact_type", "owner",
        F.coalesce("available", F.lit(False)).alias("available"),
    )


def inventory_without(inventory: DataFrame, removed: DataFrame) -> DataFrame:
    """A new inventory version after assets were dropped."""
    return inventory.join(removed.select("urn"), "urn", "left_anti")
