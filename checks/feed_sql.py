"""DuckDB SQL for the catalog feed queries."""

from __future__ import annotations

from checks.graph_sql import ASSET_DOC, CLOSURE, EDGES, PARENTS, REQUESTS, SEEDS, assets, digest, field, urn, with_

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def quoted(expr: str) -> str:
    return "'\"' || replace(replace(" + expr + ", '\\', '\\\\'), '\"', '\\\"') || '\"'"


_PROPERTIES = (
    "'{\"customProperties\":{\"estate.adapter\":\"' || coalesce(adapter, 'none') || '\",\"estate.adapter_parameters\":' || "
    + quoted("parameters_json") + " || ',\"estate.artifact_type\":\"' || artifact_type || '\",\"estate.availability\":\"' || "
    "availability || '\",\"estate.platform\":\"' || platform || '\",\"estate.requires_approval\":\"' || "
    "CAST(requires_approval AS VARCHAR) || '\",\"estate.risk\":\"' || risk || '\",\"estate.validations\":' || "
    + quoted("validations_json") + " || '},\"description\":\"Estate ' || artifact_type || ' recovery fixture.\",\"name\":\"' || "
    "display_name || '\"}'"
)
FEED = (
    "feed AS MATERIALIZED (SELECT urn AS entity_urn, 'status' AS aspect_name, '{\"removed\":false}' AS document, 1 AS item_count FROM assets "
    f"UNION ALL SELECT urn, 'datasetProperties', {_PROPERTIES}, 1 FROM assets "
    "UNION ALL SELECT urn, 'globalTags', '{\"tags\":[{\"tag\":\"urn:li:tag:estate-managed\"}]}', 1 FROM assets "
    "UNION ALL SELECT urn, 'domains', '{\"domains\":[\"urn:li:domain:estate\"]}', 1 FROM assets "
    "UNION ALL SELECT urn, 'ownership', '{\"owners\":[{\"owner\":\"' || owner || '\",\"type\":\"TECHNICAL_OWNER\"}]}', 1 FROM assets "
    "WHERE owner IS NOT NULL UNION ALL SELECT down, 'upstreamLineage', '{\"type\":\"TRANSFORMED\"}', count(*) FROM edges GROUP BY 1)"
)
CUSTOMER = urn("customer", "o_custkey")
STATUS = (
    f"last AS (SELECT {CUSTOMER} AS entity_urn, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS s "
    "FROM orders GROUP BY 1)"
)
PAGE = (
    "page AS MATERIALIZED (SELECT * FROM (SELECT up, down, row_number() OVER (PARTITION BY up ORDER BY down) AS place "
    "FROM (SELECT DISTINCT up, down FROM edges)) WHERE place <= 100)"
)
OPERATIONS = (
    "ops AS (SELECT 'user-' || user_id AS project, event_type AS operation, max(event_id) AS seq, arg_max(CASE WHEN value >= 10 "
    "THEN 'completed' WHEN value >= 2 THEN 'started' ELSE 'failed' END, event_id) AS status FROM events GROUP BY 1, 2)"
)
EVIDENCE = (
    "newest AS (SELECT * FROM (SELECT 'user-' || user_id AS project, event_type, value, " + K + " AS k, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1), "
    "files AS (SELECT 'user-' || user_id AS project, bool_or(" + K + " < 5) AS a, bool_or(" + K + " >= 5 AND " + K
    + " < 10) AS b, bool_or(" + K + " >= 10 AND " + K + " < 15) AS c FROM events GROUP BY 1), "
    "evidence AS (SELECT 'user-' || c_custkey AS project, CASE WHEN event_type IS NULL THEN 'verified DataHub vertical-slice receipt is missing' "
    "WHEN event_type = 'error' THEN 'DataHub vertical-slice receipt is unreadable or invalid' "
    "WHEN event_type = 'signup' AND k <> 8 THEN 'DataHub vertical-slice evidence was invalidated by reset; run a fresh complete vertical slice' "
    "WHEN event_type = 'signup' OR k = 8 OR value < 2 THEN 'DataHub vertical-slice receipt does not prove this project' "
    "WHEN k >= 90 THEN 'DataHub vertical-slice receipt is stale for the current fixture' "
    "WHEN k = 7 THEN 'DataHub vertical-slice receipt has invalid component paths' "
    "WHEN NOT a THEN 'DataHub evidence component is missing: datahub-seed-receipt.json' "
    "WHEN NOT b THEN 'DataHub evidence component is missing: context-read-receipt.json' "
    "WHEN NOT c THEN 'DataHub evidence component is missing: writeback-receipt.json' "
    "ELSE 'seed, MCP context read, writeback, and reread receipt verified' END AS detail FROM customer "
    "LEFT JOIN newest ON newest.project = 'user-' || c_custkey LEFT JOIN files ON files.project = 'user-' || c_custkey), "
    "judged AS (SELECT project, detail = 'seed, MCP context read, writeback, and reread receipt verified' AS ready, detail FROM evidence)"
)
BAD_KEYS = "['apikey','authorization','cookie','datahubtoken','refreshtoken','secret','setcookie','token','accesstoken']"


def _fixture(mixed: bool) -> str:
    bad = "coalesce(count(*) FILTER (NOT starts_with(split_part(urn, ',', 2), 'estate.') OR domain <> 'Retail / Estate' " \
        "OR NOT list_contains(tags, 'estate-managed')), 0)"
    return (
        f"SELECT 'fixture' AS \"check\", {bad} = 0 AS ready, CASE WHEN {bad} = 0 THEN 'validated ' || count(*) || "
        "' namespaced fixture assets' ELSE 'fixture is invalid or out of scope: NamespaceViolationError' END AS detail, "
        f"{str(mixed).lower()} AS mixed FROM ({assets(mixed=mixed)})"
    )


def _span(sql: str, where: str) -> str:
    """Restrict order rows and order edges of an asset or edge query to a date span."""
    lines = f"(SELECT lineitem.* FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE {where}) ON l_orderkey = o_orderkey)"
    return sql.replace("FROM orders", f"FROM (SELECT * FROM orders WHERE {where})").replace("FROM lineitem", f"FROM {lines}")


def _selected(where: str, rows: str) -> str:
    base = f"assets AS MATERIALIZED ({_span(assets(), where)}), edges AS MATERIALIZED ({_span(EDGES, where)}), requests AS MATERIALIZED ({REQUESTS})"
    return "WITH RECURSIVE " + ", ".join([base, SEEDS, CLOSURE, PARENTS]) + " SELECT * FROM " + rows


_WAS, _IS = "o_orderdate <= TIMESTAMP '2001-03-31'", "o_orderdate > TIMESTAMP '1995-03-31'"
STALE = (
    "WITH " + ", ".join(
        f"{side}_{rows} AS MATERIALIZED ({_selected(where, rows)})"
        for side, where in (("old", _WAS), ("new", _IS)) for rows in ("targets", "parents")
    )
    + ", d AS (SELECT coalesce(o.request_id, n.request_id) AS request_id, count(*) FILTER (o.urn IS NULL) AS targets_added, "
    "count(*) FILTER (n.urn IS NULL) AS targets_removed, count(*) FILTER (o.urn = n.urn AND o.distance IS DISTINCT FROM n.distance) "
    "AS distances_changed, 0 AS parents_added, 0 AS parents_removed, 0 AS roles_changed FROM old_targets o FULL JOIN new_targets n "
    "ON o.request_id = n.request_id AND o.urn = n.urn GROUP BY 1 UNION ALL SELECT coalesce(o.request_id, n.request_id), 0, 0, 0, "
    "count(*) FILTER (o.urn IS NULL), count(*) FILTER (n.urn IS NULL), "
    "count(*) FILTER (o.urn = n.urn AND (o.availability <> n.availability OR o.role <> n.role)) FROM old_parents o "
    "FULL JOIN new_parents n ON o.request_id = n.request_id AND o.urn = n.urn AND o.upstream_urn = n.upstream_urn GROUP BY 1) "
    "SELECT request_id, " + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}"
        for c in ("targets_added", "targets_removed", "distances_changed", "parents_added", "parents_removed", "roles_changed")
    )
    + " FROM d GROUP BY 1 HAVING greatest(sum(targets_added), sum(targets_removed), sum(distances_changed), sum(parents_added), "
    "sum(parents_removed), sum(roles_changed)) > 0"
)

CLOSED = (
    "back AS (SELECT " + urn("region", "n_regionkey") + " AS up, " + urn("customer", "c_custkey")
    + " AS down FROM (SELECT n_regionkey, c_custkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal, c_custkey) AS rn "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rn = 1), e AS (SELECT "
    + urn("customer", "c_custkey") + " AS up, " + urn("nation", "c_nationkey") + " AS down FROM customer UNION SELECT "
    + urn("nation", "n_nationkey") + ", " + urn("region", "n_regionkey") + " FROM nation UNION SELECT * FROM back)"
)
_OLD, _NEW = "o_orderdate <= TIMESTAMP '1998-06-30'", "o_orderdate > TIMESTAMP '1996-06-30'"

SQL = {
    "aspect_feed": with_(FEED) + "SELECT * FROM feed",
    "aspect_counts": with_(FEED) + "SELECT aspect_name, count(*) AS aspects, CAST(sum(item_count) AS BIGINT) AS items FROM ("
    "SELECT aspect_name, item_count FROM feed UNION ALL SELECT unnest(['domainProperties', 'tagProperties', 'tagProperties']), 1) GROUP BY 1",
    "lineage_items": with_() + "SELECT down AS entity_urn, up AS item_urn, 'TRANSFORMED' AS item_type FROM edges",
    "aspect_latest": "WITH " + STATUS + " SELECT entity_urn, 'status' AS aspect_name, '{\"removed\":' || (s = 'F') || '}' AS document, "
    "CAST(1 AS BIGINT) AS item_count, seq FROM last",
    "active_assets": "WITH " + STATUS + " SELECT entity_urn FROM last WHERE s <> 'F'",
    "writeback_verify": "WITH " + STATUS + f" SELECT {CUSTOMER} AS target_urn, 'run-' || o_orderkey AS run_id, s = 'F' AS verified "
    f"FROM orders JOIN last ON entity_urn = {CUSTOMER} WHERE o_orderstatus = 'F'",
    "writeback_refusals": "SELECT target_urn, run_id, reason FROM (SELECT "
    + urn("part", "p_partkey", "CASE WHEN p_size = 1 THEN 'foreign' ELSE 'estate' END")
    + " AS target_urn, CASE WHEN p_size % 10 = 0 THEN 'part.' || p_partkey ELSE 'run part.' || p_partkey END AS run_id, "
    "CASE WHEN p_size % 10 <> 0 THEN 'invalid_run_id' WHEN p_size = 1 THEN 'outside_namespace' WHEN p_partkey NOT IN "
    "(SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 'absent_from_catalog' END AS reason FROM part) WHERE reason IS NOT NULL",
    "writeback_gate": with_(SEEDS) + "SELECT target_urn, run_id, reason FROM (SELECT target_urn, run_id, CASE "
    "WHEN NOT regexp_full_match(run_id, '^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$') THEN 'invalid_run_id' "
    "WHEN NOT contains(target_urn, ',estate.') THEN 'outside_namespace' "
    "WHEN target_urn NOT IN (SELECT urn FROM assets) THEN 'absent_from_catalog' END AS reason FROM (SELECT urn AS target_urn, "
    "CASE WHEN owner IS NULL THEN 'run ' || display_name ELSE display_name END AS run_id FROM (" + assets(mixed=True)
    + ") UNION ALL SELECT urn, request_id FROM seeds)) WHERE reason IS NOT NULL",
    "entity_evidence": with_() + "SELECT urn FROM assets WHERE urn NOT IN (SELECT down FROM edges)",
    "lineage_page": with_(PAGE) + "SELECT up AS upstream_urn, down AS downstream_urn, CAST(place AS INTEGER) AS place FROM page",
    "lineage_evidence": with_(PAGE) + "SELECT up AS upstream_urn, down AS downstream_urn, up IN (SELECT up FROM page GROUP BY 1 "
    "HAVING count(*) >= 100) AS truncated FROM (SELECT DISTINCT up, down FROM edges EXCEPT SELECT up, down FROM page)",
    "context_receipt": with_(PAGE) + "SELECT *, 'retail-estate' AS fingerprint, asset_count = proven_assets AND edge_count = proven_edges AS verified "
    "FROM (SELECT (SELECT count(*) FROM assets) AS asset_count, (SELECT count(*) FROM assets WHERE urn IN (SELECT down FROM edges)) "
    "AS proven_assets, (SELECT count(*) FROM (SELECT DISTINCT up, down FROM edges)) AS edge_count, (SELECT count(*) FROM page) AS proven_edges, "
    "digest AS evidence_digest FROM (" + digest("page", {"upstream_urn": field("up"), "downstream_urn": field("down")}) + "))",
    "slice_receipts": "SELECT run_id, count(*) AS operations, bool_and(v) AND count(*) = 3 AS verified FROM (SELECT 'run-' || user_id AS run_id, "
    "event_type, arg_max(value >= 2, event_id) AS v FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1, 2) GROUP BY 1",
    "operation_state": "WITH " + OPERATIONS + " SELECT * FROM ops",
    "slice_evidence": "WITH " + EVIDENCE + " SELECT * FROM judged",
    "readiness": "WITH " + EVIDENCE + ", " + OPERATIONS + " SELECT project, bool_and(ready) AS ready, count(*) AS checks, "
    "count(*) FILTER (NOT ready) AS failed_checks FROM (SELECT project, ready FROM judged UNION ALL "
    "SELECT project, status <> 'failed' FROM ops) GROUP BY 1",
    "fixture_check": _fixture(False) + " UNION ALL " + _fixture(True),
    "secret_screen": "SELECT payload_id, word AS forbidden_keys, token_found FROM ("
    "SELECT 'event-' || event_id AS payload_id, CASE event_type WHEN 'purchase' THEN 'authorization' WHEN 'error' THEN 'setcookie' "
    "WHEN 'view' THEN 'apikey' ELSE '' END AS word, contains(props, 'token = \"') AS token_found FROM events UNION ALL "
    "SELECT 'doc-' || doc_id, CASE WHEN lang = 'es' THEN 'token' ELSE '' END, contains(text, 'token = \"') FROM documents UNION ALL "
    "SELECT 'turn-' || conv_id || '-' || turn, '', contains(text, 'token = \"') FROM conversations UNION ALL "
    "SELECT 'escaped-' || c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'token' ELSE '' END, c_custkey % 3 = 2 FROM customer) WHERE word <> '' OR token_found",
    "graph_diff": "WITH oa AS (SELECT urn, sha256(" + ASSET_DOC + ") AS h FROM (SELECT * REPLACE ('low' AS risk) FROM ("
    + _span(assets(), _OLD) + "))), na AS (SELECT urn, sha256(" + ASSET_DOC + ") AS h FROM (" + _span(assets(), _NEW) + ")), "
    "oe AS (SELECT DISTINCT up, down FROM (" + _span(EDGES, _OLD) + ")), ne AS (SELECT DISTINCT up, down FROM (" + _span(EDGES, _NEW) + ")) "
    "SELECT 'asset' AS item, coalesce(o.urn, n.urn) AS urn, '' AS downstream_urn, CASE WHEN o.urn IS NULL THEN 'added' "
    "WHEN n.urn IS NULL THEN 'removed' ELSE 'changed' END AS change FROM oa o FULL JOIN na n ON o.urn = n.urn "
    "WHERE o.h IS DISTINCT FROM n.h UNION ALL SELECT 'edge', up, down, 'added' FROM (SELECT * FROM ne EXCEPT SELECT * FROM oe) "
    "UNION ALL SELECT 'edge', up, down, 'removed' FROM (SELECT * FROM oe EXCEPT SELECT * FROM ne)",
    "stale_plans": STALE,
    "dangling_edges": "WITH a AS (SELECT urn FROM (" + _span(assets(), _OLD) + ")), e AS (SELECT DISTINCT up, down FROM (" + EDGES + ")) "
    "SELECT up AS upstream_urn, down AS downstream_urn, array_to_string(list_filter([CASE WHEN u.urn IS NULL THEN up END, "
    "CASE WHEN d.urn IS NULL THEN down END], lambda x: x IS NOT NULL), ',') AS missing_urns FROM e LEFT JOIN a u ON u.urn = up "
    "LEFT JOIN a d ON d.urn = down WHERE u.urn IS NULL OR d.urn IS NULL",
    "cycle_core": "WITH RECURSIVE " + CLOSED + ", walk(src, urn) AS (SELECT up, down FROM e UNION "
    "SELECT w.src, e.down FROM walk w JOIN e ON e.up = w.urn) SELECT 'all' AS request_id, urn FROM walk WHERE src = urn",
    "cycle_path": "WITH RECURSIVE " + CLOSED + ", walk(src, urn) AS (SELECT up, down FROM e UNION "
    "SELECT w.src, e.down FROM walk w JOIN e ON e.up = w.urn), core AS (SELECT urn FROM walk WHERE src = urn), "
    "f AS (SELECT up, min(down) AS next FROM e WHERE up IN (SELECT urn FROM core) AND down IN (SELECT urn FROM core) GROUP BY 1), "
    "p(pos, urn) AS (SELECT CAST(0 AS BIGINT), min(urn) FROM core UNION ALL SELECT pos + 1, next FROM p JOIN f ON up = urn "
    "WHERE next <> (SELECT min(urn) FROM core)) SELECT 'all' AS request_id, pos, urn FROM p",
}
