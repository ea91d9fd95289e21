"""DuckDB SQL for the queries over stored data and contracts."""

from __future__ import annotations

from checks.graph_sql import EDGES, VALIDATIONS, assets, digest
from checks.table_sql import COLUMNS, FEATURE, FEATURE_COLS, ORDER_COLS, REVENUE, REVENUE_COLS, STAGED

RUN = "'run-' || user_id"
_BROKEN = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '; ')"
_FAULTY = (
    "(SELECT *, TRY_CAST(regexp_extract(display_name, '(\\d+)$', 1) AS INTEGER) AS number FROM (" + assets() + "))"
)
_ASSET_RULES = _BROKEN.format(
    "CASE WHEN number % 11 = 0 THEN 'platform is empty' END, CASE WHEN number % 7 = 0 THEN 'availability is not allowed' END, "
    "CASE WHEN number % 5 = 0 THEN 'risk is not allowed' END"
)
_EDGE_RULES = _BROKEN.format(
    "CASE WHEN l_quantity = 13 THEN 'upstream_urn is missing' END, "
    "CASE WHEN l_quantity = 17 THEN 'evidence upstream_urn differs from the edge' END, "
    "CASE WHEN l_quantity > 48 THEN 'evidence downstream_urn differs from the edge' END"
)


def _checks() -> str:
    rows = []
    for kind, specs in VALIDATIONS.items():
        for pos, spec in enumerate(specs):
            name = spec.split('"kind":"')[1].split('"')[0]
            required = "false" if '"required":false' in spec else "true"
            rows.append(f"('{kind}', {pos}, '{name}', {required})")
    return "(VALUES " + ", ".join(rows) + ") s(platform, pos, kind, required)"


# What each build of the estate gives: adapter, parameter value, target, digest.
_REVENUE = digest(f"({REVENUE})", REVENUE_COLS)
_RECORDS = digest(f"({FEATURE})", FEATURE_COLS)
_FEATURE_DOC = (
    f"(SELECT '{{\"artifact\":\"features.customer_value\",\"input_fingerprint\":\"' || r.digest || '\",\"record_count\":' || f.row_count || "
    f"',\"records_digest\":\"' || f.digest || '\"}}' AS doc, f.row_count AS n FROM ({_REVENUE}) r, ({_RECORDS}) f)"
)
_MODEL_DOC = (
    "(SELECT '{\"algorithm\":\"deterministic_demo_threshold\",\"artifact\":\"models.churn_model\",\"input_fingerprint\":\"' || "
    f"sha256(doc || chr(10)) || '\",\"metrics\":{{\"accuracy\":0.5}},\"trained_records\":' || n || '}}' AS doc FROM {_FEATURE_DOC})"
)
_REPORT_DOC = (
    "(SELECT '{\"artifact\":\"dashboards.executive_revenue\",\"customer_count\":' || t.n || ',\"input_fingerprint\":\"' || r.digest || "
    "'\",\"total_revenue\":' || t.total || '}' AS doc FROM (SELECT count(*) AS n, "
    f"CAST(round(sum(CAST(total_revenue AS DECIMAL(28,6))), 2) AS DECIMAL(28,2)) AS total FROM ({REVENUE})) t, ({_REVENUE}) r)"
)
_BUILDS = [
    ("snapshot_restore", "raw.orders", "raw.orders", "restored_snapshot", f"SELECT digest FROM ({digest(f'({STAGED})', ORDER_COLS)})"),
    ("sql_transform", "stg_orders", "analytics.stg_orders", "executed_sql_transform", f"SELECT digest FROM ({digest(f'({STAGED})', ORDER_COLS)})"),
    ("sql_transform", "customer_revenue", "analytics.customer_revenue", "executed_sql_transform", f"SELECT digest FROM ({_REVENUE})"),
    ("python_build", "customer_value", "features.customer_value", "executed_python_build", f"SELECT sha256(doc || chr(10)) FROM {_FEATURE_DOC}"),
    ("python_build", "churn_model", "models.churn_model", "executed_python_build", f"SELECT sha256(doc || chr(10)) FROM {_MODEL_DOC}"),
    ("report_refresh", "executive_revenue", "dashboards.executive_revenue", "refreshed_report",
     f"SELECT sha256(regexp_replace(doc, '(\\.\\d)0\\}}$', '\\1}}') || chr(10)) FROM {_REPORT_DOC}"),
]
_EVIDENCE = " UNION ALL ".join(
    f"SELECT CAST({n} AS INTEGER) AS round, '{adapter}' AS adapter, '{action if n == 1 else 'reused_verified_output'}' AS action, "
    f"{'true' if n == 1 else 'false'} AS executed, '{key}:{value}' AS idempotency_key, '{target}' AS target, ({sql}) AS output_sha256"
    for n, key in ((1, "first"), (2, "second"))
    for adapter, value, target, action, sql in _BUILDS
)

SQL = {
    "full_order": "SELECT c_nationkey, c_mktsegment, c_custkey FROM customer ORDER BY ALL NULLS LAST",
    "table_inventory": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{','.join(columns)}' AS columns, (SELECT count(*) FROM {name}) AS row_count"
        for name, columns in COLUMNS.items()
    ),
    "missing_tables": "SELECT 'part.' || p_partkey AS table_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)",
    "receipt_files": f"SELECT event_type <> 'error' AS readable, CASE WHEN event_type <> 'error' THEN event_type END AS operation, "
    f"CASE WHEN event_type <> 'error' THEN value >= 2 END AS verified, count(*) AS receipts, "
    f"count(DISTINCT CASE WHEN event_type <> 'error' THEN {RUN} END) AS runs FROM events GROUP BY 1, 2, 3",
    "receipt_store": "SELECT conv_id || '-' || turn AS run_id, sha256(text) AS sha256 FROM conversations",
    "receipts_appended": "WITH d AS (SELECT doc_id % 300 AS k, 'run-' || (doc_id % 300) AS run_id, source, "
    "CASE WHEN doc_id % 300 % 2 = 0 THEN 'same' ELSE lang END AS body FROM documents), "
    "s AS (SELECT run_id, min(source) AS body FROM d WHERE k % 3 = 0 GROUP BY 1), "
    "f AS (SELECT run_id, min(body) AS body FROM d WHERE run_id NOT IN (SELECT run_id FROM s) GROUP BY 1 HAVING count(DISTINCT body) = 1) "
    "SELECT * FROM s UNION ALL SELECT * FROM f",
    "ledger_store": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS step_id, count(*) AS events, max(event_id) AS last_seq FROM events GROUP BY 1, 2",
    "bundle_store": "SELECT 'run-' || o_orderkey AS run_id, o_orderstatus AS status, 'reports/report.json' AS report_json_path, "
    "'reports/report.md' AS report_markdown_path FROM orders",
    "document_store": "WITH n AS (SELECT count(*) AS a, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders) "
    "SELECT CAST(t.attempt AS INTEGER) AS attempt, t.attempt <> 2 AS executed, "
    "sha256('{\"orders\":' || CASE WHEN t.attempt = 3 THEN f ELSE a END || '}' || chr(10)) AS digest FROM n, (VALUES (1), (2), (3)) t(attempt)",
    "rebuild_evidence": _EVIDENCE,
    "step_checks": f"SELECT a.urn AS target_urn, CAST(s.pos AS INTEGER) AS pos, s.kind, s.required FROM ({assets()}) a JOIN {_checks()} USING (platform)",
    "step_lookup": f"SELECT urn AS target_urn, display_name, adapter FROM ({assets()}) WHERE display_name = 'part.7'",
    "asset_contract": f"SELECT urn, broken_rules FROM (SELECT urn, {_ASSET_RULES} AS broken_rules FROM {_FAULTY}) WHERE broken_rules <> ''",
    "edge_contract": f"SELECT l_orderkey, l_linenumber, broken_rules FROM (SELECT l_orderkey, l_linenumber, {_EDGE_RULES} AS broken_rules FROM lineitem) WHERE broken_rules <> ''",
    "catalog_resets": "SELECT CAST(user_id AS VARCHAR) AS project, event_id * 3 + n AS seq, CASE n WHEN 0 THEN 'datahub_vertical_slice_invalidated' ELSE 'datahub_fixture_reset' END AS operation, "
    "CASE n WHEN 0 THEN 'invalidated' WHEN 1 THEN 'started' ELSE CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END END AS status, "
    "n = 2 AND event_type <> 'error' AS completed, n = 2 AND event_type = 'error' AS partial_mutation_possible, "
    "CASE WHEN n = 2 AND event_type = 'error' THEN 'IOError' END AS error_type FROM events, (VALUES (0), (1), (2)) t(n)",
    "json_texts": "SELECT doc_id, sha256(text) AS sha256, false AS has_line_end FROM documents",
    "lineage_rows": f"SELECT DISTINCT up AS upstream_urn, down AS downstream_urn FROM ({EDGES})",
}
