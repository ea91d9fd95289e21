"""DuckDB SQL for the run queries."""

from __future__ import annotations

from checks.graph_sql import CLOSURE, PARENTS, SEEDS, TO_PLANS, step, urn, with_

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
STEP_URN = urn("step", f"({K} // 10)")
LEDGER = (
    "ledger AS MATERIALIZED (SELECT 'run-' || user_id AS run_id, 'step-' || (" + K + " // 10) AS step_id, " + STEP_URN
    + " AS target_urn, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'failed' "
    "WHEN 'purchase' THEN 'verified' ELSE 'running' END AS status, "
    "CASE WHEN event_type = 'error' THEN 'StepValidationFailure' END AS error_type, "
    "CASE WHEN event_type = 'error' THEN props END AS error_detail, "
    "CASE WHEN event_type = 'purchase' THEN 'executed_sql_transform' END AS action FROM events), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, step_id ORDER BY seq DESC) AS rn, "
    "count(*) FILTER (status = 'running') OVER (PARTITION BY run_id, step_id) AS attempts FROM ledger), "
    "latest AS MATERIALIZED (SELECT run_id, step_id, target_urn, status, attempts, seq AS last_seq, error_type, error_detail, action "
    "FROM ranked WHERE rn = 1), "
    "summary AS MATERIALIZED (SELECT run_id, count(*) FILTER (status = 'verified') AS verified_steps, count(*) AS total_steps, "
    "CAST(sum(attempts) AS BIGINT) AS attempts, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' "
    "WHEN count(*) FILTER (status = 'verified') = count(*) THEN 'completed' "
    "WHEN count(*) FILTER (status IN ('running', 'verified')) > 0 THEN 'running' ELSE 'planned' END AS status "
    "FROM latest GROUP BY 1)"
)
INVENTORY = (
    f"SELECT {urn('customer', 'c_custkey')} AS urn, c_acctbal >= 1000 AS available FROM customer UNION ALL "
    f"SELECT {urn('supplier', 's_suppkey')}, s_acctbal >= 1000 FROM supplier"
)
SLICE = "judge_ready_datahub_vertical_slice"
ABSENT = "DATAHUB_TOKEN is absent; local recovery remains runnable"
VERIFIED = "supported globalTags writeback verified by immediate MCP reread"

_HEAD = [
    "'# Recovery Report'", "''", "'- Run: `' || run_id || '`'", "'- Plan: `plan-' || run_id || '`'",
    "'- Status: `' || status || '`'", "'- Graph fingerprint: `fp`'", "'- Context: `captured_datahub_fixture`'",
    "'- Verified steps: `' || verified_steps || '/' || total_steps || '`'", "'- DataHub outcome: `not_configured`'",
    "''", "'## Dependency waves'", "''",
]
_TAIL = [
    "''", "'## Safety and writeback'", "''",
    "'- Approval: `' || CASE WHEN attempts > 20 THEN 'duty-officer' ELSE 'missing' END || '`'",
    f"'- DataHub: {ABSENT}'", "'- Cloud actions: none; all execution targets are local and disposable.'", "''",
]


def _block(section: int, lines: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT run_id, {section} AS section, {i} AS pos, 0 AS sub, {line} AS line FROM summary"
        for i, line in enumerate(lines)
    )


REPORT = (
    "WITH " + LEDGER + ", placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_id) AS position "
    "FROM latest), waved AS (SELECT *, CAST(ceil(position / 3.0) AS INTEGER) AS wave FROM placed), "
    "named AS (SELECT *, row_number() OVER (PARTITION BY run_id, wave ORDER BY target_urn) AS member FROM waved) "
    "SELECT run_id, CAST(section AS INTEGER) AS section, CAST(pos AS BIGINT) AS pos, CAST(sub AS BIGINT) AS sub, line FROM ("
    + _block(1, _HEAD)
    + " UNION ALL SELECT run_id, 2, wave, member, CASE WHEN member = 1 THEN wave || '. ' ELSE ', ' END || '`' || target_urn || '`' FROM named"
    " UNION ALL " + _block(3, ["''", "'## Execution evidence'", "''"])
    + " UNION ALL SELECT run_id, 4, position, 0, '- `' || target_urn || '` — **' || status || '**, attempts `' || attempts || "
    "'`, action `' || coalesce(action, 'not produced') || '`' FROM placed"
    " UNION ALL SELECT run_id, 4, position, 1, '  - ' || CASE WHEN status = 'verified' THEN 'PASS `exists`: target exists' "
    "ELSE 'FAIL `exists`: target is missing' END FROM placed UNION ALL " + _block(5, _TAIL) + ")"
)

SQL = {
    "ledger_latest": "WITH " + LEDGER + " SELECT run_id, step_id, status, attempts, last_seq, error_type, error_detail, action FROM latest",
    "run_summary": "WITH " + LEDGER + " SELECT * FROM summary",
    "initial_ledger": with_(*TO_PLANS) + f"SELECT request_id AS run_id, {step('urn')} AS step_id, urn AS target_urn, "
    "CAST(0 AS BIGINT) AS seq, 'pending' AS status FROM targets JOIN ok USING (request_id)",
    "resume_frontier": with_(SEEDS, CLOSURE, PARENTS)
    + ", st AS (SELECT t.request_id, t.urn AS step, CASE a.availability WHEN 'healthy' THEN 'verified' "
    "WHEN 'unavailable' THEN 'pending' ELSE 'failed' END AS status FROM targets t JOIN assets a USING (urn)), "
    "o AS (SELECT p.request_id, p.urn AS step, count(*) FILTER (s.status <> 'verified') AS n FROM parents p JOIN st s "
    "ON s.request_id = p.request_id AND s.step = p.upstream_urn WHERE p.role = 'dependency' GROUP BY 1, 2) "
    "SELECT request_id, step, status, coalesce(n, 0) AS open_needs, CASE WHEN status = 'verified' THEN 'done' "
    "WHEN coalesce(n, 0) = 0 THEN 'ready' ELSE 'blocked' END AS frontier FROM st LEFT JOIN o USING (request_id, step)",
    "failure_records": "SELECT doc_id, 'failed' AS status, 'Error_' || lang AS error_type, substr(text, 1, 240) AS error_detail FROM documents",
    "missing_preconditions": with_(*TO_PLANS)
    + f"SELECT plan_id, {step('urn')} AS step_id, upstream_urn AS precondition_urn FROM parents JOIN ok USING (request_id) "
    f"WHERE role = 'precondition' AND upstream_urn NOT IN (SELECT urn FROM ({INVENTORY}) WHERE available)",
    "asset_health": with_() + f"SELECT a.urn, display_name, artifact_type, owner, coalesce(i.available, false) AS available "
    f"FROM assets a LEFT JOIN ({INVENTORY}) i USING (urn)",
    "inventory_after_outage": with_() + "SELECT urn, platform FROM assets WHERE availability <> 'unavailable'",
    "approval_gate": with_(*TO_PLANS)
    + ", r AS (SELECT v.request_id AS run_id, v.plan_id, split_part(v.request_id, '-', 1) AS kind, "
    "coalesce(t.n, 0) AS n FROM verdicts v LEFT JOIN (SELECT request_id, count(*) AS n FROM targets GROUP BY 1) t USING (request_id)) "
    "SELECT run_id, plan_id, CASE WHEN kind = 'supplier' THEN NULL WHEN kind = 'region' THEN '' ELSE kind || '-officer' END AS approved_by, "
    "CASE WHEN NOT regexp_full_match(run_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,79}') THEN 'invalid_run_id' "
    "WHEN kind = 'supplier' THEN 'approval_required' WHEN kind = 'customer' THEN 'approval_mismatch' "
    "WHEN kind = 'region' THEN 'approver_blank' WHEN kind = 'ghost' THEN 'stale' WHEN n % 2 = 0 THEN 'already_completed' "
    "ELSE 'go' END AS verdict FROM r",
    "context_evidence": "WITH r AS (SELECT 'run-' || user_id AS run_id, event_type, value, " + K + " AS k, props, row_number() OVER "
    "(PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events), j AS (SELECT 'run-' || c_custkey AS run_id, event_type, props, "
    "event_type IS NULL OR event_type = 'error' AS absent, coalesce(event_type IN ('purchase', 'click', 'view') AND value >= 2 AND k < 85, false) AS live "
    "FROM customer LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.run_id = 'run-' || c_custkey) "
    "SELECT run_id, 'fp' AS graph_fingerprint, CASE WHEN live THEN 'verified_live_datahub_mcp' ELSE 'captured_datahub_fixture' END AS mode, "
    "CASE WHEN live THEN sha256(props) END AS receipt_sha256, CASE WHEN live THEN 'bound to verified live DataHub MCP entity/lineage evidence' "
    "WHEN absent THEN 'compiled from the canonical captured DataHub graph; live receipt is unavailable in this local run' "
    "ELSE 'live receipt is missing, invalidated, or stale for this graph' END AS detail FROM j",
    "writeback_outcomes": "WITH " + LEDGER + ", w AS (SELECT run_id, attempts AS n, verified_steps >= 2 OR status = 'completed' AS done FROM summary) "
    "SELECT run_id, CASE WHEN NOT done THEN CASE WHEN n % 3 = 0 THEN 'verified' WHEN n % 7 <> 0 THEN 'pending' ELSE 'not_configured' END WHEN n % 3 = 0 THEN 'verified' "
    "WHEN n % 7 = 0 THEN 'not_configured' WHEN n % 5 = 0 THEN 'failed' WHEN n % 2 = 0 THEN 'verified' ELSE 'failed' END AS outcome, "
    f"CASE WHEN NOT done THEN CASE WHEN n % 3 = 0 THEN 'outcome so far: verified' WHEN n % 7 <> 0 THEN 'supported writeback will run after local verification' ELSE '{ABSENT}' END "
    f"WHEN n % 3 = 0 THEN '{VERIFIED}' WHEN n % 7 = 0 THEN 'local recovery verified; DATAHUB_TOKEN is absent so no live writeback was attempted' "
    f"WHEN n % 5 = 0 THEN 'writeback failed closed: CatalogError' WHEN n % 2 = 0 THEN '{VERIFIED}' "
    "ELSE 'writeback failed closed: WritebackVerificationError' END AS detail FROM w",
    "report_lines": REPORT,
    "receipt_conflicts": "WITH b AS (SELECT 'conv-' || conv_id AS run_id, arg_max(text, turn) AS body FROM conversations GROUP BY 1 UNION "
    "SELECT 'conv-' || conv_id, arg_min(text, turn) FROM conversations WHERE conv_id % 4 = 0 GROUP BY 1), "
    "i AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS bodies FROM b), "
    "s AS (SELECT 'conv-' || conv_id AS run_id, arg_max(text, turn) AS body FROM conversations WHERE role = 'assistant' GROUP BY 1) "
    "SELECT i.run_id, sha256(i.body) AS receipt_sha256, CASE WHEN s.body IS NULL AND bodies > 1 THEN 'conflict' WHEN s.body IS NULL THEN 'new' WHEN s.body = i.body THEN 'identical' "
    "ELSE 'conflict' END AS verdict FROM i LEFT JOIN s USING (run_id)",
}
