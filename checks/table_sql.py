"""DuckDB SQL for the table queries."""

from __future__ import annotations

from checks.graph_sql import assets, digest, field, moment, number, real, reals

AS_OF = "TIMESTAMP '1995-06-30'"
STAGED = "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders"
RESTORED = f"{STAGED} WHERE o_orderdate <= {AS_OF}"
REVENUE = (
    "SELECT c_custkey AS customer_id, c_name AS customer_name, "
    "CAST(round(coalesce(sum(CAST(amount AS DECIMAL(28,6))), 0), 2) AS DOUBLE) AS total_revenue "
    f"FROM customer LEFT JOIN ({STAGED}) ON c_custkey = customer_id GROUP BY 1, 2"
)
REVENUE_COLS = {
    "customer_id": number("customer_id"), "customer_name": field("customer_name"),
    "total_revenue": real("total_revenue"),
}
ORDER_COLS = {"order_id": number("order_id"), "customer_id": number("customer_id"), "amount": real("amount")}
FEATURE = (
    "SELECT customer_id, round(total_revenue, 2) AS lifetime_value, "
    f"CASE WHEN total_revenue >= 100 THEN 'high' ELSE 'standard' END AS value_band FROM ({REVENUE})"
)
FEATURE_COLS = {
    "customer_id": number("customer_id"), "lifetime_value": real("lifetime_value"),
    "value_band": field("value_band"),
}

_T, _M, _I, _N = field, real, moment, number
COLUMNS = {
    "region": {"r_regionkey": _N, "r_name": _T},
    "nation": {"n_nationkey": _N, "n_name": _T, "n_regionkey": _N},
    "customer": {"c_custkey": _N, "c_name": _T, "c_nationkey": _N, "c_acctbal": _M, "c_mktsegment": _T},
    "supplier": {"s_suppkey": _N, "s_name": _T, "s_nationkey": _N, "s_acctbal": _M},
    "part": {"p_partkey": _N, "p_name": _T, "p_brand": _T, "p_type": _T, "p_size": _N, "p_retailprice": _M},
    "orders": {"o_orderkey": _N, "o_custkey": _N, "o_orderstatus": _T, "o_totalprice": _M, "o_orderdate": _I,
               "o_orderpriority": _T},
    "lineitem": {"l_orderkey": _N, "l_partkey": _N, "l_suppkey": _N, "l_linenumber": _N, "l_quantity": _M,
                 "l_extendedprice": _M, "l_discount": _M, "l_tax": _M, "l_returnflag": _T, "l_linestatus": _T,
                 "l_shipdate": _I},
    "events": {"event_id": _N, "ts": _I, "user_id": _N, "event_type": _T, "value": _M, "props": _T},
    "documents": {"doc_id": _N, "text": _T, "lang": _T, "source": _T, "n_chars": _N},
    "embeddings": {"vec_id": _N, "embedding": reals, "label": _N},
    "pages": {"page_id": _N, "url": _T, "html": _T},
    "benchmark": {"item_id": _N, "text": _T},
    "labels": {"doc_id": _N, "quality": _N, "toxic": _N},
    "conversations": {"conv_id": _N, "turn": _N, "role": _T, "text": _T},
}


def _cols(name: str) -> dict[str, str]:
    return {c: kind(c) for c, kind in COLUMNS[name].items()}


def _digest_of(name: str) -> str:
    return digest(name, _cols(name))


_MADE = [
    ("raw.orders", "restored_snapshot", digest(f"({STAGED})", ORDER_COLS)),
    ("analytics.stg_orders", "executed_sql_transform", digest(f"({STAGED})", ORDER_COLS)),
    ("analytics.customer_revenue", "executed_sql_transform", digest(f"({REVENUE})", REVENUE_COLS)),
]
MATERIALIZE = " UNION ALL ".join(
    f"SELECT CAST({n} AS INTEGER) AS attempt, '{name}' AS table_name, "
    f"'{action if n == 1 else 'reused_verified_output'}' AS action, row_count, digest FROM ({sql})"
    for n in (1, 2)
    for name, action, sql in _MADE
)

RUN_RULE = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$"
URN_RULE = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,()]+),([^,()]+),([^,()]+)\)$"

EXPECTED = {
    "orders": "['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']",
    "customer": "['c_custkey','c_name','c_acctbal','c_nationkey','c_mktsegment']",
    "part": "['p_partkey','p_name','p_brand','p_type','p_size','p_retailprice']",
    "events": "['event_id','ts','user_id','event_type','value','props']",
    "documents": "['doc_id','text','lang','source','n_chars']",
}


def _table_fact(name: str) -> str:
    actual = f"(SELECT list(column_name) FROM (DESCRIBE SELECT * FROM {name}))"
    return (
        f"SELECT '{name}' AS target_urn, row_count, digest, CAST(NULL AS DOUBLE) AS least, "
        f"{actual} = {EXPECTED[name]} AS same_schema, CAST(NULL AS BIGINT) AS negative, CAST(NULL AS BIGINT) AS million FROM ({_digest_of(name)})"
    )


VALIDATE_TABLES = (
    "WITH facts AS (" + " UNION ALL ".join(_table_fact(n) for n in EXPECTED)
    + f" UNION ALL SELECT 'revenue', row_count, digest, (SELECT min(total_revenue) FROM ({REVENUE})), NULL, "
    f"(SELECT count(*) FROM ({REVENUE}) WHERE NOT total_revenue >= 0), "
    f"(SELECT count(*) FROM ({REVENUE}) WHERE NOT total_revenue < 1000000) FROM ({digest(f'({REVENUE})', REVENUE_COLS)})), "
    "claims AS (SELECT f.*, CASE WHEN target_urn = 'orders' THEN "
    f"(SELECT digest FROM ({digest(f'({RESTORED})', ORDER_COLS)})) ELSE digest END AS claimed FROM facts f), "
    "names AS (SELECT unnest(['orders','customer','part','events','documents','revenue','warehouse']) AS target_urn), "
    "specs AS (SELECT * FROM (VALUES (0,'exists',NULL,NULL,true),(1,'schema',NULL,NULL,true),(2,'row_count','1500',NULL,true),"
    "(3,'row_count','many',NULL,false),(4,'checksum',NULL,NULL,true),(5,'business_rule',NULL,'revenue_nonnegative',false),"
    "(6,'business_rule',NULL,'other',false),(7,'business_rule',NULL,'revenue_below_a_million',false),"
    "(8,'tidiness',NULL,NULL,false)) s(pos, kind, minimum, rule_name, required)), "
    "j AS (SELECT n.target_urn, s.pos, s.kind, s.required, s.minimum, s.rule_name, c.row_count, c.digest, c.claimed, "
    "c.least, c.same_schema, CASE rule_name WHEN 'revenue_nonnegative' THEN negative "
    "WHEN 'revenue_below_a_million' THEN million END AS broken FROM names n CROSS JOIN specs s LEFT JOIN claims c USING (target_urn)), "
    "e AS (SELECT *, CASE WHEN kind = 'schema' AND same_schema IS NULL THEN 'KeyError' "
    "WHEN kind IN ('row_count','checksum') AND row_count IS NULL THEN 'KeyError' "
    "WHEN kind = 'row_count' AND minimum = 'many' THEN 'ValueError' "
    "WHEN kind = 'business_rule' AND (row_count IS NULL OR broken IS NULL) THEN 'RuleNotRegistered' END AS err FROM j) "
    "SELECT target_urn, CAST(pos AS INTEGER) AS pos, kind, required, "
    "err IS NULL AND coalesce(CASE kind WHEN 'exists' THEN row_count IS NOT NULL WHEN 'schema' THEN same_schema "
    "WHEN 'row_count' THEN row_count >= TRY_CAST(minimum AS BIGINT) WHEN 'checksum' THEN digest = claimed "
    "WHEN 'business_rule' THEN broken = 0 ELSE false END, false) AS passed, "
    "CASE WHEN err IS NOT NULL THEN 'validation error: ' || err WHEN kind = 'exists' THEN "
    "CASE WHEN row_count IS NOT NULL THEN 'target exists' ELSE 'target is missing' END WHEN kind = 'schema' THEN "
    "CASE WHEN same_schema THEN 'schema matches' ELSE 'schema mismatch' END WHEN kind = 'row_count' THEN "
    "'row count ' || row_count || ' >= ' || minimum WHEN kind = 'checksum' THEN 'output checksum matches adapter evidence' "
    "WHEN kind = 'business_rule' THEN CASE WHEN broken = 0 AND rule_name = 'revenue_nonnegative' THEN "
    "'all customer revenue values are nonnegative' WHEN broken = 0 THEN 'no row breaks total_revenue < 1000000' "
    "ELSE broken || ' rows break ' || rule_name END "
    "ELSE 'unsupported validation kind: ' || kind END AS detail FROM e"
)

ARTIFACTS = (
    "artifacts AS (SELECT 'event-' || event_id AS target_urn, '{\"input_fingerprint\":\"' || event_type || "
    "'\",\"metrics\":' || props || '}' AS document, 'click' AS input_digest, ts AS modified_at FROM events "
    "UNION ALL SELECT 'doc-' || doc_id, text, lang, NULL FROM documents)"
)
ARTIFACT_CHECKS = (
    "WITH " + ARTIFACTS + ", specs AS (SELECT * FROM (VALUES (0,'artifact_load',NULL,NULL,true),"
    "(1,'metric_threshold','k',50.0,true),(2,'metric_threshold','z',1.0,false),(3,'input_fingerprint',NULL,NULL,false),"
    "(4,'freshness',NULL,1296000.0,false)) s(pos, kind, metric, floor_, required)), "
    "typed AS (SELECT *, CASE WHEN json_valid(document) THEN coalesce(json_type(document) = 'OBJECT', false) ELSE false END AS obj, "
    "greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(modified_at)) / 1000000.0) AS age FROM artifacts), "
    "safe AS (SELECT * REPLACE (CASE WHEN obj THEN document ELSE '{}' END AS document) FROM typed), "
    "j AS (SELECT t.*, s.*, TRY_CAST(json_extract_string(document, '$.metrics.' || metric) AS DOUBLE) AS v, "
    "json_extract_string(document, '$.input_fingerprint') AS fp FROM safe t CROSS JOIN specs s), "
    "e AS (SELECT *, CASE WHEN kind = 'freshness' AND modified_at IS NULL THEN 'FileNotFoundError' "
    "WHEN kind <> 'freshness' AND NOT obj THEN 'ValueError' WHEN kind = 'metric_threshold' AND v IS NULL THEN 'KeyError' "
    "WHEN kind = 'input_fingerprint' AND fp IS NULL THEN 'KeyError' END AS err FROM j), "
    "r AS (SELECT target_urn, CAST(pos AS INTEGER) AS pos, kind, required, err IS NULL AND CASE kind WHEN 'artifact_load' THEN "
    "len(json_keys(document)) > 0 WHEN 'metric_threshold' THEN v >= floor_ WHEN 'input_fingerprint' THEN fp = input_digest "
    "ELSE age <= floor_ END AS passed, CASE WHEN err IS NOT NULL THEN 'validation error: ' || err WHEN kind = 'artifact_load' "
    "THEN 'artifact loaded as JSON object' WHEN kind = 'metric_threshold' THEN metric || ' ' || printf('%.2f', v) || ' >= ' || "
    "printf('%.2f', CAST(floor_ AS DOUBLE)) WHEN kind = 'input_fingerprint' THEN 'report input fingerprint matches recovered revenue table' "
    "ELSE 'artifact age ' || printf('%.3f', age) || 's <= ' || printf('%.3f', CAST(floor_ AS DOUBLE)) || 's' END AS detail FROM e) "
)

SQL = {
    "snapshot_scan": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders",
    "csv_scan": "SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer",
    "snapshot_sink": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders",
    "inline_values": "SELECT o_orderpriority AS priority, count(*) AS orders, CAST(count(*) * any_value(units) AS BIGINT) "
    "AS forecast_units FROM orders JOIN (VALUES ('1-URGENT', 42), ('2-HIGH', 17), ('3-MEDIUM', 11), "
    "('4-NOT SPECIFIED', 5), ('5-LOW', 3)) f(priority, units) ON o_orderpriority = f.priority GROUP BY 1",
    "stg_orders": STAGED,
    "restore_as_of": RESTORED,
    "customer_revenue": REVENUE,
    "customer_value_feature": f"SELECT f.*, d.digest AS input_fingerprint FROM ({FEATURE}) f, "
    f"({digest(f'({REVENUE})', REVENUE_COLS)}) d",
    "executive_dashboard": "SELECT 'dashboards.executive_revenue' AS artifact, r.n AS customer_count, "
    "d.digest AS input_fingerprint, r.total AS total_revenue FROM (SELECT count(*) AS n, "
    f"CAST(round(sum(CAST(total_revenue AS DECIMAL(28,6))), 2) AS DOUBLE) AS total FROM ({REVENUE})) r, "
    f"({digest(f'({REVENUE})', REVENUE_COLS)}) d",
    "model_record": "SELECT 'models.churn_model' AS artifact, 'deterministic_demo_threshold' AS algorithm, "
    "digest AS input_fingerprint, row_count AS trained_records, (SELECT avg(CAST((value_band = 'high') = (c_acctbal >= 0) AS INTEGER)) "
    f"FROM ({FEATURE}) JOIN customer ON c_custkey = customer_id) AS accuracy "
    f"FROM ({digest(f'({FEATURE})', FEATURE_COLS)})",
    "table_fingerprint": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, row_count, digest FROM ({_digest_of(name)})" for name in COLUMNS
    ),
    "digest_upkeep": digest(
        f"(SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' AND o_orderdate <= {AS_OF} THEN 'F' ELSE o_orderstatus END "
        "AS o_orderstatus) FROM orders)",
        {c: kind for c, kind in _cols("orders").items() if c != "o_orderpriority"}, "o_orderpriority",
    ),
    "idempotent_materialize": MATERIALIZE,
    "scope_check": "SELECT urn, reason FROM (SELECT urn, CASE WHEN NOT (starts_with("
    f"regexp_extract(urn, '{URN_RULE}', 2), 'estate.') AND regexp_extract(urn, '{URN_RULE}', 2) <> 'estate.') "
    "THEN 'outside the namespace' WHEN domain <> 'Retail / Estate' THEN 'wrong domain' WHEN NOT "
    f"list_contains(tags, 'estate-managed') THEN 'lacks required tag' END AS reason FROM ({assets(mixed=True)})) "
    "WHERE reason IS NOT NULL",
    "urn_parse": f"SELECT urn, regexp_extract(urn, '{URN_RULE}', 1) AS platform_name, regexp_extract(urn, '{URN_RULE}', 2) "
    f"AS dataset_name, regexp_extract(urn, '{URN_RULE}', 3) AS environment FROM ({assets(mixed=True)})",
    "run_names": f"SELECT run_id, count(*) AS uses, regexp_full_match(run_id, '{RUN_RULE}') AS safe FROM ("
    "SELECT url AS run_id FROM pages UNION ALL SELECT c_name FROM customer UNION ALL SELECT o_orderpriority FROM orders "
    "UNION ALL SELECT text FROM benchmark) GROUP BY 1",
    "request_contract": "SELECT request_id, seeds, max_blast_radius_depth, array_to_string(broken, '; ') AS broken_rules FROM ("
    "SELECT 'part-' || p_partkey AS request_id, CASE WHEN p_brand = 'Brand#2' THEN '' ELSE least(p_brand, p_type) || ',' || "
    "greatest(p_brand, p_type) END AS seeds, CASE WHEN p_size > 5 THEN p_size ELSE 10 END AS max_blast_radius_depth, "
    "list_filter([CASE WHEN p_retailprice < 930 THEN 'requester is empty' END, "
    "CASE WHEN p_brand = 'Brand#2' THEN 'no unavailable asset' END, "
    "CASE WHEN p_size > 25 THEN 'max_blast_radius_depth is out of range' END, "
    "CASE WHEN p_type = 'LARGE' THEN 'risk_mode is not allowed' END], lambda x: x IS NOT NULL) AS broken FROM part) "
    "WHERE len(broken) > 0",
    "duplicate_assets": "SELECT 'urn:part:' || p_name AS urn, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1",
    "validate_tables": VALIDATE_TABLES,
    "rule_report": "SELECT rule, rows_checked, broken AS rows_broken, broken = 0 AND rows_checked > 0 AS passed FROM ("
    "SELECT count(*) AS rows_checked, count(*) FILTER (NOT l_quantity > 0) AS a, count(*) FILTER (NOT l_discount < 0.05) AS b, "
    "count(*) FILTER (NOT l_shipdate < TIMESTAMP '1998-01-01') AS c, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS d "
    "FROM lineitem), LATERAL (SELECT * FROM (VALUES ('quantity_positive', a), ('discount_below_five_percent', b), "
    "('ships_before_1998', c), ('known_flag', d)) v(rule, broken))",
    "artifact_checks": ARTIFACT_CHECKS + "SELECT * FROM r",
    "validation_gate": ARTIFACT_CHECKS + "SELECT target_urn, bool_and(passed OR NOT required) AS passed, count(*) AS checks, "
    "coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (required AND NOT passed)), ','), '') AS failed_required "
    "FROM r GROUP BY 1",
    "artifact_keys": "WITH " + ARTIFACTS + ", valid AS (SELECT CASE WHEN json_valid(document) THEN document ELSE '[]' END AS document "
    "FROM artifacts) SELECT keys, count(*) AS artifacts FROM (SELECT CASE WHEN json_type(document) = 'OBJECT' THEN "
    "array_to_string(list_sort(json_keys(document)), ',') ELSE 'not an object' END AS keys FROM valid) GROUP BY 1",
    "event_freshness": "SELECT user_id, age AS age_seconds, age <= 86400 AS passed FROM (SELECT user_id, greatest(0.0, "
    "(epoch_us(TIMESTAMP '2024-01-31') - max(epoch_us(ts))) / 1000000.0) AS age FROM events GROUP BY 1)",
    "estate_state": "SELECT 'part.' || p_partkey AS table_name, p_partkey IN (SELECT l_partkey FROM lineitem) AS available "
    "FROM part UNION ALL SELECT 'supplier.' || s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem) FROM supplier",
    "estate_counts": "SELECT count(*) FILTER (ok) AS healthy_asset_count, count(*) AS asset_count FROM ("
    "SELECT p_partkey IN (SELECT l_partkey FROM lineitem) AS ok FROM part UNION ALL "
    "SELECT s_suppkey IN (SELECT l_suppkey FROM lineitem) FROM supplier)",
}
