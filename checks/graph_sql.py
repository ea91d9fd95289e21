"""DuckDB SQL over the lineage catalog: shared subqueries and one statement per check."""

from __future__ import annotations


def urn(kind: str, key: str, space: str = "'estate'") -> str:
    return f"'urn:li:dataset:(urn:li:dataPlatform:{kind},' || {space} || '.{kind}.' || {key} || ',PROD)'"


def _spec(kind: str, params: str = "{}", required: str = "true") -> str:
    return f'{{"kind":"{kind}","parameters":{params},"required":{required}}}'


_ONE = [_spec("exists"), _spec("row_count", '{"minimum":1}')]
VALIDATIONS = {
    "brand": [],
    "part": _ONE,
    "supplier": _ONE,
    "order": [_spec("exists"), _spec("schema")],
    "customer": [_spec("business_rule", '{"rule":"revenue_nonnegative"}')],
    "nation": [_spec("exists"), _spec("freshness", '{"maximum_age_seconds":300}', "false")],
    "region": [_spec("input_fingerprint")],
}


def _asset(kind, key, source, availability, artifact="dataset", adapter=None, owner=None,
           risk="'low'", approval="false", space="'estate'", domain="'Retail / Estate'",
           tags="['estate-managed']") -> str:
    adapter_sql = f"'{adapter}'" if adapter else "CAST(NULL AS VARCHAR)"
    params = f"""'{{"table":"{kind}","key":"' || {key} || '"}}'""" if adapter else "'{}'"
    owner_sql = f"'urn:li:corpuser:{owner}'" if owner else "CAST(NULL AS VARCHAR)"
    checks = "[" + ",".join(VALIDATIONS[kind]) + "]"
    return (
        f"SELECT {urn(kind, key, space)} AS urn, '{kind}.' || {key} AS display_name, "
        f"'{artifact}' AS artifact_type, '{kind}' AS platform, {domain} AS domain, "
        f"{tags} AS tags, {availability} AS availability, {owner_sql} AS owner, "
        f"{adapter_sql} AS adapter, {params} AS parameters_json, '{checks}' AS validations_json, "
        f"{risk} AS risk, {approval} AS requires_approval FROM {source}"
    )


def assets(mixed: bool = False) -> str:
    lost = lambda c: f"CASE WHEN {c} THEN 'unavailable' ELSE 'healthy' END"
    return " UNION ALL ".join([
        _asset("brand", "p_brand", "(SELECT DISTINCT p_brand FROM part)", lost("p_brand IN ('Brand#2','Brand#4')")),
        _asset("part", "p_partkey", "part", lost("p_size % 10 = 0"), adapter="snapshot_restore", owner="parts",
               space="CASE WHEN p_size = 1 THEN 'foreign' ELSE 'estate' END" if mixed else "'estate'"),
        _asset("supplier", "s_suppkey", "supplier", lost("s_suppkey % 7 = 0"), adapter="snapshot_restore",
               owner="supply", approval="s_acctbal < 0",
               tags="CASE WHEN s_suppkey % 9 = 4 THEN CAST([] AS VARCHAR[]) ELSE ['estate-managed'] END"
               if mixed else "['estate-managed']"),
        _asset("order", "o_orderkey", "orders",
               "CASE o_orderstatus WHEN 'F' THEN 'healthy' WHEN 'O' THEN 'unavailable' ELSE 'unknown' END",
               adapter="sql_transform", owner="orders",
               risk="CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'low' END"),
        _asset("customer", "c_custkey", "customer", "'healthy'", artifact="feature", adapter="sql_transform",
               owner="customers",
               domain="CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Elsewhere' ELSE 'Retail / Estate' END"
               if mixed else "'Retail / Estate'"),
        _asset("nation", "n_nationkey", "nation", "'healthy'", artifact="model", adapter="report_refresh"),
        _asset("region", "r_regionkey", "region", "'healthy'", artifact="dashboard", adapter="report_refresh",
               risk="'medium'"),
    ])


def _edge(up, up_key, down, down_key, source) -> str:
    return f"SELECT {urn(up, up_key)} AS up, {urn(down, down_key)} AS down FROM {source}"


EDGES = " UNION ALL ".join([
    _edge("brand", "p_brand", "part", "p_partkey", "part"),
    _edge("part", "l_partkey", "order", "l_orderkey", "(SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)"),
    _edge("supplier", "l_suppkey", "order", "l_orderkey", "(SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)"),
    _edge("order", "o_orderkey", "customer", "o_custkey", "orders"),
    _edge("customer", "c_custkey", "nation", "c_nationkey", "customer"),
    _edge("supplier", "s_suppkey", "nation", "s_nationkey", "supplier"),
    _edge("nation", "n_nationkey", "region", "n_regionkey", "nation"),
])


def _request(name, kind, seeds, depth, source) -> str:
    return (f"SELECT {name} AS request_id, '{kind}_outage' AS incident_type, {seeds} AS seeds, "
            f"CAST({depth} AS INTEGER) AS max_depth FROM {source}")


REQUESTS = " UNION ALL ".join([
    _request("'supplier-' || s_nationkey", "supplier", f"[{urn('supplier', 's_suppkey')}]", "n_regionkey",
             "(SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn "
             "FROM supplier) JOIN nation ON s_nationkey = n_nationkey WHERE rn = 1"),
    _request("'customer-' || c_nationkey", "customer", f"[{urn('customer', 'c_custkey')}]", "10",
             "(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn "
             "FROM customer) WHERE rn = 1"),
    _request("'part-' || p_brand", "part", f"[{urn('part', 'p_partkey')}]", "1",
             "(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS rn "
             "FROM part) WHERE rn = 1"),
    _request("'nation-' || n_nationkey", "nation", f"[{urn('nation', 'n_nationkey')}]", "1", "nation"),
    _request("'region-' || n_regionkey", "region", "seeds", "2",
             f"(SELECT n_regionkey, list_sort(list(DISTINCT {urn('nation', 'n_nationkey')})) AS seeds "
             "FROM nation GROUP BY n_regionkey)"),
    _request("'ghost-' || r_regionkey", "ghost", f"[{urn('ghost', 'r_regionkey')}]", "10", "region"),
])

BASE = f"assets AS MATERIALIZED ({assets()}), edges AS MATERIALIZED ({EDGES}), requests AS MATERIALIZED ({REQUESTS})"

SEEDS = """
seeds AS (SELECT request_id, max_depth, unnest(seeds) AS urn FROM requests),
unknown AS (SELECT s.request_id, s.urn FROM seeds s LEFT JOIN assets a USING (urn) WHERE a.urn IS NULL),
bfs(request_id, max_depth, urn, distance) AS (
  SELECT request_id, max_depth, urn, 0 FROM seeds WHERE request_id NOT IN (SELECT request_id FROM unknown)
  UNION
  SELECT b.request_id, b.max_depth, e.down, b.distance + 1 FROM bfs b JOIN edges e ON b.urn = e.up
  WHERE b.distance < b.max_depth),
reach AS MATERIALIZED (SELECT request_id, urn, min(distance) AS distance FROM bfs GROUP BY 1, 2)
"""

CLOSURE = """
pulled(request_id, urn) AS (
  SELECT request_id, urn FROM reach
  UNION
  SELECT p.request_id, e.up FROM pulled p JOIN edges e ON p.urn = e.down
  JOIN assets a ON a.urn = e.up WHERE a.availability = 'unavailable'),
targets AS MATERIALIZED (
  SELECT p.request_id, p.urn, r.distance FROM pulled p LEFT JOIN reach r USING (request_id, urn))
"""

PARENTS = """
parents AS MATERIALIZED (
  SELECT t.request_id, t.urn, e.up AS upstream_urn, a.availability,
    CASE WHEN u.urn IS NOT NULL THEN 'dependency' WHEN a.availability = 'healthy' THEN 'precondition'
         ELSE 'unresolved' END AS role
  FROM targets t JOIN edges e ON e.down = t.urn JOIN assets a ON a.urn = e.up
  LEFT JOIN targets u ON u.request_id = t.request_id AND u.urn = e.up)
"""

WAVES = """
deps AS MATERIALIZED (SELECT request_id, upstream_urn, urn FROM parents WHERE role = 'dependency'),
layers(request_id, urn, wave) AS (
  SELECT request_id, urn, 1 FROM targets
  UNION
  SELECT l.request_id, d.urn, l.wave + 1 FROM layers l
  JOIN deps d ON d.request_id = l.request_id AND d.upstream_urn = l.urn),
waves AS MATERIALIZED (SELECT request_id, urn, max(wave) AS wave FROM layers GROUP BY 1, 2)
"""

KEYS = """
paths(request_id, urn, k) AS (
  SELECT request_id, urn, [urn] FROM targets
  UNION
  SELECT p.request_id, d.urn, list_append(list_filter(p.k, lambda x: x > d.urn), d.urn)
  FROM paths p JOIN deps d ON d.request_id = p.request_id AND d.upstream_urn = p.urn),
keys AS MATERIALIZED (SELECT request_id, urn, max(k) AS order_key FROM paths GROUP BY 1, 2)
"""


def field(expr: str) -> str:
    text = f"CAST({expr} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, 'N')"


def number(expr: str) -> str:
    return f"coalesce(CAST({expr} AS VARCHAR), 'N')"


def money(expr: str) -> str:
    return number(f"CAST(round_even(({expr}) * 100, 0) AS BIGINT)")


def real_text(x: str) -> str:
    """A double by its exact value: cents where it is a whole number of them, else digits and exponent."""
    raw = f"upper(CAST(abs({x}) AS VARCHAR))"
    mantissa = f"split_part({raw}, 'E', 1)"
    power = f"CASE WHEN contains({raw}, 'E') THEN CAST(split_part({raw}, 'E', 2) AS INTEGER) ELSE 0 END"
    after = f"CASE WHEN contains({mantissa}, '.') THEN length({mantissa}) - strpos({mantissa}, '.') ELSE 0 END"
    digits = f"ltrim(replace({mantissa}, '.', ''), '0')"
    kept = f"rtrim({digits}, '0')"
    return (
        f"CASE WHEN isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN CASE WHEN {x} < 0 THEN '-Inf' ELSE 'Inf' END "
        f"WHEN abs({x}) < 1e13 AND round_even({x} * 100, 0) / 100 = {x} THEN CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR) || 'c' "
        f"ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || {kept} || 'e' || (({power}) - ({after}) + length({digits}) - length({kept})) END"
    )


def real(expr: str) -> str:
    return f"coalesce({real_text(f'CAST({expr} AS DOUBLE)')}, 'N')"


def reals(expr: str) -> str:
    return f"coalesce('[' || array_to_string(list_transform({expr}, lambda x: coalesce({real_text('CAST(x AS DOUBLE)')}, 'N')), ',') || ']', 'N')"


def moment(expr: str) -> str:
    return number(f"epoch_us({expr})")


def digest(source: str, columns: dict[str, str], by: str = "") -> str:
    """A subquery with ``row_count`` and ``digest`` of ``source``, one row or one by group."""
    own = f"{by}, " if by else ""
    grouped = f" GROUP BY {by}" if by else ""
    row = " || '|' || ".join(columns.values())
    lanes = ", ".join(
        f"CAST(coalesce(sum(CAST(('0x' || substr(h, {at}, 15)) AS BIGINT)), 0) AS VARCHAR) AS lane{i}"
        for i, at in enumerate((1, 16, 31, 46))
    )
    names = ",".join(columns)
    return (
        f"SELECT {own}row_count, sha256('{names}' || '|' || row_count || '|' || "
        f"concat_ws('|', lane0, lane1, lane2, lane3)) AS digest FROM ("
        f"SELECT {own}count(*) AS row_count, {lanes} FROM (SELECT {own}sha256({row}) AS h FROM {source}){grouped})"
    )


def _null(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'null' ELSE '\"' || {expr} || '\"' END"


ASSET_DOC = (
    "'{\"adapter\":' || " + _null("adapter") + " || ',\"adapter_parameters\":' || parameters_json || "
    "',\"artifact_type\":\"' || artifact_type || '\",\"availability\":\"' || availability || "
    "'\",\"display_name\":\"' || display_name || '\",\"domain\":\"' || domain || '\",\"owner\":' || "
    + _null("owner") + " || ',\"platform\":\"' || platform || '\",\"requires_approval\":' || "
    "CAST(requires_approval AS VARCHAR) || ',\"risk\":\"' || risk || '\",\"tags\":[' || "
    "array_to_string(list_transform(tags, lambda t: '\"' || t || '\"'), ',') || '],\"urn\":\"' || urn || "
    "'\",\"validations\":' || validations_json || '}'"
)

FINGERPRINT = (
    "fingerprint AS MATERIALIZED (SELECT sha256('retail-estate|' || a.digest || '|' || e.digest) AS fp FROM ("
    + digest("assets", {"urn": field("urn"), "document": field(ASSET_DOC)})
    + ") a, ("
    + digest("edges", {"upstream_urn": field("up"), "downstream_urn": field("down"),
                       "source": field("'datahub_mcp'"), "tool": field("'get_lineage'")})
    + ") e)"
)

PLAN_IDS = """
plan_ids AS MATERIALIZED (
  SELECT request_id, 'plan-' || substr(sha256(
    '{"compiler_version":"0.1.0","graph_fingerprint":"' || fp || '","request":{"incident_type":"' || incident_type ||
    '","max_blast_radius_depth":' || max_depth || ',"request_id":"' || request_id ||
    '","requester":"duty-officer","risk_mode":"conservative","target_recovery_point":null,' ||
    '"unavailable_asset_urns":[' || array_to_string(list_transform(seeds, lambda u: '"' || u || '"'), ',') || ']}}'
  ), 1, 20) AS plan_id FROM requests, fingerprint)
"""

MISSING = """
missing AS (
  SELECT t.request_id, t.urn, a.adapter,
    CASE WHEN a.adapter IS NULL THEN 'recovery target has no adapter' ELSE 'adapter is not registered' END AS problem
  FROM targets t JOIN assets a USING (urn)
  WHERE a.adapter IS NULL OR a.adapter NOT IN ('snapshot_restore', 'sql_transform', 'report_refresh'))
"""

VERDICTS = """
verdicts AS MATERIALIZED (
  SELECT r.request_id, p.plan_id,
    CASE WHEN u.request_id IS NOT NULL THEN 'unknown_asset' WHEN m.request_id IS NOT NULL THEN 'missing_adapter'
         WHEN o.request_id IS NOT NULL THEN 'unresolved_prerequisite' ELSE 'ok' END AS verdict
  FROM requests r JOIN plan_ids p USING (request_id)
  LEFT JOIN (SELECT DISTINCT request_id FROM unknown) u USING (request_id)
  LEFT JOIN (SELECT DISTINCT request_id FROM missing) m USING (request_id)
  LEFT JOIN (SELECT DISTINCT request_id FROM parents WHERE role = 'unresolved') o USING (request_id)),
ok AS (SELECT request_id, plan_id FROM verdicts WHERE verdict = 'ok')
"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join([BASE, *parts]) + " "


def step(urn_col: str) -> str:
    return f"'step-' || substr(sha256(plan_id || ':' || {urn_col}), 1, 16)"


TO_PARENTS = (SEEDS, CLOSURE, PARENTS)
TO_PLANS = (*TO_PARENTS, FINGERPRINT, PLAN_IDS, MISSING, VERDICTS)

SQL = {
    "graph_fingerprint": with_(FINGERPRINT) + "SELECT fp AS fingerprint FROM fingerprint",
    "fingerprint_upkeep": with_(FINGERPRINT) + "SELECT fp AS fingerprint FROM fingerprint",
    "lineage_edges": with_() + "SELECT up AS upstream_urn, down AS downstream_urn FROM edges",
    "lineage_roots": with_() + "SELECT DISTINCT up AS upstream_urn FROM edges",
    "upstream_groups": with_() + "SELECT down AS downstream_urn, count(*) AS upstream_count, min(up) AS first_upstream, "
    "max(up) AS last_upstream FROM edges GROUP BY 1",
    "unknown_seeds": with_(SEEDS) + "SELECT request_id, urn FROM unknown",
    "blast_radius": with_(SEEDS) + "SELECT request_id, urn, distance FROM reach",
    "prerequisite_closure": with_(SEEDS, CLOSURE) + "SELECT request_id, urn, distance FROM targets",
    "target_parents": with_(*TO_PARENTS) + "SELECT request_id, urn, upstream_urn, availability, role FROM parents",
    "recovery_waves": with_(*TO_PARENTS, WAVES) + "SELECT request_id, urn, wave FROM waves",
    "recovery_order": with_(*TO_PARENTS, WAVES, KEYS) + "SELECT request_id, urn, row_number() OVER "
    "(PARTITION BY request_id ORDER BY order_key) AS position FROM keys",
    "unresolved_prerequisites": with_(*TO_PARENTS) + "SELECT request_id, urn, upstream_urn AS prerequisite_urn, "
    "availability FROM parents WHERE role = 'unresolved'",
    "missing_adapters": with_(SEEDS, CLOSURE, MISSING) + "SELECT request_id, urn, adapter, problem FROM missing",
    "selection_evidence": with_(*TO_PARENTS)
    + "SELECT request_id, urn, 'recovery_target' AS decision, 'selected outage asset or downstream impact' AS reason "
    "FROM targets UNION ALL SELECT DISTINCT request_id, upstream_urn, 'healthy_precondition', "
    "'required upstream asset is healthy and must pass preflight' FROM parents WHERE role = 'precondition'",
    "plan_selection": with_(*TO_PARENTS)
    + "SELECT a.urn, CASE WHEN t.urn IS NOT NULL THEN 'recovery_target' WHEN p.urn IS NOT NULL THEN "
    "'healthy_precondition' ELSE 'excluded' END AS decision, CASE WHEN t.urn IS NOT NULL THEN "
    "'selected outage asset or downstream impact' WHEN p.urn IS NOT NULL THEN "
    "'required upstream asset is healthy and must pass preflight' ELSE "
    "'not connected to the selected outage scope' END AS reason FROM assets a LEFT JOIN "
    "(SELECT urn FROM targets WHERE request_id = 'region-1') t USING (urn) LEFT JOIN (SELECT DISTINCT upstream_urn AS urn "
    "FROM parents WHERE request_id = 'region-1' AND role = 'precondition') p USING (urn)",
    "beyond_depth": with_(SEEDS, CLOSURE)
    + "SELECT request_id, count(*) AS beyond_depth FROM (SELECT DISTINCT r.request_id, e.down FROM reach r "
    "JOIN requests q USING (request_id) JOIN edges e ON e.up = r.urn WHERE r.distance = q.max_depth "
    "EXCEPT SELECT request_id, urn FROM targets) GROUP BY 1",
    "plan_verdicts": with_(*TO_PLANS, WAVES)
    + "SELECT v.request_id, v.plan_id, v.verdict, coalesce(t.n, 0) AS target_count, coalesce(w.n, 0) AS wave_count "
    "FROM verdicts v LEFT JOIN (SELECT request_id, count(*) AS n FROM targets GROUP BY 1) t USING (request_id) "
    "LEFT JOIN (SELECT request_id, max(wave) AS n FROM waves GROUP BY 1) w USING (request_id)",
    "plan_details": with_(*TO_PLANS, WAVES, KEYS)
    + "SELECT v.request_id, v.verdict, CASE v.verdict WHEN 'unknown_asset' THEN u.detail WHEN 'missing_adapter' THEN m.detail "
    "WHEN 'unresolved_prerequisite' THEN o.detail END AS detail FROM verdicts v "
    "LEFT JOIN (SELECT request_id, string_agg(urn, ', ' ORDER BY urn) AS detail FROM unknown GROUP BY 1) u USING (request_id) "
    "LEFT JOIN (SELECT request_id, min(urn) AS detail FROM missing GROUP BY 1) m USING (request_id) "
    "LEFT JOIN (SELECT request_id, urn || ' requires ' || upstream_urn || ' with state ' || availability AS detail "
    "FROM parents JOIN keys USING (request_id, urn) WHERE role = 'unresolved' QUALIFY row_number() OVER "
    "(PARTITION BY request_id ORDER BY order_key, upstream_urn) = 1) o USING (request_id)",
    "scope_refusals": with_()
    + "SELECT request_id, 'out_of_scope' AS verdict, (SELECT min(urn) FROM assets WHERE NOT "
    "starts_with(split_part(urn, ',', 2), 'estate.s')) AS detail, 0::BIGINT AS target_count FROM requests",
    "lineage_refusals": with_()
    + "SELECT request_id, 'invalid_lineage' AS verdict, (SELECT min('urn:li:dataset:(urn:li:dataPlatform:region,estate.region.' "
    "|| r_regionkey || ',PROD)') FROM region) AS detail, 0::BIGINT AS target_count FROM requests",
    "step_ids": with_(*TO_PLANS) + f"SELECT plan_id, urn AS target_urn, {step('urn')} AS step_id, "
    f"plan_id || ':' || {step('urn')} AS idempotency_key FROM targets JOIN ok USING (request_id)",
    "plan_steps": with_(*TO_PLANS, WAVES, KEYS)
    + f"SELECT plan_id, {step('urn')} AS step_id, row_number() OVER (PARTITION BY plan_id ORDER BY order_key) AS position, "
    "wave, urn AS target_urn, adapter, risk, requires_approval, coalesce(d, 0) AS dependency_count, "
    "coalesce(h, 0) AS precondition_count FROM keys JOIN ok USING (request_id) JOIN waves USING (request_id, urn) "
    "JOIN assets USING (urn) LEFT JOIN (SELECT request_id, urn, count(*) FILTER (role = 'dependency') AS d, "
    "count(*) FILTER (role = 'precondition') AS h FROM parents GROUP BY 1, 2) USING (request_id, urn)",
    "step_dependencies": with_(*TO_PLANS)
    + f"SELECT plan_id, {step('urn')} AS step_id, {step('upstream_urn')} AS dependency_step_id, "
    "upstream_urn AS dependency_urn FROM parents JOIN ok USING (request_id) WHERE role = 'dependency'",
    "healthy_preconditions": with_(*TO_PLANS)
    + f"SELECT plan_id, {step('urn')} AS step_id, upstream_urn AS precondition_urn FROM parents "
    "JOIN ok USING (request_id) WHERE role = 'precondition'",
}
