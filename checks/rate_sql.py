"""DuckDB SQL for the request-limit queries."""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
DAY_US = 86400 * 1_000_000


def admission(limit: int, until: str) -> str:
    """Step through each user's events in order with the list of held ends."""
    return (
        f"WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, {until} AS until_us, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
        "r(user_id, rn, event_id, held, admitted, wait) AS ("
        "SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), false, CAST(0 AS BIGINT) FROM ev GROUP BY 1 "
        "UNION ALL SELECT e.user_id, e.rn, e.event_id, "
        f"CASE WHEN len(list_filter(r.held, lambda x: x > e.us)) < {limit} "
        "THEN list_append(list_filter(r.held, lambda x: x > e.us), e.until_us) ELSE list_filter(r.held, lambda x: x > e.us) END, "
        f"len(list_filter(r.held, lambda x: x > e.us)) < {limit}, "
        "list_min(list_filter(r.held, lambda x: x > e.us)) - e.us "
        "FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1) "
    )


ADMISSION = admission(2, f"epoch_us(ts) + {DAY_US}") + (
    "SELECT user_id, event_id, admitted, CASE WHEN NOT admitted THEN greatest(1, CAST(ceil(wait / 1000000.0) AS BIGINT)) END "
    "AS retry_after FROM r WHERE rn > 0"
)
TOKENS = (
    "t AS (SELECT (user_id // 2) || '-' || (" + K + " // 10) AS token, event_type IN ('view', 'click') AS issue, user_id AS client, "
    "CASE WHEN value >= 4 THEN 'execute' ELSE 'approve' END AS operation, epoch_us(ts) AS us, event_id FROM events), "
    "i AS (SELECT token, client, operation, us FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY us, event_id) AS rn "
    "FROM t WHERE issue) WHERE rn = 1)"
)


CONFIRMATIONS = (
    "WITH " + TOKENS + ", u AS (SELECT t.*, i.client AS ic, i.operation AS io, i.us AS ius, "
    f"coalesce(t.us >= i.us AND t.us < i.us + {10 * DAY_US}, false) AS alive FROM t LEFT JOIN i USING (token) WHERE NOT issue), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY token, alive ORDER BY us, event_id) AS rn FROM u) "
    "SELECT event_id AS use_id, token, CASE WHEN NOT alive THEN 'unknown_token' WHEN rn > 1 THEN 'replayed' "
    "WHEN client <> ic OR operation <> io THEN 'mismatch' ELSE 'valid' END AS verdict FROM f"
)


RATE = (
    "WITH m AS (SELECT (epoch_us(ts) // 60000000) * 60 AS slide FROM events), w AS (SELECT slide - 540 + 60 * o.i AS window_start "
    "FROM m, (SELECT unnest(range(10)) AS i) o) "
    "SELECT CAST(window_start AS BIGINT) AS window_start, count(*) AS events, count(*) > 3 AS over_limit FROM w GROUP BY 1"
)

SQL = {
    "admission_sliding": ADMISSION,
    "stream_admission": ADMISSION,
    "pending_confirmations": admission(
        3, f"least(epoch_us(ts) + {5 * DAY_US}, epoch_us(ts) + CAST(floor(value * 3600) AS BIGINT) * 1000000)"
    ) + "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS tie, admitted FROM r WHERE rn > 0",
    "attempt_rate": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN "
    f"{DAY_US - 1} PRECEDING AND CURRENT ROW) AS attempts FROM events",
    "cooldown_gap": admission(1, "epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 + 86400000000") + (
        "SELECT user_id, event_id, admitted AS allowed, CASE WHEN NOT admitted THEN "
        "greatest(1, CAST(ceil(wait / 1000000.0) AS BIGINT)) END AS retry_after FROM r WHERE rn > 0"
    ),
    "confirmation_match": CONFIRMATIONS,
    "stream_confirmations": CONFIRMATIONS,
    "global_rate": RATE,
    "stream_global_rate": RATE,
}
