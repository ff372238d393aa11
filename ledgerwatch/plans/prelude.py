"""DuckDB text of the tables that the queries derive, for their oracles."""

PRELUDE = """
n AS (SELECT max(user_id) + 1 AS n FROM events),
ledger AS (
  SELECT 'T' || event_id AS txn_id, 'A' || user_id AS src, 'A' || t AS dst, CAST(round(value * 1000) AS DECIMAL(18,2)) AS amount, ts,
    epoch_us(ts) // 1000 AS ms, event_type AS type, event_type = 'error' AS flagged
  FROM (SELECT *, (user_id * 7 + 1 + CAST(json_extract_string(props, '$.k') AS BIGINT)) % n AS t FROM events, n) WHERE t <> user_id),
hv AS (SELECT * FROM ledger WHERE type = 'purchase' AND amount >= 100000),
purch AS (SELECT * FROM ledger WHERE type = 'purchase'),
moved AS (SELECT id, CAST(sum(amount) AS DOUBLE) AS turnover FROM (SELECT src AS id, amount FROM ledger UNION ALL SELECT dst, amount FROM ledger) GROUP BY id),
accounts AS (
  SELECT *, CASE WHEN risk >= 80 THEN 'critical' WHEN risk >= 60 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS risk_level, risk >= 85 AS is_mule
  FROM (SELECT 'A' || c_custkey AS id, c_name AS name, coalesce(nullif(c_mktsegment, ''), 'Unknown') AS bank, coalesce(n_name, 'Unknown') AS city,
    c_acctbal AS balance, CAST(30 + c_custkey * 37 % 900 AS BIGINT) AS age_days, CAST(c_custkey * 53 % 101 AS BIGINT) AS risk, coalesce(turnover, 0) AS turnover
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN moved ON moved.id = 'A' || c_custkey, n WHERE c_custkey < n)),
alerts AS (
  SELECT 'AL' || event_id AS id, ['fan_in','fan_out','pass_through','circular_transfer','rapid_movement','structuring'][k % 6 + 1] AS type,
    ['critical','high','medium','low'][k % 4 + 1] AS severity, ['new','investigating','resolved','dismissed'][event_id % 4 + 1] AS status, 'A' || user_id AS account, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error')),
feedback AS (SELECT 'A' || (doc_id % n) AS account_id, toxic = 1 AS confirmed, 'an' || (doc_id % 5) AS analyst_id, doc_id AS seq FROM labels, n),
history AS (SELECT 'A' || user_id AS account_id, event_id AS seq, ts, least(1.0, value / 100) AS risk_score FROM events WHERE event_type = 'view'),
edges AS (
  SELECT src, dst, count(*) AS n_txn, sum(amount) AS amount_sum, count(*) FILTER (flagged) AS n_flagged, arg_min(amount, (ts, txn_id)) AS first_amount FROM ledger GROUP BY src, dst),
hv_edges AS (SELECT src, dst, count(*) AS n_txn, sum(amount) AS amount_sum, arg_min(amount, (ts, txn_id)) AS first_amount FROM hv GROUP BY src, dst),
deg AS (
  SELECT account, coalesce(i.d, 0) AS in_degree, coalesce(o.d, 0) AS out_degree, CAST(coalesce(i.t, 0) AS BIGINT) AS n_in, CAST(coalesce(o.t, 0) AS BIGINT) AS n_out,
    coalesce(CAST(i.a AS DOUBLE), 0) AS amount_in, coalesce(CAST(o.a AS DOUBLE), 0) AS amount_out
  FROM (SELECT dst AS account, count(*) AS d, sum(n_txn) AS t, sum(amount_sum) AS a FROM edges GROUP BY dst) i
  FULL JOIN (SELECT src AS account, count(*) AS d, sum(n_txn) AS t, sum(amount_sum) AS a FROM edges GROUP BY src) o USING (account)),
view_at AS (SELECT src AS account, dst AS other, FALSE AS incoming, txn_id, amount, ts, ms, flagged FROM ledger UNION ALL SELECT dst, src, TRUE, txn_id, amount, ts, ms, flagged FROM ledger WHERE src <> dst)
"""


def oracle(select: str, more: str = "", recursive: bool = False) -> str:
    """A query over the derived tables; `more` adds further ones."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{PRELUDE.strip()}{',' + more if more else ''}\n{select.strip()}"


def rounded(x: str, digits: int = 0) -> str:
    scale = 10**digits
    return f"(floor(({x}) * {scale}.0 + 0.5) / {scale}.0)"
