"""Registered queries of searches, profiles and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import INGEST_CUTS, alert_id, document_id, risk_bucket
from ..operators import analytics as A
from ..operators import patterns as P
from ..sources import tables as T
from . import detection
from .prelude import oracle
from .prelude import rounded as r


def _flagged(s, d):
    return A.ingest_flags(A.account_profile(T.accounts(s, d), T.ledger(s, d)))


def _seeds(s, d):
    return T.accounts(s, d).where("risk >= 95").select("id")


def _raw_accounts(s, d):
    a = T.accounts(s, d)
    return a.select(
        F.concat(F.lit(" "), "id").alias("id"), F.when(F.col("risk") % 5 == 0, F.lit(" ")).otherwise(F.col("name")).alias("name"), "bank",
        F.when(F.col("risk") % 3 > 0, F.col("turnover")).alias("turnover"), F.col("balance").alias("total_in"), F.lit(10.0).alias("total_out"),
        F.when(F.col("risk") % 7 == 0, F.lit("odd")).otherwise(F.upper("risk_level")).alias("risk_level"),
        F.when(F.col("risk") % 2 == 0, F.lit("Under Review")).alias("status"), "is_mule", "age_days",
    )


def _raw_alerts(s, d):
    a = T.alerts(s, d)
    return a.select("id", F.when(F.col("severity") == "low", F.lit("INFO")).otherwise(F.col("severity")).alias("severity"), F.when(F.col("status") == "dismissed", F.lit("odd")).otherwise(F.col("status")).alias("status"), F.array("account", F.lit(" "), F.lit("A0"), F.lit("ghost")).alias("accounts"))


def _joined(df, column):
    return df.withColumn(column, F.array_join(column, ","))


QUERIES = {
    "sanitize_doc_id": lambda s, d: T.accounts(s, d).select("id", document_id(F.concat_ws("-", "name", "bank")).alias("doc_key")),
    "import_window": lambda s, d: T.import_window(T.ledger(s, d), "txn_id", start=100, limit=5000, share=0.5).select("txn_id"),
    "normalize_accounts": lambda s, d: A.normalize_accounts(_raw_accounts(s, d), T.AS_OF).withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd")),
    "normalize_alerts": lambda s, d: _joined(A.normalize_alerts(_raw_alerts(s, d)), "accounts"),
    "account_search": lambda s, d: A.account_search(T.accounts(s, d), "auto", page=2, size=10).select("id", "name", "bank", "risk", "risk_level", "total"),
    "txn_search": lambda s, d: A.txn_search(T.ledger(s, d), T.accounts(s, d), "a1", flagged_only=True).select("txn_id", "src", "dst", "src_name", "dst_name", F.col("amount").cast("double").alias("amount")),
    "in_out_profile": lambda s, d: A.in_out_profile(T.accounts(s, d), T.ledger(s, d)),
    "alert_search": lambda s, d: A.alert_search(T.alerts(s, d), "critical", "new").select("id", "type", "account"),
    "ingest_flags": lambda s, d: _joined(_joined(_flagged(s, d).select("id", "flags", "reasons"), "flags"), "reasons"),
    "risk_bucket": lambda s, d: T.accounts(s, d).select("id", risk_bucket(F.col("risk") / 100).alias("detection"), risk_bucket(F.col("risk") / 100, INGEST_CUTS).alias("ingest"), "risk_level"),
    "edge_risk_class": lambda s, d: A.edge_risk_class(T.ledger(s, d), T.accounts(s, d)),
    "money_flow_matrix": lambda s, d: A.money_flow_matrix(T.ledger(s, d), T.accounts(s, d)),
    "amount_by_pattern": lambda s, d: A.amount_by_pattern(T.ledger(s, d), _flagged(s, d)),
    "graph_edges_view": lambda s, d: A.graph_edges_view(T.ledger(s, d), T.accounts(s, d)),
    "graph_nodes_view": lambda s, d: A.graph_nodes_view(T.ledger(s, d), T.accounts(s, d)),
    "graph_statistics": lambda s, d: A.graph_statistics(T.ledger(s, d), T.accounts(s, d)),
    "ego_network": lambda s, d: A.ego_network(T.ledger(s, d), _seeds(s, d)),
    "account_history": lambda s, d: A.account_history(T.ledger(s, d), _seeds(s, d)),
    "alert_accounts": lambda s, d: _joined(A.alert_accounts(_raw_alerts(s, d), T.accounts(s, d)), "accounts"),
    "label_attach": lambda s, d: _joined(A.label_attach(T.accounts(s, d), detection.found(s, d)), "patterns"),
    "hour_entropy": lambda s, d: A.hour_entropy(T.ledger(s, d)),
    "counterparty_mix": lambda s, d: A.counterparty_mix(T.ledger(s, d)),
    "credit_debit": lambda s, d: A.credit_debit(T.ledger(s, d)),
    "time_mix": lambda s, d: A.time_mix(T.ledger(s, d)),
    "velocity_ratios": lambda s, d: A.velocity_ratios(T.ledger(s, d), T.AS_OF),
    "amount_volatility": lambda s, d: A.amount_volatility(T.ledger(s, d)),
    "risk_distribution": lambda s, d: A.risk_distribution(T.accounts(s, d)),
    "mule_vs_normal": lambda s, d: A.mule_vs_normal(T.accounts(s, d)),
    "flag_frequency": lambda s, d: A.flag_frequency(_flagged(s, d)),
    "bank_frequency": lambda s, d: A.bank_frequency(T.accounts(s, d)),
    "volume_by_day": lambda s, d: A.volume_by_day(T.ledger(s, d)),
    "alerts_by_hour": lambda s, d: A.alerts_by_hour(T.alerts(s, d)),
    "pattern_by_month": lambda s, d: A.pattern_by_month(T.alerts(s, d)),
    "portfolio_stats": lambda s, d: A.portfolio_stats(T.accounts(s, d), T.ledger(s, d), T.alerts(s, d)),
    "active_alert_count": lambda s, d: A.active_alert_count(T.alerts(s, d)),
    "ece": lambda s, d: A.ece(T.scored(s, d)),
    "graph_risk_legacy": lambda s, d: A.graph_risk_legacy(T.ledger(s, d), T.accounts(s, d)),
    "top_risk": lambda s, d: T.accounts(s, d).orderBy(F.desc("risk"), "id").limit(5).select("id", "risk"),
    "recent_alerts": lambda s, d: T.alerts(s, d).orderBy(F.desc("ts"), "id").limit(5).select("id", "type"),
    "top_n_patterns": lambda s, d: P.top_n(detection.found(s, d).select("pattern", "account", "severity", "amount"), 10),
    "node_index": lambda s, d: A.node_index(T.ledger(s, d)),
    "alert_id": lambda s, d: T.alerts(s, d).select("id", alert_id(F.concat_ws(":", "type", "account", "severity")).alias("alert_id")),
}

_PROFILE = """profile AS (
  SELECT a.*, coalesce(d.in_degree, 0) AS in_degree, coalesce(d.out_degree, 0) AS out_degree, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(amount_in, 0) AS amount_in,
    coalesce(amount_out, 0) AS amount_out, (SELECT count(*) FROM accounts) AS size FROM accounts a LEFT JOIN deg d ON d.account = a.id),
flagged AS (
  SELECT id, list_filter([CASE WHEN p > 0.85 AND p < 1.15 THEN 'pass_through' END, CASE WHEN CAST(n_in + n_out AS DOUBLE) / age_days > 0.1 THEN 'high_velocity' END,
    CASE WHEN age_days < 90 THEN 'new_account' END, CASE WHEN (in_degree + out_degree) / (size * 1000.0) > 0.0003 THEN 'network_hub' END, CASE WHEN n_out > 50 THEN 'high_out_degree' END,
    CASE WHEN out_degree > 30 THEN 'fan_out_suspect' END, CASE WHEN amount_in > 100000 THEN 'high_value' END], lambda x: x IS NOT NULL) AS flags
  FROM (SELECT *, CASE WHEN amount_in <> 0 THEN amount_out / amount_in ELSE 0 END AS p FROM profile))"""

ORACLES = {
    "import_window": oracle("SELECT txn_id FROM ledger WHERE CAST(substr(txn_id, 2) AS BIGINT) >= 100 AND CAST(substr(txn_id, 2) AS BIGINT) < 5100 AND md5(txn_id) < '80000000'"),
    "graph_nodes_view": oracle(f"""SELECT id, CASE WHEN length(id) > 8 THEN right(id, 6) ELSE id END AS label, risk, in_degree, out_degree, {r('CASE WHEN size > 1 THEN least(1.0::DOUBLE, (in_degree + out_degree) / (size * 0.5::DOUBLE)) ELSE 0 END', 4)} AS centrality,
  CASE WHEN is_mule OR risk >= 60 THEN 'mule' WHEN risk >= 40 THEN 'uncertain' ELSE 'safe' END AS risk_class FROM profile WHERE in_degree + out_degree > 0""", _PROFILE),
    "graph_statistics": oracle("""SELECT (SELECT count(*) FROM accounts JOIN deg ON account = id) AS nodes, count(*) AS edges, count(*) FILTER (flagged OR s.is_mule OR t.is_mule) AS flagged FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts, txn_id) AS k FROM ledger) JOIN accounts s ON s.id = src JOIN accounts t ON t.id = dst WHERE k = 1"""),
    "sanitize_doc_id": oracle("SELECT id, regexp_replace(name || '-' || bank, '[^a-zA-Z0-9]', '_', 'g') AS doc_key FROM accounts"),
    "normalize_accounts": oracle("""
SELECT id, CASE WHEN risk % 5 = 0 THEN 'Unknown' ELSE name END AS name, bank, CASE WHEN risk % 3 > 0 THEN turnover ELSE greatest(balance, 0) + 10 END AS turnover,
  CASE WHEN risk % 7 = 0 THEN 'low' ELSE risk_level END AS risk_level, CASE WHEN risk % 2 = 0 OR is_mule THEN 'under_review' ELSE 'active' END AS status,
  strftime(DATE '2024-01-31' - CAST(age_days AS INTEGER), '%Y-%m-%d') AS first_seen FROM accounts"""),
    "normalize_alerts": oracle("SELECT id, CASE WHEN severity = 'low' THEN 'info' ELSE severity END AS severity, CASE WHEN status = 'dismissed' THEN 'new' ELSE status END AS status, account || ',A0,ghost' AS accounts FROM alerts"),
    "account_search": oracle("""SELECT id, name, bank, risk, risk_level, count(*) OVER () AS total FROM accounts WHERE contains(lower(id), 'auto') OR contains(lower(name), 'auto') OR contains(lower(bank), 'auto')
ORDER BY risk DESC, id LIMIT 10 OFFSET 10"""),
    "txn_search": oracle("""SELECT txn_id, src, dst, s.name AS src_name, t.name AS dst_name, CAST(amount AS DOUBLE) AS amount FROM (
  SELECT * FROM ledger WHERE flagged AND (contains(lower(txn_id), 'a1') OR contains(lower(src), 'a1') OR contains(lower(dst), 'a1')) ORDER BY ts DESC, txn_id LIMIT 100)
LEFT JOIN accounts s ON s.id = src LEFT JOIN accounts t ON t.id = dst"""),
    "in_out_profile": oracle("SELECT CASE WHEN length(id) > 8 THEN right(id, 6) ELSE id END AS label, in_degree, out_degree FROM profile ORDER BY in_degree + out_degree DESC, id LIMIT 20", _PROFILE),
    "alert_search": oracle("SELECT id, type, account FROM alerts WHERE severity = 'critical' AND status = 'new'"),
    "ingest_flags": oracle("SELECT id, array_to_string(flags, ',') AS flags, replace(array_to_string(flags, ','), '_', ' ') AS reasons FROM flagged", _PROFILE),
    "risk_bucket": oracle("""SELECT id, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 55 THEN 'high' WHEN risk >= 35 THEN 'medium' ELSE 'low' END AS detection,
  CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS ingest, risk_level FROM accounts"""),
    "edge_risk_class": oracle("""SELECT src, dst, CASE WHEN coalesce(s.is_mule, FALSE) OR coalesce(t.is_mule, FALSE) OR greatest(coalesce(s.risk, 0), coalesce(t.risk, 0)) >= 60 THEN 'mule'
  WHEN greatest(coalesce(s.risk, 0), coalesce(t.risk, 0)) >= 40 THEN 'uncertain' ELSE 'safe' END AS risk_class FROM edges LEFT JOIN accounts s ON s.id = src LEFT JOIN accounts t ON t.id = dst"""),
    "money_flow_matrix": oracle("""SELECT coalesce(s.risk_level, 'low') AS from_level, coalesce(t.risk_level, 'low') AS to_level, CAST(sum(amount) AS DOUBLE) AS amount
FROM ledger LEFT JOIN accounts s ON s.id = src LEFT JOIN accounts t ON t.id = dst WHERE flagged GROUP BY 1, 2"""),
    "amount_by_pattern": oracle("""SELECT family, CAST(sum(amount) AS DOUBLE) AS amount FROM (
  SELECT amount, CASE WHEN contains(flag, 'pass_through') THEN 'PASSTHROUGH' WHEN contains(flag, 'fan_out') OR contains(flag, 'out_degree') THEN 'FANOUT' WHEN contains(flag, 'hub') THEN 'FANIN' WHEN contains(flag, 'circular') THEN 'CIRCULAR' END AS family
  FROM (SELECT amount, unnest(list_concat(coalesce(s.flags, []), coalesce(t.flags, []))) AS flag FROM ledger LEFT JOIN flagged s ON s.id = src LEFT JOIN flagged t ON t.id = dst WHERE ledger.flagged))
WHERE family IS NOT NULL GROUP BY family""", _PROFILE),
    "graph_edges_view": oracle("""SELECT src, dst, txn_id, CAST(amount AS DOUBLE) AS amount, flagged OR s.is_mule OR t.is_mule AS flagged FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts, txn_id) AS k FROM ledger) JOIN accounts s ON s.id = src JOIN accounts t ON t.id = dst WHERE k = 1"""),
    "ego_network": oracle("SELECT DISTINCT id AS seed, src, dst FROM accounts JOIN edges ON src = id OR dst = id WHERE risk >= 95"),
    "account_history": oracle("""SELECT account, txn_id, other, incoming, CAST(amount AS DOUBLE) AS amount, row_number() OVER (PARTITION BY account ORDER BY ts DESC, txn_id) AS rank
FROM view_at WHERE account IN (SELECT id FROM accounts WHERE risk >= 95)"""),
    "alert_accounts": oracle("SELECT x.id, array_to_string(list_sort(list(DISTINCT account)), ',') AS accounts FROM (SELECT id, account FROM alerts UNION ALL SELECT id, 'A0' FROM alerts) x JOIN accounts a ON a.id = x.account GROUP BY x.id"),
    "label_attach": oracle("SELECT id, array_to_string(list_sort(list(DISTINCT pattern) FILTER (pattern IS NOT NULL)), ',') AS patterns FROM accounts LEFT JOIN found ON account = id GROUP BY id", detection.FOUND),
    "hour_entropy": oracle(f"""SELECT account, {r('-sum(p * log2(p)) / log2(24.0)', 3)} AS entropy FROM (
  SELECT account, n / CAST(sum(n) OVER (PARTITION BY account) AS DOUBLE) AS p FROM (SELECT account, hour(ts) AS h, count(*) AS n FROM view_at GROUP BY 1, 2)) GROUP BY account"""),
    "counterparty_mix": oracle(f"""SELECT account, {r('max(n) / CAST(sum(n) AS DOUBLE)', 3)} AS max_share, {r('CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) * sum(n) AS DOUBLE)', 3)} AS hhi
FROM (SELECT account, other, count(*) AS n FROM view_at GROUP BY 1, 2) GROUP BY account"""),
    "credit_debit": oracle(f"""SELECT account, {r('CASE WHEN d > 0 THEN CAST(c AS DOUBLE) / d WHEN c > 0 THEN 999 ELSE 1 END', 3)} AS count_ratio, {r('CASE WHEN da > 0 THEN ca / da WHEN ca > 0 THEN 999 ELSE 1 END', 3)} AS amount_ratio FROM (
  SELECT account, count(*) FILTER (incoming) AS c, count(*) FILTER (NOT incoming) AS d, coalesce(CAST(sum(amount) FILTER (incoming) AS DOUBLE), 0) AS ca, coalesce(CAST(sum(amount) FILTER (NOT incoming) AS DOUBLE), 0) AS da FROM view_at GROUP BY 1)"""),
    "time_mix": oracle(f"""SELECT account, {r('count(*) FILTER (dayofweek(ts) IN (0, 6)) / CAST(count(*) AS DOUBLE)', 3)} AS weekend, {r('count(*) FILTER (hour(ts) < 5) / CAST(count(*) AS DOUBLE)', 3)} AS night,
  {r('count(*) FILTER (hour(ts) BETWEEN 9 AND 17) / CAST(count(*) AS DOUBLE)', 3)} AS business FROM view_at GROUP BY account"""),
    "velocity_ratios": oracle(f"""SELECT account, {r('CASE WHEN c > 0 THEN a / (CAST(c AS DOUBLE) / 25) ELSE 0 END', 3)} AS v7, {r('CASE WHEN c > 0 THEN b / (CAST(c AS DOUBLE) / 6) ELSE 0 END', 3)} AS v30 FROM (
  SELECT account, count(*) FILTER (1706659200000 - ms < 7 * 86400000) AS a, count(*) FILTER (1706659200000 - ms < 30 * 86400000::BIGINT) AS b, count(*) FILTER (1706659200000 - ms < 180 * 86400000::BIGINT) AS c FROM view_at GROUP BY 1)"""),
    "amount_volatility": oracle(f"SELECT account, {r('coalesce(CASE WHEN m > 0 THEN s / m END, 0)', 3)} AS volatility FROM (SELECT account, stddev_samp(CAST(amount AS DOUBLE)) AS s, avg(CAST(amount AS DOUBLE)) AS m FROM view_at GROUP BY 1)"),
    "risk_distribution": oracle(f"""SELECT risk_level, n, {r('n * 100.0 / nullif((SELECT count(*) FROM accounts), 0)', 1)} AS percent FROM (
  SELECT l AS risk_level, count(id) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS l) LEFT JOIN accounts ON risk_level = l GROUP BY l)"""),
    "mule_vs_normal": oracle("SELECT count(*) FILTER (is_mule OR risk >= 60) AS mule, count(*) FILTER (NOT (is_mule OR risk >= 60)) AS normal FROM accounts"),
    "flag_frequency": oracle("SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM flagged) GROUP BY flag ORDER BY n DESC, flag LIMIT 10", _PROFILE),
    "bank_frequency": oracle("SELECT bank, count(*) AS n FROM accounts GROUP BY bank ORDER BY n DESC, bank LIMIT 10"),
    "volume_by_day": oracle("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(amount) AS DOUBLE) / 100000 AS lakhs, count(*) AS n FROM ledger GROUP BY 1"),
    "alerts_by_hour": oracle("SELECT h AS hour, count(id) AS n FROM range(24) t(h) LEFT JOIN alerts ON hour(ts) = h GROUP BY h"),
    "pattern_by_month": oracle("""SELECT month, count(*) FILTER (type = 'fan_in') AS "FANIN", count(*) FILTER (type = 'pass_through') AS "PASSTHROUGH", count(*) FILTER (type = 'circular_transfer') AS "CIRCULAR", count(*) FILTER (type = 'fan_out') AS "FANOUT"
FROM (SELECT unnest(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun']) AS month) LEFT JOIN alerts ON strftime(ts, '%b') = month GROUP BY 1"""),
    "portfolio_stats": oracle(f"""SELECT a.*, (SELECT count(*) FROM ledger) AS transactions, b.*, {r('flagged * 100.0 / accounts', 1)} AS flagged_percent FROM (
  SELECT count(*) AS accounts, count(*) FILTER (risk >= 60) AS flagged, sum(turnover) AS turnover, {r('avg(risk)', 1)} AS mean_risk FROM accounts) a, (
  SELECT count(*) FILTER (status IN ('new', 'investigating')) AS active_alerts, count(*) FILTER (status = 'resolved') AS resolved_alerts, count(*) FILTER (type = 'fan_in') AS fan_in_alerts,
    count(*) FILTER (type = 'pass_through') AS pass_through_alerts, count(*) FILTER (type = 'circular_transfer') AS circular_transfer_alerts, count(*) FILTER (type = 'fan_out') AS fan_out_alerts FROM alerts) b"""),
    "active_alert_count": oracle("SELECT count(*) FILTER (status IN ('new', 'investigating')) AS active FROM alerts"),
    "ece": f"""WITH scored AS (SELECT doc_id % 101 / 100.0::DOUBLE AS score, quality AS label FROM labels),
bins AS (SELECT k, k * 0.1::DOUBLE AS low, (k + 1) * 0.1::DOUBLE AS high FROM range(10) t(k)),
per AS (SELECT k, count(*) AS n, avg(score) AS s, avg(label) AS y FROM scored JOIN bins ON score >= low AND score < high GROUP BY k)
SELECT {r('sum(abs(s - y) * n) / (SELECT count(*) FROM scored)', 6)} AS ece FROM per""",
    "graph_risk_legacy": oracle(f"""SELECT id, {r('c', 4)} AS centrality, {r('least(100.0, (c * 100 + in_degree * 3.4 + out_degree * 3.4 + fi * 10 + fo * 10) / 7 * 8)', 1)} AS risk FROM (
  SELECT *, CASE WHEN size > 1 THEN least(1.0::DOUBLE, (in_degree + out_degree) / (size * 0.5::DOUBLE)) ELSE 0 END AS c FROM (
    SELECT profile.*, CAST(coalesce(f.n, 0) AS DOUBLE) AS fi, CAST(coalesce(g.n, 0) AS DOUBLE) AS fo FROM profile
    LEFT JOIN (SELECT dst, sum(n_flagged) AS n FROM edges GROUP BY 1) f ON f.dst = id LEFT JOIN (SELECT src, sum(n_flagged) AS n FROM edges GROUP BY 1) g ON g.src = id))""", _PROFILE),
    "top_risk": oracle("SELECT id, risk FROM accounts ORDER BY risk DESC, id LIMIT 5"),
    "recent_alerts": oracle("SELECT id, type FROM alerts ORDER BY ts DESC, id LIMIT 5"),
    "top_n_patterns": oracle("SELECT pattern, account, severity, amount FROM found ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), pattern, account, amount DESC LIMIT 10", detection.FOUND),
    "node_index": oracle("""SELECT s.k - 1 AS source_idx, t.k - 1 AS target_idx, CAST(sum(amount) AS DOUBLE) AS amount FROM ledger JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst GROUP BY 1, 2""",
        "nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT src AS id FROM ledger UNION SELECT dst FROM ledger))"),
    "alert_id": oracle("""SELECT id, 'ALT-' || lpad(lower(to_hex(abs(list_reduce(list_concat([0::BIGINT], list_transform(string_split(type || ':' || account || ':' || severity, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)))), 8, '0') AS alert_id FROM alerts"""),
}
