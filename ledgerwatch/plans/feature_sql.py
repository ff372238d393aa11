"""SQL of the feature table and of the scores made of it."""

from __future__ import annotations

from . import detection, monitoring
from . import graph_sql as G
from .monitoring import _PROFILE
from .prelude import PRELUDE, oracle
from .prelude import rounded as r


def _body(sql: str) -> str:
    """The query of an oracle without the tables before it."""
    for before in (f"WITH {PRELUDE.strip()},{_PROFILE}\n", f"WITH {PRELUDE.strip()}\n"):
        if sql.startswith(before):
            return sql[len(before) :]
    raise ValueError("not an oracle over the derived tables")


_PARTS = {name: _body(monitoring.ORACLES[name]) for name in ("hour_entropy", "counterparty_mix", "credit_debit", "time_mix", "velocity_ratios", "amount_volatility", "graph_risk_legacy")}
_PARTS["max_burst"] = _body(detection.ORACLES["max_burst"]).replace("21600000", "300000")

_FLOW = "CASE WHEN p.amount_in <> 0 THEN p.amount_out / p.amount_in ELSE 0 END"
_NEAR = "(p.balance < 1000 AND p.turnover > 50000)"

_FEATURES = f"""{_PROFILE},{G.HOOD},
{G.COMPONENTS}, {G.COMMUNITIES}, {G.RANK}, {G.BETWEENNESS},
{', '.join(f'part_{name} AS ({sql})' for name, sql in _PARTS.items())},
f AS (SELECT p.id, p.in_degree, p.out_degree, p.in_degree + p.out_degree AS total_transactions,
  {r('CASE WHEN p.amount_out > 0 THEN p.amount_in / p.amount_out WHEN p.amount_in > 0 THEN 999 ELSE 1 END', 2)} AS in_out_ratio,
  CAST(p.in_degree >= 3 AS INTEGER) AS is_fan_in, CAST(p.out_degree >= 3 AS INTEGER) AS is_fan_out, CASE WHEN {_NEAR} THEN 0.95 ELSE 0.0 END AS near_zero_balance_ratio,
  CAST({_NEAR} AND (p.in_degree + p.out_degree > 20 OR p.turnover > 500000) AS INTEGER) AS is_transit, {r('p.turnover / greatest(p.age_days, 1)')} AS money_in_out_velocity,
  coalesce(h.clustering, 0) AS clustering_coefficient, round(coalesce(bt.bridge, 0), 6) AS betweenness_centrality, p.in_degree AS unique_inbound, p.out_degree AS unique_outbound, p.amount_in AS total_inbound, p.amount_out AS total_outbound,
  g.risk AS risk_score_graph, coalesce(v.v7, 0) AS velocity_ratio_7d_180d, coalesce(v.v30, 0) AS velocity_ratio_30d_180d, coalesce(c.count_ratio, 1) AS credit_to_debit_count_ratio, coalesce(c.amount_ratio, 1) AS credit_to_debit_amount_ratio,
  {r(_FLOW, 3)} AS pass_through_ratio, CASE WHEN {_FLOW} > 0.8 AND {_FLOW} < 1.2 AND p.balance < 0.1 * p.amount_in THEN 1 ELSE 0 END AS is_pass_through, coalesce(m.max_share, 0) AS beneficiary_concentration,
  coalesce(e.entropy, 0) AS hour_distribution_entropy, coalesce(t.weekend, 0) AS weekend_ratio, coalesce(t.night, 0) AS night_txn_ratio, coalesce(t.business, 0) AS business_hours_ratio,
  {r('CASE WHEN p.age_days > 0 THEN CAST(p.in_degree + p.out_degree AS DOUBLE) / p.age_days ELSE p.in_degree + p.out_degree END', 2)} AS txns_per_day, coalesce(a.volatility, 0) AS amount_volatility, coalesce(b.max_burst, 0) AS max_burst_size,
  p.in_degree + p.out_degree AS unique_counterparties, coalesce(m.max_share, 0) AS repeat_counterparty_ratio, coalesce(m.hhi, 0) AS counterparty_concentration,
  {r('CASE WHEN p.turnover <> 0 THEN p.balance / p.turnover ELSE 0 END', 3)} AS balance_utilization, coalesce(h.ego, 0) AS ego_network_density, {r('rk.pagerank', 4)} AS pagerank_score, {r('coalesce(cl.score, 0)', 3)} AS community_score,
  {r('coalesce(bt.bridge, 0)', 3)} AS bridge_score, p.age_days AS account_age_days, rk.pagerank, coalesce(cl.size, 1) AS cluster_size
  FROM profile p LEFT JOIN hood h ON h.id = p.id LEFT JOIN part_graph_risk_legacy g ON g.id = p.id LEFT JOIN part_velocity_ratios v ON v.account = p.id LEFT JOIN part_credit_debit c ON c.account = p.id
  LEFT JOIN part_counterparty_mix m ON m.account = p.id LEFT JOIN part_hour_entropy e ON e.account = p.id LEFT JOIN part_time_mix t ON t.account = p.id LEFT JOIN part_amount_volatility a ON a.account = p.id
  LEFT JOIN part_max_burst b ON b.account = p.id LEFT JOIN rank rk ON rk.id = p.id LEFT JOIN comp co ON co.id = p.id LEFT JOIN close cl ON cl.component = co.component LEFT JOIN between_ bt ON bt.id = p.id)"""  # fmt: skip


def _mean(signals: list[tuple[str, str]]) -> str:
    total = " + ".join(f"CASE WHEN {on} THEN {w} ELSE 0 END" for on, w in signals)
    count = " + ".join(f"CASE WHEN {on} THEN 1 ELSE 0 END" for on, _ in signals)
    return f"CASE WHEN ({count}) > 0 THEN least(1.0::DOUBLE, CAST(({total}) AS DOUBLE) / ({count})) ELSE 0 END"


_SIGNALS = {
    "behavioral": [("is_fan_in = 1", "0.6"), ("is_fan_out = 1", "0.6"), ("is_transit = 1", "0.8"), ("is_pass_through = 1", "0.9"), ("near_zero_balance_ratio > 0.5", "0.7"), ("money_in_out_velocity > 50000", "0.5"), ("in_out_ratio > 10", "0.6"),
        ("repeat_counterparty_ratio > 0.7", "0.5"), ("balance_utilization < 0.05", "0.6"), ("credit_to_debit_amount_ratio > 3", "0.5"), ("beneficiary_concentration > 0.5", "0.4")],
    "graph": [("in_degree > 5", "least(0.8::DOUBLE, in_degree / 15.0::DOUBLE)"), ("out_degree > 5", "least(0.8::DOUBLE, out_degree / 15.0::DOUBLE)"), ("clustering_coefficient < 0.1", "0.3"), ("ego_network_density > 0.5", "0.5"),
        ("pagerank_score > 0.1", "0.6"), ("bridge_score > 0.3", "0.5"), ("community_score > 0.5", "0.6")],
    "temporal": [("hour_distribution_entropy < 0.5", "0.6"), ("night_txn_ratio > 0.3", "0.7"), ("weekend_ratio > 0.4", "0.4"), ("txns_per_day > 5", "0.6"), ("amount_volatility > 2", "0.4"), ("max_burst_size >= 8", "0.7"), ("velocity_ratio_7d_180d > 3", "0.6")],
    "community": [("community_score > 0.3", "community_score"), ("bridge_score > 0.2", "bridge_score"), ("pass_through_ratio > 0.8", "0.5"), ("beneficiary_concentration > 0.6", "0.4")],
}

_INTERACTION = """least(1.0::DOUBLE, CASE WHEN is_fan_out = 1 AND near_zero_balance_ratio > 0.5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN is_pass_through = 1 AND txns_per_day > 5 THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN txns_per_day > 5 AND night_txn_ratio > 0.3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN bridge_score > 0.3 AND community_score > 0.5 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN velocity_ratio_7d_180d > 3 AND credit_to_debit_amount_ratio > 3 THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN hour_distribution_entropy < 0.5 AND max_burst_size >= 8 THEN 0.2::DOUBLE ELSE 0 END)"""

_ONE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST({} AS DOUBLE)))"
_ML = " + ".join(f"{w}::DOUBLE * {_ONE.format(x)}" for w, x in (
    ("0.35", "pagerank_score / 0.001::DOUBLE"), ("0.10", "1 - account_age_days / 3000.0::DOUBLE"), ("0.15", "total_inbound / 500000"), ("0.10", "CASE WHEN in_degree > 0 THEN total_inbound / in_degree ELSE 0 END / 50000"),
    ("0.10", "out_degree / 100.0::DOUBLE"), ("0.10", "txns_per_day"), ("0.10", "unique_outbound / 100.0::DOUBLE")))

_SCORED = f"""{_FEATURES},
parts AS (SELECT *, {', '.join(f'{_mean(s)} AS {k}' for k, s in _SIGNALS.items())}, {_ML} AS ml, {_INTERACTION} AS inter FROM f),
scored AS (SELECT *, {r('greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.2::DOUBLE * ensemble - 0.1::DOUBLE))', 3)} AS final_score FROM (
  SELECT *, least(1.0::DOUBLE, 0.25::DOUBLE * behavioral + 0.2::DOUBLE * graph + 0.15::DOUBLE * temporal + 0.1::DOUBLE * community + 0.2::DOUBLE * ml + 0.1::DOUBLE * inter) AS ensemble FROM parts))"""


_TREES = """CASE WHEN pass_through_ratio <= 0.85 THEN CASE WHEN balance_utilization <= 0.05 THEN 0.15 ELSE 0.05 END ELSE CASE WHEN near_zero_balance_ratio <= 0.5 THEN 0.45 ELSE 0.7 END END
  + CASE WHEN is_fan_out = 0 THEN CASE WHEN is_fan_in = 0 THEN -0.1 WHEN unique_inbound <= 5 THEN 0.2 ELSE 0.35 END ELSE CASE WHEN unique_outbound <= 5 THEN 0.3 WHEN beneficiary_concentration <= 0.5 THEN 0.4 ELSE 0.55 END END
  + CASE WHEN night_txn_ratio <= 0.3 THEN CASE WHEN hour_distribution_entropy > 0.5 THEN -0.05 WHEN txns_per_day <= 5 THEN 0.1 ELSE 0.25 END ELSE CASE WHEN max_burst_size <= 8 THEN 0.35 ELSE 0.55 END END
  + CASE WHEN velocity_ratio_7d_180d <= 3 THEN CASE WHEN velocity_ratio_30d_180d <= 2 THEN -0.05 ELSE 0.15 END ELSE CASE WHEN credit_to_debit_amount_ratio <= 3 THEN 0.3 ELSE 0.5 END END
  + CASE WHEN pagerank_score <= 0.2 THEN CASE WHEN bridge_score <= 0.3 THEN -0.1 ELSE 0.2 END ELSE CASE WHEN community_score <= 0.5 THEN 0.35 ELSE 0.55 END END
  + CASE WHEN credit_to_debit_count_ratio <= 2 THEN CASE WHEN repeat_counterparty_ratio <= 0.7 THEN 0 ELSE 0.15 END ELSE CASE WHEN beneficiary_concentration <= 0.6 THEN 0.25 ELSE 0.45 END END
  + CASE WHEN is_transit = 0 THEN CASE WHEN money_in_out_velocity <= 50000 THEN -0.05 ELSE 0.15 END ELSE 0.6 END
  + CASE WHEN amount_volatility <= 2 THEN CASE WHEN counterparty_concentration <= 0.3 THEN -0.05 ELSE 0.1 END ELSE CASE WHEN txns_per_day <= 3 THEN 0.15 ELSE 0.3 END END"""

CLASSIFIED = f"""{_SCORED},
classed AS (SELECT *, CASE WHEN final_score >= 0.75 THEN 'critical' WHEN final_score >= 0.55 THEN 'high' WHEN final_score >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN NOT mule THEN '' WHEN is_fan_out = 1 THEN 'distributor' WHEN is_fan_in = 1 THEN 'aggregator' WHEN is_pass_through = 1 THEN 'pass_through' WHEN pagerank > 0.2 THEN 'network_mule' ELSE 'pass_through' END AS mule_type,
  list_filter([CASE WHEN is_fan_in = 1 THEN 'fan_in' END, CASE WHEN is_fan_out = 1 THEN 'fan_out' END, CASE WHEN is_transit = 1 THEN 'transit' END, CASE WHEN is_pass_through = 1 THEN 'pass_through' END,
    CASE WHEN near_zero_balance_ratio > 0.8 THEN 'near_zero_balance' END, CASE WHEN money_in_out_velocity > 50000 THEN 'high_velocity' END, CASE WHEN bridge_score > 0.3 THEN 'bridge_account' END,
    CASE WHEN community_score > 0.5 THEN 'community_cluster' END, CASE WHEN mule THEN 'confirmed_mule' END], lambda x: x IS NOT NULL) AS flags,
  list_filter([CASE WHEN is_fan_in = 1 THEN 'Fan-in pattern detected' END, CASE WHEN is_fan_out = 1 THEN 'Fan-out pattern detected' END, CASE WHEN is_transit = 1 THEN 'Transit account behavior' END,
    CASE WHEN is_pass_through = 1 THEN 'Pass-through account (funds flow in and out)' END, CASE WHEN near_zero_balance_ratio > 0.8 THEN 'Near-zero balance despite high turnover' END, CASE WHEN money_in_out_velocity > 50000 THEN 'High transaction velocity' END,
    CASE WHEN betweenness_centrality > 0.1 THEN 'High network centrality (hub account)' END, CASE WHEN pagerank > 0.2 THEN 'High PageRank risk propagation' END, CASE WHEN night_txn_ratio > 0.3 THEN 'Significant night-time activity' END,
    CASE WHEN repeat_counterparty_ratio > 0.7 THEN 'High repeat counterparty ratio' END, CASE WHEN hour_distribution_entropy < 0.5 THEN 'Suspiciously concentrated transaction times' END, CASE WHEN credit_to_debit_amount_ratio > 3 THEN 'Abnormal credit-to-debit ratio' END,
    CASE WHEN velocity_ratio_7d_180d > 3 THEN 'Sudden 7-day activity spike' END, CASE WHEN bridge_score > 0.3 THEN 'Bridge account between clusters' END, CASE WHEN community_score > 0.5 THEN 'Part of suspicious community cluster' END,
    CASE WHEN ensemble >= 0.55 THEN 'High ensemble risk score' END, CASE WHEN final_score >= 0.55 THEN 'Calibrated probability exceeds threshold' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, final_score >= 0.55 AND (is_fan_in = 1 OR is_fan_out = 1 OR is_transit = 1) AS mule FROM scored))"""  # fmt: skip

_FACTORS = (
    ("is_transit", "Acts as transit/mule account", 0.8), ("is_pass_through", "Pass-through behavior (in ≈ out, low balance)", 0.9), ("near_zero_balance_ratio", "Near-zero balance despite high turnover", 0.7), ("money_in_out_velocity", "High transaction velocity", 0.5),
    ("in_out_ratio", "Abnormal in/out ratio", 0.6), ("repeat_counterparty_ratio", "High repeat counterparty ratio", 0.5), ("balance_utilization", "Very low balance utilization", 0.6), ("credit_to_debit_amount_ratio", "Abnormal credit-to-debit ratio", 0.5),
    ("beneficiary_concentration", "High beneficiary concentration", 0.4), ("in_degree", "Number of incoming counterparties", 0.05), ("out_degree", "Number of outgoing counterparties", 0.05), ("clustering_coefficient", "Network clustering coefficient", 0.3),
    ("ego_network_density", "Ego network density", 0.5), ("pagerank_score", "PageRank risk propagation score", 0.6), ("bridge_score", "Bridge account between clusters", 0.5), ("community_score", "Tight community cluster score", 0.6),
    ("night_txn_ratio", "Night-time transaction ratio", 0.7), ("weekend_ratio", "Weekend transaction ratio", 0.4), ("txns_per_day", "Daily transaction frequency", 0.6), ("amount_volatility", "Transaction amount volatility", 0.4),
    ("max_burst_size", "Maximum transaction burst size", 0.5), ("velocity_ratio_7d_180d", "7-day vs 180-day velocity spike", 0.6),
)
_GAINS = [f"CASE WHEN {name} > 0 THEN struct_pack(o := -{r(f'{name} * {w}::DOUBLE', 3)}, k := {k if k < 16 else k + 1}, l := '{label}') END" for k, (name, label, w) in enumerate(_FACTORS)]
_GAINS.insert(16, f"CASE WHEN hour_distribution_entropy < 0.5 THEN struct_pack(o := -{r('(1 - hour_distribution_entropy) * 0.6::DOUBLE', 3)}, k := 16, l := 'Transaction time concentration') END")
_PCT = lambda x: f"CAST(CAST({r(f'{x} * 100')} AS BIGINT) AS VARCHAR)"

EXPLAINED = f"""{CLASSIFIED}, {detection.FOUND},
kinds AS (SELECT account, list(pattern || ' (' || severity || ')' ORDER BY list_position(['rapid_movement', 'fan_in', 'fan_out', 'circular_transfer', 'layering_chain', 'structuring', 'night_owl', 'burst_activity', 'automated_timing', 'pass_through'], pattern),
    list_position(['critical', 'high', 'medium', 'low'], severity)) AS every, bool_or(pattern = 'pass_through') AS passes, bool_or(pattern = 'structuring') AS structures FROM found GROUP BY account),
explained AS (SELECT *, 'Primary risk drivers: ' || array_to_string(list_transform(gains[1:3], lambda x: x.l), '; ') || '. Overall suspicion score: ' || {_PCT('ensemble')} || '%.' AS drivers FROM (
  SELECT c.*, list_sort(list_filter([{', '.join(_GAINS)}], lambda x: x IS NOT NULL)) AS gains, coalesce(k.every[1:3], []) AS first_three, coalesce(passes, FALSE) AS passes, coalesce(structures, FALSE) AS structures,
    list_filter([CASE WHEN is_pass_through = 1 THEN 'Pass-through mule behavior' END, CASE WHEN is_fan_out = 1 THEN 'Fund distribution to multiple recipients' END, CASE WHEN is_fan_in = 1 THEN 'Fund aggregation from multiple sources' END,
      CASE WHEN night_txn_ratio > 0.3 THEN 'Unusual night-time activity' END, CASE WHEN velocity_ratio_7d_180d > 3 THEN 'Sudden activity spike' END, CASE WHEN credit_to_debit_amount_ratio > 3 THEN 'Abnormal credit-to-debit ratio' END,
      CASE WHEN beneficiary_concentration > 0.5 THEN 'High beneficiary concentration' END, CASE WHEN bridge_score > 0.3 THEN 'Bridge account between clusters' END, CASE WHEN community_score > 0.5 THEN 'Part of suspicious community cluster' END], lambda x: x IS NOT NULL) AS red
  FROM classed c LEFT JOIN kinds k ON k.account = c.id))"""  # fmt: skip

_PARTS_OF = lambda before, parts, by, kind: f"CASE WHEN len(list_filter([{parts}], lambda x: x IS NOT NULL)) > 0 THEN {before} || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '{by}') || '.' ELSE 'No significant {kind} anomalies detected.' END"
_ONE_DECIMAL = lambda x: f"format('{{:.1f}}', {r(x, 1)})"
_REPORT = f"""SELECT id, 'CASE-' || id || '-' || substr(sha256(id), 1, 8) AS case_id, {r('final_score * 100', 1)} AS risk_score,
  {_PARTS_OF("'Account ' || id || ' '", f"CASE WHEN is_fan_out = 1 THEN 'distributes funds to multiple recipients' END, CASE WHEN is_fan_in = 1 THEN 'receives funds from multiple sources' END, CASE WHEN is_pass_through = 1 THEN 'exhibits pass-through behavior (funds flow in and out rapidly)' END, CASE WHEN is_transit = 1 THEN 'operates as a transit account' END, CASE WHEN credit_to_debit_amount_ratio > 3 THEN 'credit-to-debit ratio of ' || {_ONE_DECIMAL('credit_to_debit_amount_ratio')} || 'x' END, CASE WHEN beneficiary_concentration > 0.5 THEN {_PCT('beneficiary_concentration')} || '% of funds go to a single recipient' END", ', ', 'behavioral')} AS behavioral_summary,
  {_PARTS_OF("'Network analysis reveals: '", "CASE WHEN pagerank_score > 0.2 THEN 'elevated PageRank risk propagation' END, CASE WHEN bridge_score > 0.3 THEN 'acts as a bridge between network clusters' END, CASE WHEN community_score > 0.5 THEN 'belongs to a suspicious community cluster' END, CASE WHEN clustering_coefficient < 0.1 THEN 'low clustering (isolated actor)' END, CASE WHEN ego_network_density > 0.5 THEN 'high ego network density' END", '; ', 'network')} AS network_summary,
  {_PARTS_OF("'Temporal analysis: '", f"CASE WHEN night_txn_ratio > 0.3 THEN {_PCT('night_txn_ratio')} || '% of transactions occur during night hours (00:00-05:00)' END, CASE WHEN velocity_ratio_7d_180d > 3 THEN '7-day activity is ' || {_ONE_DECIMAL('velocity_ratio_7d_180d')} || 'x the 180-day baseline' END, CASE WHEN max_burst_size >= 8 THEN 'transaction burst of ' || max_burst_size || ' transactions detected' END, CASE WHEN hour_distribution_entropy < 0.5 THEN 'transactions concentrated in narrow time windows' END", '; ', 'temporal')} AS temporal_summary,
  {_PARTS_OF("'Community analysis: '", f"CASE WHEN community_score > 0.5 THEN 'part of a cluster with ' || {_PCT('community_score')} || '% internal density' END, CASE WHEN bridge_score > 0.3 THEN 'bridge score of ' || format('{{:.2f}}', {r('bridge_score', 2)}) || ' (connects different clusters)' END", '; ', 'community')} AS community_summary,
  CASE WHEN risk_level = 'critical' OR mule THEN 'freeze' WHEN risk_level = 'high' THEN 'escalate' WHEN risk_level = 'medium' THEN 'investigate' ELSE 'monitor' END || CASE WHEN passes THEN ',investigate' ELSE '' END || CASE WHEN structures THEN ',escalate' ELSE '' END AS actions,
  least(5, len(red)) + len(first_three) + CASE WHEN pagerank_score > 0.2 THEN 1 ELSE 0 END AS n_evidence FROM explained"""

ORACLES = {
    "account_features": oracle("SELECT * EXCLUDE (pagerank, cluster_size) FROM f", _FEATURES, recursive=True),
    "component_scores": oracle(f"SELECT id, {', '.join(f'round({k}, 6) AS {k}' for k in _SIGNALS)} FROM parts", _SCORED, recursive=True),
    "interaction_score": oracle(f"SELECT id, round({_INTERACTION}, 6) AS score FROM f", _FEATURES, recursive=True),
    "gbdt_score": oracle(f"SELECT id, round(1 / (1 + exp(-(-2.5::DOUBLE + 0.1::DOUBLE * ({_TREES})))), 6) AS score FROM f", _FEATURES, recursive=True),
    "ensemble_score": oracle("SELECT id, final_score FROM scored", _SCORED, recursive=True),
    "classify_accounts": oracle("SELECT id, CAST(mule AS INTEGER) AS is_mule, risk_level, mule_type, array_to_string(flags, ',') AS flags, array_to_string(reasons, ';') AS reasons FROM classed", CLASSIFIED, recursive=True),
    "detection_run": oracle("SELECT id, final_score, risk_level, mule_type, CAST(mule AS INTEGER) AS is_mule, array_to_string(flags, ',') AS flags FROM classed", CLASSIFIED, recursive=True),
    "detection_summary": oracle(f"""SELECT (SELECT count(*) FROM classed) AS total_accounts, (SELECT count(*) FROM ledger) AS total_transactions, (SELECT count(*) FROM classed WHERE mule) AS mules_detected,
  (SELECT {r('avg(' + r('final_score * 100', 1) + ')', 1)} FROM classed) AS avg_risk_score, count(pattern) + any_value(loops) AS patterns_found, {', '.join("any_value(loops) AS circular_transfer" if k == 'circular_transfer' else f"count(*) FILTER (pattern = '{k}') AS {k}" for k in ('rapid_movement', 'fan_in', 'fan_out', 'circular_transfer', 'layering_chain', 'structuring', 'night_owl', 'burst_activity', 'automated_timing', 'pass_through', 'community_cluster', 'bridge_account'))}
FROM (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS loops FROM ({detection._cycle_counts()})) LEFT JOIN found ON pattern <> 'circular_transfer'""", f"{CLASSIFIED}, {detection.FOUND}, {detection._HALVES}", recursive=True),
    "explain": oracle("SELECT id, drivers AS summary, len(gains) AS n_factors, array_to_string(list_transform(first_three, lambda x: 'Pattern detected: ' || x), ';') AS evidence, array_to_string(red, ';') AS red_flags FROM explained", EXPLAINED, recursive=True),
    "analyst_report": oracle(_REPORT, EXPLAINED, recursive=True),
}
