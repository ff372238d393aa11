"""Features of accounts and the scores and classes made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.scalars import DETECTION_CUTS, any_flags, clamp, half_up, ratio, risk_bucket
from . import analytics as A
from . import graph as G
from . import patterns as P


#: The age of an account that does not say.
DEFAULT_AGE = 365


def account_features(ledger: DataFrame, accounts: DataFrame, as_of: str, graph: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """The features of every account, with `pagerank` unrounded besides; `graph(id, pagerank, community, bridge)` holds graph scores, 0 without it.

    `pairs` are the edges, if they are there already; the ledger then is too.
    """
    if pairs is None:
        ledger = checkpoint(ledger)
        pairs = checkpoint(P.edges(ledger))
    by = lambda df: df.withColumnRenamed("account", "id")
    f = accounts.select("id", "balance", "turnover", "age_days")
    for part in (
        by(P.degrees(ledger, pairs)), by(A.hour_entropy(ledger)), by(A.counterparty_mix(ledger)), by(A.account_measures(ledger, as_of)),
        by(P.max_burst(ledger)), G.neighbourhoods(pairs).drop("neighbours"), A.graph_risk_legacy(ledger, accounts, pairs).select("id", F.col("risk").alias("risk_score_graph")),
    ):
        f = f.join(part, "id", "left")
    f = f.join(graph, "id", "left") if graph is not None else f.withColumns({c: F.lit(0.0) for c in ("pagerank", "community", "bridge")})
    f = f.fillna(1.0, ["count_ratio", "amount_ratio"]).fillna(DEFAULT_AGE, ["age_days"]).fillna(0)
    total, near_zero = F.col("in_degree") + F.col("out_degree"), (F.col("balance") < 1000) & (F.col("turnover") > 50000)
    flow = ratio(F.col("amount_out"), F.col("amount_in"))
    in_out = F.when(F.col("amount_out") > 0, F.col("amount_in") / F.col("amount_out")).when(F.col("amount_in") > 0, 999.0).otherwise(1.0)
    return f.select(
        "id", "in_degree", "out_degree", total.alias("total_transactions"), half_up(in_out, 2).alias("in_out_ratio"), (F.col("in_degree") >= 3).alias("is_fan_in"), (F.col("out_degree") >= 3).alias("is_fan_out"),
        F.when(near_zero, 0.95).otherwise(0.0).alias("near_zero_balance_ratio"), (near_zero & ((total > 20) | (F.col("turnover") > 500000))).alias("is_transit"),
        half_up(F.col("turnover") / F.greatest(F.col("age_days"), F.lit(1))).alias("money_in_out_velocity"), F.col("clustering").alias("clustering_coefficient"), F.col("bridge").alias("betweenness_centrality"),
        F.col("in_degree").alias("unique_inbound"), F.col("out_degree").alias("unique_outbound"), F.col("amount_in").alias("total_inbound"), F.col("amount_out").alias("total_outbound"), "risk_score_graph",
        F.col("v7").alias("velocity_ratio_7d_180d"), F.col("v30").alias("velocity_ratio_30d_180d"), F.col("count_ratio").alias("credit_to_debit_count_ratio"), F.col("amount_ratio").alias("credit_to_debit_amount_ratio"),
        half_up(flow, 3).alias("pass_through_ratio"), F.when((flow > 0.8) & (flow < 1.2) & (F.col("balance") < 0.1 * F.col("amount_in")), 1).otherwise(0).alias("is_pass_through"),
        F.col("max_share").alias("beneficiary_concentration"), F.col("entropy").alias("hour_distribution_entropy"), F.col("weekend").alias("weekend_ratio"), F.col("night").alias("night_txn_ratio"),
        F.col("business").alias("business_hours_ratio"), half_up(F.when(F.col("age_days") > 0, total / F.col("age_days")).otherwise(total), 2).alias("txns_per_day"), F.col("volatility").alias("amount_volatility"),
        F.col("max_burst").alias("max_burst_size"), total.alias("unique_counterparties"), F.col("max_share").alias("repeat_counterparty_ratio"), F.col("hhi").alias("counterparty_concentration"),
        half_up(ratio(F.col("balance"), F.col("turnover")), 3).alias("balance_utilization"), F.col("ego_density").alias("ego_network_density"), half_up(F.col("pagerank"), 4).alias("pagerank_score"),
        half_up(F.col("community"), 3).alias("community_score"), half_up(F.col("bridge"), 3).alias("bridge_score"), F.col("age_days").alias("account_age_days"), "pagerank",
    )


def graph_scores(ledger: DataFrame, accounts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(id, pagerank, community, bridge, cluster_size), unrounded; an account outside of all close communities has a cluster of 1. `pairs` are the edges, if they are there already."""
    pairs = checkpoint(P.edges(ledger)) if pairs is None else pairs
    member = G.components(pairs)
    close = G.communities(ledger, pairs, member=member, digits=None).select("component", F.col("score").alias("community"), F.col("size").alias("cluster_size"))
    member = member.join(close, "component").select("id", "community", "cluster_size")
    scored = G.pagerank_risk(pairs, accounts, digits=None).join(member, "id", "left").join(G.betweenness(pairs, digits=None).withColumnRenamed("betweenness", "bridge"), "id", "left")
    return checkpoint(scored.fillna(0.0, ["pagerank", "community", "bridge"]).fillna(1, ["cluster_size"]))


def mean_of_fired(signals: list[tuple[Column, Column | float]]) -> Column:
    """The mean weight of the signals that fire, 1 at most, 0 if none does."""
    weights = [(F.coalesce(on, F.lit(False)), F.lit(w) if isinstance(w, float) else w) for on, w in signals]
    total = sum((F.when(on, w).otherwise(0.0) for on, w in weights), F.lit(0.0))
    count = sum((on.cast("int") for on, _ in weights), F.lit(0))
    return F.when(count > 0, F.least(F.lit(1.0), total / count)).otherwise(0.0)


def _c(name: str) -> Column:
    return F.col(name)


def component_scores(f: DataFrame) -> DataFrame:
    """Features with behavioral, graph, temporal and community scores."""
    # fixed values: the signals and their weights
    behavioral = [
        (_c("is_fan_in"), 0.6), (_c("is_fan_out"), 0.6), (_c("is_transit"), 0.8), (_c("is_pass_through") == 1, 0.9), (_c("near_zero_balance_ratio") > 0.5, 0.7), (_c("money_in_out_velocity") > 50000, 0.5),
        (_c("in_out_ratio") > 10, 0.6), (_c("repeat_counterparty_ratio") > 0.7, 0.5), (_c("balance_utilization") < 0.05, 0.6), (_c("credit_to_debit_amount_ratio") > 3, 0.5), (_c("beneficiary_concentration") > 0.5, 0.4),
    ]
    graph = [
        (_c("in_degree") > 5, F.least(F.lit(0.8), _c("in_degree") / 15)), (_c("out_degree") > 5, F.least(F.lit(0.8), _c("out_degree") / 15)), (_c("clustering_coefficient") < 0.1, 0.3),
        (_c("ego_network_density") > 0.5, 0.5), (_c("pagerank_score") > 0.1, 0.6), (_c("bridge_score") > 0.3, 0.5), (_c("community_score") > 0.5, 0.6),
    ]
    temporal = [
        (_c("hour_distribution_entropy") < 0.5, 0.6), (_c("night_txn_ratio") > 0.3, 0.7), (_c("weekend_ratio") > 0.4, 0.4), (_c("txns_per_day") > 5, 0.6), (_c("amount_volatility") > 2, 0.4),
        (_c("max_burst_size") >= 8, 0.7), (_c("velocity_ratio_7d_180d") > 3, 0.6),
    ]
    community = [(_c("community_score") > 0.3, _c("community_score")), (_c("bridge_score") > 0.2, _c("bridge_score")), (_c("pass_through_ratio") > 0.8, 0.5), (_c("beneficiary_concentration") > 0.6, 0.4)]
    sets = {"behavioral": behavioral, "graph": graph, "temporal": temporal, "community": community}
    return f.withColumns({f"{name}_score_part": mean_of_fired(signals) for name, signals in sets.items()})


#: Terms (feature, scale, weight) of the weighted score.
WEIGHTED_TERMS = (("hub", 0.001, 0.35), ("total_in", 500_000, 0.15), ("avg_in", 50_000, 0.10), ("out", 100, 0.10), ("velocity", 1, 0.10), ("receivers", 100, 0.10))
INGEST_TERMS = {"hub": 0.882, "age": 0.00012, "total_in": 9e-6, "avg_in": 6e-6, "out": 4e-6, "velocity": 4e-6, "receivers": 2e-6}


def _terms(columns: dict[str, Column]) -> dict[str, Column]:
    one = lambda x: clamp(x.cast("double"))
    found = {name: one(columns[name] / scale) for name, scale, _ in WEIGHTED_TERMS}
    return found | {"age": one(1 - columns["age"] / 3000.0)}


def ml_weighted_score(columns: dict[str, Column]) -> Column:
    """Seven clipped terms: hub, age, total_in, avg_in, out, velocity, receivers."""
    terms = _terms(columns)
    return clamp(sum((terms[name] * weight for name, _, weight in WEIGHTED_TERMS), terms["age"] * 0.10))


def ml_ingest_score(columns: dict[str, Column]) -> Column:
    terms = _terms(columns)
    return clamp(sum((terms[name] * weight for name, weight in INGEST_TERMS.items()), F.lit(0.0)) * 3)


def label_boosted_score(account: Column, is_mule: Column, score: Column) -> Column:
    """A demo score that looks at the label; never use it to judge a model. It jitters by the first two hex digits of the id's MD5 sum."""
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(account.cast("string")), k, 1)) - 1
    jitter = F.pmod(16 * digit(1) + digit(2), F.lit(100)) / 1000
    return F.when(is_mule, F.least(F.lit(1.0), 0.55 + score * 0.45 + jitter)).otherwise(F.least(F.lit(0.49), 0.05 + score * 0.4 + jitter))


#: The eight small trees of the boosted score as (feature, cut, low side, high side); numbers are leaves.
TREES = (
    ("pass_through_ratio", 0.85, ("balance_utilization", 0.05, 0.15, 0.05), ("near_zero_balance_ratio", 0.5, 0.45, 0.7)),
    ("is_fan_out", 0.5, ("is_fan_in", 0.5, -0.1, ("unique_inbound", 5, 0.2, 0.35)), ("unique_outbound", 5, 0.3, ("beneficiary_concentration", 0.5, 0.4, 0.55))),
    ("night_txn_ratio", 0.3, ("hour_distribution_entropy", 0.5, ("txns_per_day", 5, 0.1, 0.25), -0.05), ("max_burst_size", 8, 0.35, 0.55)),
    ("velocity_ratio_7d_180d", 3.0, ("velocity_ratio_30d_180d", 2.0, -0.05, 0.15), ("credit_to_debit_amount_ratio", 3.0, 0.3, 0.5)),
    ("pagerank_score", 0.2, ("bridge_score", 0.3, -0.1, 0.2), ("community_score", 0.5, 0.35, 0.55)),
    ("credit_to_debit_count_ratio", 2.0, ("repeat_counterparty_ratio", 0.7, 0.0, 0.15), ("beneficiary_concentration", 0.6, 0.25, 0.45)),
    ("is_transit", 0.5, ("money_in_out_velocity", 50000, -0.05, 0.15), 0.6),
    ("amount_volatility", 2.0, ("counterparty_concentration", 0.3, -0.05, 0.1), ("txns_per_day", 3, 0.15, 0.3)),
)
BIAS, RATE = -2.5, 0.1


def _tree(node) -> Column:
    """A missing feature makes the tree 0; a value that is not finite goes to the low side."""
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, cut, low, high = node
    x = F.col(name).cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull(), 0.0).when(odd | (x <= cut), _tree(low)).otherwise(_tree(high))


def gbdt_score() -> Column:
    return 1 / (1 + F.exp(-(BIAS + RATE * sum((_tree(t) for t in TREES), F.lit(0.0)))))


def interaction_score() -> Column:
    pairs = [
        (0.3, _c("is_fan_out") & (_c("near_zero_balance_ratio") > 0.5)), (0.25, (_c("is_pass_through") == 1) & (_c("txns_per_day") > 5)), (0.2, (_c("txns_per_day") > 5) & (_c("night_txn_ratio") > 0.3)),
        (0.2, (_c("bridge_score") > 0.3) & (_c("community_score") > 0.5)), (0.25, (_c("velocity_ratio_7d_180d") > 3) & (_c("credit_to_debit_amount_ratio") > 3)), (0.2, (_c("hour_distribution_entropy") < 0.5) & (_c("max_burst_size") >= 8)),
    ]
    return F.least(F.lit(1.0), sum((F.when(on, w).otherwise(0.0) for w, on in pairs), F.lit(0.0)))


def calibrate(x: Column) -> Column:
    return half_up(clamp(1.2 * x - 0.1), 3)


def score_accounts(features: DataFrame) -> DataFrame:
    """Features with ml, interaction, ensemble and final scores."""
    f = component_scores(features)
    average_in = ratio(F.col("total_inbound"), F.col("in_degree"))
    ml = ml_weighted_score({"hub": _c("pagerank_score"), "age": _c("account_age_days"), "total_in": _c("total_inbound"), "avg_in": average_in, "out": _c("out_degree"), "velocity": _c("txns_per_day"), "receivers": _c("unique_outbound")})
    f = f.withColumns({"ml_score": ml, "interaction_score": interaction_score()})
    mixed = 0.25 * _c("behavioral_score_part") + 0.20 * _c("graph_score_part") + 0.15 * _c("temporal_score_part") + 0.10 * _c("community_score_part") + 0.20 * _c("ml_score") + 0.10 * _c("interaction_score")
    f = f.withColumn("ensemble", F.least(F.lit(1.0), mixed))
    return f.withColumn("final_score", calibrate(_c("ensemble")))


#: What raises a flag, and what is given as a reason, in order.
FLAG_RULES = {
    "fan_in": lambda: _c("is_fan_in"), "fan_out": lambda: _c("is_fan_out"), "transit": lambda: _c("is_transit"), "pass_through": lambda: _c("is_pass_through") == 1, "near_zero_balance": lambda: _c("near_zero_balance_ratio") > 0.8,
    "high_velocity": lambda: _c("money_in_out_velocity") > 50000, "bridge_account": lambda: _c("bridge_score") > 0.3, "community_cluster": lambda: _c("community_score") > 0.5, "confirmed_mule": lambda: _c("is_mule"),
}
REASON_RULES = {
    "Fan-in pattern detected": lambda: _c("is_fan_in"),
    "Fan-out pattern detected": lambda: _c("is_fan_out"),
    "Transit account behavior": lambda: _c("is_transit"),
    "Pass-through account (funds flow in and out)": lambda: _c("is_pass_through") == 1,
    "Near-zero balance despite high turnover": lambda: _c("near_zero_balance_ratio") > 0.8,
    "High transaction velocity": lambda: _c("money_in_out_velocity") > 50000,
    "High network centrality (hub account)": lambda: _c("betweenness_centrality") > 0.1,
    "High PageRank risk propagation": lambda: _c("pagerank") > 0.2,
    "Significant night-time activity": lambda: _c("night_txn_ratio") > 0.3,
    "High repeat counterparty ratio": lambda: _c("repeat_counterparty_ratio") > 0.7,
    "Suspiciously concentrated transaction times": lambda: _c("hour_distribution_entropy") < 0.5,
    "Abnormal credit-to-debit ratio": lambda: _c("credit_to_debit_amount_ratio") > 3,
    "Sudden 7-day activity spike": lambda: _c("velocity_ratio_7d_180d") > 3,
    "Bridge account between clusters": lambda: _c("bridge_score") > 0.3,
    "Part of suspicious community cluster": lambda: _c("community_score") > 0.5,
    "High ensemble risk score": lambda: _c("ensemble") >= 0.55,
    "Calibrated probability exceeds threshold": lambda: _c("final_score") >= 0.55,
}


def classify_accounts(scored: DataFrame, pass_through_counts: bool = False) -> DataFrame:
    """Scored accounts with is_mule, risk_level, mule_type, flags and reasons."""
    passes = (_c("is_pass_through") == 1) if pass_through_counts else F.lit(False)
    suspect = _c("is_fan_in") | _c("is_fan_out") | _c("is_transit") | passes
    f = scored.withColumn("is_mule", (_c("final_score") >= 0.55) & suspect).withColumn("risk_level", risk_bucket(_c("final_score"), DETECTION_CUTS))
    kind = F.when(~_c("is_mule"), "").when(_c("is_fan_out"), "distributor").when(_c("is_fan_in"), "aggregator").when(_c("is_pass_through") == 1, "pass_through").when(_c("pagerank") > 0.2, "network_mule").otherwise("pass_through")
    f = f.withColumn("mule_type", kind)
    return f.withColumns({"flags": any_flags({name: rule() for name, rule in FLAG_RULES.items()}), "reasons": any_flags({said: rule() for said, rule in REASON_RULES.items()})})


def detect(ledger: DataFrame, accounts: DataFrame, as_of: str, graph: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """The whole detection: features with graph scores, fused, calibrated and classified; `pairs` are the edges, if they are there already, and the ledger then is too."""
    if pairs is None:
        ledger = checkpoint(ledger)
        pairs = checkpoint(P.edges(ledger))  # once, for graph and features
    graph = graph_scores(ledger, accounts, pairs) if graph is None else graph
    f = account_features(ledger, accounts, as_of, graph.drop("cluster_size"), pairs).join(graph.select("id", "cluster_size"), "id", "left").fillna(1, ["cluster_size"])
    return classify_accounts(score_accounts(f))
