"""What an analyst is given: explanations, alerts, case reports and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import alert_id, any_flags, half_up
from .patterns import ORDER, SEVERITIES

#: The factors of an explanation, in order, with their labels and weights. Names that are no feature never appear.
FACTORS = (
    ("fan_in", "Receives funds from multiple sources", 0.6),
    ("fan_out", "Distributes funds to multiple recipients", 0.6),
    ("is_transit", "Acts as transit/mule account", 0.8),
    ("is_pass_through", "Pass-through behavior (in ≈ out, low balance)", 0.9),
    ("near_zero_balance_ratio", "Near-zero balance despite high turnover", 0.7),
    ("money_in_out_velocity", "High transaction velocity", 0.5),
    ("in_out_ratio", "Abnormal in/out ratio", 0.6),
    ("repeat_counterparty_ratio", "High repeat counterparty ratio", 0.5),
    ("balance_utilization", "Very low balance utilization", 0.6),
    ("credit_to_debit_amount_ratio", "Abnormal credit-to-debit ratio", 0.5),
    ("beneficiary_concentration", "High beneficiary concentration", 0.4),
    ("in_degree", "Number of incoming counterparties", 0.05),
    ("out_degree", "Number of outgoing counterparties", 0.05),
    ("clustering_coefficient", "Network clustering coefficient", 0.3),
    ("ego_network_density", "Ego network density", 0.5),
    ("pagerank_score", "PageRank risk propagation score", 0.6),
    ("bridge_score", "Bridge account between clusters", 0.5),
    ("community_score", "Tight community cluster score", 0.6),
    ("hour_distribution_entropy", "Transaction time concentration", 0.6),
    ("night_txn_ratio", "Night-time transaction ratio", 0.7),
    ("weekend_ratio", "Weekend transaction ratio", 0.4),
    ("txns_per_day", "Daily transaction frequency", 0.6),
    ("amount_volatility", "Transaction amount volatility", 0.4),
    ("max_burst_size", "Maximum transaction burst size", 0.5),
    ("velocity_ratio_7d_180d", "7-day vs 180-day velocity spike", 0.6),
)

_c = F.col


def fixed(x: Column, digits: int = 0) -> Column:
    """A number in so many decimals, halves up."""
    rounded = half_up(x.cast("double"), digits)
    return rounded.cast("long").cast("string") if digits == 0 else F.format_string(f"%.{digits}f", rounded)


def percent(x: Column) -> Column:
    return fixed(x * 100)


def said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def red_flags() -> Column:
    """The rules that an account's features meet: (potential_pattern, reason, evidence_references)."""
    c2d, night, spike = _c("credit_to_debit_amount_ratio"), _c("night_txn_ratio"), _c("velocity_ratio_7d_180d")
    # fixed values: the rules, their names, texts and the features that bear them out
    rules = (
        (_c("is_pass_through") == 1, "Pass-through mule behavior", said("Account shows pass-through ratio of ", percent(_c("pass_through_ratio")), "% — funds received are almost entirely forwarded to other accounts with minimal balance retained."), ("pass_through_ratio", "is_pass_through", "balance_utilization")),
        (_c("is_fan_out"), "Fund distribution to multiple recipients", said("Account distributes funds to ", _c("out_degree"), " different recipients, suggesting a distribution node in a mule network."), ("out_degree", "is_fan_out", "unique_outbound")),
        (_c("is_fan_in"), "Fund aggregation from multiple sources", said("Account receives funds from ", _c("in_degree"), " different sources, suggesting an aggregation node."), ("in_degree", "is_fan_in", "unique_inbound")),
        (night > 0.3, "Unusual night-time activity", said(percent(night), "% of transactions occur between 00:00-05:00, inconsistent with normal business patterns."), ("night_txn_ratio", "hour_distribution_entropy")),
        (spike > 3, "Sudden activity spike", said("7-day transaction volume is ", fixed(spike, 1), "x the 180-day baseline, indicating a sudden behavioral change."), ("velocity_ratio_7d_180d", "velocity_ratio_30d_180d")),
        (c2d > 3, "Abnormal credit-to-debit ratio", said("Credit amounts are ", fixed(c2d, 1), "x debit amounts, suggesting unidirectional fund flow."), ("credit_to_debit_amount_ratio", "credit_to_debit_count_ratio")),
        (_c("beneficiary_concentration") > 0.5, "High beneficiary concentration", said(percent(_c("beneficiary_concentration")), "% of outgoing funds go to a single recipient."), ("beneficiary_concentration", "repeat_counterparty_ratio")),
        (_c("bridge_score") > 0.3, "Bridge account between clusters", said("Account acts as a bridge connecting different network clusters (centrality: ", fixed(_c("bridge_score"), 2), ")."), ("bridge_score", "betweenness_centrality", "ego_network_density")),
        (_c("community_score") > 0.5, "Part of suspicious community cluster", said("Account belongs to a tightly connected cluster with ", percent(_c("community_score")), "% internal density and fast fund flows."), ("community_score", "clustering_coefficient")),
    )
    made = [F.when(on, F.struct(F.lit(name).alias("potential_pattern"), reason.alias("reason"), F.array(*map(F.lit, refs)).alias("evidence_references"))) for on, name, reason, refs in rules]
    return F.array_compact(F.array(*made))


def factors(columns: list[str]) -> Column:
    """What weighs on an account, the largest contribution first."""
    made = []
    for k, (name, label, weight) in enumerate(FACTORS):
        if name not in columns:
            continue
        value = _c(name).cast("double")
        # evenly spread hours are no sign, so that this one counts the other way
        gain, on = ((1 - value) * weight, value < 0.5) if name == "hour_distribution_entropy" else (value * weight, value > 0)
        made.append(F.when(on, F.struct((-half_up(gain, 3)).alias("order"), F.lit(k).alias("k"), F.lit(name).alias("feature"), F.lit(label).alias("label"), half_up(value, 3).alias("value"), F.lit(weight).alias("weight"), half_up(gain, 3).alias("contribution"))))
    return F.transform(F.array_sort(F.array_compact(F.array(*made))), lambda x: F.struct(x["feature"], x["label"], x["value"], x["weight"], x["contribution"]))


def attached(found: DataFrame) -> DataFrame:
    """(id, patterns array<struct<pattern, severity, n>>): the findings of each account, counted by kind and severity, in the order of the detectors."""
    at = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    counts = found.groupBy(F.col("account").alias("id"), "pattern", "severity").agg(F.count("*").alias("n"))
    one = F.struct(at(ORDER, "pattern").alias("k"), at(SEVERITIES, "severity").alias("s"), "pattern", "severity", "n")
    per = counts.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("patterns"))
    return per.select("id", F.transform("patterns", lambda x: F.struct(x["pattern"].alias("pattern"), x["severity"].alias("severity"), x["n"].alias("n"))).alias("patterns"))


def first_patterns(n: int = 3) -> Column:
    """The first n findings of an account."""
    each = F.transform("patterns", lambda x: F.array_repeat(F.struct(x["pattern"].alias("pattern"), x["severity"].alias("severity")), F.least(x["n"], F.lit(n)).cast("int")))
    return F.slice(F.flatten(each), 1, n)


def _with_patterns(scored: DataFrame, found: DataFrame | None) -> DataFrame:
    none = F.array().cast("array<struct<pattern:string,severity:string,n:bigint>>")
    both = scored.join(attached(found), "id", "left") if found is not None else scored.withColumn("patterns", none)
    return both.withColumn("patterns", F.coalesce("patterns", none))


def explain(scored: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Scored accounts with (factors, evidence, red_flags, summary); `found` are the findings that the evidence names."""
    f = _with_patterns(scored, found)
    f = f.withColumns({"factors": factors(scored.columns), "red_flags": red_flags()})
    parts = (("behavioral", 0.5, "Behavioral analysis: ", "% suspicious signals"), ("graph", 0.5, "Network analysis: ", "% graph anomaly signals"), ("temporal", 0.5, "Temporal analysis: ", "% timing anomaly signals"), ("community", 0.3, "Community analysis: ", "% cluster risk"))
    scores = F.array_compact(F.array(*[F.when(_c(f"{name}_score_part") > cut, said(before, percent(_c(f"{name}_score_part")), after)) for name, cut, before, after in parts]))
    named = F.transform(first_patterns(), lambda p: F.concat(F.lit("Pattern detected: "), p["pattern"], F.lit(" ("), p["severity"], F.lit(")")))
    drivers = F.array_join(F.transform(F.slice("factors", 1, 3), lambda x: x["label"]), "; ")
    score = percent(_c("ensemble"))
    summary = F.when(F.size("factors") > 0, said("Primary risk drivers: ", drivers, ". Overall suspicion score: ", score, "%.")).otherwise(said("No strong individual risk signals. Composite score: ", score, "%."))
    return f.withColumns({"evidence": F.concat(scores, named), "summary": summary})


def _lakhs(name: str) -> Column:
    return said("₹", fixed(_c("measures")[name] / 100000, 1), "L")


def make_alerts(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, type, title, description, severity, account, accounts, status) of findings, one for each pattern, account, listed accounts and severity.

    Findings alike in all these have equal ids, of which the first by its description
    stays. The id is a hash of 32 bits, so of some 100,000 findings others share one
    too, and stay apart; `accounts` are those of the finding that are in
    `known(id)`, sorted, all of them without it.
    """
    m = lambda name, digits=0: fixed(_c("measures")[name], digits)
    one, chain = _c("account"), F.array_join("listed", " → ")
    # fixed values: titles and descriptions
    made = {
        "rapid_movement": ("Rapid Fund Movement Detected", said("Account ", one, " received and forwarded funds within ", m("minutes", 1), " minutes.")),
        "fan_in": ("Multiple Inbound Transfers to Single Account", said(m("partners"), " distinct accounts transferred funds to ", one, ", totaling ", _lakhs("total"), ".")),
        "fan_out": ("Single Account Dispersing to Multiple Recipients", said(one, " distributed funds to ", m("partners"), " accounts.")),
        "circular_transfer": ("Circular Transfer Pattern Identified", said("Funds traced through ", chain, " loop totaling ", _lakhs("total"), ".")),
        "layering_chain": ("Layering Chain Detected", said("Money passed through ", m("size"), " intermediate accounts in chain: ", chain, ".")),
        "structuring": ("Suspicious Structuring Pattern", said("Account ", one, " made ", m("n"), " transactions just below ₹", fixed(_c("measures")["threshold"] / 1000), "K threshold.")),
        "night_owl": ("Unusual Night-Time Activity", said("Account ", one, " conducted ", m("night"), " transactions between 00:00-05:00 (", m("percent"), "% of total).")),
        "burst_activity": ("Transaction Burst Detected", said("Account ", one, " made ", m("size"), " transactions within ", m("window"), " minutes.")),
        "automated_timing": ("Suspiciously Regular Transaction Timing", said("Account ", one, " shows ", m("regularity"), "% regularity in transaction timing (CV: ", m("cv", 3), ").")),
        "pass_through": ("Pass-Through Account Detected", said("Account ", one, " passes ", percent(_c("measures")["ratio"]), "% of inbound funds directly outbound (", _lakhs("amount_in"), " in → ", _lakhs("amount_out"), " out).")),
        "community_cluster": ("Suspicious Community Cluster", said("Account ", one, " is part of a tightly connected cluster with fast internal fund flows.")),
        "bridge_account": ("Bridge Account Between Clusters", said("Account ", one, " acts as a bridge connecting different network clusters.")),
    }
    rows = found.withColumn("listed", F.coalesce("accounts", F.array("account")))
    pick = lambda k: F.coalesce(*[F.when(_c("pattern") == name, F.lit(x[k]) if isinstance(x[k], str) else x[k]) for name, x in made.items()])
    key = F.concat_ws(":", "pattern", "account", F.array_join("listed", ","), "severity")
    rows = rows.select(alert_id(key).alias("id"), "account", _c("pattern").alias("type"), pick(0).alias("title"), pick(1).alias("description"), "severity", "listed")
    alike = ["id", "account", "type", "severity", "listed"]
    rows = rows.groupBy(*alike).agg(F.min(F.struct("description", "title")).alias("a")).select(*alike, "a.*")
    if known is None:
        rows = rows.withColumn("accounts", F.array_sort(F.array_distinct("listed")))
    else:
        each = rows.select(*alike, F.explode("listed").alias("one"))
        each = each.join(known.select(F.col("id").alias("one")).distinct(), "one", "left_semi").groupBy(*alike).agg(F.array_sort(F.collect_set("one")).alias("accounts"))
        rows = rows.join(each, alike, "left").withColumn("accounts", F.coalesce("accounts", F.array().cast("array<string>")))
    return rows.select("id", "type", "title", "description", "severity", "account", "accounts", F.lit("new").alias("status"))


#: How sure a finding of a severity is.
CONFIDENCE = {"critical": 0.95, "high": 0.85, "medium": 0.70, "low": 0.55}


def _joined(before: Column | str, parts: list[tuple[Column, Column]], by: str, none: str, after: str = ".") -> Column:
    every = F.array_compact(F.array(*[F.when(on, text) for on, text in parts]))
    return F.when(F.size(every) > 0, said(before, F.array_join(every, by), after)).otherwise(none)


def _summaries() -> dict[str, Column]:
    """The four summaries of a report."""
    text = lambda x: F.lit(x)
    c2d, share, night, spike, burst = _c("credit_to_debit_amount_ratio"), _c("beneficiary_concentration"), _c("night_txn_ratio"), _c("velocity_ratio_7d_180d"), _c("max_burst_size")
    behavioral = [
        (_c("is_fan_out"), text("distributes funds to multiple recipients")), (_c("is_fan_in"), text("receives funds from multiple sources")), (_c("is_pass_through") == 1, text("exhibits pass-through behavior (funds flow in and out rapidly)")),
        (_c("is_transit"), text("operates as a transit account")), (c2d > 3, said("credit-to-debit ratio of ", fixed(c2d, 1), "x")), (share > 0.5, said(percent(share), "% of funds go to a single recipient")),
    ]
    network = [
        (_c("pagerank_score") > 0.2, text("elevated PageRank risk propagation")), (_c("bridge_score") > 0.3, text("acts as a bridge between network clusters")), (_c("community_score") > 0.5, text("belongs to a suspicious community cluster")),
        (_c("clustering_coefficient") < 0.1, text("low clustering (isolated actor)")), (_c("ego_network_density") > 0.5, text("high ego network density")),
    ]
    temporal = [
        (night > 0.3, said(percent(night), "% of transactions occur during night hours (00:00-05:00)")), (spike > 3, said("7-day activity is ", fixed(spike, 1), "x the 180-day baseline")),
        (burst >= 8, said("transaction burst of ", burst, " transactions detected")), (_c("hour_distribution_entropy") < 0.5, text("transactions concentrated in narrow time windows")),
    ]
    community = [(_c("community_score") > 0.5, said("part of a cluster with ", percent(_c("community_score")), "% internal density")), (_c("bridge_score") > 0.3, said("bridge score of ", fixed(_c("bridge_score"), 2), " (connects different clusters)"))]
    none = lambda kind: f"No significant {kind} anomalies detected."
    return {
        "behavioral_summary": _joined(said("Account ", _c("id"), " "), behavioral, ", ", none("behavioral")),
        "network_summary": _joined("Network analysis reveals: ", network, "; ", none("network")),
        "temporal_summary": _joined("Temporal analysis: ", temporal, "; ", none("temporal")),
        "community_summary": _joined("Community analysis: ", community, "; ", none("community")),
    }


def _advice() -> Column:
    """What to do: (action, priority, reason, suggested_timeline), the first by the level, more by the findings."""
    score, n, level = F.format_string("%.1f", _c("risk_score")), F.size("red_flags"), _c("risk_level")
    do = lambda action, priority, reason, when: F.struct(F.lit(action).alias("action"), F.lit(priority).alias("priority"), reason.alias("reason"), F.lit(when).alias("suggested_timeline"))
    first = (
        F.when((level == "critical") | _c("is_mule"), do("freeze", "urgent", said("Critical risk score (", score, ") with ", n, " red flags. Immediate action required."), "Immediate (within 1 hour)"))
        .when(level == "high", do("escalate", "high", said("High risk score (", score, ") with ", n, " red flags."), "Within 24 hours"))
        .when(level == "medium", do("investigate", "medium", said("Medium risk score (", score, ") warrants further investigation."), "Within 1 week"))
        .otherwise(do("monitor", "low", said("Low risk score (", score, "). Continue standard monitoring."), "Standard monitoring cycle"))
    )
    has = lambda name: F.exists("patterns", lambda p: p["pattern"] == name)
    passing = F.when(has("pass_through"), do("investigate", "high", F.lit("Pass-through behavior detected — funds flow in and out rapidly with minimal retention."), "Within 48 hours"))
    structuring = F.when(has("structuring"), do("escalate", "high", F.lit("Transaction structuring detected — amounts deliberately kept below reporting thresholds."), "Within 24 hours"))
    return F.array_compact(F.array(first, passing, structuring))


def _evidence_chain() -> Column:
    sure = half_up(F.least(F.lit(0.95), F.greatest(F.lit(0.5), _c("risk_score") / 100)), 2)
    link = lambda finding, source, confidence: F.struct(finding.alias("finding"), source.alias("source"), confidence.cast("double").alias("confidence"))
    flags = F.transform(F.slice("red_flags", 1, 5), lambda x: link(x["potential_pattern"], F.concat(F.lit("Feature analysis: "), F.array_join(x["evidence_references"], ", ")), sure))
    level = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    found = F.transform(first_patterns(), lambda p: link(F.concat(F.lit("Pattern: "), p["pattern"]), F.concat(F.lit("Graph analysis ("), p["severity"], F.lit(" severity)")), F.coalesce(level[p["severity"]], F.lit(0.6))))
    rank = F.when(_c("pagerank_score") > 0.2, F.array(link(F.lit("Elevated PageRank risk propagation"), F.lit("Network topology analysis"), F.least(F.lit(0.9), _c("pagerank_score") + 0.5))))
    return F.concat(flags, found, F.coalesce(rank, F.slice(flags, 1, 0)))


def analyst_report(explained: DataFrame, trends: DataFrame | None = None) -> DataFrame:
    """(id, case_id, risk_score, summaries, recommendations, evidence_chain, report): of classified accounts that `explain` went over.

    `report` is the whole as a JSON document. `trends(account_id, trend,
    days_to_suspicious, trajectory)`, if given, adds how the risk went. The case is
    numbered by the id, so that reruns give the same report.
    """
    f = explained.withColumn("risk_score", half_up(_c("final_score") * 100, 1))
    if trends is None:
        f = f.withColumns({"trend": F.lit(None).cast("string"), "days_to_suspicious": F.lit(None).cast("long"), "trajectory": F.lit(None).cast("string")})
    else:
        f = f.join(trends.select(_c("account_id").alias("id"), "trend", "days_to_suspicious", "trajectory"), "id", "left")
    f = f.withColumns(_summaries() | {"recommendations": _advice(), "evidence_chain": _evidence_chain(), "case_id": said("CASE-", _c("id"), "-", F.substring(F.sha2("id", 256), 1, 8))})
    parts = F.struct(*[_c(f"{k}_score_part").alias(k) for k in ("behavioral", "graph", "temporal", "community")], _c("ml_score").alias("ml_model"), _c("final_score").alias("calibrated"))
    marked = F.transform("red_flags", lambda x: F.struct(x["potential_pattern"], x["reason"], x["evidence_references"], _c("risk_level").alias("severity")))
    context = F.struct((_c("in_degree") + _c("out_degree")).alias("connected_accounts"), "cluster_size", (_c("bridge_score") > 0.3).alias("is_bridge"), _c("community_score").alias("community_risk"))
    gone = F.when(_c("trend").isNotNull(), F.struct(_c("trend").alias("risk_trend"), "days_to_suspicious", "trajectory"))
    body = F.struct(
        "case_id", _c("id").alias("account_id"), "risk_score", "risk_level", "is_mule", "mule_type", marked.alias("red_flags"), "behavioral_summary", "network_summary", "temporal_summary", "community_summary",
        parts.alias("score_breakdown"), gone.alias("temporal_evolution"), "recommendations", context.alias("network_context"), "evidence_chain",
    )
    return f.select("id", "case_id", "risk_score", "behavioral_summary", "network_summary", "temporal_summary", "community_summary", "recommendations", "evidence_chain", F.to_json(body).alias("report"))


def detection_summary(classified: DataFrame, ledger: DataFrame, found: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """One row: accounts, payments and mules, the findings of each kind, and the mean risk out of 100.

    With `cycles(n)`, as `cycle_counts` gives it, these are the circular transfers, each cycle one, in place of those in `found`.
    """
    a = classified.agg(F.count("*").alias("total_accounts"), F.count_if("is_mule").alias("mules_detected"), half_up(F.coalesce(F.avg(half_up(_c("final_score") * 100, 1)), F.lit(0.0)), 1).alias("avg_risk_score"))
    t = ledger.agg(F.count("*").alias("total_transactions"))
    if cycles is not None:
        found = found.where("pattern != 'circular_transfer'")
    p = found.agg(F.count("*").alias("patterns_found"), *[F.count_if(_c("pattern") == name).alias(name) for name in ORDER])
    if cycles is not None:
        p = p.crossJoin(F.broadcast(cycles.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("loops"))))
        p = p.withColumns({"patterns_found": _c("patterns_found") + _c("loops"), "circular_transfer": _c("loops")}).drop("loops")
    return a.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(p))  # a row each
