"""Searches, profiles and statistics over accounts, payments and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.scalars import LEVELS, any_flags, half_up, millis, ratio
from .patterns import account_view, degrees, edges

STATUSES = ("active", "frozen", "under_review")
ALERT_STATUSES = ("new", "investigating", "resolved", "dismissed", "confirmed")
ACTIVE = ("new", "investigating")
FAMILIES = {"fan_in": "FANIN", "pass_through": "PASSTHROUGH", "circular_transfer": "CIRCULAR", "fan_out": "FANOUT"}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun")


def whitelisted(value: Column, allowed: tuple[str, ...], default: Column) -> Column:
    """Lower case, blanks as underscores, and the default for anything unknown."""
    clean = F.regexp_replace(F.lower(F.trim(value)), " +", "_")
    return F.when(clean.isin(*allowed), clean).otherwise(default)


#: The names under which imports and documents hold the columns of an account.
SPELLINGS = {
    "id": ("id", "account_id"),
    "name": ("name",),
    "bank": ("bank",),
    "turnover": ("turnover", "total_turnover", "totalAmount"),
    "total_in": ("total_in", "total_in_amount"),
    "total_out": ("total_out", "total_out_amount"),
    "risk_level": ("riskLevel", "risk_level"),
    "status": ("status",),
    "is_mule": ("isMule", "is_mule"),
    "age_days": ("age_days", "account_age_days"),
}
KINDS = {"turnover": "double", "total_in": "double", "total_out": "double", "is_mule": "boolean", "age_days": "double"}


def spelt(raw: DataFrame) -> DataFrame:
    """`raw` with one column of each name: the first spelling that holds a value, null if none does."""
    found = {name: [F.col(c).cast(KINDS.get(name, "string")) for c in names if c in raw.columns] for name, names in SPELLINGS.items()}
    return raw.select(*[(F.coalesce(*cols) if cols else F.lit(None).cast(KINDS.get(name, "string"))).alias(name) for name, cols in found.items()])


def normalize_accounts(raw: DataFrame, as_of: str) -> DataFrame:
    """Accounts from (id, name, bank, turnover, total_in, total_out, risk_level, status, is_mule, age_days) as they come.

    Columns may have any of their further names; the first that holds a value counts.
    """
    raw = spelt(raw)
    count = lambda c: F.greatest(F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)), F.lit(0.0))
    named = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown"))
    status = F.when(F.col("is_mule"), "under_review").otherwise("active")
    return raw.select(
        F.trim("id").alias("id"),
        named("name").alias("name"),
        named("bank").alias("bank"),
        F.coalesce(F.when(F.col("turnover").isNotNull() & ~F.isnan("turnover"), F.greatest(F.col("turnover"), F.lit(0.0))), count("total_in") + count("total_out")).alias("turnover"),
        whitelisted(F.col("risk_level"), LEVELS, F.lit("low")).alias("risk_level"),
        whitelisted(F.col("status"), STATUSES, status).alias("status"),
        F.date_sub(F.to_date(F.lit(as_of)), F.greatest(F.coalesce("age_days", F.lit(0)), F.lit(0)).cast("int")).alias("first_seen"),
    )


def normalize_alerts(raw: DataFrame) -> DataFrame:
    """Alerts with known severity and status, and without blank accounts."""
    return raw.select(
        "id",
        whitelisted(F.col("severity"), (*LEVELS, "info"), F.lit("medium")).alias("severity"),
        whitelisted(F.col("status"), ALERT_STATUSES, F.lit("new")).alias("status"),
        F.filter("accounts", lambda a: a.isNotNull() & (F.trim(a) != "")).alias("accounts"),
    )


def account_search(accounts: DataFrame, text: str = "", level: str | None = None, sort: str = "risk", ascending: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """One page of the accounts whose id, name or bank contains the text, with the total number found."""
    page, size, text = max(1, page), max(1, min(size, 500)), text.lower()
    found = accounts.where(F.lower("id").contains(text) | F.lower("name").contains(text) | F.lower("bank").contains(text))
    if level:
        found = found.where(F.col("risk_level") == level)
    order = F.asc(sort) if ascending else F.desc(sort)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(order, "id").offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def txn_search(ledger: DataFrame, accounts: DataFrame, text: str = "", kind: str | None = None, flagged_only: bool = False, limit: int = 100) -> DataFrame:
    """The newest payments that match, with the names of both parties."""
    text = text.lower()
    found = ledger.where(F.lower("txn_id").contains(text) | F.lower("src").contains(text) | F.lower("dst").contains(text))
    if kind:
        found = found.where(F.col("type") == kind)
    if flagged_only:
        found = found.where("flagged")
    found = found.orderBy(F.desc("ts"), "txn_id").limit(limit)
    name = lambda side: accounts.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    return found.join(name("src"), "src", "left").join(name("dst"), "dst", "left")


def in_out_profile(accounts: DataFrame, ledger: DataFrame, limit: int = 20) -> DataFrame:
    label = F.when(F.length("account") > 8, F.right("account", F.lit(6))).otherwise(F.col("account"))
    both = accounts.select(F.col("id").alias("account")).join(degrees(ledger), "account", "left").fillna(0)
    return both.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "account").limit(limit).select(label.alias("label"), "in_degree", "out_degree")


def alert_search(alerts: DataFrame, severity: str | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("severity", severity), ("status", status)):
        alerts = alerts.where(F.col(column) == value) if value else alerts
    return alerts.orderBy(F.desc("ts"), "id")


def account_profile(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Accounts with flows, velocity and hub share, null-free."""
    n = accounts.agg(F.count("*").alias("n_accounts"))
    both = accounts.join(degrees(ledger).withColumnRenamed("account", "id"), "id", "left").fillna(0).crossJoin(F.broadcast(n))  # one row
    hub = (F.col("in_degree") + F.col("out_degree")) / (F.col("n_accounts") * 1000.0)
    return both.withColumns({"pass_ratio": ratio(F.col("amount_out"), F.col("amount_in")), "velocity": ratio(F.col("n_in") + F.col("n_out"), F.col("age_days")), "hub_score": hub})


def ingest_flags(profile: DataFrame) -> DataFrame:
    flags = any_flags(
        {
            "pass_through": (F.col("pass_ratio") > 0.85) & (F.col("pass_ratio") < 1.15),
            "high_velocity": F.col("velocity") > 0.1,
            "new_account": F.col("age_days") < 90,
            "network_hub": F.col("hub_score") > 0.0003,
            "high_out_degree": F.col("n_out") > 50,
            "fan_out_suspect": F.col("out_degree") > 30,
            "high_value": F.col("amount_in") > 100000,
        }
    )
    flagged = profile.withColumn("flags", flags)
    return flagged.withColumn("reasons", F.transform("flags", lambda f: F.replace(f, F.lit("_"), F.lit(" "))))


def edge_risk_class(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    side = lambda at: accounts.select(F.col("id").alias(at), F.col("risk").alias(f"{at}_risk"), F.col("is_mule").alias(f"{at}_mule"))
    both = edges(ledger).select("src", "dst").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    risk = F.greatest(F.coalesce("src_risk", F.lit(0)), F.coalesce("dst_risk", F.lit(0)))
    mule = F.coalesce("src_mule", F.lit(False)) | F.coalesce("dst_mule", F.lit(False))
    return both.select("src", "dst", F.when(mule | (risk >= 60), "mule").when(risk >= 40, "uncertain").otherwise("safe").alias("risk_class"))


def _with_levels(ledger: DataFrame, accounts: DataFrame, column: str) -> DataFrame:
    side = lambda at, name: accounts.select(F.col("id").alias(at), F.col(column).alias(name))
    return ledger.where("flagged").join(side("src", "from_value"), "src", "left").join(side("dst", "to_value"), "dst", "left")


def money_flow_matrix(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    level = lambda c: F.coalesce(c, F.lit("low")).alias(c.replace("value", "level"))
    return _with_levels(ledger, accounts, "risk_level").groupBy(level("from_value"), level("to_value")).agg(F.sum("amount").cast("double").alias("amount"))


def amount_by_pattern(ledger: DataFrame, flagged: DataFrame) -> DataFrame:
    """Flagged amounts by family of pattern, once for each flag at either end."""
    none = F.array().cast("array<string>")
    rows = _with_levels(ledger, flagged, "flags").select("amount", F.explode(F.concat(F.coalesce("from_value", none), F.coalesce("to_value", none))).alias("flag"))
    family = F.when(F.col("flag").contains("pass_through"), "PASSTHROUGH").when(F.col("flag").contains("fan_out") | F.col("flag").contains("out_degree"), "FANOUT").when(F.col("flag").contains("hub"), "FANIN").when(F.col("flag").contains("circular"), "CIRCULAR")
    return rows.select(family.alias("family"), "amount").where("family is not null").groupBy("family").agg(F.sum("amount").cast("double").alias("amount"))


def graph_edges_view(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """The earliest payment of each edge between known accounts, flagged if it or either party is suspect."""
    side = lambda at: accounts.select(F.col("id").alias(at), F.col("is_mule").alias(f"{at}_mule"))
    first = ledger.groupBy("src", "dst").agg(F.min_by(F.struct("txn_id", "amount", "flagged"), F.struct("ts", "txn_id")).alias("f"))
    both = first.join(side("src"), "src").join(side("dst"), "dst")
    return both.select("src", "dst", "f.txn_id", F.col("f.amount").cast("double").alias("amount"), (F.col("f.flagged") | F.col("src_mule") | F.col("dst_mule")).alias("flagged"))


def graph_nodes_view(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """The nodes of the payment graph that are known: label, risk, degrees, centrality and what colour their risk has."""
    n = accounts.agg(F.count("*").alias("n_accounts"))
    both = accounts.join(degrees(ledger).withColumnRenamed("account", "id"), "id").crossJoin(F.broadcast(n))  # one row
    label = F.when(F.length("id") > 8, F.right("id", F.lit(6))).otherwise(F.col("id"))
    centrality = F.when(F.col("n_accounts") > 1, F.least(F.lit(1.0), (F.col("in_degree") + F.col("out_degree")) / (F.col("n_accounts") * 0.5))).otherwise(0.0)
    kind = F.when(F.col("is_mule") | (F.col("risk") >= 60), "mule").when(F.col("risk") >= 40, "uncertain").otherwise("safe")
    return both.select("id", label.alias("label"), "risk", "in_degree", "out_degree", half_up(centrality, 4).alias("centrality"), kind.alias("risk_class"))


def graph_statistics(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """(nodes, edges, flagged): the size of the graph that the views show."""
    nodes = graph_nodes_view(ledger, accounts).agg(F.count("*").alias("nodes"))
    both = graph_edges_view(ledger, accounts).agg(F.count("*").alias("edges"), F.count_if("flagged").alias("flagged"))
    return nodes.crossJoin(F.broadcast(both))  # a row each


def ego_network(ledger: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, src, dst): the edges at each seed account of `seeds(id)`."""
    pairs = edges(ledger).select("src", "dst")
    out = seeds.select(F.col("id").alias("seed")).join(pairs, F.col("seed") == F.col("src"))
    into = seeds.select(F.col("id").alias("seed")).join(pairs, F.col("seed") == F.col("dst"))
    return out.union(into).distinct()


def account_history(ledger: DataFrame, seeds: DataFrame) -> DataFrame:
    """(account, txn_id, other, incoming, amount, rank): payments of each seed, newest first."""
    from pyspark.sql import Window

    mine = account_view(ledger).join(seeds.select(F.col("id").alias("account")), "account", "left_semi")
    order = Window.partitionBy("account").orderBy(F.desc("ts"), "txn_id")
    return mine.select("account", "txn_id", "other", "incoming", F.col("amount").cast("double").alias("amount"), F.row_number().over(order).alias("rank"))


def alert_accounts(alerts: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, accounts): each alert's accounts that are known, sorted."""
    each = alerts.select("id", F.explode("accounts").alias("account"))
    known = each.join(accounts.select(F.col("id").alias("account")), "account", "left_semi")
    return known.groupBy("id").agg(F.array_sort(F.collect_set("account")).alias("accounts"))


def label_attach(accounts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, patterns): the findings of each account, sorted."""
    found = patterns.groupBy(F.col("account").alias("id")).agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    return accounts.select("id").join(found, "id", "left")


def hour_entropy(ledger: DataFrame) -> DataFrame:
    """(account, entropy): Shannon entropy of the hours of its payments, as a share of the most possible."""
    hours = account_view(ledger).groupBy("account", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    totals = hours.groupBy("account").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return hours.join(totals, "account").groupBy("account").agg((-F.sum(p * F.log2(p)) / F.log2(F.lit(24.0))).alias("e")).select("account", half_up(F.col("e"), 3).alias("entropy"))


def counterparty_mix(ledger: DataFrame) -> DataFrame:
    pairs = account_view(ledger).groupBy("account", "other").agg(F.count("*").alias("n"))
    per = pairs.groupBy("account").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return per.select("account", half_up(F.col("most") / F.col("total"), 3).alias("max_share"), half_up(F.col("squares") / (F.col("total") * F.col("total")), 3).alias("hhi"))


def _measures(as_of: str) -> dict[str, tuple[list[Column], list[Column]]]:
    """Sums over the payments of an account, and what is made of them, by name."""
    day, now = 86_400_000, F.unix_millis(F.lit(as_of).cast("timestamp"))
    sent, amount = ~F.col("incoming"), F.col("amount").cast("double")
    total = lambda on, name: F.sum(F.when(on, F.col("amount")).otherwise(0)).cast("double").alias(name)
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).when(F.col(a) > 0, 999.0).otherwise(1.0)
    share = lambda name: half_up(F.col(f"n_{name}") / F.col("n_all"), 3).alias(name)
    within = lambda days: F.count_if(now - F.col("ms") < days * day).alias(f"in_{days}")
    speed = lambda days, spans, name: half_up(F.when(F.col("in_180") > 0, F.col(f"in_{days}") / (F.col("in_180") / spans)).otherwise(0.0), 3).alias(name)
    return {
        "credit_debit": ([F.count_if("incoming").alias("c"), F.count_if(sent).alias("d"), total(F.col("incoming"), "ca"), total(sent, "da")], [half_up(part("c", "d"), 3).alias("count_ratio"), half_up(part("ca", "da"), 3).alias("amount_ratio")]),
        "time_mix": (
            [F.count("*").alias("n_all"), F.count_if(F.dayofweek("ts").isin(1, 7)).alias("n_weekend"), F.count_if(F.col("hour") < 5).alias("n_night"), F.count_if(F.col("hour").between(9, 17)).alias("n_business")],
            [share("weekend"), share("night"), share("business")],
        ),
        "velocity_ratios": ([within(7), within(30), within(180)], [speed(7, 25, "v7"), speed(30, 6, "v30")]),
        "amount_volatility": ([F.stddev_samp(amount).alias("spread"), F.avg(amount).alias("mean")], [half_up(F.coalesce(F.when(F.col("mean") > 0, F.col("spread") / F.col("mean")), F.lit(0.0)), 3).alias("volatility")]),
    }


def account_measures(ledger: DataFrame, as_of: str, *names: str) -> DataFrame:
    """The named measures of every account (all without names), in one pass over its payments."""
    chosen = [m for name, m in _measures(as_of).items() if not names or name in names]
    view = account_view(ledger).withColumns({"hour": F.hour("ts"), "ms": millis(F.col("ts"))})
    per = view.groupBy("account").agg(*[x for sums, _ in chosen for x in sums])
    return per.select("account", *[x for _, made in chosen for x in made])


def credit_debit(ledger: DataFrame) -> DataFrame:
    return account_measures(ledger, "1970-01-01 00:00:00", "credit_debit")


def time_mix(ledger: DataFrame) -> DataFrame:
    return account_measures(ledger, "1970-01-01 00:00:00", "time_mix")


def velocity_ratios(ledger: DataFrame, as_of: str) -> DataFrame:
    """Payments of the last 7 and 30 days against the average of such spans in the last 180."""
    return account_measures(ledger, as_of, "velocity_ratios")


def amount_volatility(ledger: DataFrame) -> DataFrame:
    return account_measures(ledger, "1970-01-01 00:00:00", "amount_volatility")


def risk_distribution(accounts: DataFrame) -> DataFrame:
    spark = accounts.sparkSession
    levels = spark.createDataFrame([(x,) for x in LEVELS], "risk_level string")
    counts = levels.join(accounts.groupBy("risk_level").agg(F.count("*").alias("n")), "risk_level", "left").fillna(0)
    total = accounts.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("risk_level", "n", half_up(ratio(F.col("n"), F.col("total")) * 100, 1).alias("percent"))


def mule_vs_normal(accounts: DataFrame) -> DataFrame:
    mule = F.col("is_mule") | (F.col("risk") >= 60) | F.col("risk_level").isin("critical", "high")
    return accounts.agg(F.count_if(mule).alias("mule"), F.count_if(~mule).alias("normal"))


def flag_frequency(flagged: DataFrame, limit: int = 10) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(limit)


def bank_frequency(accounts: DataFrame, limit: int = 10) -> DataFrame:
    return accounts.groupBy("bank").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bank").limit(limit)


def volume_by_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.sum("amount").cast("double") / 100000).alias("lakhs"), F.count("*").alias("n"))


def alerts_by_hour(alerts: DataFrame) -> DataFrame:
    hours = alerts.sparkSession.range(24).withColumnRenamed("id", "hour")
    return hours.join(alerts.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n")), "hour", "left").fillna(0)


def pattern_by_month(alerts: DataFrame, year: int | None = None) -> DataFrame:
    """Alerts of four families in each month from January to June, months without any included; of one year, or of each month in all years."""
    family = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in FAMILIES.items()])
    rows = alerts.where(F.year("ts") == year) if year else alerts
    rows = rows.where(F.month("ts") <= len(MONTHS)).select(F.month("ts").alias("number"), family.alias("family"))
    counts = rows.groupBy("number").pivot("family", list(FAMILIES.values())).agg(F.count(F.lit(1)))
    months = alerts.sparkSession.createDataFrame(list(enumerate(MONTHS, 1)), "number int, month string")
    return months.join(counts, "number", "left").fillna(0).drop("number")


def active_alert_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def portfolio_stats(accounts: DataFrame, ledger: DataFrame, alerts: DataFrame) -> DataFrame:
    a = accounts.agg(F.count("*").alias("accounts"), F.count_if(F.col("risk") >= 60).alias("flagged"), F.sum("turnover").alias("turnover"), half_up(F.avg("risk"), 1).alias("mean_risk"))
    t = ledger.agg(F.count("*").alias("transactions"))
    kinds = [F.count_if(F.col("type") == k).alias(f"{k}_alerts") for k in FAMILIES]
    b = alerts.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active_alerts"), F.count_if(F.col("status") == "resolved").alias("resolved_alerts"), *kinds)
    both = a.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(b))  # a row each
    return both.withColumn("flagged_percent", half_up(ratio(F.col("flagged"), F.col("accounts")) * 100, 1))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of (score, label) over equal bins; a score of exactly 1 is in no bin but counts in the total."""
    edge = scored.sparkSession.createDataFrame([(k, k * (1 / bins), (k + 1) * (1 / bins)) for k in range(bins)], "bin int, low double, high double")
    total = scored.agg(F.count("*").alias("total"))
    binned = scored.join(F.broadcast(edge), (F.col("score") >= F.col("low")) & (F.col("score") < F.col("high")))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("label").alias("y"))
    return per.crossJoin(F.broadcast(total)).agg(half_up(F.sum(F.abs(F.col("s") - F.col("y")) * F.col("n")) / F.first("total"), 6).alias("ece"))


def graph_risk_legacy(ledger: DataFrame, accounts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A risk out of 100 from degrees and flagged payments."""
    pairs = edges(ledger) if pairs is None else pairs
    flagged = lambda at, name: pairs.groupBy(F.col(at).alias("id")).agg(F.sum("n_flagged").alias(name))
    both = accounts.select("id").join(degrees(ledger, pairs).withColumnRenamed("account", "id"), "id", "left").join(flagged("dst", "f_in"), "id", "left").join(flagged("src", "f_out"), "id", "left").fillna(0)
    both = both.crossJoin(F.broadcast(accounts.agg(F.count("*").alias("size"))))  # one row
    i, o = F.col("in_degree"), F.col("out_degree")
    c = F.when(F.col("size") > 1, F.least(F.lit(1.0), (i + o) / (F.col("size") * 0.5))).otherwise(0.0)
    terms = c * 100 + i * 2.5 + o * 2.5 + i * 0.9 + o * 0.9 + F.col("f_in") * 10 + F.col("f_out") * 10
    return both.select("id", half_up(c, 4).alias("centrality"), half_up(F.least(F.lit(100.0), terms / 7 * 8), 1).alias("risk"))


def node_index(ledger: DataFrame) -> DataFrame:
    """(source_idx, target_idx, amount): flows between accounts numbered densely in the order of their ids.

    Numbers come from a range sort: counts of the parts give each part its
    offset, so no task sees all ids.
    """
    from pyspark.sql import Window

    nodes = ledger.select(F.col("src").alias("id")).union(ledger.select("dst")).distinct()
    parts = checkpoint(nodes.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each part
    index = parts.join(F.broadcast(offsets), "part").select("id", (F.row_number().over(Window.partitionBy("part").orderBy("id")) + F.col("offset") - 1).alias("idx"))
    flow = ledger.groupBy("src", "dst").agg(F.sum("amount").cast("double").alias("amount"))
    flow = flow.join(index.select(F.col("id").alias("src"), F.col("idx").alias("source_idx")), "src").join(index.select(F.col("id").alias("dst"), F.col("idx").alias("target_idx")), "dst")
    return flow.select("source_idx", "target_idx", "amount")
