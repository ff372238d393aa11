"""Pattern detectors over a ledger (txn_id, src, dst, amount, ts, type, flagged) and accounts (id, balance, ...).

Every detector returns one row for each finding with the account, a severity and
its measures. Nothing is cut off; `top_n` ranks findings if a report wants a few.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import strong_components
from ..functions.lineage import checkpoint
from ..functions.scalars import half_up, millis, ratio

MINUTE = 60_000
THRESHOLDS = (10_000, 50_000, 100_000, 200_000)
SEVERITIES = ("critical", "high", "medium", "low")


def canonical_ledger(raw: DataFrame, accounts: DataFrame) -> DataFrame:
    """Payments between known accounts, whichever of the three spellings of sender and receiver a row uses."""
    filled = lambda names: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names if c in raw.columns])
    rows = raw.withColumns({"src": filled(["from_account", "from", "sender_id"]), "dst": filled(["to_account", "to", "receiver_id"])})
    rows = rows.drop("from_account", "from", "sender_id", "to_account", "to", "receiver_id").where("src is not null and dst is not null")
    known = accounts.select("id").distinct()
    return rows.join(known, rows["src"] == known["id"], "left_semi").join(known.alias("k"), F.col("dst") == F.col("k.id"), "left_semi")


def edges(ledger: DataFrame) -> DataFrame:
    """One row for each (src, dst): payments, sum, flagged payments and the amount of the earliest one."""
    first = F.min(F.struct("ts", "txn_id", "amount"))["amount"]
    return ledger.groupBy("src", "dst").agg(F.count("*").alias("n_txn"), F.sum("amount").alias("amount_sum"), F.count_if("flagged").alias("n_flagged"), first.alias("first_amount"))


#: Partners that a finding lists by name; its counts are of all, and `fan_partners` has all as rows.
LISTED = 100


def _fan(ledger: DataFrame, at: str, other: str, least: int, critical: int, list_cap: int) -> DataFrame:
    # distinct pairs first, so a busy account is summed from as many parts as it has partners
    pairs = ledger.groupBy(at, other).agg(F.sum("amount").alias("amount"))
    total = [F.count("*").alias("partners"), F.sum("amount").cast("double").alias("total")]
    named = lambda rows: F.array_join(F.sort_array(F.collect_list(rows)), ",").alias("accounts")
    # the first partners by name alone are listed, which Spark cuts off before the shuffle; the counts are of all
    few = pairs.withColumn("k", F.row_number().over(Window.partitionBy(at).orderBy(other))).where(F.col("k") <= list_cap)
    found = pairs.groupBy(F.col(at).alias("account")).agg(*total).join(few.groupBy(F.col(at).alias("account")).agg(named(other)), "account")
    return found.where(F.col("partners") >= least).withColumn("severity", F.when(F.col("partners") >= critical, "critical").otherwise("high"))


def fan_in(ledger: DataFrame, least: int = 3, critical: int = 7, list_cap: int = LISTED) -> DataFrame:
    """Receivers of payments from several senders, of whom the first `list_cap` by name are listed."""
    return _fan(ledger, "dst", "src", least, critical, list_cap)


def fan_out(ledger: DataFrame, least: int = 3, critical: int = 8, list_cap: int = LISTED) -> DataFrame:
    """Senders of payments to several receivers, of whom the first `list_cap` by name are listed."""
    return _fan(ledger, "src", "dst", least, critical, list_cap)


def fan_partners(ledger: DataFrame, least: int = 3) -> DataFrame:
    """(account, direction, partner, n, amount): every partner of the accounts that `fan_in` and `fan_out` find, a row each."""
    pairs = ledger.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))

    def side(at: str, other: str, direction: str) -> DataFrame:
        many = pairs.groupBy(at).agg(F.count("*").alias("partners")).where(F.col("partners") >= least).select(at)
        return pairs.join(many, at).select(F.col(at).alias("account"), F.lit(direction).alias("direction"), F.col(other).alias("partner"), "n", "amount")

    return side("dst", "src", "in").union(side("src", "dst", "out"))


def degrees(ledger: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(account, in_degree, out_degree, n_in, n_out, amount_in, amount_out); `pairs` are the edges, if they are there already."""
    pairs = edges(ledger) if pairs is None else pairs
    side = lambda at, d: pairs.groupBy(F.col(at).alias("account")).agg(F.count("*").alias(f"{d}_degree"), F.sum("n_txn").alias(f"n_{d}"), F.sum("amount_sum").cast("double").alias(f"amount_{d}"))
    return side("dst", "in").join(side("src", "out"), "account", "full").fillna(0)


def structuring(ledger: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Repeated amounts just below a reporting threshold."""
    below = ledger.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    below = below.where((F.col("amount") >= F.col("threshold") * F.lit(85) / 100) & (F.col("amount") < F.col("threshold")))
    found = below.groupBy(F.col("src").alias("account"), F.col("threshold").cast("long").alias("threshold")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))
    return found.where("n >= 3").select("*", half_up(F.col("total") / F.col("n")).alias("mean"), F.when(F.col("n") >= 5, "critical").otherwise("high").alias("severity"))


def pass_through(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Money that leaves about as it came, from an account that keeps little."""
    flows = degrees(ledger).where("n_in >= 2 and n_out >= 2").join(accounts.select(F.col("id").alias("account"), "balance"), "account")
    flows = flows.withColumn("ratio", ratio(F.col("amount_out"), F.col("amount_in")))
    flows = flows.where((F.col("ratio") > 0.8) & (F.col("ratio") < 1.2) & (F.col("balance") < 0.1 * F.col("amount_in")))
    return flows.select("account", half_up(F.col("ratio"), 3).alias("ratio"), F.col("in_degree").alias("sources"), F.col("out_degree").alias("targets"), "amount_in", "amount_out", F.when(F.col("ratio") > 0.95, "critical").otherwise("high").alias("severity"))


def night_owl(ledger: DataFrame, share: float = 0.4, critical: float = 0.7) -> DataFrame:
    found = ledger.groupBy(F.col("src").alias("account")).agg(F.count("*").alias("n"), F.count_if(F.hour("ts") < 5).alias("night"))
    found = found.where("n >= 5 and night >= 3").withColumn("share", F.col("night") / F.col("n")).where(F.col("share") > share)
    return found.select("account", "n", "night", half_up(F.col("share") * 100).alias("percent"), F.when(F.col("share") > critical, "critical").otherwise("high").alias("severity"))


#: The payments of an account within so many ms are ordered by one task; a busy account is cut into such slices.
SLICE = 6 * 3_600_000


def _gaps(rows: DataFrame) -> DataFrame:
    """(account, txn_id, amount, ms, slice, since): payments with the ms since the one before of the same account, null for its first.

    Slices are ordered on their own; only the last payment of each is handed on to
    the next, in a table of a row a slice.
    """
    rows = rows.where("ms is not null").withColumn("slice", F.floor(F.col("ms") / SLICE))
    ends = rows.groupBy("account", "slice").agg(F.max("ms").alias("last"))
    before = ends.select("account", "slice", F.lag("last").over(Window.partitionBy("account").orderBy("slice")).alias("before"))
    within = Window.partitionBy("account", "slice").orderBy("ms", "txn_id")
    rows = rows.withColumn("previous", F.lag("ms").over(within)).join(before, ["account", "slice"])
    return rows.withColumn("since", F.col("ms") - F.coalesce("previous", "before")).drop("previous", "before")


def _runs(rows: DataFrame, account: str, gap: int, strict: bool) -> DataFrame:
    """(account, start, size, amount) of runs whose neighbours are at most `gap` ms apart."""
    rows = _gaps(rows.select(F.col(account).alias("account"), "txn_id", "amount", millis(F.col("ts")).alias("ms")))
    new = F.col("since").isNull() | (F.col("since") >= gap if strict else F.col("since") > gap)
    rows = rows.withColumn("new", new.cast("int"))
    # runs are numbered within a slice, and go on from the number that the slices before have reached
    numbers = rows.groupBy("account", "slice").agg(F.sum("new").alias("news"))
    reached = F.sum("news").over(Window.partitionBy("account").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    numbers = numbers.select("account", "slice", F.coalesce(reached, F.lit(0)).alias("reached"))
    within = Window.partitionBy("account", "slice").orderBy("ms", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("new").over(within)).join(numbers, ["account", "slice"]).withColumn("run", F.col("run") + F.col("reached"))
    return rows.groupBy("account", "run").agg(F.min("ms").alias("start"), F.count("*").alias("size"), F.sum("amount").cast("double").alias("amount"))


def burst_activity(ledger: DataFrame, gap_minutes: float = 5, least: int = 5) -> DataFrame:
    """The longest run of payments in quick succession of each sender; the first of equally long ones."""
    runs = _runs(ledger, "src", int(gap_minutes * MINUTE), strict=False)
    best = runs.groupBy("account").agg(F.max(F.struct("size", (-F.col("start")).alias("early"), "amount")).alias("b"))
    return best.select("account", "b.size", "b.amount").where(F.col("size") >= least).withColumn("severity", F.when(F.col("size") >= 10, "critical").otherwise("high"))


def account_view(ledger: DataFrame) -> DataFrame:
    """Each payment once for each account in it: (account, other, incoming, ...); a payment to oneself appears once."""
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit(False).alias("incoming"))))
    both = both.otherwise(F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit(False).alias("incoming")), F.struct(F.col("dst").alias("account"), F.col("src").alias("other"), F.lit(True).alias("incoming"))))
    return ledger.select("*", F.inline(both))


def max_burst(ledger: DataFrame, gap_minutes: float = 5) -> DataFrame:
    """The longest run of an account's payments with gaps below the limit; 0 if no two are that close."""
    runs = _runs(account_view(ledger).drop("src", "dst"), "account", int(gap_minutes * MINUTE), strict=True)
    return runs.groupBy("account").agg(F.max("size").alias("size")).select("account", F.when(F.col("size") >= 2, F.col("size")).otherwise(0).alias("max_burst"))


def automated_timing(ledger: DataFrame, cv: float = 0.2, critical: float = 0.1) -> DataFrame:
    """Senders whose gaps between payments hardly vary."""
    rows = _gaps(ledger.select(F.col("src").alias("account"), "txn_id", "amount", millis(F.col("ts")).alias("ms")))
    found = rows.groupBy("account").agg(F.count("*").alias("n"), F.avg("since").alias("mean"), F.stddev_pop("since").alias("spread")).where("n >= 10")
    found = found.withColumn("cv", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("spread") / F.col("mean"))).where(F.col("cv") < cv)
    return found.select("account", "n", half_up(F.col("cv"), 4).alias("cv"), half_up((1 - F.col("cv")) * 100).alias("regularity"), F.when(F.col("cv") < critical, "critical").otherwise("high").alias("severity"))


#: Payments of an account and slot, of one side, that a task compares with as many of the other.
CELL = 4096


def _grid(rows: DataFrame, sizes: DataFrame, mine: str, other: str) -> DataFrame:
    """`rows` with (part_in, part_out): its own part of its side by hash, and a copy for each part of the other side."""
    parts = lambda side: F.greatest(F.lit(1), F.ceil(F.col(f"n_{side}") / CELL)).cast("int")
    rows = rows.join(sizes, ["account", "slot"])
    own = F.pmod(F.xxhash64(f"{mine}_txn"), parts(mine)).cast("int")
    return rows.withColumns({f"part_{mine}": own, f"part_{other}": F.explode(F.sequence(F.lit(0), parts(other) - 1))}).drop("n_in", "n_out")


def rapid_movement(ledger: DataFrame, minutes: float = 30, forward_only: bool = False) -> DataFrame:
    """Money received and sent on by an account within minutes, other than back to where it came from.

    Both sides meet by account and time slot of the window's length; the paying
    side looks into its own slot and the two beside it. A busy slot is a grid of
    parts of both sides, so a task compares CELL payments with CELL at most; copies
    are a CELL-th of the pairs found. `rapid_counts` counts pairs without making them.
    """
    width = int(minutes * MINUTE)
    slot = F.floor(F.col("ms") / width)
    rows = ledger.withColumn("ms", millis(F.col("ts")))
    came = rows.select(F.col("dst").alias("account"), F.col("src").alias("origin"), F.col("txn_id").alias("in_txn"), F.col("amount").alias("in_amount"), F.col("ms").alias("in_ms"), slot.alias("slot"))
    went = rows.select(F.col("src").alias("account"), F.col("dst").alias("target"), F.col("txn_id").alias("out_txn"), F.col("amount").alias("out_amount"), F.col("ms").alias("out_ms"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    count = lambda df, name: df.groupBy("account", "slot").agg(F.count("*").alias(name))
    sizes = count(came, "n_in").join(count(went, "n_out"), ["account", "slot"])
    gap = F.col("out_ms") - F.col("in_ms")
    near = _grid(came, sizes, "in", "out").join(_grid(went, sizes, "out", "in"), ["account", "slot", "part_in", "part_out"])
    near = near.where((F.abs(gap) <= width) & (F.col("origin") != F.col("target")) & (F.col("in_txn") != F.col("out_txn")))
    if forward_only:
        near = near.where(gap >= 0)
    apart = F.abs(gap) / MINUTE
    return near.select("account", "in_txn", "out_txn", half_up(apart, 1).alias("minutes"), F.col("in_amount").cast("double").alias("in_amount"), F.col("out_amount").cast("double").alias("out_amount"), F.when(apart < 5, "critical").otherwise("high").alias("severity"))


def _flow_pairs(events: DataFrame, by: list[str], reach: int) -> DataFrame:
    """(by..., pairs): pairs of one incoming and one outgoing event of `events(by..., ms, inward, outward)` at most `reach` ms apart.

    Time is cut into slices; what comes in within reach of a border is handed to the
    slices beyond it, so slices are counted on their own, from a row for each moment.
    """
    width = max(SLICE, reach)
    each = events.where("ms is not null").groupBy(*by, "ms").agg(F.sum("inward").alias("inward"), F.sum("outward").alias("outward"))
    own = F.floor(F.col("ms") / width)
    reached = F.sequence(F.floor((F.col("ms") - reach) / width), F.floor((F.col("ms") + reach) / width))
    # what goes out is counted in its own slice alone
    dealt = each.withColumn("home", own).withColumn("slice", F.explode(F.when(F.col("inward") > 0, reached).otherwise(F.array(own))))
    near = Window.partitionBy(*by, "slice").orderBy("ms").rangeBetween(-reach, reach)
    paired = dealt.withColumn("pairs", F.when(F.col("slice") == F.col("home"), F.col("outward")).otherwise(0) * F.sum("inward").over(near))
    return paired.groupBy(*by).agg(F.sum("pairs").alias("pairs"))


def _events(ledger: DataFrame) -> DataFrame:
    """(account, other, ms, inward, outward): each payment as it leaves one account and reaches another."""
    side = lambda at, other, inward: ledger.select(F.col(at).alias("account"), F.col(other).alias("other"), millis(F.col("ts")).alias("ms"), F.lit(int(inward)).alias("inward"), F.lit(int(not inward)).alias("outward"))
    return side("dst", "src", True).union(side("src", "dst", False))


def fast_flow_pairs(ledger: DataFrame, window_ms: int = 3_600_000) -> DataFrame:
    """(account, pairs): how many (incoming, outgoing) pairs lie less than an hour apart."""
    return _flow_pairs(_events(ledger), ["account"], window_ms - 1)


def rapid_counts(ledger: DataFrame, minutes: float = 30) -> DataFrame:
    """(account, pairs): how many rows `rapid_movement` has for each account that has any, counted and not made."""
    reach = int(minutes * MINUTE)
    events = _events(ledger)
    every = _flow_pairs(events, ["account"], reach)
    # pairs back to where the money came from, a payment to oneself with itself among them
    back = _flow_pairs(events, ["account", "other"], reach).groupBy("account").agg(F.sum("pairs").alias("back"))
    both = every.join(back, "account").select("account", (F.col("pairs") - F.col("back")).alias("pairs"))
    return both.where("pairs > 0")


#: The detectors, in the order in which their findings are listed.
ORDER = ("rapid_movement", "fan_in", "fan_out", "circular_transfer", "layering_chain", "structuring", "night_owl", "burst_activity", "automated_timing", "pass_through", "community_cluster", "bridge_account")


def findings(ledger: DataFrame, accounts: DataFrame, paths: DataFrame | None = None, graph: DataFrame | None = None, list_cap: int = LISTED, **loose: float) -> DataFrame:
    """Findings of all detectors: (pattern, account, severity, amount, accounts array, measures map).

    Cycles and chains are looked for in the edges `paths` (all of the ledger's
    unless given). `loose` loosens or tightens detectors; `longest_cycle` bounds
    cycles, whose number multiplies with the degree. `graph(id, community, bridge)`, if given, adds the accounts of close
    communities and the bridges between them.
    """
    paths = edges(ledger) if paths is None else paths
    split = lambda c, by: F.split(c, by)
    none = F.lit(None).cast("array<string>")
    burst = loose.get("burst_minutes", 5)
    first = lambda df: df.withColumn("account", F.substring_index("path", ">", 1))
    found = {
        "rapid_movement": (rapid_movement(ledger, loose.get("rapid_minutes", 30)), F.col("in_amount"), none, ["minutes", "in_amount", "out_amount"]),
        "fan_in": (fan_in(ledger, list_cap=list_cap), F.col("total"), split("accounts", ","), ["partners", "total"]),
        "fan_out": (fan_out(ledger, list_cap=list_cap), F.col("total"), split("accounts", ","), ["partners", "total"]),
        "circular_transfer": (first(cycles(paths, longest=loose.get("longest_cycle", 6), few=loose.get("few"))), F.col("total"), split("path", ">"), ["size", "total"]),
        "layering_chain": (first(layering_chains(paths, deviation=loose.get("deviation", 0.3), few_in=loose.get("few_in", 1))), F.col("mean"), split("path", ">"), ["size", "mean", "deviation"]),
        "structuring": (structuring(ledger), F.col("total"), none, ["threshold", "n", "total", "mean"]),
        "night_owl": (night_owl(ledger, loose.get("night", 0.4)), F.lit(0.0), none, ["n", "night", "percent"]),
        "burst_activity": (burst_activity(ledger, burst).withColumn("window", F.lit(burst)), F.col("amount"), none, ["size", "amount", "window"]),
        "automated_timing": (automated_timing(ledger, loose.get("cv", 0.2)), F.lit(0.0), none, ["n", "cv", "regularity"]),
        "pass_through": (pass_through(ledger, accounts), F.lit(0.0), none, ["ratio", "amount_in", "amount_out", "sources", "targets"]),
    }
    if graph is not None:
        level = lambda c: F.when(F.col(c) > 0.75, "critical").otherwise("high").alias("severity")
        found["community_cluster"] = (graph.where("community > 0.5").select(F.col("id").alias("account"), "community", level("community")), F.lit(0.0), none, ["community"])
        found["bridge_account"] = (graph.where("bridge > 0.3").select(F.col("id").alias("account"), "bridge", level("bridge")), F.lit(0.0), none, ["bridge"])
    measures = lambda names: F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))]).alias("measures")
    parts = [df.select(F.lit(name).alias("pattern"), "account", "severity", amount.cast("double").alias("amount"), listed.alias("accounts"), measures(names)) for name, (df, amount, listed, names) in found.items()]
    return reduce(DataFrame.unionByName, parts)


def all_patterns(ledger: DataFrame, accounts: DataFrame, paths: DataFrame | None = None, **loose: float) -> DataFrame:
    """Findings of the detectors in one table: (pattern, account, severity, amount)."""
    return findings(ledger, accounts, paths, **loose).select("pattern", "account", "severity", "amount")


def top_n(patterns: DataFrame, n: int) -> DataFrame:
    """The first n findings by severity, pattern and account."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return patterns.orderBy(rank, "pattern", "account", F.desc("amount")).limit(n)


def strong_edges(pairs: DataFrame) -> DataFrame:
    """The edges (src, dst, amount_sum) inside strongly connected components, checkpointed: those that lie on any cycle."""
    e = pairs.where("src != dst").select("src", "dst", "amount_sum")
    member = strong_components(e.select("src", "dst"))
    side = lambda c: member.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    return checkpoint(e.join(side("src"), "src").join(side("dst"), "dst").where("src_component = dst_component").select("src", "dst", "amount_sum"))


def _halves(e: DataFrame, hops: int, back: bool) -> dict[int, DataFrame]:
    """For 1 to `hops`: (a, b, inner array, total) of paths from a to b, or with `back` from b to a, over accounts that are all larger than a."""
    near, far = ("dst", "src") if back else ("src", "dst")
    now = e.where(F.col(far) > F.col(near)).select(F.col(near).alias("a"), F.col(far).alias("b"), F.array().cast(f"array<{e.schema['src'].dataType.simpleString()}>").alias("inner"), F.col("amount_sum").alias("total"))
    hop = e.select(F.col(near).alias("b"), F.col(far).alias("next"), F.col("amount_sum").alias("leg"))
    found = {1: now}
    for k in range(2, hops + 1):
        grown = found[k - 1].join(hop, "b").where((F.col("next") > F.col("a")) & (F.col("next") != F.col("b")) & ~F.array_contains("inner", F.col("next")))
        inner = F.concat(F.array("b"), "inner") if back else F.concat("inner", F.array("b"))
        found[k] = grown.select("a", F.col("next").alias("b"), inner.alias("inner"), (F.col("total") + F.col("leg")).alias("total"))
        if k > 1 and hops > 2:
            found[k] = checkpoint(found[k])
    return found


def _closed(e: DataFrame, sizes: range) -> list[DataFrame]:
    """(path, size, total) of the simple cycles of each size, from its least account on: a half out and a half back that meet at both ends."""
    out, home = _halves(e, (sizes[-1] + 1) // 2, back=False), _halves(e, sizes[-1] // 2, back=True)
    found = []
    for size in sizes:
        there, back = out[(size + 1) // 2], home[size // 2].select("a", "b", F.col("inner").alias("later"), F.col("total").alias("rest"))
        both = there.join(back, ["a", "b"]).where(~F.arrays_overlap("inner", "later"))
        found.append(both.select(F.concat(F.array("a"), "inner", F.array("b"), "later").alias("path"), F.lit(size).alias("size"), (F.col("total") + F.col("rest")).cast("double").alias("total")))
    return found


def cycles(pairs: DataFrame, longest: int = 6, whole: int = 4, few: int | None = None) -> DataFrame:
    """Simple directed cycles of 2 to `longest` accounts, one for each set of accounts, the smallest path of the set.

    Edges outside strongly connected components go first, unless only cycles of up to
    three are asked for, which two joins find at once. A cycle is two halves of
    three hops at most that meet by both ends, so tables of paths never have more
    than the half of a cycle's hops. Cycles of up to `whole` accounts are looked for
    among all edges. Longer ones multiply with the degree: with `few`, they are looked
    for among edges of accounts that pay `few` others at most to accounts that `few`
    others pay at most; `cycle_counts` counts them among all.
    """
    e = strong_edges(pairs) if longest > 3 else checkpoint(pairs.where("src != dst").select("src", "dst", "amount_sum"))
    found = _closed(e, range(2, min(whole, longest) + 1))
    if longest > whole:
        if few is not None:
            side = lambda c: e.groupBy(c).agg(F.count("*").alias("d")).where(F.col("d") <= few).select(c)
            e = strong_edges(e.join(side("src"), "src").join(side("dst"), "dst"))
        found += _closed(e, range(whole + 1, longest + 1))
    every = reduce(DataFrame.union, found).withColumn("text", F.array_join("path", ">")).withColumn("members", F.array_join(F.array_sort("path"), ","))
    best = every.groupBy("members").agg(F.min(F.struct("path", "text", "size", "total")).alias("b"))
    return best.select("members", F.col("b.text").alias("path"), "b.size", "b.total", F.when(F.col("b.size") <= 2, "critical").when(F.col("b.size") <= 4, "high").otherwise("medium").alias("severity"))


def _counted(parts: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(by..., a column for each part): the sums of `n` of parts (by..., n), 0 where a part lacks a row."""
    rows = [df.select(*by, *[(F.col("n") if name == own else F.lit(0)).cast("long").alias(name) for name in parts]) for own, df in parts.items()]
    return reduce(DataFrame.union, rows).groupBy(*by).agg(*[F.sum(name).alias(name) for name in parts])


def cycle_counts(pairs: DataFrame, longest: int = 6) -> DataFrame:
    """(account, size, n): how many simple directed cycles of 2 to `longest` (at most 6) accounts have `account` as their least one.

    Neither cycles nor paths are made, only numbers of walks over accounts larger than
    the least one, a: `l1` to `l3` from a to each z, by hops, and `h1` to `h3` back. Three
    hops are summed up from two by one join. Their products count cycles and closed walks
    that pass a second account c twice, which are taken off by what they hold, namely
    loops of three and ways there and back, all over accounts larger than a:

    * at z = c: `r` accounts that c pays and is paid by (`r1` where a pays c), `u` of them
      that a pays, `v` that pay a, `w` that do both; `t` loops of three from c;
    * by a: `q` loops (x, y, z) with a paying x and paid by y, `p` those whose leg from x
      to y leads back too, with a paying y and paid by x; `s` closed walks of four hops
      from a c that a pays and is paid by.
    """
    e = strong_edges(pairs)
    # numbers in the order of the names join and group faster
    ids = checkpoint(e.select(F.col("src").alias("id")).distinct().orderBy("id").withColumn("number", F.monotonically_increasing_id()))
    side = lambda c: ids.select(F.col("id").alias(c), F.col("number").alias(f"{c}_number"))
    e = checkpoint(e.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst")))
    named = lambda df, *names: df.toDF(*names)
    one = F.lit(1).cast("long").alias("n")
    above = F.col("z") > F.col("a")
    mutual = checkpoint(e.join(named(e, "dst", "src"), ["src", "dst"]).select("src", "dst"))
    out1, home1 = named(e, "a", "z").where(above).select("a", "z", one), named(e, "z", "a").where(above).select("a", "z", one)

    def on(walks: DataFrame, steps: DataFrame) -> DataFrame:
        """(a, z, n): walks that go one of `steps(y, z)` on, not summed up."""
        return walks.withColumnRenamed("z", "y").join(named(steps, "y", "z"), "y").where(above).select("a", "z", "n")

    def returns(found: DataFrame) -> DataFrame:
        """(a, z, n): in how many ways each (a, z) goes on to an account larger than a and back."""
        steps = named(mutual, "z", "y")
        return found.select("a", "z").join(steps, "z").where(F.col("y") > F.col("a")).groupBy("a", "z").agg(F.count("*").alias("n"))

    forth, back = e.select("src", "dst"), e.select("dst", "src")
    summed = lambda df: checkpoint(df.groupBy("a", "z").agg(F.sum("n").alias("n")))
    l2, h2 = summed(on(out1, forth)), summed(on(home1, back))
    own = checkpoint(returns(out1))
    # loops of three (x, y, z), from each of their accounts on
    first = named(e, "x", "y").join(named(e, "y", "z"), "y").join(named(e, "z", "x"), ["z", "x"])
    loops = checkpoint(first.select("x", "y", "z"))
    low = F.least("y", "z")
    near = out1.select("a", "z").union(home1.select("a", "z")).distinct().withColumnRenamed("z", "x")
    t = loops.groupBy("x", low.alias("low")).agg(F.count("*").alias("n")).join(near, "x").where("a < low").select("a", F.col("x").alias("z"), "n")
    parts = {"l1": out1, "h1": home1, "l2": l2, "h2": h2, "r1": own, "r": returns(l2), "t": t, "u": on(out1, mutual), "v": on(home1, mutual), "w": on(named(mutual, "a", "z").where(above).select("a", "z", one), mutual)}
    sums = {
        2: "sum(l1 * h1)",
        3: "sum(l2 * h1)",
        4: "sum(l2 * h2 - l1 * h1 * r1)",
        5: "-sum(t * l1 * h1 + h1 * (l2 * r - u))",
        6: "-sum(t * (l1 * h2 + l2 * h1) + l2 * h2 * r - l2 * v - h2 * u + w - w * r + l1 * h1 * r1)",
    }
    kept = checkpoint(_counted(parts, ["a", "z"]).groupBy("a").agg(*[F.expr(sums[k]).alias(f"s{k}") for k in range(2, longest + 1)]))
    terms = [kept.select("a", F.lit(k).alias("size"), F.col(f"s{k}").alias("n")) for k in range(2, longest + 1)]
    if longest > 4:
        # three hops that end where the first did are no paths
        less = lambda df: df.select("a", "z", (-F.col("n")).alias("n"))
        there = on(l2, forth).union(less(own))
        whole = _counted({"l3": there, "h2": h2} | ({"h3": on(h2, back).union(less(returns(home1)))} if longest > 5 else {}), ["a", "z"]).where("l3 > 0")
        whole = whole.groupBy("a").agg(F.sum(F.col("l3") * F.col("h2")).alias("s5"), *([F.sum(F.col("l3") * F.col("h3")).alias("s6")] if longest > 5 else []))
        whole = checkpoint(whole)
        terms += [whole.select("a", F.lit(k).alias("size"), F.col(f"s{k}").alias("n")) for k in range(5, longest + 1)]
    if longest > 5:
        a_out, a_home = named(e, "a", "x"), named(e, "y", "a")
        closed = loops.join(a_out, "x").join(a_home, ["y", "a"]).where(F.col("a") < F.least("x", "y", "z"))
        q = closed.groupBy("a").agg(F.count("*").alias("n"))
        # the leg from x to y also leads back; a pays y and is paid by x
        both = loops.join(named(mutual, "x", "y"), ["x", "y"]).join(named(e, "a", "y"), "y").join(named(e, "x", "a"), ["x", "a"]).where(F.col("a") < F.least("x", "y", "z"))
        p = both.groupBy("a").agg((2 * F.count("*")).alias("n"))
        pair = named(mutual, "a", "c").where("c > a")

        def twice(steps: DataFrame) -> DataFrame:
            """(a, c, z, n): walks of two steps from c over accounts larger than a, other than back to c."""
            mid = pair.join(named(steps, "c", "y"), "c").where("y > a")
            return mid.join(named(steps, "y", "z"), "y").where(above & (F.col("z") != F.col("c"))).select("a", "c", "z", one)

        s = _counted({"o": twice(forth), "i": twice(back)}, ["a", "c", "z"]).groupBy("a").agg((-F.sum(F.col("o") * F.col("i"))).alias("n"))
        terms += [df.select("a", F.lit(6).alias("size"), "n") for df in (q, p, s)]
    found = reduce(DataFrame.union, terms).groupBy(F.col("a").alias("account"), "size").agg(F.sum("n").alias("n")).where("n > 0")
    return found.join(ids, found["account"] == ids["number"]).select(ids["id"].alias("account"), "size", "n")


def triangles(ledger: DataFrame) -> DataFrame:
    """Loops of three accounts, one for each set, with the amount of the smallest path's first leg.

    A link holds the amounts of both its directions and points from the end of lower
    degree to the other, so triples are listed from the rarest corner and an account
    that pays all the world is the middle of few.
    """
    e = edges(ledger).where("src != dst").select("src", "dst", F.col("first_amount").cast("double").alias("amount"))
    up = F.col("src") < F.col("dst")
    links = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.when(up, F.col("amount"))).alias("up"), F.max(F.when(~up, F.col("amount"))).alias("down"))
    links = checkpoint(links)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("k"))
    ends = links.join(degree.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    low = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    side = lambda k: ends.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias(f"v{k}"), F.when(low, F.col("up")).otherwise(F.col("down")).alias(f"to{k}"), F.when(low, F.col("down")).otherwise(F.col("up")).alias(f"from{k}"))
    met = side(1).join(side(2), "u").where("v1 < v2").join(links.withColumnsRenamed({"a": "v1", "b": "v2"}), ["v1", "v2"])
    first = F.col("u") < F.col("v1")
    leg = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    named = lambda *c: F.concat_ws(">", *c)
    one = F.when(F.expr("to1 is not null and up is not null and from2 is not null"), F.struct(F.when(first, named("u", "v1", "v2")).otherwise(named("v1", "v2", "u")).alias("path"), leg("to1", "up").alias("amount")))
    two = F.when(F.expr("to2 is not null and down is not null and from1 is not null"), F.struct(F.when(first, named("u", "v2", "v1")).otherwise(named("v1", "u", "v2")).alias("path"), leg("to2", "from1").alias("amount")))
    return met.select(F.array_join(F.array_sort(F.array("u", "v1", "v2")), ",").alias("members"), F.least(one, two).alias("b")).where("b is not null").select("members", "b.path", "b.amount")


def layering_chains(pairs: DataFrame, longest: int = 6, mean: float = 1000, deviation: float = 0.3, few_in: int = 1) -> DataFrame:
    """Simple paths of 4 to `longest` accounts from a start that `few_in` others pay at most, with like amounts on every hop; `pairs` are all edges.

    Every leg is within `deviation` of the mean, so no two differ by more than
    (1 + deviation) / (1 - deviation), and none is below (1 - deviation) * `mean`. A
    path is given up at the first leg outside, so what is held are paths of like
    amounts only. Legs are dealt by the logarithm of their amounts: a path looks into
    the three bands at most that it can go on with, also at an account that pays all
    the world.
    """
    if not 0 < deviation < 1:
        raise ValueError("deviation must lie between 0 and 1")
    slack = 1 + 1e-9  # bounds are never tighter than the test of whole paths
    ratio = (1 + deviation) / (1 - deviation) * slack
    incoming = pairs.groupBy("dst").agg(F.count("*").alias("n_in")).withColumnRenamed("dst", "src")
    leg = F.col("first_amount").cast("double")
    band = lambda x: F.floor(F.log(x) / math.log(ratio)).cast("int")
    hop = pairs.where(leg > mean * (1 - deviation) / slack).select(F.col("src").alias("at"), F.col("dst").alias("next"), leg.alias("leg"), band(leg).alias("band"))
    starts = hop.join(incoming.withColumnRenamed("src", "at"), "at", "left").where(F.coalesce("n_in", F.lit(0)) <= few_in)
    paths = starts.where("at != next").select(F.array("at", "next").alias("path"), F.col("next").alias("at"), F.array("leg").alias("legs"))
    found = []
    for size in range(3, longest + 1):
        low, high = F.array_min("legs"), F.array_max("legs")
        reached = paths.withColumns({"low": high / ratio, "high": low * ratio})
        reached = reached.withColumn("band", F.explode(F.sequence(band(F.col("low")), band(F.col("high")))))
        grown = reached.join(hop, ["at", "band"]).where((F.col("leg") >= F.col("low")) & (F.col("leg") <= F.col("high")) & ~F.array_contains("path", F.col("next")))
        paths = checkpoint(grown.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"), F.concat("legs", F.array("leg")).alias("legs")))
        if size >= 4:
            found.append(paths.select("path", "legs", F.lit(size).alias("size")))
    every = reduce(DataFrame.union, found)
    every = every.withColumn("mean", F.aggregate("legs", F.lit(0.0), lambda a, x: a + x) / F.size("legs"))
    every = every.withColumn("deviation", F.array_max(F.transform("legs", lambda x: F.abs(x - F.col("mean")))) / F.col("mean"))
    every = every.where((F.col("mean") > mean) & (F.col("deviation") < deviation))
    return every.select(F.array_join("path", ">").alias("path"), "size", half_up(F.col("mean")).alias("mean"), half_up(F.col("deviation") * 100).alias("deviation"), F.when(F.col("size") >= 5, "critical").otherwise("high").alias("severity"))
