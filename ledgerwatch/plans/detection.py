"""Registered queries of the detectors, with their SQL."""

from __future__ import annotations

from ..operators import patterns as P
from ..sources import tables as T
from .prelude import oracle
from .prelude import rounded as r


#: Looser than by default, as events at random hold few patterns: no account is paid by one other alone, so chains start where few pay, with amounts more alike instead.
LOOSE = {"night": 0.25, "burst_minutes": 360, "cv": 0.9, "deviation": 0.05, "few_in": 36, "longest_cycle": 3}


def _cycles(table: str, sizes: range) -> str:
    """(p, size, total): the simple cycles of each size among the edges of a table, from their least account on."""
    parts = []
    for size in sizes:
        nodes = ["e1.src"] + [f"e{k}.dst" for k in range(1, size)]
        joins = f"{table} e1 " + " ".join(f"JOIN {table} e{k} ON e{k}.src = e{k - 1}.dst" for k in range(2, size + 1))
        apart = " AND ".join(f"{nodes[j]} <> {nodes[i]}" for i in range(1, size) for j in range(1, i)) or "TRUE"
        least = " AND ".join(f"{x} > e1.src" for x in nodes[1:])
        total = " + ".join(f"e{k}.amount_sum" for k in range(1, size + 1))
        parts.append(f"SELECT [{', '.join(nodes)}] AS p, {size} AS size, CAST({total} AS DOUBLE) AS total FROM {joins} WHERE e{size}.dst = e1.src AND {least} AND {apart}")
    return " UNION ALL ".join(parts)


def _circular(every: str) -> str:
    return f"""
SELECT members, arg_min(array_to_string(p, '>'), p) AS path, arg_min(size, p) AS size, arg_min(total, p) AS total,
  CASE WHEN arg_min(size, p) <= 2 THEN 'critical' WHEN arg_min(size, p) <= 4 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT *, array_to_string(list_sort(p), ',') AS members FROM ({every})) GROUP BY members"""


#: Cycles of up to three accounts are listed from all edges, longer ones from accounts of so few partners each way; those of four are listed from all and summed up.
FEW = 8
_FEW_EDGES = f"""
few_edges AS (
  SELECT * FROM edges WHERE src <> dst AND src IN (SELECT src FROM edges WHERE src <> dst GROUP BY src HAVING count(*) <= {FEW}) AND dst IN (SELECT dst FROM edges WHERE src <> dst GROUP BY dst HAVING count(*) <= {FEW}))"""


def _half(hops: int, back: bool) -> str:
    """(a, b, x1...): paths of one direction over accounts larger than a."""
    near, far = ("dst", "src") if back else ("src", "dst")
    joins = "edges e1 " + " ".join(f"JOIN edges e{k} ON e{k}.{near} = e{k - 1}.{far}" for k in range(2, hops + 1))
    nodes = [f"e{k}.{far}" for k in range(1, hops + 1)]
    apart = " AND ".join([f"{x} > e1.{near}" for x in nodes] + [f"{nodes[i]} <> {nodes[j]}" for i in range(hops) for j in range(i)])
    inner = ", ".join(f"{x} AS x{k}" for k, x in enumerate(nodes[:-1][:: -1 if back else 1], 1))
    return f"SELECT e1.{near} AS a, {nodes[-1]} AS b{', ' if inner else ''}{inner} FROM {joins} WHERE {apart}"


def _cycle_counts() -> str:
    """Cycles of 5 and 6 from halves: all pairs less those that share accounts, with shared accounts summed by the places they have."""
    direct = f"SELECT p[1] AS account, size, count(*) AS n FROM ({_cycles('edges', range(2, 5))}) GROUP BY 1, 2"

    def met(out: str, home: str, on: list[tuple[str, str]], sign: int, size: int) -> str:
        keys = lambda names: "".join(f", {x}" for x in names)
        left, right = [x for x, _ in on], [y for _, y in on]
        join = "".join(f" AND o.{x} = h.{y}" for x, y in on)
        return f"SELECT o.a AS account, {size} AS size, {sign} * o.n * h.n AS n FROM (SELECT a, b{keys(left)}, count(*) AS n FROM {out} GROUP BY a, b{keys(left)}) o JOIN (SELECT a, b{keys(right)}, count(*) AS n FROM {home} GROUP BY a, b{keys(right)}) h ON o.a = h.a AND o.b = h.b{join}"

    five = [met("out3", "home2", on, sign, 5) for on, sign in (([], 1), ([("x1", "x1")], -1), ([("x2", "x1")], -1))]
    six = [met("out3", "home3", on, sign, 6) for on, sign in (([], 1), ([("x1", "x1")], -1), ([("x1", "x2")], -1), ([("x2", "x1")], -1), ([("x2", "x2")], -1), ([("x1", "x1"), ("x2", "x2")], 1), ([("x1", "x2"), ("x2", "x1")], 1))]
    return f"SELECT account, size, CAST(sum(n) AS BIGINT) AS n FROM ({' UNION ALL '.join([direct, *five, *six])}) GROUP BY account, size HAVING sum(n) > 0"


_HALVES = f"out3 AS MATERIALIZED ({_half(3, False)}), home2 AS MATERIALIZED ({_half(2, True)}), home3 AS MATERIALIZED ({_half(3, True)})"


def _chains(longest: int = 6) -> str:
    ratio = (1 + LOOSE["deviation"]) / (1 - LOOSE["deviation"]) * 1.000001  # legs further apart than that deviate by more from any mean
    parts = []
    for size in range(4, longest + 1):
        nodes = ["e1.src"] + [f"e{k}.dst" for k in range(1, size)]
        amounts = [f"CAST(e{k}.first_amount AS DOUBLE)" for k in range(1, size)]
        like = lambda k: "".join(f" AND {amounts[k]} <= {ratio} * {amounts[j]} AND {amounts[j]} <= {ratio} * {amounts[k]}" for j in range(k))  # noqa: B023, E731
        joins = "starts JOIN edges e1 ON e1.src = starts.src " + " ".join(f"JOIN edges e{k} ON e{k}.src = e{k - 1}.dst{like(k - 1)}" for k in range(2, size))
        apart = " AND ".join(f"{nodes[j]} <> {nodes[i]}" for i in range(size) for j in range(i))
        parts.append(f"SELECT [{', '.join(nodes)}] AS p, {size} AS size, [{', '.join(amounts)}] AS legs FROM {joins} WHERE {apart}")
    return f"""
SELECT array_to_string(p, '>') AS path, size, {r('mean')} AS mean, {r('deviation * 100')} AS deviation, CASE WHEN size >= 5 THEN 'critical' ELSE 'high' END AS severity
FROM (SELECT *, list_max(list_transform(legs, lambda x: abs(x - mean))) / mean AS deviation FROM (SELECT *, list_sum(legs) / len(legs) AS mean FROM ({' UNION ALL '.join(parts)})))
WHERE mean > 1000 AND deviation < {LOOSE["deviation"]}"""


_RUNS = """
SELECT account, sum(fresh) OVER (PARTITION BY account ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) AS run, ms, amount FROM (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY account ORDER BY ms, txn_id) {test} THEN 0 ELSE 1 END AS fresh FROM {rows})"""

_FAN = """
SELECT account, count(*) AS partners, CAST(sum(amount) AS DOUBLE) AS total, array_to_string(list_sort(list(other))[:100], ',') AS accounts,
  CASE WHEN count(*) >= {critical} THEN 'critical' ELSE 'high' END AS severity
FROM (SELECT {at} AS account, {other} AS other, sum(amount) AS amount FROM {rows} GROUP BY 1, 2) GROUP BY account HAVING count(*) >= 3"""

_STRUCTURING = f"""
SELECT account, threshold, n, total, {r('total / n')} AS mean, CASE WHEN n >= 5 THEN 'critical' ELSE 'high' END AS severity FROM (
  SELECT src AS account, threshold, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total
  FROM ledger, (SELECT unnest([10000, 50000, 100000, 200000])::BIGINT AS threshold) WHERE amount >= threshold * 0.85 AND amount < threshold GROUP BY 1, 2) WHERE n >= 3"""

_PASS = f"""
SELECT account, {r('ratio', 3)} AS ratio, in_degree AS sources, out_degree AS targets, amount_in, amount_out, CASE WHEN ratio > 0.95 THEN 'critical' ELSE 'high' END AS severity
FROM (SELECT deg.*, amount_out / amount_in AS ratio, balance FROM deg JOIN accounts ON id = account WHERE n_in >= 2 AND n_out >= 2 AND amount_in > 0)
WHERE ratio > 0.8 AND ratio < 1.2 AND balance < 0.1 * amount_in"""

_NIGHT = f"""
SELECT account, n, night, {r('CAST(night AS DOUBLE) / n * 100')} AS percent, CASE WHEN CAST(night AS DOUBLE) / n > 0.7 THEN 'critical' ELSE 'high' END AS severity
FROM (SELECT src AS account, count(*) AS n, count(*) FILTER (hour(ts) < 5) AS night FROM ledger GROUP BY 1) WHERE n >= 5 AND night >= 3 AND CAST(night AS DOUBLE) / n > 0.25"""

_BURST = f"""
SELECT account, size, amount, CASE WHEN size >= 10 THEN 'critical' ELSE 'high' END AS severity FROM (
  SELECT account, run, count(*) AS size, CAST(sum(amount) AS DOUBLE) AS amount, row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, min(ms)) AS k
  FROM ({_RUNS.format(test='<= 21600000', rows='(SELECT src AS account, txn_id, amount, ms FROM ledger)')}) GROUP BY 1, 2) WHERE k = 1 AND size >= 5"""

_MAX_BURST = f"""
SELECT account, CASE WHEN max(size) >= 2 THEN max(size) ELSE 0 END AS max_burst FROM (
  SELECT account, run, count(*) AS size FROM ({_RUNS.format(test='< 21600000', rows='view_at')}) GROUP BY 1, 2) GROUP BY 1"""

_TIMING = f"""
SELECT account, n, {r('cv', 4)} AS cv, {r('(1 - cv) * 100')} AS regularity, CASE WHEN cv < 0.1 THEN 'critical' ELSE 'high' END AS severity FROM (
  SELECT src AS account, count(*) AS n, CASE WHEN avg(gap) = 0 THEN 0.0 ELSE stddev_pop(gap) / avg(gap) END AS cv
  FROM (SELECT src, ms - lag(ms) OVER (PARTITION BY src ORDER BY ms, txn_id) AS gap FROM ledger) GROUP BY 1 HAVING count(*) >= 10) WHERE cv < 0.9"""

_RAPID = f"""
SELECT i.dst AS account, i.txn_id AS in_txn, o.txn_id AS out_txn, {r('abs(o.ms - i.ms) / 60000.0', 1)} AS minutes, CAST(i.amount AS DOUBLE) AS in_amount, CAST(o.amount AS DOUBLE) AS out_amount,
  CASE WHEN abs(o.ms - i.ms) < 300000 THEN 'critical' ELSE 'high' END AS severity
FROM ledger i JOIN ledger o ON i.dst = o.src AND abs(o.ms - i.ms) <= 1800000 AND i.src <> o.dst AND i.txn_id <> o.txn_id"""

_FAST = """
SELECT account, CAST(sum(pairs) AS BIGINT) AS pairs FROM (
  SELECT a.account, CAST(coalesce(count(b.txn_id), 0) AS BIGINT) AS pairs
  FROM (SELECT src AS account, txn_id, ms FROM ledger) a LEFT JOIN ledger b ON b.dst = a.account AND abs(a.ms - b.ms) < 3600000 GROUP BY a.account, a.txn_id
  UNION ALL SELECT DISTINCT dst, 0 FROM ledger) GROUP BY account"""

_DEGREES = "SELECT * FROM deg"

_TRIANGLES = """
SELECT members, arg_min(path, path) AS path, arg_min(amount, path) AS amount FROM (
  SELECT array_to_string(list_sort([a.src, a.dst, b.dst]), ',') AS members, a.src || '>' || a.dst || '>' || b.dst AS path, CAST(a.first_amount AS DOUBLE) AS amount
  FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst) GROUP BY members"""

_STARTS = f"starts AS (SELECT DISTINCT src FROM edges WHERE src NOT IN (SELECT dst FROM edges GROUP BY dst HAVING count(*) > {LOOSE['few_in']}))"


def _whole(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


def _lakhs(x: str) -> str:
    return f"'₹' || format('{{:.1f}}', {r(f'{x} / 100000', 1)}) || 'L'"


_FAN_IN, _FAN_OUT = _FAN.format(at="dst", other="src", rows="ledger", critical=7), _FAN.format(at="src", other="dst", rows="ledger", critical=8)
_HEAD = "split_part(path, '>', 1)"
_CHAIN = "replace(path, '>', ' → ')"
#: (pattern, rows, account, amount, listed accounts, description)
_PARTS = (
    ("rapid_movement", _RAPID, "account", "in_amount", "[account]", "'Account ' || account || ' received and forwarded funds within ' || format('{:.1f}', minutes) || ' minutes.'"),
    ("fan_in", _FAN_IN, "account", "total", "string_split(accounts, ',')", f"{_whole('partners')} || ' distinct accounts transferred funds to ' || account || ', totaling ' || {_lakhs('total')} || '.'"),
    ("fan_out", _FAN_OUT, "account", "total", "string_split(accounts, ',')", f"account || ' distributed funds to ' || {_whole('partners')} || ' accounts.'"),
    ("circular_transfer", _circular(_cycles("edges", range(2, LOOSE["longest_cycle"] + 1))), _HEAD, "total", "string_split(path, '>')", f"'Funds traced through ' || {_CHAIN} || ' loop totaling ' || {_lakhs('total')} || '.'"),
    ("layering_chain", _chains(), _HEAD, "mean", "string_split(path, '>')", f"'Money passed through ' || {_whole('size')} || ' intermediate accounts in chain: ' || {_CHAIN} || '.'"),
    ("structuring", _STRUCTURING, "account", "total", "[account]", f"'Account ' || account || ' made ' || {_whole('n')} || ' transactions just below ₹' || {_whole('threshold // 1000')} || 'K threshold.'"),
    ("night_owl", _NIGHT, "account", "0.0", "[account]", f"'Account ' || account || ' conducted ' || {_whole('night')} || ' transactions between 00:00-05:00 (' || {_whole('percent')} || '% of total).'"),
    ("burst_activity", _BURST, "account", "amount", "[account]", f"'Account ' || account || ' made ' || {_whole('size')} || ' transactions within 360 minutes.'"),
    ("automated_timing", _TIMING, "account", "0.0", "[account]", f"'Account ' || account || ' shows ' || {_whole('regularity')} || '% regularity in transaction timing (CV: ' || format('{{:.3f}}', {r('cv', 3)}) || ').'"),
    ("pass_through", _PASS, "account", "0.0", "[account]", f"'Account ' || account || ' passes ' || {_whole(r('ratio * 100'))} || '% of inbound funds directly outbound (' || {_lakhs('amount_in')} || ' in → ' || {_lakhs('amount_out')} || ' out).'"),
)
#: The findings of all detectors: (pattern, account, severity, amount, listed, description).
FOUND = f"""{_STARTS},
found AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{name}' AS pattern, {account} AS account, severity, CAST({amount} AS DOUBLE) AS amount, {listed} AS listed, {text} AS description FROM ({sql})" for name, sql, account, amount, listed, text in _PARTS)})"""


def found(s, d, ledger=None, accounts=None, pairs=None):
    """All findings in the whole ledger; cycles of up to three accounts (`circular_transfer` has longer ones)."""
    ledger, accounts = ledger if ledger is not None else T.ledger(s, d), accounts if accounts is not None else T.accounts(s, d)
    return P.findings(ledger, accounts, pairs, **LOOSE)


def _fours(s, d):
    """The cycles of four accounts among all payments, summed up by their least account."""
    from pyspark.sql import functions as F

    found = P.cycles(P.edges(T.ledger(s, d)), longest=4).where("size = 4")
    return found.groupBy(F.substring_index("path", ">", 1).alias("account")).agg(F.count("*").alias("sets"), F.sum("total").alias("total"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def _raw(spark, d):
    """The ledger with the three spellings of its parties, some blank and some unknown."""
    from pyspark.sql import functions as F

    rows = T.ledger(spark, d).withColumn("k", F.substring("txn_id", 2, 20).cast("long"))
    when = lambda k, c: F.when(F.col("k") % 4 == k, F.col(c))
    return rows.select(
        "txn_id", when(0, "src").alias("from_account"), when(0, "dst").alias("to_account"), when(1, "src").alias("from"), when(1, "dst").alias("to"),
        when(2, "src").alias("sender_id"), F.when(F.col("k") % 8 == 2, F.lit("")).otherwise(when(2, "dst")).alias("receiver_id"), F.col("amount").cast("double").alias("amount"),
    )


QUERIES = {
    "canonical_ledger": lambda s, d: P.canonical_ledger(_raw(s, d), T.accounts(s, d).where("risk < 90")).select("txn_id", "src", "dst", "amount"),
    "degrees": lambda s, d: P.degrees(T.ledger(s, d)),
    "fan_in": lambda s, d: P.fan_in(T.ledger(s, d)),
    "fan_out": lambda s, d: P.fan_out(T.ledger(s, d)),
    "fan_partners": lambda s, d: P.fan_partners(T.ledger(s, d)),
    "structuring": lambda s, d: P.structuring(T.ledger(s, d)),
    "pass_through": lambda s, d: P.pass_through(T.ledger(s, d), T.accounts(s, d)),
    "night_owl": lambda s, d: P.night_owl(T.ledger(s, d), share=0.25),
    "burst_activity": lambda s, d: P.burst_activity(T.ledger(s, d), gap_minutes=360),
    "max_burst": lambda s, d: P.max_burst(T.ledger(s, d), gap_minutes=360),
    "automated_timing": lambda s, d: P.automated_timing(T.ledger(s, d), cv=0.9),
    "rapid_movement": lambda s, d: P.rapid_movement(T.ledger(s, d)),
    "fast_flow_pairs": lambda s, d: P.fast_flow_pairs(T.ledger(s, d)),
    "all_patterns": lambda s, d: found(s, d).select("pattern", "account", "severity", "amount"),
    "circular_transfer": lambda s, d: P.cycles(P.edges(T.ledger(s, d)), whole=3, few=FEW),
    "circular_of_four": _fours,
    "circular_high_value": lambda s, d: P.cycles(P.edges(T.high_value(s, d))),
    "cycle_counts": lambda s, d: P.cycle_counts(P.edges(T.ledger(s, d))),
    "rapid_counts": lambda s, d: P.rapid_counts(T.ledger(s, d)),
    "triangles3": lambda s, d: P.triangles(T.ledger(s, d)),
    "layering_chain": lambda s, d: P.layering_chains(P.edges(T.ledger(s, d)), deviation=LOOSE["deviation"], few_in=LOOSE["few_in"]),
}

ORACLES = {
    "canonical_ledger": oracle("""
SELECT txn_id, src, dst, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, CAST(substr(txn_id, 2) AS BIGINT) AS k FROM ledger)
WHERE k % 4 <> 3 AND k % 8 <> 2 AND src IN (SELECT id FROM accounts WHERE risk < 90) AND dst IN (SELECT id FROM accounts WHERE risk < 90)"""),
    "degrees": oracle(_DEGREES),
    "fan_in": oracle(_FAN_IN),
    "fan_out": oracle(_FAN_OUT),
    "fan_partners": oracle("""
SELECT dst AS account, 'in' AS direction, src AS partner, n_txn AS n, CAST(amount_sum AS DOUBLE) AS amount FROM edges WHERE dst IN (SELECT dst FROM edges GROUP BY dst HAVING count(*) >= 3)
UNION ALL SELECT src, 'out', dst, n_txn, CAST(amount_sum AS DOUBLE) FROM edges WHERE src IN (SELECT src FROM edges GROUP BY src HAVING count(*) >= 3)"""),
    "structuring": oracle(_STRUCTURING),
    "pass_through": oracle(_PASS),
    "night_owl": oracle(_NIGHT),
    "burst_activity": oracle(_BURST),
    "max_burst": oracle(_MAX_BURST),
    "automated_timing": oracle(_TIMING),
    "rapid_movement": oracle(_RAPID),
    "fast_flow_pairs": oracle(_FAST),
    "all_patterns": oracle("SELECT pattern, account, severity, amount FROM found", FOUND),
    "circular_transfer": oracle(_circular(f"{_cycles('edges', range(2, 4))} UNION ALL {_cycles('few_edges', range(4, 7))}"), _FEW_EDGES),
    "circular_of_four": oracle(f"""
SELECT split_part(path, '>', 1) AS account, count(*) AS sets, sum(total) AS total, min(path) AS first_path, max(path) AS last_path FROM ({_circular(_cycles("edges", range(2, 5)))}) WHERE size = 4 GROUP BY 1"""),
    "circular_high_value": oracle(_circular(_cycles("hv_edges", range(2, 7)))),
    "cycle_counts": oracle(_cycle_counts(), _HALVES),
    "rapid_counts": oracle(f"SELECT account, count(*) AS pairs FROM ({_RAPID}) GROUP BY account"),
    "triangles3": oracle(_TRIANGLES),
    "layering_chain": oracle(_chains(), _STARTS),
}
