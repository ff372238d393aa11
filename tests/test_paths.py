"""Cycles, chains and flows in time against plain search, with accounts that hold a third of all payments."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from ledgerwatch.functions.components import strong_components
from ledgerwatch.operators import patterns as P

START = datetime(2026, 8, 1)


def plain_cycles(edges, longest):
    """Simple cycles from their least account on."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = []

    def walk(path):
        for x in out.get(path[-1], ()):
            if x == path[0] and len(path) > 1:
                found.append(tuple(path))
            elif x > path[0] and x not in path and len(path) < longest:
                walk([*path, x])

    for a in out:
        walk([a])
    return found


def graph(seed, nodes=12, n=30):
    rng = random.Random(seed)
    made = {(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for _ in range(n)}
    made |= {("hub", f"n{k:02}") for k in range(0, nodes, 2)} | {(f"n{k:02}", "hub") for k in range(0, nodes, 3)}
    return sorted(made)


def as_pairs(spark, edges, amount=lambda a, b: 1.0):
    rows = [(a, b, 1, Decimal(str(amount(a, b))), 0, Decimal(str(amount(a, b)))) for a, b in edges]
    return spark.createDataFrame(rows, "src string, dst string, n_txn long, amount_sum decimal(18,2), n_flagged long, first_amount decimal(18,2)")


@pytest.mark.parametrize("seed", range(2))
def test_cycles_against_plain_search(spark, seed):
    edges = graph(seed)
    weight = {e: k + 1 for k, e in enumerate(edges)}
    pairs = as_pairs(spark, edges, lambda a, b: weight[a, b])
    every = plain_cycles(edges, 6)
    best = {}
    for path in every:
        best[frozenset(path)] = min(best.get(frozenset(path), path), path)
    total = lambda p: float(sum(weight[a, b] for a, b in zip(p, [*p[1:], p[0]], strict=True)))
    expected = sorted((",".join(sorted(p)), ">".join(p), len(p), total(p)) for p in best.values())
    found = sorted((r["members"], r["path"], r["size"], r["total"]) for r in P.cycles(pairs).collect())
    assert found == expected and len(expected) > 30
    short = {r["members"] for r in P.cycles(pairs, longest=3).collect()}
    assert short == {m for m, *_ in expected if m.count(",") < 3}
    counted = {(r["account"], r["size"]): r["n"] for r in P.cycle_counts(pairs).collect()}
    assert counted == Counter((p[0], len(p)) for p in every)


@pytest.mark.parametrize("kind", ["all", "dense"])
def test_cycles_are_counted_without_paths(spark, monkeypatch, kind):
    rng = random.Random(5)
    nodes = [f"n{k:02}" for k in range(24 if kind == "all" else 9)]
    edges = [(a, b) for a in nodes for b in nodes if a != b and (kind == "all" or rng.random() < 0.6)]
    monkeypatch.setattr(P, "_halves", None)
    counted = {(r["account"], r["size"]): r["n"] for r in P.cycle_counts(as_pairs(spark, edges)).collect()}
    if kind == "all":  # each larger account may come next
        assert counted == {(a, k): math.perm(23 - i, k - 1) for i, a in enumerate(nodes) for k in range(2, 7) if 23 - i >= k - 1}
    else:
        assert counted == Counter((p[0], len(p)) for p in plain_cycles(edges, 6))
        short = {(r["account"], r["size"]): r["n"] for r in P.cycle_counts(as_pairs(spark, edges), longest=5).collect()}
        assert short == {k: n for k, n in counted.items() if k[1] < 6}


def test_long_cycles_within_a_degree(spark):
    ring = [(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)]
    dense = [(f"d{a}", f"d{b}") for a in range(6) for b in range(6) if a != b]
    found = {r["members"] for r in P.cycles(as_pairs(spark, ring + dense + [("d0", "r0"), ("r0", "d0")]), few=2).collect()}
    assert "r0,r1,r2,r3,r4" in found and not any(m.startswith("d") and m.count(",") > 3 for m in found)
    assert sum(m.count(",") == 3 for m in found) == 15  # every four of six


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_against_reachability(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(55)})
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    reached = {a: reach(a) for a in range(40)}
    expected = {a: min(b for b in range(40) if b in reached[a] and a in reached[b]) for a in range(40) if any(b != a and b in reached[a] and a in reached[b] for b in range(40))}
    found = {r["id"]: r["component"] for r in strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == expected
    assert strong_components(spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "src long, dst long")).count() == 0


def plain_chains(amount, few_in, deviation, least=1000, longest=6):
    out, into = {}, Counter(b for _, b in amount)
    for a, b in amount:
        out.setdefault(a, []).append(b)
    found = []

    def walk(path, legs):
        if len(path) >= 4:
            mean = sum(legs) / len(legs)
            if mean > least and max(abs(x - mean) for x in legs) / mean < deviation:
                found.append(">".join(path))
        if len(path) < longest:
            for x in out.get(path[-1], ()):
                if x not in path:
                    walk([*path, x], [*legs, amount[path[-1], x]])

    for a in out:
        if into[a] <= few_in:
            walk([a], [])
    return sorted(found)


@pytest.mark.parametrize("seed,few_in,deviation", [(0, 1, 0.3), (2, 1, 0.9), (3, 3, 0.05)])
def test_chains_against_plain_search(spark, seed, few_in, deviation):
    rng = random.Random(seed)
    edges = graph(seed) + [(f"s{k}", f"n{k:02}") for k in range(4)]
    amount = {e: rng.choice([0.0, 900.0, 1000.0, 1300.0, 1857.0, 2000.0, 3000.0, 5000.0]) for e in edges}
    found = P.layering_chains(as_pairs(spark, edges, lambda a, b: amount[a, b]), few_in=few_in, deviation=deviation)
    expected = plain_chains(amount, few_in, deviation)
    assert sorted(r["path"] for r in found.collect()) == expected and expected


def test_chain_starts_count_all_edges(spark):
    chain = {(f"c{k}", f"c{k + 1}"): 5000.0 for k in range(4)}
    small = {("x", "c0"): 1.0, ("y", "c0"): 2.0}  # edges that no chain can use still pay its start
    assert P.layering_chains(as_pairs(spark, sorted(chain), lambda a, b: 5000.0)).count() == 3
    assert P.layering_chains(as_pairs(spark, sorted(chain | small), lambda a, b: (chain | small)[a, b])).count() == 1  # c1>c2>c3>c4


def busy_ledger(spark, seed=0, n=600):
    """A third of all payments reach or leave one account, most of them at the same times."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = f"a{rng.randrange(15)}", f"a{rng.randrange(15)}"
        kind = rng.random()
        a, b = ("hub", b) if kind < 0.17 else (a, "hub") if kind < 0.34 else (a, b)
        minute = rng.choice([360 * rng.randrange(8), rng.randrange(3000)]) + rng.choice([0, 0, 30, 60])
        rows.append((f"T{k:04}", a, b, Decimal(rng.randrange(1, 999)), START + timedelta(minutes=minute), "TRANSFER", False))
    rows.append(("T9999", "hub", "a1", Decimal(5), None, "TRANSFER", False))
    return rows, spark.createDataFrame(rows, "txn_id string, src string, dst string, amount decimal(18,2), ts timestamp, type string, flagged boolean")


@pytest.mark.parametrize("cell", [4096, 3])
def test_flows_of_a_busy_account(spark, monkeypatch, cell):
    monkeypatch.setattr(P, "CELL", cell)
    rows, ledger = busy_ledger(spark)
    timed = [r for r in rows if r[4] is not None]
    near = [(i[2], i[0], o[0]) for i in timed for o in timed if i[2] == o[1] and abs((o[4] - i[4]).total_seconds()) <= 1800 and i[1] != o[2] and i[0] != o[0]]
    found = sorted((r["account"], r["in_txn"], r["out_txn"]) for r in P.rapid_movement(ledger).collect())
    assert found == sorted(near) and Counter(a for a, *_ in near)["hub"] > len(near) / 3
    assert {r["account"]: r["pairs"] for r in P.rapid_counts(ledger).collect()} == Counter(a for a, *_ in near)
    fast = Counter(i[2] for i in timed for o in timed if i[2] == o[1] and abs((o[4] - i[4]).total_seconds()) < 3600)
    assert {r["account"]: r["pairs"] for r in P.fast_flow_pairs(ledger).collect() if r["pairs"]} == fast


def test_slices_narrower_than_the_window(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 1)
    rows, ledger = busy_ledger(spark, 1, 200)
    timed = [r for r in rows if r[4] is not None]
    fast = Counter(i[2] for i in timed for o in timed if i[2] == o[1] and abs((o[4] - i[4]).total_seconds()) < 3600)
    assert {r["account"]: r["pairs"] for r in P.fast_flow_pairs(ledger).collect() if r["pairs"]} == fast
