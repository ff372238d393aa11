"""Communities, betweenness and behaviour over time against plain versions."""

import random
from collections import Counter, deque
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerwatch.operators import graph as G
from ledgerwatch.operators import markov as M
from ledgerwatch.plans import scores


def as_pairs(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def quality(edges, member):
    """Modularity of a partition, by definition."""
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    degree = Counter(x for e in links for x in e)
    inside = sum(len({member[x] for x in e}) == 1 for e in links)
    sums = Counter()
    for x, k in degree.items():
        sums[member[x]] += k
    m = len(links)
    return inside / m - sum((s / (2 * m)) ** 2 for s in sums.values())


def greedy(edges):
    """The greedy method: join the two communities that gain most until none gains."""
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    member = {x: x for e in links for x in e}
    value = quality(edges, member)
    while True:
        near = {tuple(sorted((member[a], member[b]))) for a, b in map(tuple, links) if member[a] != member[b]}
        best = max(((quality(edges, {x: (p if c == q else c) for x, c in member.items()}), p, q) for p, q in sorted(near)), default=(0, "", ""))
        if best[0] <= value + 1e-12:
            return value
        value = best[0]
        member = {x: (best[1] if c == best[2] else c) for x, c in member.items()}


def planted(seed, groups=4, size=7):
    rng = random.Random(seed)
    names = [f"v{k:02}" for k in range(groups * size)]
    return {(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and rng.random() < (0.6 if i // size == j // size else 0.07)}


def sparse(seed, n=30):
    rng = random.Random(seed)
    return {(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range(45)}


@pytest.mark.parametrize("edges", [planted(0), planted(1, 3, 8), sparse(2), sparse(3), {("a", "b")}, {(f"c{k}", f"c{(k + 1) % 12}") for k in range(12)}])
def test_modularity_is_no_less_than_that_of_the_greedy_method(spark, edges):
    rows = G.modularity_communities(as_pairs(spark, edges)).collect()
    member = {r["id"]: r["community"] for r in rows}
    assert set(member) == {x for e in edges for x in e if e[0] != e[1]}
    assert all(c == min(x for x, d in member.items() if d == c) for c in set(member.values()))
    assert rows[0]["modularity"] == pytest.approx(quality(edges, member), abs=6e-5)
    assert quality(edges, member) >= greedy(edges) - 1e-9


def test_planted_groups_are_found(spark, monkeypatch):
    monkeypatch.setattr(G, "SMALL", 12)  # the first levels as joins
    edges = {(f"{g}{a}", f"{g}{b}") for g in "pqrs" for a in range(6) for b in range(a)} | {("p0", "q0"), ("q1", "r0"), ("r1", "s0")}
    assert {r["id"][0] + r["community"][0] for r in G.modularity_communities(as_pairs(spark, edges)).collect()} == {"pp", "qq", "rr", "ss"}
    assert G.modularity_communities(as_pairs(spark, {("x", "x")})).count() == 0


def test_graphs_too_large_for_the_greedy_method_are_settled_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(G, "_local_moves", None)
    side = spark.range(740).selectExpr("id", "id % 2 AS half")
    pairs = side.alias("a").join(side.alias("b"), "half").where("a.id < b.id").selectExpr("concat('v', a.id) AS src", "concat('v', b.id) AS dst")
    assert 2 * pairs.count() > G.GREEDY
    found = {r["id"]: r["community"] for r in G.modularity_communities(pairs).collect()}
    assert found == {f"v{k}": f"v{k % 2}" for k in range(740)}


@pytest.mark.parametrize("edges", [planted(0), sparse(2)])
def test_settled_without_the_greedy_method(monkeypatch, edges):
    monkeypatch.setattr(G, "GREEDY", 0)
    monkeypatch.setattr(G, "_joined_up", None)
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    degree = Counter(x for e in links for x in e)
    rows = [(x, y, 1.0) for e in links for x, y in (sorted(e), sorted(e)[::-1])] + [(x, None, float(k)) for x, k in degree.items()]
    (found,) = G._settled(iter([pd.DataFrame(rows[:20], columns=["a", "b", "w"]), pd.DataFrame(rows[20:], columns=["a", "b", "w"])]))
    member = dict(zip(found["id"], found["community"], strict=True))
    assert set(member) == set(degree) and quality(edges, member) >= 0.9 * greedy(edges)


def test_modularity_of_the_ledger_as_sql_has_it(spark):
    sf = "/root/testdata/sf0.001"
    rows = scores.QUERIES["modularity_communities"](spark, sf).toPandas()
    from ledgerwatch.plans.prelude import oracle

    base = duckdb.connect()
    for name in ("events", "customer", "nation", "labels"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    base.register("member", rows)
    sql = oracle(
        """SELECT sum(inside / m2 - (d / m2) * (d / m2)) FROM (
  SELECT x.community, CAST(count(*) AS DOUBLE) AS d, CAST(count(*) FILTER (x.community = y.community) AS DOUBLE) AS inside
  FROM ends JOIN member x ON x.id = a JOIN member y ON y.id = b GROUP BY 1), (SELECT CAST(count(*) AS DOUBLE) AS m2 FROM ends)""",
        "links AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)",
    )
    assert rows["modularity"].iloc[0] == pytest.approx(base.execute(sql).fetchone()[0], abs=6e-5)


def plain_betweenness(edges):
    """Of all ordered pairs of other nodes, the share whose shortest paths pass each node, weighted by how many do."""
    edges = {e for e in edges if e[0] != e[1]}
    nodes = sorted({x for e in edges for x in e})
    out = {a: sorted(b for x, b in edges if x == a) for a in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, todo = {s: 0}, {s: 1}, deque([s])
        order = []
        while todo:
            a = todo.popleft()
            order.append(a)
            for b in out[a]:
                if b not in dist:
                    dist[b], paths[b] = dist[a] + 1, 0
                    todo.append(b)
                if dist[b] == dist[a] + 1:
                    paths[b] += paths[a]
        for t in order[1:]:
            share = {t: 1.0}
            for b in reversed(order):
                if b in share and b != s:
                    before = [a for a in order if dist[a] == dist[b] - 1 and b in out[a]]
                    for a in before:
                        share[a] = share.get(a, 0) + share[b] * paths[a] / paths[b]
            for x, v in share.items():
                if x not in (s, t):
                    total[x] += v
    n = len(nodes)
    return {x: v / ((n - 1) * (n - 2)) if n > 2 else 0.0 for x, v in total.items()}


@pytest.mark.parametrize("edges,batch", [(sparse(5, 14), 5), (sparse(6, 20) | {(f"leaf{k}", f"v{k % 3:02}") for k in range(9)} | {("v00", f"end{k}") for k in range(4)}, 16), ({("a", "b"), ("b", "c")}, 256), ({("a", "b")}, 1), ({("l1", "m"), ("l2", "m"), ("m", "l3"), ("m", "t")}, 1)])
def test_exact_betweenness_against_brute_force(spark, edges, batch):
    found = {r["id"]: r["betweenness"] for r in G.exact_betweenness(as_pairs(spark, edges), batch).collect()}
    assert found == pytest.approx(plain_betweenness(edges), abs=6e-5)


@pytest.mark.parametrize("path", ["walks", "walks in pieces", "joins"])
def test_exact_betweenness_by_walks_and_by_joins(spark, monkeypatch, path):
    edges = sparse(7, 60) | {(f"leaf{k}", f"v{k % 3:02}") for k in range(5)} | {("v00", f"v{k:02}") for k in range(1, 9)}
    if path == "joins":
        monkeypatch.setattr(G, "WALKED", 0)
    else:
        monkeypatch.setattr(G, "_carried", None)  # no state of sources x nodes
        monkeypatch.setattr(G, "AT_ONCE", 3 if path == "walks in pieces" else G.AT_ONCE)
    found = {r["id"]: r["betweenness"] for r in G.exact_betweenness(as_pairs(spark, edges), 8, digits=None).collect()}
    assert found == pytest.approx(plain_betweenness(edges), abs=1e-12)


def test_steps_of_a_level_are_cut_into_pieces(monkeypatch):
    edges = sorted(sparse(3, 80))
    ids = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(ids)}
    to = np.array([at[b] for _, b in edges], dtype=np.int32)
    ways = np.bincount([at[a] for a, _ in edges], minlength=len(ids))
    whole = sum(G._passed(np.cumsum(ways) - ways, ways, to, s) for s in range(len(ids)))
    monkeypatch.setattr(G, "AT_ONCE", 2)
    pieces = sum(G._passed(np.cumsum(ways) - ways, ways, to, s) for s in range(len(ids)))
    assert pieces == pytest.approx(whole) and whole.max() > 0


def test_history_of_a_busy_account_in_slices(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        when = datetime(2026, 8, 1) + timedelta(minutes=rng.randrange(4000)) if rng.random() < 0.8 else None
        rows.append(("busy" if k % 3 == 0 else f"a{k % 9}", k, when, rng.random()))
    monkeypatch.setattr(M, "SEQUENCES", 16)
    history = spark.createDataFrame(rows, "account_id string, seq long, ts timestamp, risk_score double")
    state = lambda x: M.STATES[2 if x >= 0.55 else 1 if x >= 0.35 else 0]
    expected, ends = {}, {}
    for account in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == account), key=lambda r: (r[2] is None, r[2] or datetime.min, r[1]))
        before = None
        for r in own:
            now = state(r[3])
            expected[r[1]] = (now, 1.0 if before is None else M.MATRIX[M.STATES.index(before)][M.STATES.index(now)])
            before = now
        early, late = (sum(r[3] for r in x) / len(x) for x in (own[:5], own[-5:]))
        ends[account] = (len(own), "escalating" if late > 1.2 * early else "de-escalating" if late < 0.8 * early else "stable")
    assert {r["seq"]: (r["state"], r["probability"]) for r in M.markov_states(history).collect()} == expected
    assert {r["account_id"]: (r["n"], r["trend"]) for r in M.risk_trend(history).collect()} == ends
