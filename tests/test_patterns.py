"""Detectors on small ledgers: boundaries, empty input, invariants."""

import math
from datetime import datetime, timedelta
from functools import reduce
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import analytics as A
from ledgerwatch.operators import casework as C
from ledgerwatch.operators import feedback as B
from ledgerwatch.operators import graph as G
from ledgerwatch.operators import markov as M
from ledgerwatch.operators import patterns as P
from ledgerwatch.operators import scoring as S
from ledgerwatch.operators import trees as X
from ledgerwatch.plans import detection, scores
from ledgerwatch.plans.detection import LOOSE
from ledgerwatch.sources import tables as T

START = datetime(2026, 8, 1, 14)
SCHEMA = "txn_id string, src string, dst string, amount decimal(18,2), ts timestamp, type string, flagged boolean"


@pytest.fixture
def ledger(spark):
    def make(*rows):
        from decimal import Decimal

        made = [(f"T{k:03}", src, dst, Decimal(amount), START + timedelta(minutes=minutes), "TRANSFER", flagged) for k, (src, dst, amount, minutes, *rest) in enumerate(rows) for flagged in [bool(rest and rest[0])]]
        return spark.createDataFrame(made, SCHEMA)

    return make


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fans(ledger):
    rows = ledger(*[(f"s{k}", "hub", 10, k) for k in range(3)], ("s0", "hub", 5, 9), *[("out", f"r{k}", 1, k) for k in range(8)], ("a", "b", 1, 0))
    assert got(P.fan_in(rows), "account", "partners", "total", "severity") == [("hub", 3, 35.0, "high")]
    assert got(P.fan_out(rows), "account", "partners", "severity") == [("out", 8, "critical")]


def test_structuring_bounds(ledger):
    rows = ledger(("a", "b", 8500, 0), ("a", "b", 9999, 1), ("a", "b", 9000, 2), ("a", "b", 10000, 3), ("a", "b", 8499, 4))
    assert got(P.structuring(rows), "account", "threshold", "n", "total", "mean") == [("a", 10000, 3, 27499.0, 9166.0)]


def test_pass_through_is_strict(spark, ledger):
    rows = ledger(("x", "m", 100, 0), ("y", "m", 100, 1), ("m", "z", 100, 2), ("m", "w", 97, 3), ("x", "n", 100, 0), ("y", "n", 100, 1), ("n", "z", 80, 2), ("n", "w", 80, 3))
    accounts = spark.createDataFrame([("m", 5.0), ("n", 5.0)], "id string, balance double")
    assert got(P.pass_through(rows, accounts), "account", "ratio", "severity") == [("m", 0.985, "critical"), ("n", 0.8, "high")][:1]


def test_burst_includes_five_minutes(ledger):
    rows = ledger(*[("a", f"r{k}", 10, 5 * k) for k in range(6)])
    assert got(P.burst_activity(rows), "account", "size", "amount", "severity") == [("a", 6, 60.0, "high")]
    assert got(P.max_burst(rows).where("account = 'a'"), "max_burst") == [(0,)]


def test_runs_go_on_over_slices(ledger, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 7 * P.MINUTE)
    rows = ledger(*[("a", f"r{k}", 10, 5 * k) for k in range(9)], ("a", "x", 1, 200), *[("b", "y", 1, 6 * k) for k in range(12)])
    assert got(P.burst_activity(rows), "account", "size", "amount") == [("a", 9, 90.0)]
    assert got(P.max_burst(rows, gap_minutes=5.5).where("account in ('a', 'b')"), "account", "max_burst") == [("a", 9), ("b", 0)]
    assert got(P.automated_timing(rows), "account", "n", "cv") == [("b", 12, 0.0)]


def test_components_of_loops_and_stars(ledger):
    rows = ledger(("a", "b", 1, 0), ("c", "b", 1, 1), ("z", "z", 1, 2), *[("hub", f"h{k:03}", 1, 3) for k in range(60)], ("h001", "q", 1, 4))
    found = {r["id"]: r["component"] for r in G.components(P.edges(rows)).collect()}
    assert {k: v for k, v in found.items() if k in "abcz"} == {"a": "a", "b": "a", "c": "a", "z": "z"}
    assert {v for k, v in found.items() if k not in "abcz"} == {"h000"} and len(found) == 66


def test_rapid_movement_bounds(ledger):
    rows = ledger(("a", "m", 10, 0), ("m", "b", 10, 30), ("m", "a", 10, 4), ("m", "c", 10, 31))
    assert got(P.rapid_movement(rows), "in_txn", "out_txn", "minutes", "severity") == [("T000", "T001", 30.0, "high")]


def test_fast_pairs_are_strict(ledger):
    rows = ledger(("a", "m", 1, 0), ("m", "b", 1, 60), ("m", "c", 1, 59))
    assert got(P.fast_flow_pairs(rows).where("account = 'm'"), "pairs") == [(1,)]


def test_automated_timing(ledger):
    rows = ledger(*[("a", "b", 1, 7 * k) for k in range(10)], *[("c", "b", 1, k * k) for k in range(10)])
    assert got(P.automated_timing(rows), "account", "cv", "regularity", "severity") == [("a", 0.0, 100.0, "critical")]


def test_night_owl(ledger):
    rows = ledger(*[("a", "b", 1, 60 * 11 + k) for k in range(4)], ("a", "b", 1, 0), *[("c", "b", 1, k) for k in range(6)])
    assert got(P.night_owl(rows), "account", "percent", "severity") == [("a", 80.0, "critical")]


def test_cycles_one_for_each_set(ledger):
    rows = ledger(("a", "b", 1, 0), ("b", "c", 2, 1), ("c", "a", 3, 2), ("c", "b", 9, 3), ("b", "a", 1, 4), ("x", "a", 1, 5))
    assert got(P.cycles(P.edges(rows)), "members", "path", "size", "total") == [("a,b", "a>b", 2, 2.0), ("a,b,c", "a>b>c", 3, 6.0), ("b,c", "b>c", 2, 11.0)]
    assert got(P.triangles(rows), "members", "amount") == [("a,b,c", 1.0)]


def test_layering_chain(ledger):
    rows = ledger(("l1", "l2", 10000, 0), ("l2", "l3", 9800, 1), ("l3", "l4", 9700, 2), ("l4", "l5", 9600, 3))
    found = got(P.layering_chains(P.edges(rows)), "path", "severity")
    assert found == [("l1>l2>l3>l4", "high"), ("l1>l2>l3>l4>l5", "critical"), ("l2>l3>l4>l5", "high")]


def test_empty_ledger(ledger, spark):
    none = ledger()
    accounts = spark.createDataFrame([], "id string, balance double")
    assert P.all_patterns(none, accounts).count() == 0
    assert P.cycles(P.edges(none)).count() == 0
    assert G.components(P.edges(none)).count() == 0


def test_canonical_ledger_spellings(spark):
    raw = spark.createDataFrame([("1", "a", "", None, "b", None, None), ("2", None, None, None, None, "a", "b"), ("3", "a", "ghost", None, None, None, None), ("4", " ", "b", None, None, None, None)], "txn_id string, from_account string, to_account string, `from` string, `to` string, sender_id string, receiver_id string")
    accounts = spark.createDataFrame([("a",), ("b",)], "id string")
    assert got(P.canonical_ledger(raw, accounts), "txn_id", "src", "dst") == [("1", "a", "b"), ("2", "a", "b")]


def brute_betweenness(pairs):
    nodes = sorted({x for p in pairs for x in p})
    after = {n: sorted({b for a, b in pairs if a == n and a != b}) for n in nodes}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, queue = {s: 0}, {s: 1.0}, [], [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in after[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in order:
                if w in after[v] and dist[w] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    most = max(1.0, *total.values())
    return {k: int(v / most * 10000 + 0.5) / 10000 for k, v in total.items()}


def test_betweenness_against_brute_force(ledger):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e"), ("e", "b"), ("b", "e"), ("f", "a")]
    found = {r["id"]: r["betweenness"] for r in G.betweenness(P.edges(ledger(*[(a, b, 1, k) for k, (a, b) in enumerate(pairs)])), None).collect()}
    assert found == pytest.approx(brute_betweenness(pairs), abs=2e-4)


def test_label_propagation_splits_cliques(ledger):
    clique = lambda names: [(a, b) for a in names for b in names if a < b]
    pairs = clique("abcd") + clique("wxyz") + [("d", "w")]
    rows = G.modularity_communities(P.edges(ledger(*[(a, b, 1, k) for k, (a, b) in enumerate(pairs)]))).collect()
    group = {r["id"]: r["community"] for r in rows}
    assert len({group[x] for x in "abc"}) == 1 and len({group[x] for x in "xyz"}) == 1 and group["a"] != group["z"]
    assert 0 < rows[0]["modularity"] < 1


def test_scores_stay_in_range(spark):
    f = S.score_accounts(S.account_features(T.ledger(spark, "/root/testdata/sf0.001"), T.accounts(spark, "/root/testdata/sf0.001"), T.AS_OF))
    low, high = f.agg(F.min(F.least("final_score", "ensemble", "ml_score")), F.max(F.greatest("final_score", "ensemble", "ml_score"))).first()
    assert 0 <= low and high <= 1
    assert len(f.columns) >= 39


def test_transition_rows_sum_to_one():
    assert all(abs(sum(row) - 1) < 1e-9 for row in M.MATRIX)


def test_invalid_trees_count_for_nothing(spark):
    assert not X.valid_tree({"feature": "x", "threshold": 1})
    model = '{"base_score": 0, "learning_rate": 1, "trees": [{"feature": "x", "threshold": 1}]}'
    assert got(spark.createDataFrame([(1.0,), (float("nan"),)], "x double").select(X.tree_ensemble_score(model, ["x"]).alias("s")), "s") == [(0.5,), (0.5,)]


def test_upsert_keeps_untouched_columns(spark):
    base = spark.createDataFrame([("1", "x", 1), ("2", "y", 2)], "id string, name string, score int")
    new = spark.createDataFrame([("2", 20), ("3", 30)], "id string, score int")
    assert got(B.upsert(base, new), "id", "score") == [("1", 1), ("2", 20), ("3", 30)]
    assert {r["id"]: r["name"] for r in B.upsert(base, new).collect()} == {"1": "x", "2": "y", "3": None}


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("account_id,account_age_days,kyc_status,account_type,in_txn_count,unique_senders,total_in_amount,avg_in_amount,out_txn_count,unique_receivers,total_out_amount,avg_out_amount,pass_through_ratio,txn_velocity_per_day,pagerank,hub_score,authority_score,is_mule\nx,10,FULL,SAVINGS,oops,,1.5,1,1,1,1,1,1,1,1,1,1,True\n")
    row = T.read_feature_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row["kyc_full"], row["in_txn_count"], row["total_in_amount"], row["is_mule"]) == (True, 0.0, 1.5, True)
    (tmp_path / "b.csv").write_text("txn_id,sender_id,receiver_id,amount,timestamp,mode,is_fraud_pattern\n1,a,b,12.5,2024-01-01T00:00:00,UPI,NONE\n2,a,b,x,bad,UPI,FAN\n")
    assert got(T.read_ledger_csv(spark, str(tmp_path / "b.csv")), "txn_id", "flagged") == [("1", False), ("2", True)]
    (tmp_path / "c.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert T.read_dataset_json(spark, str(tmp_path / "c.json")).count() == 2


def test_import_window_resumes(spark):
    rows = spark.createDataFrame([(f"T{k}",) for k in range(100)], "id string")
    assert T.import_window(rows, "id", 10, 20).count() == 20
    share = T.import_window(rows, "id", share=0.5)
    assert 20 < share.count() < 80 and sorted(share.collect()) == sorted(T.import_window(rows, "id", share=0.5).collect())


def test_score_of_one_is_in_no_bin(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.05, 1)], "score double, label int")
    assert A.ece(rows).first()["ece"] == pytest.approx(0.475)


@pytest.fixture(scope="module")
def detected(spark):
    sf = "/root/testdata/sf0.001"
    ledger, accounts = T.ledger(spark, sf), T.accounts(spark, sf)
    found = P.findings(ledger, accounts, P.edges(T.high_value(spark, sf)), **LOOSE).cache()
    return S.detect(ledger, accounts, T.AS_OF).cache(), found, accounts, ledger


def test_reports_and_explanations_know_the_graph(spark, detected):
    classified, found, _, _ = detected
    explained = C.explain(classified, found)
    scored = {r["id"]: round(r["final_score"] * 100, 1) for r in classified.collect()}
    report = F.get_json_object
    rows = C.analyst_report(explained).select("id", "risk_score", report("report", "$.network_context.cluster_size").cast("int").alias("size"), report("report", "$.score_breakdown.graph").cast("double").alias("graph")).collect()
    assert {r["id"]: r["risk_score"] for r in rows} == scored and max(r["size"] for r in rows) > 1 and max(r["graph"] for r in rows) > 0
    assert explained.where(F.exists("factors", lambda x: x["feature"] == "pagerank_score")).count() > 0
    one = explained.first()
    gains = [x["contribution"] for x in one["factors"]]
    assert gains == sorted(gains, reverse=True) and one["summary"].startswith("Primary risk drivers: " + one["factors"][0]["label"])
    assert sum(x.startswith("Pattern detected: ") for x in one["evidence"]) <= 3


def test_reports_with_trends(detected):
    classified, found, _, _ = detected
    trends = classified.select(F.col("id").alias("account_id"), F.lit("escalating").alias("trend"), F.lit(3).cast("long").alias("days_to_suspicious"), F.lit("Risk up 20%").alias("trajectory"))
    row = C.analyst_report(C.explain(classified, found), trends).select(F.get_json_object("report", "$.temporal_evolution.risk_trend").alias("t"), "recommendations", "evidence_chain").first()
    assert row["t"] == "escalating" and row["recommendations"][0]["action"] in ("freeze", "escalate", "investigate", "monitor") and all(0.5 <= x["confidence"] <= 0.95 for x in row["evidence_chain"])


def test_trends_add_the_oldest_first(spark):
    values = {"up": (0.42, 3.89, 12.14, 17.7, 4.57, 37.22, 5.65, 95.54, 2.44, 42.99, 12.83, 8.23, 7.69, 21.19, 22.66), "down": (88.6, 29.71, 7.65, 37.48, 0.56, 0.72, 17.56, 8.77, 18.43, 86.21, 50.28, 11.01, 60.38, 51.32, 36.11)}
    history = [(name, k, START + timedelta(days=k), x / 100) for name, each in values.items() for k, x in enumerate(each)]
    found = M.risk_trend(spark.createDataFrame(history, "account_id string, seq long, ts timestamp, risk_score double"))

    def percent(each):
        # one after the other: Python's sum makes up for what is rounded off
        early, late = (reduce(float.__add__, (x / 100 for x in part)) / 5 for part in (each[:5], each[-5:]))
        return f"Risk up {math.floor((late - early) / early * 100 + 0.5)}%"

    # halves that go the other way if the last five are added from the newest on
    assert got(found, "account_id", "trajectory") == [(name, percent(values[name])) for name in ("down", "up")] == [("down", "Risk up 27%"), ("up", "Risk up 88%")]


def test_advice_freezes_every_mule(spark, detected):
    classified, found, _, _ = detected
    made = classified.withColumns({"is_mule": F.lit(True), "risk_level": F.lit("high")})
    assert {r["recommendations"][0]["action"] for r in C.analyst_report(C.explain(made, found)).collect()} == {"freeze"}
    plain = classified.withColumns({"is_mule": F.lit(False), "risk_level": F.lit("low")})
    rows = C.analyst_report(C.explain(plain)).collect()
    assert {tuple(x["action"] for x in r["recommendations"]) for r in rows} == {("monitor",)}


def test_alerts_of_every_kind(spark):
    kinds = {
        "rapid_movement": {"minutes": 4.0}, "fan_in": {"partners": 3.0, "total": 810000.0}, "fan_out": {"partners": 8.0, "total": 1.0}, "circular_transfer": {"size": 3.0, "total": 1370000.0}, "layering_chain": {"size": 4.0, "mean": 5.0, "deviation": 1.0},
        "structuring": {"threshold": 100000.0, "n": 3.0}, "night_owl": {"night": 4.0, "percent": 80.0}, "burst_activity": {"size": 6.0, "window": 5.0}, "automated_timing": {"regularity": 95.0, "cv": 0.05}, "pass_through": {"ratio": 0.977, "amount_in": 100000.0, "amount_out": 97700.0},
        "community_cluster": {"community": 0.6}, "bridge_account": {"bridge": 0.4},
    }
    listed = {"fan_in": ["s", "ghost", "t"], "circular_transfer": ["a", "b", "c"], "layering_chain": ["a", "b", "c", "d"]}
    rows = [(k, "a", "high", 1.0, listed.get(k), m) for k, m in kinds.items()]
    found = spark.createDataFrame(rows + rows[:1], "pattern string, account string, severity string, amount double, accounts array<string>, measures map<string,double>")
    known = spark.createDataFrame([(x,) for x in "abcdst"], "id string")
    made = {r["type"]: r for r in C.make_alerts(found, known).collect()}
    assert set(made) == set(kinds) and made["fan_in"]["accounts"] == ["s", "t"] and made["night_owl"]["accounts"] == ["a"]
    assert made["fan_in"]["description"] == "3 distinct accounts transferred funds to a, totaling ₹8.1L."
    assert made["circular_transfer"]["description"] == "Funds traced through a → b → c loop totaling ₹13.7L."
    assert made["pass_through"]["description"] == "Account a passes 98% of inbound funds directly outbound (₹1.0L in → ₹1.0L out)."
    assert made["structuring"]["description"] == "Account a made 3 transactions just below ₹100K threshold."
    assert made["automated_timing"]["description"].endswith("(CV: 0.050).") and all(r["title"] and r["id"].startswith("ALT-") for r in made.values())


FOUND = "pattern string, account string, severity string, amount double, accounts array<string>, measures map<string,double>"


def test_alerts_that_share_an_id_stay_apart(spark):
    # the hash takes Aa for BB
    found = spark.createDataFrame([("circular_transfer", "A", "critical", 1.0, ["A", x], {"size": 2.0, "total": 1.0}) for x in ("Aa", "BB", "BB")], FOUND)
    made = C.make_alerts(found).collect()
    assert len({r["id"] for r in made}) == 1 and sorted(r["accounts"] for r in made) == [["A", "Aa"], ["A", "BB"]]
    made = C.make_alerts(found, spark.createDataFrame([("A",), ("BB",)], "id string")).collect()
    assert sorted(r["accounts"] for r in made) == [["A"], ["A", "BB"]]


def test_written_alerts_that_share_an_id_stay_apart(spark, monkeypatch):
    found = spark.createDataFrame([("circular_transfer", "A", severity, 1.0, ["A", x], {"size": 2.0, "total": 1.0}) for x, severity in (("qdYzrAV", "critical"), ("hUJWcOn", "high"))], FOUND)
    assert len({r["id"] for r in C.make_alerts(found).collect()}) == 1
    monkeypatch.setattr(detection, "found", lambda *_, **__: found)
    written = scores.QUERIES["write_alerts"](spark, "/root/testdata/sf0.001").where("type is not null")
    assert got(written, "severity", "status", "n") == [("critical", "confirmed", 1), ("high", None, 1)]


def test_close_communities_and_bridges_are_found_if_asked_for(spark, ledger):
    graph = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.1, 0.5), ("c", 0.5, 0.3)], "id string, community double, bridge double")
    accounts = spark.createDataFrame([("a", 1.0)], "id string, balance double")
    found = P.findings(ledger(("a", "b", 1, 0)), accounts, graph=graph)
    assert got(found, "pattern", "account", "severity") == [("bridge_account", "b", "high"), ("community_cluster", "a", "critical")]


def test_listed_partners_can_be_bounded(ledger):
    rows = ledger(*[(f"s{k:02}", "hub", 10, k) for k in range(30)])
    assert got(P.fan_in(rows, list_cap=3), "account", "partners", "total", "accounts") == [("hub", 30, 300.0, "s00,s01,s02")]


def test_summary_counts_what_was_found(detected):
    classified, found, _, ledger = detected
    row = C.detection_summary(classified, ledger, found).first()
    assert row["total_accounts"] == classified.count() and row["total_transactions"] == ledger.count() and row["patterns_found"] == found.count() == sum(row[k] for k in P.ORDER)


@pytest.mark.parametrize("query", [scores._explained, scores._summary])
def test_ledger_and_edges_are_made_once(spark, monkeypatch, query):
    made = []
    for module, name in ((T, "ledger"), (P, "edges")):
        monkeypatch.setattr(module, name, lambda *args, real=getattr(module, name), name=name: made.append(name) or real(*args))
    monkeypatch.setattr(P, "cycle_counts", lambda *_: spark.createDataFrame([("a", 2, 1)], "account string, size int, n long"))
    query(spark, "/root/testdata/sf0.001")
    # triangles of the legacy score and degrees of passing through have edges of their own
    assert made.count("ledger") == 1 and made.count("edges") <= 2


def test_summary_counts_cycles_of_all_sizes(detected, ledger):
    """cycles of four to six accounts count too, also where every account has many partners."""
    classified, found, _, _ = detected
    rows = ledger(*[(f"n{i}", f"n{j}", 10, 0) for i in range(6) for j in range(6) if i != j], *[(f"r{i}", f"r{(i + 1) % 5}", 10, 0) for i in range(5)])
    every = sum(1 for size in range(2, 7) for path in permutations(range(6), size) if path[0] == min(path)) + 1
    row = C.detection_summary(classified, rows, found, P.cycle_counts(P.edges(rows))).first()
    assert row["circular_transfer"] == every == 410
    assert row["patterns_found"] == sum(row[k] for k in P.ORDER) == found.where("pattern != 'circular_transfer'").count() + every


def test_age_that_is_not_said_is_a_year(spark, ledger):
    accounts = spark.createDataFrame([("a", 10.0, 7300.0, None), ("b", 1.0, 0.0, 0)], "id string, balance double, turnover double, age_days long")
    found = {r["id"]: r for r in S.account_features(ledger(("a", "b", 100, 0)), accounts, "2026-09-01 00:00:00").collect()}
    assert (found["a"]["account_age_days"], found["a"]["money_in_out_velocity"], found["b"]["account_age_days"]) == (365, 20.0, 0)


def test_normalised_accounts_of_other_spellings(spark):
    raw = spark.createDataFrame([(" x ", -5.0, "HIGH", True, 10), ("y", float("nan"), "odd", None, None)], "account_id string, totalAmount double, riskLevel string, isMule boolean, account_age_days int")
    assert got(A.normalize_accounts(raw, "2024-01-31"), "id", "name", "turnover", "risk_level", "status") == [("x", "Unknown", 0.0, "high", "under_review"), ("y", "Unknown", 0.0, "low", "active")]


def test_exported_trees_score_as_the_model(spark):
    rows = spark.createDataFrame([(float(k % 17), float(k % 5), int(k % 17 > 8 or k % 5 == 0)) for k in range(200)], "x double, y double, label int")
    model, area = X.train_tree_model(rows, ["x", "y"], rounds=5, depth=3)
    from pyspark.ml.feature import VectorAssembler

    want = [r["probability"][1] for r in model.transform(VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows)).collect()]
    own = [r[0] for r in rows.select(X.tree_ensemble_score(X.exported(model, ["x", "y"]), ["x", "y"])).collect()]
    assert own == pytest.approx(want, abs=1e-9) and area > 0.9


def test_modularity_and_betweenness_see_the_whole_ledger(spark):
    from ledgerwatch.plans import scores

    sf = "/root/testdata/sf0.001"
    pays = T.ledger(spark, sf)
    ids = {r[0] for r in pays.select("src").union(pays.select("dst")).distinct().collect()}
    assert {r["id"] for r in scores.QUERIES["modularity_communities"](spark, sf).collect()} == ids
    assert {r["id"] for r in scores.QUERIES["betweenness"](spark, sf).collect()} == ids
