"""Keyed tables, streams that merge into them, large JSON arrays and tree models."""

import json
import math
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import trees as X
from ledgerwatch.sources import keyed as K
from ledgerwatch.sources import tables as T
from ledgerwatch.streaming import jobs as J


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_merges_touch_their_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = spark.createDataFrame([(f"k{k}", k, "old") for k in range(200)], "id string, n int, kind string")
    one = K.merge_keyed(first, path, "import", 0, buckets=16)
    assert len(one.folders) == 16
    new = spark.createDataFrame([("k3", 300, 1.5), ("k3", 299, 9.5), ("fresh", 1, None)], "id string, n int, score double")
    two = K.merge_keyed(new, path, "run", 7, order="n")
    changed = [b for b in two.folders if two.folders[b] != one.folders.get(b)]
    assert 1 <= len(changed) <= 2 and two.version == 2
    found = {r["id"]: (r["n"], r["kind"], r["score"]) for r in K.read_keyed(spark, path).collect()}
    assert len(found) == 201 and found["k3"] == (300, "old", 1.5) and found["fresh"] == (1, None, None) and found["k4"] == (4, "old", None)
    assert K.merge_keyed(new.withColumn("n", F.lit(0)), path, "run", 7).version == 2  # a rerun
    assert K.read_keyed(spark, path, 1).count() == 200  # a state that is kept
    three = K.merge_keyed(new.limit(0), path, "run", 8)
    assert three.version == 3 and three.folders == two.folders
    gone = K.vacuum(spark, path, keep=1)
    assert gone == len([b for b in changed if b in one.folders]) and K.read_keyed(spark, path).count() == 201


def test_two_merges_at_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    new = spark.createDataFrame([("a", 1)], "id string, n int")
    K.merge_keyed(new, path, "one", 0)
    stale = K.manifest(spark, path)
    K.merge_keyed(new.withColumn("n", F.lit(2)), path, "two", 0)
    monkeypatch.setattr(K, "manifest", lambda *a: stale)
    with pytest.raises(RuntimeError, match="another merge"):
        K.merge_keyed(new.withColumn("n", F.lit(3)), path, "three", 0)
    monkeypatch.undo()
    assert rows(K.read_keyed(spark, path), "id", "n") == [("a", 2)]
    with pytest.raises(FileNotFoundError):
        K.read_keyed(spark, f"{tmp_path}/none")


def dropped(spark, folder, *batches, schema):
    """A stream that has each list of rows in a batch of its own."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("seen"):
                os.rename(f"{folder}/{name}", f"{folder}/seen-{k}.parquet")
                os.utime(f"{folder}/seen-{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/seen-*.parquet")


def test_an_alert_that_returns_stays_one_row(spark, tmp_path):
    day = datetime(2026, 8, 1)
    schema = "id string, severity string, ts timestamp"
    stream = dropped(spark, f"{tmp_path}/in", [("a", "low", day), ("b", "low", day)], [("a", "high", day + timedelta(days=9)), ("a", "medium", day + timedelta(days=8))], [("c", "low", day)], schema=schema)
    J.stream_sink(stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    assert rows(K.read_keyed(spark, f"{tmp_path}/out"), "id", "severity") == [("a", "high"), ("b", "low"), ("c", "low")]
    assert K.manifest(spark, f"{tmp_path}/out").merged == {f"{tmp_path}/progress": 2}


def test_states_on_a_stream_expire_and_late_ones_are_left_out(spark, tmp_path):
    at = lambda d, m=0: datetime(2026, 8, 1) + timedelta(days=d, minutes=m)
    schema = "account_id string, seq long, ts timestamp, risk_score double"
    busy = [("busy", 100 + k, at(1, k), 0.6 if k % 2 else 0.1) for k in range(50)]
    random.Random(1).shuffle(busy)
    batches = [
        [*busy, ("a", 1, at(1), 0.4), ("b", 2, at(1), 0.1), ("n", 3, None, 0.9)],
        [("a", 4, at(2), 0.6), ("a", 5, at(0), 0.1), ("busy", 200, at(2), 0.4)],  # 5 is late
        [("c", 6, at(40), 0.1), ("a", 7, at(41), 0.1)],  # the state of a has expired
    ]
    J.stream_markov(dropped(spark, f"{tmp_path}/in", *batches, schema=schema), f"{tmp_path}/out", f"{tmp_path}/progress", buckets=2).awaitTermination()
    found = {r["seq"]: (r["before"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out/out").collect()}
    legit, odd, mule = "legitimate", "suspicious", "confirmed_mule"
    assert found.pop(1) == (None, odd) and found.pop(2) == (None, legit) and found.pop(4) == (odd, mule) and found.pop(200) == (mule, odd)
    assert found.pop(6) == (None, legit) and found.pop(7) == (None, legit) and not {3, 5} & set(found)
    assert found == {100 + k: (None if not k else legit if k % 2 else mule, mule if k % 2 else legit) for k in range(50)}
    assert set(r["account_id"] for r in K.read_keyed(spark, f"{tmp_path}/out/state").collect()) <= {"a", "c", "busy", "b"}


@pytest.mark.parametrize("indent", [None, 1])
def test_large_arrays_are_read_in_ranges(spark, tmp_path, indent):
    rng = random.Random(4)
    odd = ["}", "{", '"', "\\", "},{", '\\"}', "é\U0001f600", "[", "]", ",", " ", "a"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    data = [[{"id": f"{f}-{k}", "name": text(), "more": {"x": {"y": text()}, "list": [{"z": text()} for _ in range(rng.randrange(3))]}} for k in range(200)] for f in range(2)] + [[]]
    for f, own in enumerate(data):
        (tmp_path / f"{f}.json").write_text(json.dumps(own, indent=indent, ensure_ascii=False), encoding="utf8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        schema = "id string, name string, more struct<x: struct<y: string>, list: array<struct<z: string>>>"
        read = T.read_json_array(spark, str(tmp_path), schema)
        found = {r["id"]: (r["name"], r["more"]["x"]["y"], [z["z"] for z in r["more"]["list"]]) for r in read.collect()}
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert found == {r["id"]: (r["name"], r["more"]["x"]["y"], [z["z"] for z in r["more"]["list"]]) for own in data for r in own}


def plain_score(model, values):
    """The score of one row, node by node."""
    names, total = model["feature_names"], model["base_score"]
    for tree in model["trees"]:
        node, value = tree, 0.0
        if not ("leaf" in tree or ("feature" in tree and (tree.get("left") or tree.get("right")))):
            continue
        while node:
            if node.get("leaf") is not None:
                value = node["leaf"]
                break
            f = node.get("feature")
            f = f if isinstance(f, int) else names.index(f) if f in names else -1
            if not 0 <= f < len(names) or not (node.get("left") or node.get("right") or node.get("missing")):
                break
            x, other = values[f], node.get("missing")
            node = other if x is None or not math.isfinite(x) else (node.get("left") or other) if x <= (node.get("threshold") or 0) else (node.get("right") or other)
        total += value * model["learning_rate"]
    return 1 / (1 + math.exp(-total))


def test_trees_of_any_shape_score_as_a_walk_does(spark):
    rng = random.Random(6)

    def node(depth):
        if rng.random() < 0.2 or not depth:
            return {"leaf": rng.choice([1.0, -2.0, 0.5])} if rng.random() < 0.9 else {"leaf": None}
        made = {"feature": rng.choice(["a", "b", "c", 0, 1, 2, 7, "none"]), "threshold": rng.choice([0.0, 1.5, -3.0, None])}
        return made | {side: rng.choice([None, node(depth - 1), node(depth - 1)]) for side in ("left", "right", "missing")}

    model = {"feature_names": ["a", "b", "c"], "base_score": 0.5, "learning_rate": 0.3, "trees": [node(4) for _ in range(60)]}
    number = lambda: rng.choice([0.0, 1.5, 2.0, -3.0, -9.0, None, float("nan"), float("inf")])
    data = [(k, number(), number()) for k in range(60)]
    table = spark.createDataFrame(data, "k int, a double, c double")  # no column b: it is 0
    found = {r["k"]: r["s"] for r in table.select("k", X.tree_ensemble_score(json.dumps(model), ["a", "c"]).alias("s")).collect()}
    assert found == pytest.approx({k: plain_score(model, (a, 0.0, c)) for k, a, c in data})
    deep = {"leaf": 1.0}
    for _ in range(3000):
        deep = {"feature": 0, "threshold": 0.0, "left": deep}
    assert X.walked(X.flattened(deep, ["a"]), __import__("numpy").zeros((2, 1))).tolist() == [1.0, 1.0]


def test_categories_are_carried_through_the_export(spark):
    kinds = ["SAVINGS", "CURRENT", "JOINT", None]
    data = [(float(k % 13), kinds[k % 4], "FULL" if k % 3 else "MIN", int(kinds[k % 4] in ("CURRENT", None) or (k % 3 == 0 and k % 13 > 6))) for k in range(260)]
    table = spark.createDataFrame(data, "x double, account_type string, kyc_status string, label int")
    names = ["x", "account_type", "kyc_status"]
    orders = X.category_orders(table, names[1:])
    assert orders["account_type"][-1] == "CURRENT" and set(orders["account_type"]) == {"SAVINGS", "CURRENT", "JOINT"} and orders["kyc_status"] == ["FULL", "MIN"]
    model, area = X.train_tree_model(X.numbered(table, orders), names, rounds=8, depth=3)
    text = X.exported(model, names, orders)
    assert area > 0.9 and '"account_type"' in json.dumps(json.loads(text)["trees"])
    scored = table.select("*", X.tree_ensemble_score(text, names).alias("score"))
    both = X.probabilities(model, X.numbered(scored, orders), names)
    assert both.where(F.abs(F.col("score") - F.col("probability")) > 1e-9).count() == 0 and both.count() == 260
    unseen = spark.createDataFrame([(1.0, "OTHER", None)], "x double, account_type string, kyc_status string")
    assert 0 < unseen.select(X.tree_ensemble_score(text, names)).first()[0] < 1


def test_partners_of_fans_as_rows(spark):
    from ledgerwatch.operators import patterns as P

    data = [(f"s{k}", "hub", 2.0) for k in range(150)] + [("s0", "hub", 3.0), ("a", "b", 1.0), ("a", "c", 1.0)]
    table = spark.createDataFrame(data, "src string, dst string, amount double")
    found = P.fan_partners(table)
    assert found.count() == 150 and rows(found.where("partner = 's0'"), "account", "direction", "n", "amount") == [("hub", "in", 2, 5.0)]
    listed = P.fan_in(table).first()
    assert listed["partners"] == 150 and len(listed["accounts"].split(",")) == 100
