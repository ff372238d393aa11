"""Scoring with exported tree ensembles, and training of one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def valid_tree(tree: dict) -> bool:
    """Whether a tree counts: a leaf, or a split with a side at least."""
    return "leaf" in tree or ("feature" in tree and (tree.get("left") is not None or tree.get("right") is not None))


@dataclass(frozen=True)
class Flat:
    """A tree as arrays with a place for each node: place 0 is worth nothing and stays where it is, place 1 is the root."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing: np.ndarray
    value: np.ndarray
    settled: np.ndarray


def flattened(tree: dict, names: list[str]) -> Flat:
    """A tree of nodes {leaf} or {feature, threshold, left, right, missing}: features by number or by name, `missing` a node of its own.

    A value that is not finite goes to `missing`; one without a node on its side goes
    there too. A node without a known feature or without any node below it is worth 0.
    """
    known = {name: k for k, name in enumerate(names)}
    nodes, rows = [None, tree], [(0, 0.0, 0, 0, 0, 0.0, True)]
    while len(rows) < len(nodes):
        node, at = nodes[len(rows)], len(rows)
        below = {side: node.get(side) for side in ("left", "right", "missing")}
        feature = node.get("feature")
        place = feature if isinstance(feature, int) else known.get(feature, -1)
        if node.get("leaf") is not None:
            rows.append((0, 0.0, at, at, at, float(node["leaf"]), True))
        elif not 0 <= place < len(names) or all(child is None for child in below.values()):
            rows.append((0, 0.0, at, at, at, 0.0, True))
        else:
            where = dict.fromkeys(below, 0)
            for side, child in below.items():
                if child is not None:
                    where[side] = len(nodes)
                    nodes.append(child)
            rows.append((place, float(node.get("threshold") or 0.0), where["left"] or where["missing"], where["right"] or where["missing"], where["missing"], 0.0, False))
    return Flat(*(np.array(column) for column in zip(*rows, strict=True)))


def walked(tree: Flat, values: np.ndarray) -> np.ndarray:
    """The value of a tree for each row of `values`; all rows go down a level at a time."""
    at, live = np.ones(len(values), np.int64), np.arange(len(values))
    while len(live := live[~tree.settled[at[live]]]):
        node = at[live]
        x = values[live, tree.feature[node]]
        at[live] = np.where(~np.isfinite(x), tree.missing[node], np.where(x <= tree.threshold[node], tree.left[node], tree.right[node]))
    return tree.value[at]


def tree_ensemble_score(model: str, columns: list[str]) -> Column:
    """The score of a JSON model {feature_names, base_score, learning_rate, trees}: all rows of an Arrow batch walk a tree together.

    `feature_names` says which number each feature has (that of its column, if there is
    none); features without a column are 0. Columns in its `categories` are numbered by
    the orders there. Trees that are not valid count for nothing.
    """
    spec = json.loads(model)
    names = spec.get("feature_names") or columns
    trees = [flattened(t, names) for t in spec.get("trees") or [] if valid_tree(t)]
    base, rate = float(spec.get("base_score", 0.0)), float(spec.get("learning_rate", 1.0))
    used = [c for c in columns if c in names] or columns[:1]

    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for given in batches:
            given = (given,) if isinstance(given, pd.Series) else given  # a single column comes bare
            values = np.zeros((len(given[0]), len(names)))
            for name, x in zip(used, given, strict=True):
                if name in names:
                    values[:, names.index(name)] = x.to_numpy(float)
            total = np.full(len(values), base)
            for tree in trees:
                total += rate * walked(tree, values)
            with np.errstate(over="ignore"):
                yield pd.Series(1 / (1 + np.exp(-total)))

    orders = spec.get("categories") or {}
    return score(*[category_number(F.col(c), orders[c]) if c in orders else F.col(c).cast("double") for c in used])


#: A column with more values than this is no category.
MOST_CATEGORIES = 4096


def category_orders(rows: DataFrame, columns: list[str], label: str = "label") -> dict[str, list[str]]:
    """The values of each column from the least mean label to the greatest, ties by name: cut by a threshold, that order parts them as well as any sets could."""
    found = {}
    for c in columns:
        per = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.avg(F.col(label).cast("double")).alias("mean"))
        values = per.orderBy("mean", "v").limit(MOST_CATEGORIES + 1).collect()
        if len(values) > MOST_CATEGORIES:
            raise ValueError(f"{c} has more than {MOST_CATEGORIES} values")
        found[c] = [r["v"] for r in values]
    return found


def category_number(column: Column, order: list[str]) -> Column:
    """The place of a value in its order; -1 for a null or a value that is not in it."""
    if not order:
        return F.lit(-1.0)
    places = F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, float(k))])
    return F.coalesce(F.try_element_at(places, column.cast("string")), F.lit(-1.0))


def numbered(rows: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """`rows` with the columns of `orders` as places in them."""
    return rows.withColumns({c: category_number(F.col(c), order) for c, order in orders.items()})


def train_tree_model(rows: DataFrame, features: list[str], label: str = "label", rounds: int = 200, depth: int = 5, step: float = 0.05):
    """A boosted tree model and its area under the curve on a held-out fifth of each class."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    weight = F.when(F.col(label) == 1, counts.get(0, 0) / max(1, counts.get(1, 0))).otherwise(1.0)
    # within each class the fifth that a range of hash values cuts off, found by a quantile and so without a sort
    data = rows.withColumns({"weight": weight, "draw": F.xxhash64(*features, F.lit(42))})
    cuts = {r[label]: r["cut"] for r in data.groupBy(label).agg(F.percentile_approx("draw", 0.2, 10_000).alias("cut")).collect()}
    cut = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in cuts.items()]) if cuts else F.lit(0)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(data).withColumn("test", F.col("draw") <= cut)
    model = GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42).fit(data.where("not test"))
    return model, BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(data.where("test")))


def probabilities(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """`rows` with the model's own `probability` of the label 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def exported(model, features: list[str], categories: dict[str, list[str]] | None = None) -> str:
    """A trained model as the JSON that `tree_ensemble_score` reads; its scores are the model's probabilities. `categories` are the orders of columns that were numbered."""

    def node(n, weight: float) -> dict:
        if n.numDescendants() == 0:
            return {"leaf": 2 * weight * n.prediction()}  # the model's probability is the logistic function of twice its margin
        split = n.split()
        return {"feature": features[split.featureIndex()], "threshold": split.threshold(), "left": node(n.leftChild(), weight), "right": node(n.rightChild(), weight)}

    trees = [node(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return json.dumps({"feature_names": features, "num_features": len(features), "num_trees": len(trees), "base_score": 0.0, "learning_rate": 1.0, "categories": categories or {}, "trees": trees})
