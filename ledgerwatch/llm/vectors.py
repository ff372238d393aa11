"""Embedding near-dedup over robust-pruned flat graphs.

Vectors of one label are compared with each other. Centres, drawn from a bounded
sample of each label and thinned until none lies close to another, cut a label into
cells; a vector is at home with its nearest centre and a guest of every other whose
border with the home it is near. Linked vectors are at most d = sqrt(2 - 2 COSINE)
apart, so one of the two lies within d / 2 of the border between their homes: no
link is lost between cells. A cell is dealt out by a hash into shards of about
`SHARD` members and blocks of as many vectors at home, whatever their likeness;
each task has one shard and one block that searches it, so none holds a whole cell.

In a shard, overlapping clusters of `CLUSTER` vectors each get a graph: every
vector keeps its nearest neighbours of the cluster and, further out, those that
robust pruning leaves of its near ones and of a spread over the cluster. The
adjacency lists of the clusters are united, with links both ways. A search enters
at the medoids, and at one vector of each group of near ones and of whatever could
not be reached from there; it follows the graph greedily with a beam, and widens
over everything in range: each hit is expanded too. What it finds is verified by
cosine in double precision.

Only counts of links and one link to a root for each vector leave a task, so the
rows do not grow with the square of a group. `audit` measures the recall of a
sample of queries against brute force.

Nulls and edge cases: vectors that are null, empty, zero or hold a null or
non-finite component, and vectors without a label, link with nothing; vectors of
different lengths are never compared; a null vec_id links with nothing; rows
that repeat a vec_id are one vector if their label and components agree, and
otherwise are told apart by them; ties of cosine do not matter, as all in range
are links; other columns, whatever their names, are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, local_roots, read, whole_groups

COSINE = 0.98
#: Vectors at home in a cell, about, and centres of a label at most.
CELL, CENTRES = 256, 4096
#: Half of the distance of the furthest linked vectors: how near a border makes a guest.
BORDER = float(np.sqrt(2 - 2 * COSINE)) / 2 + 1e-6
#: Cosine of the nearest two centres of a label, and vectors in a slice of a label.
APART, SLICE = 0.9, 4096
SHARD, CLUSTER = 2048, 512
#: Candidates for a vector's list: its nearest, and a spread over its cluster.
NEAR, SPREAD = 40, 16
#: Neighbours kept without pruning, degree at most after pruning, and pruning's slack.
NEAREST, DEGREE, ALPHA = 6, 24, 1.2
BEAM = 24
#: Rows of cell sizes that may be broadcast.
FEW = 200_000
#: Links of a node at most once the lists are united, and queries that move together.
WIDEST, QUERIES = 64, 256


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def pruned(near: np.ndarray, sims: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Robust pruning of candidate lists, nearest first: of those that remain take the nearest, drop what it is ALPHA times nearer to.

    `near` (n, k) are rows of `points`, `sims` their cosines with the own point;
    returns (n, DEGREE) rows, -1 where there are none.
    """
    n, k = near.shape
    out = np.full((n, DEGREE), -1, np.int64)
    out[:, :NEAREST] = near[:, :NEAREST]
    candidates = points[near]
    alive = np.ones((n, k), bool)
    rows, away = np.arange(n), 1 - sims
    for slot in range(DEGREE):
        if slot >= min(NEAREST, k):
            any_left = alive.any(axis=1)
            if not any_left.any():
                break
        pick = alive.argmax(axis=1) if slot >= NEAREST else np.full(n, min(slot, k - 1))
        out[:, slot] = np.where(alive[rows, pick] | (slot < min(NEAREST, k)), near[rows, pick], -1)
        between = 1 - np.einsum("nkd,nd->nk", candidates, candidates[rows, pick])
        alive &= ALPHA * between > away
        alive[rows, pick] = False
        alive[:, : min(slot + 1, NEAREST)] = False
    return out


def cluster_graph(points: np.ndarray) -> np.ndarray:
    """Adjacency (n, DEGREE) of one cluster, -1 where there is none."""
    n = len(points)
    if n == 1:
        return np.full((1, DEGREE), -1, np.int64)
    sims = points @ points.T
    np.fill_diagonal(sims, -2)
    k = min(n - 1, NEAR)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    if n > NEAR + SPREAD:
        # a tight group fills the nearest with itself; the spread leads out of it (its own row, at cosine -2, comes last)
        spread = np.tile(np.linspace(0, n - 1, SPREAD).astype(int), (n, 1))
        order = np.argsort(-np.take_along_axis(sims, spread, 1), axis=1, kind="stable")
        near = np.concatenate([near, np.take_along_axis(spread, order, 1)[:, : SPREAD - 1]], axis=1)
    if k < NEAREST:
        return np.pad(near, ((0, 0), (0, DEGREE - k)), constant_values=-1)
    return pruned(near, np.take_along_axis(sims, near, 1), points)


def shard_graph(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """United adjacency lists (n, width) of a shard's overlapping clusters, and where searches enter."""
    n = len(points)
    count = -(-2 * n // CLUSTER) if n > CLUSTER else 1
    if count == 1:
        members = [np.arange(n)]
    else:
        centres = points[np.linspace(0, n - 1, count).astype(int)]
        closest = np.argsort(-(points @ centres.T), axis=1, kind="stable")[:, :2]
        members = []
        for c in range(count):
            own = np.flatnonzero((closest == c).any(axis=1))
            members += np.array_split(own, max(1, -(-len(own) // (2 * CLUSTER)))) if len(own) else []
    sources, targets, medoids = [], [], []
    for own in members:
        links = cluster_graph(points[own])
        a, slot = np.nonzero(links >= 0)
        sources.append(own[a])
        targets.append(own[links[a, slot]])
        medoids.append(own[np.argmax(points[own] @ points[own].mean(axis=0))])
    a, b = np.concatenate(sources), np.concatenate(targets)
    if not len(a):
        return np.full((n, 1), -1, np.int64), np.unique(medoids)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    # nearest first, so that the widest lists keep their nearest links; what they drop still links to them
    order = np.lexsort((-cosines(points, a, points, b), a))
    a, b = a[order], b[order]
    degree = np.bincount(a, minlength=n)
    slot = np.arange(len(a)) - np.repeat(np.cumsum(degree) - degree, degree)
    a, b, slot = a[slot < WIDEST], b[slot < WIDEST], slot[slot < WIDEST]
    table = np.full((n, int(slot.max()) + 1), -1, np.int64)
    table[a, slot] = b
    return table, entries(table, np.unique(medoids), points)


def entries(table: np.ndarray, medoids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The medoids, a vector of each group that is linked in range, and as many more as it takes to reach all others."""
    n = len(table)
    a, slot = np.nonzero(table >= 0)
    b = table[a, slot]
    close = cosines(points, a, points, b) >= COSINE - 1e-4
    roots = local_roots(n, a[close], b[close])
    begin = np.union1d(medoids, roots[roots != np.arange(n)])
    reached = np.zeros(n, bool)
    front = begin
    while True:
        reached[front] = True
        near = table[front]
        near = np.unique(near[near >= 0])
        front = near[~reached[near]]
        if not len(front):
            left = np.flatnonzero(~reached)
            if not len(left):
                return begin
            front = left[:1]
            begin = np.union1d(begin, front)


def cosines(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, at_once: int = 65_536) -> np.ndarray:
    """Row products x[a] . y[b], a bounded number at a time."""
    out = np.empty(len(a), np.result_type(x, y))
    for k in range(0, len(a), at_once):
        part = slice(k, k + at_once)
        out[part] = np.einsum("nd,nd->n", x[a[part]], y[b[part]])
    return out


def search(points: np.ndarray, graph: np.ndarray, begin: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) found in range: beams from the entries, then every hit is expanded until no new one comes up.

    All queries of a block move together, one node each a step; a query is done
    when all of its beam and all of its hits have been expanded.
    """
    n, q = len(points), len(queries)
    sims = np.full((q, n), -2, np.float32)  # cosines of the nodes seen so far
    expanded = np.zeros((q, n), bool)
    sims[:, begin] = queries @ points[begin].T
    active, beams = np.arange(q), min(BEAM, n)
    while len(active):
        own = sims[active]
        floor = np.partition(own, n - beams, axis=1)[:, n - beams]
        open_ = np.where(expanded[active], -2, own)
        # a few at once: as good as one after another, with fewer steps
        best = np.argpartition(-open_, min(4, n) - 1, axis=1)[:, : min(4, n)]
        worth = np.take_along_axis(open_, best, 1)
        take = (worth > -2) & ((worth >= floor[:, None]) | (worth >= least))
        at, slot = np.nonzero(take)
        if not len(at):
            break
        nodes = best[at, slot]
        expanded[active[at], nodes] = True
        near = graph[nodes]
        which = np.repeat(active[at], near.shape[1]).reshape(near.shape)
        fresh = near >= 0
        which, near = which[fresh], near[fresh]
        fresh = sims[which, near] == -2
        which, near = which[fresh], near[fresh]
        sims[which, near] = cosines(queries, which, points, near)
        active = active[np.bincount(at, minlength=len(active)) > 0]
    return np.nonzero(sims >= least)


def _linked(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each vector of a shard and a block: links found by and for it, and the root of those links."""
        key = ["label", "cell", "shard", "block"]
        for rows in whole_groups(batches, key, 1024):
            out = []
            for (_, cell, shard, block), group in rows.groupby(key, sort=False):
                vectors = unit(np.frombuffer(b"".join(group["v"]), kind).astype(np.float64).reshape(len(group), -1))
                member = np.flatnonzero(group["shard_of"] == shard)
                queries = np.flatnonzero((group["home"] == cell) & (group["block_of"] == block))
                if not len(member) or not len(queries):
                    continue
                points = vectors[member].astype(np.float32)
                graph, begin = shard_graph(points)
                found = [[], []]
                for at in range(0, len(queries), QUERIES):
                    part = queries[at : at + QUERIES]
                    a, b = search(points, graph, begin, vectors[part].astype(np.float32), COSINE - 1e-4)
                    found[0].append(part[a])
                    found[1].append(member[b])
                a, b = np.concatenate(found[0]), np.concatenate(found[1])
                right = (cosines(vectors, a, vectors, b) >= COSINE) & (a != b)
                a, b = a[right], b[right]
                # what b's own search will not meet, as a is no guest of b's cell, is counted for b here
                homes, cells = group["home"].to_numpy(), [set(np.frombuffer(x, np.int64).tolist()) for x in group["guest"]]
                alone = np.array([homes[y] != cell and homes[y] not in cells[x] for x, y in zip(a, b, strict=True)], bool)
                copies = group["copies"].to_numpy()
                links = np.bincount(a, copies[b], len(group)) + np.bincount(b[alone], copies[a[alone]], len(group))
                nodes = group["node"].to_numpy()
                order = np.argsort(nodes, kind="stable")
                rank = np.argsort(order, kind="stable")
                roots = nodes[order][local_roots(len(nodes), rank[a], rank[b])[rank]]
                out.append(pd.DataFrame({"node": nodes, "links": links.astype(np.int64), "root": roots})[(links > 0) | (roots != nodes)])
            if out:
                yield pd.concat(out)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """The vectors that can link: finite, not zero, with label and vec_id."""
    v = F.col("embedding")
    if "float" not in vectors.schema["embedding"].dataType.simpleString():
        v = v.cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", "label", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole).where(F.size("v") > 0)


def thinned(centres: np.ndarray) -> np.ndarray:
    """Which of the centres stay, in their order: those not closer than APART to one that stays."""
    stay: list[int] = []
    for k in range(len(centres)):
        if not stay or (centres[stay] @ centres[k]).max() < APART:
            stay.append(k)
    return np.array(stay, int)


def _celled(kind: str):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        """Home and guest cells of the vectors of one slice of a label, which comes with the label's centres."""
        centre = part["is_centre"].to_numpy()
        middle, part = part[centre].sort_values("node"), part[~centre]
        out = []
        if len(middle):
            to = unit(np.stack(middle["v"].to_numpy()).astype(np.float64))
            stay = thinned(to)
            ids, to = middle["node"].to_numpy()[stay], to[stay]
        for start in range(0, len(part), 1024):
            some = part.iloc[start : start + 1024]
            if not len(middle):
                home, cells = np.zeros(len(some), np.int64), [np.zeros(1, np.int64)] * len(some)
            else:
                near = unit(np.stack(some["v"].to_numpy()).astype(np.float64)) @ to.T
                best = near.argmax(axis=1)
                # |home - centre|, by which the difference of the cosines is the distance from the border
                wide = np.sqrt(np.maximum(2 - 2 * (to[best] @ to.T), 0))
                guest = near.max(axis=1)[:, None] - near <= BORDER * wide
                guest[np.arange(len(some)), best] = True
                home, cells = ids[best], [ids[row] for row in guest]
            packed = {"v": [np.asarray(v, kind).tobytes() for v in some["v"]], "guest": [c.tobytes() for c in cells]}
            out.append(pd.DataFrame({"node": some["node"], "label": some["label"], "copies": some["copies"], "home": home, "cells": cells, **packed}))
        none = {"node": "int64", "label": "int64", "copies": "int64", "home": "int64", "cells": object, "v": object, "guest": object}
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in none.items()})

    return run


def small(sizes: DataFrame) -> DataFrame:
    """Counts to join with: broadcast if they are few, else shuffled as any other table."""
    sizes = checkpoint(sizes)
    return F.broadcast(sizes) if sizes.count() <= FEW else sizes


def packed_as(member: DataFrame) -> str:
    """The numpy type that keeps the components as they are."""
    return "<f4" if "float" in member.schema["v"].dataType.simpleString() else "<f8"


def celled(member: DataFrame) -> DataFrame:
    """Vectors with their home and guest cells.

    About one vector in CELL of a label, CENTRES at most, is drawn by hash as a
    centre; every slice thins them alike. Each label is cut into slices by its size, and every slice gets the
    centres, so that no task holds more than a bounded part of a label.
    """
    sizes = small(member.groupBy("label").agg(F.count("*").alias("size")))
    slices = F.greatest(F.lit(1), F.ceil(F.col("size") / SLICE)).cast("int")
    sized = member.join(sizes, "label")
    rate = F.least(F.ceil(F.col("size") / CELL), F.lit(CENTRES)) / F.col("size")
    draw = F.pmod(F.xxhash64("node", F.lit("centre")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    middle = sized.where(draw < rate).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    cut = sized.withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int"))
    both = cut.withColumn("is_centre", F.lit(False)).union(middle.withColumn("is_centre", F.lit(True))).drop("size")
    schema = "node long, label long, copies long, home long, cells array<long>, v binary, guest binary"
    return both.groupBy("label", "slice").applyInPandas(_celled(packed_as(member)), schema=schema)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of `vectors`."""
    good = usable(vectors)
    # rows alike in label and components are copies of one node, linked with each other; its number is the least vec_id's
    key = ["label", "size", "one", "two"]
    keyed = good.select("vec_id", "label", "v", F.size("v").alias("size"), F.xxhash64("v").alias("one"), F.hash("v").alias("two"))
    nodes = keyed.groupBy(*key).agg(F.countDistinct("vec_id").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    nodes = checkpoint(nodes.withColumn("node", F.xxhash64(*key)))
    member = nodes.select("node", F.xxhash64("label", "size").alias("label"), "v", "copies")
    spread = checkpoint(celled(member))
    at_home = F.col("home") == F.col("cell")
    placed = spread.select("*", F.explode("cells").alias("cell")).drop("cells")
    placed = placed.join(small(placed.groupBy("label", "cell").agg(F.count("*").alias("size"), F.count_if(at_home).alias("homes"))), ["label", "cell"])
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / SHARD)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), parts(n)).cast("int")
    placed = placed.withColumns({"shard_of": own("size"), "block_of": F.when(at_home, own("homes"))})
    # every shard meets every block; a vector at home goes to all shards as a query and to all blocks as a member, a guest is a member alone
    pair = lambda shard, block: F.struct(shard.alias("shard"), block.alias("block"))
    as_member = F.transform(F.sequence(F.lit(0), parts("homes") - 1), lambda j: pair(F.col("shard_of"), j))
    as_query = F.transform(F.sequence(F.lit(0), parts("size") - 1), lambda i: pair(i, F.col("block_of")))
    placed = placed.select("*", F.inline(F.when(at_home, F.array_union(as_member, as_query)).otherwise(as_member)))
    task = ["label", "cell", "shard", "block"]
    placed = placed.select(*task, "shard_of", "block_of", "home", "guest", "node", "copies", "v").repartition(*task).sortWithinPartitions(*task)
    links = checkpoint(placed.mapInPandas(_linked(packed_as(member)), schema="node long, links long, root long"))
    final = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    per = nodes.select(*key, "node", "least", "copies").join(counts, "node", "left").join(final, "node", "left")
    per = per.withColumn("component", F.coalesce("component", "node"))
    per = per.join(per.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    per = per.select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    v = F.col("embedding").cast(good.schema["v"].dataType)
    rows = vectors.select("vec_id", "label", v.alias("v"))
    rows = rows.select("vec_id", "label", F.size("v").alias("size"), F.xxhash64("v").alias("one"), F.hash("v").alias("two"))
    out = rows.join(per, key, "left")
    n = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long")
    group = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).cast("long")
    return out.select("vec_id", n.alias("n_links"), group.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, found: DataFrame, every: int = 50) -> float:
    """Recall of the links of every `every`th vec_id against brute force over its label (for tests and tuning)."""
    good = usable(vectors)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    good = good.withColumn("v", F.transform("v", lambda x: x / norm))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    queries = good.where(F.col("vec_id") % every == 0)
    pairs = queries.join(good.select(F.col("vec_id").alias("other"), "label", F.col("v").alias("w")), "label").where("vec_id != other").where(dot >= COSINE)
    want = pairs.groupBy("vec_id").count()
    got = want.join(found, "vec_id").agg(F.sum(F.least("count", "n_links")), F.sum("count")).first()
    return 1.0 if not got[1] else got[0] / got[1]


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT x.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, x.vec_id = c.component_id AS kept FROM embeddings x
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = x.vec_id LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = x.vec_id
"""
