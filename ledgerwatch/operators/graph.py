"""Graph analytics over edges (src, dst, n_txn, amount_sum, n_flagged), all as joins.

Loops keep their state in small tables that are checkpointed each round; the
driver sees a count or a checksum a round and nothing else.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import components as stars
from ..functions.lineage import checkpoint
from ..functions.scalars import half_up
from .patterns import fast_flow_pairs

DAMPING, SEED_WEIGHT, ROUNDS = 0.85, 0.3, 20


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): weakly connected components, named by their least id."""
    pairs = checkpoint(pairs.select("src", "dst").distinct())
    joined = stars(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    # nodes that only pay themselves are components of their own
    nodes = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    return nodes.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def communities(ledger: DataFrame, pairs: DataFrame, least: float = 0.3, member: DataFrame | None = None, digits: int | None = 4) -> DataFrame:
    """(component, size, density, score) of components of three or more, kept above a score of `least`; `member` is what `components` gives.

    The members of each are the rows of `member`: a giant component is never listed in one place.
    """
    member = components(pairs) if member is None else member
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    inner = pairs.where("src != dst").join(member.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count("*").alias("links"))
    paid = ledger.groupBy("src").agg(F.count("*").alias("n")).join(member.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.sum("n").alias("txns"))
    fast = fast_flow_pairs(ledger).join(member.withColumnRenamed("id", "account"), "account").groupBy("component").agg(F.sum("pairs").alias("fast"))
    both = sizes.where("size >= 3").join(inner, "component").join(paid, "component").join(fast, "component", "left").fillna(0, ["fast"])
    both = both.withColumn("density", F.col("links") / (F.col("size") * (F.col("size") - 1)))
    both = both.withColumn("score", F.least(F.lit(1.0), 2 * F.col("density") + F.col("fast") / F.col("txns"))).where(F.col("score") > least)
    return both.select("component", "size", _digits(F.col("density"), digits).alias("density"), _digits(F.col("score"), digits).alias("score"))


def _digits(x: Column, digits: int | None) -> Column:
    return x if digits is None else half_up(x, digits)


#: Gains below this share of all links are rounding.
LEAST_GAIN = 1e-9


def _quality(links: DataFrame, now: DataFrame, total: float) -> float:
    """The modularity of `now(id, k, community)` but for links inside nodes, which no move changes."""
    side = lambda c: now.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    inside = links.join(side("a"), "a").join(side("b"), "b").where("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    squares = now.groupBy("community").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    return inside / total - squares / total**2


def _gains(links: DataFrame, now: DataFrame, total: float) -> DataFrame:
    """(id, k, home, gain, to): the move of each node that gains most, if any does; the least community of equal ones."""
    votes = links.join(now.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
    sizes = now.groupBy("community").agg(F.sum("k").alias("s"))
    own = now.join(sizes, "community").join(votes.select("id", "community", F.col("w").alias("w0")), ["id", "community"], "left").select("id", "k", F.col("community").alias("home"), F.col("s").alias("s0"), F.coalesce("w0", F.lit(0.0)).alias("w0"))
    options = votes.join(own, "id").where("community != home").join(sizes, "community")
    gain = (F.col("w") - F.col("w0")) - F.col("k") * (F.col("s") - F.col("s0") + F.col("k")) / total
    options = options.withColumn("loss", F.round(-gain / total, 12)).where(F.col("loss") < -LEAST_GAIN)
    best = options.groupBy("id").agg(F.min(F.struct("loss", "community", "k", "home")).alias("b"))
    return best.select("id", "b.k", "b.home", (-F.col("b.loss")).alias("gain"), F.col("b.community").alias("to"))


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch the same community, each the best of all that touch one of its own: what they gain adds up."""
    order = F.struct((-F.col("gain")).alias("loss"), "id")
    best = moves.select("id", "gain", F.explode(F.array("home", "to")).alias("community")).groupBy("community").agg(F.min(order).alias("best"))
    side = lambda c: best.select(F.col("community").alias(c), F.col("best.id").alias(f"{c}_best"))
    return moves.join(side("home"), "home").join(side("to"), "to").where("home_best = id and to_best = id").drop("home_best", "to_best")


def _local_moves(links: DataFrame, now: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """`now(id, k, community)` after rounds of moves, each of which raises the modularity, and whether any node moved.

    A third of the nodes move at once; where that would not raise the modularity, as
    when neighbours swap, moves that touch no community in common are made instead.
    """
    total = float(now.agg(F.sum("k")).first()[0] or 0.0)
    if not total:
        return now, False
    value, moved = _quality(links, now, total), False
    for k in range(rounds):
        moves = checkpoint(_gains(links, now, total))
        if not moves.limit(1).count():
            break
        apply = lambda chosen: checkpoint(now.join(chosen.select("id", "to"), "id", "left").select("id", "k", F.coalesce("to", "community").alias("community")))  # noqa: B023, E731
        tried = apply(moves.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) == k % 3))
        reached = _quality(links, tried, total)
        if reached <= value:
            tried = apply(_apart(moves))
            reached = _quality(links, tried, total)
            if reached <= value:  # what is left is rounding
                break
        now, value, moved = tried, reached, True
    return now, moved


def modularity(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """One row (modularity) of a partition `member(id, community)` of the undirected graph without weights."""
    links = _undirected(pairs)
    both = links.union(links.select("b", "a"))
    total = both.agg(F.count("*").alias("m2"))
    side = lambda c: member.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    ends = both.join(side("a"), "a").join(side("b"), "b")
    per = ends.groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("d"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    share = F.col("inside") / F.col("m2") - F.pow(F.col("d") / F.col("m2"), F.lit(2))
    return per.crossJoin(F.broadcast(total)).agg(half_up(F.coalesce(F.sum(share), F.lit(0.0)), 4).alias("modularity"))  # total: one row


def _undirected(pairs: DataFrame) -> DataFrame:
    return pairs.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


#: Graphs of so many directed links at most (communities as nodes, after the first levels) are settled by one task, those of so few also from what the greedy method joins.
SMALL, GREEDY = 1 << 21, 1 << 18


def _swept(near: dict, k: dict, member: dict) -> dict:
    """`member` after single nodes have moved to where they gain most, until none gains."""
    total, size = sum(k.values()), defaultdict(float)
    for x, c in member.items():
        size[c] += k[x]
    again = True
    while again:
        again = False
        for x in near:
            home, votes = member[x], defaultdict(float)
            for y, w in near[x].items():
                votes[member[y]] += w
            size[home] -= k[x]
            gain = {c: w - k[x] * size[c] / total for c, w in votes.items()}
            stay = gain.get(home, -k[x] * size[home] / total)
            best = min(gain, key=lambda c: (-gain[c], c), default=home)
            if best != home and gain[best] > stay + LEAST_GAIN * total:
                member[x], again = best, True
            size[member[x]] += k[x]
    return member


def _joined_up(near: dict, k: dict) -> dict:
    """The greedy method: the two communities that gain most are joined, until none gain."""
    total, k = sum(k.values()), dict(k)
    near, member = {x: dict(n) for x, n in near.items()}, {x: [x] for x in near}
    gain = lambda a, b: near[a][b] - k[a] * k[b] / total
    heap = [(-gain(a, b), a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        loss, a, b = heapq.heappop(heap)
        if a not in near or b not in near[a] or -loss != gain(a, b):
            continue
        if loss >= 0:
            break
        for y, w in near.pop(b).items():
            del near[y][b]
            if y != a:
                near[a][y] = near[y][a] = near[a].get(y, 0.0) + w
        k[a] += k.pop(b)
        member[a] += member.pop(b)
        for y in near[a]:
            heapq.heappush(heap, (-gain(min(a, y), max(a, y)), min(a, y), max(a, y)))
    return {x: c for c, own in member.items() for x in own}


def _levels(near: dict, k: dict, member: dict) -> dict:
    """`member` after moves of nodes, of their communities as nodes, and of nodes again."""
    member = _swept(near, k, member)
    if len(set(member.values())) < len(near):
        links, sums = {c: defaultdict(float) for c in member.values()}, defaultdict(float)
        for x, n in near.items():
            sums[member[x]] += k[x]
            for y, w in n.items():
                if member[x] != member[y]:
                    links[member[x]][member[y]] += w
        links = {c: links[c] for c in sorted(links)}
        outer = _levels(links, sums, {c: c for c in links})
        member = _swept(near, k, {x: outer[c] for x, c in member.items()})
    return member


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, community) of a small graph, given as links (a, b, w) and nodes (a, null, k).

    The best of moves from single nodes and, of GREEDY links at most, from what the greedy
    method joins, with equal gains settled by the smaller names and by the larger ones.
    """
    if not (given := list(batches)):
        return
    rows = pd.concat(given)
    del given
    alone = rows["b"].isna()
    nodes, links = rows[alone].sort_values("a"), rows[~alone]
    names, total = nodes["a"].tolist(), math.fsum(nodes["w"])
    place = pd.Index(names)
    ends = [place.get_indexer(links[c]) for c in "ab"]

    def value(near: dict, k: dict, member: dict) -> float:
        sums = defaultdict(float)
        for x, c in member.items():
            sums[c] += k[x]
        return sum(w for x, n in near.items() for y, w in n.items() if member[x] == member[y]) / total - sum(s * s for s in sums.values()) / total**2

    best, found = -1.0, {}
    for order in (names, names[::-1]):
        numbers = list(range(len(names)))
        turn = (lambda x: x) if order is names else (lambda x: len(names) - 1 - x)
        k = dict(zip(numbers, nodes["w"].tolist() if order is names else nodes["w"].tolist()[::-1], strict=True))
        near: dict = {x: {} for x in numbers}
        for x, y, w in zip(turn(ends[0]).tolist(), turn(ends[1]).tolist(), links["w"].tolist(), strict=True):
            near[x][numbers[y]] = w
        for start in ({x: x for x in k}, *([_joined_up(near, k)] if len(links) <= GREEDY else [])) if total else ():
            member = _levels(near, k, start)
            if (reached := value(near, k, member)) > best:
                best, found = reached, {order[x]: order[c] for x, c in member.items()}
    if found:
        yield pd.DataFrame(list(found.items()), columns=["id", "community"])


def modularity_communities(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community, modularity): communities of high modularity of the undirected graph without weights, named by their least id.

    Nodes move to the neighbouring community that gains most; communities then become
    the nodes of a smaller graph, whose links are theirs summed up, and move in turn.
    Every step raises the modularity. Links are joined and summed, never gathered,
    until a graph has SMALL links at most, which one task settles; of a graph of GREEDY
    links from the start the result has no less modularity than the greedy method's.
    """
    links = _undirected(pairs)
    base = checkpoint(links.union(links.select("b", "a")).withColumn("w", F.lit(1.0)))
    nodes = checkpoint(base.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    level, now, member = base, nodes.withColumn("community", F.col("id")), None
    while level.count() > SMALL:
        now, moved = _local_moves(level, now, rounds)
        if not moved:
            break
        side = lambda c: now.select(F.col("id").alias(c), F.col("community").alias(f"c{c}"))  # noqa: B023, E731
        level = checkpoint(level.join(side("a"), "a").join(side("b"), "b").where("ca != cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        member = _composed(member, now)
        now = checkpoint(now.groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k")).withColumn("community", F.col("id")))
    else:
        kind = links.schema["a"].dataType.simpleString()
        rows = level.union(now.select("id", F.lit(None).cast(kind), "k"))
        member = _composed(member, rows.coalesce(1).mapInPandas(_settled, schema=f"id {kind}, community {kind}"))
    if member is None:  # no node of a large graph gains by moving
        member = now.select("id", "community")
    names = member.groupBy("community").agg(F.min("id").alias("name"))
    member = checkpoint(member.join(names, "community").select("id", F.col("name").alias("community")))
    return member.crossJoin(F.broadcast(modularity(pairs, member)))  # one row


def _composed(member: DataFrame | None, outer: DataFrame) -> DataFrame:
    """Where the nodes of the first graph are once their communities have moved as `outer(id, community)` says."""
    if member is None:
        return checkpoint(outer.select("id", "community"))
    moved = outer.select(F.col("id").alias("community"), F.col("community").alias("to"))
    return checkpoint(member.join(moved, "community").select("id", F.col("to").alias("community")))


def _carried(e: DataFrame, start: DataFrame) -> DataFrame:
    """(id, b): what each node carries of the shortest paths from the sources `start(source, weight)`, sources themselves only for those folded into them.

    A state row is (source, node, paths); levels grow by joins, and what each node
    carries is summed back level by level. A source of weight 1 + w stands for w nodes
    as well that reach it alone and are reached by none: their paths go on as its own do,
    and all but the one to the source itself pass it.
    """
    level = checkpoint(start.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths")))
    seen, levels = level.select("source", "node"), [level]
    while True:
        grown = level.join(e.withColumnRenamed("src", "node"), "node").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = checkpoint(grown.join(seen, ["source", "node"], "left_anti"))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = checkpoint(seen.union(level.select("source", "node")))
    carried = levels[-1].select("source", "node", "paths", F.lit(0.0).alias("carried"))
    summed = [carried]
    for before in reversed(levels[:-1]):
        after = carried.select("source", F.col("node").alias("dst"), ((1 + F.col("carried")) / F.col("paths")).alias("share"))
        part = before.join(e.withColumnRenamed("src", "node"), "node").join(after, ["source", "dst"]).groupBy("source", "node").agg(F.sum(F.col("share") * F.col("paths")).alias("carried"))
        carried = checkpoint(before.join(part, ["source", "node"], "left").fillna(0.0, ["carried"]))
        summed.append(carried)
    # what a source carries of its own paths is the number of nodes that it reaches
    share = F.col("carried") * F.when(F.col("source") == F.col("node"), F.col("weight") - 1).otherwise(F.col("weight"))
    return reduce(DataFrame.unionByName, summed).join(start, "source").groupBy(F.col("node").alias("id")).agg(F.sum(share).alias("b"))


def betweenness(pairs: DataFrame, sources: int | None = 30, digits: int | None = 4) -> DataFrame:
    """(id, betweenness): shortest paths through each node from the sources, over the largest value or 1.

    Sources are those with the least MD5 sums of their ids (all if None, but see `exact_betweenness`).
    """
    e = checkpoint(pairs.where("src != dst").select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    start = nodes if sources is None else nodes.orderBy(F.md5("id"), "id").limit(sources)
    per = nodes.join(_carried(e, start.select(F.col("id").alias("source"), F.lit(1).alias("weight"))), "id", "left").fillna(0.0)
    most = per.agg(F.greatest(F.max("b"), F.lit(1.0)).alias("most"))
    return per.crossJoin(F.broadcast(most)).select("id", _digits(F.col("b") / F.col("most"), digits).alias("betweenness"))  # one row


#: Graphs of so many edges at most (numbers of 4 bytes) are sent to every task that walks them; so many edges are looked at at once.
WALKED, AT_ONCE = 1 << 23, 1 << 19


def _passed(first: np.ndarray, ways: np.ndarray, to: np.ndarray, source: int) -> np.ndarray:
    """What each node carries of the shortest paths from one source; the edges of node x are those from first[x] on, ways[x] of them."""
    paths, seen = np.zeros(len(first)), np.zeros(len(first), dtype=bool)
    paths[source], seen[source] = 1.0, True
    level, steps = np.array([source]), []
    while len(level):
        level = level[ways[level] > 0]
        parts = np.cumsum(ways[level]) // AT_ONCE
        reached, legs = np.zeros(len(first)), []
        for nodes in np.split(level, np.flatnonzero(np.diff(parts)) + 1):
            k = ways[nodes]
            ends = to[np.repeat(first[nodes] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            new = ~seen[ends]
            origins, ends = np.repeat(nodes, k)[new].astype(np.int32), ends[new]
            reached += np.bincount(ends, weights=paths[origins], minlength=len(first))
            legs.append((origins, ends))
        level = np.flatnonzero(reached)
        paths[level], seen[level] = reached[level], True
        steps.append(legs)
    carried = np.zeros(len(first))
    for legs in reversed(steps):
        # no leg of a level ends where another one of it starts
        carried += sum(np.bincount(origins, weights=paths[origins] * ((1 + carried[ends]) / paths[ends]), minlength=len(first)) for origins, ends in legs)
    return carried


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, b): as `_carried`, given each node's edges (src, dst array) and, for sources, a weight."""
    if not (given := list(batches)):
        return
    rows = pd.concat(given)
    own, ways = rows["src"].to_numpy(), rows["dst"].map(len).to_numpy()
    ends = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["dst"]])
    ids = np.unique(np.concatenate([own, ends]))
    first, count, total = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids))
    places = np.searchsorted(ids, own)
    first[places], count[places] = np.cumsum(ways) - ways, ways
    to = np.searchsorted(ids, ends).astype(np.int32)
    chosen = rows["weight"].notna().to_numpy()
    for source, weight in zip(places[chosen], rows["weight"].to_numpy()[chosen], strict=True):
        carried = _passed(first, count, to, source)
        total += weight * carried
        total[source] -= carried[source]
    yield pd.DataFrame({"id": ids, "b": total})


def exact_betweenness(pairs: DataFrame, batch: int = 256, digits: int | None = 4) -> DataFrame:
    """(id, betweenness): the share of all ordered pairs of other nodes, (n - 1)(n - 2) of them, whose shortest paths pass each node.

    Sources are dealt out to tasks, each of which walks from one at a time, if the
    graph has WALKED edges at most. In larger graphs they are worked on by joins in
    batches of about `batch`. The state is a row of n numbers for each task or batch x n
    rows, never n x n. Nodes without a way out are no sources, and nodes with one way
    out and none in are folded into the node that they reach.
    """
    e = checkpoint(pairs.where("src != dst").select("src", "dst").distinct())
    nodes = checkpoint(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("number", F.monotonically_increasing_id()))
    n = nodes.count()
    entered = e.select(F.col("dst").alias("src")).distinct()
    leaf = e.groupBy("src").agg(F.count("*").alias("o"), F.first("dst").alias("dst")).where("o = 1").join(entered, "src", "left_anti")
    folded = leaf.groupBy(F.col("dst").alias("source")).agg(F.count("*").alias("folded"))
    start = e.select(F.col("src").alias("source")).distinct().join(leaf.select(F.col("src").alias("source")), "source", "left_anti").join(folded, "source", "left")
    start = start.select("source", (1 + F.coalesce("folded", F.lit(0))).alias("weight"))
    if e.count() <= WALKED:
        total = _summed_walks(e, nodes, start)
    else:
        parts = max(1, -(-n // batch))
        start = checkpoint(start.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts))))
        total = nodes.select("id", F.lit(0.0).alias("b"))
        for k in range(parts):
            total = checkpoint(total.union(_carried(e, start.where(F.col("part") == k).drop("part"))).groupBy("id").agg(F.sum("b").alias("b")))
    return total.select("id", _digits(F.col("b") / ((n - 1) * (n - 2)) if n > 2 else F.lit(0.0), digits).alias("betweenness"))


def _summed_walks(e: DataFrame, nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(id, b) of all nodes, from walks of the sources `start(source, weight)`; each task has all edges of the graph and its share of the sources."""
    tasks = 2 * e.sparkSession.sparkContext.defaultParallelism
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("number").alias(f"{c}_number"))
    ways = e.join(side("src"), "src").join(side("dst"), "dst").groupBy("src", "src_number").agg(F.collect_list("dst_number").alias("dst"))
    ways = checkpoint(ways.join(start.withColumnRenamed("source", "src"), "src", "left").select(F.col("src_number").alias("src"), "dst", "weight", F.pmod(F.xxhash64("src_number"), F.lit(tasks)).alias("part")))
    dealt = ways.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).select("task", "src", "dst", F.when(F.col("part") == F.col("task"), F.col("weight")).alias("weight"))
    walked = dealt.repartitionById(tasks, F.col("task").cast("int")).select("src", "dst", "weight").mapInPandas(_walked, schema="id long, b double")
    per = walked.groupBy(F.col("id").alias("number")).agg(F.sum("b").alias("b"))
    return nodes.join(per, "number", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("b"))


def pagerank_risk(pairs: DataFrame, nodes: DataFrame, rounds: int = ROUNDS, digits: int | None = 4) -> DataFrame:
    """(id, pagerank): risk passed along payments, heavier from flagged payers, scaled to 0..1.

    A fixed number of rounds of DAMPING * sum(predecessor * weight) + 0.15 / n +
    SEED_WEIGHT * seed; the seed is a node's share of degree, the start is the
    normalised seed. Nodes without successors pass on nothing.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"), (F.sum("n_flagged") / F.sum("n_txn")).alias("share"))
    into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    base = ids.join(out, "id", "left").join(into, "id", "left").fillna(0)
    c = F.when(F.lit(n) > 1, F.least(F.lit(1.0), (F.col("i") + F.col("o")) / (n * 0.5))).otherwise(0.0)
    base = checkpoint(base.withColumn("seed", F.least(F.lit(1.0), (F.col("i") + F.col("o") + 100 * c) / 20)))
    weight = base.where("o > 0").select(F.col("id").alias("src"), ((1 / F.col("o")) * (1 + 2 * F.col("share"))).alias("weight"))
    weighted = checkpoint(pairs.select("src", "dst").join(weight, "src").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").repartition("src"))
    total = base.agg(F.sum("seed")).first()[0] or 1.0
    now = base.select("id", (F.col("seed") / total).alias("score"))
    for k in range(rounds):
        passed = weighted.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("weight")).alias("passed"))
        now = base.select("id", "seed").join(passed, "id", "left").select("id", (DAMPING * F.coalesce("passed", F.lit(0.0)) + (1 - DAMPING) / n + SEED_WEIGHT * F.col("seed")).alias("score"))
        if k % 5 == 4:
            now = checkpoint(now)
    span = now.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return now.crossJoin(F.broadcast(span)).select("id", _digits(scaled, digits).alias("pagerank"))  # one row


def neighbourhoods(pairs: DataFrame) -> DataFrame:
    """(id, neighbours, clustering, ego_density): links between the neighbours of each node.

    Each undirected link points from the end of lower degree to the other, so
    triangles are found from wedges at their rarest corner.
    """
    plain = pairs.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    links = checkpoint(plain.groupBy("a", "b").agg(F.count("*").alias("ways")))
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("k"))
    ends = links.join(degree.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    low = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    out = ends.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"), "ways")
    x, y = out.select("u", F.col("v").alias("v1"), F.col("ways").alias("w1")), out.select("u", F.col("v").alias("v2"), F.col("ways").alias("w2"))
    wedges = x.join(y, "u").where("v1 < v2")
    closed = wedges.join(links.select(F.col("a").alias("v1"), F.col("b").alias("v2"), F.col("ways").alias("w3")), ["v1", "v2"])
    corner = lambda node, opposite: F.struct(F.col(node).alias("id"), F.col(opposite).alias("ways"))
    per = closed.select(F.inline(F.array(corner("u", "w3"), corner("v1", "w2"), corner("v2", "w1")))).groupBy("id").agg(F.count("*").alias("triangles"), F.sum("ways").alias("directed"))
    both = degree.join(per, "id", "left").fillna(0)
    possible = F.col("k") * (F.col("k") - 1)
    value = lambda x, digits: half_up(F.when(F.col("k") >= 2, x / possible).otherwise(0.0), digits)
    return both.select("id", F.col("k").alias("neighbours"), value(2 * F.col("triangles"), 2).alias("clustering"), value(F.col("directed"), 3).alias("ego_density"))


def degree_centrality(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    side = lambda at: pairs.groupBy(F.col(at).alias("id")).agg(F.count("*").alias(f"{at}_d"))
    both = nodes.select("id").join(side("src"), "id", "left").join(side("dst"), "id", "left").fillna(0).crossJoin(F.broadcast(n))  # one row
    return both.select("id", half_up(F.when(F.col("n") > 1, F.least(F.lit(1.0), (F.col("src_d") + F.col("dst_d")) / (F.col("n") * 0.5))).otherwise(0.0), 4).alias("centrality"))
