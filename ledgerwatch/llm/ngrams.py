"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles (64-bit hashes); a text of one to four words
is one shingle. Two documents are linked if the Jaccard similarity of their sets
is 0.8 or more.

1. Documents with equal sets form one class; the rest works on classes.
2. `HASHES` MinHash values of each class fall into bands of `ROWS`. Classes that
   share a band are candidates: a pair at the threshold fails to share any with
   probability (1 - 0.8**5)**32, about 3 in a million.
3. Candidates compare their MinHash values `STEP` at a time. With m of n values
   equal, and any similarity as likely as another before, the similarity is at
   least 0.8 with probability P(Bin(n + 1, 0.8) <= m); a pair is dropped when that
   falls below `TOLERANCE`.
4. What remains is verified exactly, by counting common shingles. The surviving
   pairs connect the classes to candidate groups. In a small or dense group blocks
   of classes are compared as a whole, which ships each set once for every block of
   the group; in a group where the surviving pairs are fewer than that, a chain of
   many loosely alike texts, the pairs are listed and compared one by one. A pair
   is counted and listed in the first band that it shares.

A band or group of any size is split into blocks, and each task compares two
blocks: nothing is capped. Tasks return counts of links and one link to a root
for each class, and list pairs only where they are fewer than the rows of blocks,
so the rows do not grow with the square of a group.

Nulls and edge cases: a text that is null or has no words is linked with nothing;
a null doc_id is a document like any other, whose class takes the least doc_id
that is not null; rows of the same doc_id are separate documents; repeated rows
are copies, linked with each other; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, in_blocks, local_roots, read, whole_groups, words

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 5
HASHES, STEP = BANDS * ROWS, 32
TOLERANCE = 1e-6
#: Classes in a block of a band, and of a candidate group.
BAND_BLOCK, GROUP_BLOCK = 512, 256
#: Pairs compared at a time.
PAIRS = 100_000

_RANDOM = np.random.default_rng(5)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _RANDOM.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text given the hashes of its words, sorted."""
    hashes = np.asarray(hashes).astype(np.int64).view(np.uint64)
    if not len(hashes):
        return hashes
    width = min(SHINGLE, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total += mix(hashes[k : k + n] + np.uint64(k)) * _POWERS[k]
    return np.unique(mix(total))


def identity(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of shingles."""
    return int(np.add.reduce(mix(found + np.uint64(1))).view(np.int64)), int(np.bitwise_xor.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 512):
        np.minimum(least, (_FACTORS[:, None] * found[None, at : at + 512]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def bands_of(signs: np.ndarray) -> np.ndarray:
    """A hash of each band, its number included."""
    parts = signs.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((parts * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) + (np.arange(BANDS, dtype=np.uint64) << np.uint64(32))).view(np.int64)


def fewest_matches(n: int, tolerance: float = TOLERANCE) -> int:
    """The least m for which m of n equal MinHash values leave the threshold likely enough."""
    t, below = SIMILAR[0] / SIMILAR[1], 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


FEWEST = [fewest_matches(n) for n in range(STEP, HASHES + 1, STEP)]


def hashed_words(docs: DataFrame, *also: str) -> DataFrame:
    return docs.select("doc_id", *also, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for hashes in batch["hashes"]:
            found = shingles(hashes)
            if not len(found):
                rows.append((0, 0, 0, b"", []))
                continue
            signs = signature(found)
            rows.append((*identity(found), len(found), signs.tobytes(), bands_of(signs)))
        yield pd.concat([batch.drop(columns="hashes"), pd.DataFrame(rows, columns=["node", "check", "n", "signs", "bands"], index=batch.index)], axis=1)


def surviving(signs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs a-b are still likely enough once their MinHash values are compared step by step."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, fewest in enumerate(FEWEST):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[left] += (signs[a[left], part] == signs[b[left], part]).sum(axis=1, dtype=np.int32)
        left = left[matches[left] >= fewest]
    return left


def pairs_of(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within neighbouring groups of the given sizes, a bounded number at a time."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    rows = np.arange(len(ends))
    counts = ends - rows - 1
    total, at = np.cumsum(counts), 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        own = counts[at:stop]
        a = np.repeat(rows[at:stop], own)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        at = stop


def _sizes(keys: pd.DataFrame) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = (keys.to_numpy()[1:] != keys.to_numpy()[:-1]).any(axis=1)
    return np.diff(np.append(np.flatnonzero(new), len(keys)))


def _survivors(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The surviving pairs (row, row) of the blocks in `rows` that share no earlier band."""
    signs = np.frombuffer(b"".join(rows["signs"]), np.uint16).reshape(len(rows), HASHES)
    mine, across, band = rows["mine"].to_numpy(), (rows["i"] != rows["j"]).to_numpy(), rows["k"].to_numpy()
    for a, b in pairs_of(_sizes(rows[["band", "i", "j"]])):
        fresh = ~across[a] | (mine[a] != mine[b])
        a, b = a[fresh], b[fresh]
        left = surviving(signs, a, b)
        a, b = a[left], b[left]
        first = (signs[a] == signs[b]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        yield a[first == band[a]], b[first == band[a]]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A link to a root for each class that a surviving pair connects, and the number of these pairs."""
    for rows in whole_groups(batches, ["band", "i", "j"]):
        nodes, inverse = np.unique(rows["node"].to_numpy(), return_inverse=True)
        ends: list[list[np.ndarray]] = [[], []]
        for a, b in _survivors(rows):
            ends[0].append(inverse[a])
            ends[1].append(inverse[b])
        if not ends[0]:
            continue
        a, b = np.concatenate(ends[0]), np.concatenate(ends[1])
        roots, pairs = local_roots(len(nodes), a, b), np.bincount(a, minlength=len(nodes))
        told = (roots != np.arange(len(nodes))) | (pairs > 0)
        yield pd.DataFrame({"a": nodes[told], "b": nodes[roots[told]], "pairs": pairs[told]})


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The surviving pairs of classes themselves."""
    for rows in whole_groups(batches, ["band", "i", "j"]):
        nodes = rows["node"].to_numpy()
        for a, b in _survivors(rows):
            yield pd.DataFrame({"a": nodes[a], "b": nodes[b]})


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of pairs whose sets lie side by side: for either end the documents of the other, and the root."""
    for batch in batches:
        sets = [[np.frombuffer(x, np.uint64) for x in batch[c]] for c in ("found_a", "found_b")]
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64)
        sizes = [np.array([len(x) for x in side], np.int64) for side in sets]
        kept = batch[SIMILAR[1] * both >= SIMILAR[0] * (sizes[0] + sizes[1] - both)]
        root = kept[["a", "b"]].min(axis=1)
        yield pd.concat([pd.DataFrame({"node": kept[x], "links": kept[f"copies_{y}"], "root": root}) for x, y in ("ab", "ba")])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    held = np.bincount(column)[column] > 1  # a shingle of one set is common to none
    column, owner = column[held], owner[held]
    out = np.zeros((n, n), np.float32)
    if not len(column):
        return out.astype(np.int64)
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    width = max(256, (1 << 21) // n)
    for at in range(0, int(column[-1]) + 1, width):
        here = slice(*np.searchsorted(column, (at, at + width)))
        part = np.zeros((n, width), np.float32)
        part[owner[here], column[here] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each class of two blocks: how many documents of others it is linked with, and the root of those links."""
    for rows in whole_groups(batches, ["component", "i", "j"], 512):
        out = []
        for (_, i, j), group in rows.groupby(["component", "i", "j"], sort=False):
            group = group.drop_duplicates("node")
            sets = [np.frombuffer(x, np.uint64) for x in group["found"]]
            nodes, mine, copies = group["node"].to_numpy(), group["mine"].to_numpy(), group["copies"].to_numpy()
            sizes = np.array([len(s) for s in sets])
            both = common(sets)
            linked = SIMILAR[1] * both >= SIMILAR[0] * (sizes[:, None] + sizes[None, :] - both)
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= mine[:, None] != mine[None, :]
            a, b = np.nonzero(np.triu(linked))
            order = np.argsort(nodes)
            rank = np.argsort(order)
            roots = nodes[order][local_roots(len(nodes), rank[a], rank[b])[rank]]
            out.append(pd.DataFrame({"node": nodes, "links": linked @ copies, "root": roots})[linked.any(axis=1)])
        yield pd.concat(out)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [shingles(x) for x in batch["hashes"]]
        mine = np.array([identity(x)[0] if len(x) else 0 for x in found], np.int64) == batch["node"].to_numpy()
        kept = batch[mine].drop(columns="hashes")
        yield kept.assign(found=[x.tobytes() for x, m in zip(found, mine, strict=True) if m])


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_links, class_id, n_shingles): a row for each row of `docs`.

    n_links counts the other documents linked with it, class_id is the least
    doc_id that links lead to.
    """
    return grouped_documents(docs).drop("group")


def grouped_documents(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, `also`, n_links, class_id, n_shingles, group): `similar_documents` with further columns of `docs`.

    `group` is the same for all that links lead to, whatever their doc_ids, and
    null for a text without words.
    """
    carried = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *also))
    described = hashed_words(docs, *also).mapInPandas(_described, schema=f"{carried}, node long, check long, n int, signs binary, bands array<long>")
    described = checkpoint(described)
    classes = described.where("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("signs").alias("signs"), F.first("bands").alias("bands"))
    classes = checkpoint(classes)
    banded = classes.select("node", F.posexplode("bands").alias("k", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    # MinHash values follow only to the bands that several classes share
    near = in_blocks(banded.join(shared, "band").join(classes.select("node", "signs"), "node"), "band", "size", "node", BAND_BLOCK)
    near = near.select("band", "k", "i", "j", "mine", "node", "signs")
    edges = checkpoint(near.mapInPandas(_candidates, schema="a long, b long, pairs long"))
    groups = components(edges.select("a", "b")).withColumnRenamed("id", "node")
    pairs = edges.groupBy(F.col("a").alias("node")).agg(F.sum("pairs").alias("pairs"))
    groups = checkpoint(groups.join(pairs, "node", "left").join(classes.select("node", "least", "copies"), "node"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"), F.sum(F.coalesce("pairs", F.lit(0))).alias("pairs"))
    # a listed pair ships two sets, a group in blocks each set once a block
    sizes = checkpoint(sizes.withColumn("sparse", 2 * F.col("pairs") < F.col("size") * F.ceil(F.col("size") / F.lit(GROUP_BLOCK))))
    wanted = groups.join(sizes, "component").select("component", "size", "sparse", "node", "copies", "least")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).select("component", "size", "sparse", "node", "copies", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    sets = texts.mapInPandas(_sets, schema="component long, size long, sparse boolean, node long, copies long, found binary")
    loose = sizes.where("sparse").limit(1).count() > 0
    if loose:
        sets = checkpoint(sets)
    blocks = in_blocks(sets.where("not sparse"), "component", "size", "node", GROUP_BLOCK).select("component", "i", "j", "mine", "node", "copies", "found")
    links = blocks.mapInPandas(_verified, schema="node long, links long, root long")
    if loose:
        each = sets.where("sparse").dropDuplicates(["node"])
        side = lambda x: each.select(F.col("node").alias(x), F.col("copies").alias(f"copies_{x}"), F.col("found").alias(f"found_{x}"))
        listed = near.join(each.select("node"), "node", "left_semi").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        listed = listed.mapInPandas(_listed, schema="a long, b long").join(side("a"), "a").join(side("b"), "b")
        links = links.union(listed.mapInPandas(_compared, schema="node long, links long, root long"))
    links = checkpoint(links)
    final = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    per = classes.select("node", "check", "least", "copies").join(counts, "node", "left").join(final, "node", "left")
    per = per.withColumn("component", F.coalesce("component", "node"))
    least = per.groupBy("component").agg(F.min("least").alias("class_id"))
    per = per.join(least, "component").select("node", "check", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id", F.col("component").alias("group"))
    # by both hashes: sets that share one are still two classes
    out = described.select("doc_id", *also, "node", "check", "n").join(per, ["node", "check"], "left")
    return out.select("doc_id", *also, F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.col("n").cast("long").alias("n_shingles"), "group")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM parts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(l.n, 0) AS n_links, c.class_id, coalesce(s.n, 0) AS n_shingles FROM documents d
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id LEFT JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON c.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
