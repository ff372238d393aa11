"""Mixing sources to target weights by balanced (cube) sampling.

Every source gets a target number of words; every document of it is then taken
`target / source_size` times on average. The whole part of that rate is taken
outright, the fractional part is an inclusion probability. Documents alike in
doc_id, source and size are one unit, whose copies are shared out at the end. The
cube method's flight phase moves the probabilities of a few units at a time along
the null space of two constraints, the words and the documents taken, until all but
two are 0 or 1; so both totals stay exact while the choice is made. Each step goes
to one wall or the other with the odds that leave every probability as it was on
average, by draws that are seeded by source and block: reruns agree.

The flight runs in blocks of a fixed number of units of one source, and the few
that each block leaves undecided go through the next round of blocks. The last two
of a source are the landing problem: the choice that comes closest to the target in
words, mended by exchanging decisions inside that last block. No block grows with a
source, so a source with a third of all rows is spread over as many tasks as its
size asks for. Nor does any task hold all sources: they are numbered by a range sort
and capped in rounds of sums.

Nulls and edge cases: a null text has size 0 and is never taken by its rate
(`taken` is a number of words, hence 0); a null source is a source of its own,
last in order; a source without words has target 0. Rows alike in doc_id,
source and size are separate documents, any of which may be taken; ties of size are
broken by doc_id. Texts of any length are counted whole; columns other than doc_id,
source and text are not read by `mix`, and kept as they are by `mixed_documents`
(names that begin with two underscores are its own). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, read

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 1024
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def numbered(per: DataFrame, by: str) -> DataFrame:
    """`per` with (number), from 0 in the order of distinct `by`, nulls last: by a range sort, whose parts' counts give their offsets."""
    order = F.col(by).asc_nulls_last()
    parts = checkpoint(per.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each part
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.join(F.broadcast(offsets), "part").withColumn("number", F.col("offset") + within - 1).drop("part", "offset")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, target): all words shared by weight, at most `cap` times a source's own.

    The level is the words a unit of weight gets. Sources whose share is above their
    cap are held there, which raises the level of the others, and so on until none
    is above: a round for each time that the level rises past further caps, and the
    driver sees four sums a round.
    """
    per = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    per = checkpoint(per.select("source", "source_size", "n_docs", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("cap")))
    level, held = 0.0, -1
    while True:
        over = F.col("cap") < level * F.col("weight")
        row = per.agg(F.sum("source_size"), F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        total, now, capped, free = (x or 0 for x in row)
        if now == held or not free:
            break
        held, level = now, (total - capped) / free
    return per.select("source", "source_size", "n_docs", F.least("cap", F.lit(float(level)) * F.col("weight")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping sum(p) and sum(p * size) and, on average over seeds, each p; at most two stay fractional."""
    draws = np.random.default_rng(seed).random(len(p)).tolist()
    p, size = p.tolist(), size.tolist()
    held: list[int] = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        # null vector of the rows (1, 1, 1) and (size a, size b, size c)
        u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if u == [0, 0, 0]:
            u = [1, -1, 0]
        room = lambda s: min((((1 - p[i]) if s * v > 0 else p[i]) / abs(v)) for i, v in zip(held, u, strict=True) if v)
        forth, back = room(1), room(-1)
        # the nearer wall has the better odds, so that the step is 0 on average
        step = forth if draws[k] * (forth + back) < back else -back
        for i, v in zip(held, u, strict=True):
            p[i] += step * v
            if p[i] < EPS or p[i] > 1 - EPS:
                p[i] = float(round(p[i]))
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last fractional documents: the choice nearest to the words they stand for."""
    p = p.copy()
    left = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    want = sum(p[i] * size[i] for i in left)
    picks = range(1 << len(left))
    best = min(picks, key=lambda m: (abs(sum(size[i] for j, i in enumerate(left) if m >> j & 1) - want), m), default=0)
    for j, i in enumerate(left):
        p[i] = float(best >> j & 1)
    # the document total gives way: exchange decisions, long documents first, while that brings the words nearer
    error = sum(p[i] * size[i] for i in left) - want
    for i in np.argsort(-size, kind="stable"):
        if 0 < size[i] <= abs(error) and p[i] == (error > 0):
            error += size[i] * (1 if error < 0 else -1)
            p[i] = 1 - p[i]
    return p


def _fly(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # long documents first: those left for the landing are short, and so is its error
        block = block.sort_values(["size", "key", "doc_id"], ascending=[False, True, True], kind="stable")
        p = flight(block["p"].to_numpy(float), block["size"].to_numpy(float), int(block["seed"].iloc[0]) & 0x7FFFFFFFFFFFFFFF)
        return block.assign(p=landing(p, block["size"].to_numpy(float)) if last else p)

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_REPEATS, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document, a row for each row of `docs`."""
    sized = sizes(docs)
    goal = checkpoint(targets(sized, weights, cap))
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    n_units = alike.groupBy("source").agg(F.count("*").alias("n_units"))
    goal = checkpoint(goal.join(n_units.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    most = goal.agg(F.max("n_units")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = alike.join(F.broadcast(goal) if goal.count() <= 10_000 else goal, alike["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    expected = F.col("rows") * (rate - F.floor(rate))
    units = units.select("doc_id", "source", "size", "source_size", "target", "rows", "n_units", F.floor(rate).alias("base"), F.floor(expected).alias("more"), (expected - F.floor(expected)).alias("p"), F.xxhash64("doc_id", "size").alias("key"))
    undecided, decided, expect = units, [], most
    level = 0
    while True:
        last = expect <= block
        cut = F.greatest(F.lit(1), F.ceil(F.col("n_units") / F.lit(block))).cast("long")
        flown = undecided.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), cut)).withColumn("seed", F.xxhash64("source", "block", F.lit(level)))
        flown = checkpoint(flown.groupBy("source", "block").applyInPandas(_fly(last), schema=flown.schema).drop("block", "seed"))
        decided.append(flown.where("p = 0 or p = 1"))
        if last:
            break
        # each block leaves two at most, so every source has this many left at most
        undecided = flown.where("p > 0 and p < 1").withColumn("n_units", 2 * F.ceil(F.col("n_units") / F.lit(block)))
        expect, level = 2 * -(-expect // block), level + 1
    out = decided[0]
    for part in decided[1:]:
        out = out.union(part)
    more = F.col("more") + F.col("p").cast("long")
    out = out.select("doc_id", "source", "size", "source_size", "target", "base", more.alias("more"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("k"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + (F.col("k") <= F.col("more")).cast("long")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Documents without words are kept once, as they count for nothing. Rows that
    agree in doc_id, source and size get the whole part of their share each, and one
    more by a hash of their text.
    """
    chosen = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies"), F.count("*")).toDF("__doc", "__source", "__words", "__copies", "__rows")
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0))
    both = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("__doc")) & docs["source"].eqNullSafe(F.col("__source")) & (words == F.col("__words")))
    # rows that share the copies are dealt them by a hash of their text and id, over which what remains is spread
    part = F.pmod(F.xxhash64(docs["text"], F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = F.when(F.col("__words") == 0, F.lit(1)).when(F.col("__rows") == 1, F.col("__copies").cast("int")).otherwise(F.floor(F.col("__copies") / F.col("__rows") + part).cast("int"))
    both = both.select(*[docs[c] for c in docs.columns], each.alias("__n")).where("__n > 0")
    return both.withColumn("__n", F.explode(F.sequence(F.lit(1), "__n"))).drop("__n")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
