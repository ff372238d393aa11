"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.lineage import checkpoint, shared_folder

__all__ = ["GAP", "WORD", "checkpoint", "components", "in_blocks", "kept", "let", "local_roots", "read", "running_sums", "stored", "whole_groups", "words"]

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space between words.
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What tasks of one operator leave in a Python worker for its next ones; what others have left there is freed."""
    if operator not in _KEPT:
        _KEPT.clear()
        _KEPT[operator] = {}
    return _KEPT[operator]


def stored(df: DataFrame) -> DataFrame:
    """`df` from a Parquet table in the shared folder; smaller than a checkpoint, and there as long as the folder is."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """[0, v0, v0+v1, ...]: one element more than `values`."""
    return let(values, _running_sums)


def _running_sums(values: Column) -> Column:
    """Built from blocks of about the square root of the length, so that a very
    long array costs n**1.5 element copies and not n**2.
    """

    def within(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        return F.aggregate(block, F.array(start.cast("long")), step)

    size = F.size(values)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
    short = within(values, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), width), lambda i: F.slice(values, i + 1, width))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
        inner = lambda starts: F.transform(blocks, lambda b, i: F.slice(within(b, F.element_at(starts, i + 1)), 2, F.size(b)))
        return F.concat(F.array(F.lit(0).cast("long")), F.flatten(let(within(totals, F.lit(0)), inner)))

    return F.when(size <= 64, short).otherwise(let(blocks, joined))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 4096) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows dealt anew, so that no group is cut in two; a group must fit in memory."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        joined = pd.concat(held, ignore_index=True)
        last = (joined[keys] != joined[keys].iloc[-1]).any(axis=1).to_numpy()
        cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
        if cut:
            yield joined.iloc[:cut].reset_index(drop=True)
        held = [joined.iloc[cut:]]
    if held and (joined := pd.concat(held, ignore_index=True)).size:
        yield joined


def in_blocks(rows: DataFrame, key: str, size: str, item: str, block: int) -> DataFrame:
    """`rows` with (i, j, mine): a copy for each pair of blocks i <= j of its group that has the row's own block.

    Blocks split a group of `size` rows by a hash of `item`, so the pairs of any
    group are found by tasks that hold two blocks each, however large the group.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(block))).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(item, F.lit(11)), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For items 0..n-1 and links a-b, the least item that each one reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        now = np.minimum(now, now[now])
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, root):
            break
        root = now
    return root
