"""Tables that are merged into by key, as Parquet files with a manifest.

Rows are dealt into buckets by a hash of their key. A merge reads and writes only the
buckets that its rows touch, each into a new folder; the manifest, a small JSON file
that says which folder each bucket is in now, is put in place last, by a rename. A
reader sees the table before or after a merge and nothing between. A merge names its
writer and number; one with a number that this writer has already merged is a rerun
and changes nothing. Folders that no kept manifest names go with `vacuum`.

Rows: columns of the new rows win, columns that they lack survive, columns that the
table lacks are added; of new rows of one key the one of the greatest `order` is
taken, ties by all columns; a null key is a key like others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.feedback import upsert

BUCKETS = 64


@dataclass
class Manifest:
    """One state of a table: folders by bucket, the last merge of each writer, the schema."""

    version: int = 0
    buckets: int = BUCKETS
    folders: dict[str, str] = field(default_factory=dict)
    merged: dict[str, int] = field(default_factory=dict)
    schema: dict | None = None


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, where = _files(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The latest state of a table, or one that is kept; an empty one if there is none."""
    versions = _versions(spark, path)
    if not versions:
        return Manifest()
    files, where = _files(spark, f"{path}/manifests/{version or versions[-1]:09}.json")
    stream = files.open(where)
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, state: Manifest) -> None:
    files, draft = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(state.__dict__).encode()))
    stream.close()
    _, place = _files(spark, f"{path}/manifests/{state.version:09}.json")
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise RuntimeError(f"another merge has made version {state.version} of {path}")


def _rows(spark: SparkSession, path: str, state: Manifest, buckets: list[str]) -> DataFrame | None:
    folders = [f"{path}/{state.folders[b]}" for b in buckets if b in state.folders]
    if state.schema is None:
        return None
    schema = StructType.fromJson(state.schema)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a table, each key once."""
    state = manifest(spark, path, version)
    rows = _rows(spark, path, state, sorted(state.folders))
    if rows is None:
        raise FileNotFoundError(f"no table has been merged into {path}")
    return rows


def merge_keyed(new: DataFrame, path: str, writer: str, number: int, key: str | list[str] = "id", order: str | None = None, buckets: int = BUCKETS, keep: Column | None = None) -> Manifest:
    """Merge rows by key, one column or several; returns the state after it. `buckets` counts for a new table only; rows of the buckets rewritten for which `keep` does not hold go."""
    spark = new.sparkSession
    state = manifest(spark, path)
    if number <= state.merged.get(writer, -1):
        return state
    n, keys = state.buckets if state.version else buckets, [key] if isinstance(key, str) else key
    rank = F.struct(*([order] if order else []), *[c for c in new.columns if c != order and "map" not in new.schema[c].dataType.simpleString()])
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), rank).alias("row")).select("row.*")
    dealt = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    name = f"data/{state.version + 1:09}-{uuid.uuid4().hex[:8]}"
    touched = [str(r[0]) for r in new.select(dealt.alias("b")).distinct().collect()]  # no more than there are buckets
    old = _rows(spark, path, state, touched)
    rows = latest if old is None else upsert(old, latest, keys)
    rows = rows if keep is None else rows.where(keep)
    if touched:
        rows.withColumn("__bucket", dealt).repartition(min(n, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{name}")
    folders = state.folders | {b: f"{name}/__bucket={b}" for b in touched}
    done = Manifest(state.version + 1, n, folders, state.merged | {writer: number}, json.loads(rows.schema.json()))
    _put(spark, path, done)
    return done


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the folders and manifests that the last `keep` states do not need; returns how many folders went."""
    versions = _versions(spark, path)
    used = {f for v in versions[-keep:] for f in manifest(spark, path, v).folders.values()}
    files, where = _files(spark, f"{path}/data")
    gone = 0
    for made in files.listStatus(where) if files.exists(where) else []:
        if int(made.getPath().getName().split("-")[0]) > versions[-1]:
            continue  # a merge that is under way
        for part in files.listStatus(made.getPath()):
            name = f"data/{made.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in used:
                gone += files.delete(part.getPath(), True)
    for v in versions[:-keep]:
        files.delete(_files(spark, f"{path}/manifests/{v:09}.json")[1], False)
    return gone
