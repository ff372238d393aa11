"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpoint

#: Tasks that share the edges of one node.
SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): edges with the least neighbour of `a`. A node of many edges is counted and looked up in parts."""
    # dealt once, for the parts and for the join
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).repartition("a", "salt")
    parts = edges.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts")).select("a", "m", F.explode("salts").alias("salt"))
    # merged, however small: each table broadcast in each round would pass through the driver and stay there for a while
    return edges.join(least.hint("merge"), ["a", "salt"]).select("a", "b", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether edges from larger to smaller ids are one star around each centre: nobody has two edges down, or one down and one up."""
    end = lambda c: F.struct(F.col(c).alias("id"), F.lit(c == "a").cast("int").alias("down"), F.lit(c == "b").cast("int").alias("up"))
    ends = edges.select(F.inline(F.array(end("a"), end("b"))))
    per = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not per.agg(F.count_if(F.col("down") + F.least("down", "up") > 1)).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a, b)`: rows (id, component), component the smallest id; ids may be of any type with an order.

    Alternates large-star and small-star steps until the edges form one star around
    each smallest id; edges that do so from the start take no step. Only the edges
    are ever shuffled, nothing is gathered in one place but a count a round. Each
    exchange costs the driver a thread and a plan for a while, so rounds are few and short.
    """
    now = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        both = _with_least(now.union(now.select("b", "a")))
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b")
        small = _with_least(large)
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").where("a != b").distinct()
        now = checkpoint(small)
    return now.toDF("id", "component").union(now.select("b", "b").distinct())


def _changes(df: DataFrame) -> int:
    return df.agg(F.count_if("changed")).first()[0]


def _trimmed(edges: DataFrame) -> DataFrame:
    """`edges(src, dst)` without nodes that lack an edge in or out, until none is left."""
    edges, before = checkpoint(edges), -1
    while (now := edges.count()) != before:
        before = now
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = checkpoint(kept.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of two nodes or more of `edges(src, dst)`, named by their least id.

    Forward, each node gets the least id that reaches it; backward from the nodes
    that got their own, those of the same mark that reach them are a component. What
    is left between nodes of one mark goes on, without nodes that lack an edge in or
    out. Rounds are bounded by path lengths; the driver sees counts.
    """
    edges, done = _trimmed(edges.where("src != dst").select("src", "dst").distinct()), None
    while edges.limit(1).count():
        marks = checkpoint(edges.select(F.col("src").alias("id")).distinct().withColumn("mark", F.col("id")))
        while True:
            least = edges.join(marks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("mark").alias("least"))
            now = checkpoint(marks.join(least, "id").select("id", F.least("mark", "least").alias("mark"), (F.col("least") < F.col("mark")).alias("changed")))
            marks = now.select("id", "mark")
            if not _changes(now):
                break
        side = lambda c: marks.select(F.col("id").alias(c), F.col("mark").alias(f"{c}_mark"))  # noqa: B023, E731
        inner = checkpoint(edges.join(side("src"), "src").join(side("dst"), "dst").where("src_mark = dst_mark").select("src", "dst"))
        back = checkpoint(marks.where("id = mark").select("id"))
        fresh = back
        while fresh.limit(1).count():
            fresh = checkpoint(inner.join(fresh.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(back, "id", "left_anti"))
            back = checkpoint(back.union(fresh))
        found = back.join(marks, "id").select("id", F.col("mark").alias("component"))
        done = found if done is None else done.union(found)
        left = lambda c: back.withColumnRenamed("id", c)  # noqa: B023, E731
        edges = _trimmed(inner.join(left("src"), "src", "left_anti").join(left("dst"), "dst", "left_anti"))
    if done is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"))
    several = done.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done.join(several, "component", "left_semi").select("id", "component")
