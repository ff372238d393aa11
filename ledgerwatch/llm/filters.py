"""Audit of how filters interact, by counting paths through the lattice of their subsets.

An order in which filters are applied is a path from the empty set to the full one;
each of its steps is an edge, from the set of filters applied so far to that set
with one more. Counting forward gives the orders that reach a set, counting
backward those that leave it, and their product the orders that use an edge. What
an edge removes (documents that pass all filters of the set and fail the new one)
is found once for each edge, from counts of documents by the set of filters that
they fail. An edge's removals weighted by the orders through it are a filter's
Shapley value over all orders; the steps of every order are read from the same
edges.

Documents are counted by part and set of failures before anything else happens, so
what meets the edges is a row for each part and set, 2**n a part at most.

Nulls and edge cases: a null text counts as empty (it fails A alone); a null source
is the empty string's part; rows that agree in all columns are documents of their
own; of rows of one text those of the least doc_id pass E, all of them if several
share that id; null doc_ids are larger than all others, and equal to one another; a
document without labels is neither good nor toxic, one with several rows of labels
is what any of them says; texts of any length are taken whole; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, words

FILTERS = "ABCDE"
#: Tasks that share the rows of one text.
SALTS = 16
#: A text of fewer words fails A; one with a smaller percentage of distinct words fails B; one with a larger percentage of capitals fails C.
LEAST_WORDS, DISTINCT, CAPITALS = 200, 50, 2
#: A text with any of these characters fails D.
MARKS = "[#$%&*|]"
#: All orders are listed for so many filters at most.
MOST_FILTERS = 6


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, bit, paths) for each edge of the lattice of subsets of n filters: the set before, the filter added, the orders through the edge."""
    full, bits = 2**n - 1, [1 << k for k in range(n)]
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(1, full + 1):
        reach[state] = sum(reach[state ^ b] for b in bits if state & b)
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | b] for b in bits if not state & b)
    return [(state, b, reach[state] * leave[state | b]) for state in range(full + 1) for b in bits if not state & b]


def orders(names: str) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, state, bit): the edges of every order, one a step."""
    return [("".join(order), k + 1, sum(1 << names.index(x) for x in order[:k]), 1 << names.index(x)) for order in permutations(names) for k, x in enumerate(order)]


def edge_flows(rows: DataFrame, n: int, measures: Sequence[str] = ()) -> DataFrame:
    """(part, state, bit, paths, kept, removed, fails, unique_fails, and for each measure what is lost of it) of `rows(part, failed, ...)`; `failed` has a bit for each filter failed."""
    each = rows.groupBy("part", "failed").agg(F.count("*").alias("rows"), *[F.sum(F.col(m).cast("long")).alias(m) for m in measures])
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(p).cast("long").alias("paths")) for s, b, p in lattice(n)]))
    met = each.withColumn("e", edge).select("*", "e.*")
    failed, state, bit = F.col("failed"), F.col("state"), F.col("bit")
    here = (failed.bitwiseAND(state) == 0) & (failed.bitwiseAND(bit) != 0)
    total = lambda on, name, value="rows": F.sum(F.when(on, F.col(value)).otherwise(0)).alias(name)
    return met.groupBy("part", "state", "bit", "paths").agg(
        total(failed.bitwiseAND(state.bitwiseOR(bit)) == 0, "kept"), total(here, "removed"), total(failed.bitwiseAND(bit) != 0, "fails"), total(failed == bit, "unique_fails"), *[total(here, f"{m}_lost", m) for m in measures]
    )


def audit(rows: DataFrame, names: str = FILTERS, measures: Sequence[str] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <measure>_lost..., shapley): every step of every order of the filters `names`, for each part."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"orders of more than {MOST_FILTERS} filters are too many to list")
    flows = edge_flows(rows, len(names), measures)
    values = flows.groupBy("part", "bit").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    steps = rows.sparkSession.createDataFrame(orders(names), "filter_order string, step int, state int, bit int")
    every = flows.join(F.broadcast(steps), ["state", "bit"]).join(values, ["part", "bit"])  # steps: a constant number of rows, 4,320 at most
    return every.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{m}_lost" for m in measures], "shapley")


def _repeats(docs: DataFrame) -> DataFrame:
    """(one, two, salt, first): the least doc_id of every text that occurs more than once, for each salt its rows have."""
    parts = docs.groupBy("one", "two", "salt").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    whole = parts.groupBy("one", "two").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    return whole.select("one", "two", "first", F.explode("salts").alias("salt"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed): the filters that each document fails, A to E from the lowest bit on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    # texts are told apart by 128 bits; the rows of a text that is everywhere are dealt out by their ids
    hashed = hashed.withColumns({"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(11), "text"), "salt": F.pmod(F.hash("doc_id"), F.lit(SALTS)), "words": words(F.col("text"))})
    n, apart = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    checks = [n < LEAST_WORDS, 100 * apart < DISTINCT * n, 100 * capitals > CAPITALS * F.length("text"), F.col("text").rlike(MARKS)]
    own = _bits(checks)
    facts = hashed.select("doc_id", "part", "one", "two", "salt", own.alias("failed"))
    again = facts.join(_repeats(hashed.select("doc_id", "one", "two", "salt")), ["one", "two", "salt"], "left")
    later = F.coalesce((F.col("first") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    return again.select("doc_id", "part", (F.col("failed") + F.when(later, 1 << len(checks)).otherwise(0)).alias("failed"))


def _bits(checks: list[Column]) -> Column:
    return sum((F.when(on, 1 << k).otherwise(0) for k, on in enumerate(checks)), F.lit(0))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with booleans good and toxic from `labels(doc_id, quality, toxic)`."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = rows.join(said, "doc_id", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)).cast("int") for c in ("good", "toxic")})


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(failures(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))
    return audit(rows, FILTERS, ["good", "toxic"])


ORACLE = f"""
WITH said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
texts AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(good, FALSE) AS good, coalesce(s.toxic, FALSE) AS toxic,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, min(d.doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents d LEFT JOIN said s ON s.doc_id = d.doc_id),
failed AS (
  SELECT part, good, toxic, [len(words) < {LEAST_WORDS}, 100 * len(list_distinct(words)) < {DISTINCT} * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITALS} * length(text), regexp_matches(text, '{MARKS}'), first < doc_id] AS f FROM texts),
kinds AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, f),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
every AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM one a JOIN one b ON b.k <> a.k JOIN one c ON c.k NOT IN (a.k, b.k) JOIN one d ON d.k NOT IN (a.k, b.k, c.k) JOIN one e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
steps AS (SELECT array_to_string(list_transform(o, lambda x: substr('{FILTERS}', x, 1)), '') AS filter_order, k AS step, o[:k - 1] AS before, o[k] AS now FROM every, one),
counted AS (
  SELECT part, filter_order, step, now,
    coalesce(sum(n) FILTER (NOT gone AND NOT f[now]), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND f[now]), 0) AS removed, coalesce(sum(n) FILTER (gone AND f[now]), 0) AS redundant,
    coalesce(sum(n) FILTER (f[now] AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND f[now]), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND f[now]), 0) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda x: f[x])) > 0 AS gone FROM kinds, steps) GROUP BY part, filter_order, step, now)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, now) AS BIGINT) AS shapley
FROM counted
"""
