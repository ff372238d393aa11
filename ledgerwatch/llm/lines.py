"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is a sequence of lines that are not blank. Of every `run` neighbouring
lines the one with the least hash is a fingerprint, so two documents that share a
run of that length are certain to share its fingerprint. Fingerprints that occur
once are dropped. The positions of the others are joined with the first place, in
the order of doc_id and place, of each run of `run` lines that holds them; matches
that go on along the same places of the same two documents are extended both ways
to one repeat. Repeats are deleted where they come later. Blank lines belong to no
run and stay. With `long`, a line of more words than that is a run of its own too,
whatever stands around it.

A line of a run that occurred before is thereby deleted, wherever the first places
of the runs it belongs to are: the longest repeats of all its documents together.
Only hashes travel until the end, when the places to delete meet their texts: lines
are told apart by 96 bits each, and runs by 96 bits made of those. No pairs are
formed: each run looks up its first place. Runs that are everywhere are dealt out
by their documents to `SALTS` tasks each.

Nulls and edge cases: a null text stays null; an empty text has one (blank) line;
a null doc_id comes last in order; rows that agree in doc_id and text are one
document and treated alike; documents of the same doc_id with different texts are
ordered by a hash; a run may overlap its earlier place (a line repeated over and
over keeps one); other columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, words

#: The least number of lines that counts as a repeat.
RUN = 2
#: Tasks that share the places of one fingerprint or run.
SALTS = 16
#: A line of more words than this is a passage, which is a repeat on its own (in the pipeline; the SQL of op8_line_dedup knows runs only).
PASSAGE = 50


def passages(docs: DataFrame, long: int) -> DataFrame:
    """(doc_id, mark, at, key, check, places): each line of more than `long` words, as a run of one."""
    filled = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.trim(s["x"]) != "")
    numbered = F.transform(filled, lambda s, at: F.struct(at.alias("at"), F.xxhash64(s["x"]).alias("key"), F.hash(s["x"]).alias("check"), F.array(s["i"]).alias("places"), s["x"].alias("x")))
    # so many words take twice as many characters at least
    found = F.filter(numbered, lambda s: F.when(F.length(s["x"]) > 2 * long, F.size(words(s["x"])) > long).otherwise(False))
    return docs.where(F.length("text") > 2 * long).select("doc_id", F.xxhash64("text").alias("mark"), F.inline(found)).drop("x")


def repeats(docs: DataFrame, run: int = RUN, long: int | None = None) -> DataFrame:
    """(doc_id, mark, first_doc_id, first_mark, start, first_start, n_lines, places array<int>): each later repeat, extended as far as it goes.

    `mark` is a hash of the text; starts count lines that are not blank, `places` all lines.
    """
    met = _matched(docs, run, long)
    along = Window.partitionBy("doc_id", "mark", "first", "shift").orderBy("at", "width")
    # places of one repeat follow on each other: its runs overlap, or a line of its own lies next to them
    begins = F.coalesce(F.col("at") > F.max(F.col("at") + F.col("width")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    met = met.withColumn("repeat", F.sum(begins.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = met.groupBy("doc_id", "mark", "first", "shift", "repeat").agg(F.min("at").alias("start"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    return whole.select("doc_id", "mark", F.col("first.doc_id").alias("first_doc_id"), F.col("first.mark").alias("first_mark"), "start", (F.col("start") - F.col("shift")).alias("first_start"), F.size("places").alias("n_lines"), "places")


def repeated_lines(docs: DataFrame, run: int = RUN, long: int | None = None) -> DataFrame:
    """(doc_id, mark, gone array<int>): the lines to delete of each document that has any; `mark` is a hash of the text."""
    return repeats(docs, run, long).groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))


def _matched(docs: DataFrame, run: int, long: int | None) -> DataFrame:
    """(doc_id, mark, at, width, places, first struct, shift): every run that has an earlier place, with its first one."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.when(F.trim(x) != "", F.xxhash64(x)).alias("h"), F.hash(x).alias("c"))), lambda s: s["h"].isNotNull())
    hashed = docs.select("doc_id", F.xxhash64("text").alias("mark"), lines.alias("lines")).where(F.size("lines") >= run).dropDuplicates(["doc_id", "mark"])
    last = F.size("lines") - run
    salt = F.pmod(F.hash("doc_id", "mark"), F.lit(SALTS))

    def least(s):
        window = F.slice("lines", s + 1, run)
        return s + F.array_position(F.transform(window, lambda x: x["h"]), F.array_min(F.transform(window, lambda x: x["h"]))).cast("int") - 1

    prints = hashed.withColumn("at", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), last), least))))
    start = F.greatest(F.col("at") - run + 1, F.lit(0))
    # what a run that holds the fingerprint can reach
    prints = prints.select("doc_id", "mark", F.element_at("lines", F.col("at") + 1)["h"].alias("print"), start.alias("start"), F.slice("lines", start + 1, F.col("at") + run - start).alias("near"))
    # a fingerprint that is everywhere is counted and looked up in parts
    prints = prints.withColumn("salt", salt)
    parts = prints.groupBy("print", "salt").count()
    shared = parts.groupBy("print").agg(F.sum("count").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1").select("print", F.explode("salts").alias("salt"))
    near = prints.join(shared, ["print", "salt"])

    def piece(k):
        window = F.slice("near", k + 1, run)
        hashes = F.transform(window, lambda x: x["h"])
        return F.struct((F.col("start") + k).alias("at"), F.xxhash64(hashes).alias("key"), F.hash(F.transform(window, lambda x: x["c"])).alias("check"), F.transform(window, lambda x: x["i"]).alias("places"))

    runs = near.where(F.size("near") >= run).select("doc_id", "mark", F.inline(F.transform(F.sequence(F.lit(0), F.size("near") - run), piece)))
    runs = runs.withColumn("width", F.lit(run))
    if long is not None:
        runs = runs.union(passages(docs, long).withColumn("width", F.lit(1)))
    runs = runs.dropDuplicates(["doc_id", "mark", "at", "width"])
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "at")
    # a run that is everywhere is counted and looked up in parts
    runs = runs.withColumn("salt", salt)
    parts = runs.groupBy("width", "key", "check", "salt").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = parts.groupBy("width", "key", "check").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    again = runs.join(first.select("width", "key", "check", "first", F.explode("salts").alias("salt")), ["width", "key", "check", "salt"]).where(place != F.col("first"))
    again = again.select("doc_id", "mark", "at", "width", "places", F.struct("first.last", "first.doc_id", "first.mark").alias("first"), (F.col("at") - F.col("first.at")).alias("shift"))
    return again.repartition("doc_id", "mark")


def without_repeats(docs: DataFrame, run: int = RUN, long: int | None = None) -> DataFrame:
    """`docs` with later repeats deleted from `text`, and n_lines, n_deleted (in place of columns so named); with `long`, also single lines of more words."""
    docs = docs.drop("n_lines", "n_deleted")
    gone = repeated_lines(docs, run, long).toDF("__doc", "__mark", "__gone")
    both = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__doc"]) & (F.xxhash64(docs["text"]) == gone["__mark"]), "left")
    lines = F.split(docs["text"], "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    columns = [text.alias(c) if c == "text" else docs[c] for c in docs.columns]
    return both.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS spot FROM lines WHERE trim(line, ' ') <> ''),
runs AS (
  SELECT doc_id, spot, list(line) OVER w AS held, list(i) OVER w AS places FROM filled
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)),
again AS (
  SELECT doc_id, places FROM runs WHERE len(held) = {RUN}
  QUALIFY row_number() OVER (PARTITION BY held ORDER BY doc_id, spot) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(places) AS i FROM again),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_deleted
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
