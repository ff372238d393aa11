"""Removal of repeated byte strings by suffix arrays sorted in two stages.

Every byte goes that lies in a string of `window` bytes which starts anywhere else
too. Suffix arrays decide which strings repeat: within a task, the suffixes that are
smaller than their successors are sorted directly, all others are induced from these
by one scan over the buckets of first bytes, and the common prefixes of neighbours
tell which starts share `window` bytes with another.

What shares a task is found by anchors. Of the grams of a window the one with the
least hash, the leftmost of equal ones, is its anchor, so equal windows have equal
anchors at the same place, wherever they stand. Neighbouring windows with one anchor
are a run. Runs whose anchor occurs nowhere else hold no repeat and are dropped, which
is all of them but a few; of the others each distinct string is sorted once, with the
number of its places, together with all strings of the same anchor (a string at
several places without any such company is repeated as a whole). An anchor with
more than `GROUP` distinct strings (a passage that is everywhere, in ever other
surroundings) has its runs cut at fixed distances from the anchor, first into `FINER`
windows and in the end into single ones, and the pieces are dealt out by the hash of
the bytes that all windows of the piece hold; pieces that stand alone are dropped
again. So no task ever holds more than a bounded number of strings, none of them
longer than 2 * window, and no pairs are formed.

The runs are kept as a table in the folder that spark.checkpoint.dir names; the texts
are shuffled twice, once to fetch the distinct strings and once to cut.

Nulls and edge cases: a null text counts as empty; texts shorter than the window stay
as they are; rows that agree in doc_id and text are documents of their own, so each is
the other's repeat; matches never cross documents; a text may repeat within itself,
overlapping or not; a cut may fall inside a character, so what is kept are bytes;
texts of any length are worked on whole, in pieces that overlap; a null doc_id is an id
like others; columns named like the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, whole_groups

#: Bytes that a repeat has at least.
WINDOW = 400
#: Distinct strings of one anchor that are sorted together, and how many windows the pieces have of anchors with more.
GROUP, FINER = 256, (32, 1)
#: Bytes that are hashed, or sorted, at a time.
CHUNK = 1 << 18
#: Tasks that share the places of one anchor or string.
SALTS = 16
#: Bits of a number that hold a place within a chunk.
PLACE = 20
RESULTS = ("n_bytes", "removed", "kept")
ODD = 0x9E3779B97F4A7C15


# --- anchors ---------------------------------------------------------------------------


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd base and of its inverse modulo 2**64."""
    table = np.random.default_rng(12).integers(0, 2**63, 256, dtype=np.uint64)

    def of(base: int) -> np.ndarray:
        found = np.full(1 << PLACE, base, np.uint64)
        found[0] = 1
        return np.cumprod(found)

    return table, of(ODD), of(pow(ODD, -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _grams(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each byte on, the same wherever they stand."""
    table, power, inverse = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * power[: len(raw)])])
    return _mixed((sums[size:] - sums[:-size]) * inverse[: len(raw) - size + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def gram_size(window: int) -> int:
    return max(1, window * 8 // 25)


def runs_of(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, anchor, key) of the runs of some texts one after the other; `ends` has each byte's end of text, `anchor` counts from `first`."""
    gram = gram_size(window)
    grams = _grams(raw, gram)
    here = np.arange(len(grams), dtype=np.uint64)
    # equal hashes differ in their places alone, so the leftmost is the least
    least = _least((grams >> np.uint64(PLACE) << np.uint64(PLACE)) | here, window - gram + 1)
    at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    whole = np.flatnonzero(np.arange(len(at)) + window <= ends[: len(at)])
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    anchor = at[whole]
    begins = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)])
    first, size = whole[begins], np.diff(np.append(np.flatnonzero(begins), len(whole)))
    return first, size, anchor[begins] - first, grams[anchor[begins]].view(np.int64)


def _pieces(batch: pd.DataFrame, window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, start, bytes) with about CHUNK bytes each; a long text is cut so that each of its windows is in one piece."""
    held, size = [], 0
    for row, text in enumerate(batch["text"]):
        data = (text or "").encode()
        for start in range(0, len(data) - window + 1, CHUNK):
            piece = data[start : start + CHUNK + window - 1]
            held.append((row, start, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _described(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for held in _pieces(batch, window):
                data = b"".join(piece for *_, piece in held)
                sizes = np.array([len(piece) for *_, piece in held])
                ends = np.cumsum(sizes)
                first, size, anchor, key = runs_of(np.frombuffer(data, np.uint8), np.repeat(ends, sizes), window)
                piece = np.searchsorted(ends, first, side="right")
                rows, starts = np.array([r for r, *_ in held])[piece], np.array([s for _, s, _ in held])[piece]
                ctx = np.array([xxh3_64_intdigest(data[f : f + n + window - 1]) for f, n in zip(first.tolist(), size.tolist(), strict=True)], np.uint64).view(np.int64)
                ids = {c: batch[c].to_numpy()[rows] for c in ("node", "mark")}
                yield pd.DataFrame(ids | {"key": key, "ctx": ctx, "lo": starts + first - (ends - sizes)[piece], "size": size, "anchor": anchor})

    return run


# --- suffix arrays ---------------------------------------------------------------------


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """The starts of all suffixes of `text` in the order of their first `depth` bytes, in two stages.

    A suffix that is smaller than its successor is sorted directly. Each other one
    comes after its successor, so a scan from the smallest suffix on meets the
    successor first, and puts it at the front of what is left of its bucket, that is
    of the suffixes with its first byte; the directly sorted ones fill the backs.
    """
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    steps = np.diff(raw.astype(np.int16))
    turns = np.flatnonzero(steps)
    turn = np.searchsorted(turns, np.arange(n))
    rising = np.zeros(n, bool)
    rising[turn < len(turns)] = steps[turns[turn[turn < len(turns)]]] > 0
    direct = sorted(np.flatnonzero(rising).tolist(), key=lambda i: text[i : i + depth])
    ends = np.cumsum(np.bincount(raw, minlength=256))
    fronts = [0, *ends[:-1].tolist()]
    found = np.full(n, -1, np.int64)
    heads = raw[direct]
    # the place of each directly sorted suffix: as far from its bucket's end as from the end of those of its bucket
    found[ends[heads] - np.cumsum(np.bincount(heads, minlength=256))[heads] + np.arange(len(direct))] = direct
    order, larger = found.tolist(), (~rising).tolist()
    if n:
        order[fronts[text[-1]]] = n - 1  # its successor is the empty suffix, the smallest of all
        fronts[text[-1]] += 1
    for k in range(n):
        i = order[k] - 1
        if i >= 0 and larger[i]:
            bucket = text[i]
            order[fronts[bucket]] = i
            fronts[bucket] += 1
    return np.array(order, np.int64)


def common_prefixes(text: bytes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at `a` and `b` share, `most` at most; both have that many."""
    padded = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
    words = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    found, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, most, 8):
        apart = words[np.minimum(a[live] + at, len(text))] ^ words[np.minimum(b[live] + at, len(text))]
        found[live] += sum((apart < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(8))
        live = live[apart == 0]
        if not len(live):
            break
    return np.minimum(found, most)


def repeated_starts(parts: list[bytes], counts: list[int], window: int) -> list[np.ndarray]:
    """For each string, which of its windows occur in another one or elsewhere in it, which is all of them if it has several places (`counts`)."""
    text = b"".join(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    inside, repeated = np.zeros(len(text), bool), np.zeros(len(text), bool)
    for s, e, n in zip(starts[:-1], starts[1:], counts, strict=True):
        inside[s : max(s, e - window + 1)] = True
        repeated[s:e] = n > 1
    order = suffix_array(text, window)
    order = order[inside[order]]
    same = common_prefixes(text, order[:-1], order[1:], window) >= window
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    return [repeated[s : max(s, e - window + 1)] for s, e in zip(starts[:-1], starts[1:], strict=True)]


def _sorted(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["key"], 1024):
            ends = rows["part"].map(len).cumsum()
            # whole groups, with about CHUNK bytes at a time
            chunk = ends.groupby(rows["key"]).transform("min") // CHUNK
            for _, some in rows.groupby(chunk.to_numpy(), sort=False):
                found = []
                parts = [bytes(p) for p in some["part"]]
                for key, ctx, marks in zip(some["key"], some["ctx"], repeated_starts(parts, some["n"].tolist(), window), strict=True):
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
                    found += [(key, ctx, s, e - s) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                yield pd.DataFrame(found, columns=["key", "ctx", "first", "many"])

    return run


# --- busy anchors ----------------------------------------------------------------------


def pieces_of(part: bytes, anchor: int, width: int, window: int) -> list[tuple[int, int, bytes, bytes]]:
    """(first, distance, shared, piece): the windows of a run in pieces of `width` by their distance to the anchor, with the bytes that all windows of such a piece hold."""
    found, n = [], len(part) - window + 1
    for tile in range(max(0, anchor - n + 1) // width, anchor // width + 1):
        latest = anchor - tile * width
        earliest = latest - width + 1
        first, last = max(0, earliest), min(n - 1, latest)
        found.append((first, tile, part[latest : earliest + window], part[first : last + window]))
    return found


def _finer(width: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        signed = lambda data, seed: int(np.uint64(xxh3_64_intdigest(data, seed)).view(np.int64))
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = []
                for key, ctx, n, anchor, part in batch.iloc[at : at + 256][["key", "ctx", "n", "anchor", "part"]].itertuples(index=False):
                    for first, tile, shared, piece in pieces_of(bytes(part), anchor, width, window):
                        found.append((key, ctx, first, signed(shared, (key + tile) % 2**64), signed(piece, tile), n, anchor - first, len(piece) - window + 1, piece if width > 1 else b""))
                yield pd.DataFrame(found, columns=["of_key", "of_ctx", "start", "key", "ctx", "n", "anchor", "size", "part"])

    return run


def _totals(rows: DataFrame) -> DataFrame:
    """(key, salt, strings): how many rows each key has whose `n` are several places together; a key that is everywhere is counted and looked up in parts."""
    parts = rows.groupBy("key", "salt").agg(F.count("*").alias("strings"), F.sum("n").alias("total"))
    whole = parts.groupBy("key").agg(F.sum("strings").alias("strings"), F.sum("total").alias("total"), F.collect_set("salt").alias("salts")).where("total > 1")
    return whole.select("key", "strings", F.explode("salts").alias("salt"))


def _sized(strings: DataFrame) -> DataFrame:
    """Distinct strings (key, ctx, n, ...) with `strings`, how many share their key; those that are alone at one place are dropped."""
    strings = strings.withColumn("salt", F.pmod("ctx", F.lit(SALTS)))
    return strings.join(_totals(strings), ["key", "salt"]).drop("salt")


def _alone(sized: DataFrame) -> DataFrame:
    """(key, ctx, first, many) of strings at several places that no other shares an anchor with: there is nothing to sort them with."""
    return sized.where("strings = 1").select("key", "ctx", F.lit(0).alias("first"), F.col("size").alias("many"))


def _marks(sized: DataFrame, window: int, widths: tuple[int, ...]) -> DataFrame:
    """(key, ctx, first, many): the repeated windows of distinct strings (key, ctx, n, anchor, size, strings, part) that share their key with others."""
    few = sized.where(F.col("strings") <= GROUP).select("key", "ctx", "n", "part")
    found = few.repartition("key").sortWithinPartitions("key").mapInPandas(_sorted(window), schema="key long, ctx long, first int, many int")
    many = sized.where(F.col("strings") > GROUP)
    if not many.limit(1).count():
        return found
    width = widths[0]
    schema = "of_key long, of_ctx long, start int, key long, ctx long, n long, anchor int, size int, part binary"
    finer = stored(many.select("key", "ctx", "n", "anchor", "part").mapInPandas(_finer(width, window), schema=schema))
    if width > 1:
        distinct = finer.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.first("anchor").alias("anchor"), F.first("size").alias("size"), F.first("part").alias("part"))
        distinct = stored(_sized(distinct))
        inner = _alone(distinct).union(_marks(distinct.where("strings > 1"), window, widths[1:]))
    else:
        # a single window needs no sorting
        inner = finer.groupBy("key", "ctx").agg(F.sum("n").alias("n")).where("n > 1").select("key", "ctx", F.lit(0).alias("first"), F.lit(1).alias("many"))
    places = finer.select("of_key", "of_ctx", "start", "key", "ctx")
    outer = places.join(inner, ["key", "ctx"]).select(F.col("of_key").alias("key"), F.col("of_ctx").alias("ctx"), (F.col("start") + F.col("first")).alias("first"), "many")
    return found.union(outer)


# --- documents -------------------------------------------------------------------------


def _named(docs: DataFrame) -> DataFrame:
    """(node, mark, text): 128 bits for each doc_id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("node"), F.xxhash64("text").alias("mark"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(node, mark, spans array<struct<start, end>>): where each document that has any holds bytes of repeats, in order, without overlaps; `node` and `mark` are hashes of doc_id and text, and of the text."""
    named = _named(docs).where(F.octet_length("text") >= window)
    runs = stored(named.mapInPandas(_described(window), schema="node long, mark long, key long, ctx long, lo int, size int, anchor int"))
    runs = runs.withColumn("salt", F.pmod(F.hash("node", "lo"), F.lit(SALTS)))
    shared = stored(runs.join(_totals(runs.withColumn("n", F.lit(1))), ["key", "salt"]).select("node", "mark", "key", "ctx", "lo", "size", "anchor", "salt"))
    place = F.min(F.struct("node", "mark", "lo", "size", "anchor")).alias("at")
    parts = shared.groupBy("key", "ctx", "salt").agg(F.count("*").alias("n"), place)
    strings = parts.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.collect_set("salt").alias("salts")).select("key", "ctx", "n", "salts", "at.*")
    sized = stored(_sized(strings))
    part = F.substring("raw", F.col("lo") + 1, F.col("size") + (window - 1)).alias("part")
    fetched = sized.where("strings > 1").join(named.select("node", "mark", F.col("text").cast("binary").alias("raw")), ["node", "mark"])
    # rows of one text and id fetch a string more than once
    fetched = stored(fetched.select("key", "ctx", "n", "anchor", "size", "strings", part).dropDuplicates(["key", "ctx"]))
    marks = _alone(sized).union(_marks(fetched, window, FINER))
    # a row for each string before places are looked up, however many pieces it was cut into
    marks = marks.groupBy("key", "ctx").agg(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("many") + (window - 1)).alias("end"))).alias("found"))
    marks = marks.select("key", "ctx", _joined(F.array_sort("found")).alias("found"))
    dealt = sized.select("key", "ctx", F.explode("salts").alias("salt"))
    placed = marks.join(dealt, ["key", "ctx"]).join(shared, ["key", "ctx", "salt"])
    moved = F.transform("found", lambda s: F.struct((F.col("lo") + s["start"]).alias("start"), (F.col("lo") + s["end"]).alias("end")))
    spans = placed.select("node", "mark", moved.alias("found")).groupBy("node", "mark").agg(F.flatten(F.collect_set("found")).alias("spans"))
    return spans.select("node", "mark", _joined(F.array_sort("spans")).alias("spans"))


def _joined(spans):
    """Ordered spans with those joined that overlap or touch."""
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(done, s):
        last = F.element_at(done["done"], -1)
        meets = (F.size(done["done"]) > 0) & (s["start"] <= last["end"])
        grown = F.concat(F.slice(done["done"], 1, F.size(done["done"]) - 1), F.array(span(last["start"], F.greatest(last["end"], s["end"]))))
        return F.struct(F.when(meets, grown).otherwise(F.concat(done["done"], F.array(span(s["start"], s["end"])))).alias("done"))

    return F.aggregate(spans, F.struct(none.alias("done")), step, lambda done: done["done"])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_bytes, removed array<struct<start, end>> and kept binary: the bytes of each text without those of repeats."""
    docs = docs.drop(*RESULTS)
    spans = repeated_spans(docs.select("doc_id", "text"), window).toDF("__node", "__mark", "__spans")
    both = docs.join(spans, (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__node")) & (F.xxhash64(docs["text"]) == F.col("__mark")), "left")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    both = both.select(*[docs[c] for c in docs.columns], raw.alias("__raw"), F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))
    removed, n = F.col("removed"), F.octet_length("__raw")
    begin = lambda k: F.when(k > 0, F.get(removed, k - 1)["end"]).otherwise(0)
    stop = lambda k: F.coalesce(F.get(removed, k)["start"], n)
    parts = F.transform(F.sequence(F.lit(0), F.size(removed)), lambda k: F.substring("__raw", begin(k) + 1, stop(k) - begin(k)))
    kept = F.when(F.size(removed) == 0, F.col("__raw")).otherwise(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)))
    return both.select(*docs.columns, n.cast("long").alias("n_bytes"), "removed", kept.alias("kept"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS k, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (SELECT k, start, least(64, n - {WINDOW - 1} - start) AS m, substr(h, 2 * start + 1, {2 * (WINDOW + 63)}) AS piece FROM texts, unnest(range(0, n - {WINDOW - 1}, 64)) AS u(start)),
starts AS (SELECT k, start + o AS p, hash(substr(piece, 2 * o + 1, {2 * WINDOW})) AS w FROM blocks, unnest(range(m)) AS u(o)),
again AS (SELECT k, p FROM starts QUALIFY count(*) OVER (PARTITION BY w) > 1),
runs AS (SELECT k, p, sum(new) OVER (PARTITION BY k ORDER BY p) AS r FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY k ORDER BY p) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT k, min(p) AS a, max(p) + {WINDOW} AS b FROM runs GROUP BY k, r),
gaps AS (SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT k, max(b), NULL FROM spans GROUP BY k),
kept AS (SELECT g.k, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM gaps g JOIN texts USING (k) GROUP BY g.k),
gone AS (SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY k)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, texts.h))) AS kept_sha256
FROM texts LEFT JOIN gone USING (k) LEFT JOIN kept ON kept.k = texts.k
"""
