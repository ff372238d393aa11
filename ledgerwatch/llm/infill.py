"""Fill-in-middle rewriting of documents, with offsets from a sparse index of exceptions.

A text is cut at token ends into prefix, middle and suffix, and put together again
in the order that a model trained to fill in the middle reads: prefix, suffix,
middle (psm) or suffix, prefix, middle (spm), each behind a marker. Texts that hold
a marker, and a share of all, stay plain. Cuts are drawn from a hash of the id, so
reruns agree.

Cutting works on UTF-8 bytes. Where all characters are ASCII, code points and bytes
are the same number; of all others only the position and the excess bytes are
recorded (`Exceptions`), and a binary search among them converts a cut either way.
A text without such characters has an empty index and its cuts stay arithmetic.

Nulls and edge cases: a null text counts as empty, and an empty one is plain; a null
id counts as an empty one; rows that agree are cut alike; texts of any length are
cut whole; a text that is a single token can have an empty prefix, middle or suffix;
other columns are kept as they are, those named like the results are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of each hundred texts so many are cut, and of those so many put the suffix first.
CUT, SUFFIX_FIRST = 90, 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Exceptions:
    """The characters of a text that take more than one byte: their places in code points, and the excess bytes up to and with each."""

    places: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Exceptions:
        """The index of UTF-8 bytes."""
        heads = np.flatnonzero(raw >= 0xC0)
        lead = raw[heads]
        excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        return cls(heads - np.concatenate([[0], excess[:-1]])[: len(heads)], excess)

    def bytes_at(self, place: int) -> int:
        """The byte at which the code point `place` begins."""
        k = int(np.searchsorted(self.places, place, side="left"))
        return place + (int(self.excess[k - 1]) if k else 0)

    def place_at(self, byte: int) -> int:
        """The code point that begins at `byte`."""
        ends = self.places + self.excess  # the last byte of each exception
        k = int(np.searchsorted(ends, byte, side="left"))
        return byte - (int(self.excess[k - 1]) if k else 0)


def token_starts(raw: np.ndarray) -> np.ndarray:
    """The bytes at which tokens begin: runs of ASCII letters, and every other character on its own."""
    lower = raw | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    begins = ~letter & ((raw & 0xC0) != 0x80)
    begins |= letter & ~np.concatenate([[False], letter[:-1]])
    return np.flatnonzero(begins)


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 for an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rewrite(text: str, key: str, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text: its tokens, and how it was put together."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    starts = token_starts(raw)
    n = len(starts)
    h1, h2, h3, h4 = draws(key, seed)
    if not n or h3 % 100 >= cut or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    ends = np.append(starts, len(raw))  # token k ends where token k + 1 begins
    low, high = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    index = Exceptions.of(raw)
    first, second = index.place_at(low), index.place_at(high)
    prefix, middle, suffix = (data[a:b].decode() for a, b in ((0, low), (low, high), (high, len(data))))
    spm = h4 % 100 < suffix_first
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, "spm" if spm else "psm", first, second - first, output


def restore(output: str, form: str) -> str:
    """The text that was rewritten, from the output and its form alone."""
    if form == "plain":
        return output
    parts = dict.fromkeys((PREFIX, SUFFIX, MIDDLE), "")
    at = [(output.index(m), m) for m in parts]
    at.sort()
    for (start, marker), (stop, _) in zip(at, [*at[1:], (len(output), "")], strict=True):
        parts[marker] = output[start + len(marker) : stop]
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def infill(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`docs` with n, form, prefix_chars, middle_chars and output."""

    @pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def made(text: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = [rewrite(t or "", k, seed, cut, suffix_first) for t, k in zip(text, key, strict=True)]
        found = pd.DataFrame(rows, columns=list(RESULTS))
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.drop(*RESULTS).withColumn("__made", made("text", key)).select(*[c for c in docs.columns if c not in RESULTS], "__made.*")


def restored(rewritten: DataFrame) -> DataFrame:
    """`rewritten` with `text` rebuilt from output and form."""

    @pandas_udf("string")
    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return rewritten.withColumn("text", back("output", "form"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(infill(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def _group(k: int) -> str:
    return f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"


ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, {_group(0)} AS h1, {_group(1)} AS h2, {_group(2)} AS h3, {_group(3)} AS h4 FROM texts),
placed AS (
  SELECT doc_id, text, len(t) AS n, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
    t, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b FROM cut),
parts AS (SELECT *, array_to_string(t[:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
