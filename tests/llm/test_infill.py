"""Fill-in-middle against a plain version over code points, and offsets against a full table."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import infill

ALPHABET = "abcXYZ 0,\néİ́中文\U0001f600\U0001f469<>PSM"


def plain(text, key, seed=1):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed", range(4))
def test_offsets_against_a_full_table(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 400)))
    index = infill.Exceptions.of(np.frombuffer(text.encode(), np.uint8))
    assert len(index.places) == sum(ord(c) > 127 for c in text)
    at = 0
    for place, c in enumerate(text + "."):
        assert index.bytes_at(place) == at and index.place_at(at) == place
        at += len(c.encode())


def test_ascii_texts_have_no_exceptions():
    index = infill.Exceptions.of(np.frombuffer(b"only ascii here", np.uint8))
    assert not len(index.places) and index.bytes_at(7) == 7 == index.place_at(7)


def test_rewrite_against_a_plain_version():
    rng = random.Random(9)
    for k in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60)))
        made = infill.rewrite(text, str(k))
        assert made == plain(text, str(k))
        assert infill.restore(made[4], made[1]) == text


def test_infill_of_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "hello there"), (5, "word é" * 40000), (6, "has <M> inside"), (-7, "\U0001f600" * 9), (8, "a" * 50000), (9, "\x00\r\n")]
    table = docs(*rows).withColumns({"output": F.lit(1), "n": F.lit("x"), "kept": F.lit(2)})
    found = infill.restored(infill.infill(table)).collect()
    assert len(found) == len(rows) and all(r["kept"] == 2 for r in found)
    by = {(r["doc_id"], r["text"]): tuple(r[c] for c in infill.RESULTS) for r in found}
    for doc_id, text in rows:
        assert by[doc_id, text or ""] == plain(text or "", "" if doc_id is None else str(doc_id))
    assert infill.infill(table.limit(0)).count() == 0


def test_shares_of_forms(spark):
    made = infill.infill(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text")))
    forms = {r["form"]: r["count"] / 4000 for r in made.groupBy("form").count().collect()}
    assert abs(forms["plain"] - 0.1) < 0.02 and abs(forms["spm"] - 0.18) < 0.03
