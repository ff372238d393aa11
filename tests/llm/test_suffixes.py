"""Suffix arrays, anchors and the removal of repeats against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import suffixes


def plain(rows, window):
    """For each (doc_id, text) row: (bytes, removed spans, kept bytes)."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    found = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(d) if end < 0 else end
            spans.append((at, end))
            at = end
        found.append((len(d), tuple(spans), bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return found


def result(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["n_bytes"], tuple(map(tuple, r["removed"])), bytes(r["kept"])) for r in df.collect())


def expected(rows, window):
    return sorted((d if d is not None else -99, *x) for (d, _), x in zip(rows, plain(rows, window), strict=True))


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"banana", b"mississippi", b"abab" * 20, bytes([255, 0, 255, 0, 0]), b"ba" * 7 + b"c"])
def test_suffix_array_of_small_texts(text):
    assert suffixes.suffix_array(text, len(text) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_random_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randrange(200)))
        assert suffixes.suffix_array(text, 300).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_to_a_depth():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(3000)) * 3
    order = suffixes.suffix_array(text, 40).tolist()
    assert sorted(order) == list(range(len(text)))
    assert all(text[a : a + 40] <= text[b : b + 40] for a, b in zip(order, order[1:], strict=False))


def test_common_prefixes():
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab\x00") for _ in range(60)) * 4
    a, b = np.array([0, 3, 60, 7, 10]), np.array([60, 63, 0, 8, 11])
    plain = [next((k for k in range(40) if text[x + k] != text[y + k]), 40) for x, y in zip(a, b, strict=True)]
    assert suffixes.common_prefixes(text, a, b, 40).tolist() == plain


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    block = bytes(rng.choice(b"abcdefgh ") for _ in range(700))
    one, two = b"x" * 37 + block + b"yy", bytes(rng.choice(b"pqr") for _ in range(501)) + block
    found = []
    for text in (one, two):
        first, size, anchor, key = suffixes.runs_of(np.frombuffer(text, np.uint8), np.full(len(text), len(text)), 400)
        assert size.sum() == len(text) - 399
        at = text.index(block)
        found.append({int(p) - at: (int(f + a) - at, int(k)) for f, s, a, k in zip(first, size, anchor, key, strict=True) for p in range(f, f + s) if 0 <= p - at <= 300})
    assert found[0] == found[1] and len(found[0]) == 301


def test_pieces_hold_every_window_once():
    rng = random.Random(7)
    part = bytes(rng.choice(b"abc") for _ in range(520))
    for anchor in (0, 5, 120, 150, 272):
        for width in (32, 1):
            seen = []
            for first, tile, shared, piece in suffixes.pieces_of(part, anchor, width, 400):
                n = len(piece) - 399
                assert 1 <= n <= width and len(shared) == 401 - width and shared in piece
                assert all((anchor - j) // width == tile for j in range(first, first + n))
                seen += range(first, first + n)
            assert sorted(seen) == list(range(min(121, anchor + 1)))


def texts(seed, n=60):
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choice("abcdefé \n") for _ in range(k))
    shared = [fresh(rng.randrange(20, 120)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else fresh(rng.randrange(0, 60)) for _ in range(rng.randrange(0, 7))]
        rows.append((k if rng.random() < 0.95 else None, "".join(parts)))
    return rows + rows[:4] + [(900, "a" * 500), (901, None), (902, ""), (903, "ab" * 90), (904, "short")]


@pytest.mark.parametrize("seed", range(2))
def test_repeats_against_brute_force(docs, seed, monkeypatch):
    rows = texts(seed)
    table = docs(*rows).withColumns({c: F.lit(5) for c in ("node", "mark", "key", "removed", "spans", "at")})
    assert result(suffixes.without_repeats(table, 32)) == expected(rows, 32)
    monkeypatch.setattr(suffixes, "CHUNK", 128)  # long texts in pieces, strings in chunks
    monkeypatch.setattr(suffixes, "GROUP", 3)  # busy anchors
    monkeypatch.setattr(suffixes, "FINER", (4, 1))
    assert result(suffixes.without_repeats(table, 32)) == expected(rows, 32)


def test_a_passage_in_ever_other_surroundings(docs):
    rng = random.Random(8)
    fresh = lambda k: "".join(rng.choice("abcdefgh ijklmnop") for _ in range(k))
    passage = fresh(450)
    rows = [(k, fresh(rng.randrange(500)) + passage + fresh(rng.randrange(500))) for k in range(300)]
    assert result(suffixes.without_repeats(docs(*rows))) == expected(rows, 400)


def test_documents_with_the_given_window(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    found = {r["doc_id"]: r for r in suffixes.op12_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    for (doc_id, _), (n, spans, kept) in zip(rows, plain(rows, 400), strict=True):
        r = found[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert suffixes.without_repeats(table.limit(0)).count() == 0
