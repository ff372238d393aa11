"""The filter audit against plain enumeration of every order."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from ledgerwatch.llm import filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_failures(rows):
    """{row number: set of letters failed} of (doc_id, text) rows."""
    first = {}
    for doc_id, text in rows:
        text = text or ""
        if doc_id is not None:
            first[text] = min(first.get(text, doc_id), doc_id)
    found = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        failed = {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        failed |= {"D"} if re.search("[#$%&*|]", text) else set()
        failed |= {"E"} if text in first and (doc_id is None or first[text] < doc_id) else set()
        found.append(failed)
    return found


def plain_audit(failed, names):
    """{(part, order, step): (kept, removed, redundant, unique, good, toxic, shapley)} of (part, letters, good, toxic)."""
    found = {}
    for part in {p for p, *_ in failed}:
        own = [x for x in failed if x[0] == part]
        total = dict.fromkeys(names, 0)
        for order in map("".join, permutations(names)):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                fails = sum(f in x[1] for x in own)
                found[part, order, k + 1] = [len(left), len(gone), fails - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), row in found.items():
            if p == part:
                row.append(total[order[k - 1]])
    return {key: tuple(row) for key, row in found.items()}


def by_step(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_paths_of_the_lattice():
    edges = filters.lattice(5)
    assert len(edges) == 80 and sum(p for *_, p in edges) == 5 * 120
    used = {}
    for _, _, state, bit in filters.orders("ABCDE"):
        used[state, bit] = used.get((state, bit), 0) + 1
    assert used == {(state, bit): p for state, bit, p in edges}


def test_against_every_order(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["red", "Blue", "GREEN", "a", "b"] + [f"w{k}" for k in range(200)])
    texts = ["", None, "A#", "x " * 300, "Éİ   café"]
    texts += [" ".join(word() for _ in range(rng.randrange(150, 400))) + rng.choice(["", "", "%", "\n|"]) for _ in range(30)]
    rows = [(k if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["one", "two", None, ""])) for k in range(150)]
    rows += rows[:7]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 150, 3)] + [(3, 1, 1), (3, 0, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "failed", "words", "one", "salt", "good", "first")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = by_step(filters.audit(filters.labelled(filters.failures(docs), said), "ABCDE", ["good", "toxic"]))
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, t in labels if k is not None and t == 1}
    failed = [(source or "", f, d in good, d in toxic) for (d, _, source), f in zip(rows, plain_failures([(d, t) for d, t, _ in rows]), strict=True)]
    assert found == plain_audit(failed, "ABCDE")
    assert filters.audit(filters.labelled(filters.failures(docs.limit(0)), said), "ABCDE", ["good", "toxic"]).count() == 0


def test_other_filters_and_no_measures(spark):
    rows = spark.createDataFrame([("p", 0), ("p", 3), ("p", 2), ("q", 7)], "part string, failed int")
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filters.audit(rows, "xyz").collect()}
    assert len(found) == 2 * 6 * 3
    assert found["p", "xyz", 1] == (2, 1, 3) and found["p", "xyz", 2] == (1, 1, 9) and found["q", "zyx", 3] == (0, 0, 2)
