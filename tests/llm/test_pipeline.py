import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerwatch.llm import language

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("12345 !!").alias("text"), "lang", "source", F.lit(8).cast("long").alias("n_chars"))
    first = docs.orderBy("doc_id").limit(1)
    copy = first.select(F.lit(10**9).cast("long").alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"), "lang", "source", "n_chars")
    columns = docs.columns
    kept = P.keep_known_languages(spark, docs.union(junk).union(copy), SF)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and -1 not in ids and len(ids) >= docs.count()
    single = P.keep_one_of_similar(spark, docs.union(copy), SF)
    assert single.columns == columns and 10**9 not in {r["doc_id"] for r in single.collect()}
    cleaned = P.drop_repeated_lines(spark, docs, SF)
    assert cleaned.columns == columns and cleaned.where("n_chars != length(text)").count() == 0
    mixed = P.mix_sources(spark, docs, SF)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0


def test_run(spark):
    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and rows.where("size(ids) != n_tokens").count() == 0 and rows.count() > 0
    assert [name for name, _ in P.STAGES][0] == "language ID" and len(P.STAGES) == 5


def test_single_long_lines_go(spark, docs):
    said = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = docs((1, f"a\n{said(51)}\nb"), (2, f"c\n\n{said(51)}\nd"), (3, said(51)), (4, said(50)), (5, said(50)), (None, f"{said(51)}\ne"))
    found = {r["doc_id"]: r["text"] for r in P.drop_repeated_lines(spark, rows, SF).collect()}
    assert found == {1: f"a\n{said(51)}\nb", 2: "c\n\nd", 4: said(50), 5: said(50), None: "e"}


def test_one_of_each_group_whatever_its_doc_ids(spark, docs):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = docs((None, text("a")), (None, text("a")), (None, text("b")), (None, text("c") + " tail"), (1, text("c")), (2, text("d")), (2, text("e")), (3, text("e") + " tail"), (4, None), (4, None), (None, text("f")), (None, text("f") + " tail"))
    found = [(r["doc_id"], r["text"]) for r in P.keep_one_of_similar(spark, rows, SF).collect()]
    assert len([x for x in found if x[1] and x[1].startswith("f")]) == 1
    rest = [x for x in found if not (x[1] and x[1].startswith("f"))]
    assert sorted(rest, key=str) == sorted([(None, text("a")), (None, text("b")), (1, text("c")), (2, text("d")), (2, text("e")), (4, None), (4, None)], key=str)


def test_unlearned_languages_and_noise_go(spark, docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    planted = [" ".join(word() for _ in range(80)) for _ in range(5)] + ["это текст на русском языке " * 9, "これは日本語の文章です" * 10, "ฉันรักภาษาไทย " * 10, "Ελληνικά κείμενο για δοκιμή " * 9]
    known = spark.read.parquet(f"{SF}/documents.parquet")
    rows = known.union(docs(*[(5 * 10**6 + k, x, None) for k, x in enumerate(planted)]).select(known.columns))
    kept = {r["doc_id"] for r in P.keep_known_languages(spark, rows, SF).collect()}
    assert not [k for k in kept if k >= 5 * 10**6]
    held = {r["doc_id"] for r in known.where(language.held_out()).where("text is not null").collect()}
    assert len(held - kept) <= language.LOST * len(held)


def test_low_quantiles_of_few_and_many():
    rng = np.random.default_rng(2)
    score = lambda n: 1 / (1 + np.exp(-(2 + rng.exponential(1, n) * 0.5)))
    many = language.low_quantile(score(100_000), 0.001)
    assert many == pytest.approx(1 / (1 + np.exp(-2)), abs=0.01)
    tail = [language.low_quantile(1 / (1 + np.exp(rng.exponential(0.5, 200) - 4)), 0.001) for _ in range(50)]
    assert np.mean(1 / (1 + np.exp(np.log(1000) * 0.5 - 4)) - tail) == pytest.approx(0, abs=0.1)
    assert language.low_quantile(np.zeros(0), 0.001) == 0


def test_odd_rows_in_every_stage(spark, docs):
    long = "many words of one text follow on each other here " * 6000
    rows = [(None, "plain words of a text that no one else has written so far", "en", None), (1, None), (2, ""), (3, "a"), (3, "a"), (4, "\n\n"), (5, long), (6, "é😀\t\x0b ok"), (7, "some text here\nand there", None, None)]
    odd = docs(*rows).withColumns({c: F.lit(7) for c in ("node", "bands", "gone", "key", "copies", "target", "lang_pred", "__n")})
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    found = {name: stage(spark, odd, SF) for name, stage in P.STAGES}
    assert all(df.columns == columns for df in list(found.values())[:-1])
    ids = {name: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str) for name, df in found.items()}
    # no letter, no language; the one repeated row is a copy; a document without words counts for nothing and is kept
    assert not {1, 2, 4} & set(ids["language ID"])
    assert ids["line dedup"] == sorted([None, 1, 2, 3, 3, 4, 5, 6, 7], key=str) and ids["n-gram Jaccard join"] == sorted([None, 1, 2, 3, 4, 5, 6, 7], key=str)
    assert {1, 2, 4} <= set(ids["mixing sources to target weights"]) and ids["byte-level BPE encoding and decoding"] == ids["line dedup"]
    assert {r["n_tokens"] for r in found["byte-level BPE encoding and decoding"].where("doc_id in (1, 2)").collect()} == {0}
    assert [df.count() for df in (stage(spark, odd.limit(0), SF) for _, stage in P.STAGES)] == [0] * 5
