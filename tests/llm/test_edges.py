"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import bpe, chat, filters, infill, language, licences, lines, media, mixing, ngrams, pii, suffixes, vectors

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "\n\n"), (None, "hello there\nworld"), (5, "word " * 20000), (6, "é😀\t\x0b ok"), (7, "0" * 5000)]
OPERATORS = {
    "mix": mixing.mix,
    "mixed": mixing.mixed_documents,
    "pii": pii.find,
    "redact": pii.redact,
    "media": media.digests,
    "clips": lambda d: media.clip_rows(media.media_column(d)),
    "licences": licences.scan,
    "bpe": bpe.digests,
    "bpe round": lambda d: bpe.decode_documents(bpe.encode_documents(d)),
    "lines": lines.without_repeats,
    "language": lambda d: language.predict(d, language.train(language.sample(d))),
    "similar": ngrams.similar_documents,
    "failures": filters.failures,
    "infill": infill.infill,
    "suffixes": suffixes.without_repeats,
}
ROW_EACH = {"mix", "pii", "media", "bpe", "bpe round", "lines", "language", "similar", "redact", "failures", "infill", "suffixes"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(docs, name):
    clashing = docs(*ODD).withColumns({c: F.lit(7) for c in ("size", "target", "copies", "lang_pred", "score", "n_lines", "node", "bands", "spans", "email", "n", "key", "base")})
    found = OPERATORS[name](clashing).collect()
    if name in ROW_EACH:
        assert len(found) == len(ODD)
    assert OPERATORS[name](docs(*ODD).limit(0)).count() == 0


def test_odd_conversations(spark):
    rows = spark.createDataFrame([(1, None, "user", "x"), (1, 0, None, None), (None, 0, "assistant", "&lt;</s>[/INST]<s2>"), (2, 0, "a[INST]", "b"), (2, 0, "a[INST]", "b")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.format_conversations(rows.withColumn("level", F.lit(9))).withColumn("again", chat.parse(F.col("formatted"))).collect()}
    assert all(r["turns"] == r["again"] for r in found.values())
    assert [len(found[k]["turns"]) for k in (1, None, 2)] == [2, 1, 2] and found[1]["level"] == 0 and found[2]["level"] == 1
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [2.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[11] == (2, 1, False)
    assert all(found[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_odd_values(docs):
    rows = docs(*ODD)
    by = lambda df, *columns: sorted({(r["doc_id"], *[r[c] for c in columns]) for r in df.collect()}, key=str)
    assert [x for x in by(mixing.mix(rows), "size") if x[0] in (1, 2, 3, 4)] == [(1, 0), (2, 0), (3, 1), (4, 0)]
    assert [x for x in by(bpe.digests(rows), "n_tokens") if x[0] in (1, 2, 3)] == [(1, 0), (2, 0), (3, 1)]
    assert [x for x in by(lines.without_repeats(rows), "text", "n_lines", "n_deleted") if x[0] in (1, 2, 4, None)] == [(1, None, 0, 0), (2, "", 1, 0), (4, "\n\n", 3, 0), (None, "hello there\nworld", 2, 0)]
    assert [x for x in by(media.digests(rows), "n_bytes", "payload_bytes") if x[0] in (1, 2, 3)] == [(1, 0, 64), (2, 0, 64), (3, 1, 64)]
    similar = by(ngrams.similar_documents(rows), "n_links", "class_id", "n_shingles")
    assert [x for x in similar if x[0] in (1, 2, 3, 5)] == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 1, 3, 1), (5, 0, 5, 1)]
    told = by(language.predict(rows, language.train(language.sample(rows))), "lang_pred", "rejected")
    assert [x for x in told if x[0] in (1, 2, 4, 7)] == [(k, "und", True) for k in (1, 2, 4, 7)]
    assert [x for x in by(pii.redact(rows), "text") if x[0] in (1, 2, 3)] == [(1, ""), (2, ""), (3, "a")]


def test_partitions_and_order_do_not_matter(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dealt = rows.repartition(7).orderBy(F.desc("doc_id"))
    for run in (lambda d: mixing.mix(d, block=64).select("doc_id", "copies"), lambda d: lines.without_repeats(d).select("doc_id", "text"), lambda d: ngrams.similar_documents(d), lambda d: pii.find(d).select("doc_id", pii.written(F.col("spans")))):
        assert sorted(map(str, run(rows).collect())) == sorted(map(str, run(dealt).collect()))
