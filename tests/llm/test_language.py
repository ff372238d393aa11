"""Language identification against a plain version: n-grams by hand, the mean of their rows, a softmax."""

import math

import numpy as np
import pandas as pd
import pytest
import regex

from ledgerwatch.llm import language


def plain_rows(text):
    """The hash rows of all n-grams, one at a time, in whole numbers."""
    whole = " " + regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip() + " "
    found = []
    for n in language.ORDERS:
        for at in range(len(whole) - n + 1):
            value = 0
            for k, c in enumerate(whole[at : at + n], 1):
                value = (value * 0x9E3779B1 + ord(c) + k) % 2**32
            value ^= value >> 15
            found.append(value * 0x85EBCA6B % 2**32 >> 17)
    return found


def plain_prediction(model, text):
    if not text or not regex.search(r"\p{L}", text):
        return "und", 0.0, True
    rows = plain_rows(text)
    sums = [sum(float(model.logits[r][k]) for r in rows) / (len(rows) + language.FEW) / model.temperature for k in range(len(model.labels))]
    odds = [math.exp(x - max(sums)) for x in sums]
    best = max(range(len(odds)), key=lambda k: (odds[k], -k))
    score = odds[best] / sum(odds)
    return model.labels[best], score, score < model.threshold


TEXTS = ["", "a", "Straße über Köln", "12 34", "\U0001f600 ok", "x" * 3000, "ÀÉÎ õ ü\nnew line", "İstanbul", None]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_ngrams_one_at_a_time(text):
    assert sorted(int(r) for rows in language.ngram_rows(text) for r in rows) == sorted(plain_rows(text))


def test_predictions_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = docs.where(~language.held_out())
    model = language.calibrated(language.train(language.sample(labelled)), labelled)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + r["doc_id"], r["text"]) for r in docs.limit(40).collect()]
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc_id, text in rows:
        lang, score, rejected = plain_prediction(model, text)
        assert (found[doc_id]["lang_pred"], found[doc_id]["rejected"]) == (lang, rejected)
        assert found[doc_id]["score"] == pytest.approx(score, abs=1e-4)


def test_every_language_is_learned(spark):
    """Three hundred languages, the rarest too, each of letters of its own."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        own = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        rows += [(len(rows) + j, "".join(rng.choice(own, 40)), f"l{k:03d}") for j in range(3 + 5 * (k % 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.calibrated(language.train(language.sample(docs)), docs)
    assert model.labels == sorted({r[2] for r in rows}) and model.out.shape == (language.WIDTH, 300)


def test_more_values_than_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "abc", f"l{k}") for k in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        language.sample(docs)
    assert len(language.sample(docs.where("doc_id < 2"))) == 2


def test_low_quantile_is_one_rule_at_every_size():
    odds = pd.Series(np.random.default_rng(1).logistic(6, 1, 200_000))
    scores = (1 / (1 + np.exp(-odds))).to_numpy()
    want = np.quantile(scores, language.LOST)
    assert language.low_quantile(scores, language.LOST) == pytest.approx(want, abs=1e-3)
    logit = lambda p: math.log(p / (1 - p))
    for n in (300, 3_000, 9_000, 11_000, 49_000, 51_000):
        assert abs(logit(language.low_quantile(scores[:n], language.LOST)) - logit(want)) < 2
    near = [logit(language.low_quantile(scores[:n], language.LOST)) for n in (9_900, 10_100)]
    assert abs(near[0] - near[1]) < 0.2
    assert language.low_quantile(np.zeros(0), language.LOST) == 0.0


def _sayings(n):
    """Texts of two languages, each of words that no other text has."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        low = 0x4E00 if k % 2 else 0x7000
        rows.append((k, "".join(chr(low + int(x)) for x in rng.integers(0, 4000, 30)), "ab"[k % 2]))
    return rows


def test_the_model_learns_from_every_text(spark, monkeypatch):
    """what stands in one text outside the sample is known too."""
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = _sayings(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4, "doc_id")
    few, every = language.train(language.sample(docs, per_language=20)), language.learn(docs)
    right = lambda model: sum(model.predict(text)[0] == lang for _, text, lang in rows) / len(rows)
    assert right(every) > 0.9 and right(every) > right(few)
    moved = np.abs(every.table - language.train(language.sample(docs, per_language=20)).table).max(axis=1) > 0
    seen = {int(r) for _, text, _ in rows for part in language.ngram_rows(text) for r in part}
    assert moved.sum() > 0.9 * len(seen)


def test_temperature_and_threshold_come_from_all_texts(spark):
    rows = _sayings(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4, "doc_id")
    model = language.judged(language.train(language.sample(docs)), docs)
    found = [(model.predict(text), lang) for _, text, lang in rows]
    right = np.array([score for (said, score, _), lang in found if said == lang])
    assert model.threshold == pytest.approx(language.low_quantile(right, language.LOST), abs=1e-9)
    assert model.temperature in language.TEMPERATURES


def test_nothing_to_learn_or_one_text(spark):
    none = spark.createDataFrame([(1, "abc", None), (2, None, "a")], "doc_id long, text string, lang string")
    assert language.learn(none).labels == []
    assert language.learn(none.union(spark.createDataFrame([(3, "abc", "b")], none.schema))).labels == ["b"]


def test_a_worker_keeps_the_tables_of_one_operator():
    from ledgerwatch.llm import bpe, common

    made = bpe.codec()
    assert bpe.codec() is made and common.kept("bpe")
    common.kept("language")
    assert list(common._KEPT) == ["language"] and bpe.codec() is not made
