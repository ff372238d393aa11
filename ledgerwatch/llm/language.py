"""Language identification by averaged hashed subword embeddings.

A text is the bag of its character n-grams, one to four long, over lower-cased
letters with a space for every run of anything else. Each n-gram hashes to a row
of an embedding table; the mean of the rows goes through a linear softmax.
Embeddings and output weights are trained together by stochastic gradient
descent in numpy, from all labelled texts but those kept back (`learn`). Where it
starts is a model of a bounded sample, `SAMPLE` texts for each language and about
`TEXTS` of all, which reach the driver as counts over the hash rows. From there each
task descends over all of its own texts, and the mean of what the tasks have come to,
weighted by their texts, is the model. A share `KEPT_BACK` of the texts of each
language, but of the rarest, is not learned from: the temperature of the scores is
chosen on all of these, and a prediction is rejected below the score that only `LOST`
of the right ones among them stay under. How texts are dealt to tasks is how the files
are read; reruns with the same files and settings agree.

Tasks get the table and the weights, which grow by `WIDTH` numbers a language.

Nulls and edge cases: a text that is null or has no letter is `und` with score
0 and rejected; rows with a null language are never learned from; with no
language to learn, every text is `und`; every language is learned, and more than
`LANGUAGES` values are an error, as `lang` is no language then; ties of score go to the first language by name; texts of any length are
read whole, in pieces that change nothing; repeated rows give repeated results;
other columns are kept, but for any named lang_pred, score or rejected, which give
way; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, kept, read

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
WIDTH = 16
#: Training texts at most for each language, and of all languages (one of each at least).
SAMPLE, TEXTS = 250, 64_000
#: More values of `lang` than there are languages.
LANGUAGES = 10_000
EPOCHS, RATE = 12, 8.0
#: Share of the right predictions that rejection may cost.
LOST = 0.001
#: Loss that calibration may cost; n-grams that count as few.
SLACK, FEW = 0.01, 10
#: The tail of the least scores: so many of them, but this share at most.
LEAST, TAIL = 50, 0.2
#: Texts outside the sample that rejection is calibrated on, about so many.
CALIBRATE = 10_000
#: Share of the texts kept back to calibrate on, of languages with so many texts; without any such language all texts are calibrated on.
KEPT_BACK, MANY = 0.2, 50
#: The rate of the pass over all texts, and how many numbers of a model travel together to their mean.
LATER, PART = 2.0, 1024
TEMPERATURES = np.geomspace(0.05, 20, 60)
UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
PIECE = 1 << 18
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


def ngram_rows(text: str) -> Iterator[np.ndarray]:
    """Hash rows of all n-grams of a text, of a piece of it at a time; an n-gram belongs to the piece that it begins in."""
    whole = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    longest = max(ORDERS)
    for at in range(0, len(whole), PIECE):
        points = np.frombuffer(whole[at : at + PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        value, starts = np.zeros(len(points), np.uint32), min(PIECE, len(whole) - at)
        for n in range(1, longest + 1):
            if len(points) < n:
                break
            value = value[: len(points) - n + 1] * _MIX[0] + points[n - 1 :] + np.uint32(n)
            mixed = value[:starts] ^ (value[:starts] >> np.uint32(15))
            yield ((mixed * _MIX[1]) >> np.uint32(17)).astype(np.intp)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hash rows of a text, and how often it has each."""
    counts = np.zeros(BUCKETS, np.int64)
    for rows in ngram_rows(text):
        counts += np.bincount(rows, minlength=BUCKETS)
    rows = np.flatnonzero(counts)
    return rows, counts[rows]


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x WIDTH
    out: np.ndarray  # WIDTH x languages
    temperature: float
    threshold: float
    kept_back: np.ndarray  # scores of the right predictions among the texts kept back

    @property
    def logits(self) -> np.ndarray:
        """Of each hash row."""
        return self.table @ self.out

    def evidence(self, text: str) -> np.ndarray:
        """The mean of the logits of the n-grams; few n-grams are little evidence, and drawn towards even odds."""
        total, n = np.zeros(WIDTH), 0
        for rows in ngram_rows(text):
            total += np.bincount(rows, minlength=BUCKETS) @ self.table if len(rows) > BUCKETS else self.table[rows].sum(axis=0)
            n += len(rows)
        return total @ self.out / (n + FEW)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether the score is too low to trust."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = softmax(self.evidence(text) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold)


def _known(labelled: DataFrame, per_language: int) -> tuple[DataFrame, dict[str, int], float]:
    """The texts that can be learned from, how many there are of each language, and how many of each to learn."""
    known = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    return known, sizes, max(1, min(per_language, TEXTS / max(1, len(sizes))))


def _uniform(key: str, name: str) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(name)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _drawn(key: str, sizes: dict[str, int], per_language: float) -> F.Column:
    """Whether a text is in the sample."""
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, per_language / n)]), F.col("lang"))
    return _uniform(key, "sample") < rate


def sample(labelled: DataFrame, key: str = "doc_id", per_language: int = SAMPLE) -> pd.DataFrame:
    """(lang, rows, counts): hash-row counts of at most `per_language` texts of each language.

    Texts are drawn by a hash of `key` at the rate that leaves about so many, so
    no language is ever sorted or gathered as a whole.
    """
    known, sizes, per_language = _known(labelled, per_language)
    if not sizes:
        return pd.DataFrame({"lang": [], "rows": [], "counts": []})
    picked = known.where(_drawn(key, sizes, per_language)).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("language")
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if not has_letter(text):
                    continue
                rows, counts = bag(text)
                yield pd.DataFrame({"lang": [lang], "rows": [rows.astype(np.int32)], "counts": [counts.astype(np.float32)]})

    found = picked.mapInPandas(run, schema="lang string, rows array<int>, counts array<float>")
    # twice the expected number is beyond what the draw gives (rows of one key are drawn together); it bounds what the driver holds
    found = found.orderBy(F.xxhash64("lang", "rows", "counts")).limit(int(2 * per_language * len(sizes))).toPandas()
    found["order"] = [hash_of(r, c) for r, c in zip(found["rows"], found["counts"], strict=True)]
    return found.sort_values(["order", "lang"], kind="stable").drop(columns="order").reset_index(drop=True)


def hash_of(rows: np.ndarray, counts: np.ndarray) -> int:
    """An order for the training texts that does not depend on how Spark delivered them."""
    return int((np.asarray(rows, np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(counts).astype(np.uint64)).sum() & np.uint64(0x7FFFFFFFFFFFFFFF))


def _descend(table: np.ndarray, out: np.ndarray, rows: np.ndarray, share: np.ndarray, want: int, rate: float) -> None:
    """One step down the gradient at a text, in place."""
    hidden = share @ table[rows]
    error = softmax(hidden @ out)
    error[want] -= 1
    back = out @ error
    out -= rate * np.outer(hidden, error)
    table[rows] -= rate * share[:, None] * back


def train(texts: pd.DataFrame, seed: int = 0) -> Model:
    """Stochastic gradient descent over the sample, then temperature and threshold on every fifth text."""
    labels = sorted(texts["lang"].unique())
    if not labels:
        return Model([], np.zeros((BUCKETS, WIDTH)), np.zeros((WIDTH, 0)), 1.0, 0.0, np.zeros(0))
    rng = np.random.default_rng(seed)
    table, out = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(labels)))
    want = texts["lang"].map(labels.index).to_numpy()
    share = [np.asarray(c, np.float32) / np.sum(c) for c in texts["counts"]]
    rows = [np.asarray(r) for r in texts["rows"]]
    kept_back = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    learned, steps = np.flatnonzero(~kept_back), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(learned):
            rate = RATE * (1 - steps / (EPOCHS * len(learned)))
            _descend(table, out, rows[k], share[k], want[k], rate)
            steps += 1
    logits = table @ out
    check = np.flatnonzero(kept_back) if kept_back.any() else learned
    # drawn towards even odds as in predict, so that short texts are calibrated as they are scored
    sizes = np.array([float(np.sum(texts["counts"].iloc[k])) for k in check])
    scores, truth = np.array([share[k] @ logits[rows[k]] for k in check]) * (sizes / (sizes + FEW))[:, None], want[check]
    temperature = float(TEMPERATURES[mildest([-np.log(softmax(scores / t)[np.arange(len(check)), truth] + 1e-12).mean() for t in TEMPERATURES])])
    p = softmax(scores / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    return Model(labels, table.astype(np.float32), out.astype(np.float32), temperature, low_quantile(right, LOST), right)


def mildest(losses: list[float]) -> int:
    """Which of TEMPERATURES to take: texts that are told apart without error would let any low one do, so the mildest that is as good."""
    return max(k for k, x in enumerate(losses) if x <= min(losses) + SLACK)


def _tail(n: int, share: float) -> int:
    """How many of the least of n scores tell the quantile."""
    return int(max(1, share * n, min(LEAST, TAIL * n)))


def low_quantile(scores: np.ndarray, share: float, of: int | None = None) -> float:
    """The score that `share` of texts like these stay below, 0 without any; `scores` may be the least, `_tail` and one more, `of` so many.

    A few hundred texts hold no quantile as low as LOST: their least score is one
    of a few in a thousand. So the log odds of the scores are taken to fall off
    exponentially below the `LEAST` least ones (a share TAIL of them at most), at
    the mean rate of the texts there; with `LEAST / share` scores and more this is
    the quantile itself.
    """
    if not len(scores):
        return 0.0
    n = len(scores) if of is None else of
    odds = np.sort(np.log(np.clip(scores, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(scores, 1e-9, 1 - 1e-9)))
    k = _tail(n, share)
    edge = odds[min(k, len(odds) - 1)]
    at = float(edge - (edge - odds[:k]).mean() * np.log(max(1.0, k / (share * n))))
    return float(1 / (1 + np.exp(-at)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected (in place of columns so named); it reads nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + LANGUAGES) x WIDTH numbers at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("language")
        for batch in batches:
            found = [shared.value.predict(x) for x in batch["text"]]
            yield batch.assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found], rejected=[f[2] for f in found])

    docs = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, schema=f"{schema}, lang_pred string, score double, rejected boolean")


def calibrated(model: Model, labelled: DataFrame, key: str = "doc_id", per_language: int = SAMPLE) -> Model:
    """`model` with its threshold from labelled texts outside its sample and those it kept back."""
    known, sizes, per_language = _known(labelled, per_language)
    if not sizes:
        return model
    others = known.where(~_drawn(key, sizes, per_language)).where(_uniform(key, "calibrate") < CALIBRATE / sum(sizes.values()))
    right = predict(others.select("lang", "text"), model).where("lang_pred = lang").select("score")
    # as in the sample, twice the expected number bounds what the driver holds
    scores = right.orderBy(F.xxhash64("score")).limit(2 * CALIBRATE).toPandas()["score"].to_numpy()
    return replace(model, threshold=low_quantile(np.concatenate([scores, model.kept_back]), LOST))


def learn(labelled: DataFrame, key: str = "doc_id") -> Model:
    """A model of all labelled texts: those kept back set its temperature and threshold, it learns from all others."""
    known, sizes, _ = _known(labelled.where(F.col("text").rlike(r"\p{L}")), SAMPLE)
    many = sorted(lang for lang, n in sizes.items() if n >= MANY)
    if not many:
        return judged(descended(_with_all(train(sample(known, key, SAMPLE)), sizes), known), known)
    back = F.col("lang").isin(many) & (_uniform(key, "kept back") < KEPT_BACK)
    learned = known.where(~back)
    return judged(descended(_with_all(train(sample(learned, key, SAMPLE)), sizes), learned), known.where(back))


def _with_all(model: Model, labels: Iterable[str]) -> Model:
    """`model` with languages that the sample has missed, of which it knows nothing yet."""
    found = dict(zip(model.labels, model.out.T, strict=True))
    labels = sorted(labels)
    out = np.array([found.get(x, np.zeros(WIDTH)) for x in labels], np.float32).reshape(-1, WIDTH).T.copy()
    return replace(model, labels=labels, table=model.table.astype(np.float32), out=out)


def descended(model: Model, learned: DataFrame) -> Model:
    """`model` after a pass over all texts of `learned(lang, text)`: each task goes on from it by its own texts, and the mean by texts is taken.

    A task hands on one copy of the model in parts, and parts are added up where the
    shuffle brings them together; the driver gets their means.
    """
    if not model.labels:
        return model
    shared = learned.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("language")
        start, n = shared.value, 0
        number, table, out = {x: k for k, x in enumerate(start.labels)}, start.table.copy(), start.out.copy()
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang in number and has_letter(text):
                    rows, counts = bag(text)
                    _descend(table, out, rows, (counts / counts.sum()).astype(np.float32), number[lang], LATER)
                    n += 1
        if n:
            flat = np.concatenate([table.ravel(), out.ravel()])
            parts = [flat[at : at + PART].tobytes() for at in range(0, len(flat), PART)]
            yield pd.DataFrame({"part": range(len(parts)), "task": TaskContext.get().partitionId(), "n": n, "numbers": parts})

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total, n = None, np.zeros(0), 0
        done = lambda: pd.DataFrame({"part": [part], "numbers": [(total / n).tobytes()]})
        for batch in batches:
            for now, texts, numbers in zip(batch["part"], batch["n"], batch["numbers"], strict=True):
                if now != part:
                    if part is not None:
                        yield done()
                    part, total, n = now, np.zeros(len(numbers) // 4), 0
                total, n = total + texts * np.frombuffer(numbers, np.float32).astype(np.float64), n + texts
        if part is not None:
            yield done()

    sent = learned.select("lang", "text").mapInPandas(run, schema="part int, task int, n long, numbers binary")
    # in the order of the tasks, so that sums do not depend on what arrives first
    found = sent.repartition("part").sortWithinPartitions("part", "task").mapInPandas(mean, schema="part int, numbers binary").toPandas()
    if not len(found):
        return model
    flat = np.concatenate([np.frombuffer(x) for x in found.sort_values("part")["numbers"]]).astype(np.float32)
    return replace(model, table=flat[: model.table.size].reshape(model.table.shape), out=flat[model.table.size :].reshape(model.out.shape))


def judged(model: Model, texts: DataFrame) -> Model:
    """`model` with temperature and threshold from all `texts(lang, text)`, which are scored once, at every temperature."""
    if not model.labels:
        return model
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("language")
        model = shared.value
        number = {x: k for k, x in enumerate(model.labels)}
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows, some = [], batch.iloc[at : at + 1000]
                for lang, text in zip(some["lang"], some["text"], strict=True):
                    if lang in number and has_letter(text):
                        logits = model.evidence(text)
                        p, best = softmax(logits / TEMPERATURES[:, None]), int(logits.argmax())
                        # copies, as a row or column of p would keep all of it
                        rows.append((best == number[lang], p[:, best].copy(), -np.log(p[:, number[lang]] + 1e-12)))
                yield pd.DataFrame(rows, columns=["right", "scores", "losses"])

    scored = checkpoint(texts.select("lang", "text").mapInPandas(run, schema="right boolean, scores array<double>, losses array<double>"))
    *losses, n, right = scored.agg(*[F.sum(F.get("losses", F.lit(k))) for k in range(len(TEMPERATURES))], F.count("*"), F.count_if("right")).first()
    if not n:
        return model
    at = mildest([x / n for x in losses])
    # the least LOST of the right scores are all that the driver needs of them
    least = scored.where("right").select(F.get("scores", F.lit(at)).alias("score")).orderBy("score").limit(_tail(right, LOST) + 1)
    return replace(model, temperature=float(TEMPERATURES[at]), threshold=low_quantile(least.toPandas()["score"].to_numpy(), LOST, right))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    mine = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(mine, model).drop("text")
