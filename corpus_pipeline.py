"""A training corpus from raw documents, in five stages.

Each stage works on all that the one before it kept. All but the last return the
columns of documents; stages are handed on as Parquet files in the cluster's
shared checkpoint folder, and removed once the stage after them has been written.
The last one gives the tokens of each document that is left, as often as the mix
takes it, with digests of the tokens and of what they decode to.

Nulls and edge cases are those of the operators: a text that is null or has no
letter is rejected by the first stage; an empty table passes through as one; texts
of any length are worked on whole; rows of the same doc_id are separate documents
until the third stage, which keeps one row of each group of near copies, whatever
its doc_ids, by least doc_id, ties by a hash of the text; repeated rows are such
copies; a null lang is never learned from and a null source is a source of its own,
last in order; columns beyond those of documents, whatever their names, are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.lineage import shared_folder
from ledgerwatch.llm import bpe, language, lines, mixing, ngrams

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose language the classifier rejects go."""
    docs = docs.select(*COLUMNS)
    labelled = docs.where(~language.held_out())
    return language.predict(docs, language.learn(labelled)).where("not rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: later repeats of runs of lines and of single long lines are deleted; documents left without any text go."""
    cleaned = lines.without_repeats(docs.select(*COLUMNS), long=lines.PASSAGE)
    cleaned = cleaned.where("n_deleted = 0 or trim(text) != ''")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near duplicates the document of the least (doc_id, hash of the text) stays, null doc_ids last."""
    docs = docs.select(*COLUMNS)
    mark = F.xxhash64("text")
    found = ngrams.grouped_documents(docs.select("doc_id", "text", mark.alias("mark")), "mark")
    # a text that is linked with nothing is a group of its own
    alone = lambda c: F.when(F.col("n_links") == 0, F.col(c))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    groups = found.groupBy("group", alone("doc_id").alias("a"), alone("mark").alias("b")).agg(first, F.max("n_links").alias("links"))
    kept = groups.select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"), "links")
    both = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept_id")) & (mark == F.col("kept_mark")))
    # rows of one doc_id and text are copies of one another
    single = both.where("links > 0").dropDuplicates(["kept_id", "kept_mark"])
    return both.where("links = 0").union(single).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the tokens of every document, and digests of them and of what they decode to."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: The first stage is a trained classifier; the pipeline is tested stage by stage.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name, done = uuid.uuid4().hex, None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/pipeline-{name}-{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if done:
                _remove(spark, done)
            done = path
    return docs
