"""Readers of ledgers and accounts, and the ledger derived from the driver's event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import risk_bucket

#: The instant that windows of the derived ledger look back from.
AS_OF = "2024-01-31 00:00:00"

ACCOUNT_CSV = (
    "account_id string, account_age_days string, kyc_status string, account_type string, in_txn_count string, unique_senders string, "
    "total_in_amount string, avg_in_amount string, out_txn_count string, unique_receivers string, total_out_amount string, avg_out_amount string, "
    "pass_through_ratio string, txn_velocity_per_day string, pagerank string, hub_score string, authority_score string, is_mule string"
)
LEDGER_CSV = "txn_id string, sender_id string, receiver_id string, amount string, timestamp string, mode string, is_fraud_pattern string"
_TEXT = {"account_id", "kyc_status", "account_type", "is_mule"}


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Account features from CSV: numbers that do not parse are 0, `is_mule` is a boolean, `kyc_full` marks full checks."""
    rows = spark.read.schema(ACCOUNT_CSV).option("header", True).csv(path)
    numbers = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in rows.columns if c not in _TEXT]
    return rows.select("account_id", "account_type", (F.col("kyc_status") == "FULL").alias("kyc_full"), *numbers, F.coalesce(F.lower("is_mule") == "true", F.lit(False)).alias("is_mule"))


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Payments from CSV; a payment is flagged if it names a fraud pattern."""
    rows = spark.read.schema(LEDGER_CSV).option("header", True).csv(path)
    return rows.select("txn_id", F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"), F.coalesce(F.col("amount").try_cast("decimal(18,2)"), F.lit(0)).alias("amount"), F.col("timestamp").try_cast("timestamp").alias("ts"), F.col("mode").alias("type"), (F.coalesce("is_fraud_pattern", F.lit("NONE")) != "NONE").alias("flagged"))


def read_dataset_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Accounts from a JSON array, which one task reads whole, or, without `multi_line`, from a document a line, which many share."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", multi_line).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array of objects each, however long, with or without line breaks.

    Files are read in byte ranges, as pieces that end at a closing brace. How many
    quotes a piece has, outside escapes, says for both cases whether strings are open
    at its end; running over the pieces of a range, and over the ranges of a file, that
    tells braces in strings from others, and those say where objects end. Only the
    pieces of one object, or of what lies in one range, are ever put together.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    plain = F.regexp_replace("value", r"\\.", "")  # without escapes, which never hold a brace
    raw = raw.withColumns({"plain": plain, "odd": F.regexp_count(plain, F.lit('"')) % 2})
    blocks, ahead = Window.partitionBy("file").orderBy("block"), (Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "block").orderBy("k")
    before = lambda c: F.coalesce(F.sum(c).over(within.rowsBetween(*ahead)), F.lit(0))

    def run(df: DataFrame, value: str, name: str) -> DataFrame:
        """`df` with the sum of `value` over all pieces before, from sums within a range and a row for each range."""
        ranges = df.groupBy("file", "block").agg(F.sum(value).alias("all")).select("file", "block", F.coalesce(F.sum("all").over(blocks.rowsBetween(*ahead)), F.lit(0)).alias("earlier"))
        return df.join(ranges, ["file", "block"]).withColumn(name, F.col("earlier") + before(value)).drop("earlier")

    found = run(raw, "odd", "quotes")
    inside = F.col("quotes") % 2 == 1
    outside = F.when(inside, F.regexp_replace("plain", '^[^"]*("|$)', "")).otherwise(F.col("plain"))
    outside = F.regexp_replace(F.regexp_replace(outside, '"[^"]*"', ""), '"[^"]*$', "")
    closed = (F.col("quotes") + F.col("odd")) % 2 == 0  # the brace at the end is no part of a string
    found = found.withColumns({"closes": closed.cast("long"), "turns": F.regexp_count(outside, F.lit(r"\{")) - closed.cast("long")})
    found = run(found, "turns", "depth")
    # an object ends where no brace is open any more
    found = found.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") + F.col("turns") == 0)).cast("long"))
    found = run(found, "ends", "object")
    parts = found.groupBy("file", "object").agg(F.sort_array(F.collect_list(F.struct("block", "k", "value"))).alias("parts"), F.max("ends").alias("whole")).where("whole = 1")
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    return parts.select(F.from_json(F.regexp_replace(text, r"^[^{]*", ""), schema).alias("row")).select("row.*")


def import_window(rows: DataFrame, key: str, start: int = 0, limit: int | None = None, share: float | None = None) -> DataFrame:
    """A slice of an import by the number in its key, or a hashed share of it; reruns give the same rows."""
    number = F.regexp_extract(key, r"(\d+)$", 1).try_cast("long")
    rows = rows.where(number >= start)
    if limit is not None:
        rows = rows.where(number < start + limit)
    if share is not None:
        rows = rows.where(F.md5(F.col(key).cast("string")) < F.lit(f"{int(share * 16**8):08x}"))
    return rows


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def account_count(spark: SparkSession, sf_dir: str) -> int:
    return _read(spark, sf_dir, "events").agg(F.max("user_id") + 1).first()[0] or 0


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files (a glob, so that one file will do as well as a folder)."""
    return spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def ledger(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(txn_id, src, dst, amount, ts, type, flagged): each event pays from its user to another account."""
    n = account_count(spark, sf_dir)
    to = (F.col("user_id") * 7 + 1 + F.get_json_object("props", "$.k").cast("long")) % n
    return (
        (_read(spark, sf_dir, "events") if events is None else events)
        .withColumn("to", to)
        .where("to != user_id")
        .select(
            F.concat(F.lit("T"), F.col("event_id")).alias("txn_id"),
            F.concat(F.lit("A"), F.col("user_id")).alias("src"),
            F.concat(F.lit("A"), F.col("to")).alias("dst"),
            F.round(F.col("value") * 1000).cast("decimal(18,2)").alias("amount"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("type"),
            (F.col("event_type") == "error").alias("flagged"),
        )
    )


def high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("type = 'purchase' and amount >= 100000")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("type = 'purchase'")


def accounts(spark: SparkSession, sf_dir: str, pays: DataFrame | None = None) -> DataFrame:
    """(id, name, bank, city, balance, age_days, turnover, risk, risk_level, is_mule); `pays` is the ledger, if it is there already."""
    n = account_count(spark, sf_dir)
    pays = ledger(spark, sf_dir) if pays is None else pays
    moved = pays.select(F.col("src").alias("id"), "amount").union(pays.select("dst", "amount")).groupBy("id").agg(F.sum("amount").cast("double").alias("turnover"))
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    who = _read(spark, sf_dir, "customer").where(F.col("c_custkey") < n).join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    who = who.select(
        F.concat(F.lit("A"), F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("name"),
        F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("Unknown")).alias("bank"),
        F.coalesce("n_name", F.lit("Unknown")).alias("city"),
        F.col("c_acctbal").alias("balance"),
        (30 + F.col("c_custkey") * 37 % 900).cast("long").alias("age_days"),
        (F.col("c_custkey") * 53 % 101).cast("long").alias("risk"),
    )
    who = who.withColumns({"risk_level": risk_bucket(F.col("risk"), (80, 60, 40)), "is_mule": F.col("risk") >= 85})
    return who.join(moved, "id", "left").fillna(0.0, ["turnover"])


def alerts(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(id, type, severity, status, account, ts): each error event raises one."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    return (
        (_read(spark, sf_dir, "events") if events is None else events)
        .where("event_type = 'error'")
        .select(
            F.concat(F.lit("AL"), F.col("event_id")).alias("id"),
            pick(["fan_in", "fan_out", "pass_through", "circular_transfer", "rapid_movement", "structuring"], k % 6).alias("type"),
            pick(["critical", "high", "medium", "low"], k % 4).alias("severity"),
            pick(["new", "investigating", "resolved", "dismissed"], F.col("event_id") % 4).alias("status"),
            F.concat(F.lit("A"), F.col("user_id")).alias("account"),
            F.col("ts").cast("timestamp").alias("ts"),
        )
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account_id, confirmed, analyst_id, ts): one entry for each label."""
    n = account_count(spark, sf_dir)
    return _read(spark, sf_dir, "labels").select(
        F.concat(F.lit("A"), F.col("doc_id") % n).alias("account_id"),
        (F.col("toxic") == 1).alias("confirmed"),
        F.concat(F.lit("an"), F.col("doc_id") % 5).alias("analyst_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("ts"),
    )


def history(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(account_id, seq, ts, risk_score): risk of an account over time, from its views."""
    return (_read(spark, sf_dir, "events") if events is None else events).where("event_type = 'view'").select(F.concat(F.lit("A"), F.col("user_id")).alias("account_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.least(F.lit(1.0), F.col("value") / 100).alias("risk_score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, label): scores in hundredths with a true label."""
    return _read(spark, sf_dir, "labels").select((F.col("doc_id") % 101 / 100.0).alias("score"), F.col("quality").alias("label"))
