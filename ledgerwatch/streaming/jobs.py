"""The detectors and statistics that run on a stream of payments, and sinks that can be rerun.

All take a streaming (or batch) ledger with an event time `ts`. Rows later than
the watermark are dropped; over a closed input the results equal the batch ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.markov import state_of, transition_anomaly, with_before
from ..sources.keyed import manifest, merge_keyed, read_keyed

LATE = "1 hour"


def ledger_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_fan_in(ledger: DataFrame, least: int = 3, window: str = "4 hours", slide: str = "30 minutes") -> DataFrame:
    """Receivers paid by several senders within a sliding window."""
    # a row of state for each pair, so that no task holds the senders of a busy receiver
    pairs = ledger.withWatermark("ts", LATE).groupBy(F.window("ts", window, slide).alias("w"), F.col("dst").alias("account"), "src").agg(F.count("*").alias("n"))
    per = pairs.groupBy("w", "account").agg(F.count("*").alias("senders"), F.sum("n").alias("n"))
    return per.where(F.col("senders") >= least).select(F.unix_millis("w.start").alias("start_ms"), "account", "senders", "n")


def stream_volume(ledger: DataFrame) -> DataFrame:
    per = ledger.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("amount").cast("double").alias("amount"), F.count("*").alias("n"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "amount", "n")


def stream_burst(ledger: DataFrame, gap: str = "5 minutes", least: int = 5) -> DataFrame:
    """Sessions of a sender's payments in quick succession."""
    per = ledger.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), F.col("src").alias("account")).agg(F.count("*").alias("size"), F.sum("amount").cast("double").alias("amount"))
    return per.where(F.col("size") >= least).select(F.unix_millis("w.start").alias("start_ms"), "account", "size", "amount")


def stream_rapid(came: DataFrame, went: DataFrame, minutes: int = 30) -> DataFrame:
    """Money received and sent on within minutes: a join of two streams, bounded by their event times."""
    i = came.withWatermark("ts", LATE).select(F.col("dst").alias("account"), F.col("src").alias("origin"), F.col("txn_id").alias("in_txn"), F.col("ts").alias("in_ts"))
    o = went.withWatermark("ts", LATE).select(F.col("src").alias("payer"), F.col("dst").alias("target"), F.col("txn_id").alias("out_txn"), F.col("ts").alias("out_ts"))
    span = F.expr(f"interval {minutes} minutes")
    near = (F.col("out_ts") >= F.col("in_ts") - span) & (F.col("out_ts") <= F.col("in_ts") + span)
    return i.join(o, (F.col("account") == F.col("payer")) & near & (F.col("origin") != F.col("target")) & (F.col("in_txn") != F.col("out_txn"))).select("account", "in_txn", "out_txn")


def stream_markov(history: DataFrame, path: str, checkpoint: str, expires: str = "30 days", buckets: int = 64):
    """Each observation with the state before it: (account_id, seq, before, state, anomaly) in folders of `path`/out, a batch each.

    The last state of every account is a row of a keyed table; a batch is ordered in
    slices of time, as in `markov_states`, so no task holds what an account has in it.
    The table is merged into once the batch is written, so a batch that is run again
    either finds all done or overwrites its own folder. Observations without a time,
    and late ones, older than the state of their account, are left out. A state that is
    older by `expires` than the newest of the batch counts as none, and goes when its
    bucket is next written.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, table = batch.sparkSession, f"{path}/state"
        if number <= manifest(spark, table).merged.get(checkpoint, -1):
            return
        batch = held = batch.where("ts is not null").select("account_id", "seq", "ts", "risk_score").persist()
        newest = batch.agg(F.max("ts")).first()[0]
        if newest is None:
            return
        fresh = F.col("at") >= F.lit(newest) - F.expr(f"interval {expires}")
        known = manifest(spark, table).version and read_keyed(spark, table).where(fresh)
        if known:
            then = known.select("account_id", "at", F.col("seq").alias("at_seq"))
            batch = batch.join(then, "account_id", "left").where("at is null or ts > at or (ts = at and seq > at_seq)").drop("at", "at_seq")
        rows = with_before(batch, known or None)
        anomaly = F.when(F.col("before").isNull(), 0.0).otherwise(transition_anomaly(F.col("before"), F.col("state")))
        rows.select("account_id", "seq", "before", "state", anomaly.alias("anomaly")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        last = batch.groupBy("account_id").agg(F.max_by(F.struct(F.col("ts").alias("at"), "seq", state_of(F.col("risk_score")).alias("last")), F.struct("ts", "seq")).alias("s")).select("account_id", "s.*")
        merge_keyed(last, table, checkpoint, number, key="account_id", buckets=buckets, keep=fresh)
        held.unpersist()

    return history.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sink(alerts: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Merge alerts by id into the table at `path` (see `sources.keyed`): an id that returns, however late, stays one row, with its latest values.

    A batch rewrites only the buckets that it touches; one that is run again after a
    failure is recognised by its number and by `checkpoint`, the name of its writer.
    """

    def write(batch: DataFrame, number: int) -> None:
        merge_keyed(batch, path, checkpoint, number, order="ts", buckets=buckets)

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote; `folder` is one that all executors share."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
