"""Behaviour of accounts over time as a three-state chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, millis

STATES = ("legitimate", "suspicious", "confirmed_mule")
#: Probability of the next state (columns) given the last (rows), in the order of STATES.
MATRIX = ((0.92, 0.07, 0.01), (0.15, 0.55, 0.30), (0.0, 0.05, 0.95))
SUSPICIOUS, MULE = 0.35, 0.55


def state_of(score: Column) -> Column:
    return F.when(score >= MULE, STATES[2]).when(score >= SUSPICIOUS, STATES[1]).otherwise(STATES[0])


def transition(before: Column, after: Column) -> Column:
    """The probability of a step; a third for states that are not known."""
    pairs = [x for i, a in enumerate(STATES) for j, b in enumerate(STATES) for x in (F.lit(f"{a}>{b}"), F.lit(MATRIX[i][j]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.concat(before, F.lit(">"), after)), F.lit(1 / 3))


def transition_anomaly(before: Column, after: Column) -> Column:
    return half_up(1 - transition(before, after), 3)


#: An account's observations within so many ms, or of so many sequence numbers where they have no time, are ordered by one task.
SLICE, SEQUENCES = 6 * 3_600_000, 65_536


def _place() -> Column:
    """The order of an account's observations: oldest first, those without a time last."""
    return F.struct(F.col("ts").isNull().alias("late"), "ts", "seq")


def _sliced(history: DataFrame) -> DataFrame:
    """`history` with its slice: no task orders more of an account than one."""
    part = F.when(F.col("ts").isNull(), F.floor(F.col("seq") / SEQUENCES)).otherwise(F.floor(millis(F.col("ts")) / SLICE))
    return history.withColumn("slice", F.struct(F.col("ts").isNull().alias("late"), part.alias("part")))


def with_before(history: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`history` with the state of each observation and the one before it, oldest first, those without a time last.

    Slices of time are ordered on their own; the last state of each is handed on to
    the next. `known(account_id, last)` are states before the first ones, if there are any.
    """
    rows = _sliced(history).withColumn("state", state_of(F.col("risk_score")))
    ends = rows.groupBy("account_id", "slice").agg(F.max_by("state", _place()).alias("last"))
    handed = ends.select("account_id", "slice", F.lag("last").over(Window.partitionBy("account_id").orderBy("slice")).alias("handed"))
    within = Window.partitionBy("account_id", "slice").orderBy(F.col("ts").asc_nulls_last(), "seq")
    rows = rows.withColumn("before", F.lag("state").over(within)).join(handed, ["account_id", "slice"]).withColumn("before", F.coalesce("before", "handed")).drop("slice", "handed")
    if known is None:
        return rows
    return rows.join(known.select("account_id", "last"), "account_id", "left").withColumn("before", F.coalesce("before", "last")).drop("last")


def markov_states(history: DataFrame) -> DataFrame:
    """(account_id, seq, state, probability, anomaly) for each observation."""
    rows = with_before(history)
    first = F.col("before").isNull()
    return rows.select("account_id", "seq", "state", F.when(first, 1.0).otherwise(transition(F.col("before"), F.col("state"))).alias("probability"), F.when(first, 0.0).otherwise(transition_anomaly(F.col("before"), F.col("state"))).alias("anomaly"))


def _ends(rows: DataFrame, span: int, last: bool) -> DataFrame:
    """(account_id, mean): the mean score of each account's first or last `span` observations, found among those of every slice.

    Scores are added oldest first: a sum depends on its order in the last digit, and a half that is rounded up on that.
    """
    keys = [F.col("ts").desc_nulls_first(), F.desc("seq")] if last else [F.col("ts").asc_nulls_last(), F.asc("seq")]
    for by in (["account_id", "slice"], ["account_id"]):
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("k") <= span)
    scores = F.transform(F.array_sort(F.collect_list(F.struct(_place().alias("place"), F.col("risk_score").cast("double").alias("score")))), lambda x: x["score"])
    rows = rows.groupBy("account_id").agg(F.filter(scores, lambda x: x.isNotNull()).alias("scores"))
    mean = F.when(F.size("scores") > 0, F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores"))
    return rows.select("account_id", mean.alias("late" if last else "early"))


def risk_trend(history: DataFrame, span: int = 5) -> DataFrame:
    """(account_id, n, trend, days_to_suspicious, trajectory): the last observations against the first."""
    rows = _sliced(history).withColumn("state", state_of(F.col("risk_score")))
    odd = F.col("state") != STATES[0]
    per = rows.groupBy("account_id").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.min(F.when(odd, _place())).alias("odd"), F.max_by("state", _place()).alias("last"))
    per = per.join(_ends(rows, span, False), "account_id").join(_ends(rows, span, True), "account_id")
    trend = F.when(F.col("n") == 1, "stable").when(F.col("late") > F.col("early") * 1.2, "escalating").when(F.col("late") < F.col("early") * 0.8, "de-escalating").otherwise("stable")
    per = per.withColumn("trend", trend)
    change = lambda a, b: half_up((a - b) / F.greatest(F.col("early"), F.lit(0.01)) * 100).cast("long").cast("string")
    said = F.when(F.col("n") == 1, F.concat(F.lit("Single observation at "), "last", F.lit(" state"))).when(F.col("trend") == "escalating", F.concat(F.lit("Risk up "), change(F.col("late"), F.col("early")), F.lit("%")))
    said = said.when(F.col("trend") == "de-escalating", F.concat(F.lit("Risk down "), change(F.col("early"), F.col("late")), F.lit("%"))).otherwise(F.concat(F.lit("Stable behaviour at "), "last", F.lit(" state")))
    days = half_up((F.unix_millis(F.col("odd.ts")) - F.unix_millis("start")) / 86_400_000.0).cast("long")
    return per.select("account_id", "n", "trend", days.alias("days_to_suspicious"), said.alias("trajectory"))


def predictions(spark, steps: int = 365) -> DataFrame:
    """(state, k, likely, probability): the likeliest state k steps on; the table is (steps + 1) x 3 rows."""
    rows = []
    for i, state in enumerate(STATES):
        now = [float(j == i) for j in range(3)]
        for k in range(max(0, min(steps, 365)) + 1):
            best = max(range(3), key=lambda j: (now[j], -j))
            rows.append((state, k, STATES[best], int(now[best] * 1000 + 0.5) / 1000))
            now = [sum(now[a] * MATRIX[a][b] for a in range(3)) for b in range(3)]
    return spark.createDataFrame(rows, "state string, k int, likely string, probability double")


def predict_state(history: DataFrame, k: int) -> DataFrame:
    """(account_id, state, likely, probability): each account's latest state and where it leads in k steps."""
    last = history.groupBy("account_id").agg(F.max_by(state_of(F.col("risk_score")), F.struct(F.coalesce("ts", F.lit("9999-12-31").cast("timestamp")), "seq")).alias("state"))
    table = predictions(history.sparkSession, k).where(F.col("k") == max(0, min(k, 365))).drop("k")
    return last.join(F.broadcast(table), "state")  # three rows
