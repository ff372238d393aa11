"""Analyst feedback, and writing scored rows back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, ratio


def valid_feedback(raw: DataFrame) -> DataFrame:
    """Entries with an account and a verdict."""
    return raw.where(F.col("account_id").isNotNull() & (F.trim("account_id") != "") & F.col("confirmed").isNotNull())


def feedback_by_account(entries: DataFrame) -> DataFrame:
    outcome = F.when(F.col("confirmed"), "confirmed_mule").otherwise("false_positive")
    per = valid_feedback(entries).groupBy("account_id").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("confirmed"), F.max_by(outcome, F.struct("ts", outcome)).alias("last_outcome"))
    return per.select("account_id", "n", "confirmed", half_up(F.col("confirmed") / F.col("n"), 3).alias("rate"), "last_outcome")


def feedback_global(entries: DataFrame) -> DataFrame:
    """A row for each analyst and one, with analyst `all`, over them."""
    per = valid_feedback(entries).rollup("analyst_id").agg(F.grouping("analyst_id").alias("whole"), F.count("*").alias("n"), F.count_if("confirmed").alias("confirmed"))
    return per.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("analyst_id")).alias("analyst_id"), "n", "confirmed", half_up(ratio(F.col("confirmed"), F.col("n")), 3).alias("confirmation_rate"), half_up(ratio(F.col("n") - F.col("confirmed"), F.col("n")), 3).alias("false_positive_rate"))


def feedback_history(entries: DataFrame, latest: int = 50) -> DataFrame:
    order = Window.partitionBy("account_id").orderBy(F.desc("ts"), "analyst_id", "confirmed")
    return valid_feedback(entries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= latest)


def apply_feedback(accounts: DataFrame, entries: DataFrame) -> DataFrame:
    """Accounts with the count, the confirmations and the last outcome of their feedback."""
    per = feedback_by_account(entries).select(F.col("account_id").alias("id"), F.col("n").alias("feedback_count"), F.col("confirmed").alias("feedback_confirmed"), F.col("last_outcome").alias("feedback_outcome"))
    return accounts.join(per, "id", "left").fillna(0, ["feedback_count", "feedback_confirmed"])


def apply_verdicts(alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Alerts with the status of their latest verdict (alert_id, confirmed, ts)."""
    last = verdicts.groupBy(F.col("alert_id").alias("id")).agg(F.max_by("confirmed", "ts").alias("confirmed"))
    status = F.when(F.col("confirmed"), "confirmed").when(~F.col("confirmed"), "dismissed").otherwise(F.col("status"))
    return alerts.join(last, "id", "left").withColumn("status", status).drop("confirmed")


def upsert(base: DataFrame, new: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Rows of both tables by key, one column or several: columns of `new` win where it has a row, columns it lacks survive."""
    keys = [key] if isinstance(key, str) else key
    same = reduce(Column.__and__, (F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    both = base.alias("b").join(new.withColumn("__new", F.lit(True)).alias("n"), same, "full")
    columns = []
    for name in [*base.columns, *[c for c in new.columns if c not in base.columns]]:
        if name in keys:
            columns.append(F.coalesce(f"n.{name}", f"b.{name}").alias(name))
        elif name in new.columns:
            old = F.col(f"b.{name}") if name in base.columns else F.lit(None)
            columns.append(F.when(F.col("n.__new"), F.col(f"n.{name}")).otherwise(old).alias(name))
        else:
            columns.append(F.col(f"b.{name}"))
    return both.select(*columns)
