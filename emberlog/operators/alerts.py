"""Rates and threshold alerts over counter snapshots, one per tick.

``snapshots``: ts, logs_received, logs_dropped, bytes_written, disk_usage, disk_cap. Ticks
are compared with the one before day by day, so that years of ticks are many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.operators.ordering import with_previous
from emberlog.operators.retention import DISK_WARNING
from emberlog.params import ALERT_METRICS, AlertRule


def _with_last_tick(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return with_previous(df, columns, "ts", F.date_trunc("day", "ts"), keys, "last")


def _per_second(column: str) -> Column:
    seconds = (F.unix_micros("ts") - F.unix_micros("last.ts")) / F.lit(1e6)
    return F.when(seconds > 0, F.try_divide(F.col(column) - F.col(f"last.{column}"), seconds))


def rate_delta(snapshots: DataFrame) -> DataFrame:
    """Logs and bytes per second since the tick before; null at the first."""
    return _with_last_tick(snapshots, ["ts", "logs_received", "bytes_written"]).select(
        "ts", _per_second("logs_received").alias("logs_per_sec"), _per_second("bytes_written").alias("bytes_per_sec"))


def talker_rates(counts: DataFrame) -> DataFrame:
    """Per talker (``name``, ``ts``, cumulative ``count``): entries per second since its last tick."""
    return _with_last_tick(counts, ["ts", "count"], ["name"]).select(
        "name", "ts", "count", _per_second("count").alias("per_sec"))


def metrics(snapshots: DataFrame) -> DataFrame:
    """The values rules may test; drop_rate is the increase since the last tick, never negative."""
    increase = F.col("logs_dropped") - F.col("last.logs_dropped")
    return _with_last_tick(snapshots, ["logs_dropped"]).select(
        "ts", F.col("logs_dropped").cast("double").alias("logs_dropped"),
        F.greatest(F.lit(0.0), F.coalesce(increase, F.lit(0))).cast("double").alias("drop_rate"),
        F.when(F.col("disk_cap") > 0, F.try_divide(F.col("disk_usage") * F.lit(100.0), "disk_cap")).otherwise(0.0).alias("disk_pct"),
        F.col("logs_received").cast("double").alias("logs_received"))


def crossed(value: Column, rule: AlertRule) -> Column:
    return {"gt": value > rule.threshold, "lt": value < rule.threshold,
            "gte": value >= rule.threshold, "lte": value <= rule.threshold}[rule.op]


def rule_states(measured: DataFrame, rules: Sequence[AlertRule] | DataFrame) -> DataFrame:
    """One row per tick and rule: rule, detail, value, triggered. Rules may be a table of the columns
    ``name, metric, op, threshold, detail``, joined by metric."""
    if isinstance(rules, DataFrame):
        values = measured.select("ts", F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ALERT_METRICS])))
        value, threshold = F.col("value"), F.col("threshold")
        tests = {"gt": value > threshold, "lt": value < threshold, "gte": value >= threshold, "lte": value <= threshold}
        triggered = F.coalesce(*[F.when(F.col("op") == op, test) for op, test in tests.items()])
        return values.join(rules, "metric").select(
            "ts", F.col("name").alias("rule"), "detail", "value", triggered.alias("triggered"))
    return measured.select("ts", F.inline(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.detail).alias("detail"), F.col(r.metric).alias("value"),
                 crossed(F.col(r.metric), r).alias("triggered")) for r in rules])))


def rising_edges(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ticks at which ``triggered`` turns true: fired once, armed again when it turns false."""
    return (_with_last_tick(states, ["triggered"], keys)
            .where(F.col("triggered") & ~F.coalesce("last.triggered", F.lit(False))).drop("last", "triggered"))


def alert_edges(snapshots: DataFrame, rules: Sequence[AlertRule] | DataFrame) -> DataFrame:
    return rising_edges(rule_states(metrics(snapshots), rules), ["rule"])


def disk_warning_edges(snapshots: DataFrame) -> DataFrame:
    """Ticks at which disk use passes the warning share of the cap."""
    over = F.col("disk_usage") > F.floor(F.col("disk_cap") * DISK_WARNING)
    return rising_edges(snapshots.where("disk_cap > 0").select("ts", "disk_usage", "disk_cap", over.alias("triggered")))
