"""Alerts over a stream of ticks: fire once when a threshold is crossed, hold, arm again when it clears.

What one trigger leaves to the next are its last two ticks: from them the batch operators work
out whether a rule was firing and how much a counter rose. Ticks of a trigger are ordered by
Spark's own sorts, day by day, so that no rule's ticks are gathered in memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.alerts import alert_edges
from emberlog.operators.retention import DISK_WARNING
from emberlog.params import AlertRule
from emberlog.sources.rules import read_alert_rules

TICK = ["ts", "logs_received", "logs_dropped", "bytes_written", "disk_usage", "disk_cap"]
ALERT = "ts timestamp, rule string, detail string, value double"
DISK_RULE = AlertRule("disk_warning", "disk_pct", "gt", DISK_WARNING * 100, "disk usage above the warning level")


def keep_alerts(snapshots: DataFrame, rules: Sequence[AlertRule] | str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the alerts of a stream of counter snapshots below ``out``; ``alerts`` reads them.

    ``rules`` may be the path of a rules file, which is read and checked anew at each trigger; a bad
    file stops the stream. A rule that is new takes the ticks carried over as its past. Ticks without a time, or no later than
    one already judged, change nothing and are kept apart (``late_ticks``). Folders are named by trigger, and
    the carried ticks lie in two folders used in turn, so that a retry replaces what an earlier attempt left."""
    def judge(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, F.unix_micros("ts")
        new = batch.select(*TICK).persist()
        try:
            carried = spark.read.schema(new.schema).parquet(f"{out}/carried-{(number - 1) % 2}") if number else new.where("false")
            judged = carried.agg(F.max(at)).head()[0]
            timely = F.col("ts").isNotNull() if judged is None else F.coalesce(at > judged, F.lit(False))
            ticks = carried.union(new.where(timely))
            known = read_alert_rules(spark, rules) if isinstance(rules, str) else rules
            found = alert_edges(ticks, known).where(timely).select("ts", "rule", "detail", "value")
            for name, rows in (("alerts", found), ("late", new.where(~timely))):
                # One folder at least, so that there is something to read; none for triggers without rows.
                rows = rows.persist()
                if number == 0 or not rows.isEmpty():
                    rows.write.mode("overwrite").parquet(f"{out}/{name}/trigger={number}")
                rows.unpersist()
            ticks.orderBy(F.desc("ts")).limit(2).write.mode("overwrite").parquet(f"{out}/carried-{number % 2}")
        finally:
            new.unpersist()

    return (snapshots.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(judge).trigger(availableNow=True).start())


def alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts that ``keep_alerts`` wrote."""
    return spark.read.schema(ALERT).option("recursiveFileLookup", True).parquet(f"{out}/alerts")


def late_ticks(spark: SparkSession, out: str) -> DataFrame:
    """The ticks that came too late to be judged, and those without a time."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{out}/late")
