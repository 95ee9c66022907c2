"""One-record incident report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from emberlog.functions.messages import CRITICAL_WORDS, contains_any, is_error, normalize_message
from emberlog.functions.scoring import severity
from emberlog.operators import triage
from emberlog.operators.capture_index import report_labels
from emberlog.operators.ordering import kept

TOP_ERRORS = 20  # fixed value


def report(logs: DataFrame, index: DataFrame, metadata: DataFrame, top: int = TOP_ERRORS) -> DataFrame:
    """Per capture: size and period, totals, error rate, top signature, severity.

    Totals and top signatures come from one aggregation of the logs by capture and
    signature (the null signature holds the lines that are no errors)."""
    signature = F.when(is_error(F.col("msg")), normalize_message(F.col("msg")))
    counts = kept(logs.groupBy("capture", signature.alias("signature")).agg(F.count(F.lit(1)).alias("n")), "report-counts")
    is_sig = F.col("signature").isNotNull()
    totals = counts.groupBy("capture").agg(
        F.sum("n").alias("total_lines"), F.sum(F.when(is_sig, F.col("n")).otherwise(0)).alias("error_lines"))
    rank = F.row_number().over(Window.partitionBy("capture").orderBy(F.desc("n"), "signature"))
    # At most `top` rows per capture are kept, also before the shuffle.
    best = (counts.where(is_sig).withColumn("_rank", rank).where(F.col("_rank") <= top)
            .groupBy("capture")
            .agg(F.bool_or(contains_any(F.col("signature"), CRITICAL_WORDS)).alias("critical"),
                 F.max(F.when(F.col("_rank") == 1, F.col("signature"))).alias("top_error"),
                 F.max(F.when(F.col("_rank") == 1, F.col("n"))).alias("top_error_count")))
    files = index.groupBy("capture").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    pct = F.coalesce(F.try_divide(F.col("error_lines") * 100.0, "total_lines"), F.lit(0.0))
    return (metadata.select("capture", "started", "stopped",
                            ((F.unix_micros("stopped") - F.unix_micros("started")) / F.lit(1e6)).alias("duration_seconds"))
            .join(files, "capture", "left").join(totals, "capture", "left").join(best, "capture", "left")
            .withColumn("error_rate_pct", pct)
            .withColumn("severity", severity(F.col("error_rate_pct"), F.coalesce("critical", F.lit(False))))
            .drop("critical"))


def incident_report(logs: DataFrame, index: DataFrame, metadata: DataFrame, capture: str, top: int = TOP_ERRORS,
                    order: Sequence[str] = triage.CHRONOLOGICAL) -> DataFrame:
    """The whole report of one capture in one record: what ``report`` says, and with it the
    number of values per label key, the top errors and the time windows, as arrays."""
    def of(df):
        return df.where(F.col("capture") == capture)

    logs, index = of(logs), of(index)
    signatures, timeline = kept(triage.signature_places(logs, order), "signatures"), kept(triage.error_timeline(logs), "timeline")
    # Each list is short: the keys of the labels, ``top`` signatures, three windows.
    labels = report_labels(index).agg(F.array_sort(F.collect_list(F.struct("key", "values"))))
    ranked = F.struct((-F.col("count")).alias("_rank"), "signature", "count", "first_seen", "example", "pct_of_errors")
    errors = triage.top_errors(signatures, top, logs, order).agg(
        F.transform(F.array_sort(F.collect_list(ranked)), lambda e: e.dropFields("_rank")))
    found = triage.windows(timeline, signatures).agg(
        F.array_sort(F.collect_list(F.struct("window", "from", "to", "minutes", "value"))))
    return report(logs, index, of(metadata), top).select(
        "*", labels.scalar().alias("labels"),
        errors.scalar().alias("top_errors"),
        found.scalar().alias("windows"))


def as_json(report_rows: DataFrame) -> DataFrame:
    return report_rows.select("capture", F.to_json(F.struct(*report_rows.columns)).alias("report"))
