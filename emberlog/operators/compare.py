"""Compare two captures. Both come in one DataFrame with a ``capture`` column, so that each
comparison reads the logs once and counts both sides side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.functions.messages import is_error, normalize_message
from emberlog.functions.scoring import percent_change, percent_text, verdict


def _of(capture: str) -> Column:
    return F.col("capture") == capture


def rate_compare(logs: DataFrame, a: str, b: str) -> DataFrame:
    """Lines per minute of A and B, for every minute that either has."""
    return (logs.where(F.col("capture").isin(a, b))
            .groupBy(F.date_trunc("minute", "ts").alias("minute"))
            .agg(F.count_if(_of(a)).alias("rate_a"), F.count_if(_of(b)).alias("rate_b")))


def signature_counts(logs: DataFrame, a: str, b: str) -> DataFrame:
    """Lines of A and B per signature; the null signature holds the lines that are no errors."""
    signature = F.when(is_error(F.col("msg")), normalize_message(F.col("msg")))
    return (logs.where(F.col("capture").isin(a, b))
            .groupBy(signature.alias("signature"))
            .agg(F.count_if(_of(a)).alias("count_a"), F.count_if(_of(b)).alias("count_b")))


def errors_only(logs: DataFrame, a: str, b: str, top: int | None = None) -> DataFrame:
    """Signatures that one capture has and the other has not. Complete sets are compared;
    ``top`` asks for the most frequent ones of each side only, after the comparison."""
    found = (signature_counts(logs, a, b).where("signature is not null and (count_a = 0 or count_b = 0)")
             .select(F.when(F.col("count_b") == 0, "a").otherwise("b").alias("side"), F.col("signature").alias("pattern"),
                     (F.col("count_a") + F.col("count_b")).alias("count")))
    if top is None:
        return found
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("count"), "pattern"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")


def _key_sides(keys: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (capture, key), however many, to one per key: whether A and whether B has it."""
    return (keys.where(F.col("capture").isin(a, b))
            .groupBy("key").agg(F.bool_or(_of(a)).alias("_a"), F.bool_or(_of(b)).alias("_b")))


def labels_only(index: DataFrame, a: str, b: str) -> DataFrame:
    """Label keys that only one of the captures knows (from the index)."""
    return (_key_sides(index.select("capture", F.explode(F.map_keys("labels")).alias("key")), a, b)
            .where("_a <> _b").select(F.when(F.col("_a"), "a").otherwise("b").alias("side"), "key"))


def key_difference(keys: DataFrame, a: str, b: str) -> DataFrame:
    """Keys of A that B has not, from rows (capture, key). Counted map-side, as a join would bring all rows of a key together."""
    return _key_sides(keys, a, b).where("_a and not _b").select("key")


def baseline_error_delta(logs: DataFrame, baseline: str, current: str) -> DataFrame:
    """Current signatures that are new or more than doubled."""
    return (signature_counts(logs, baseline, current)
            .where("signature is not null and count_b > 0 and (count_a = 0 or count_b > 2 * count_a)")
            .select(F.col("signature").alias("pattern"), F.col("count_b").alias("count"),
                    F.col("count_a").alias("baseline_count")))


def diff_summary(logs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per capture: period, lines and rate (from the metadata), label keys, error lines (0 if it has no lines)."""
    errors = logs.groupBy("capture").agg(F.count_if(is_error(F.col("msg"))).alias("error_lines"))
    seconds = (F.unix_micros("stopped") - F.unix_micros("started")) / F.lit(1e6)
    return (metadata.select(
                "capture", "started", "stopped", seconds.alias("duration_seconds"),
                F.col("total_lines").alias("lines"),
                F.when(seconds > 0, F.try_divide("total_lines", seconds)).otherwise(F.lit(0.0)).alias("lines_per_sec"),
                F.array_join(F.array_sort("labels_seen"), ";").alias("labels"))
            .join(errors, "capture", "left").withColumn("error_lines", F.coalesce("error_lines", F.lit(0).cast("bigint"))))


def baseline_diff(logs: DataFrame, baseline: str, current: str, fail_on: Sequence[str] = ("regression",)) -> DataFrame:
    """One row: changes, number of new patterns, verdict with confidence, and the gate result."""
    is_sig = F.col("signature").isNotNull()
    new = is_sig & (F.col("count_b") > 0) & ((F.col("count_a") == 0) | (F.col("count_b") > 2 * F.col("count_a")))

    def rate(errors, lines):
        return F.when(F.col(lines) > 0, F.try_divide(errors, lines) * 100).otherwise(F.lit(0.0))

    one = signature_counts(logs, baseline, current).agg(
        *[F.coalesce(F.sum(F.when(cond, F.col(c)).otherwise(0)), F.lit(0)).alias(name) for name, cond, c in (
            ("base_lines", F.lit(True), "count_a"), ("cur_lines", F.lit(True), "count_b"),
            ("base_errors", is_sig, "count_a"), ("cur_errors", is_sig, "count_b"))],
        F.count_if(new).alias("new_patterns"))
    one = (one.withColumn("error_pct", percent_change(rate("base_errors", "base_lines"), rate("cur_errors", "cur_lines")))
           .withColumn("volume_pct", percent_change(F.col("base_lines"), F.col("cur_lines")))
           .withColumn("_v", verdict(F.col("error_pct"), F.col("volume_pct"), F.col("new_patterns") > 0)))
    return one.select(
        F.lit(baseline).alias("baseline"), F.lit(current).alias("current"),
        "base_lines", "cur_lines", "base_errors", "cur_errors", "new_patterns",
        percent_text(F.col("error_pct")).alias("error_rate_change"),
        percent_text(F.col("volume_pct")).alias("volume_change"),
        F.col("_v.verdict").alias("verdict"), F.col("_v.confidence").alias("confidence"),
        F.col("_v.verdict").isin(*fail_on).alias("gate_failed"))
