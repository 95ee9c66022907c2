"""Error triage: totals, minute histogram, signatures, talkers and time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from emberlog.functions.messages import is_error, is_error_once, normalize_message
from emberlog.operators.ordering import at_places, first_places, with_first

# The usual sizes of the lists.
MAX_SIGNATURES = 10_000
TOP_ERRORS = 50
PEAK_MINUTES = 5
MIN_STEADY_MINUTES = 3
CHRONOLOGICAL = ("ts", "file", "line_no")


def totals(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total_lines"),
                    F.count_if(is_error(F.col("msg"))).alias("error_lines"))


def minute_counts(logs: DataFrame) -> DataFrame:
    return (logs.groupBy(F.date_trunc("minute", "ts").alias("minute"))
            .agg(F.count(F.lit(1)).alias("total_lines"),
                 F.count_if(is_error(F.col("msg"))).alias("error_lines")))


def error_timeline(logs: DataFrame, max_buckets: int | None = None) -> DataFrame:
    """Every minute from the first to the last, zero-filled; ``max_buckets`` asks for the first so many only.

    The logs are read once. The window runs over the minute counts (1440 a day, whatever
    the volume); each minute then fills the gap up to the next one, day by day, so that
    a gap of years takes no more memory than one of hours. Entries without a time have no minute."""
    by_minute = Window.orderBy("minute")
    one, day = F.expr("interval 1 minute"), F.expr("interval 1 day")
    minutes = (minute_counts(logs).where("minute is not null")
               .withColumn("_upto", F.coalesce(F.lead("minute").over(by_minute) - one, F.col("minute"))))
    if max_buckets is not None:
        end = F.min("minute").over(by_minute) + F.make_dt_interval(mins=F.lit(max_buckets - 1))
        minutes = minutes.withColumn("_end", end).where("minute <= _end").withColumn("_upto", F.least("_upto", "_end"))
    days = minutes.select("total_lines", "error_lines", "_upto", F.col("minute").alias("_at"),
                          F.explode(F.sequence("minute", "_upto", day)).alias("_day"))
    here = F.col("minute") == F.col("_at")
    return (days
            .select("*", F.explode(F.sequence("_day", F.least("_upto", F.col("_day") + day - one), one)).alias("minute"))
            .select("minute",
                    F.when(here, F.col("total_lines")).otherwise(F.lit(0)).alias("total_lines"),
                    F.when(here, F.col("error_lines")).otherwise(F.lit(0)).alias("error_lines")))


def signature_places(logs: DataFrame, order: Sequence[str] = CHRONOLOGICAL, keys: Sequence[str] = ()) -> DataFrame:
    """Per signature (and key): count, first_seen, and the place of the earliest entry, for examples to be
    fetched by. One hash aggregation."""
    errors = logs.where(is_error_once(F.col("msg"))).withColumn("signature", normalize_message(F.col("msg")))
    return first_places(errors, [*keys, "signature"], order, first_seen="ts")


def with_examples(logs: DataFrame, signatures: DataFrame, order: Sequence[str] = CHRONOLOGICAL, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of :func:`signature_places` with the message of the earliest entry as ``example``. Only entries at
    one of the places are normalised again. An entry without a time counts as the latest."""
    few = at_places(logs, signatures, order).where(is_error_once(F.col("msg"))).withColumn("signature", normalize_message(F.col("msg")))
    return with_first(signatures, few, [*keys, "signature"], order, {"example": "msg"})


def error_signatures(logs: DataFrame, order: Sequence[str] = CHRONOLOGICAL, keys: Sequence[str] = ()) -> DataFrame:
    """Per signature (and key): count, first_seen, and the message of the earliest entry."""
    return with_examples(logs, signature_places(logs, order, keys), order, keys).select(*keys, "signature", "count", "first_seen", "example")


def signature_starts(logs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Like error_signatures without examples."""
    return (logs.where(is_error_once(F.col("msg")))
            .groupBy(*keys, normalize_message(F.col("msg")).alias("signature"))
            .agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen")))


def signature_cap(signatures: DataFrame, cap: int = MAX_SIGNATURES) -> DataFrame:
    """The most frequent ``cap`` signatures."""
    return signatures.orderBy(F.desc("count"), "signature").limit(cap)


def top_errors(signatures: DataFrame, top: int = TOP_ERRORS, logs: DataFrame | None = None, order: Sequence[str] = CHRONOLOGICAL) -> DataFrame:
    """The most frequent signatures and their share of all error lines.

    With ``logs``, ``signatures`` are those of :func:`signature_places`, and examples are fetched for the
    top ones only."""
    total = signatures.agg(F.sum("count"))
    best = signature_cap(signatures, top).withColumn("pct_of_errors", F.col("count") / total.scalar() * 100)
    if logs is not None:
        best = with_examples(logs, best, order)
    return best.select("signature", "count", "first_seen", "example", "pct_of_errors")


def talkers(logs: DataFrame) -> DataFrame:
    """Volume and errors per label key and value."""
    return (logs.select(F.explode("labels").alias("key", "value"), is_error(F.col("msg")).alias("_err"))
            .groupBy("key", "value")
            .agg(F.count(F.lit(1)).alias("total_lines"), F.count_if("_err").alias("error_lines")))


def first_seen_by_minute(signatures: DataFrame) -> DataFrame:
    return (signatures.groupBy(F.date_trunc("minute", "first_seen").alias("minute"))
            .agg(F.count(F.lit(1)).alias("new_signatures")))


# The windows below run over one timeline: 1440 short rows a day, whatever the volume.

def _window_row(df: DataFrame, name: str, minutes, value) -> DataFrame:
    return df.select(F.lit(name).alias("window"), F.col("_from").alias("from"),
                     F.col("_to").alias("to"), minutes.cast("bigint").alias("minutes"),
                     value.cast("bigint").alias("value"))


def peak_error_window(timeline: DataFrame, size: int = PEAK_MINUTES) -> DataFrame:
    """The ``size`` minutes in a row with the most errors, the earliest of equals; a shorter
    timeline counts as a whole. No row if there are no errors."""
    sliding = Window.orderBy("minute").rowsBetween(-(size - 1), 0)
    whole = Window.partitionBy()
    best = (timeline
            .withColumn("_from", F.min("minute").over(sliding))
            .withColumn("_sum", F.sum("error_lines").over(sliding))
            .withColumn("_len", F.count(F.lit(1)).over(sliding))
            .withColumn("_size", F.least(F.lit(size), F.count(F.lit(1)).over(whole)))
            .where("_len = _size and _sum > 0")
            .withColumn("_to", F.col("minute") + F.expr("interval 1 minute"))
            .orderBy(F.desc("_sum"), "_from").limit(1))
    return _window_row(best, "peak_error", F.col("_size"), F.col("_sum"))


def incident_start(signatures: DataFrame) -> DataFrame:
    """The minute in which most signatures were seen for the first time."""
    best = (first_seen_by_minute(signatures).orderBy(F.desc("new_signatures"), "minute").limit(1)
            .withColumn("_from", F.col("minute")).withColumn("_to", F.col("minute") + F.expr("interval 1 minute")))
    return _window_row(best, "incident_start", F.lit(1), F.col("new_signatures"))


def steady_state_window(timeline: DataFrame, min_minutes: int = MIN_STEADY_MINUTES) -> DataFrame:
    """The longest run of minutes with at most the (upper) median of errors; value = that median."""
    by_minute = Window.orderBy("minute")
    ranked = (timeline
              .withColumn("_rank", F.row_number().over(Window.orderBy("error_lines", "minute")))
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
              .withColumn("_median", F.max(F.expr("case when _rank = _n div 2 + 1 then error_lines end"))
                          .over(Window.partitionBy()))
              .withColumn("_pos", F.row_number().over(by_minute))
              .where("error_lines <= _median"))
    best = (ranked
            .withColumn("_run", F.col("_pos") - F.row_number().over(by_minute))
            .groupBy("_run")
            .agg(F.min("minute").alias("_from"), F.max("minute").alias("_last"),
                 F.count(F.lit(1)).alias("_len"), F.max("_median").alias("_median"))
            .where(F.col("_len") >= min_minutes)
            .withColumn("_to", F.col("_last") + F.expr("interval 1 minute"))
            .orderBy(F.desc("_len"), "_from").limit(1))
    return _window_row(best, "steady_state", F.col("_len"), F.col("_median"))


def windows(timeline: DataFrame, signatures: DataFrame) -> DataFrame:
    return (peak_error_window(timeline).unionByName(incident_start(signatures))
            .unionByName(steady_state_window(timeline)))
