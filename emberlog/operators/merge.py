"""Merge captures, with clock-skew estimation and correction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from emberlog.functions.messages import is_error, normalize_message
from emberlog.operators.ordering import broadcast_if_small, upper_median

# Fixed values. A larger offset is taken for something else than skew, and not corrected.
MAX_SKEW_MS = 60_000
FALLBACK_CONFIDENCE = 0.3
OFFSET_SLICE_US = 1_000_000


def merge(*captures: DataFrame) -> DataFrame:
    """All entries of all captures; the ``capture`` column keeps equal file names apart."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), captures)


def shift_time(ts: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def detect_skew(logs: DataFrame, max_skew_ms: int = MAX_SKEW_MS) -> DataFrame:
    """Clock offset of every capture against the one with most lines (of equals: the first).

    Offset = upper median of first-seen differences over shared error signatures, or the
    difference of the starts when none is shared. ``applied`` is false for offsets above ``max_skew_ms``,
    and where no offset can be told."""
    # One pass: first time and lines per capture and signature; non-errors share the null
    # signature. Line counts, starts and signature times all follow from this table.
    signature = F.when(is_error(F.col("msg")), normalize_message(F.col("msg")))
    seen = (logs.groupBy("capture", signature.alias("signature"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"))).persist()
    sources = seen.groupBy("capture").agg(F.sum("n").alias("lines"), F.min("first_seen").alias("started"))
    ref = sources.orderBy(F.desc("lines"), "capture").first()  # one row: the reference clock
    if ref is None:
        ref = Row(capture="", started=None)
    first = seen.where("signature is not null").select("capture", "signature", "first_seen")
    is_ref = F.col("capture") == ref["capture"]
    ref_first = first.where(is_ref).select("signature", F.col("first_seen").alias("ref_seen"))
    offsets = (first.where(~is_ref).join(ref_first, "signature")
               .select("capture", (F.unix_micros("ref_seen") - F.unix_micros("first_seen")).alias("offset")))
    medians = upper_median(offsets, ["capture"], "offset", OFFSET_SLICE_US)
    shared = F.col("n").isNotNull()
    fallback = F.unix_micros(F.lit(ref["started"]).cast("timestamp")) - F.unix_micros("started")
    return (sources.where(~is_ref)
            .join(medians, "capture", "left")
            .withColumn("offset_us", F.when(shared, F.col("median")).otherwise(fallback))
            .select("capture", F.expr("offset_us div 1000").alias("offset_ms"),
                    F.when(shared, F.round(F.greatest(F.lit(0.5), F.least(F.col("n") / 5, F.lit(1.0))), 2))
                    .otherwise(F.lit(FALLBACK_CONFIDENCE)).alias("confidence"),
                    F.when(shared, "error_signature").otherwise("metadata_overlap").alias("method"),
                    F.coalesce(F.abs("offset_us") <= max_skew_ms * 1000, F.lit(False)).alias("applied")))


def merge_corrected(logs: DataFrame, skew: DataFrame | None = None) -> DataFrame:
    """Entries with the clock of every skewed capture put right."""
    skew = detect_skew(logs) if skew is None else skew
    offsets = broadcast_if_small(
        logs.sparkSession, skew.where("applied").select("capture", (F.col("offset_ms") * 1000).alias("_offset")))
    return (logs.join(offsets, "capture", "left")
            .withColumn("ts", shift_time(F.col("ts"), F.coalesce("_offset", F.lit(0))))
            .drop("_offset"))


def merge_metadata(metadata: DataFrame, index: DataFrame) -> DataFrame:
    """One record for the merged capture. The first index row gives the start, and the last
    one may move the stop later; without an index the metadata decide."""
    first = index.agg(F.min("from"))
    last = index.agg(F.max_by("to", F.struct("from", "to")))
    keys = (metadata.select(F.explode("labels_seen").alias("key"))
            .union(index.select(F.explode(F.map_keys("labels")).alias("key")))
            .agg(F.array_sort(F.collect_set("key"))))
    total = metadata.agg(
        F.min("started").alias("_started"), F.max("stopped").alias("_stopped"),
        F.sum("total_lines").alias("total_lines"), F.sum("total_bytes").alias("total_bytes"),
        F.coalesce(F.bool_or("redaction.enabled"), F.lit(False)).alias("redacted"))
    return total.select(
        F.lit(1).alias("version"), F.lit("jsonl").alias("format"),
        F.coalesce(first.scalar(), "_started").alias("started"),
        F.greatest(F.col("_stopped"), last.scalar()).alias("stopped"),
        "total_lines", "total_bytes", keys.scalar().alias("labels_seen"), "redacted")
