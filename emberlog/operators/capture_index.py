"""The per-file index of a capture, and the questions it answers without reading the data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

# Bucket widths by length of the period (below -> width).
WIDTHS = (
    (timedelta(hours=2), timedelta(minutes=1)),
    (timedelta(hours=12), timedelta(minutes=5)),
    (timedelta(days=3), timedelta(minutes=15)),
    (timedelta(days=7), timedelta(hours=1)),
)
WIDEST = timedelta(hours=4)


def build_index(logs: DataFrame, size: Column | None = None, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Per file: first and last time, lines, bytes, and label -> value -> count.

    The logs are read once: each entry is exploded to one row for itself (null label) and
    one per label, and counted map-side. Files are then put together from those counts,
    of which a file has as many as it has distinct labels."""
    keys = list(keys)
    size = F.octet_length("msg") if size is None else size
    itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    labels = F.coalesce(F.map_entries("labels"), F.filter(itself, lambda e: F.lit(False)))
    counts = (logs.select(*keys, "ts", size.cast("bigint").alias("_size"), F.inline(F.concat(itself, labels)))
              # A label may be there without a value; that counts as the empty one.
              .withColumn("value", F.when(F.col("key").isNotNull(), F.coalesce("value", F.lit(""))))
              .groupBy(*keys, "key", "value")
              .agg(F.min("ts").alias("from"), F.max("ts").alias("to"),
                   F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes")))
    by_key = counts.groupBy(*keys, "key").agg(
        F.min("from").alias("from"), F.max("to").alias("to"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"),
        F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("value", "n")))).alias("values"))
    stats = F.col("key").isNull()
    return by_key.groupBy(*keys).agg(
        F.max(F.when(stats, F.col("from"))).alias("from"), F.max(F.when(stats, F.col("to"))).alias("to"),
        F.max(F.when(stats, F.col("n"))).alias("lines"), F.max(F.when(stats, F.col("bytes"))).alias("bytes"),
        F.map_from_entries(F.collect_list(F.when(~stats, F.struct("key", "values")))).alias("labels"))


def build_metadata(index: DataFrame, redaction: Sequence[str] | None = None,
                   keys: Sequence[str] = ("capture",)) -> DataFrame:
    """The session record of each capture, from its index."""
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("labels")))))
    red = F.struct(F.lit(redaction is not None).alias("enabled"),
                   F.array(*[F.lit(p) for p in redaction or ()]).cast("array<string>").alias("patterns"))
    return index.groupBy(*keys).agg(
        F.lit(1).alias("version"), F.lit("jsonl").alias("format"),
        F.min("from").alias("started"), F.max("to").alias("stopped"),
        F.sum("lines").alias("total_lines"), F.sum("bytes").alias("total_bytes"),
        found.alias("labels_seen")).withColumn("redaction", red)


def label_rows(index: DataFrame) -> DataFrame:
    """One row per file, label key and value."""
    return (index.select("*", F.explode("labels").alias("key", "_values"))
            .select("*", F.explode("_values").alias("value", "count")).drop("labels", "_values"))


def service_summary(index: DataFrame) -> DataFrame:
    """Lines per value of the label key with most distinct values (of equals: the first key)."""
    values = label_rows(index).groupBy("key", "value").agg(F.sum("count").alias("lines"))
    # The number of keys is small; only the best key's name is looked up.
    best = (values.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "key").limit(1)
            .select("key"))
    return values.where(F.col("key") == best.scalar()).select(F.col("key").alias("label"), "value", "lines")


def label_breakdown(index: DataFrame) -> DataFrame:
    """Lines per label key and value, and their share of each file's bytes (whole numbers per file)."""
    return (label_rows(index).groupBy("key", "value")
            .agg(F.sum("count").alias("lines"),
                 F.sum(F.expr("case when lines > 0 then bytes * count div lines else 0 end")).alias("bytes")))


def report_labels(index: DataFrame) -> DataFrame:
    """Distinct values per label key."""
    return label_rows(index).groupBy("key").agg(F.count_distinct("value").alias("values"))


def orphan_files(files: DataFrame, index: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Data files that the index does not know."""
    return files.join(index, list(keys), "left_anti")


def line_totals(index: DataFrame, orphan_lines: DataFrame) -> DataFrame:
    """Lines of the indexed files plus those counted in the orphans."""
    return (index.select(F.col("lines").alias("n"))
            .unionByName(orphan_lines.agg(F.count(F.lit(1)).alias("n")))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines")))


def capture_summary(index: DataFrame, metadata: DataFrame, files: DataFrame | None = None,
                    keys: Sequence[str] = ("capture",)) -> DataFrame:
    """Per capture: files, lines, bytes, data period and rate over the effective period, which
    is that of the metadata or else of the data. ``files`` (with ``bytes``) gives disk sizes."""
    keys = list(keys)
    data = index.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("total_lines"), F.sum("bytes").alias("total_bytes"),
        F.min("from").alias("data_from"), F.max("to").alias("data_to"))
    df = metadata.select(*keys, "started", "stopped").join(data, keys, "left")
    if files is not None:
        disk = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("disk_size"))
        df = df.drop("files").join(disk, keys, "left")
    seconds = (F.unix_micros(F.coalesce("stopped", "data_to"))
               - F.unix_micros(F.coalesce("started", "data_from"))) / F.lit(1e6)
    return df.withColumn("lines_per_sec", F.when(seconds > 0, F.try_divide("total_lines", seconds)).otherwise(F.lit(0.0)))


def bucket_seconds(length: Column) -> Column:
    """Bucket width in seconds for a period of ``length`` seconds."""
    width = F
    for below, size in WIDTHS:
        width = width.when(length < below.total_seconds(), int(size.total_seconds()))
    return width.otherwise(int(WIDEST.total_seconds()))


def capture_timeline(index: DataFrame, keys: Sequence[str] = ("capture",)) -> DataFrame:
    """Lines over time from the index alone: the lines of each file are spread evenly over the
    buckets it touches, the remainder going to the first ones. Empty buckets are listed too."""
    keys = list(keys)
    periods = index.groupBy(*keys).agg(F.min("from").alias("_min"), F.max("to").alias("_max"))
    secs = F.unix_seconds

    def floor_to(t):
        return F.expr(f"{t} - mod({t}, width)")

    spans = (index.join(periods, keys)
             .withColumn("width", bucket_seconds((F.unix_micros("_max") - F.unix_micros("_min")) / 1e6).cast("bigint"))
             .withColumn("_from", secs("from")).withColumn("_to", secs("to"))
             .withColumn("_start", secs("_min")).withColumn("_stop", secs("_max"))
             .withColumn("_start", floor_to("_start"))
             .withColumn("_limit", floor_to("_stop"))
             .withColumn("_first", F.greatest(floor_to("_from"), F.col("_start")))
             .withColumn("_last", F.least(floor_to("_to"), F.col("_limit"))))
    spread = (spans.where("lines > 0 and _first <= _last")
              .withColumn("_span", F.expr("(_last - _first) div width + 1"))
              .select(*keys, "lines", "_span", F.posexplode(F.expr("sequence(_first, _last, width)")).alias("_i", "bucket"))
              .select(*keys, "bucket", F.expr("lines div _span + if(_i < lines % _span, 1, 0)").alias("lines")))
    # One row per capture gives the grid: six buckets a day once the period is long.
    grid = (spans.groupBy(*keys).agg(F.max("_start").alias("_start"), F.max("_limit").alias("_limit"),
                                     F.max("width").alias("width"))
            .select(*keys, F.explode(F.expr("sequence(_start, _limit, width)")).alias("bucket"),
                    F.lit(0).cast("bigint").alias("lines")))
    return (spread.unionByName(grid).groupBy(*keys, "bucket").agg(F.sum("lines").alias("lines"))
            .select(*keys, F.timestamp_seconds("bucket").alias("time"), "lines"))


def share_of_total(counts: DataFrame, value: str) -> DataFrame:
    """Percentage of the column's total; meant for short lists such as services."""
    return counts.withColumn("pct", F.try_divide(F.col(value) * 100.0, F.sum(value).over(Window.partitionBy())))
