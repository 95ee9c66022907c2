"""Which captures or files to delete."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from emberlog.operators.ordering import running_total

DISK_WARNING = 0.8  # fixed value: warn above this share of the cap


def retention_plan(captures: DataFrame, now: datetime, max_age: timedelta | None = None,
                   max_bytes: int | None = None) -> DataFrame:
    """Captures (``dir``, ``started``, ``bytes``) to delete, with the reason: those started
    before ``now - max_age``; then, oldest first, until the rest fits ``max_bytes``."""
    if max_age is None and max_bytes is None:
        raise ValueError("give max_age, max_bytes or both")
    expired = (F.col("started") < F.lit(now - max_age)) if max_age is not None else F.lit(False)
    marked = captures.select("dir", "started", "bytes", F.coalesce(expired, F.lit(False)).alias("_expired"))
    by_age = marked.where("_expired").select("dir", "started", "bytes", F.lit("max-age").alias("reason"))
    if max_bytes is None:
        return by_age
    left = marked.where("not _expired").drop("_expired")
    total = left.agg(F.coalesce(F.sum("bytes"), F.lit(0)))
    by_size = (running_total(left, F.col("bytes"), ["started", "dir"], F.date_trunc("day", "started"), out="_upto")
               .where(total.scalar() - (F.col("_upto") - F.col("bytes")) > max_bytes)
               .select("dir", "started", "bytes", F.lit("max-total").alias("reason")))
    return by_age.unionByName(by_size)


def disk_cap_plan(files: DataFrame, cap: int, overhead: int = 0) -> DataFrame:
    """Data files (``file``, ``bytes``) to delete, oldest name first, until the usage fits.
    ``overhead`` is the size of the files that are never deleted."""
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)) + overhead)
    # File names start with their date, YYYY-MM-DD.
    return (running_total(files, F.col("bytes"), ["file"], F.substring("file", 1, 10), out="_upto")
            .where(total.scalar() - (F.col("_upto") - F.col("bytes")) > cap)
            .select("file", "bytes"))


def disk_usage(files: DataFrame, cap: int) -> DataFrame:
    """Usage, cap, and whether the warning level is passed."""
    used = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("disk_usage"))
    return used.select("disk_usage", F.lit(cap).cast("bigint").alias("disk_cap"),
                       (F.col("disk_usage") > int(cap * DISK_WARNING)).alias("warning"))
