"""Ordered computations that never bring a whole group into one task.

A running total or rank over a long group is taken in two levels: per slice of the order
(a second, a day, a million lines), and then within each slice. Only the one-row-per-slice
totals are ever summed in a single ordered pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from emberlog.session import scratch_dir

# Rows of a side that may be broadcast after it has been counted.
BROADCAST_ROWS = 250_000


def running_total(df: DataFrame, value: Column, order: Sequence[Column | str], slice_by: Column,
                  keys: Sequence[str] = (), out: str = "running") -> DataFrame:
    """Running sum of ``value`` in ``order`` within ``keys``, the current row included.

    ``slice_by`` must be coarser than ``order`` and grow with it."""
    keys = list(keys)
    # A struct is never null, so rows without an order value keep a slice of their own.
    df = df.withColumn("_slice", F.struct(slice_by.alias("at"))).withColumn("_value", value.cast("bigint"))
    sums = df.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # Kept, as a result is often used more than once: one short row per slice.
    sums = sums.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")).persist()
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(sums, [*keys, "_slice"])
            .withColumn(out, F.col("_before") + F.sum("_value").over(inside))
            .drop("_slice", "_value", "_before"))


def number_rows(df: DataFrame, order: Sequence[Column | str], slice_by: Column,
                keys: Sequence[str] = (), out: str = "line_no") -> DataFrame:
    """1, 2, 3, ... in ``order`` within ``keys``."""
    return running_total(df, F.lit(1), order, slice_by, keys, out)


def with_previous(df: DataFrame, columns: Sequence[str], order: str, slice_by: Column,
                  keys: Sequence[str] = (), out: str = "previous") -> DataFrame:
    """Add a struct with the ``columns`` of the row before in ``order`` (null at the first).

    Within a slice that is a plain lag; the first row of a slice takes the last row of the
    slice before, of which there is one per slice."""
    keys = list(keys)
    df = df.withColumn("_row", F.struct(*columns)).withColumn("_slice", F.struct(slice_by.alias("at")))
    lasts = df.groupBy(*keys, "_slice").agg(F.max_by("_row", order).alias("_end"))
    over_slices = Window.partitionBy(*keys).orderBy("_slice")
    lasts = lasts.select(*keys, "_slice", F.lag("_end").over(over_slices).alias("_carried"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (df.join(lasts, [*keys, "_slice"])
            .withColumn(out, F.coalesce(F.lag("_row").over(inside), "_carried"))
            .drop("_row", "_slice", "_carried"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, slice_width: int) -> DataFrame:
    """Per key: ``sorted[n div 2]`` of a bigint column and n.

    Equal values are counted first; the slice that holds the median is found from the
    slice counts, and only that slice is ordered value by value."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).persist()
    counts = counts.withColumn("_slice", F.floor(F.col(value) / slice_width))
    slices = counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    slices = (slices
              .withColumn("_cum", F.sum("_n").over(upto))
              .withColumn("n", F.sum("_n").over(everything))
              .withColumn("_rank", F.expr("n div 2 + 1"))
              .where("_cum >= _rank and _cum - _n < _rank")
              .select(*keys, "_slice", "n", (F.col("_rank") - (F.col("_cum") - F.col("_n"))).alias("_rank")))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.join(slices, [*keys, "_slice"])
            .withColumn("_cum", F.sum("_n").over(inside))
            .where("_cum >= _rank and _cum - _n < _rank")
            .select(*keys, F.col(value).alias("median"), "n"))


def semi_join_small(df: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys are among the ``few``, such as the files an index selects. The
    big side is shuffled only if the few turn out to be many."""
    return df.join(broadcast_if_small(df.sparkSession, few), list(keys), "left_semi")


def broadcast_if_small(spark: SparkSession, df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Run ``df`` once. If it has at most ``max_rows`` rows, return those rows marked for
    broadcast; otherwise return ``df`` itself, for an ordinary shuffled join."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(spark.createDataFrame(rows, df.schema))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a short table into the shared folder once and read it back. All that uses it reads the files, an
    executor's loss costs nothing, and joins are planned by its true size in bytes."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- the first row of each group, without text in the aggregation -------------------------
# An aggregation whose buffers are all of fixed width is a hash aggregation; a text in it (min_by of a
# message) makes Spark sort all rows. So the first place is aggregated, and the text fetched for it.

def _place(df: DataFrame, order: Sequence[str]) -> tuple[list[str], Column]:
    """Leading text columns of an order, and the first other column as a number; null comes last."""
    types = {f.name: f.dataType for f in df.schema.fields}
    lead = []
    for name in order:
        if isinstance(types[name], T.StringType):
            lead.append(name)
            continue
        time = isinstance(types[name], (T.TimestampType, T.TimestampNTZType))
        number = F.unix_micros(F.col(name).cast("timestamp")) if time else F.col(name).cast("bigint")
        return lead, F.coalesce(number, F.lit((1 << 63) - 1))
    return lead, F.lit(0).cast("bigint")


def first_places(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: str = "count", **least: str) -> DataFrame:
    """Per key: the number of rows as ``count``, the least of other columns (``name="column"``), and the place
    of the first row: the leading text columns of ``order`` and ``_at``."""
    lead, at = _place(df, order)
    groups = df.withColumn("_at", at).groupBy(*keys, *lead).agg(
        F.count(F.lit(1)).alias(count), *(F.min(c).alias(n) for n, c in least.items()), F.min("_at").alias("_at"))
    if not lead:
        return groups
    # One row per key and file, say: the texts are ordered there, not row by row.
    own = Window.partitionBy(*keys)
    return (groups.withColumns({count: F.sum(count).over(own), **{n: F.min(n).over(own) for n in least}})
            .withColumn("_rank", F.row_number().over(own.orderBy(*lead, "_at"))).where("_rank = 1").drop("_rank"))


def at_places(df: DataFrame, places: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows of ``df`` at any of the ``places`` of :func:`first_places`, whatever their key: few, and found
    before their texts are looked at. ``_at`` is added."""
    lead, at = _place(df, order)
    return df.withColumn("_at", at).join(places.select(*lead, "_at"), [*lead, "_at"], "left_semi")


def with_first(places: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """``places`` with ``columns`` (name: column of ``rows``) of the first row of each key. ``rows`` are those of
    :func:`at_places` with the keys. Of rows at one place the rest of the order decides."""
    lead, _ = _place(rows, order)
    here = [*keys, *lead, "_at"]
    first = F.row_number().over(Window.partitionBy(*here).orderBy(*order))
    found = rows.withColumn("_rank", first).where("_rank = 1").select(*here, *(F.col(c).alias(n) for n, c in columns.items()))
    return places.join(found, here, "left")
