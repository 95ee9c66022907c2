"""Merged captures stored as a manifest: a list of files with a time offset each, no data rewritten.

``<path>/files`` has a row per part and file (root, capture, file, offset); ``<path>/index`` and
``<path>/metadata`` are those of an ordinary capture, with the times moved by the offsets. So an index-only
question costs what it costs on any capture, and readers apply the offset to each entry.
A merged capture can be part of another: its files are taken over, offsets added.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.operators.filters import file_may_match
from emberlog.operators.merge import merge_metadata, shift_time
from emberlog.sources.captures import full_index, parse_entries, read_index, read_lines_of, read_metadata
from emberlog.sources.sinks import TIMES

MANIFEST = "root string, source_capture string, source_file string, file string, offset_us bigint"


class Part(NamedTuple):
    """Captures below ``root`` (one of them, or all) and what is added to their times."""

    root: str
    capture: str | None = None
    offset: timedelta = timedelta()


def parts_of(root: str, skew: DataFrame, captures: Iterable[str]) -> list[Part]:
    """Parts for the captures below ``root`` with the clocks that ``detect_skew`` found applied. One row per capture."""
    late = {r["capture"]: r["offset_ms"] for r in skew.where("applied").select("capture", "offset_ms").collect()}
    return [Part(root, c, timedelta(milliseconds=late.get(c, 0))) for c in captures]


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/files")


def _moved(ts: str) -> Column:
    return shift_time(F.col(ts), F.col("offset_us"))


def _files_of(spark: SparkSession, number: int, part: Part) -> DataFrame:
    """Index rows of a part with their source; file names get the part's number, which keeps equal ones apart."""
    micros = part.offset // timedelta(microseconds=1)
    merged = spark._jvm.org.apache.hadoop.fs.Path(f"{part.root}/files")
    if merged.getFileSystem(spark._jsc.hadoopConfiguration()).exists(merged):
        rows = read_index(spark, part.root).drop("capture").join(_manifest(spark, part.root), "file")
        # Its index has the manifest's offsets in it already.
        rows = rows.withColumns({"carried": F.col("offset_us"), "offset_us": F.lit(micros)})
    else:
        rows = full_index(spark, part.root)
        if part.capture is not None:
            rows = rows.where(F.col("capture") == part.capture)
        rows = rows.select(F.lit(part.root).alias("root"), F.col("capture").alias("source_capture"), F.col("file").alias("source_file"), *(
            c for c in rows.columns if c not in ("capture", "file")), F.lit(0).cast("bigint").alias("carried"), F.lit(micros).alias("offset_us"))
    name = F.concat(F.format_string("%05d", F.lit(number)), F.lit("~"), F.xxhash64("root", "source_capture", "carried").cast("string"), F.lit("~"), F.col("source_file"))
    return rows.select("root", "source_capture", "source_file", name.alias("file"), _moved("from").alias("from"), _moved("to").alias("to"), "lines", "bytes",
                       "labels", (F.col("carried") + F.col("offset_us")).alias("offset_us"))


def write_merged(spark: SparkSession, path: str, parts: Iterable[Part]) -> None:
    """Store the merged capture of all parts below ``path``. Only index rows are written. No part is an error."""
    parts = list(parts)
    if not parts:
        raise ValueError("nothing to merge")
    rows = reduce(DataFrame.unionByName, [_files_of(spark, i, p) for i, p in enumerate(parts)])
    rows.select("root", "source_capture", "source_file", "file", "offset_us").write.parquet(f"{path}/files")
    index = rows.select("file", "from", "to", "lines", "bytes", "labels")
    index.write.option("timestampFormat", TIMES).json(f"{path}/index")
    records = reduce(DataFrame.unionByName, [_record(spark, p) for p in parts])
    merged = merge_metadata(records, read_index(spark, path))
    redaction = F.struct(F.col("redacted").alias("enabled"), F.array().cast("array<string>").alias("patterns"))
    (merged.withColumn("redaction", redaction).drop("redacted").coalesce(1)
     .write.option("timestampFormat", TIMES).json(f"{path}/metadata"))


def _record(spark: SparkSession, part: Part) -> DataFrame:
    rows = read_metadata(spark, part.root)
    if part.capture is not None:
        rows = rows.where(F.col("capture") == part.capture)
    rows = rows.withColumn("offset_us", F.lit(part.offset // timedelta(microseconds=1)))
    return rows.withColumns({"started": _moved("started"), "stopped": _moved("stopped")}).drop("offset_us")


def read_merged(spark: SparkSession, path: str, frm: datetime | None = None, to: datetime | None = None, labels=None) -> DataFrame:
    """Entries of a merged capture with their corrected times: ts, labels, msg, raw_bytes, source_capture, file, block.

    Bounds and labels leave out files by the moved index, before they are opened; filtering the entries is left to the
    caller. A file that two parts share gives its entries once for each."""
    files = _manifest(spark, path)
    if frm is not None or to is not None or labels:
        ruled_out = read_index(spark, path).where(~F.coalesce(file_may_match(frm, to, labels), F.lit(True)))
        files = files.join(ruled_out.select("file"), "file", "left_anti")
    found = []
    for (root,) in _manifest(spark, path).select("root").distinct().collect():  # one for each place that was merged
        own = files.where(F.col("root") == root).select(F.col("source_capture").alias("capture"), F.col("source_file").alias("_source"), F.col("file").alias("_file"), "offset_us")
        lines = read_lines_of(spark, root, own.select("capture", F.col("_source").alias("file")))
        found.append(parse_entries(lines).withColumnRenamed("file", "_source").join(F.broadcast(own), ["capture", "_source"])
                     .select(_moved("ts").alias("ts"), "labels", "msg", "raw_bytes", F.col("capture").alias("source_capture"), F.col("_file").alias("file"), "block"))
    return reduce(DataFrame.unionByName, found)
