"""Write captures and exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from emberlog.functions.labels import flatten_labels
from emberlog.functions.messages import rfc3339
from emberlog.operators.capture_index import build_index, build_metadata
from emberlog.operators.filters import filter_logs, slice_logs
from emberlog.operators.ordering import kept
from emberlog.sources.captures import parse_all_lines, read_index, read_lines, read_metadata

TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
MAX_FILE_BYTES = 256 << 20
MAX_FILE_ENTRIES = 10_000_000
#: Bytes that a task should sort at least.
MIN_RUN_BYTES = 1 << 20


def _wire(logs: DataFrame, *more: str) -> DataFrame:
    return logs.select(rfc3339(F.col("ts")).alias("ts"), "labels", "msg", *more)


def _segmented(logs: DataFrame, keys: Sequence[str], order: Sequence[str], max_bytes: int, max_entries: int) -> DataFrame:
    """Stored lines (``value``) with the file they go to (``seg``): in order of time, no file over ``max_bytes`` or
    ``max_entries`` (a single longer line has a file of its own size).

    Bytes are summed by minute first. Minutes make runs of at most about a file each, and one that is heavier
    is cut into parts by time; a run is one task's work. In it the running total of bytes chooses the file.
    The capture is part of the name, which so chooses a single file among all captures. Equal places are told apart by the line, so that lines go to the same files whenever this is evaluated."""
    own = list(dict.fromkeys([*keys, "ts", *order]))
    line = F.to_json(F.struct(rfc3339(F.col("ts")).alias("ts"), "labels", "msg"))
    lines = (logs.select(*own, "labels", line.alias("value"))
             .withColumns({"_size": F.octet_length("value") + 1, "_tie": F.xxhash64("value"),
                           "_minute": F.coalesce(F.expr("unix_micros(ts) div 60000000"), F.lit(-1 << 60))}))
    minutes = lines.groupBy(*keys, "_minute").agg(F.sum("_size").alias("_bytes"), F.max("_size").alias("_longest"))
    before = Window.partitionBy(*keys).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    share = F.expr(f"greatest(least({max_bytes}, sum(_bytes) over () div {logs.sparkSession.sparkContext.defaultParallelism}), least({MIN_RUN_BYTES}, {max_bytes}))")
    # One short row per minute, whatever the volume.
    minutes = (minutes.withColumns({"_share": share, "_before": F.coalesce(F.sum("_bytes").over(before), F.lit(0))})
               .withColumns({"_run": F.expr("_before div _share"), "_parts": F.expr("(_bytes - 1) div _share + 1")})
               .withColumn("_longest", F.max("_longest").over(Window.partitionBy(*keys, "_run")))
               .select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("_minute").alias("_at"), "_run", "_parts", "_longest"))
    here = F.col("_minute") == F.col("_at")
    for c in keys:
        here = here & F.col(c).eqNullSafe(F.col(f"_{c}"))
    part = F.expr("if(_parts > 1 and ts is not null, pmod(unix_micros(ts), 60000000) * _parts div 60000000, 0)")
    placed = lines.join(kept(minutes, "capture-minutes"), here).withColumn("_part", part)
    upto = Window.partitionBy(*keys, "_run", "_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    room = F.expr(f"if(_longest < {max_bytes}, {max_bytes} - _longest, {max_bytes})")
    piece = F.expr("(_upto - 1) div _room") + F.expr(f"(_row - 1) div {max_entries}")
    return (placed.withColumns({"_upto": F.sum("_size").over(upto), "_row": F.row_number().over(upto), "_room": room})
            .withColumn("seg", F.format_string("s%08d-%05d-%06d-%08x", "_run", "_part", piece, F.hash(*keys) if keys else F.lit(0))))


def _write(logs: DataFrame, path: str, data: str, keys: Sequence[str], order: Sequence[str], max_bytes: int, max_entries: int,
           redaction: Sequence[str] | None, compression: str, mode: str) -> None:
    """Data, index and session record. The index is counted from the lines as they are written, not from the files:
    a second pass that leaves the messages behind."""
    spark, keys = logs.sparkSession, list(keys)
    placed = _segmented(logs, keys, order, max_bytes, max_entries)
    lines = placed.sortWithinPartitions(*keys, "seg", *order, "_tie").select("value", *keys, "seg")
    lines.write.mode(mode).option("compression", compression).partitionBy(*keys, "seg").text(data)
    index = build_index(placed.select(*keys, F.col("seg").alias("file"), "ts", "labels", "_size"), F.col("_size"), [*keys, "file"])
    index.write.mode(mode).option("timestampFormat", TIMES).partitionBy(*keys).json(f"{path}/index")
    metadata = build_metadata(read_index(spark, f"{path}/index"), redaction)
    (metadata if keys else metadata.drop("capture")).write.mode(mode).option("timestampFormat", TIMES).partitionBy(*keys).json(f"{path}/metadata")


def write_capture(logs: DataFrame, path: str, order: Sequence[str] = ("ts",),
                  max_entries: int = MAX_FILE_ENTRIES, redaction: Sequence[str] | None = None,
                  compression: str = "none", mode: str = "errorifexists", max_bytes: int = MAX_FILE_BYTES) -> None:
    """Write entries as JSON lines in files of bounded size and length, then index and session record.
    File name order is time order. The bound is of bytes before compression."""
    _write(logs, path, f"{path}/data", (), order, max_bytes, max_entries, redaction, compression, mode)


def write_captures(logs: DataFrame, root: str, order: Sequence[str] = ("ts",),
                   max_entries: int = MAX_FILE_ENTRIES, redaction: Sequence[str] | None = None,
                   compression: str = "none", max_bytes: int = MAX_FILE_BYTES) -> None:
    """Write all captures of the ``capture`` column at once, one folder each. A capture with a
    large share of the entries is cut by time like all others."""
    _write(logs, root, root, ("capture",), order, max_bytes, max_entries, redaction, compression, "errorifexists")


def slice_write(logs: DataFrame, path: str, **write_options) -> None:
    """Write a filtered subset as a capture of its own; nothing to write is an error."""
    if logs.isEmpty():
        raise ValueError("the filters leave no line to write")
    write_capture(logs, path, **write_options)


def slice_capture(spark: SparkSession, source: str, path: str, frm: datetime | None = None, to: datetime | None = None,
                  labels=None, grep: str | None = None) -> None:
    """Slice a stored capture into a new one. Lines are kept exactly as stored, in their order,
    unreadable ones too if there is no time bound; only files the index selects are looked at."""
    lines = parse_all_lines(read_lines(spark, source)).withColumn("_at", F.monotonically_increasing_id())
    kept = slice_logs(lines, read_index(spark, source), frm, to, labels, grep, F.col("value"), F.col("bad"), ["capture", "file"])
    if kept.isEmpty():
        raise ValueError("the filters leave no line to write")
    place = ["file", "block", "_at"]
    (kept.repartitionByRange(*place).sortWithinPartitions(*place).select("value")
     .write.option("maxRecordsPerFile", MAX_FILE_ENTRIES).text(f"{path}/data"))
    written = parse_all_lines(read_lines(spark, path))
    index = build_index(written, F.octet_length("value") + 1, ["file"])
    index.write.option("timestampFormat", TIMES).json(f"{path}/index")
    metadata = build_metadata(read_index(spark, path)).drop("capture", "redaction")
    (metadata.withColumn("redaction", read_metadata(spark, source).select(F.first("redaction", True)).scalar())
     .write.option("timestampFormat", TIMES).json(f"{path}/metadata"))


def export(logs: DataFrame, path: str, fmt: str, **filters) -> None:
    """``parquet`` (zstd), ``csv`` (ts, flattened labels, msg) or ``jsonl``."""
    logs = filter_logs(logs, **filters)
    if fmt == "parquet":
        logs.select("ts", "labels", "msg").write.option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        (logs.select(rfc3339(F.col("ts")).alias("ts"), flatten_labels(F.col("labels")).alias("labels"), "msg")
         .write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path))
    elif fmt == "jsonl":
        _wire(logs).write.json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def timeline_csv(timeline: DataFrame, path: str) -> None:
    """``minute,total_lines,error_lines`` in one ordered file; a timeline has a bounded length."""
    (timeline.orderBy("minute").select(rfc3339(F.col("minute")).alias("minute"), "total_lines", "error_lines")
     .coalesce(1).write.option("header", True).csv(path))

