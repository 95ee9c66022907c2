"""Streams from landed files. Sources are rate-limited by ``max_files``; every sink has a
checkpoint, so a lost executor or a restart loses and repeats nothing."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.labels import label_present, service_label
from emberlog.functions.messages import is_error, is_error_once, normalize_message
from emberlog.functions.redaction import redact_with_hits, select_patterns
from emberlog.operators.filters import text_or_label_matches
from emberlog.operators.ingest import explode_loki, ingest_audit, redaction_counts
from emberlog.schema import AUDIT
from emberlog.sources.captures import DATA_GLOB, is_data_file, parse_entries
from emberlog.sources.sinks import write_capture

WATERMARK = "10 minutes"
ENTRY = T.StructType([T.StructField("ts", T.TimestampType()),
                      T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
                      T.StructField("msg", T.StringType())])


def payload_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Push payloads, one a line, from files as they land."""
    return (spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
            .withColumnRenamed("value", "payload"))


def entry_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Entries from parquet files as they land, such as those of ``ingest``."""
    return (spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", True).parquet(path))


def ingest(payloads: DataFrame, out: str, checkpoint: str, redactor: bool | Iterable[str] | None = True,
           custom=(), now: datetime | None = None) -> StreamingQuery:
    """Explode payloads, redact, then write: nothing unredacted reaches the sink."""
    entries = explode_loki(payloads, "payload", now, redactor, custom)
    return (entries.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .option("path", out).outputMode("append").trigger(availableNow=True).start())


def _spread(batch: DataFrame) -> DataFrame:
    """The rows of a trigger over all cores: its few files would else keep as few of them busy, at every volume."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(cores) if batch.rdd.getNumPartitions() < cores else batch


def ingest_capture(payloads: DataFrame, root: str, checkpoint: str, redactor: bool | Iterable[str] | None = True,
                   custom=(), now: datetime | None = None, event: str = "loki_push_received") -> StreamingQuery:
    """Ingest into captures: each trigger becomes one below ``root``, with data files, index and session
    record, so that all readers open them; how often each pattern was redacted and an audit row
    per payload (schema AUDIT) are kept beside them as ``redactions`` and ``audit``.

    Everything a trigger writes lies in folders of its number and replaces what an earlier attempt
    left there, so a retry neither loses nor repeats entries."""
    names = None if redactor is True or not redactor else list(redactor)
    patterns = [p.name for p in select_patterns(names, custom)] if redactor else []
    extra = [c for c in ("remote_ip", "duration_ms") if c in payloads.columns]

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("_payload", F.monotonically_increasing_id())
        entries = explode_loki(_spread(numbered), "payload", now)
        if redactor:
            entries = redact_with_hits(entries, "msg", names, custom)
        entries = entries.persist()
        try:
            write_capture(entries.select("ts", "labels", "msg"), f"{root}/trigger-{number:09d}",
                          redaction=patterns if redactor else None, mode="overwrite")
            if patterns:
                redaction_counts(entries).write.mode("overwrite").parquet(f"{root}/redactions/trigger={number}")
            per_payload = ingest_audit(entries, "_payload", event).join(numbered.select("_payload", *extra), "_payload")
            at = F.current_timestamp() if now is None else F.lit(now)
            row = {"timestamp": at, "remote_ip": F.lit(None), "duration_ms": F.lit(None)} | {c: F.col(c) for c in extra}
            audit = per_payload.select(*[row.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in AUDIT])
            audit.write.mode("overwrite").parquet(f"{root}/audit/trigger={number}")
        finally:
            entries.unpersist()

    return (payloads.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def follow(spark: SparkSession, path: str, grep: str | None = None, label: tuple[str, str] | None = None,
           max_files: int = 1000) -> DataFrame:
    """New entries of a capture's data files as they appear, rotated ones included, filtered. Its
    index, session record and audit trail are no entries."""
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True)
             .option("pathGlobFilter", DATA_GLOB).text(path).where(is_data_file()))
    entries = parse_entries(lines)
    if label:
        entries = entries.where(label_present(F.col("labels"), *label))
    if grep is not None:
        entries = entries.where(text_or_label_matches(grep))
    return entries.select("ts", "labels", "msg")


def counters(entries: DataFrame) -> DataFrame:
    """Running entries and bytes per talker; entries without one count under the empty name."""
    name = F.coalesce(service_label(F.col("labels")), F.lit(""))
    return entries.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("received"), F.sum(F.octet_length("msg")).cast("bigint").alias("bytes"))


def rates(entries: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """Entries and bytes per second of event time."""
    if watermark:
        entries = entries.withWatermark("ts", watermark)
    return (entries.groupBy(F.window("ts", "1 second"))
            .agg(F.count(F.lit(1)).alias("logs_per_sec"), F.sum(F.octet_length("msg")).cast("bigint").alias("bytes_per_sec"))
            .select(F.col("window.start").alias("second"), "logs_per_sec", "bytes_per_sec"))


def minute_counts(entries: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """Totals and errors per minute."""
    if watermark:
        entries = entries.withWatermark("ts", watermark)
    return (entries.groupBy(F.window("ts", "1 minute"))
            .agg(F.count(F.lit(1)).alias("total_lines"), F.count_if(is_error(F.col("msg"))).alias("error_lines"))
            .select(F.col("window.start").alias("minute"), "total_lines", "error_lines"))


def split_late(entries: DataFrame, out: str, checkpoint: str, delay: str = WATERMARK) -> StreamingQuery:
    """Part entries (ts, labels, msg) into ``out/timely`` and ``out/late``, folders by trigger.

    Late is what lies more than ``delay`` before the latest time of earlier triggers, and what has no time. A
    watermark of the same delay drops late rows without a trace; over ``timely`` it drops none, and the late
    ones can be counted or added to closed windows. The latest time lies in two folders used in turn, so a retry
    replaces what an earlier attempt left."""
    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [spark.read.schema("high timestamp").parquet(f"{out}/high-{(number - 1) % 2}")] if number else []
        high = before[0].agg(F.unix_micros(F.max("high"))).head()[0] if before else None
        timely = F.col("ts").isNotNull()
        if high is not None:
            timely = F.coalesce(F.col("ts") >= F.timestamp_micros(F.lit(high).cast("bigint")) - F.expr(f"interval {delay}"), F.lit(False))
        rows = batch.select("ts", "labels", "msg").persist()
        try:
            for name, part in (("timely", rows.where(timely)), ("late", rows.where(~timely))):
                # One folder at least, so that there is something to read; none for triggers without rows.
                if number == 0 or not part.isEmpty():
                    part.write.mode("overwrite").parquet(f"{out}/{name}/trigger={number}")
            latest_times = rows.agg(F.max("ts").alias("high"))
            for earlier in before:
                latest_times = latest_times.union(earlier).agg(F.max("high").alias("high"))
            latest_times.write.mode("overwrite").parquet(f"{out}/high-{number % 2}")
        finally:
            rows.unpersist()

    return (entries.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(split).trigger(availableNow=True).start())


def keep_closed(windows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each window of ``rates`` or ``minute_counts`` once, when the watermark has passed its end;
    only open windows are held as state."""
    return (windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def signatures(entries: DataFrame) -> DataFrame:
    """Running count and first time per error signature."""
    return (entries.where(is_error_once(F.col("msg")))
            .groupBy(normalize_message(F.col("msg")).alias("signature"))
            .agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen")))


def talkers(entries: DataFrame) -> DataFrame:
    """Running volume and errors per label key and value."""
    return (entries.select(F.explode("labels").alias("key", "value"), is_error(F.col("msg")).alias("_err"))
            .groupBy("key", "value")
            .agg(F.count(F.lit(1)).alias("total_lines"), F.count_if("_err").alias("error_lines")))


def keep_updates(running: DataFrame, out: str, checkpoint: str, keys: list[str] | None = None,
                 every: int = 20) -> StreamingQuery:
    """Write the rows that changed in each trigger to a folder of that trigger. Writing a
    trigger again replaces its folder, so a retry does no harm.

    With ``keys`` the log stays short: after every so many triggers the current rows of all keys are folded into
    one of two base folders used in turn, and the folders that the fold before had taken in go. So a fold never
    reads what it replaces, nor what an attempt that failed may have removed."""
    def fold(spark: SparkSession, number: int) -> None:
        turn = number // every
        first = turn * every
        taken_in = [f"{out}/updates/trigger={n}" for n in range(first, number + 1)]
        if turn:
            taken_in.append(f"{out}/base-{(turn - 1) % 2}")
        _newest(spark, taken_in, keys).write.mode("overwrite").parquet(f"{out}/base-{turn % 2}")
        for taken in range(max(0, first - every), first):
            _remove(spark, f"{out}/updates/trigger={taken}")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/updates/trigger={number}")
        if keys and number % every == every - 1:
            fold(batch.sparkSession, number)

    return (running.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _newest(spark: SparkSession, paths: list[str], keys: list[str]) -> DataFrame:
    """The newest row of each key in some folders, with its trigger."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(*paths)
    values = [c for c in rows.columns if c not in (*keys, "trigger")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "trigger").alias("_v"), F.max("trigger").alias("trigger"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values], "trigger"))


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The current value of each key from what ``keep_updates`` wrote; to be read between triggers."""
    return _newest(spark, [out], keys).drop("trigger")
