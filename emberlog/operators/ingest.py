"""Push payloads to entries and back, and what is counted on the way in."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.functions.labels import flatten_labels, service_label
from emberlog.functions.redaction import Pattern, redact
from emberlog.operators.decoding import decode
from emberlog.schema import ENTRY_WIRE, PUSH_PAYLOAD

# Lines per batch, bytes per payload, seconds until a batch is sent anyway.
BATCH_LINES = 100
MAX_PAYLOAD_BYTES = 1 << 20
FLUSH_SECONDS = 0.5


def _redacted(msg: Column, redactor: bool | Iterable[str] | None, custom: Iterable[Pattern]) -> Column:
    if not redactor:
        return msg
    return redact(msg, None if redactor is True else redactor, custom)


def _now(now: datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now)


def explode_loki(payloads: DataFrame, column: str = "payload", now: datetime | None = None,
                 redactor: bool | Iterable[str] | None = None, custom: Iterable[Pattern] = ()) -> DataFrame:
    """Entries of ``{"streams": [{"stream": labels, "values": [[ns, msg], ...]}]}`` payloads.

    Values with fewer than two items are dropped; a time that is no number becomes ``now``.
    Other columns of ``payloads`` are kept. Narrow: no shuffle."""
    rest = [c for c in payloads.columns if c != column]
    parsed = F.from_json(F.col(column), PUSH_PAYLOAD, {"columnNameOfCorruptRecord": "_corrupt"})
    nanos = F.trim(F.col("_value")[0]).try_cast("bigint")
    return (payloads.withColumn("_p", parsed)
            .select(*rest, F.explode("_p.streams").alias("_stream"))
            .select(*rest, F.col("_stream.stream").alias("labels"), F.explode("_stream.values").alias("_value"))
            .where(F.size("_value") >= 2)
            .select(*rest,
                    F.coalesce(_from_nanos(nanos), _now(now)).alias("ts"),
                    "labels", _redacted(F.col("_value")[1], redactor, custom).alias("msg")))


def _from_nanos(nanos: Column) -> Column:
    """Timestamp of a nanosecond count, rounded down to Spark's microseconds."""
    return F.timestamp_micros(F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000)))


def explode_raw(lines: DataFrame, column: str = "value", now: datetime | None = None,
                redactor: bool | Iterable[str] | None = None, custom: Iterable[Pattern] = ()) -> DataFrame:
    """Entries of one-JSON-object-per-line pushes; a missing time becomes ``now``. Lines that
    are not an entry are left out."""
    rest = [c for c in lines.columns if c != column]
    return (decode(lines, column, ENTRY_WIRE)
            .withColumn("_ts", F.col("ts").try_cast("timestamp"))
            .where("ts is null or _ts is not null")
            .select(*rest, F.coalesce("_ts", _now(now)).alias("ts"), "labels",
                    _redacted(F.coalesce("msg", F.lit("")), redactor, custom).alias("msg")))


def parse_k8s_lines(lines: DataFrame, container: str | Column, column: str = "value", now: datetime | None = None,
                    labels: Column | None = None) -> DataFrame:
    """``<time> <message>`` lines. Without a readable time the whole line is the message."""
    rest = [c for c in lines.columns if c != column]
    line = F.col(column)
    head = F.substring_index(line, " ", 1)
    # Only full RFC 3339 times count; a bare date or clock time is part of the message.
    looks_right = head.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z")
    ts = F.when(looks_right & line.contains(" "), F.regexp_replace(head, r"(\.\d{6})\d+", "$1").try_cast("timestamp"))
    own = F.create_map(F.lit("container"), F.lit(container) if isinstance(container, str) else container)
    return (lines.withColumn("_ts", ts)
            .select(*rest, F.coalesce("_ts", _now(now)).alias("ts"),
                    (own if labels is None else F.map_concat(
                        F.map_filter(labels, lambda k, v: k != "container"), own)).alias("labels"),
                    F.when(F.col("_ts").isNotNull(), F.expr(f"substring({column}, instr({column}, ' ') + 1)"))
                    .otherwise(line).alias("msg")))


def to_loki_payloads(logs: DataFrame, batch: int = BATCH_LINES, max_bytes: int = MAX_PAYLOAD_BYTES,
                     flush_seconds: float = FLUSH_SECONDS, order: tuple[str, ...] = ("ts", "msg"),
                     keys: tuple[str, ...] = ()) -> DataFrame:
    """Push payloads: entries of one label set and one flush interval, at most ``batch`` a payload.

    The flush interval is part of the group, so that a label set with a large share of all
    entries is spread over many groups. Label sets are told apart by their keys and values, not
    by how they print. A payload that would pass ``max_bytes`` is cut into pieces by the running
    size of its entries; ``accepted`` is false only for a single entry over the limit."""
    micros = int(flush_seconds * 1_000_000)
    logs = logs.withColumn("_set", F.array_sort(F.map_entries("labels"))).withColumn(
        "flush", F.floor(F.unix_micros("ts") / micros))
    group = [*keys, "_set", "flush"]
    seq = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    nanos = (F.unix_micros("ts") * 1000).cast("string")
    value = F.struct(F.col("_seq"), F.array(nanos, F.col("msg")).alias("value"))
    # Pieces of half the limit: with the entry that crosses it and the labels, a piece stays below the limit.
    size = F.octet_length(F.to_json(F.array(nanos, F.col("msg")))).cast("bigint") + 1
    before = Window.partitionBy(*group, "part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    packed = (logs.withColumn("_seq", seq).withColumn("part", F.floor(F.col("_seq") / batch))
              .withColumn("piece", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / (max_bytes // 2)))
              .groupBy(*group, "part", "piece")
              .agg(F.first("labels").alias("labels"), F.count(F.lit(1)).alias("lines"),
                   F.transform(F.array_sort(F.collect_list(value)), lambda e: e["value"]).alias("values")))
    payload = F.to_json(F.struct(F.array(F.struct(F.col("labels").alias("stream"), "values")).alias("streams")))
    return (packed.withColumn("payload", payload)
            .select(*keys, flatten_labels(F.col("labels")).alias("label_set"), "flush", "part", "piece", "lines", "payload",
                    F.octet_length("payload").cast("bigint").alias("bytes"))
            .withColumn("accepted", F.col("bytes") <= max_bytes))


def batch_size_estimate(labels: Column, lines: Column) -> Column:
    """Rough bytes of a batch: label text plus 24 bytes over each line. ``lines`` is an array of text."""
    names = F.aggregate(F.map_entries(labels), F.lit(0),
                        lambda acc, e: acc + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return names + F.aggregate(lines, F.lit(0), lambda acc, m: acc + F.octet_length(m) + 24)


def ingest_talkers(logs: DataFrame) -> DataFrame:
    """Entries per service."""
    return (logs.select(service_label(F.col("labels")).alias("name")).where("name is not null")
            .groupBy("name").agg(F.count(F.lit(1)).alias("count")))


def ingest_audit(entries: DataFrame, payload_id: str, event: str = "loki_push_received") -> DataFrame:
    """Per payload: lines, and bytes of the messages as kept (after redaction)."""
    return (entries.groupBy(payload_id)
            .agg(F.lit(event).alias("event"), F.count(F.lit(1)).alias("lines"),
                 F.sum(F.octet_length("msg")).cast("bigint").alias("bytes")))


def redaction_counts(redacted: DataFrame) -> DataFrame:
    """Sum the ``hits_<pattern>`` columns: one row per pattern."""
    hits = [c for c in redacted.columns if c.startswith("hits_")]
    sums = redacted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in hits])
    rows = F.array(*[F.struct(F.lit(c.removeprefix("hits_")).alias("pattern"), F.col(c).alias("count")) for c in hits])
    return sums.select(F.inline(rows))
