"""Streams run to the end of the landed data, then read back."""

from pyspark.sql import functions as F

from emberlog.functions.labels import flatten_labels, service_label
from emberlog.plans.ingest_queries import _HITS, _redact_ctes, rules_file
from emberlog.plans.registry import ORACLES, query
from emberlog.plans.tables import HALF, LOGS, SNAPSHOTS, is_error_sql, signature_sql
from emberlog.schema import AUDIT
from emberlog.session import scratch_dir, streaming_session
from emberlog.sources import captures, sinks
from emberlog.streaming import alerting, streams


def _several(t) -> int:
    """In how many files test data land: as many as the session's shuffles have partitions."""
    return int(t.spark.conf.get("spark.sql.shuffle.partitions"))


def _landed_entries(t):
    """The log entries as parquet files that arrive one after another."""
    path = scratch_dir(t.spark, "landed")
    t.logs().select("ts", "labels", "msg").repartition(_several(t)).write.parquet(path)
    return streams.entry_stream(streaming_session(t.spark), path, max_files=3)


def _finished(t, running, keys):
    """Run a stream in update mode to its end and read the current values."""
    out = scratch_dir(t.spark, "updates")
    streams.keep_updates(running, out, scratch_dir(t.spark, "stream"), keys).awaitTermination()
    return streams.latest(t.spark, out, keys)


@query("stream_ingest", f"WITH {LOGS}, {_redact_ctes('logs', 'event_id, ts, app, env', 'msg')} SELECT ts, 'app=' || app || ';env=' || env AS labels, t AS msg FROM done")
def stream_ingest(t):
    landed, out = scratch_dir(t.spark, "payloads"), scratch_dir(t.spark, "ingested")
    t.payloads().select("payload").repartition(_several(t)).write.text(landed)
    streams.ingest(streams.payload_stream(t.spark, landed, max_files=2), out, scratch_dir(t.spark, "stream")).awaitTermination()
    return t.spark.read.parquet(out).select("ts", flatten_labels(F.col("labels")).alias("labels"), "msg")


def _ingested_captures(t):
    landed, root = scratch_dir(t.spark, "payloads"), scratch_dir(t.spark, "ingested")
    t.payloads().select("payload").repartition(_several(t)).write.text(landed)
    stream = streams.payload_stream(t.spark, landed, max_files=3)
    streams.ingest_capture(stream, root, scratch_dir(t.spark, "stream")).awaitTermination()
    return root


@query("stream_ingest_capture", f"WITH {LOGS}, {_redact_ctes('logs', 'event_id, ts, app, env', 'msg')} SELECT ts, 'app=' || app || ';env=' || env AS labels, t AS msg FROM done")
def stream_ingest_capture(t):
    """Ingested into captures, one a trigger, and read back as such."""
    return captures.read_capture(t.spark, _ingested_captures(t)).select("ts", flatten_labels(F.col("labels")).alias("labels"), "msg")


@query("stream_ingest_books", f"""WITH {LOGS}, {_redact_ctes('logs', 'event_id', 'msg')}
SELECT CAST(count(*) AS BIGINT) AS audit_lines, CAST(sum(strlen(t)) AS BIGINT) AS audit_bytes, CAST(count(*) AS BIGINT) AS index_lines,
  CAST(count(*) AS BIGINT) AS catalog_entries, CAST({' + '.join(f'sum(hits_{n})' for n in _HITS)} AS BIGINT) AS redacted FROM done""")
def stream_ingest_books(t):
    """What audit, index, catalog and redaction counts of all triggers add up to."""
    root = _ingested_captures(t)
    audit = t.spark.read.schema(AUDIT).option("recursiveFileLookup", True).parquet(f"{root}/audit")
    counts = t.spark.read.option("recursiveFileLookup", True).parquet(f"{root}/redactions")
    return (audit.agg(F.sum("lines").alias("audit_lines"), F.sum("bytes").alias("audit_bytes"))
            .withColumn("index_lines", captures.read_index(t.spark, root).agg(F.sum("lines")).scalar())
            .withColumn("catalog_entries", captures.catalog(t.spark, root).agg(F.sum("entries")).scalar())
            .withColumn("redacted", counts.agg(F.sum("count")).scalar()))


@query("stream_counters", f"WITH {LOGS} SELECT app AS name, CAST(count(*) AS BIGINT) AS received, CAST(sum(strlen(msg)) AS BIGINT) AS bytes FROM logs GROUP BY app")
def stream_counters(t):
    return _finished(t, streams.counters(_landed_entries(t)), ["name"])


@query("stream_rate", f"""WITH {LOGS} SELECT date_trunc('second', ts) AS second, CAST(count(*) AS BIGINT) AS logs_per_sec,
  CAST(sum(strlen(msg)) AS BIGINT) AS bytes_per_sec FROM logs GROUP BY 1""")
def stream_rate(t):
    return _finished(t, streams.rates(_landed_entries(t), watermark=None), ["second"])


@query("stream_triage", f"""WITH {LOGS} SELECT date_trunc('minute', ts) AS minute, CAST(count(*) AS BIGINT) AS total_lines,
  CAST(count(*) FILTER (WHERE {is_error_sql()}) AS BIGINT) AS error_lines FROM logs GROUP BY 1""")
def stream_triage(t):
    return _finished(t, streams.minute_counts(_landed_entries(t), watermark=None), ["minute"])


# Every fiftieth entry lands after all others; it is late if it lies over ten minutes before their end.
_LATE = f"""WITH {LOGS}, high AS (SELECT max(ts) FILTER (WHERE event_id % 50 <> 7) AS t FROM logs),
parted AS (SELECT *, event_id % 50 = 7 AND ts < (SELECT t FROM high) - INTERVAL 10 MINUTE AS late FROM logs),
mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS t FROM parted WHERE NOT late)"""


def _parted(t):
    """Entries that land in order of time, half by half, and stragglers after them, parted by a stream."""
    path, out, files = scratch_dir(t.spark, "landed"), scratch_dir(t.spark, "parted"), _several(t)
    straggler = F.col("event_id") % 50 == 7
    for part in (~straggler & (F.col("ts") < F.lit(HALF)), ~straggler & (F.col("ts") >= F.lit(HALF)), straggler):
        t.logs().where(part).select("ts", "labels", "msg").repartition(files).write.mode("append").parquet(path)
    entries = streams.entry_stream(streaming_session(t.spark), path, max_files=files)
    streams.split_late(entries, out, scratch_dir(t.spark, "stream")).awaitTermination()
    return out


def _closed(t, windows):
    entries = streams.entry_stream(streaming_session(t.spark), f"{_parted(t)}/timely")
    out = scratch_dir(t.spark, "closed")
    streams.keep_closed(windows(entries), out, scratch_dir(t.spark, "stream")).awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_rate_closed", f"""{_LATE} SELECT date_trunc('second', ts) AS second, CAST(count(*) AS BIGINT) AS logs_per_sec,
  CAST(sum(strlen(msg)) AS BIGINT) AS bytes_per_sec FROM parted WHERE NOT late GROUP BY 1 HAVING second + INTERVAL 1 SECOND <= (SELECT t FROM mark)""")
def stream_rate_closed(t):
    """Under a watermark: seconds that are closed, without what came late."""
    return _closed(t, streams.rates)


@query("stream_triage_closed", f"""{_LATE} SELECT date_trunc('minute', ts) AS minute, CAST(count(*) AS BIGINT) AS total_lines,
  CAST(count(*) FILTER (WHERE {is_error_sql()}) AS BIGINT) AS error_lines FROM parted WHERE NOT late GROUP BY 1
HAVING minute + INTERVAL 1 MINUTE <= (SELECT t FROM mark)""")
def stream_triage_closed(t):
    return _closed(t, streams.minute_counts)


@query("stream_late", f"{_LATE} SELECT app AS name, CAST(count(*) AS BIGINT) AS late_lines, CAST(sum(strlen(msg)) AS BIGINT) AS late_bytes FROM parted WHERE late GROUP BY 1")
def stream_late(t):
    """What came too late, by talker."""
    late = t.spark.read.schema(streams.ENTRY).option("recursiveFileLookup", True).parquet(f"{_parted(t)}/late")
    return late.groupBy(service_label(F.col("labels")).alias("name")).agg(
        F.count(F.lit(1)).alias("late_lines"), F.sum(F.octet_length("msg")).alias("late_bytes"))


@query("stream_signatures", f"""WITH {LOGS} SELECT {signature_sql()} AS signature, CAST(count(*) AS BIGINT) AS count, min(ts) AS first_seen
FROM logs WHERE {is_error_sql()} GROUP BY 1""")
def stream_signatures(t):
    return _finished(t, streams.signatures(_landed_entries(t)), ["signature"])


@query("stream_talkers", ORACLES.get("talkers"))
def stream_talkers(t):
    return _finished(t, streams.talkers(_landed_entries(t)), ["key", "value"])


@query("follow", f"WITH {LOGS} SELECT ts, msg FROM logs WHERE app = 'svc-1' AND (regexp_matches(msg, 'panic|refused') OR regexp_matches(app, 'panic|refused') OR regexp_matches(env, 'panic|refused'))")
def follow(t):
    path, out = scratch_dir(t.spark, "capture"), scratch_dir(t.spark, "followed")
    sinks.export(t.logs(), path, "jsonl")
    entries = streams.follow(t.spark, path, "panic|refused", ("app", "svc-1"), max_files=1)
    (entries.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(t.spark, "stream"))
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(out).select("ts", "msg")


def _landed_snapshots(t):
    """Snapshots as parquet files, in order of time."""
    path = scratch_dir(t.spark, "snapshots")
    snapshots = t.snapshots()
    snapshots.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return streaming_session(t.spark).readStream.schema(snapshots.schema).parquet(path)


def _alerts(t, rules):
    out = scratch_dir(t.spark, "alerts")
    alerting.keep_alerts(_landed_snapshots(t), rules, out, scratch_dir(t.spark, "stream")).awaitTermination()
    return alerting.alerts(t.spark, out)


@query("stream_alerts", ORACLES.get("alert_edges"))
def stream_alerts(t):
    """Rules of a file, read at each trigger."""
    return _alerts(t, rules_file(t))


@query("stream_disk_warning", f"""WITH {SNAPSHOTS},
e AS (SELECT ts, disk_usage * 100.0 / disk_cap AS value FROM snapshots),
f AS (SELECT *, coalesce(lag(value > 80) OVER (ORDER BY ts), false) AS was FROM e)
SELECT ts, 'disk_warning' AS rule, CAST(value AS DOUBLE) AS value FROM f WHERE value > 80 AND NOT was""")
def stream_disk_warning(t):
    return _alerts(t, [alerting.DISK_RULE]).select("ts", "rule", "value")
