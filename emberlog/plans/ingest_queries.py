"""Ingest, redaction, counters and alerts."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from emberlog.functions.labels import flatten_labels
from emberlog.functions.redaction import custom_pattern, luhn_valid, redact, redact_with_hits
from emberlog.operators import alerts, ingest
from emberlog.params import AlertRule
from emberlog.plans.registry import ORACLES, query
from emberlog.plans.tables import LOGS, SNAPSHOTS
from emberlog.functions.messages import rfc3339
from emberlog.session import scratch_dir
from emberlog.sources import rules

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)

# ---- the redaction chain in SQL --------------------------------------------------------------

# The redaction patterns as DuckDB's regex engine reads them.
_CARD = r"\b(?:\d[ -]*?){13,19}\b"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)"
_OTHERS = (
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED:email]"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED:jwt]"),
    ("bearer", r"(?i)(?:Bearer\s+|Authorization:\s*Bearer\s+)[A-Za-z0-9_\-.]+", "[REDACTED:bearer]"),
    ("ip_v4", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "[REDACTED:ip]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED:ssn]"),
    ("phone", r"(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[REDACTED:phone]"),
)


def _luhn_sql(m: str) -> str:
    d = f"reverse(regexp_replace({m}, '[ -]', '', 'g'))"
    digit = f"CAST(substr({d}, i, 1) AS INTEGER)"
    return (f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
            f"WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0)")


def _redact_ctes(source: str, key: str, text: str) -> str:
    """CTE ``done``: key, final text, hits per pattern."""
    steps = [f"""c0 AS (
  SELECT {key}, {text} AS t, regexp_extract_all({text}, '{_CARD}') AS ms, string_split_regex({text}, '{_CARD}') AS gaps FROM {source}),
c1 AS (
  SELECT {key}, gaps, ms, list_transform(ms, lambda m: CASE WHEN {_luhn_sql('m')} THEN '[REDACTED:cc]' ELSE m END) AS kept FROM c0),
r0 AS (
  SELECT {key}, len(list_filter(list_zip(ms, kept), lambda z: z[1] <> z[2])) AS hits_credit_card,
    list_aggregate(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(kept[i], '')), 'string_agg', '') AS t FROM c1)"""]
    for i, (name, pattern, placeholder) in enumerate(_OTHERS):
        steps.append(f"""r{i + 1} AS (
  SELECT * EXCLUDE (t, u), u AS t, CAST(u <> t AS BIGINT) AS hits_{name} FROM (
    SELECT *, regexp_replace(t, '{pattern}', '{placeholder}', 'g') AS u FROM r{i}))""")
    steps.append(f"done AS (SELECT * FROM r{len(_OTHERS)})")
    return ",\n".join(steps)


@query("redact", f"WITH {_redact_ctes('documents', 'doc_id', 'text')} SELECT doc_id, md5(t) AS redacted_md5, CAST(strlen(t) AS BIGINT) AS bytes FROM done")
def redact_documents(t):
    clean = t.messages().select("doc_id", redact(F.col("msg")).alias("msg"))
    return clean.select("doc_id", F.md5("msg").alias("redacted_md5"), F.octet_length("msg").cast("bigint").alias("bytes"))


@query("redact_conversations", f"WITH {_redact_ctes('conversations', 'conv_id, turn', 'text')} SELECT conv_id, turn, t AS text FROM done")
def redact_conversations(t):
    return t.table("conversations").select("conv_id", "turn", redact(F.col("text")).alias("text"))


@query("redact_subset", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_OTHERS[3][1]}', '[REDACTED:ip]', 'g'),
  '{_OTHERS[0][1]}', '[REDACTED:email]', 'g'), '(\\w+)\\.example', '\\1.host', 'g')) AS redacted_md5 FROM documents""")
def redact_subset(t):
    """Some builtins in the order given, then a custom pattern with a group."""
    custom = [custom_pattern("host", r"(\w+)\.example", "${1}.host")]
    return t.messages().select("doc_id", F.md5(redact(F.col("msg"), ["ip_v4", "email"], custom)).alias("redacted_md5"))


@query("redact_from_file", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text,
  '{_OTHERS[0][1]}', '[REDACTED:email]', 'g'), '[0-9]{{6}}', '[number]', 'g'), '(\\w+)\\.example', '\\1.host', 'g')) AS redacted_md5 FROM documents""")
def redact_from_file(t):
    """A builtin pattern, then those of a file, in its order."""
    path = scratch_dir(t.spark, "patterns")
    t.spark.createDataFrame([("number", "[0-9]{6}", "[number]"), ("host", r"(\w+)\.example", "${1}.host")], rules.PATTERNS).write.json(path)
    custom = rules.read_patterns(t.spark, path)
    return t.messages().select("doc_id", F.md5(redact(F.col("msg"), ["email"], custom)).alias("redacted_md5"))


_HITS = ["credit_card", *[n for n, _, _ in _OTHERS]]


@query("redact_hits", f"WITH {_redact_ctes('documents', 'doc_id', 'text')} SELECT doc_id, {', '.join(f'CAST(hits_{n} AS BIGINT) AS hits_{n}' for n in _HITS)} FROM done")
def redact_hits(t):
    return redact_with_hits(t.messages().select("doc_id", "msg"), "msg").drop("msg")


@query("redaction_counts", "WITH " + _redact_ctes("documents", "doc_id", "text") + "\n" + "\nUNION ALL ".join(
    f"SELECT '{n}' AS pattern, CAST(sum(hits_{n}) AS BIGINT) AS count FROM done" for n in _HITS))
def redaction_counts(t):
    return ingest.redaction_counts(redact_with_hits(t.messages().select("msg"), "msg"))


@query("luhn", rf"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\d[ -]?){{12,20}}')) AS number FROM documents)
SELECT doc_id, number, CASE WHEN length(regexp_replace(number, '[ -]', '', 'g')) BETWEEN 13 AND 19 THEN {_luhn_sql('number')} ELSE false END AS valid
FROM found""")
def luhn(t):
    found = F.explode(F.regexp_extract_all("msg", F.lit(r"(?:\d[ -]?){12,20}"), F.lit(0)))
    return t.messages().select("doc_id", found.alias("number")).select("doc_id", "number", luhn_valid(F.col("number")).alias("valid"))


# ---- payloads ----------------------------------------------------------------------------------

@query("loki_explode", f"WITH {LOGS} SELECT ts, 'app=' || app || ';env=' || env AS labels, msg FROM logs")
def loki_explode(t):
    """Entries packed into payloads and taken out again are the entries."""
    entries = ingest.explode_loki(t.payloads().select("payload"), now=NOW)
    return entries.select("ts", flatten_labels(F.col("labels")).alias("labels"), "msg")


@query("loki_explode_redacted", f"WITH {LOGS}, {_redact_ctes('logs', 'event_id, ts', 'msg')} SELECT ts, t AS msg FROM done")
def loki_explode_redacted(t):
    return ingest.explode_loki(t.payloads().select("payload"), now=NOW, redactor=True).select("ts", "msg")


@query("raw_explode", f"""WITH {LOGS}
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END AS ts, app, msg FROM logs WHERE event_id % 11 <> 0""")
def raw_explode(t):
    """Some lines lack a time, some are broken off."""
    body = F.to_json(F.struct(F.when(F.col("event_id") % 7 != 0, rfc3339(F.col("ts"))).alias("ts"), "labels", "msg"))
    lines = t.logs().select("event_id", F.when(F.col("event_id") % 11 == 0, F.substring(body, 1, 20)).otherwise(body).alias("value"))
    return ingest.explode_raw(lines, now=NOW).select("event_id", "ts", F.col("labels")["app"].alias("app"), "msg")


@query("k8s_line_source", f"""WITH {LOGS}
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END AS ts, 'container=' || app AS labels, msg FROM logs""")
def k8s_line_source(t):
    """Lines with a leading time, and every fifth without."""
    line = F.when(F.col("event_id") % 5 == 0, F.col("msg")).otherwise(F.concat_ws(" ", rfc3339(F.col("ts")), "msg"))
    lines = t.logs().select("event_id", "app", line.alias("value"))
    return ingest.parse_k8s_lines(lines, F.col("app"), now=NOW).select(
        "event_id", "ts", flatten_labels(F.col("labels")).alias("labels"), "msg")


_PACKED = LOGS + """,
f AS (SELECT *, 'app=' || app || ';env=' || env AS label_set, epoch_us(ts) // 3600000000 AS flush FROM logs),
s AS (SELECT *, row_number() OVER (PARTITION BY label_set, flush ORDER BY ts, event_id) - 1 AS seq FROM f),
packed AS (
  SELECT label_set, CAST(flush AS BIGINT) AS flush, CAST(seq // 100 AS BIGINT) AS part, CAST(0 AS BIGINT) AS piece, CAST(count(*) AS BIGINT) AS lines,
    '{"streams":[{"stream":{"app":"' || app || '","env":"' || env || '"},"values":['
      || string_agg('["' || CAST(epoch_us(ts) * 1000 AS VARCHAR) || '","' || msg || '"]', ',' ORDER BY seq) || ']}]}' AS payload
  FROM s GROUP BY label_set, flush, seq // 100, app, env)"""


@query("loki_payload_write", f"WITH {_PACKED} SELECT *, CAST(strlen(payload) AS BIGINT) AS bytes, strlen(payload) <= 1048576 AS accepted FROM packed")
def loki_payload_write(t):
    return t.payloads().drop("payload_id")


@query("ingest_audit", f"""WITH {_PACKED.replace("packed AS (", "unused AS (")},
{_redact_ctes("(SELECT event_id, label_set || '/' || flush || '/' || (seq // 100) || '/0' AS payload_id, msg FROM s)", "event_id, payload_id", "msg")}
SELECT payload_id, 'loki_push_received' AS event, CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(t)) AS BIGINT) AS bytes
FROM done GROUP BY payload_id""")
def ingest_audit(t):
    entries = ingest.explode_loki(t.payloads().select("payload_id", "payload"), now=NOW, redactor=True)
    return ingest.ingest_audit(entries, "payload_id")


@query("ingest_talkers", f"WITH {LOGS} SELECT app AS name, CAST(count(*) AS BIGINT) AS count FROM logs GROUP BY app")
def ingest_talkers(t):
    return ingest.ingest_talkers(t.logs())


# ---- counters and alerts -------------------------------------------------------------------------

@query("rate_delta", f"""WITH {SNAPSHOTS}
SELECT ts, round((logs_received - lag(logs_received) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6), 9) AS logs_per_sec,
  round((bytes_written - lag(bytes_written) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6), 9) AS bytes_per_sec
FROM snapshots WINDOW w AS (ORDER BY ts)""")
def rate_delta(t):
    return alerts.rate_delta(t.snapshots()).withColumns(
        {c: F.round(c, 9) for c in ("logs_per_sec", "bytes_per_sec")})


RULES = (
    AlertRule("many-dropped", "logs_dropped", "gt", 100, "more than 100 dropped"),
    AlertRule("dropping", "drop_rate", "gte", 4, "four or more dropped in an hour"),
    AlertRule("disk-full", "disk_pct", "gt", 55, "disk is filling up"),
    AlertRule("quiet", "logs_received", "lt", 50, "few logs yet"),
)


@query("alert_edges", f"""WITH {SNAPSHOTS},
m AS (SELECT ts, CAST(logs_dropped AS DOUBLE) AS logs_dropped, CAST(greatest(0, coalesce(logs_dropped - lag(logs_dropped) OVER (ORDER BY ts), 0)) AS DOUBLE) AS drop_rate,
        disk_usage * 100.0 / disk_cap AS disk_pct, CAST(logs_received AS DOUBLE) AS logs_received FROM snapshots),
s AS (
  SELECT ts, 'many-dropped' AS rule, 'more than 100 dropped' AS detail, logs_dropped AS value, logs_dropped > 100 AS hit FROM m
  UNION ALL SELECT ts, 'dropping', 'four or more dropped in an hour', drop_rate, drop_rate >= 4 FROM m
  UNION ALL SELECT ts, 'disk-full', 'disk is filling up', disk_pct, disk_pct > 55 FROM m
  UNION ALL SELECT ts, 'quiet', 'few logs yet', logs_received, logs_received < 50 FROM m),
e AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY rule ORDER BY ts), false) AS was FROM s)
SELECT ts, rule, detail, CAST(value AS DOUBLE) AS value FROM e WHERE hit AND NOT was""")
def alert_edges(t):
    return alerts.alert_edges(t.snapshots(), RULES)


def rules_file(t):
    """The rules as a file."""
    path = scratch_dir(t.spark, "rules")
    t.spark.createDataFrame(RULES).write.json(path)
    return path


@query("alert_edges_from_file", ORACLES["alert_edges"])
def alert_edges_from_file(t):
    return alerts.alert_edges(t.snapshots(), rules.read_alert_rules(t.spark, rules_file(t)))


@query("disk_warning_edge", f"""WITH {SNAPSHOTS},
e AS (SELECT ts, disk_usage, disk_cap, disk_usage > floor(disk_cap * 0.8) AS hit,
        coalesce(lag(disk_usage > floor(disk_cap * 0.8)) OVER (ORDER BY ts), false) AS was FROM snapshots)
SELECT ts, disk_usage, disk_cap FROM e WHERE hit AND NOT was""")
def disk_warning_edge(t):
    return alerts.disk_warning_edges(t.snapshots())


@query("talker_rates", f"""WITH {LOGS},
h AS (SELECT app AS name, date_trunc('hour', ts) AS ts, count(*) AS n FROM logs GROUP BY 1, 2),
c AS (SELECT name, ts, CAST(sum(n) OVER (PARTITION BY name ORDER BY ts) AS BIGINT) AS count FROM h)
SELECT name, ts, count, round((count - lag(count) OVER w) / ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6), 9) AS per_sec
FROM c WINDOW w AS (PARTITION BY name ORDER BY ts)""")
def talker_rates(t):
    from pyspark.sql import Window
    hourly = t.logs().groupBy(F.col("app").alias("name"), F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("name").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return alerts.talker_rates(hourly.select("name", "ts", F.sum("n").over(upto).alias("count"))).withColumn(
        "per_sec", F.round("per_sec", 9))
