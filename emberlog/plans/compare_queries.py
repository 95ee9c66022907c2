"""Comparison, merge, skew and fault-injection queries."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from emberlog.functions.labels import flatten_labels
from emberlog.functions.scoring import percent_change, percent_text
from emberlog.operators import compare, inject as faults, merge as merging, triage
from emberlog.params import Fault
from emberlog.plans.registry import query
from emberlog.plans.tables import CHRONOLOGICAL, ERRORS, INDEX, LOGS, SKEWED, is_error_sql, signature_sql
from emberlog.session import scratch_dir
from emberlog.sources import captures, merged, sinks

_SIDES = LOGS + f""",
sig AS (
  SELECT CASE WHEN {is_error_sql()} THEN {signature_sql()} END AS signature, capture FROM logs),
ab AS (
  SELECT signature, count(*) FILTER (WHERE capture = 'base') AS a, count(*) FILTER (WHERE capture = 'current') AS b
  FROM sig GROUP BY signature)"""


@query("rate_compare", f"""WITH {LOGS}
SELECT date_trunc('minute', ts) AS minute, CAST(count(*) FILTER (WHERE capture = 'base') AS BIGINT) AS rate_a,
  CAST(count(*) FILTER (WHERE capture = 'current') AS BIGINT) AS rate_b FROM logs GROUP BY 1""")
def rate_compare(t):
    return compare.rate_compare(t.logs(), "base", "current")


@query("rate_compare_services", f"""WITH {LOGS},
a AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM logs WHERE app = 'svc-0' GROUP BY 1),
b AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM logs WHERE app = 'svc-1' GROUP BY 1)
SELECT minute, CAST(coalesce(a.n, 0) AS BIGINT) AS rate_a, CAST(coalesce(b.n, 0) AS BIGINT) AS rate_b
FROM a FULL JOIN b USING (minute)""")
def rate_compare_services(t):
    """Two services as the two captures, whose minutes overlap."""
    return compare.rate_compare(t.logs().withColumn("capture", F.col("app")), "svc-0", "svc-1")


@query("errors_only", f"""WITH {_SIDES.replace("capture = 'base'", "capture = 'svc-0'").replace("capture = 'current'", "capture = 'svc-1'")
    .replace("END AS signature, capture FROM logs", "END AS signature, app AS capture FROM logs")},
ta AS (SELECT signature, a AS n FROM ab WHERE signature IS NOT NULL AND a > 0),
tb AS (SELECT signature, b AS n FROM ab WHERE signature IS NOT NULL AND b > 0)
SELECT 'a' AS side, signature AS pattern, CAST(n AS BIGINT) AS count FROM ta WHERE signature NOT IN (SELECT signature FROM tb)
UNION ALL SELECT 'b', signature, CAST(n AS BIGINT) FROM tb WHERE signature NOT IN (SELECT signature FROM ta)""")
def errors_only(t):
    return compare.errors_only(t.logs().withColumn("capture", F.col("app")), "svc-0", "svc-1")


_KEYED = INDEX.replace("UNION ALL SELECT capture, file, 'env', env FROM logs",
                       "UNION ALL SELECT capture, file, 'env', env FROM logs WHERE capture = 'base'"
                       " UNION ALL SELECT capture, file, 'zone', 'z1' FROM logs WHERE capture = 'current'")


def _relabelled(t):
    """Logs whose captures know different label keys: env only in base, zone only in current."""
    zone = F.create_map(F.lit("app"), F.col("app"), F.lit("zone"), F.lit("z1"))
    return t.logs().withColumn("labels", F.when(F.col("capture") == "base", F.col("labels")).otherwise(zone))


@query("labels_only", f"""WITH {_KEYED},
ka AS (SELECT DISTINCT key FROM idx_labels WHERE capture = 'base'), kb AS (SELECT DISTINCT key FROM idx_labels WHERE capture = 'current')
SELECT 'a' AS side, key FROM ka WHERE key NOT IN (SELECT key FROM kb)
UNION ALL SELECT 'b', key FROM kb WHERE key NOT IN (SELECT key FROM ka)""")
def labels_only(t):
    from emberlog.operators.capture_index import build_index
    index = build_index(_relabelled(t), keys=["capture", "file"])
    return compare.labels_only(index, "base", "current")


@query("label_difference", f"""WITH {_KEYED}
SELECT key FROM idx_labels WHERE capture = 'base' EXCEPT SELECT key FROM idx_labels WHERE capture = 'current'""")
def label_difference(t):
    """Of each key is kept which captures have it, from the first pass on: a key's entries never meet in a task."""
    keys = _relabelled(t).select("capture", F.explode(F.map_keys("labels")).alias("key"))
    return compare.key_difference(keys, "base", "current")


@query("baseline_error_delta", f"""WITH {_SIDES.replace("capture = 'base'", "capture = 'svc-0'").replace("capture = 'current'", "capture = 'svc-1'")
    .replace("END AS signature, capture FROM logs", "END AS signature, app AS capture FROM logs")}
SELECT signature AS pattern, CAST(b AS BIGINT) AS count, CAST(a AS BIGINT) AS baseline_count FROM ab
WHERE signature IS NOT NULL AND b > 0 AND (a = 0 OR b > 2 * a)""")
def baseline_error_delta(t):
    return compare.baseline_error_delta(t.logs().withColumn("capture", F.col("app")), "svc-0", "svc-1")


@query("diff_summary", f"""WITH {LOGS}
SELECT capture, min(ts) AS started, max(ts) AS stopped, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds,
  CAST(count(*) AS BIGINT) AS lines, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS lines_per_sec,
  'app;env' AS labels, CAST(count(*) FILTER (WHERE {is_error_sql()}) AS BIGINT) AS error_lines
FROM logs GROUP BY capture""")
def diff_summary(t):
    return compare.diff_summary(t.logs(), t.metadata()).withColumn("lines_per_sec", F.round("lines_per_sec", 9))


_VERDICT = """
m AS (
  SELECT sum(a) AS la, sum(b) AS lb, sum(a) FILTER (WHERE signature IS NOT NULL) AS ea, sum(b) FILTER (WHERE signature IS NOT NULL) AS eb,
    count(*) FILTER (WHERE signature IS NOT NULL AND b > 0 AND (a = 0 OR b > 2 * a)) AS fresh FROM ab),
pct AS (
  SELECT *, (eb * 100.0 / lb - ea * 100.0 / la) / (ea * 100.0 / la) * 100 AS ep, (lb - la) * 100.0 / la AS vp FROM m),
v AS (
  SELECT *, CASE
      WHEN ep < -20 THEN 'improvement' WHEN ep > 50 AND fresh > 0 THEN 'regression'
      WHEN abs(vp) > 50 AND abs(ep) <= 50 THEN 'different' WHEN ep > 50 THEN 'different'
      WHEN abs(ep) <= 20 AND fresh = 0 THEN 'stable' WHEN fresh > 0 THEN 'different' ELSE 'stable' END AS verdict,
    CASE
      WHEN ep < -50 THEN 0.9 WHEN ep < -20 THEN 0.7 WHEN ep > 200 AND fresh > 0 THEN 0.95 WHEN ep > 100 AND fresh > 0 THEN 0.85
      WHEN ep > 50 AND fresh > 0 THEN 0.7 WHEN abs(vp) > 50 AND abs(ep) <= 50 THEN 0.6 WHEN ep > 50 THEN 0.5
      WHEN abs(ep) <= 5 AND fresh = 0 THEN 0.95 WHEN abs(ep) <= 20 AND fresh = 0 THEN 0.8 ELSE 0.5 END AS confidence FROM pct)
SELECT '{a}' AS baseline, '{b}' AS current, CAST(la AS BIGINT) AS base_lines, CAST(lb AS BIGINT) AS cur_lines,
  CAST(ea AS BIGINT) AS base_errors, CAST(eb AS BIGINT) AS cur_errors, CAST(fresh AS BIGINT) AS new_patterns,
  CASE WHEN ep >= 0 THEN '+' ELSE '' END || printf('%.0f', CAST(ep AS DOUBLE)) || '%' AS error_rate_change,
  CASE WHEN vp >= 0 THEN '+' ELSE '' END || printf('%.0f', CAST(vp AS DOUBLE)) || '%' AS volume_change,
  verdict, CAST(confidence AS DOUBLE) AS confidence, verdict = 'regression' AS gate_failed FROM v"""


@query("baseline_verdict", "WITH " + _SIDES + "," + _VERDICT.replace("{a}", "base").replace("{b}", "current"))
def baseline_verdict(t):
    return compare.baseline_diff(t.logs(), "base", "current")


@query("baseline_verdict_noisy", "WITH " + _SIDES.replace(
    "capture FROM logs", "capture FROM logs WHERE capture = 'current' OR NOT contains(msg, 'panic')") + ","
    + _VERDICT.replace("{a}", "base").replace("{b}", "current"))
def baseline_verdict_noisy(t):
    """The baseline without its panics: new patterns in the current capture."""
    logs = t.logs().where((F.col("capture") == "current") | ~F.col("msg").contains("panic"))
    return compare.baseline_diff(logs, "base", "current")


@query("percent_change", f"""WITH {LOGS},
n AS (SELECT app, count(*) FILTER (WHERE capture = 'base') AS a, count(*) FILTER (WHERE capture = 'current') AS b FROM logs GROUP BY app)
SELECT app, CASE WHEN (b - a) >= 0 THEN '+' ELSE '' END || printf('%.0f', CAST((b - a) * 100.0 / a AS DOUBLE)) || '%' AS change FROM n""")
def percent_change_by_service(t):
    n = t.logs().groupBy("app").agg(F.count_if(F.col("capture") == "base").alias("a"),
                                    F.count_if(F.col("capture") == "current").alias("b"))
    return n.select("app", percent_text(percent_change(F.col("a"), F.col("b"))).alias("change"))


# ---- merge and skew ------------------------------------------------------------------------

@query("merge", f"WITH {LOGS} SELECT event_id, capture, file, ts, msg FROM logs")
def merge(t):
    logs = t.logs()
    parts = [logs.where(F.col("capture") == c) for c in ("base", "current")]
    return merging.merge(*parts).select("event_id", "capture", "file", "ts", "msg")


_OFFSETS = SKEWED + f""",
seen AS (SELECT capture, {signature_sql()} AS signature, min(ts) AS first FROM skewed WHERE {is_error_sql()} GROUP BY 1, 2),
src AS (SELECT capture, count(*) AS n FROM skewed GROUP BY capture),
ref AS (SELECT capture FROM src ORDER BY n DESC, capture LIMIT 1),
offs AS (
  SELECT s.capture, s.signature, epoch_us(r.first) - epoch_us(s.first) AS off FROM seen r JOIN seen s ON r.signature = s.signature
  WHERE r.capture = (SELECT capture FROM ref) AND s.capture <> (SELECT capture FROM ref)),
rk AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY off) - 1 AS i, count(*) OVER (PARTITION BY capture) AS n FROM offs),
skew AS (
  SELECT capture, CAST(trunc(off / 1000) AS BIGINT) AS offset_ms,
    round(greatest(0.5, least(n / 5.0, 1.0)), 2)::DOUBLE AS confidence, 'error_signature' AS method, abs(off) <= 60000000 AS applied
  FROM rk WHERE i = n // 2)"""


@query("skew_shared_signatures", f"WITH {_OFFSETS} SELECT capture, signature, CAST(off AS BIGINT) AS offset_us FROM offs")
def skew_shared_signatures(t):
    seen = triage.signature_starts(t.skewed_logs(), ["capture"]).persist()
    ref = seen.where("capture = 'A'").select("signature", F.col("first_seen").alias("ref_seen"))
    return seen.where("capture <> 'A'").join(ref, "signature").select(
        "capture", "signature", (F.unix_micros("ref_seen") - F.unix_micros("first_seen")).alias("offset_us"))


@query("skew_estimate", f"WITH {_OFFSETS} SELECT * FROM skew")
def skew_estimate(t):
    return merging.detect_skew(t.skewed_logs())


@query("merge_clock_corrected", f"""WITH {_OFFSETS}
SELECT event_id, s.capture, ts + to_microseconds(coalesce(k.offset_ms, 0) * 1000) AS ts, msg
FROM skewed s LEFT JOIN skew k ON s.capture = k.capture AND k.applied""")
def merge_clock_corrected(t):
    return merging.merge_corrected(t.skewed_logs()).select("event_id", "capture", "ts", "msg")


@query("merge_stored", f"""WITH {LOGS}
SELECT ts + CASE capture WHEN 'base' THEN INTERVAL 90 SECOND ELSE INTERVAL 0 SECOND END AS ts, capture AS source_capture, msg FROM logs""")
def merge_stored(t):
    """Two written captures merged by their files, one with its clock moved, and read back."""
    root, path = scratch_dir(t.spark, "captures"), scratch_dir(t.spark, "merged")
    sinks.write_captures(t.logs(), root, order=CHRONOLOGICAL)
    merged.write_merged(t.spark, path, [merged.Part(root, "base", timedelta(seconds=90)), merged.Part(root, "current")])
    return merged.read_merged(t.spark, path).select("ts", "source_capture", "msg")


def _corrected(t):
    root, path = scratch_dir(t.spark, "captures"), scratch_dir(t.spark, "merged")
    logs = t.skewed_logs()
    sinks.write_captures(logs, root, order=CHRONOLOGICAL)
    merged.write_merged(t.spark, path, merged.parts_of(root, merging.detect_skew(logs), ["A", "B"]))
    return path


@query("merge_corrected_stored", f"""WITH {_OFFSETS}
SELECT s.capture AS source_capture, ts + to_microseconds(coalesce(k.offset_ms, 0) * 1000) AS ts, msg
FROM skewed s LEFT JOIN skew k ON s.capture = k.capture AND k.applied""")
def merge_corrected_stored(t):
    """Skew is found, the captures are merged with corrected clocks, and read back."""
    return merged.read_merged(t.spark, _corrected(t)).select("source_capture", "ts", "msg")


@query("merge_corrected_summary", f"""WITH {_OFFSETS},
fixed AS (SELECT ts + to_microseconds(coalesce(k.offset_ms, 0) * 1000) AS ts FROM skewed s LEFT JOIN skew k ON s.capture = k.capture AND k.applied)
SELECT min(ts) AS data_from, max(ts) AS data_to, CAST(count(*) AS BIGINT) AS total_lines FROM fixed""")
def merge_corrected_summary(t):
    """Period and lines of the merged capture from its index alone."""
    index = captures.read_index(t.spark, _corrected(t))
    return index.agg(F.min("from").alias("data_from"), F.max("to").alias("data_to"), F.sum("lines").alias("total_lines"))


@query("shift_time", f"WITH {LOGS} SELECT event_id, ts - INTERVAL 1500 MILLISECOND AS ts FROM logs")
def shift_time(t):
    return t.logs().select("event_id", merging.shift_time(F.col("ts"), F.lit(-1500000)).alias("ts"))


@query("merge_metadata", f"""WITH {INDEX},
last AS (SELECT t_to FROM idx ORDER BY t_from DESC, t_to DESC LIMIT 1)
SELECT 1 AS version, 'jsonl' AS format, min(t_from) AS started, greatest(max(t_to), (SELECT t_to FROM last)) AS stopped,
  CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(bytes) AS BIGINT) AS total_bytes, 'app;env' AS labels_seen, false AS redacted
FROM idx""")
def merge_metadata(t):
    return merging.merge_metadata(t.metadata(), t.index()).withColumn("labels_seen", F.array_join("labels_seen", ";"))


# ---- faults --------------------------------------------------------------------------------

AT = datetime(2024, 1, 12, tzinfo=timezone.utc)
DAY = timedelta(days=1)
FAULTS = [Fault("error-spike", None, AT, DAY), Fault("latency-spike", "svc-2", AT, DAY),
          Fault("service-down", "svc-3", AT + timedelta(hours=6), DAY)]

_INJECT = LOGS + """,
synthetic AS (SELECT * FROM (VALUES (1, 'error: connection timeout'), (2, 'error: 503 service unavailable'), (3, 'panic: runtime error')) s(copy, text)),
spiked AS (
  SELECT event_id, ts, app, env, 0 AS copy, msg FROM logs
  UNION ALL SELECT event_id, ts, app, env, copy, text FROM logs, synthetic
    WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13'),
slowed AS (
  SELECT event_id, ts, app, copy,
    msg || CASE WHEN app = 'svc-2' AND ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13' THEN ' [SLOW: 5.2s]' ELSE '' END AS msg,
    CASE WHEN copy > 0 OR app = 'svc-2' AND ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13' THEN '_injected=true;' ELSE '' END
      || 'app=' || app || ';env=' || env AS labels
  FROM spiked),
injected AS (SELECT * FROM slowed
  WHERE NOT (app = 'svc-3' AND ts >= TIMESTAMP '2024-01-12 06:00:00' AND ts < TIMESTAMP '2024-01-13 06:00:00'))"""


@query("fault_expansion", f"WITH {_INJECT} SELECT event_id, ts, copy, labels, msg FROM injected")
def fault_expansion(t):
    return faults.inject(t.logs(), FAULTS).select(
        "event_id", "ts", "copy", flatten_labels(F.col("labels")).alias("labels"), "msg")


@query("inject_stats", f"""WITH {_INJECT}
SELECT CAST((SELECT count(*) FROM logs) AS BIGINT) AS original_lines,
  CAST(count(*) - (SELECT count(*) FROM logs) AS BIGINT) AS injected_lines, CAST(count(*) AS BIGINT) AS total_lines, CAST(3 AS BIGINT) AS faults
FROM injected""")
def inject_stats(t):
    return faults.inject_stats(t.logs(), FAULTS)


@query("error_rate_by_capture", f"""WITH {ERRORS}
SELECT capture, CAST(count(*) AS BIGINT) AS error_lines, CAST(count(DISTINCT signature) AS BIGINT) AS signatures FROM errors GROUP BY capture""")
def error_rate_by_capture(t):
    sigs = triage.signature_starts(t.logs(), ["capture"])
    return sigs.groupBy("capture").agg(F.sum("count").alias("error_lines"), F.count(F.lit(1)).alias("signatures"))
