"""Triage, correlation and report queries."""

from pyspark.sql import functions as F

from emberlog.functions.labels import service_label
from emberlog.operators import correlate as corr, ordering, report as rep, triage
from emberlog.plans.registry import query
from emberlog.plans.tables import CASCADE, CHRONOLOGICAL, ERRORS, INDEX, LOGS, is_error_sql, signature_sql

SIGS = ERRORS + """,
sigs AS (
  SELECT signature, CAST(count(*) AS BIGINT) AS count, min(ts) AS first_seen, arg_min(msg, (ts, event_id)) AS example
  FROM errors GROUP BY signature)"""

TIMELINE = LOGS + f""",
counts AS (
  SELECT date_trunc('minute', ts) AS minute, count(*) AS total, count(*) FILTER (WHERE {is_error_sql()}) AS errs
  FROM logs GROUP BY 1),
timeline AS (
  SELECT g.minute, CAST(coalesce(c.total, 0) AS BIGINT) AS total_lines, CAST(coalesce(c.errs, 0) AS BIGINT) AS error_lines
  FROM (SELECT unnest(generate_series((SELECT min(minute) FROM counts), (SELECT max(minute) FROM counts), INTERVAL 1 MINUTE)) AS minute) g
  LEFT JOIN counts c USING (minute))"""


def _signatures(t):
    return triage.error_signatures(t.logs(), CHRONOLOGICAL)


@query("triage_totals", f"""WITH {LOGS} SELECT CAST(count(*) AS BIGINT) AS total_lines,
  CAST(count(*) FILTER (WHERE {is_error_sql()}) AS BIGINT) AS error_lines FROM logs""")
def triage_totals(t):
    return triage.totals(t.logs())


@query("error_timeline", f"WITH {TIMELINE} SELECT * FROM timeline")
def error_timeline(t):
    return triage.error_timeline(t.logs())


@query("dense_timeline", f"""WITH {TIMELINE.replace("date_trunc('minute', ts)", "date_trunc('hour', ts)")} SELECT * FROM timeline""")
def dense_timeline(t):
    """Entries with whole hours for times: 59 of 60 minutes are filled in."""
    return triage.error_timeline(t.logs().withColumn("ts", F.date_trunc("hour", "ts")))


@query("error_signatures", f"WITH {SIGS} SELECT * FROM sigs")
def error_signatures(t):
    return _signatures(t)


@query("signature_cap", f"WITH {SIGS} SELECT signature, count FROM sigs ORDER BY count DESC, signature LIMIT 100")
def signature_cap(t):
    return triage.signature_cap(triage.signature_starts(t.logs()), 100).select("signature", "count")


@query("top_errors", f"""WITH {SIGS}
SELECT signature, count, first_seen, example, round(count * 100.0 / (SELECT sum(count) FROM sigs), 6) AS pct_of_errors
FROM sigs ORDER BY count DESC, signature LIMIT 50""")
def top_errors(t):
    logs = t.logs()
    return triage.top_errors(triage.signature_places(logs, CHRONOLOGICAL), logs=logs, order=CHRONOLOGICAL).withColumn("pct_of_errors", F.round("pct_of_errors", 6))


@query("talkers", f"""WITH {LOGS},
pairs AS (SELECT 'app' AS key, app AS value, msg FROM logs UNION ALL SELECT 'env', env, msg FROM logs)
SELECT key, value, CAST(count(*) AS BIGINT) AS total_lines, CAST(count(*) FILTER (WHERE {is_error_sql()}) AS BIGINT) AS error_lines
FROM pairs GROUP BY key, value""")
def talkers(t):
    return triage.talkers(t.logs())


@query("first_seen_by_minute", f"""WITH {SIGS} SELECT date_trunc('minute', first_seen) AS minute, CAST(count(*) AS BIGINT) AS new_signatures
FROM sigs GROUP BY 1""")
def first_seen_by_minute(t):
    return triage.first_seen_by_minute(triage.signature_starts(t.logs()))


PEAK = """
framed AS (
  SELECT minute, sum(error_lines) OVER w AS s, min(minute) OVER w AS f, count(*) OVER w AS n
  FROM timeline WINDOW w AS (ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
peak AS (
  SELECT 'peak_error' AS "window", f AS "from", minute + INTERVAL 1 MINUTE AS "to", CAST(5 AS BIGINT) AS minutes, CAST(s AS BIGINT) AS value
  FROM framed WHERE n = 5 AND s > 0 ORDER BY s DESC, f LIMIT 1)"""
START = """
born AS (SELECT date_trunc('minute', first_seen) AS minute, count(*) AS n FROM sigs GROUP BY 1),
incident AS (
  SELECT 'incident_start' AS "window", minute AS "from", minute + INTERVAL 1 MINUTE AS "to", CAST(1 AS BIGINT) AS minutes, CAST(n AS BIGINT) AS value
  FROM born ORDER BY n DESC, minute LIMIT 1)"""
STEADY = """
med AS (SELECT error_lines AS median FROM (SELECT error_lines, row_number() OVER (ORDER BY error_lines, minute) - 1 AS i,
          count(*) OVER () AS n FROM timeline) WHERE i = n // 2),
calm AS (SELECT minute, row_number() OVER (ORDER BY minute) AS k FROM timeline, med WHERE error_lines <= median),
runs AS (SELECT min(minute) AS f, max(minute) AS l, count(*) AS n FROM calm GROUP BY minute - to_minutes(k)),
steady AS (
  SELECT 'steady_state' AS "window", f AS "from", l + INTERVAL 1 MINUTE AS "to", CAST(n AS BIGINT) AS minutes, CAST((SELECT median FROM med) AS BIGINT) AS value
  FROM runs WHERE n >= 3 ORDER BY n DESC, f LIMIT 1)"""
SIGS_TAIL = f""",
errors AS (SELECT *, {signature_sql()} AS signature FROM logs WHERE {is_error_sql()}),
sigs AS (SELECT signature, min(ts) AS first_seen FROM errors GROUP BY signature)"""


@query("peak_error_window", f"WITH {TIMELINE}, {PEAK} SELECT * FROM peak")
def peak_error_window(t):
    return triage.peak_error_window(triage.error_timeline(t.logs()))


@query("steady_state_window", f"WITH {TIMELINE}, {STEADY} SELECT * FROM steady")
def steady_state_window(t):
    return triage.steady_state_window(triage.error_timeline(t.logs()))


@query("incident_start", f"WITH {SIGS}, {START} SELECT * FROM incident")
def incident_start(t):
    return triage.incident_start(triage.signature_starts(t.logs()))


@query("triage_windows", f"""WITH {TIMELINE} {SIGS_TAIL}, {PEAK}, {START}, {STEADY}
SELECT * FROM peak UNION ALL SELECT * FROM incident UNION ALL SELECT * FROM steady""")
def triage_windows(t):
    logs = t.logs()
    # The timeline is 1440 short rows a day; both windows over it share one scan.
    timeline = triage.error_timeline(logs).persist()
    return triage.windows(timeline, triage.signature_starts(logs))


@query("upper_median", f"""WITH {LOGS},
r AS (SELECT app, strlen(msg) AS n, row_number() OVER (PARTITION BY app ORDER BY strlen(msg), event_id) - 1 AS i,
        count(*) OVER (PARTITION BY app) AS c FROM logs)
SELECT app, CAST(n AS BIGINT) AS median, CAST(c AS BIGINT) AS n FROM r WHERE i = c // 2""")
def upper_median(t):
    sized = t.logs().select("app", F.octet_length("msg").cast("bigint").alias("size"))
    return ordering.upper_median(sized, ["app"], "size", 16)


@query("service_label", f"WITH {LOGS} SELECT event_id, app AS service FROM logs")
def service(t):
    return t.logs().select("event_id", service_label(F.col("labels")).alias("service"))


@query("service_error_buckets", f"""WITH {LOGS}
SELECT app AS service, CAST(epoch_us(ts) // 10000000 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS errors,
  arg_min(msg, (ts, event_id)) AS first_error
FROM logs WHERE {is_error_sql()} GROUP BY 1, 2""")
def service_error_buckets(t):
    return corr.service_error_buckets(t.logs(), order=CHRONOLOGICAL).select("service", "bucket", "errors", "first_error")


@query("mentions_service", rf"""WITH {LOGS}
SELECT event_id, regexp_matches(msg, '(?i)\bsvc-' || CAST((event_id + 1) % 5 AS VARCHAR) || '\b') AS mentioned FROM logs""")
def mentions_service(t):
    name = F.concat(F.lit("SVC-"), ((F.col("event_id") + 1) % 5).cast("string"))
    return t.logs().select("event_id", corr.mentions_service(F.col("msg"), name).alias("mentioned"))


@query("cascade_pattern", rf"""WITH {LOGS}
SELECT event_id, CASE WHEN event_id % 3 * 10 < 10 THEN 'co_failure' WHEN regexp_matches(msg, '(?i)\bsvc-1\b') OR regexp_matches(env, '(?i)\b' || app || '\b')
  THEN 'cascade_timeout' ELSE 'cascade_error' END AS pattern FROM logs""")
def cascade_pattern(t):
    """The rule applied to every entry as if it were a pair's first error."""
    return t.logs().select("event_id", corr.cascade_pattern(
        F.col("event_id") % 3 * 10, F.lit(10), F.col("app"), F.lit("svc-1"), F.col("msg"), F.col("env")).alias("pattern"))


_CORRELATE = CASCADE + f""",
b AS (SELECT app AS s, epoch_us(ts) // 10000000 AS k, count(*) AS n FROM logs WHERE {is_error_sql()} GROUP BY 1, 2),
p AS (SELECT s, min(k) AS lo, max(k) AS hi FROM b GROUP BY s),
fe AS (SELECT app AS s, arg_min(msg, (ts, event_id)) AS e FROM logs WHERE {is_error_sql()} GROUP BY 1),
pr AS (
  SELECT a.s AS src, c.s AS tgt, least(a.lo, c.lo) AS lo, greatest(a.hi, c.hi) AS hi, lag
  FROM p a JOIN p c ON a.s <> c.s, (SELECT unnest(generate_series(0, 5)) AS lag)
  WHERE lag <= greatest(a.hi, c.hi) - least(a.lo, c.lo)),
m AS (
  SELECT src, tgt, lag, hi - lo + 1 - lag AS m,
    (SELECT coalesce(sum(n), 0) FROM b WHERE s = src AND k <= hi - lag) AS sx,
    (SELECT coalesce(sum(n * n), 0) FROM b WHERE s = src AND k <= hi - lag) AS sxx,
    (SELECT coalesce(sum(n), 0) FROM b WHERE s = tgt AND k >= lo + lag) AS sy,
    (SELECT coalesce(sum(n * n), 0) FROM b WHERE s = tgt AND k >= lo + lag) AS syy,
    (SELECT coalesce(sum(x.n * y.n), 0) FROM b x JOIN b y ON y.k = x.k + lag WHERE x.s = src AND y.s = tgt) AS sxy
  FROM pr),
r AS (
  SELECT src, tgt, lag, CASE WHEN m * sxx - sx * sx = 0 OR m * syy - sy * sy = 0 THEN CASE WHEN sx > 0 AND sy > 0 THEN 1.0 ELSE 0.0 END
    ELSE greatest(0.0, CAST(m * sxy - sx * sy AS DOUBLE) / (sqrt(CAST(m * sxx - sx * sx AS DOUBLE)) * sqrt(CAST(m * syy - sy * sy AS DOUBLE)))) END AS r
  FROM m),
best AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY r DESC, lag) AS rk FROM r),
kept AS (SELECT src, tgt, lag, round(r, 2) AS conf FROM best WHERE rk = 1 AND r > 0.5 AND round(r, 2) > 0.5),
dir AS (SELECT *, row_number() OVER (PARTITION BY least(src, tgt), greatest(src, tgt) ORDER BY conf DESC, src) AS rk FROM kept),
corr AS (
  SELECT src AS source, tgt AS target, CAST(lag * 10 AS DOUBLE) AS lag_seconds,
    CASE WHEN lag * 10 < 10 THEN 'co_failure'
      WHEN regexp_matches(a.e, '(?i)\\b' || tgt || '\\b') OR regexp_matches(c.e, '(?i)\\b' || src || '\\b') THEN 'cascade_timeout'
      ELSE 'cascade_error' END AS pattern,
    CAST(conf AS DOUBLE) AS confidence, a.e AS source_error, c.e AS target_error
  FROM dir JOIN fe a ON a.s = src JOIN fe c ON c.s = tgt WHERE rk = 1)"""


def _correlations(t):
    return corr.correlate(t.cascade_logs(), order=CHRONOLOGICAL)


@query("lag_correlation", f"WITH {_CORRELATE} SELECT * FROM corr")
def lag_correlation(t):
    return _correlations(t)


@query("lag_correlation_services", "WITH " + _CORRELATE.replace(CASCADE, LOGS) + " SELECT * FROM corr")
def lag_correlation_services(t):
    """The services of the plain logs, whose errors come at random times."""
    return corr.correlate(t.logs(), order=CHRONOLOGICAL)


@query("best_direction", f"""WITH {_CORRELATE}
SELECT src AS source, tgt AS target, CAST(conf AS DOUBLE) AS confidence FROM dir WHERE rk = 1""")
def best_direction(t):
    return _correlations(t).select("source", "target", "confidence")


@query("sequence_participants", f"""WITH {_CORRELATE},
ranked AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, source, target) AS i FROM corr),
names AS (SELECT source AS name, i FROM ranked UNION ALL SELECT target, NULL FROM ranked)
SELECT name, CAST(row_number() OVER (ORDER BY min(i) ASC NULLS LAST, name) - 1 AS BIGINT) AS "index" FROM names GROUP BY name""")
def sequence_participants(t):
    return corr.participants(_correlations(t))


@query("sequence_interactions", f"""WITH {_CORRELATE}
SELECT CAST(row_number() OVER (ORDER BY lag_seconds, confidence DESC, source, target) AS BIGINT) AS position,
  source AS "from", target AS "to", lag_seconds, pattern, confidence,
  pattern || ' +' || CAST(CAST(lag_seconds AS BIGINT) AS VARCHAR) || 's (' || CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR) || '%)' AS label
FROM corr""")
def sequence_interactions(t):
    return corr.interactions(_correlations(t))


@query("report", f"""WITH {INDEX},
errs AS (SELECT capture, {signature_sql()} AS signature FROM logs WHERE {is_error_sql()}),
s AS (SELECT capture, signature, count(*) AS n, row_number() OVER (PARTITION BY capture ORDER BY count(*) DESC, signature) AS rk
      FROM errs GROUP BY capture, signature),
best AS (
  SELECT capture, bool_or(contains(signature, 'OOMKilled') OR contains(signature, 'panic') OR contains(signature, 'FATAL')
      OR contains(signature, 'segfault') OR contains(signature, 'core dumped')) AS critical,
    max(CASE WHEN rk = 1 THEN signature END) AS top_error, max(CASE WHEN rk = 1 THEN n END) AS top_error_count
  FROM s WHERE rk <= 20 GROUP BY capture),
tot AS (SELECT capture, min(ts) AS started, max(ts) AS stopped, count(*) AS total_lines,
          count(*) FILTER (WHERE {is_error_sql()}) AS error_lines FROM logs GROUP BY capture),
f AS (SELECT capture, count(*) AS files, sum(bytes) AS bytes FROM idx GROUP BY capture)
SELECT capture, started, stopped, round((epoch_us(stopped) - epoch_us(started)) / 1e6, 3) AS duration_seconds,
  CAST(files AS BIGINT) AS files, CAST(bytes AS BIGINT) AS bytes, CAST(total_lines AS BIGINT) AS total_lines,
  CAST(error_lines AS BIGINT) AS error_lines, top_error, CAST(top_error_count AS BIGINT) AS top_error_count,
  round(error_lines * 100.0 / total_lines, 6) AS error_rate_pct,
  CASE WHEN critical OR error_lines * 100.0 / total_lines > 5 THEN 'high' WHEN error_lines * 100.0 / total_lines > 1 THEN 'medium' ELSE 'low' END AS severity
FROM tot JOIN f USING (capture) LEFT JOIN best USING (capture)""")
def report(t):
    return rep.report(t.logs(), t.index(), t.metadata()).withColumns(
        {"duration_seconds": F.round("duration_seconds", 3), "error_rate_pct": F.round("error_rate_pct", 6)})


_BASE = "logs AS (SELECT * FROM all_logs WHERE capture = 'base')"
_BASE_LOGS = LOGS.replace("logs AS (", "all_logs AS (", 1) + ", " + _BASE


@query("incident_report", f"""WITH {TIMELINE.replace(LOGS, _BASE_LOGS)},
errors AS (SELECT *, {signature_sql()} AS signature FROM logs WHERE {is_error_sql()}),
sigs AS (SELECT signature, count(*) AS count, min(ts) AS first_seen, arg_min(msg, (ts, event_id)) AS example FROM errors GROUP BY signature),
top AS (SELECT * FROM sigs ORDER BY count DESC, signature LIMIT 20),
{PEAK}, {START}, {STEADY},
w AS (SELECT * FROM peak UNION ALL SELECT * FROM incident UNION ALL SELECT * FROM steady)
SELECT 'base' AS capture, CAST((SELECT count(*) FROM logs) AS BIGINT) AS total_lines, CAST((SELECT count(*) FROM errors) AS BIGINT) AS error_lines,
  CASE WHEN (SELECT bool_or(contains(signature, 'panic')) FROM top) OR (SELECT count(*) FROM errors) * 100.0 / (SELECT count(*) FROM logs) > 5 THEN 'high'
    WHEN (SELECT count(*) FROM errors) * 100.0 / (SELECT count(*) FROM logs) > 1 THEN 'medium' ELSE 'low' END AS severity,
  (SELECT 'app=' || count(DISTINCT app) || ';env=' || count(DISTINCT env) FROM logs) AS labels,
  (SELECT string_agg(count || ' ' || signature || ' | ' || example, chr(10) ORDER BY count DESC, signature) FROM top) AS top_errors,
  (SELECT string_agg("window" || ' ' || strftime("from", '%Y-%m-%d %H:%M') || ' ' || minutes || ' ' || value, chr(10) ORDER BY "window") FROM w) AS windows""")
def incident_report(t):
    r = rep.incident_report(t.logs(), t.index(), t.metadata(), "base", order=CHRONOLOGICAL)
    text = {
        "labels": F.array_join(F.transform("labels", lambda e: F.concat_ws("=", e["key"], e["values"].cast("string"))), ";"),
        "top_errors": F.array_join(F.transform("top_errors", lambda e: F.concat(
            e["count"].cast("string"), F.lit(" "), e["signature"], F.lit(" | "), e["example"])), "\n"),
        "windows": F.array_join(F.transform("windows", lambda e: F.concat_ws(
            " ", e["window"], F.date_format(e["from"], "yyyy-MM-dd HH:mm"), e["minutes"].cast("string"), e["value"].cast("string"))), "\n"),
    }
    return r.select("capture", "total_lines", "error_lines", "severity", *[c.alias(n) for n, c in text.items()])


@query("severity", f"""WITH {LOGS},
tot AS (SELECT app, count(*) AS n, count(*) FILTER (WHERE contains(msg, 'failed')) AS e FROM logs GROUP BY app)
SELECT app, CASE WHEN e * 100.0 / n > 5 THEN 'high' WHEN e * 100.0 / n > 1 THEN 'medium' ELSE 'low' END AS severity FROM tot""")
def severity(t):
    from emberlog.functions.scoring import severity as rule
    rate = F.count_if(F.col("msg").contains("failed")) * 100.0 / F.count(F.lit(1))
    return t.logs().groupBy("app").agg(rule(rate, F.lit(False)).alias("severity"))
