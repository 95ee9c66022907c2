"""Filters, search and the export-analysis queries."""

from datetime import datetime, timezone

from pyspark.sql import Window, functions as F

from emberlog import params
from emberlog.functions.labels import flatten_labels
from emberlog.functions.messages import is_error, normalize_message
from emberlog.operators import filters, grep as search
from emberlog.operators.ordering import semi_join_small
from emberlog.plans.registry import query
from emberlog.plans.tables import CHRONOLOGICAL, HALF, INDEX, LOGS, NUMBERED, is_error_sql, signature_sql

FROM = datetime(2024, 1, 10, 6, tzinfo=timezone.utc)
TO = datetime(2024, 1, 20, 18, tzinfo=timezone.utc)
COLUMNS = ("event_id", "ts", "app", "env", "msg")
PICK = "event_id, ts, app, env, msg"
T_FROM, T_TO = "TIMESTAMP '2024-01-10 06:00:00'", "TIMESTAMP '2024-01-20 18:00:00'"
REFUSED = r"(refused|timeout).*:?\d+"


def _sql(where: str) -> str:
    return f"WITH {LOGS} SELECT {PICK} FROM logs WHERE {where}"


@query("filter_time", _sql(f"ts BETWEEN {T_FROM} AND {T_TO}"))
def filter_time(t):
    return t.logs().where(filters.time_between(F.col("ts"), FROM, TO)).select(*COLUMNS)


@query("filter_parameters", _sql("ts >= TIMESTAMP '2024-01-16 10:32:00' AND ts <= TIMESTAMP '2024-01-20 17:30:00' AND app = 'svc-1'"))
def filter_parameters(t):
    """Times and labels as users write them: a clock time of a day, an age, ``key=value``."""
    first, last = params.parse_time("10:32", HALF, TO), params.parse_time("-30m", HALF, TO)
    logs = t.logs().where(filters.time_between(F.col("ts"), first, last))
    return filters.filter_logs(logs, labels=dict([params.parse_label("app=svc-1")])).select(*COLUMNS)


@query("filter_labels", _sql("app = 'svc-1' AND env = 'prod'"))
def filter_labels(t):
    return filters.filter_logs(t.logs(), labels={"app": "svc-1", "env": "prod", "zone": ""}).select(*COLUMNS)


@query("filter_regex", _sql(r"regexp_matches(msg, '\b(refused|svc-[23]\b)') OR regexp_matches(app, '\b(refused|svc-[23]\b)') OR regexp_matches(env, '\b(refused|svc-[23]\b)')"))
def filter_regex(t):
    return filters.filter_logs(t.logs(), grep=r"\b(refused|svc-[23]\b)").select(*COLUMNS)


@query("filter_all", _sql(f"ts BETWEEN {T_FROM} AND {T_TO} AND app = 'svc-2' AND regexp_matches(msg, '{REFUSED}')"))
def filter_all(t):
    return filters.filter_logs(t.logs(), frm=FROM, to=TO, labels={"app": "svc-2"}, grep=REFUSED).select(*COLUMNS)


@query("file_skip", f"""WITH {INDEX}
SELECT capture, file, lines FROM idx i
WHERE t_to >= {T_FROM} AND t_from <= {T_TO}
  AND EXISTS (SELECT 1 FROM idx_labels l WHERE l.capture = i.capture AND l.file = i.file AND l.key = 'app' AND l.value = 'svc-3')""")
def file_skip(t):
    return filters.prune_files(t.index(), frm=FROM, to=TO, labels={"app": "svc-3", "zone": "x"}).select(
        "capture", "file", "lines")


@query("index_semi", f"""WITH {INDEX}
SELECT {PICK} FROM logs WHERE (capture, file) IN (
  SELECT (capture, file) FROM idx WHERE t_to >= {T_FROM} AND t_from <= {T_TO})""")
def index_semi(t):
    files = filters.prune_files(t.index(), frm=FROM, to=TO).select("capture", "file")
    return semi_join_small(t.logs(), files, ["capture", "file"]).select(*COLUMNS)


@query("slice_filter", f"""WITH {INDEX}
SELECT {PICK} FROM logs WHERE ts >= {T_FROM} AND ts < {T_TO} AND regexp_matches(msg, 'took \\d+ms$')
  AND (capture, file) IN (
    SELECT (i.capture, i.file) FROM idx i JOIN idx_labels l ON l.capture = i.capture AND l.file = i.file
    WHERE t_to >= {T_FROM} AND t_from <= {T_TO} AND l.key = 'app' AND l.value IN ('svc-1', 'svc-9'))""")
def slice_filter(t):
    return filters.slice_logs(t.logs(), t.index(), FROM, TO, [("app", "svc-1"), ("app", "svc-9")], r"took \d+ms$",
                              keys=("capture", "file")).select(*COLUMNS)


@query("filter_label_present", _sql("env = 'staging'"))
def filter_label_present(t):
    return filters.filter_label_present(t.logs(), "env", "staging").select(*COLUMNS)


@query("filter_stack", _sql(r"app = 'svc-1' AND (regexp_matches(msg, 'took|failed') OR regexp_matches(env, 'took|failed')) AND NOT regexp_matches(msg, '^click') AND NOT regexp_matches(env, '^dev$')"))
def filter_stack(t):
    return filters.filter_stack(t.logs(), [("keep", "took|failed"), ("hide", "^click"), ("hide", "^dev$")],
                                label=("app", "svc-1")).select(*COLUMNS)


@query("time_jump", f"""WITH {LOGS} SELECT {PICK} FROM logs
WHERE contains(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '14:3') ORDER BY ts, event_id LIMIT 1""")
def time_jump(t):
    return filters.time_jump(t.logs(), " 14:3 ", CHRONOLOGICAL).select(*COLUMNS)


@query("is_error", f"WITH {LOGS} SELECT event_id, {is_error_sql()} AS is_error FROM logs")
def is_error_flag(t):
    return t.logs().select("event_id", is_error(F.col("msg")).alias("is_error"))


@query("is_error_documents", f"SELECT doc_id, {is_error_sql('text')} AS is_error FROM documents")
def is_error_documents(t):
    return t.messages().select("doc_id", is_error(F.col("msg")).alias("is_error"))


@query("normalize_message", f"WITH {LOGS} SELECT event_id, {signature_sql()} AS signature FROM logs")
def normalize(t):
    return t.logs().select("event_id", normalize_message(F.col("msg")).alias("signature"))


@query("normalize_documents", f"SELECT doc_id, md5({signature_sql('text')}) AS signature_md5 FROM documents")
def normalize_documents(t):
    return t.messages().select("doc_id", F.md5(normalize_message(F.col("msg"))).alias("signature_md5"))


@query("filter_regex_documents", r"""SELECT doc_id, lang FROM documents
WHERE regexp_matches(text, '(?i)\b(licen[cs]e|copyright)\b') OR regexp_matches(coalesce(lang, ''), '(?i)\b(licen[cs]e|copyright)\b')
  OR regexp_matches(coalesce(source, ''), '(?i)\b(licen[cs]e|copyright)\b')""")
def filter_regex_documents(t):
    return filters.filter_logs(t.messages(), grep=r"(?i)\b(licen[cs]e|copyright)\b").select(
        "doc_id", F.try_element_at("labels", F.lit("lang")).alias("lang"))


@query("grep_match", _sql("regexp_matches(msg, 'job .* failed') OR regexp_matches(app, 'job .* failed') OR regexp_matches(env, 'job .* failed')"))
def grep_match(t):
    return search.grep(t.logs(), "job .* failed", sort=True, order=CHRONOLOGICAL).select(*COLUMNS)


@query("grep_count", f"""WITH {LOGS} SELECT file, CAST(count(*) AS BIGINT) AS count FROM logs
WHERE regexp_matches(msg, 'panic') GROUP BY file""")
def grep_count(t):
    return search.grep_count(t.logs(), "panic")


@query("line_number", f"WITH {NUMBERED} SELECT event_id, file, CAST(line_no AS BIGINT) AS line_no FROM numbered")
def line_number(t):
    return t.numbered_logs().select("event_id", "file", "line_no")


CONTEXT = 2
_SPANS = NUMBERED + f""",
hits AS (SELECT file, line_no FROM numbered WHERE regexp_matches(msg, 'panic') OR regexp_matches(app, 'panic') OR regexp_matches(env, 'panic')),
marked AS (
  SELECT n.*, (n.file, n.line_no) IN (SELECT (file, line_no) FROM hits) AS is_match,
    EXISTS (SELECT 1 FROM hits h WHERE h.file = n.file AND h.line_no BETWEEN n.line_no - {CONTEXT} AND n.line_no + {CONTEXT}) AS shown,
    EXISTS (SELECT 1 FROM hits h WHERE h.file = n.file AND h.line_no > n.line_no) AS has_later
  FROM numbered n),
emitted AS (
  SELECT *, CASE WHEN lag(line_no) OVER (PARTITION BY file ORDER BY line_no) = line_no - 1 THEN 0 ELSE 1 END AS starts
  FROM marked WHERE shown)"""


@query("grep_context", f"""WITH {_SPANS}
SELECT event_id, file, CAST(line_no AS BIGINT) AS line_no, msg,
  CAST(sum(starts) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS "group",
  CASE WHEN is_match THEN '' WHEN has_later THEN 'before' ELSE 'after' END AS context
FROM emitted""")
def grep_context(t):
    return search.grep_context(t.numbered_logs(), "panic", CONTEXT).select(
        "event_id", "file", "line_no", "msg", "group", "context")


@query("context_spans", f"""WITH {_SPANS},
grouped AS (SELECT file, line_no, sum(starts) OVER (PARTITION BY file ORDER BY line_no) AS g FROM emitted)
SELECT file, CAST(g AS BIGINT) AS "group", CAST(min(line_no) AS BIGINT) AS first_line, CAST(max(line_no) AS BIGINT) AS last_line
FROM grouped GROUP BY file, g""")
def context_spans(t):
    logs = t.numbered_logs()
    hits = logs.where(filters.match(grep="panic")).select("file", "line_no")
    spans = search.context_spans(hits, CONTEXT)
    shown = logs.select("file", "line_no").join(spans, ["file", "line_no"])
    return shown.groupBy("file", "group").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("chronological_sort", f"WITH {LOGS} SELECT event_id, ts, file, msg FROM logs ORDER BY ts, event_id")
def chronological_sort(t):
    return t.logs().select("event_id", "ts", "file", "msg").orderBy(*CHRONOLOGICAL)


@query("early_stop", f"WITH {LOGS} SELECT event_id, ts, msg FROM logs WHERE contains(msg, 'panic') ORDER BY ts, event_id LIMIT 25")
def early_stop(t):
    """The first 25 hits, after which a scan may stop."""
    return search.grep(t.logs(), "panic", sort=True, order=CHRONOLOGICAL).select("event_id", "ts", "msg").limit(25)


@query("early_stop_any", f"WITH {LOGS} SELECT CAST(least(25, count(*)) AS BIGINT) AS hits, true AS all_match FROM logs WHERE contains(msg, 'panic')")
def early_stop_any(t):
    """Any 25 hits: how many there are, and that they are hits."""
    return search.first_hits(t.logs(), 25, "panic").agg(
        F.count(F.lit(1)).alias("hits"), F.coalesce(F.bool_and(F.col("msg").contains("panic")), F.lit(True)).alias("all_match"))


_TAIL = f"""WITH {NUMBERED},
last AS (SELECT * FROM numbered WHERE file = (SELECT max(file) FROM numbered) ORDER BY line_no DESC LIMIT 100)
SELECT event_id, ts, app, msg FROM last WHERE app = 'svc-1' AND (regexp_matches(msg, 'took') OR regexp_matches(app, 'took') OR regexp_matches(env, 'took'))"""


@query("tail_n", _TAIL)
def tail_n(t):
    return filters.tail_n(t.logs(), 100, "took", ("app", "svc-1"), order=CHRONOLOGICAL).select(
        "event_id", "ts", "app", "msg")


@query("flatten_labels", f"WITH {LOGS} SELECT event_id, 'app=' || app || ';env=' || env AS labels FROM logs")
def flatten(t):
    return t.logs().select("event_id", flatten_labels(F.col("labels")).alias("labels"))


@query("replay_offset", f"""WITH {LOGS}
SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM logs)) / 4e6 AS offset_seconds FROM logs""")
def replay_offset(t):
    return filters.replay_offset(t.logs(), 4.0).select("event_id", "offset_seconds")


# ---- analyses of an exported capture -------------------------------------------------------
# Which figures these queries give, their words, units and limits.

@query("total_lines", f"WITH {LOGS} SELECT CAST(count(*) AS BIGINT) AS total_lines FROM logs")
def total_lines(t):
    return t.logs().agg(F.count(F.lit(1)).alias("total_lines"))


@query("lines_per_service", f"""WITH {LOGS}
SELECT app AS service, CAST(count(*) AS BIGINT) AS lines, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
FROM logs GROUP BY app""")
def lines_per_service(t):
    counts = t.logs().groupBy(F.col("labels")["app"].alias("service")).agg(F.count(F.lit(1)).alias("lines"))
    share = F.col("lines") * F.lit(100.0) / F.sum("lines").over(Window.partitionBy())
    return counts.select("service", "lines", F.round(share, 1).alias("pct")).orderBy(F.desc("lines"))


@query("errors_per_minute", f"""WITH {LOGS}
SELECT date_trunc('minute', ts) AS minute, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE msg ILIKE '%error%' OR msg ILIKE '%fail%') AS BIGINT) AS errors
FROM logs GROUP BY 1""")
def errors_per_minute(t):
    bad = F.col("msg").ilike("%error%") | F.col("msg").ilike("%fail%")
    return (t.logs().groupBy(F.date_trunc("minute", "ts").alias("minute"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("errors")).orderBy("minute"))


@query("top_error_messages", rf"""WITH {LOGS},
patterns AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(msg,
      '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '<UUID>', 'gi'),
      '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}', '<IP>', 'g'), '\d+ms', '<DUR>', 'g') AS pattern
  FROM logs WHERE msg ILIKE '%error%' OR msg ILIKE '%fail%' OR msg ILIKE '%timeout%')
SELECT pattern, CAST(count(*) AS BIGINT) AS occurrences FROM patterns GROUP BY pattern
ORDER BY occurrences DESC, pattern LIMIT 20""")
def top_error_messages(t):
    msg = F.col("msg")
    uuid = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    pattern = msg
    for regex, placeholder in ((uuid, "<UUID>"), (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"), (r"\d+ms", "<DUR>")):
        pattern = F.regexp_replace(pattern, regex, placeholder)
    bad = msg.ilike("%error%") | msg.ilike("%fail%") | msg.ilike("%timeout%")
    return (t.logs().where(bad).groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("occurrences"))
            .orderBy(F.desc("occurrences"), "pattern").limit(20))


@query("peak_seconds", f"""WITH {LOGS}
SELECT date_trunc('second', ts) AS second, CAST(count(*) AS BIGINT) AS lines_per_sec
FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def peak_seconds(t):
    return (t.logs().groupBy(F.date_trunc("second", "ts").alias("second")).agg(F.count(F.lit(1)).alias("lines_per_sec"))
            .orderBy(F.desc("lines_per_sec"), "second").limit(10))


@query("service_error_rate", f"""WITH {LOGS}
SELECT app AS service, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE msg ILIKE '%error%' OR msg ILIKE '%timeout%') AS BIGINT) AS errors,
  round(count(*) FILTER (WHERE msg ILIKE '%error%' OR msg ILIKE '%timeout%') * 100.0 / count(*), 2) AS error_pct
FROM logs GROUP BY app""")
def service_error_rate(t):
    bad = F.col("msg").ilike("%error%") | F.col("msg").ilike("%timeout%")
    return (t.logs().groupBy(F.col("labels")["app"].alias("service"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("errors"))
            .withColumn("error_pct", F.round(F.col("errors") * F.lit(100.0) / F.col("total"), 2))
            .orderBy(F.desc("error_pct")))
