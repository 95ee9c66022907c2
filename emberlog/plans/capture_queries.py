"""Index, summaries, retention, integrity, and captures written and read back."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Window, functions as F

from emberlog.functions.labels import flatten_labels
from emberlog.operators import capture_index as ci, integrity, retention
from emberlog.operators.filters import slice_logs
from emberlog.operators.triage import error_timeline
from emberlog.plans.filter_queries import FROM, T_FROM, T_TO, TO
from emberlog.params import parse_age, parse_size
from emberlog.plans.registry import query
from emberlog.plans.tables import CAPTURES, CHRONOLOGICAL, INDEX, LOGS
from emberlog.plans.triage_queries import TIMELINE
from emberlog.session import scratch_dir
from emberlog.sources import captures as src, sinks


@query("index_build", f"""WITH {INDEX},
flat AS (SELECT capture, file, string_agg(key || '=' || value || ':' || count, ';' ORDER BY key, value) AS labels
         FROM idx_labels GROUP BY capture, file)
SELECT capture, file, t_from AS "from", t_to AS "to", lines, bytes, labels FROM idx JOIN flat USING (capture, file)""")
def index_build(t):
    flat = F.array_sort(F.flatten(F.transform(F.map_entries("labels"), lambda k: F.transform(
        F.map_entries(k["value"]), lambda v: F.concat(k["key"], F.lit("="), v["key"], F.lit(":"), v["value"].cast("string"))))))
    return t.index().withColumn("labels", F.array_join(flat, ";"))


@query("metadata_build", f"""WITH {INDEX}
SELECT capture, 1 AS version, 'jsonl' AS format, min(t_from) AS started, max(t_to) AS stopped, CAST(sum(lines) AS BIGINT) AS total_lines,
  CAST(sum(bytes) AS BIGINT) AS total_bytes, 'app;env' AS labels_seen FROM idx GROUP BY capture""")
def metadata_build(t):
    return t.metadata().drop("redaction").withColumn("labels_seen", F.array_join("labels_seen", ";"))


@query("service_summary", f"""WITH {INDEX},
v AS (SELECT key, value, sum(count) AS lines FROM idx_labels GROUP BY key, value),
best AS (SELECT key FROM v GROUP BY key ORDER BY count(*) DESC, key LIMIT 1)
SELECT key AS label, value, CAST(lines AS BIGINT) AS lines FROM v WHERE key = (SELECT key FROM best)""")
def service_summary(t):
    return ci.service_summary(t.index())


@query("label_breakdown", f"""WITH {INDEX}
SELECT key, value, CAST(sum(count) AS BIGINT) AS lines, CAST(sum(bytes * count // lines) AS BIGINT) AS bytes
FROM idx_labels JOIN idx USING (capture, file) GROUP BY key, value""")
def label_breakdown(t):
    return ci.label_breakdown(t.index())


@query("report_labels", f"WITH {INDEX} SELECT key, CAST(count(DISTINCT value) AS BIGINT) AS values FROM idx_labels GROUP BY key")
def report_labels(t):
    return ci.report_labels(t.index())


@query("capture_summary", f"""WITH {INDEX}
SELECT capture, min(t_from) AS started, max(t_to) AS stopped, CAST(count(*) AS BIGINT) AS files, CAST(sum(lines) AS BIGINT) AS total_lines,
  CAST(sum(bytes) AS BIGINT) AS total_bytes, min(t_from) AS data_from, max(t_to) AS data_to,
  round(sum(lines) / ((epoch_us(max(t_to)) - epoch_us(min(t_from))) / 1e6), 9) AS lines_per_sec
FROM idx GROUP BY capture""")
def capture_summary(t):
    return ci.capture_summary(t.index(), t.metadata()).withColumn("lines_per_sec", F.round("lines_per_sec", 9))


@query("capture_timeline", f"""WITH {INDEX},
r AS (SELECT capture, min(t_from) AS lo, max(t_to) AS hi FROM idx GROUP BY capture),
w AS (
  SELECT capture, lo, hi, CASE WHEN epoch_us(hi) - epoch_us(lo) < 7200e6 THEN 60 WHEN epoch_us(hi) - epoch_us(lo) < 43200e6 THEN 300
      WHEN epoch_us(hi) - epoch_us(lo) < 259200e6 THEN 900 WHEN epoch_us(hi) - epoch_us(lo) < 604800e6 THEN 3600 ELSE 14400 END AS width FROM r),
g AS (SELECT capture, unnest(generate_series(epoch_us(lo) // 1000000 // width * width, epoch_us(hi) // 1000000 // width * width, width)) AS b FROM w),
s AS (
  SELECT capture, file, lines, width, epoch_us(t_from) // 1000000 // width * width AS f, epoch_us(t_to) // 1000000 // width * width AS l
  FROM idx JOIN w USING (capture)),
e AS (SELECT g.capture, g.b, lines // ((l - f) // width + 1) + CASE WHEN (g.b - f) // width < lines % ((l - f) // width + 1) THEN 1 ELSE 0 END AS n
      FROM g LEFT JOIN s ON s.capture = g.capture AND g.b BETWEEN s.f AND s.l)
SELECT capture, make_timestamp(CAST(b AS BIGINT) * 1000000) AS time, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines FROM e GROUP BY capture, b""")
def capture_timeline(t):
    return ci.capture_timeline(t.index())


@query("share_of_total", f"""WITH {INDEX}
SELECT value, CAST(sum(count) AS BIGINT) AS lines, round(sum(count) * 100.0 / sum(sum(count)) OVER (), 6) AS pct
FROM idx_labels WHERE key = 'app' GROUP BY value""")
def share_of_total(t):
    lines = ci.service_summary(t.index()).select("value", "lines")
    return ci.share_of_total(lines, "lines").withColumn("pct", F.round("pct", 6))


# ---- retention -----------------------------------------------------------------------------

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


@query("retention_plan", f"""WITH {CAPTURES},
aged AS (SELECT dir, started, bytes, 'max-age' AS reason FROM captures WHERE started < TIMESTAMP '2024-01-11'),
left_over AS (SELECT *, sum(bytes) OVER (ORDER BY started, dir) AS upto, sum(bytes) OVER () AS total FROM captures WHERE NOT started < TIMESTAMP '2024-01-11'),
size_limit AS (SELECT sum(bytes) // 2 AS cap FROM captures)
SELECT * FROM aged
UNION ALL SELECT dir, started, bytes, 'max-total' FROM left_over WHERE total - (upto - bytes) > (SELECT cap FROM size_limit)""")
def retention_plan(t):
    captures = t.captures()
    cap = captures.agg(F.sum("bytes")).first()[0] or 0
    return retention.retention_plan(captures, NOW, timedelta(days=20), cap // 2)


@query("retention_parameters", f"""WITH {CAPTURES},
left_over AS (SELECT *, sum(bytes) OVER (ORDER BY started, dir) AS upto, sum(bytes) OVER () AS total FROM captures WHERE NOT started < TIMESTAMP '2024-01-11')
SELECT dir, started, bytes, 'max-age' AS reason FROM captures WHERE started < TIMESTAMP '2024-01-11'
UNION ALL SELECT dir, started, bytes, 'max-total' FROM left_over WHERE total - (upto - bytes) > 65536""")
def retention_parameters(t):
    """An age and a size as users write them."""
    return retention.retention_plan(t.captures(), NOW, parse_age("20d"), parse_size("64KB"))


@query("disk_cap_plan", f"""WITH {CAPTURES},
c AS (SELECT dir AS file, bytes, sum(bytes) OVER (ORDER BY dir) AS upto, sum(bytes) OVER () AS total FROM captures)
SELECT file, bytes FROM c WHERE total - (upto - bytes) > total * 2 // 3""")
def disk_cap_plan(t):
    files = t.captures().select(F.col("dir").alias("file"), "bytes")
    total = files.agg(F.sum("bytes")).first()[0] or 0
    return retention.disk_cap_plan(files, total * 2 // 3)


@query("disk_usage", f"""WITH {CAPTURES}
SELECT CAST(sum(bytes) AS BIGINT) AS disk_usage, CAST(1000000 AS BIGINT) AS disk_cap, sum(bytes) > 800000 AS warning FROM captures""")
def disk_usage(t):
    return retention.disk_usage(t.captures(), 1_000_000)


# ---- integrity -----------------------------------------------------------------------------

def _texts(t):
    return t.table("documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))


@query("manifest", """SELECT CAST(doc_id AS VARCHAR) AS file, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents""")
def manifest(t):
    return integrity.manifest(_texts(t))


@query("manifest_lines", "SELECT sha256(text) || '  ' || CAST(doc_id AS VARCHAR) AS value FROM documents")
def manifest_lines(t):
    return integrity.manifest_lines(integrity.manifest(_texts(t)))


@query("manifest_verify", """
WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS file, sha256(text) AS h FROM documents WHERE doc_id % 50 <> 1),
a AS (SELECT CAST(doc_id AS VARCHAR) AS file, sha256(CASE WHEN doc_id % 50 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 50 <> 3)
SELECT file, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'extra' ELSE 'mismatch' END AS status, e.h AS expected, a.h AS actual
FROM e FULL JOIN a USING (file) WHERE e.h IS DISTINCT FROM a.h""")
def manifest_verify(t):
    """Signed before and checked after some files were added, changed and lost."""
    docs, number = _texts(t), F.col("file").cast("bigint") % 50
    text = F.col("content")
    now = docs.where(number != 3).withColumn("content", F.when(number == 2, F.concat(text, F.lit("!"))).otherwise(text))
    signed = integrity.manifest_lines(integrity.manifest(docs.where(number != 1)))
    return integrity.verify(integrity.read_manifest_lines(signed), integrity.manifest(now))


# ---- captures on disk: written from the logs, then read back -------------------------------

def _written(t, **options):
    """The captures of the logs, written below one folder."""
    root = scratch_dir(t.spark, "captures")
    sinks.write_captures(t.logs(), root, order=CHRONOLOGICAL, **options)
    return root


_FLAT = "'app=' || app || ';env=' || env"
_RFC = "regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'"
# Bytes of a stored line with its line end.
_LINE = f"""strlen('{{"ts":"' || {_RFC} || '","labels":{{"app":"' || app || '","env":"' || env || '"}},"msg":"' || msg || '"}}') + 1"""


@query("capture_scan", f"WITH {LOGS} SELECT capture, ts, {_FLAT} AS labels, msg FROM logs")
def capture_scan(t):
    return src.read_capture(t.spark, _written(t)).select(
        "capture", "ts", flatten_labels(F.col("labels")).alias("labels"), "msg")


@query("capture_write", f"""WITH {LOGS},
n AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY ts, event_id) AS place FROM logs)
SELECT capture, CAST(place AS BIGINT) AS place, ts, msg FROM n""")
def capture_write(t):
    """Many small files: their names and lines must keep the order of time."""
    root = _written(t, max_entries=700, compression="gzip")
    lines = src.read_capture(t.spark, root, line_numbers=True)
    # Place in the capture = lines of the files before (one row per file) + line in the file.
    sizes = lines.groupBy("capture", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("capture").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("capture", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["capture", "file"]).select(
        "capture", (F.col("start") + F.col("line_no")).alias("place"), "ts", "msg")


@query("index_scan", f"""WITH {INDEX} SELECT capture, min(t_from) AS "from", max(t_to) AS "to", CAST(sum(lines) AS BIGINT) AS lines,
  (SELECT CAST(sum({_LINE}) AS BIGINT) FROM logs WHERE logs.capture = idx.capture) AS bytes,
  (SELECT string_agg(DISTINCT key || '=' || value, ';' ORDER BY key || '=' || value) FROM idx_labels l WHERE l.capture = idx.capture) AS labels
FROM idx GROUP BY capture""")
def index_scan(t):
    index = src.read_index(t.spark, _written(t))
    rows = ci.label_rows(index).groupBy("capture").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "key", "value"))), ";").alias("labels"))
    return (index.groupBy("capture").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.sum("lines").alias("lines"),
                                         F.sum("bytes").alias("bytes"))
            .join(rows, "capture"))


@query("metadata_scan", f"""WITH {LOGS} SELECT capture, 1 AS version, 'jsonl' AS format, min(ts) AS started, max(ts) AS stopped,
  CAST(count(*) AS BIGINT) AS total_lines, CAST(sum({_LINE}) AS BIGINT) AS total_bytes, 'app;env' AS labels_seen FROM logs GROUP BY capture""")
def metadata_scan(t):
    return src.read_metadata(t.spark, _written(t)).select(
        "capture", "version", "format", "started", "stopped", "total_lines", "total_bytes",
        F.array_join("labels_seen", ";").alias("labels_seen"))


@query("catalog", f"""WITH {LOGS} SELECT capture, min(ts) AS started, max(ts) AS stopped, CAST(count(*) AS BIGINT) AS entries,
  true AS has_files, CAST(sum({_LINE}) AS BIGINT) AS bytes, false AS active, 'app;env' AS labels FROM logs GROUP BY capture""")
def catalog(t):
    """How many files there are depends on the cores that wrote them."""
    return src.catalog(t.spark, _written(t)).withColumn("has_files", F.col("files") > 0).drop("files")


@query("orphan_files", f"WITH {LOGS} SELECT capture, capture = 'current' AS orphaned, CAST(count(*) AS BIGINT) AS lines FROM logs GROUP BY capture")
def orphan_files(t):
    """The index knows the files of one capture; those of the other are orphans, with all its lines."""
    root = _written(t, max_entries=2000)
    index = src.read_index(t.spark, root).where("capture = 'base'")
    orphans = ci.orphan_files(src.list_files(t.spark, root), index, ["capture", "file"])
    lines = src.parse_entries(src.read_lines_of(t.spark, root, orphans))
    found = lines.groupBy("capture").agg(F.lit(True).alias("orphaned"), F.count(F.lit(1)).alias("lines"))
    return found.unionByName(index.groupBy("capture").agg(F.lit(False).alias("orphaned"), F.sum("lines").alias("lines")))


@query("line_totals", f"WITH {LOGS} SELECT CAST(count(*) AS BIGINT) AS total_lines FROM logs")
def line_totals(t):
    """Half of the index is lost; the lines of those files are counted in the files."""
    root = _written(t, max_entries=1000)
    index = src.read_index(t.spark, root).where("crc32(file) % 2 = 0")
    orphans = ci.orphan_files(src.list_files(t.spark, root), index, ["capture", "file"])
    return ci.line_totals(index, src.read_lines_of(t.spark, root, orphans))


@query("inspect_with_orphans", f"""WITH {INDEX} SELECT key, value, CAST(sum(count) AS BIGINT) AS lines FROM idx_labels GROUP BY key, value""")
def inspect_with_orphans(t):
    """Half of the index is lost, and the label table is still complete."""
    root = _written(t, max_entries=1000)
    index = src.read_index(t.spark, root).where("crc32(file) % 2 = 0")
    return ci.label_breakdown(src.full_index(t.spark, root, index)).select("key", "value", "lines")


@query("pruned_scan", f"WITH {LOGS} SELECT capture, ts, msg FROM logs WHERE ts BETWEEN {T_FROM} AND {T_TO} AND app = 'svc-1'")
def pruned_scan(t):
    from emberlog.operators.filters import filter_logs
    root = _written(t, max_entries=500)
    labels = {"app": "svc-1"}
    kept = src.read_capture_pruned(t.spark, root, src.read_index(t.spark, root), FROM, TO, labels)
    return filter_logs(kept, frm=FROM, to=TO, labels=labels).select("capture", "ts", "msg")


@query("tail_capture", f"""WITH {LOGS}, last AS (SELECT * FROM logs ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT ts, msg FROM last WHERE app = 'svc-1'""")
def tail_capture(t):
    root = scratch_dir(t.spark, "capture")
    sinks.write_capture(t.logs(), root, order=CHRONOLOGICAL)
    return src.tail_capture(t.spark, root, 50, label=("app", "svc-1")).select("ts", "msg")


@query("catch_up_new_files", f"WITH {LOGS} SELECT capture, ts, msg FROM logs WHERE capture = 'current'")
def catch_up_new_files(t):
    """Only base had been seen at the last look."""
    root = _written(t)
    files = src.list_files(t.spark, root)
    fresh = src.new_files(files.where("capture = 'base'"), files).select("capture", "file")
    return src.parse_entries(src.read_lines_of(t.spark, root, fresh)).select("capture", "ts", "msg")


@query("signed_capture", f"""WITH {LOGS}
SELECT capture, CAST(capture = 'base' AS BIGINT) AS changed, CAST(capture = 'current' AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added,
  false AS same_root FROM logs GROUP BY capture""")
def signed_capture(t):
    """The written files against a stored manifest. Since it was signed, the first file of base got another byte and
    the last of current was lost: just those are found, and no root digest holds. The digests themselves
    depend on how many files the cores wrote."""
    root = _written(t, max_entries=1000)
    contents = src.read_file_contents(t.spark, root)
    path = scratch_dir(t.spark, "manifest")
    whole = F.concat_ws("/", "capture", "file")
    integrity.manifest_lines(integrity.manifest(contents).withColumn("file", whole)).write.text(path)
    signed = integrity.read_manifest_lines(t.spark.read.text(path))

    ends = src.list_files(t.spark, root).groupBy("capture").agg(F.min("file").alias("first"), F.max("file").alias("last"))
    changed = (F.col("capture") == "base") & (F.col("file") == F.col("first"))
    now = integrity.manifest(contents.join(ends, "capture").where("not (capture = 'current' and file = last)")
                             .withColumn("content", F.when(changed, F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))).drop("first", "last"))
    issues = integrity.verify(signed, now.withColumn("file", whole)).groupBy(F.substring_index("file", "/", 1).alias("capture")).agg(
        *(F.count_if(F.col("status") == status).alias(name) for status, name in (("mismatch", "changed"), ("missing", "lost"), ("extra", "added"))))
    before = signed.select(F.substring_index("file", "/", 1).alias("capture"), F.substring_index("file", "/", -1).alias("file"), "sha256")
    roots = integrity.root_digest(before).select("capture", F.col("root_sha256").alias("signed_root"))
    return (integrity.root_digest(now).join(roots, "capture").join(issues, "capture", "left")
            .select("capture", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("changed", "lost", "added")),
                    (F.col("root_sha256") == F.col("signed_root")).alias("same_root")))


@query("export_parquet", f"WITH {LOGS} SELECT ts, {_FLAT} AS labels, msg FROM logs WHERE ts BETWEEN {T_FROM} AND {T_TO}")
def export_parquet(t):
    path = scratch_dir(t.spark, "export")
    sinks.export(t.logs(), path, "parquet", frm=FROM, to=TO)
    return t.spark.read.parquet(path).withColumn("labels", flatten_labels(F.col("labels")))


@query("export_csv", f"WITH {LOGS} SELECT {_RFC} AS ts, {_FLAT} AS labels, msg FROM logs WHERE app = 'svc-1'")
def export_csv(t):
    path = scratch_dir(t.spark, "export")
    sinks.export(t.logs(), path, "csv", labels={"app": "svc-1"})
    return t.spark.read.option("header", True).option("escape", '"').csv(path)


@query("export_jsonl", f"WITH {LOGS} SELECT {_RFC} AS ts, {_FLAT} AS labels, msg FROM logs WHERE regexp_matches(msg, 'failed')")
def export_jsonl(t):
    path = scratch_dir(t.spark, "export")
    sinks.export(t.logs(), path, "jsonl", grep="failed")
    return t.spark.read.schema("ts string, labels map<string,string>, msg string").json(path).withColumn(
        "labels", flatten_labels(F.col("labels")))


@query("slice_write", f"WITH {LOGS} SELECT ts, msg FROM logs WHERE ts >= {T_FROM} AND ts < {T_TO} AND regexp_matches(msg, 'purchase')")
def slice_write(t):
    path = scratch_dir(t.spark, "slice")
    sinks.slice_write(slice_logs(t.logs(), t.index(), FROM, TO, grep="purchase", keys=("capture", "file")), path)
    return src.read_capture(t.spark, path).select("ts", "msg")


@query("timeline_csv", f"""WITH {TIMELINE}
SELECT strftime(minute, '%Y-%m-%dT%H:%M:%SZ') AS minute, CAST(total_lines AS VARCHAR) AS total_lines, CAST(error_lines AS VARCHAR) AS error_lines FROM timeline""")
def timeline_csv(t):
    path = scratch_dir(t.spark, "timeline")
    sinks.timeline_csv(error_timeline(t.logs()), path)
    return t.spark.read.option("header", True).csv(path)
