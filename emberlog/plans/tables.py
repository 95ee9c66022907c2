"""Views of the given tables in the shape the operators expect, and the same views in SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from emberlog.functions.messages import ERROR_KEYWORDS, is_error_once
from emberlog.operators.capture_index import build_index, build_metadata
from emberlog.operators.ingest import to_loki_payloads
from emberlog.operators.ordering import number_rows
from emberlog.session import configure, size_shuffles

CHRONOLOGICAL = ("ts", "event_id")
HALF = datetime(2024, 1, 16, tzinfo=timezone.utc)  # where the base capture ends and the current one begins


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = size_shuffles(configure(spark), sf_dir)
        self.sf_dir = sf_dir
        self._index = None

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        df = self.spark.read.parquet(path)
        if not any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema.fields):
            return df
        # Times without a zone are UTC instants. Reading them as such (instead of casting the
        # column) lets time filters reach the scan.
        schema = T.StructType([T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType)
                                             else f.dataType) for f in df.schema.fields])
        return self.spark.read.schema(schema).parquet(path)

    def logs(self) -> DataFrame:
        """``events`` as log entries; every event becomes one entry."""
        e = self.table("events")
        md5 = F.md5(F.col("event_id").cast("string"))
        took = F.floor("value").cast("string")
        uid, eid = F.col("user_id").cast("string"), F.col("event_id")
        dashed = F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        error = (F.when(eid % 4 == 0, F.concat(F.lit("error: connection timeout for request "),
                                               (eid + 10000).cast("string"), F.lit(" after "), took, F.lit("ms")))
                 .when(eid % 4 == 1, F.concat(F.lit("connection refused to 10.0."), (F.col("user_id") % 256).cast("string"),
                                              F.lit("."), (eid % 256).cast("string"), F.lit(":8080")))
                 .when(eid % 4 == 2, F.concat(F.lit("panic: nil pointer at 0x"), F.substring(md5, 1, 8),
                                              F.lit(" in svc-"), ((F.col("user_id") + 1) % 5).cast("string")))
                 .otherwise(F.concat(F.lit("job "), dashed, F.lit(" failed"))))
        plain = F.concat("event_type", F.lit(" user="), uid, F.lit(" took "), took, F.lit("ms"))
        app = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))
        env = F.when(F.col("user_id") % 3 == 0, "prod").when(F.col("user_id") % 3 == 1, "staging").otherwise("dev")
        return e.select(
            "event_id", "ts", app.alias("app"), env.alias("env"),
            F.create_map(F.lit("app"), app, F.lit("env"), env).alias("labels"),
            F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T000000-000.jsonl")).alias("file"),
            F.when(F.col("ts") < F.lit(HALF), "base").otherwise("current").alias("capture"),
            F.when(F.col("event_type") == "error", error).otherwise(plain).alias("msg"))

    def numbered_logs(self) -> DataFrame:
        """Log entries with their line number in the file, counted second by second."""
        return number_rows(self.logs(), CHRONOLOGICAL, F.date_trunc("second", "ts"), ["file"])

    def messages(self) -> DataFrame:
        """``documents`` as messages, whole texts."""
        return self.table("documents").select(
            "doc_id", F.col("text").alias("msg"),
            F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")),
                         lambda k, v: v.isNotNull()).alias("labels"))

    def cascade_logs(self) -> DataFrame:
        """All entries as an upstream service; its errors again 10 s later downstream, and as noise 5 h later."""
        def copy(app: str, late: int, text: str):
            return F.struct(F.lit(app).alias("app"), F.lit(late).alias("late"), F.concat(F.lit(text), F.col("msg")).alias("text"))
        copies = F.when(is_error_once(F.col("msg")), F.array(
            copy("upstream", 0, "error: timeout calling downstream: "), copy("downstream", 10, "error processing order: "),
            copy("noise", 18000, "error: unrelated: "))).otherwise(F.array(copy("upstream", 0, "")))
        return (self.logs().select("event_id", "ts", F.inline(copies))
                .select("event_id", F.timestamp_micros(F.unix_micros("ts") + F.col("late").cast("bigint") * 1000000).alias("ts"),
                        "app", F.create_map(F.lit("app"), F.col("app")).alias("labels"), F.col("text").alias("msg")))

    def skewed_logs(self) -> DataFrame:
        """Source A: all entries. Source B: their errors with a clock 3 s ahead."""
        base = self.logs()
        copies = F.array(F.struct(F.lit("A").alias("capture"), F.lit(0).alias("_late")),
                         F.struct(F.lit("B").alias("capture"), F.lit(3000000).alias("_late")))
        return (base.drop("capture").select("*", F.inline(copies))
                .where((F.col("capture") == "A") | is_error_once(F.col("msg")))
                .withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("_late"))).drop("_late"))

    def index(self) -> DataFrame:
        """The per-file index. It is short and used repeatedly, so it is built once and kept."""
        if self._index is None:
            self._index = build_index(self.logs(), F.octet_length("msg"), ["capture", "file"]).persist()
        return self._index

    def metadata(self) -> DataFrame:
        return build_metadata(self.index())

    def captures(self) -> DataFrame:
        """One capture per day, as retention sees them."""
        return self.logs().groupBy(F.col("file").alias("dir")).agg(
            F.min("ts").alias("started"), F.sum(F.octet_length("msg")).cast("bigint").alias("bytes"))

    def payloads(self) -> DataFrame:
        """Log entries packed as push payloads, with a payload id."""
        packed = to_loki_payloads(self.logs(), flush_seconds=3600.0, order=CHRONOLOGICAL)
        return packed.withColumn("payload_id", F.concat_ws("/", "label_set", F.col("flush").cast("string"),
                                                           F.col("part").cast("string"), F.col("piece").cast("string")))

    def snapshots(self) -> DataFrame:
        """Hourly counters: cumulative events received, errors dropped, value as disk use."""
        hourly = (self.table("events")
                  .groupBy(F.date_trunc("hour", "ts").alias("ts"))
                  .agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("event_type") == "error").alias("dropped"),
                       F.sum(F.floor("value")).alias("used")))
        # One row per hour, whatever the volume. The cap is one and a half times the usual use.
        cap = hourly.agg(F.expr("sum(used) div count(1) * 3 div 2")).scalar()
        upto = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return hourly.select(
            "ts", F.sum("received").over(upto).alias("logs_received"), F.sum("dropped").over(upto).alias("logs_dropped"),
            F.sum("used").over(upto).alias("bytes_written"), F.col("used").alias("disk_usage"),
            cap.alias("disk_cap"))


# ---- the same views for the SQL twins -----------------------------------------------------

LOGS = """
logs AS (
  SELECT event_id, ts,
    'svc-' || CAST(user_id % 5 AS VARCHAR) AS app,
    CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS env,
    strftime(ts, '%Y-%m-%d') || 'T000000-000.jsonl' AS file,
    CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'base' ELSE 'current' END AS capture,
    CASE WHEN event_type <> 'error' THEN
        event_type || ' user=' || CAST(user_id AS VARCHAR) || ' took ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'ms'
      WHEN event_id % 4 = 0 THEN
        'error: connection timeout for request ' || CAST(event_id + 10000 AS VARCHAR) || ' after ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'ms'
      WHEN event_id % 4 = 1 THEN
        'connection refused to 10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) || ':8080'
      WHEN event_id % 4 = 2 THEN
        'panic: nil pointer at 0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || ' in svc-' || CAST((user_id + 1) % 5 AS VARCHAR)
      ELSE 'job ' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(event_id AS VARCHAR)), 9, 4) || '-'
        || substr(md5(CAST(event_id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(event_id AS VARCHAR)), 17, 4) || '-'
        || substr(md5(CAST(event_id AS VARCHAR)), 21, 12) || ' failed' END AS msg
  FROM events)"""

NUMBERED = LOGS + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) AS line_no FROM logs)"""


def is_error_sql(msg: str = "msg") -> str:
    return "(" + " OR ".join(f"contains(lower({msg}), '{k}')" for k in ERROR_KEYWORDS) + ")"


def signature_sql(msg: str = "msg") -> str:
    # The signature rules as DuckDB's regex engine reads them.
    rules = (
        (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
        (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[.\d]*Z?", "<TS>"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
        (r"0x[0-9a-fA-F]+", "<HEX>"),
        (r"\b\d+\.?\d*(?:ms|us|µs|ns|s|m|h)\b", "<DUR>"),
        (r"\b\d{4,}\b", "<N>"),
    )
    for pattern, placeholder in rules:
        msg = f"regexp_replace({msg}, '{pattern}', '{placeholder}', 'g')"
    return msg


ERRORS = LOGS + f""",
errors AS (SELECT *, {signature_sql()} AS signature FROM logs WHERE {is_error_sql()})"""

INDEX = LOGS + """,
idx AS (
  SELECT capture, file, min(ts) AS t_from, max(ts) AS t_to, CAST(count(*) AS BIGINT) AS lines,
    CAST(sum(strlen(msg)) AS BIGINT) AS bytes
  FROM logs GROUP BY capture, file),
pairs AS (SELECT capture, file, 'app' AS key, app AS value FROM logs
          UNION ALL SELECT capture, file, 'env', env FROM logs),
idx_labels AS (
  SELECT capture, file, key, value, CAST(count(*) AS BIGINT) AS count FROM pairs GROUP BY ALL)"""

CAPTURES = LOGS + """,
captures AS (SELECT file AS dir, min(ts) AS started, CAST(sum(strlen(msg)) AS BIGINT) AS bytes FROM logs GROUP BY file)"""

SNAPSHOTS = """
hourly AS (
  SELECT date_trunc('hour', ts) AS ts, count(*) AS received, count(*) FILTER (WHERE event_type = 'error') AS dropped,
    sum(CAST(floor(value) AS BIGINT)) AS used
  FROM events GROUP BY 1),
snapshots AS (
  SELECT ts, CAST(sum(received) OVER w AS BIGINT) AS logs_received, CAST(sum(dropped) OVER w AS BIGINT) AS logs_dropped,
    CAST(sum(used) OVER w AS BIGINT) AS bytes_written, CAST(used AS BIGINT) AS disk_usage, (SELECT CAST(sum(used) // count(*) * 3 // 2 AS BIGINT) FROM hourly) AS disk_cap
  FROM hourly WINDOW w AS (ORDER BY ts))"""

CASCADE = LOGS.replace("logs AS (", "plain AS (", 1) + f""",
logs AS (
  SELECT event_id, ts, 'upstream' AS app, CASE WHEN {is_error_sql()} THEN 'error: timeout calling downstream: ' ELSE '' END || msg AS msg FROM plain
  UNION ALL SELECT event_id, ts + INTERVAL 10 SECOND, 'downstream', 'error processing order: ' || msg FROM plain WHERE {is_error_sql()}
  UNION ALL SELECT event_id, ts + INTERVAL 5 HOUR, 'noise', 'error: unrelated: ' || msg FROM plain WHERE {is_error_sql()})"""

SKEWED = ERRORS + f""",
skewed AS (
  SELECT event_id, ts, app, env, file, 'A' AS capture, msg FROM logs
  UNION ALL
  SELECT event_id, ts + INTERVAL 3 SECOND, app, env, file, 'B', msg FROM logs WHERE {is_error_sql()})"""
