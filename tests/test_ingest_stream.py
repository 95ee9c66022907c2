import json
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import at, write_lines
from emberlog.functions.labels import flatten_labels
from emberlog.functions.redaction import redact
from emberlog.operators import alerts, ingest, triage
from emberlog.params import AlertRule
from emberlog.session import scratch_dir
from emberlog.sources import rules, sinks
from emberlog.streaming import alerting, streams

NOW = at("00:00:00", "2024-02-01")


def payloads(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, payload string")


def test_explode(spark):
    doc = {"streams": [{"stream": {"app": "test"}, "values": [
        ["1234567890000000000", "hello world"], [" 1234567890123456789 ", "mail a@b.io"], ["nope", "late"], ["1"], []]},
        {"stream": {}, "values": [["-1", "old"]]}, {"stream": {"x": "y"}, "values": []}]}
    rows = ingest.explode_loki(payloads(spark, doc, "broken", "{}"), now=NOW, redactor=True).collect()
    assert [(r.msg, r.id) for r in rows] == [("hello world", 0), ("mail [REDACTED:email]", 0), ("late", 0), ("old", 0)]
    assert rows[0].ts.timestamp() == 1234567890 and rows[1].ts.microsecond == 123456 and rows[2].ts.month == 2
    assert rows[0].labels == {"app": "test"}
    micros = ingest.explode_loki(payloads(spark, doc), now=NOW).select(F.unix_micros("ts")).collect()
    assert micros[3][0] == -1
    audit = ingest.ingest_audit(ingest.explode_loki(payloads(spark, doc), now=NOW), "id").first()
    assert (audit.lines, audit.bytes) == (4, len("hello world" + "mail a@b.io" + "late" + "old"))


def test_raw(spark):
    lines = spark.createDataFrame([('{"ts":"2024-01-15T10:00:00Z","labels":{"a":"b"},"msg":"m"}',), ('{"msg":"n"}',), ("{oops",), ("",)],
                                  "value string")
    rows = ingest.explode_raw(lines, now=NOW).collect()
    assert [(r.msg, r.ts.month, r.labels) for r in rows] == [("m", 1, {"a": "b"}), ("n", 2, None)]


def test_k8s(spark):
    texts = ["2024-01-15T10:30:00.123456789Z actual log message", "no time here", "2024-01-15T10:30:00+02:00 x", "single",
             "2024-01-15 plain date", "2024-01-15T10:30:00Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    rows = ingest.parse_k8s_lines(df, "main", now=NOW).orderBy("i").collect()
    assert [r.msg for r in rows] == ["actual log message", "no time here", "x", "single", "2024-01-15 plain date", "2024-01-15T10:30:00Z"]
    assert rows[0].ts.microsecond == 123456 and rows[2].ts.hour == 8 and rows[1].ts.month == 2
    assert rows[0].labels == {"container": "main"}


def test_payload_batches(spark, make_logs):
    rows = [(at("10:00:00") + timedelta(milliseconds=i), {"app": "api"}, f"m{i:03d}") for i in range(250)]
    rows += [(at("10:00:00"), {"app": "web"}, "w"), (at("10:00:01"), {"app": "web"}, "x" * 300)]
    packed = ingest.to_loki_payloads(make_logs(rows), batch=100, max_bytes=300)
    got = {(r.label_set, r.flush, r.part, r.piece): (r.lines, r.bytes, r.accepted) for r in packed.collect()}
    assert sum(n for n, _, _ in got.values()) == 252 and all((size <= 300) == ok for _, size, ok in got.values())
    assert [n for n, _, ok in got.values() if not ok] == [1]  # one entry is larger than any payload may be
    whole = ingest.to_loki_payloads(make_logs(rows), batch=100)
    assert sorted(r.lines for r in whole.collect()) == [1, 1, 50, 100, 100] and whole.where("not accepted").count() == 0
    back = ingest.explode_loki(packed.select("payload"), now=NOW)
    assert sorted((r.ts, r.labels["app"], r.msg) for r in back.collect()) == sorted((t, lab["app"], m) for t, lab, m in [
        (t.replace(tzinfo=None), lab, m) for t, lab, m in rows])


def test_label_sets_that_print_alike_stay_apart(make_logs):
    logs = make_logs([("10:00:00", {"a": "1;b=2"}, "x"), ("10:00:00", {"a": "1", "b": "2"}, "y"), ("10:00:00", {"a": None}, "z")])
    packed = ingest.to_loki_payloads(logs)
    assert packed.count() == 3
    back = {r.msg: r.labels for r in ingest.explode_loki(packed.select("payload"), now=NOW).collect()}
    assert back["x"] == {"a": "1;b=2"} and back["y"] == {"a": "1", "b": "2"}


def test_batch_size_estimate(spark):
    df = spark.createDataFrame([({"app": "api"}, ["abc", "d"])], "labels map<string,string>, lines array<string>")
    assert df.select(ingest.batch_size_estimate(F.col("labels"), F.col("lines"))).first()[0] == 6 + 3 + 1 + 48


def test_talkers(make_logs):
    logs = make_logs([("10:00:00", {"app": "a"}, "")] * 3 + [("10:00:00", {"pod": "p"}, ""), ("10:00:00", {}, "")])
    assert {r.name: r["count"] for r in ingest.ingest_talkers(logs).collect()} == {"a": 3, "p": 1}


# ---- streams give what the batch gives ------------------------------------------------------

def run_updates(spark, df, keys):
    out = scratch_dir(spark, "updates")
    streams.keep_updates(df, out, scratch_dir(spark, "cp")).awaitTermination()
    return streams.latest(spark, out, keys)


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def landed(spark, logs, files=4):
    path = scratch_dir(spark, "landed")
    logs.select("ts", "labels", "msg").repartition(files).write.parquet(path)
    return streams.entry_stream(spark, path, max_files=1)


def test_streamed_triage_equals_batch(spark, make_logs):
    logs = make_logs([(at("10:00:00") + timedelta(seconds=7 * i), {"app": f"s{i % 3}"}, f"error {i}000" if i % 4 == 0 else "fine") for i in range(80)])
    same(run_updates(spark, streams.minute_counts(landed(spark, logs), None), ["minute"]), triage.minute_counts(logs))
    same(run_updates(spark, streams.signatures(landed(spark, logs)), ["signature"]), triage.signature_starts(logs))
    same(run_updates(spark, streams.talkers(landed(spark, logs)), ["key", "value"]), triage.talkers(logs))
    counters = run_updates(spark, streams.counters(landed(spark, logs)), ["name"])
    same(counters.select("name", F.col("received").alias("count")), ingest.ingest_talkers(logs))


def test_update_log_is_folded(spark, make_logs):
    # Talkers 0 to 3 come up again and again, those from 100 on once each: old rows must outlive the folds.
    logs = make_logs([("10:00:00", {"app": f"s{i % 4 if i % 2 else 100 + i}"}, "m" * i) for i in range(44)])
    path, out = scratch_dir(spark, "landed"), scratch_dir(spark, "updates")
    logs.select("ts", "labels", "msg").repartition(11).write.parquet(path)
    running = streams.counters(streams.entry_stream(spark, path, max_files=1))
    folded = streams.keep_updates(running, out, scratch_dir(spark, "cp"), ["name"], every=2)
    folded.awaitTermination()
    assert folded.lastProgress["batchId"] >= 10
    same(streams.latest(spark, out, ["name"]).select("name", F.col("received").alias("count")), ingest.ingest_talkers(logs))
    folders = {p.name for p in (*Path(out).iterdir(), *(Path(out) / "updates").iterdir())}
    assert {"base-0", "base-1", "updates"} < folders and len(folders) <= 3 + 2 * 2


def test_watermark_closes_windows(spark, make_logs):
    logs = make_logs([(at("10:00:00") + timedelta(minutes=i), {}, "m") for i in range(40)])
    path = scratch_dir(spark, "ordered")
    for i in range(0, 40, 10):  # one file after another
        part = logs.where((F.col("line_no") > i) & (F.col("line_no") <= i + 10))
        part.select("ts", "labels", "msg").coalesce(1).write.mode("append").parquet(path)
    out = scratch_dir(spark, "closed")
    stream = streams.minute_counts(streams.entry_stream(spark, path, 1))
    (stream.writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", scratch_dir(spark, "cp")).trigger(availableNow=True).start().awaitTermination())
    closed = spark.read.parquet(out)
    assert 20 <= closed.count() < 40 and closed.agg(F.max("total_lines")).first()[0] == 1


def test_late_entries_are_kept_apart_and_state_shrinks(spark, make_logs):
    path, out, cp, closed = (scratch_dir(spark, n) for n in ("ordered", "parted", "cp", "closed"))
    hours = [[(at("10:00:00") + timedelta(minutes=60 * h + i), {"h": str(h)}, f"{h}:{i}") for i in range(60)] for h in range(3)]
    late = [(at("10:30:00"), {}, "late"), (None, {}, "no time"), (at("12:50:00"), {}, "just in time"), (at("12:48:59"), {}, "just late")]
    for rows in (*hours, late):  # one file after another
        make_logs(rows).select("ts", "labels", "msg").coalesce(1).write.mode("append").parquet(path)
    streams.split_late(streams.entry_stream(spark, path, 1), out, cp).awaitTermination()
    assert sorted(r.msg for r in spark.read.parquet(f"{out}/late").collect()) == ["just late", "late", "no time"]
    assert spark.read.parquet(f"{out}/timely").count() == 181
    windows = streams.minute_counts(streams.entry_stream(spark, f"{out}/timely", 1))
    done = streams.keep_closed(windows, closed, scratch_dir(spark, "cp"))
    done.awaitTermination()
    state = [p["stateOperators"][0] for p in done.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in state) >= 60 and state[-1]["numRowsTotal"] == 11  # 12:49 to 12:59 are open
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 0
    got = spark.read.parquet(closed)
    assert got.count() == 169 and got.agg(F.sum("total_lines")).first()[0] == 169


def test_ingest_redacts_before_the_sink_and_resumes(spark, tmp_path):
    out, cp = scratch_dir(spark, "out"), scratch_dir(spark, "cp")

    def land(name, text):
        write_lines(tmp_path / name, [{"streams": [{"stream": {"app": "a"}, "values": [["1700000000000000000", text]]}]}])

    def run():
        streams.ingest(streams.payload_stream(spark, str(tmp_path)), out, cp).awaitTermination()
        return sorted(r.msg for r in spark.read.parquet(out).collect())
    land("p1.json", "mail x@y.io")
    assert run() == ["mail [REDACTED:email]"]
    land("p2.json", "ip 10.1.2.3")
    assert run() == ["ip [REDACTED:ip]", "mail [REDACTED:email]"]


def test_follow(spark, tmp_path):
    write_lines(tmp_path / "a.jsonl", [{"ts": "2024-01-15T10:00:00Z", "labels": {"app": "x"}, "msg": "hit"}, "bad",
                                       {"ts": "2024-01-15T10:00:00Z", "labels": {"app": "y"}, "msg": "hit"}])
    out = scratch_dir(spark, "followed")
    (streams.follow(spark, str(tmp_path), "hit", ("app", "x")).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_dir(spark, "cp")).trigger(availableNow=True).start().awaitTermination())
    assert [flat[0] for flat in spark.read.parquet(out).select(flatten_labels(F.col("labels"))).collect()] == ["app=x"]


def test_follow_reads_the_data_files_of_a_capture_only(spark, make_logs, tmp_path):
    logs = make_logs([("10:00:00", {"app": "x"}, f"m{i}", "f", "c") for i in range(9)])
    root = tmp_path / "captures"
    sinks.write_captures(logs, str(root), max_entries=4, compression="gzip", order=("ts", "msg"))
    write_lines(root / "audit.jsonl", [{"timestamp": "2024-01-15T10:00:00Z", "event": "loki_push_received", "lines": 9}])
    write_lines(root / "index.jsonl", [{"file": "f", "lines": 9}])
    out = scratch_dir(spark, "followed")
    (streams.follow(spark, str(root)).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_dir(spark, "cp")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.msg for r in spark.read.parquet(out).collect()) == [f"m{i}" for i in range(9)]


TICKS = "ts timestamp, logs_received bigint, logs_dropped bigint, bytes_written bigint, disk_usage bigint, disk_cap bigint"


def run_alerts(spark, path, schema, known, max_files=1):
    out = scratch_dir(spark, "alerts")
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    alerting.keep_alerts(ticks, known, out, scratch_dir(spark, "cp")).awaitTermination()
    return out


def test_alert_stream_keeps_state_between_triggers(spark):
    drops = [0, 200, 300, 50, 60, 250, 260, 500]
    rows = [(at("10:00:00") + timedelta(seconds=i), 10 * i, d, 0, d, 400) for i, d in enumerate(drops)]
    df = spark.createDataFrame(rows, TICKS)
    path = scratch_dir(spark, "ticks")
    for i in range(0, len(rows), 3):  # one file after another
        df.where(F.col("ts").between(rows[i][0], rows[min(i + 2, 7)][0])).coalesce(1).write.mode("append").parquet(path)
    known = [AlertRule("drops", "logs_dropped", "gt", 100, "d"), AlertRule("rate", "drop_rate", "gte", 100, "r"),
             AlertRule("disk", "disk_pct", "gt", 60, "full")]
    out = run_alerts(spark, path, df.schema, known)
    same(alerting.alerts(spark, out), alerts.alert_edges(df, known))
    assert alerting.late_ticks(spark, out).count() == 0
    # A tick that comes late, one that comes again and one without a time are kept apart.
    late = [(rows[2][0], 0, 9999, 0, 0, 1), rows[7], (None, 0, 9999, 0, 0, 1)]
    spark.createDataFrame(late, TICKS).coalesce(1).write.mode("append").parquet(path)
    out = run_alerts(spark, path, df.schema, known)
    same(alerting.alerts(spark, out), alerts.alert_edges(df, known))
    assert alerting.late_ticks(spark, out).count() == 3


def test_a_trigger_may_hold_a_million_ticks_of_a_rule(spark, tmp_path):
    seconds = F.col("id")
    ticks = spark.range(1_000_000).select(
        F.timestamp_seconds(seconds + 1700000000).alias("ts"), seconds.alias("logs_received"), (F.floor(seconds / 7) * (seconds % 3)).alias("logs_dropped"),
        F.lit(0).cast("bigint").alias("bytes_written"), (F.floor(seconds / 1000) % 100).alias("disk_usage"), F.lit(100).cast("bigint").alias("disk_cap"))
    path = scratch_dir(spark, "ticks")
    ticks.write.parquet(path)
    write_lines(tmp_path / "rules.json", [{"name": "disk", "metric": "disk_pct", "op": "gte", "threshold": 90},
                                          {"name": "rise", "metric": "drop_rate", "op": "gt", "threshold": 200000, "detail": "r"}])
    found = alerting.alerts(spark, run_alerts(spark, path, ticks.schema, str(tmp_path / "rules.json"), 1000))
    assert found.where("rule = 'disk'").count() == 10
    same(found, alerts.alert_edges(ticks, [AlertRule("disk", "disk_pct", "gte", 90), AlertRule("rise", "drop_rate", "gt", 200000, "r")]))


def test_rules_from_a_file(spark, tmp_path):
    good = {"name": "full", "metric": "disk_pct", "op": "gt", "threshold": 90}
    path = str(tmp_path / "rules.json")
    for bad, why in (({"metric": "cpu"}, "unknown metric: 'cpu'"), ({"metric": None}, "unknown metric"), ({"op": "eq"}, "unknown op: 'eq'"),
                     ({"name": ""}, "no name"), ({"name": None}, "no name"), ({"threshold": None}, "no threshold"), ({"threshold": "high"}, "not a rule")):
        write_lines(path, [good, good | {"name": "b"} | bad])
        with pytest.raises(ValueError, match=why):
            rules.read_alert_rules(spark, path)
    for lines, why in (([good, good], "name used twice"), ([good, "rules:"], "not a rule"), (["[1]"], "not a rule")):
        write_lines(path, lines)
        with pytest.raises(ValueError, match=why):
            rules.read_alert_rules(spark, path)
    write_lines(path, [good, ""])
    assert [tuple(r) for r in rules.read_alert_rules(spark, path).collect()] == [("full", "disk_pct", "gt", 90.0, "")]
    write_lines(path, [])
    assert rules.read_alert_rules(spark, path).collect() == []


def test_patterns_from_a_file(spark, tmp_path, text_column):
    path = str(tmp_path / "patterns.json")
    one = {"name": "ticket", "regex": r"\bT-(\d+)", "replacement": "ticket $1"}
    write_lines(path, [one, {"name": "a", "regex": "ticket", "replacement": "[x]"}])
    assert text_column(lambda c: redact(c, ["ip_v4"], rules.read_patterns(spark, path)), ["T-12 at 10.1.2.3", None]) == ["[x] 12 at [REDACTED:ip]", None]
    for bad, why in (({"regex": "("}, "'ticket' cannot be used"), ({"regex": ""}, "no pattern"), ({"name": "email"}, "builtin"), ({"name": None}, "no name")):
        write_lines(path, [one | bad])
        with pytest.raises(ValueError, match=why):
            rules.read_patterns(spark, path)


def test_a_trigger_of_few_files_keeps_all_cores_busy(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores + 1)
    assert streams._spread(few).rdd.getNumPartitions() == cores and streams._spread(few).count() == 100
    assert streams._spread(many).rdd.getNumPartitions() == cores + 1
