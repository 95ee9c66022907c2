"""Retention, integrity, faults, alerts."""

import hashlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at
from emberlog.operators import alerts, inject as faults, integrity, retention
from emberlog.params import AlertRule, Fault

NOW = at("00:00:00", "2024-02-01")


def captures(spark, *ages_and_sizes):
    return spark.createDataFrame([(f"cap{i}", NOW - timedelta(days=d), s) for i, (d, s) in enumerate(ages_and_sizes)],
                                 "dir string, started timestamp, bytes bigint")


def plan(df):
    return {(r.dir, r.reason) for r in df.collect()}


def test_retention(spark):
    c = captures(spark, (10, 5), (8, 5), (2, 5))
    assert plan(retention.retention_plan(c, NOW, timedelta(days=7))) == {("cap0", "max-age"), ("cap1", "max-age")}
    assert plan(retention.retention_plan(c, NOW, timedelta(days=10))) == set()  # strictly older
    assert plan(retention.retention_plan(c, NOW, None, 10)) == {("cap0", "max-total")}
    assert plan(retention.retention_plan(c, NOW, timedelta(days=9), 7)) == {("cap0", "max-age"), ("cap1", "max-total")}
    assert plan(retention.retention_plan(c, NOW, None, 100)) == set()
    same = captures(spark, (3, 4), (3, 4), (3, 4))
    assert plan(retention.retention_plan(same, NOW, None, 4)) == {("cap0", "max-total"), ("cap1", "max-total")}
    with pytest.raises(ValueError):
        retention.retention_plan(c, NOW)


def test_disk_cap(spark):
    files = spark.createDataFrame([("2024-01-02T0-000.jsonl", 10), ("2024-01-01T0-001.jsonl", 10), ("2024-01-01T0-000.jsonl", 10)],
                                  "file string, bytes bigint")
    assert [r.file for r in retention.disk_cap_plan(files, 20).collect()] == ["2024-01-01T0-000.jsonl"]
    assert retention.disk_cap_plan(files, 20, overhead=1).count() == 2
    assert retention.disk_cap_plan(files, 30).count() == 0
    assert retention.disk_usage(files, 37).first().warning and not retention.disk_usage(files, 38).first().warning


def files_of(spark, **contents):
    return spark.createDataFrame([("c1", k, v) for k, v in contents.items()], "capture string, file string, content string")


def test_manifest(spark):
    before = files_of(spark, a="one", b="two", c="three")
    digests = integrity.manifest(before)
    assert {r.file: (r.sha256, r.bytes) for r in digests.collect()}["a"] == (hashlib.sha256(b"one").hexdigest(), 3)
    lines = integrity.manifest_lines(digests)
    text = "".join(sorted((r.value + "\n" for r in lines.collect()), key=lambda s: s[66:]))
    root = integrity.root_digest(digests).first()
    assert (root.root_sha256, root.files) == (hashlib.sha256(text.encode()).hexdigest(), 3)
    after = integrity.manifest(files_of(spark, a="one", b="TWO", d="four"))
    signed = integrity.read_manifest_lines(lines.union(spark.createDataFrame([("garbage",)], "value string")))
    assert {(r.file, r.status) for r in integrity.verify(signed, after).collect()} == {
        ("b", "mismatch"), ("c", "missing"), ("d", "extra")}
    assert integrity.verify(signed, digests).count() == 0


AT, HOUR = at("10:00:00"), timedelta(hours=1)


def injected(make_logs, faults_, app="api", clock="10:30:00"):
    logs = make_logs([(clock, {"app": app}, "GET /users")])
    return [(r.msg, r.labels.get("_injected")) for r in faults.inject(logs, faults_).orderBy("copy").collect()]


def test_faults(make_logs):
    spike, slow, down = Fault("error-spike", None, AT, HOUR), Fault("latency-spike", "api", AT, HOUR), Fault("service-down", "api", AT, HOUR)
    assert injected(make_logs, [spike]) == [("GET /users", None), ("error: connection timeout", "true"),
                                            ("error: 503 service unavailable", "true"), ("panic: runtime error", "true")]
    assert injected(make_logs, [down]) == [] and injected(make_logs, [down], "web") == [("GET /users", None)]
    assert injected(make_logs, [slow]) == [("GET /users [SLOW: 5.2s]", "true")]
    assert injected(make_logs, [slow, slow]) == [("GET /users [SLOW: 5.2s] [SLOW: 5.2s]", "true")]
    assert injected(make_logs, [spike, slow], clock="11:00:00") == [("GET /users", None)]  # end excluded
    assert len(injected(make_logs, [spike, slow], clock="10:00:00")) == 4
    assert all("[SLOW" in m for m, _ in injected(make_logs, [spike, slow]))
    assert injected(make_logs, [spike, down]) == []  # synthetic entries of the service go too
    assert len(injected(make_logs, [down, spike])) == 3


def test_inject_stats(make_logs):
    logs = make_logs([("10:30:00", {"app": "api"}, "a"), ("12:00:00", {"app": "api"}, "b"), ("10:30:00", None, "c")])
    assert tuple(faults.inject_stats(logs, [Fault("error-spike", None, AT, HOUR)]).first()) == (3, 6, 9, 1)
    assert tuple(faults.inject_stats(logs, [Fault("service-down", "api", AT, HOUR)]).first()) == (3, -1, 2, 1)


def ticks(spark, dropped, usage=None, cap=100):
    rows = [(at("10:00:00") + timedelta(seconds=i), 10 * i, d, 100 * i, (usage or dropped)[i], cap) for i, d in enumerate(dropped)]
    return spark.createDataFrame(rows, "ts timestamp, logs_received bigint, logs_dropped bigint, bytes_written bigint, "
                                       "disk_usage bigint, disk_cap bigint")


def fired(df):
    return [(r.rule, r.ts.second) for r in df.orderBy("rule", "ts").collect()]


def test_alerts(spark):
    over = AlertRule("r", "logs_dropped", "gt", 100)
    assert fired(alerts.alert_edges(ticks(spark, [200, 300, 400]), [over])) == [("r", 0)]
    assert fired(alerts.alert_edges(ticks(spark, [200, 300, 50, 200]), [over])) == [("r", 0), ("r", 3)]
    rate = AlertRule("d", "drop_rate", "gte", 10)
    assert fired(alerts.alert_edges(ticks(spark, [500, 505, 520, 540, 10, 30]), [rate, over])) == [("d", 2), ("d", 5), ("r", 0)]
    disk = AlertRule("disk", "disk_pct", "lte", 50)
    assert fired(alerts.alert_edges(ticks(spark, [0, 0, 0], [60, 50, 40]), [disk])) == [("disk", 1)]
    assert fired(alerts.alert_edges(ticks(spark, [0], [60], cap=0), [disk])) == [("disk", 0)]
    edges = alerts.disk_warning_edges(ticks(spark, [0] * 5, [80, 81, 90, 70, 99]))
    assert [r.ts.second for r in edges.orderBy("ts").collect()] == [1, 4]


def test_rates(spark):
    rows = alerts.rate_delta(ticks(spark, [0, 0, 0])).orderBy("ts").collect()
    assert [r.logs_per_sec for r in rows] == [None, 10.0, 10.0] and rows[1].bytes_per_sec == 100.0
    counts = spark.createDataFrame([("a", at("10:00:00"), 5), ("a", at("10:00:02"), 9), ("b", at("10:00:02"), 1)],
                                   "name string, ts timestamp, count bigint")
    assert {(r.name, r["count"]): r.per_sec for r in alerts.talker_rates(counts).collect()} == {("a", 5): None, ("a", 9): 2.0, ("b", 1): None}
    assert counts.where(F.lit(False)).count() == 0
