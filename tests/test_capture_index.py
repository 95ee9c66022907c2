from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at
from emberlog import schema
from emberlog.operators import capture_index as ci, report as rep


def index_of(spark, *rows):
    full = [(f, at(a), at(b), lines, size, labels) for f, a, b, lines, size, labels in rows]
    return spark.createDataFrame(full, schema.INDEX).withColumn("capture", F.lit("c1"))


def test_build_index(make_logs):
    logs = make_logs([("10:00:00", {"app": "api", "pod": "p1"}, "abc"), ("10:02:00", {"app": "api"}, "de"),
                      ("10:01:00", None, "f"), ("10:05:00", {}, "ü", "f2")])
    got = {r.file: r for r in ci.build_index(logs).collect()}
    assert (got["f1"].lines, got["f1"].bytes, got["f1"]["from"].minute, got["f1"].to.minute) == (3, 6, 0, 2)
    assert got["f1"].labels == {"app": {"api": 2}, "pod": {"p1": 1}}
    assert (got["f2"].lines, got["f2"].bytes, got["f2"].labels) == (1, 2, {})


def test_summaries(spark):
    index = index_of(spark, ("a", "10:00:00", "10:10:00", 600, 30000, {"app": {"api": 400, "web": 200}, "env": {"p": 600}}),
                     ("b", "10:10:00", "10:20:00", 400, 20000, {"app": {"api": 100, "db": 300}}))
    meta = ci.build_metadata(index)
    s = ci.capture_summary(index, meta).first()
    assert (s.files, s.total_lines, s.total_bytes, s.lines_per_sec) == (2, 1000, 50000, 1000 / 1200)
    assert meta.first().labels_seen == ["app", "env"]
    assert {(r.label, r.value, r.lines) for r in ci.service_summary(index).collect()} == {
        ("app", "api", 500), ("app", "web", 200), ("app", "db", 300)}
    assert {(r.key, r.value): (r.lines, r.bytes) for r in ci.label_breakdown(index).collect()} == {
        ("app", "api"): (500, 25000), ("app", "web"): (200, 10000), ("app", "db"): (300, 15000), ("env", "p"): (600, 30000)}
    assert {r.key: r["values"] for r in ci.report_labels(index).collect()} == {"app": 3, "env": 1}


def test_summary_without_metadata_times(spark):
    index = index_of(spark, ("a", "10:00:00", "10:00:10", 50, 10, {}))
    meta = ci.build_metadata(index).withColumn("started", F.lit(None).cast("timestamp")).withColumn("stopped", F.lit(None).cast("timestamp"))
    files = spark.createDataFrame([("c1", "a", 7), ("c1", "orphan", 8)], "capture string, file string, bytes bigint")
    s = ci.capture_summary(index, meta, files).first()
    assert (s.files, s.disk_size, s.lines_per_sec) == (2, 15, 5.0)


def spread(rows, width):
    """The spreading rule, file by file."""
    start = min(a for a, _, _ in rows) // width * width
    out = {}
    for a, b, lines in rows:
        first, last = (a // width * width - start) // width, (b // width * width - start) // width
        n = last - first + 1
        for i in range(first, last + 1):
            out[i] = out.get(i, 0) + lines // n + (i - first < lines % n)
    return out


@pytest.mark.parametrize("files, width", [
    ([(0, 240, 300)], 60), ([(0, 240, 7), (100, 3000, 101), (3000, 3000, 5)], 60), ([(30, 5 * 3600, 1000), (7000, 7200, 33)], 300),
    ([(0, 13 * 3600, 77)], 900), ([(0, 4 * 86400, 500), (86400, 2 * 86400, 9)], 3600), ([(5, 9 * 86400, 1234)], 14400)])
def test_timeline(spark, files, width):
    base = at("00:00:00")
    rows = [(f"f{i}", base + timedelta(seconds=a), base + timedelta(seconds=b), n, 0, {}) for i, (a, b, n) in enumerate(files)]
    got = ci.capture_timeline(spark.createDataFrame(rows, schema.INDEX).withColumn("capture", F.lit("c1"))).orderBy("time").collect()
    want = spread([(a, b, n) for a, b, n in files], width)
    assert [r.lines for r in got] == [want.get(i, 0) for i in range(max(want) + 1)]
    assert (got[1].time - got[0].time).total_seconds() == width if len(got) > 1 else True


def test_report(make_logs):
    logs = make_logs([(f"10:00:{i:02d}", {"app": "api"}, "panic: boom" if i == 7 else "ok") for i in range(50)])
    index = ci.build_index(logs, keys=["capture", "file"])
    r = rep.report(logs, index, ci.build_metadata(index)).first()
    assert (r.severity, r.error_rate_pct, r.top_error, r.total_lines, r.duration_seconds) == ("high", 2.0, "panic: boom", 50, 49.0)
    calm = logs.where("msg = 'ok'")
    index = ci.build_index(calm, keys=["capture", "file"])
    assert rep.report(calm, index, ci.build_metadata(index)).first().severity == "low"
    assert '"severity":"low"' in rep.as_json(rep.report(calm, index, ci.build_metadata(index))).first().report


def test_incident_report(make_logs):
    logs = make_logs([(f"10:0{i // 10}:{i % 10:02d}", {"app": f"s{i % 3}"}, "error: x" if i % 10 == 0 else "ok") for i in range(60)]
                     + [("11:00:00", {"pod": "p"}, "error: other", "f1", "c2")])
    index = ci.build_index(logs, keys=["capture", "file"])
    r = rep.incident_report(logs, index, ci.build_metadata(index), "c1").first()
    assert (r.total_lines, r.error_lines, r.severity) == (60, 6, "high")
    assert [(e.signature, e["count"], e.pct_of_errors) for e in r.top_errors] == [("error: x", 6, 100.0)]
    assert [(x.key, x["values"]) for x in r.labels] == [("app", 3)]
    assert {w.window: w.value for w in r.windows}["peak_error"] == 5 and len(r.windows) == 3
    assert '"top_errors":[{"signature":"error: x"' in rep.as_json(rep.incident_report(
        logs, index, ci.build_metadata(index), "c1")).first().report


def test_share(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "v string, lines bigint")
    assert {r.v: r.pct for r in ci.share_of_total(df, "lines").collect()} == {"a": 25.0, "b": 75.0}
