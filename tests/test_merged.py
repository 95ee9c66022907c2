"""Merged captures as manifests of files with offsets."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, write_lines
from emberlog.operators import capture_index as ci
from emberlog.session import scratch_dir
from emberlog.sources import captures as src, merged, sinks
from emberlog.sources.merged import Part


def times(df):
    return sorted((r.ts.isoformat(), r.msg) for r in df.collect())


def test_written_and_flat_captures(spark, make_logs, tmp_path):
    logs = make_logs([(f"10:00:{i:02d}", {"app": "a" if i % 2 else "b"}, f"m{i}", "f", "one" if i < 20 else "two") for i in range(40)])
    root, path = scratch_dir(spark, "parts"), scratch_dir(spark, "merged")
    sinks.write_captures(logs, root, max_entries=5, redaction=["email"])
    flat = tmp_path / "flat"
    flat.mkdir()
    write_lines(flat / "x.jsonl", [{"ts": "2024-01-15T09:00:00Z", "labels": {"env": "prod"}, "msg": "early"}, "no entry", {"msg": "no time"}])
    merged.write_merged(spark, path, [Part(root, "one", timedelta(seconds=-30)), Part(root, "two"), Part(str(flat), None, timedelta(hours=1))])
    back = merged.read_merged(spark, path)
    want = logs.withColumn("ts", F.expr("if(capture = 'one', ts - interval 30 seconds, ts)")).select("ts", "msg").unionByName(
        spark.createDataFrame([(at("10:00:00"), "early")], "ts timestamp, msg string"))
    assert times(back.where("ts is not null")) == times(want)
    assert [r.msg for r in back.where("ts is null").collect()] == ["no time"]
    # The index alone says the same.
    index = src.read_index(spark, path)
    seen = {r.file: r for r in ci.build_index(back.where("ts is not null"), F.col("raw_bytes") + 1, ["file"]).collect()}
    for r in index.where("not file like '%x.jsonl'").collect():
        assert (seen[r.file]["from"], seen[r.file].to, seen[r.file].lines, seen[r.file].labels) == (r["from"], r.to, r.lines, r.labels)
    record = src.read_metadata(spark, path).first()
    assert record.total_lines == 40 and record.redaction.enabled and record.labels_seen == ["app", "env"]
    assert record.started.isoformat().endswith("09:59:30")
    # Files are left out by their moved times.
    few = merged.read_merged(spark, path, to=at("09:59:40"))
    assert 0 < few.count() < 20 and few.where(F.col("ts") <= F.lit(at("09:59:40"))).count() == 11


def test_merged_again_and_with_itself(spark, make_logs):
    logs = make_logs([(f"10:00:{i:02d}", {"app": "a"}, f"m{i}", "f", "one") for i in range(4)])
    root, once, twice = (scratch_dir(spark, n) for n in ("parts", "once", "twice"))
    sinks.write_captures(logs, root)
    merged.write_merged(spark, once, [Part(root, None, timedelta(seconds=10)), Part(root, "one", timedelta(seconds=20))])
    assert merged.read_merged(spark, once).count() == 8
    merged.write_merged(spark, twice, [Part(once, None, timedelta(seconds=100)), Part(root)])
    got = times(merged.read_merged(spark, twice))
    base = [r.ts for r in logs.orderBy("ts").collect()]
    assert got == sorted(((t + timedelta(seconds=s)).isoformat(), f"m{i}") for s in (0, 110, 120) for i, t in enumerate(base))
    index = src.read_index(spark, twice).agg(F.min("from"), F.max("to"), F.sum("lines")).first()
    assert tuple(index) == (base[0], base[3] + timedelta(seconds=120), 12)
    with pytest.raises(ValueError):
        merged.write_merged(spark, twice, [])
