"""Reading and writing captures and exports on disk."""

import gzip
import io
import json
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import at, write_lines
from emberlog.functions.labels import flatten_labels
from emberlog.operators import capture_index as ci, integrity
from emberlog.session import scratch_dir
from emberlog.sources import captures as src, sinks


def entry(clock, msg, **labels):
    return {"ts": f"2024-01-15T{clock}Z", "labels": labels, "msg": msg, "extra": 1}


@pytest.fixture
def root(tmp_path):
    """Two captures in the flat layout: plain and compressed files, an index that misses one file."""
    one, two = tmp_path / "one", tmp_path / "nested" / "two"
    one.mkdir(), two.mkdir(parents=True)
    write_lines(one / "2024-01-15T100000-000.jsonl", [
        entry("10:00:00.123456789", "a", app="api"), "", "not json", {"msg": "no time"}, {"ts": "soon", "msg": "bad time"},
        entry("10:00:02", "b", app="web"), '{"ts":"2024-01-15T10:00:03Z","ms'])
    data = "".join(json.dumps(entry(f"11:00:0{i}", f"z{i}", app="api")) + "\n" for i in range(3))
    (one / "2024-01-15T110000-000.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(data.encode()))
    write_lines(one / "index.jsonl", [
        {"file": "2024-01-15T100000-000.jsonl", "from": "2024-01-15T10:00:00Z", "to": "2024-01-15T10:00:02Z", "lines": 3,
         "bytes": 99, "labels": {"app": {"api": 1, "web": 1}}}, "{broken", ""])
    (one / "metadata.json").write_text(json.dumps({
        "version": 1, "format": "jsonl", "started": "2024-01-15T10:00:00Z", "stopped": "2024-01-15T11:00:02Z", "total_lines": 6,
        "total_bytes": 500, "labels_seen": ["app"], "redaction": {"enabled": True, "patterns": ["email"]}}, indent=1))
    write_lines(one / "audit.jsonl", [{"event": "loki_push_received", "lines": 3}])
    (two / "metadata.json").write_text(json.dumps({"version": 1, "format": "jsonl", "started": "2024-01-16T00:00:00Z"}))
    return tmp_path


def test_scan(spark, root):
    rows = src.read_capture(spark, str(root), line_numbers=True).orderBy("file", "line_no").collect()
    assert [(r.line_no, r.msg) for r in rows] == [(1, "a"), (2, "no time"), (3, "b"), (1, "z0"), (2, "z1"), (3, "z2")]
    assert rows[0].ts.microsecond == 123456 and rows[1].ts is None and {r.capture for r in rows} == {"one"}
    assert rows[0].labels == {"app": "api"}


def test_index_metadata_files(spark, root):
    index = src.read_index(spark, str(root))
    assert [(r.capture, r.file, r.lines, r.labels) for r in index.collect()] == [
        ("one", "2024-01-15T100000-000.jsonl", 3, {"app": {"api": 1, "web": 1}})]
    meta = {r.capture: r for r in src.read_metadata(spark, str(root)).collect()}
    assert meta["one"].redaction.patterns == ["email"] and meta["two"].stopped is None
    orphans = ci.orphan_files(src.list_files(spark, str(root)), index, ["capture", "file"])
    assert [r.file for r in orphans.collect()] == ["2024-01-15T110000-000.jsonl.zst"]
    lines = src.read_lines_of(spark, str(root), orphans)
    assert ci.line_totals(index, lines).first().total_lines == 6


def test_catalog(spark, root):
    rows = src.catalog(spark, str(root)).collect()
    assert [(r.capture, r.files, r.active) for r in rows] == [("two", 0, True), ("one", 2, False)]
    assert rows[1].entries == 6 and rows[1].labels == "app" and rows[1].bytes > 0


def test_pruned_read_opens_fewer_files(spark, root):
    index = src.read_index(spark, str(root))
    rows, files = _read(src.read_capture_pruned(spark, str(root), index, frm=at("10:30:00")))
    assert sorted(r.msg for r in rows) == ["z0", "z1", "z2"] and files == 1
    rows, files = _read(src.read_capture_pruned(spark, str(root), index, labels={"app": "web"}))
    assert len(rows) == 6 and files == 2


def test_only_listed_files_are_opened(spark, root):
    files = src.list_files(spark, str(root)).where("file like '%.zst'")
    rows, opened = _read(src.read_lines_of(spark, str(root), files))
    assert len(rows) == 3 and opened == 1
    assert src.read_lines_of(spark, str(root), files, inverse=True).count() == 6
    assert src.read_lines_of(spark, str(root), files.limit(0)).count() == 0


def _read(df):
    """Rows and the number of files opened for them."""
    rows, found = df.collect(), []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName().startswith("Scan text"):
            found.append(("seg" in node.output().mkString(), node.metrics().apply("numFiles").value()))
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next())
    walk(df._jdf.queryExecution().executedPlan())
    # The scan of written data has a partition column; others beside it read the index.
    return rows, sum(n for seg, n in found if seg or not any(s for s, _ in found))


def test_full_index(spark, root):
    rows = {r.file: r for r in src.full_index(spark, str(root)).collect()}
    orphan = rows["2024-01-15T110000-000.jsonl.zst"]
    assert len(rows) == 2 and orphan.lines == 3 and orphan.labels == {"app": {"api": 3}} and orphan.to.hour == 11
    nothing = src.read_index(spark, str(root)).limit(0)
    rows = {r.file: r for r in src.full_index(spark, str(root), nothing).collect()}
    assert rows["2024-01-15T100000-000.jsonl"].lines == 6  # unreadable lines count too


def test_slice_keeps_lines_as_stored(spark, root):
    one = str(root / "one")
    whole = scratch_dir(spark, "slice")
    sinks.slice_capture(spark, one, whole, labels=[("app", "web")], grep="a|not json")
    lines = [r.value for r in src.read_lines(spark, whole).collect()]
    assert len(lines) == 4 and "not json" in lines and any('"extra": 1' in v for v in lines)
    meta = src.read_metadata(spark, whole).first()
    assert meta.redaction.patterns == ["email"] and meta.total_lines == 4
    cut = scratch_dir(spark, "slice")
    sinks.slice_capture(spark, one, cut, frm=at("10:00:00"), to=at("10:00:02"))
    assert [r.msg for r in src.read_capture(spark, cut).collect()] == ["a"]  # the end is excluded
    with pytest.raises(ValueError):
        sinks.slice_capture(spark, one, scratch_dir(spark, "slice"), labels=[("app", "none")])


def test_catalog_not_recursive(spark, root):
    assert [r.capture for r in src.catalog(spark, str(root), recursive=False).collect()] == ["one"]
    assert [r.capture for r in src.catalog(spark, str(root / "one"), recursive=False).collect()] == ["one"]


def test_new_files(spark, root):
    files = src.list_files(spark, str(root))
    assert [r.file for r in src.new_files(files.where("file like '%100000%'"), files).collect()] == ["2024-01-15T110000-000.jsonl.zst"]


def test_line_numbers_across_splits(spark, tmp_path):
    """A file read in many pieces is numbered like the whole."""
    cap = tmp_path / "big"
    cap.mkdir()
    write_lines(cap / "f.jsonl", [entry("10:00:00", f"m{i}") for i in range(3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = src.read_capture(spark, str(cap), line_numbers=True)
        assert rows.select("block").distinct().count() > 5
        assert rows.where("msg <> concat('m', line_no - 1)").count() == 0 and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_write_and_read(spark, make_logs):
    logs = make_logs([(f"10:{59 - i:02d}:00", {"app": f"s{i % 2}"}, f'm{i} "q" <&>') for i in range(60)])
    path = scratch_dir(spark, "cap") + "/c9"
    sinks.write_capture(logs, path, max_entries=7, redaction=["email"])
    back = src.read_capture(spark, path, line_numbers=True).orderBy("file", "line_no").collect()
    assert [r.msg.split()[0] for r in back] == [f"m{i}" for i in range(59, -1, -1)] and back[0].capture == "c9"
    assert '<&>' in back[0].msg
    meta = src.read_metadata(spark, path).first()
    assert (meta.total_lines, meta.labels_seen, meta.redaction.enabled, meta.started.minute) == (60, ["app"], True, 0)
    index = src.read_index(spark, path)
    assert index.count() >= 9 and index.agg(F.sum("lines"), F.max("lines")).first()[:] == (60, 7)
    assert index.agg(F.sum("bytes")).first()[0] == sum(r.raw_bytes + 1 for r in back)
    root = integrity.root_digest(integrity.manifest(src.read_file_contents(spark, path))).first()
    assert root.files >= 11 and len(root.root_sha256) == 64


def test_write_many(spark, make_logs):
    logs = make_logs([(f"10:{59 - i:02d}:00", {"app": "x"}, f"m{i}", "f", "hot" if i % 3 else "cold") for i in range(60)])
    root = scratch_dir(spark, "caps")
    sinks.write_captures(logs, root, max_entries=9)
    back = src.read_capture(spark, root)
    assert {r.capture: r["count"] for r in back.groupBy("capture").count().collect()} == {"hot": 40, "cold": 20}
    assert {r.capture: r.total_lines for r in src.read_metadata(spark, root).collect()} == {"hot": 40, "cold": 20}
    index = src.read_index(spark, root)
    assert index.agg(F.max("lines")).first()[0] <= 9
    rows = {r.capture: r for r in src.catalog(spark, root).collect()}
    assert rows["hot"].files == index.where("capture = 'hot'").count() and rows["cold"].bytes > 0
    only = src.read_capture(spark, f"{root}/capture=hot")
    assert only.count() == 40 and only.first().capture == "hot"
    # Name order is time order.
    spans = index.where("capture = 'hot'").orderBy("file").collect()
    assert all(a.to < b["from"] for a, b in zip(spans, spans[1:]))


def test_slice_write_needs_lines(spark, make_logs):
    with pytest.raises(ValueError):
        sinks.slice_write(make_logs([("10:00:00", {}, "x")]).limit(0), scratch_dir(spark, "none"))


def test_exports(spark, make_logs):
    logs = make_logs([("10:00:00", {"b": "2", "a": "1"}, 'say "hi", ok'), ("10:00:01", {}, "two"), ("10:00:02", {}, "skip")])
    for fmt in ("parquet", "csv", "jsonl"):
        path = scratch_dir(spark, fmt)
        sinks.export(logs, path, fmt, to=at("10:00:01"))
        if fmt == "parquet":
            back = spark.read.parquet(path)
            assert [r[0] for r in back.select(flatten_labels(F.col("labels"))).orderBy("ts").collect()] == ["a=1;b=2", ""]
            plan = back.where(F.col("ts") >= F.lit(at("10:00:01")))._jdf.queryExecution().executedPlan().toString()
            assert "GreaterThanOrEqual(ts" in plan  # a time filter reaches the exported file
        elif fmt == "csv":
            text = "\n".join(r.value for r in spark.read.text(path).collect())
            assert 'ts,labels,msg' in text and '2024-01-15T10:00:00Z,a=1;b=2,"say ""hi"", ok"' in text
        else:
            assert '"msg":"two"' in "".join(r.value for r in spark.read.text(path).collect())
    with pytest.raises(ValueError):
        sinks.export(logs, "x", "xml")


def test_gzip_and_unknown_codecs(spark, tmp_path):
    cap = tmp_path / "g"
    cap.mkdir()
    buf = io.BytesIO()
    with gzip.GzipFile(fileobj=buf, mode="w") as f:
        f.write((json.dumps(entry("10:00:00", "gz")) + "\n").encode())
    (cap / "x.jsonl.gz").write_bytes(buf.getvalue())
    (cap / "notes.txt").write_text("no data\n")
    assert [r.msg for r in src.read_capture(spark, str(cap)).collect()] == ["gz"]


@pytest.mark.parametrize("name", ["prod east", "2024-01-01T10:30", "100%", "a=b", "p+q"])
def test_names_with_unusual_characters(spark, make_logs, tmp_path, name):
    logs = make_logs([("10:00:00", {"app": "a"}, "one", "f", name), ("10:00:01", {"app": "a"}, "two", "f", name)])
    root = str(tmp_path / "root")
    sinks.write_captures(logs, root, order=("ts", "msg"))
    assert {r.capture for r in src.read_capture(spark, root).collect()} == {name}
    index = src.read_index(spark, root)
    assert [(r.capture, r.lines) for r in index.collect()] == [(name, 2)]
    assert ci.orphan_files(src.list_files(spark, root), index, ["capture", "file"]).count() == 0
    found = src.catalog(spark, root).first()
    assert (found.capture, found.files, found.entries) == (name, 1, 2) and found.bytes > 0
    assert src.read_capture_pruned(spark, root, index, labels={"app": "other"}).count() == 0
    assert src.read_lines_of(spark, root, index.select("capture", "file")).count() == 2


def test_a_missing_table_file_is_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(4).write.parquet(path)
    table = spark.read.parquet(path)
    next((tmp_path / "t").glob("part-*.parquet")).unlink()
    with pytest.raises(Exception, match="(?i)file"):
        table.count()


def test_null_label_values(spark, tmp_path):
    write_lines(tmp_path / "a.jsonl", ['{"ts":"2024-01-15T10:00:00Z","labels":{"a":null},"msg":"x"}',
                                       '{"ts":"2024-01-15T10:00:00Z","labels":{"a":""},"msg":"y"}'])
    row = ci.build_index(src.read_capture(spark, str(tmp_path))).first()
    assert row.labels == {"a": {"": 2}} and row.lines == 2


def test_files_are_bounded_by_bytes_and_the_index_agrees(spark, make_logs):
    rows = [(f"10:{i % 60:02d}:{i // 60:02d}", {"app": f"a{i % 3}"}, f"{i} " + "x" * (1_000_000 if i % 40 == 7 else 300), "f", "hot" if i % 5 else "cold") for i in range(600)]
    rows += [("10:30:30", {"app": "burst"}, f"same time {i % 7}" + "y" * 20_000, "f", "hot") for i in range(300)]  # heavier than a file
    rows += [(None, {"app": "none"}, "no time", "f", "hot")] * 3
    root = scratch_dir(spark, "bounded")
    sinks.write_captures(make_logs(rows), root, max_bytes=3_000_000)
    files = src.list_files(spark, root).collect()
    assert len(files) > 8 and all(f.bytes <= 3_000_000 and f.own_folder for f in files)
    index = {(r.capture, r.file): r for r in src.read_index(spark, root).collect()}
    back = src.read_capture(spark, root)
    seen = ci.build_index(back, F.col("raw_bytes") + 1, ["capture", "file"]).collect()
    assert {(r.capture, r.file): (r["from"], r.to, r.lines, r.bytes, r.labels) for r in seen} == {
        k: (r["from"], r.to, r.lines, r.bytes, r.labels) for k, r in index.items()}
    assert {(f.capture, f.file): f.bytes for f in files} == {k: r.bytes for k, r in index.items()}
    assert back.count() == len(rows)
    spans = sorted((k[1], r["from"], r.to) for k, r in index.items() if k[0] == "hot" and r["from"])
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_files_are_chosen_in_the_plan(spark, make_logs):
    logs = make_logs([(f"10:{i % 60:02d}:{i // 60:02d}", {"app": f"a{i // 100}"}, f"m{i}", "f", f"c{i % 2}") for i in range(600)])
    root = scratch_dir(spark, "pruned")
    sinks.write_captures(logs, root, max_entries=10)
    index = src.read_index(spark, root)
    # Many more rows in the index than there are files.
    many = index.unionByName(spark.range(500_000).select(F.lit("gone").alias("capture"), F.concat(F.lit("g"), "id").alias("file"), *(
        F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields if f.name not in ("capture", "file"))))
    df = src.read_capture_pruned(spark, root, many, frm=at("10:30:00"), to=at("10:34:00"))
    rows, opened = _read(df)
    wanted = {(r.capture, r.file) for r in index.where((F.col("from") <= F.lit(at("10:34:00"))) & (F.col("to") >= F.lit(at("10:30:00")))).collect()}
    assert opened == len(wanted) < index.count() / 2 and {(r.capture, r.file) for r in rows} == wanted
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    rows, opened = _read(src.read_lines_of(spark, root, index.where("capture = 'c1'")))
    assert opened == index.where("capture = 'c1'").count() and len(rows) == 300
    one = f"{root}/capture=c1"
    rows, opened = _read(src.read_lines_of(spark, one, index.where("capture = 'c1'").orderBy("file").limit(2)))
    assert opened == 2 and {r.capture for r in rows} == {"c1"}


def _jobs(spark, make):
    """What ``make`` returns, and the stages' tasks that its planning alone took."""
    group = scratch_dir(spark, "group")
    spark.sparkContext.setJobGroup(group, "")
    try:
        made, tracker = make(), spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return made, sum(tracker.getStageInfo(s).numTasks for s in stages)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("write", [sinks.write_captures, sinks.write_capture])
def test_index_is_found_without_listing_data_folders(spark, make_logs, write):
    logs = make_logs([(f"10:00:{i:02d}", {"app": "api"}, f"m{i}", "f1", "cap") for i in range(35)])
    root = scratch_dir(spark, "captures")
    write(logs, root, max_entries=1)
    index, tasks = _jobs(spark, lambda: src.read_index(spark, root))
    assert tasks == 0 and index.agg({"lines": "sum"}).first()[0] == 35
    meta, tasks = _jobs(spark, lambda: src.read_metadata(spark, root))
    assert tasks == 0 and meta.count() == 1


def test_flat_capture_beside_written_ones(spark, make_logs):
    root = scratch_dir(spark, "captures")
    sinks.write_captures(make_logs([(f"10:00:{i:02d}", {"app": "api"}, f"m{i}", "f1", "cap") for i in range(3)]), root)
    (folder := Path(root, "captured")).mkdir()
    write_lines(folder / "a.jsonl", [{"ts": "2024-01-15T10:00:00Z", "labels": {"app": "api"}, "msg": "flat"}])
    write_lines(folder / "index.jsonl", [{"file": "a.jsonl", "from": "2024-01-15T10:00:00Z", "to": "2024-01-15T10:00:00Z", "lines": 1}])
    write_lines(folder / "metadata.json", [{"version": 1}])
    index = src.read_index(spark, root)
    assert index.agg({"lines": "sum"}).first()[0] == 4 and src.read_metadata(spark, root).count() == 2
    assert src.read_lines_of(spark, root, index.select("capture", "file")).count() == 4


@pytest.mark.parametrize("prefix", ["seg=", "capture=", "data"])
def test_names_beside_data_folders(spark, prefix):
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(src._not_starting(prefix))
    names = ["s", "se", "seg", "seg=1", "sega", "sx", "index", "c", "capture", "capture=", "capture=1", "captured", "data", "data2", "d", "dat", "dot.x"]
    assert [n for n in names if glob.matches(n)] == [n for n in names if not n.startswith(prefix)]
    assert not glob.matches("_SUCCESS") and not glob.matches(".hidden")


def test_plain_paths_need_one_match(spark):
    """What a single match takes for data is data by the whole rule, and what is written or flat goes that way."""
    seg = "seg=s00000001-00000-000000-0a1b2c3d"
    plain = [f"file:/t/capture=a/{seg}/part-0.txt", f"file:/t/cap/data/{seg}/part-0.txt.gz", "file:/t/cap/2024.jsonl", "s3a://b/cap/x.jsonl.zst"]
    others = [f"file:/t/{folder}/{name}" for folder in ("cap", "cap/data", "index", "metadata", "index/capture=a", "metadata/capture=a", "cap/index", seg,
                                                         f"index/{seg}", f"index/capture=a/{seg}", f"{seg}/{seg}", "ca%20p", "cap/seg=index.jsonl", "cap/seg=x.txt")
              for name in ("index.jsonl", "audit.jsonl", "metadata.json", "manifest.sha256", "a.txt", "a.jsonl", "a%2Fb.jsonl", "part-0.json")]
    paths = spark.createDataFrame([(p,) for p in plain + others], "p string")
    path = src._unescaped(F.col("p"))
    rows = paths.select("p", F.col("p").rlike(src._PLAINLY_DATA).alias("plainly"), src._is_data(src._plain(path), src._file(path)).alias("data")).collect()
    assert all(r.data for r in rows if r.plainly) and {r.p for r in rows if r.plainly} >= set(plain)
    assert any(r.data and not r.plainly for r in rows) and any(not r.data for r in rows)
