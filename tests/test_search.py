import pytest
from pyspark.sql import functions as F

from conftest import at
from emberlog.operators import filters, grep as search
from emberlog.operators.capture_index import build_index


def msgs(df):
    return [r.msg for r in df.orderBy("capture", "file", "line_no").collect()]


@pytest.fixture
def logs(make_logs):
    return make_logs([
        ("10:00:00", {"app": "api", "env": "prod"}, "start", "f1"),
        ("10:01:00", {"app": "api"}, "error: one", "f1"),
        ("10:02:00", {"app": "web", "env": "dev"}, "two", "f2"),
        ("10:03:00", None, "three", "f2"),
    ])


def test_match(logs):
    assert msgs(filters.filter_logs(logs, frm=at("10:01:00"), to=at("10:02:00"))) == ["error: one", "two"]
    assert msgs(filters.filter_logs(logs, labels={"app": "api", "env": ""})) == ["error: one"]
    assert msgs(filters.filter_logs(logs, grep="^prod$|three")) == ["start", "three"]
    assert msgs(filters.filter_logs(logs)) == ["start", "error: one", "two", "three"]
    assert msgs(filters.filter_label_present(logs, "env", "")) == []


def test_filter_stack(logs):
    assert msgs(filters.filter_stack(logs, [("keep", "t"), ("hide", "error")])) == ["start", "two", "three"]
    assert msgs(filters.filter_stack(logs, [("hide", "^dev$")], label=("app", "web"))) == []


def test_time_jump(logs):
    assert filters.time_jump(logs, " 10:02 ").first().msg == "two"
    assert filters.time_jump(logs, "2024-01-15T10:0").first().msg == "start"
    assert filters.time_jump(logs, "").count() == 0


def test_prune_and_slice(logs):
    index = build_index(logs)
    names = lambda **kw: sorted(r.file for r in filters.prune_files(index, **kw).collect())
    assert names(frm=at("10:01:30")) == ["f2"]
    assert names(to=at("10:01:30")) == ["f1"]
    assert names(labels={"app": "web"}) == ["f2"]
    assert names(labels={"zone": "x"}) == ["f1", "f2"]  # unknown keys never prune
    # Labels select files, not lines; either label will do; the end is excluded.
    cut = filters.slice_logs(logs, index, at("10:00:00"), at("10:01:00"), [("app", "api"), ("app", "none")])
    assert msgs(cut) == ["start"]
    assert msgs(filters.slice_logs(logs, index, labels=[("zone", "x")])) == []


def test_slice_bad_lines(logs):
    index, raw = build_index(logs), F.concat(F.lit("{"), "msg")
    bad = F.col("msg") == "two"
    assert msgs(filters.slice_logs(logs, index, grep=r"^\{t", raw=raw, bad=bad)) == ["two", "three"]
    assert msgs(filters.slice_logs(logs, index, at("10:00:00"), grep=r"^\{t", raw=raw, bad=bad)) == ["three"]


def test_tail(logs):
    assert [r.msg for r in filters.tail_n(logs, 1).collect()] == ["three"]
    assert [r.msg for r in filters.tail_n(logs, 5).collect()] == ["two", "three"]
    assert [r.msg for r in filters.tail_n(logs, 1, grep="two").collect()] == []
    assert [r.msg for r in filters.tail_n(logs, 2, label=("app", "web")).collect()] == ["two"]


def test_replay(logs):
    got = [r.offset_seconds for r in filters.replay_offset(logs, 2.0).orderBy("ts").collect()]
    assert got == [0.0, 30.0, 60.0, 90.0]
    assert filters.replay_offset(logs, 0).agg(F.max("offset_seconds")).first()[0] == 0.0


def test_grep_sort_and_count(make_logs):
    logs = make_logs([("10:02:00", {}, "x1", "a"), ("10:00:00", {}, "x2", "b"), ("10:01:00", {}, "y", "b")])
    assert [r.msg for r in search.grep(logs, "x", sort=True).collect()] == ["x2", "x1"]
    assert {r.file: r["count"] for r in search.grep_count(logs, "y").collect()} == {"b": 1}


def brute_context(matches, n, c):
    """Line number -> (group, mark), by walking over the merged ranges."""
    out, group, prev = {}, 0, None
    for i in range(1, n + 1):
        if any(abs(i - m) <= c for m in matches):
            group += prev != i - 1
            prev = i
            out[i] = (group, "" if i in matches else "before" if any(m > i for m in matches) else "after")
    return out


@pytest.mark.parametrize("n, matches, c", [(7, {3}, 2), (8, {2, 4}, 1), (8, {1, 8}, 1), (8, {1, 4}, 1), (5, {1}, 3),
                                           (30, {1, 2, 9, 15, 16, 30}, 2), (4, set(), 2)])
def test_context(make_logs, monkeypatch, n, matches, c):
    monkeypatch.setattr(search, "SLICE_LINES", 3)  # several slices in a file
    rows = [(f"10:00:{i:02d}", {}, "HIT" if i in matches else "no", f) for f in ("f1", "f2") for i in range(1, n + 1)]
    got = search.grep_context(make_logs(rows), "HIT", c).collect()
    for f in ("f1", "f2"):
        assert {r.line_no: (r.group, r.context) for r in got if r.file == f} == brute_context(matches, n, c)
