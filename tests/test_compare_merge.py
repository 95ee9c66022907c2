from datetime import timedelta

import pytest

from conftest import at
from emberlog.operators import capture_index as ci, compare, merge as merging


def rows(capture, n, errors, texts, start="10:00:00", shift=0.0):
    base = at(start) + timedelta(seconds=shift)
    return [(base + timedelta(seconds=i), {"app": "api"}, texts[i % len(texts)] if i < errors else "ok", "f1", capture)
            for i in range(n)]


def test_baseline_regression(make_logs):
    logs = make_logs(rows("base", 20, 1, ["error: old"]) + rows("cur", 20, 10, ["error: old", "FATAL: new"]))
    r = compare.baseline_diff(logs, "base", "cur").first()
    assert (r.verdict, r.gate_failed, r.new_patterns, r.error_rate_change) == ("regression", True, 2, "+900%")
    delta = {d.pattern: (d["count"], d.baseline_count) for d in compare.baseline_error_delta(logs, "base", "cur").collect()}
    assert delta == {"FATAL: new": (5, 0), "error: old": (5, 1)}


def test_stable(make_logs):
    logs = make_logs(rows("a", 20, 2, ["error x"]) + rows("b", 20, 2, ["error x"]))
    r = compare.baseline_diff(logs, "a", "b").first()
    assert (r.verdict, r.confidence, r.gate_failed) == ("stable", 0.95, False)


def test_errors_only_compares_complete_sets(make_logs):
    both = [f"error in {chr(97 + i)}" for i in range(25)]
    logs = make_logs(rows("a", 29, 28, [*both, "error p", "error p", "error q"]) + rows("b", 26, 26, [*both, "error r"]))
    got = {(r.side, r.pattern, r["count"]) for r in compare.errors_only(logs, "a", "b").collect()}
    assert got == {("a", "error p", 2), ("a", "error q", 1), ("b", "error r", 1)}
    assert {r.pattern for r in compare.errors_only(logs, "a", "b", top=1).collect()} == {"error p", "error r"}


def test_rates_and_labels(make_logs):
    logs = make_logs([("10:00:01", {"app": "x"}, "m", "f", "a"), ("10:00:02", {"app": "x"}, "m", "f", "a"),
                      ("10:00:03", {"pod": "x"}, "m", "f", "b"), ("10:05:00", {"pod": "y"}, "m", "f", "b")])
    assert [(r.rate_a, r.rate_b) for r in compare.rate_compare(logs, "a", "b").orderBy("minute").collect()] == [(2, 1), (0, 1)]
    index = ci.build_index(logs, keys=["capture", "file"])
    assert {(r.side, r.key) for r in compare.labels_only(index, "a", "b").collect()} == {("a", "app"), ("b", "pod")}
    summary = {r.capture: r for r in compare.diff_summary(logs, ci.build_metadata(index)).collect()}
    assert summary["b"].lines == 2 and summary["b"].labels == "pod" and summary["a"].error_lines == 0


def skew(make_logs, offset, texts_a=("error one", "error two"), texts_b=("error one", "error two")):
    logs = make_logs(rows("a", 6, 2, list(texts_a)) + rows("b", 4, 2, list(texts_b), shift=offset))
    return logs, [tuple(r) for r in merging.detect_skew(logs).collect()]


def test_skew(make_logs):
    logs, found = skew(make_logs, 3)
    assert found == [("b", -3000, 0.5, "error_signature", True)]
    fixed = merging.merge_corrected(logs).where("capture = 'b'").orderBy("line_no").first()
    assert fixed.ts.second == 0
    assert skew(make_logs, 0)[1] == [("b", 0, 0.5, "error_signature", True)]
    assert skew(make_logs, 61)[1] == [("b", -61000, 0.5, "error_signature", False)]
    assert skew(make_logs, 5, texts_b=("error three", "error four"))[1] == [("b", -5000, 0.3, "metadata_overlap", True)]


def test_skew_median_of_many(make_logs):
    a = [(at("10:00:00") + timedelta(seconds=i), {}, f"error kind {chr(97 + i)}", "f", "a") for i in range(6)]
    b = [(at("10:00:00") + timedelta(seconds=i + i), {}, f"error kind {chr(97 + i)}", "f", "b") for i in range(5)]
    assert [tuple(r) for r in merging.detect_skew(make_logs(a + b)).collect()] == [("b", -2000, 1.0, "error_signature", True)]


def test_merge(make_logs):
    logs = make_logs(rows("a", 5, 0, [""]) + rows("b", 5, 0, [""], shift=2))
    both = merging.merge(logs.where("capture = 'a'"), logs.where("capture = 'b'"))
    assert both.count() == 10 and both.select("capture", "file").distinct().count() == 2
    index = ci.build_index(logs, keys=["capture", "file"])
    m = merging.merge_metadata(ci.build_metadata(index), index).first()
    assert (m.total_lines, m.started.second, m.stopped.second, m.labels_seen, m.redacted) == (10, 0, 6, ["app"], False)


@pytest.mark.parametrize("count, confidence", [(1, 0.5), (4, 0.8)])
def test_skew_confidence(make_logs, count, confidence):
    texts = [f"error kind {chr(97 + i)}" for i in range(count)]
    logs = make_logs(rows("a", 6, count, texts) + rows("b", 5, count, texts, shift=1))
    assert merging.detect_skew(logs).first().confidence == confidence


def test_label_difference_counts_before_the_shuffle(spark, tmp_path):
    """Two keys and any number of entries: what is shuffled are rows by key and task, not by entry."""
    from emberlog.plans import all_queries
    from pyspark.sql import functions as F
    n = 5000
    (spark.range(0, n, 1, 2).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(0, 0, 0, id * 30)").alias("ts"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
     .write.parquet(f"{tmp_path}/events.parquet"))
    found = all_queries()["label_difference"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("env",)]

    shuffled, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if node.nodeName() in ("Exchange", "BroadcastExchange"):
                rows = "shuffleRecordsWritten" if node.nodeName() == "Exchange" else "numOutputRows"
                shuffled.append(node.metrics().apply(rows).value())
            children = node.children()
            todo.extend(children.apply(i) for i in range(children.size()))
    assert shuffled and max(shuffled) <= 100
