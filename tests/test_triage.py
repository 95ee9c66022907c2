import random
from datetime import timedelta

import pytest

from conftest import at
from emberlog.operators import triage


@pytest.fixture
def incident(make_logs):
    api, worker, gw = {"app": "api"}, {"app": "worker"}, {"app": "gateway"}
    return make_logs([
        ("10:00:00", api, "GET /users 200"), ("10:01:00", worker, "job done"),
        ("10:02:00", api, "connection refused to payments:8080"), ("10:02:30", api, "connection refused to payments:8080"),
        ("10:03:00", api, "connection refused to payments:8080"), ("10:04:00", api, "error: timeout after 230ms"),
        ("10:05:00", worker, "job done"), ("10:06:00", gw, "panic: nil pointer"), ("10:07:00", api, "error: timeout after 31ms"),
        ("10:08:00", gw, "ok")])


def test_incident(incident):
    assert tuple(triage.totals(incident).first()) == (10, 6)
    timeline = triage.error_timeline(incident)
    rows = timeline.orderBy("minute").collect()
    assert len(rows) == 9 and sum(r.total_lines for r in rows) == 10
    sigs = triage.error_signatures(incident)
    top = triage.top_errors(sigs).collect()
    assert (top[0].signature, top[0]["count"], top[0].pct_of_errors) == ("connection refused to payments:<N>", 3, 50.0)
    assert top[1].signature == "error: timeout after <DUR>" and top[1].example == "error: timeout after 230ms"
    talkers = {r.value: (r.total_lines, r.error_lines) for r in triage.talkers(incident).collect()}
    assert talkers["api"] == (6, 5) and talkers["gateway"] == (2, 1)
    found = {r.window: r for r in triage.windows(timeline, sigs).collect()}
    assert set(found) == {"peak_error", "incident_start", "steady_state"}
    assert found["peak_error"].value == 5
    assert found["incident_start"]["from"].minute == 2


def test_signature_cap(make_logs):
    logs = make_logs([("10:00:00", {}, f"error: unique failure #{i}") for i in range(20)])
    assert triage.signature_cap(triage.signature_starts(logs), 3).count() == 3


def test_gaps_and_cap(make_logs):
    logs = make_logs([("10:00:10", {}, "a"), ("10:03:00", {}, "error"), ("10:09:00", {}, "b")])
    assert [(r.minute.minute, r.total_lines, r.error_lines) for r in triage.error_timeline(logs, 5).orderBy("minute").collect()] == [
        (0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 0, 0)]
    assert triage.error_timeline(logs).count() == 10
    assert triage.error_timeline(logs.limit(0)).count() == 0


def brute_windows(errors):
    size = min(5, len(errors))
    sums = [sum(errors[i:i + size]) for i in range(len(errors) - size + 1)]
    peak = (sums.index(max(sums)), size, max(sums)) if max(sums) > 0 else None
    median = sorted(errors)[len(errors) // 2]
    best = None
    for i in range(len(errors)):
        j = i
        while j < len(errors) and errors[j] <= median:
            j += 1
        if j - i >= 3 and (best is None or j - i > best[1]):
            best = (i, j - i)
    return peak, best


@pytest.mark.parametrize("seed", range(4))
def test_windows_brute_force(spark, seed):
    rng = random.Random(seed)
    errors = [rng.choice([0, 0, 0, 1, 4]) for _ in range(rng.choice([3, 12, 40]))]
    rows = [(at("10:00:00") + timedelta(minutes=i), 5, e) for i, e in enumerate(errors)]
    timeline = spark.createDataFrame(rows, "minute timestamp, total_lines bigint, error_lines bigint")
    peak, steady = brute_windows(errors)

    def found(df):
        r = df.first()
        return r and (int((r["from"].timestamp() - rows[0][0].timestamp()) // 60), r.minutes, r.value)
    assert found(triage.peak_error_window(timeline)) == peak
    got = found(triage.steady_state_window(timeline))
    assert (got and got[:2]) == steady
