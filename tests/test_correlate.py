import math
import random
from datetime import timedelta

import pytest

from conftest import at
from emberlog.operators import correlate as corr


def entry(offset, app, msg):
    return (at("10:00:00") + timedelta(seconds=offset), {"app": app}, msg)


def pairs(df):
    return [(r.source, r.target, r.lag_seconds, r.pattern, r.confidence) for r in df.collect()]


def test_cascade(make_logs):
    rows = [e for i in range(10) for e in (entry(30 * i, "payments", "error: db down"),
                                           entry(30 * i + 10, "api", "timeout calling payments service"))]
    found = pairs(corr.correlate(make_logs(rows)))
    assert len(found) == 1
    source, target, lag, pattern, confidence = found[0]
    assert {source, target} == {"payments", "api"} and confidence > 0.5 and pattern == "cascade_timeout"


def test_co_failure(make_logs):
    rows = [e for i in range(5) for e in (entry(60 * i, "frontend", "error a"), entry(60 * i + 1, "backend", "error b"))]
    found = pairs(corr.correlate(make_logs(rows)))
    assert [(f[3], f[2]) for f in found] == [("co_failure", 0.0)]
    assert found[0][0] == "backend"  # of equals the first name


def test_no_cascade(make_logs):
    far = [entry(10 * i, "a", "error") for i in range(3)] + [entry(4000 + 170 * i, "b", "error") for i in range(3)]
    assert pairs(corr.correlate(make_logs(far))) == []
    assert pairs(corr.correlate(make_logs([entry(0, "a", "error")]))) == []
    assert pairs(corr.correlate(make_logs([entry(0, "a", "fine")]))) == []


def dense(x, y, lag):
    n = len(x) - lag
    a, b = x[:n], y[lag:]
    ma, mb = sum(a) / n, sum(b) / n
    va, vb = sum((v - ma) ** 2 for v in a), sum((v - mb) ** 2 for v in b)
    if va * vb == 0:
        return 1.0 if ma > 0 and mb > 0 else 0.0
    return max(0.0, sum((p - ma) * (q - mb) for p, q in zip(a, b)) / math.sqrt(va * vb))


def test_hash_aggregation_and_first_errors(make_logs):
    from pyspark.sql import functions as F
    logs = make_logs([entry(0, "a", "error one", ), entry(0, "a", "error two"), entry(15, "a", "error three"), entry(1, "b", "error four")])
    for order in (("file", "line_no"), ("ts", "file", "line_no")):
        df = corr.service_error_buckets(logs, order=order)
        first = logs.agg(F.min("ts")).first()[0].timestamp() // 10
        assert {(r.service, r.bucket - first, r.errors, r.first_error) for r in df.collect()} == {
            ("a", 0, 2, "error one"), ("a", 1, 1, "error three"), ("b", 0, 1, "error four")}
        assert "SortAggregate" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed, split", [(0, 1000), (1, 1000), (2, 1), (3, 2), (4, 1)])
def test_against_dense_vectors(make_logs, monkeypatch, seed, split):
    monkeypatch.setattr(corr, "SPLIT_SERVICES", split)  # with and without split buckets
    monkeypatch.setattr(corr, "FEW_SERVICES", 0 if seed else 200)  # with and without an index
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    base = [rng.randrange(40) for _ in range(8)]
    counts = {s: {} for s in names}
    for k, s in enumerate(names):
        for b in base:
            if rng.random() < 0.8:
                counts[s][b + k * rng.choice([0, 1])] = rng.randrange(1, 4)
    rows = [entry(10 * b, s, f"error in {s}") for s in names for b, n in counts[s].items() for _ in range(n)]
    best = {}
    for s in names:
        for t in names:
            if s == t or not counts[s] or not counts[t]:
                continue
            lo, hi = min([*counts[s], *counts[t]]), max([*counts[s], *counts[t]])
            x, y = ([counts[w].get(b, 0) for b in range(lo, hi + 1)] for w in (s, t))
            r, lag = 0.0, 0
            for k in range(min(5, len(x) - 1) + 1):
                if (v := dense(x, y, k)) > r + 1e-12:
                    r, lag = v, k
            if r > 0.5 and round(r, 2) > 0.5:
                key = (min(s, t), max(s, t))
                if key not in best or round(r, 2) > best[key][3]:
                    best[key] = (s, t, lag * 10.0, round(r, 2))
    got = {(f[0], f[1], f[2], f[4]) for f in pairs(corr.correlate(make_logs(rows)))}
    assert got == set(best.values())


def test_few_products_of_many_services(spark):
    """2000 services that all fail in the same eight minutes, and each at times of its own; 40 follow another."""
    from pyspark.sql import functions as F
    rng, counts = random.Random(5), {}
    common = rng.sample(range(20_000), 8)
    for s in range(2000):
        own = {b: 2 for b in rng.sample(range(20_000), 40)}
        counts[s] = own | dict.fromkeys(common, 1)
    for s in range(40):
        counts[1000 + s] = {b + 2: 2 for b in list(counts[s])[:40]} | dict.fromkeys(common, 1)
    rows = [(f"s{s}", b, n) for s, own in counts.items() for b, n in own.items()]
    df = spark.createDataFrame(rows, "service string, bucket bigint, errors bigint").withColumn("errors", F.col("errors").cast("decimal(20,0)"))
    profiles = corr.kept(corr.service_profiles(df, 5), "test-profiles")
    met = corr.kept(corr.meetings(df, profiles), "test-met")
    pairs = corr.kept(corr.candidates(met), "test-pairs")
    few = met.count() + corr.products(df, pairs).count()
    n = [0] * 20_010
    for _, b, _ in rows:
        n[b] += 1
    assert 10 * few < sum(n[b] * n[b + k] for k in range(6) for b in range(20_000))
    found = {(r.source, r.target, r.lag) for r in pairs.collect()}
    assert {(f"s{s}", f"s{1000 + s}", 2) for s in range(40)} <= found


def test_sequence(spark):
    rows = [("api", "db", 10.0, "cascade_error", 0.9), ("web", "api", 0.0, "co_failure", 0.8), ("web", "cache", 20.0, "cascade_error", 0.7)]
    df = spark.createDataFrame(rows, "source string, target string, lag_seconds double, pattern string, confidence double")
    assert [(r["index"], r.name) for r in corr.participants(df).orderBy("index").collect()] == [
        (0, "api"), (1, "web"), (2, "cache"), (3, "db")]
    arrows = corr.interactions(df).orderBy("position").collect()
    assert [a.label for a in arrows] == ["co_failure +0s (80%)", "cascade_error +10s (90%)", "cascade_error +20s (70%)"]


def test_mentions_quotes_names(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("calling A.B now", "a.b"), ("calling axb now", "a.b"), ("x", "")], "m string, s string")
    assert [r[0] for r in df.select(corr.mentions_service(F.col("m"), F.col("s"))).collect()] == [True, False, False]
