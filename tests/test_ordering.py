"""The two-level computations against plain Python."""

import random

from pyspark.sql import functions as F

from emberlog.operators.ordering import broadcast_if_small, number_rows, running_total, upper_median, with_previous


def test_running_total_with_one_heavy_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(5)}", rng.randrange(500), i, rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    got = {r.i: r.running for r in running_total(df, F.col("v"), ["t", "i"], F.expr("t div 10"), ["k"]).collect()}
    sums = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        assert got[i] == sums[k]


def test_rows_without_order_value_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (3, 3), (None, 4)], "t int, i int")
    got = {r.i: r.line_no for r in number_rows(df, ["t", "i"], F.expr("t div 2")).collect()}
    assert got == {1: 1, 4: 2, 3: 3, 2: 4}


def test_upper_median(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(-2000, 2000) if k != "hot" else 7) for k in ("a", "b", "hot") for _ in range(rng.randrange(1, 200))]
    rows += [("one", 5), ("two", 1), ("two", 2)]
    got = {r.k: (r["median"], r.n) for r in upper_median(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", 100).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        assert got[key] == (values[len(values) // 2], len(values))


def test_broadcast_only_when_small(spark):
    df = spark.range(10)
    assert "ResolvedHint" in broadcast_if_small(spark, df, 10)._jdf.queryExecution().analyzed().toString()
    assert broadcast_if_small(spark, df, 9) is df


def test_previous_row_across_slices(spark):
    rng = random.Random(3)
    rows = [(k, t, rng.randrange(100)) for k in ("a", "b") for t in rng.sample(range(400), 60)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r.k, r.t): r.previous and r.previous.v for r in with_previous(df, ["v"], "t", F.expr("t div 50"), ["k"]).collect()}
    for key in ("a", "b"):
        last = None
        for k, t, v in sorted(r for r in rows if r[0] == key):
            assert got[(k, t)] == last
            last = v
