import json
import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberlog import session  # noqa: E402

UTC = timezone.utc


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
                      spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def at(clock: str, day: str = "2024-01-15") -> datetime:
    return datetime.fromisoformat(f"{day}T{clock}").replace(tzinfo=UTC)


@pytest.fixture
def make_logs(spark):
    """Rows (time, labels, msg[, file[, capture]]); line numbers count within capture and file."""
    def make(rows):
        out, lines = [], {}
        for ts, labels, msg, *rest in rows:
            file, capture = (list(rest) + ["f1", "c1"][len(rest):])[:2]
            lines[(capture, file)] = line = lines.get((capture, file), 0) + 1
            out.append((at(ts) if isinstance(ts, str) else ts, labels, msg, file, capture, line))
        return spark.createDataFrame(
            out, "ts timestamp, labels map<string,string>, msg string, file string, capture string, line_no bigint")
    return make


@pytest.fixture
def text_column(spark):
    """Apply a column function to each text."""
    from pyspark.sql import functions as F

    def apply(fn, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[1] for r in sorted(df.select("i", fn(F.col("t")).alias("r")).collect())]
    return apply


def seconds(base: str, *offsets):
    return [at(base) + timedelta(seconds=s) for s in offsets]


def write_lines(path, rows, opener=open):
    with opener(path, "wt") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")
