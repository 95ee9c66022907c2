"""What goes to Python's tasks at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from emberlog import session


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    docs = session.configure(spark).range(0, 400, 1, 1).select("id", F.repeat(F.lit("word "), 20_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})
    got = docs.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    assert sum(r["rows"] for r in got) == 400 and sum(r["bytes"] for r in got) >= 40_000_000
    assert max(r["bytes"] for r in got) < 10 << 20
