"""Search with counts and context lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from emberlog.operators.filters import match
from emberlog.operators.ordering import running_total

CHRONOLOGICAL = ("ts", "file", "line_no")
# Lines per slice of a file when context groups are numbered.
SLICE_LINES = 1_000_000


def grep(logs: DataFrame, pattern: str | None = None, sort: bool = False,
         order: Sequence[str] = CHRONOLOGICAL, **filters) -> DataFrame:
    hits = logs.where(match(grep=pattern, **filters))
    return hits.orderBy(*order) if sort else hits


def first_hits(logs: DataFrame, n: int, pattern: str | None = None, **filters) -> DataFrame:
    """Any ``n`` hits. Nothing is ordered, so every scan task stops once it has found enough."""
    return grep(logs, pattern, **filters).limit(n)


def grep_count(logs: DataFrame, pattern: str | None = None, keys: Sequence[str] = ("file",), **filters) -> DataFrame:
    """Matches per file; files without a match have no row."""
    return (logs.where(match(grep=pattern, **filters)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("count")))


def context_spans(hits: DataFrame, context: int, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Line numbers within ``context`` lines of a hit, each with its group and mark.

    ``hits`` has the keys and ``line_no``. Ranges that overlap or touch form one group;
    groups count from 1 in each file. The mark is empty for a hit, ``before`` if any later
    hit follows in the file, ``after`` otherwise.

    Nothing here is ordered per file: a line knows that it continues a group because some
    hit's range covers the line before it, which is one hash aggregation."""
    keys = list(keys)
    low = F.greatest(F.lit(1), F.col("line_no") - context)
    covered = (
        hits.select(*keys, F.col("line_no").alias("_hit"), low.alias("_low"),
                    F.explode(F.sequence(low, F.col("line_no") + context + 1)).alias("line_no"))
        .groupBy(*keys, "line_no")
        .agg(F.max(F.col("line_no") <= F.col("_hit") + context).alias("_shown"),
             F.max(F.col("line_no") > F.col("_low")).alias("_continues"),
             F.max(F.col("line_no") == F.col("_hit")).alias("is_match"))
        .where("_shown"))
    last = hits.groupBy(*keys).agg(F.max("line_no").alias("_last"))
    numbered = running_total(covered, (~F.col("_continues")).cast("int"), ["line_no"],
                             F.expr(f"line_no div {SLICE_LINES}"), keys, "group")
    mark = (F.when(F.col("is_match"), "").when(F.col("line_no") < F.col("_last"), "before").otherwise("after"))
    return numbered.join(last, keys).select(*keys, "line_no", "group", mark.alias("context"))


def grep_context(logs: DataFrame, pattern: str | None, context: int, keys: Sequence[str] = ("file",),
                 **filters) -> DataFrame:
    """Matches with the lines around them; ``logs`` must have ``line_no`` counted from 1 in each file."""
    # The places of the hits are kept: finding them reads and numbers all lines.
    hits = logs.where(match(grep=pattern, **filters)).select(*keys, "line_no").persist()
    return logs.join(context_spans(hits, context, keys), [*keys, "line_no"])
