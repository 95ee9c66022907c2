"""Fault injection: synthetic errors, lost services, slow responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from emberlog.functions.labels import label_equals
from emberlog.params import Fault

# Messages of an error spike, and what a slow response looks like.
SYNTHETIC_ERRORS = ("error: connection timeout", "error: 503 service unavailable", "panic: runtime error")
SLOW_SUFFIX = " [SLOW: 5.2s]"
MARK = ("_injected", "true")


def _marked(labels):
    key, value = MARK
    others = F.map_filter(F.coalesce(labels, F.expr("cast(map() as map<string,string>)")), lambda k, v: k != key)
    return F.map_concat(others, F.create_map(F.lit(key), F.lit(value)))


def _versions(logs: DataFrame, faults: Sequence[Fault]) -> DataFrame:
    """Add ``_out``: the versions of each entry after all faults, as an array of structs."""
    one = F.struct(F.lit(0).alias("copy"), F.col("labels").alias("labels"), F.col("msg").alias("msg"))
    df = logs.withColumn("_out", F.array(one))
    for fault in faults:
        inside = (F.col("ts") >= F.lit(fault.at)) & (F.col("ts") < F.lit(fault.at + fault.duration))
        if fault.type == "error-spike":
            extra = F.array(*[
                F.struct((F.size("_out") + i).alias("copy"), _marked(F.col("labels")).alias("labels"),
                         F.lit(text).alias("msg"))
                for i, text in enumerate(SYNTHETIC_ERRORS)])
            changed = F.concat("_out", extra)
        elif fault.type == "service-down":
            changed = F.filter("_out", lambda e: ~label_equals(e["labels"], "app", fault.service))
        else:
            changed = F.transform("_out", lambda e: F.when(
                label_equals(e["labels"], "app", fault.service),
                F.struct(e["copy"].alias("copy"), _marked(e["labels"]).alias("labels"),
                         F.concat(e["msg"], F.lit(SLOW_SUFFIX)).alias("msg"))).otherwise(e))
        if fault.service is not None:
            inside = inside & label_equals(F.col("labels"), "app", fault.service)
        df = df.withColumn("_out", F.when(inside, changed).otherwise(F.col("_out")))
    return df


def inject(logs: DataFrame, faults: Sequence[Fault]) -> DataFrame:
    """Apply the faults in order to every entry whose time is in the fault's window
    ``[at, at + duration)``. ``copy`` is 0 for the entry itself and counts the synthetic ones.

    Each entry becomes an array of its versions, which is then exploded: no shuffle."""
    rest = [c for c in logs.columns if c not in ("labels", "msg")]
    return _versions(logs, faults).select(*rest, F.inline("_out"))


def inject_stats(logs: DataFrame, faults: Sequence[Fault]) -> DataFrame:
    """original / injected / total lines, where injected is what the total gained or lost."""
    counts = _versions(logs.select("ts", "labels", "msg"), faults).agg(
        F.count(F.lit(1)).alias("original_lines"),
        F.coalesce(F.sum(F.size("_out")), F.lit(0)).alias("total_lines"))
    return counts.select("original_lines", (F.col("total_lines") - F.col("original_lines")).alias("injected_lines"),
                         "total_lines", F.lit(len(faults)).cast("bigint").alias("faults"))
