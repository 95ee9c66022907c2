"""Row predicates and file pruning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.functions.labels import label_equals, label_present
from emberlog.functions.regex import matches
from emberlog.operators.ordering import semi_join_small

Labels = Mapping[str, str] | Iterable[tuple[str, str]] | None


def _pairs(labels: Labels) -> list[tuple[str, str]]:
    return list(labels.items() if isinstance(labels, Mapping) else labels or ())


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def time_between(ts: Column, frm: datetime | None, to: datetime | None) -> Column:
    """Both ends included; a missing end is open."""
    parts = []
    if frm is not None:
        parts.append(ts >= F.lit(frm))
    if to is not None:
        parts.append(ts <= F.lit(to))
    return all_of(parts)


def text_or_label_matches(pattern: str, msg: Column | None = None, labels: Column | None = None) -> Column:
    """The regex is found in the message or in any label value."""
    msg = F.col("msg") if msg is None else msg
    labels = F.col("labels") if labels is None else labels
    in_labels = F.exists(F.map_values(labels), lambda v: matches(v, pattern))
    return F.coalesce(matches(msg, pattern), F.lit(False)) | F.coalesce(in_labels, F.lit(False))


def match(frm: datetime | None = None, to: datetime | None = None, labels: Labels = None,
          grep: str | None = None) -> Column:
    """Time range, labels (all must hold) and regex; what is not given is true."""
    parts = [time_between(F.col("ts"), frm, to)]
    parts += [label_equals(F.col("labels"), k, v) for k, v in _pairs(labels)]
    if grep is not None:
        parts.append(text_or_label_matches(grep))
    return all_of(parts)


def filter_logs(logs: DataFrame, **filters) -> DataFrame:
    return logs.where(match(**filters))


def filter_label_present(logs: DataFrame, key: str, value: str) -> DataFrame:
    return logs.where(label_present(F.col("labels"), key, value))


def filter_stack(logs: DataFrame, stack: Sequence[tuple[str, str]],
                 label: tuple[str, str] | None = None) -> DataFrame:
    """A label filter, then ("keep" | "hide", regex) filters in order."""
    if label:
        logs = filter_label_present(logs, *label)
    for mode, pattern in stack:
        hit = text_or_label_matches(pattern)
        logs = logs.where(hit if mode == "keep" else ~hit)
    return logs


def time_jump(logs: DataFrame, fragment: str, order: Sequence[str] = ("file", "line_no")) -> DataFrame:
    """The first entry whose UTC time text (to the second) contains the fragment."""
    fragment = fragment.strip()
    if not fragment:
        return logs.limit(0)
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return logs.where(text.contains(fragment)).orderBy(*order).limit(1)


# ---- file level -------------------------------------------------------------------------

def file_may_match(frm: datetime | None = None, to: datetime | None = None, labels: Labels = None) -> Column:
    """False for index rows whose file cannot hold a match: the time ranges are apart, or a
    label key is known in the file but the value is not. A regex never prunes."""
    parts = []
    if frm is not None:
        parts.append(F.col("to") >= F.lit(frm))
    if to is not None:
        parts.append(F.col("from") <= F.lit(to))
    for key, value in _pairs(labels):
        values = F.try_element_at("labels", F.lit(key))
        parts.append(values.isNull() | F.coalesce(F.map_contains_key(values, F.lit(value)), F.lit(False)))
    return all_of(parts)


def prune_files(index: DataFrame, **filters) -> DataFrame:
    return index.where(file_may_match(**filters))


def slice_files(index: DataFrame, frm: datetime | None = None, to: datetime | None = None,
                labels: Labels = None) -> DataFrame:
    """The slice variant: labels are alternatives and must be known in the file."""
    hits = [F.coalesce(F.map_contains_key(F.try_element_at("labels", F.lit(k)), F.lit(v)), F.lit(False))
            for k, v in _pairs(labels)]
    by_label = reduce(lambda a, b: a | b, hits) if hits else F.lit(True)
    return index.where(file_may_match(frm, to) & by_label)


def slice_logs(logs: DataFrame, index: DataFrame, frm: datetime | None = None, to: datetime | None = None,
               labels: Labels = None, grep: str | None = None, raw: Column | None = None,
               bad: Column | None = None, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Entries with ``from <= ts < to`` of the files kept by ``slice_files``, the regex being
    tested on the stored line (``raw``). Lines marked ``bad`` (no readable entry) stay only
    when there is no time bound."""
    parts = []
    bounded = frm is not None or to is not None
    if frm is not None:
        parts.append(F.col("ts") >= F.lit(frm))
    if to is not None:
        parts.append(F.col("ts") < F.lit(to))
    if grep is not None:
        parts.append(matches(F.col("msg") if raw is None else raw, grep))
    if bounded and bad is not None:
        parts.append(~bad)
    files = slice_files(index, frm, to, labels).select(*keys).distinct()
    return semi_join_small(logs.where(all_of(parts)), files, keys)


def tail_n(logs: DataFrame, n: int, grep: str | None = None, label: tuple[str, str] | None = None,
           order: Sequence[str] = ("file", "line_no")) -> DataFrame:
    """The last n entries of the newest file, then filtered: fewer than n may be left."""
    newest = logs.agg(F.max("file")).scalar()
    last = (logs.where(F.col("file") == newest)
            .orderBy(*[F.col(c).desc() for c in order]).limit(n))
    if label:
        last = filter_label_present(last, *label)
    if grep is not None:
        last = last.where(text_or_label_matches(grep))
    return last.orderBy(*order)




def replay_offset(logs: DataFrame, speed: float) -> DataFrame:
    """``offset_seconds`` at which each entry is replayed; speed 0 means all at once."""
    if speed == 0:
        return logs.withColumn("offset_seconds", F.lit(0.0))
    first = logs.agg(F.min(F.unix_micros("ts"))).scalar()
    return logs.withColumn("offset_seconds", (F.unix_micros("ts") - first) / F.lit(1e6 * speed))
