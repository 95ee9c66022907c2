"""Label maps."""

from pyspark.sql import Column, functions as F


def flatten_labels(labels: Column) -> Column:
    """``k=v;k=v`` sorted by key; empty text for no labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)),
                        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(pairs, ";"), F.lit(""))


def service_label(labels: Column) -> Column:
    """The ``app`` label, else the value of the alphabetically first key; null if there is none."""
    first = F.try_element_at(labels, F.array_min(F.map_keys(labels)))
    return F.nullif(F.coalesce(F.nullif(F.try_element_at(labels, F.lit("app")), F.lit("")), first), F.lit(""))


def label_equals(labels: Column, key: str, value: str) -> Column:
    """A missing key counts as the empty value."""
    return F.coalesce(F.try_element_at(labels, F.lit(key)), F.lit("")) == F.lit(value)


def label_present(labels: Column, key: str, value: str) -> Column:
    """The key must be there; a null value counts as the empty one."""
    there = F.coalesce(F.map_contains_key(labels, key), F.lit(False))
    return there & (F.coalesce(F.try_element_at(labels, F.lit(key)), F.lit("")) == F.lit(value))
