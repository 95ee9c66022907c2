"""Decode JSON text."""

from pyspark.sql import DataFrame, functions as F, types as T


def decode(df: DataFrame, column: str, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """Add the fields of the JSON text in ``column``; rows that are no such object are left out,
    or kept with ``_corrupt`` set.

    The decoder sits in a generator, through which conditions on its fields are not moved:
    each text is decoded once, however many conditions and columns use it."""
    entry = F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    decoded = df.where(F.trim(column) != "").select("*", F.inline(F.array(entry)))
    return decoded if keep_bad else decoded.where("_corrupt is null").drop("_corrupt")
