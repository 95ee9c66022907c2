"""Alert rules and redaction patterns that lie in files: JSON lines with fixed columns, checked when read."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.functions.redaction import BUILTIN, Pattern, custom_pattern
from emberlog.params import ALERT_METRICS, ALERT_OPS

ALERT_RULES = "name string, metric string, op string, threshold double, detail string"
PATTERNS = "name string, regex string, replacement string"
#: Patterns become part of the query's expressions, one step each, so a file may not hold more.
MAX_PATTERNS = 200


def _refuse(rows: DataFrame, bad: Column, shown: str, why: str) -> None:
    found = rows.where(bad).select(F.col(shown).cast("string")).head()
    if found is not None:
        raise ValueError(f"{why}: {found[0]!r}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file and their place (``at``); text that is no JSON object is an error, an empty line is not."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("at")).where(F.trim("value") != "")
    parsed = lines.select("value", "at", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    _refuse(parsed, F.col("r._corrupt").isNotNull() | F.col("r").isNull() | ~F.col("value").rlike(r"^\s*\{"), "value", "not a rule")
    return parsed.select("r.*", "at").drop("_corrupt")


def _refuse_repeats(rows: DataFrame) -> None:
    _refuse(rows, F.coalesce("name", F.lit("")) == "", "name", "no name")
    _refuse(rows.groupBy("name").count(), F.col("count") > 1, "name", "name used twice")


def read_alert_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules as a table (``ALERT_RULES``). A metric, operator or threshold that does not exist is a
    ValueError, and so is a missing or repeated name; a missing detail is empty."""
    rules = _read(spark, path, ALERT_RULES)
    _refuse_repeats(rules)
    for column, known in (("metric", ALERT_METRICS), ("op", ALERT_OPS)):
        _refuse(rules, ~F.coalesce(F.col(column).isin(*known), F.lit(False)), column, f"unknown {column}")
    _refuse(rules, F.col("threshold").isNull() | F.isnan("threshold"), "name", "no threshold in rule")
    return rules.fillna("", ["detail"]).drop("at")


def read_patterns(spark: SparkSession, path: str) -> list[Pattern]:
    """Redaction patterns of one's own, in the order of the file. A pattern that cannot be
    compiled is a ValueError that names it."""
    rows = _read(spark, path, PATTERNS)
    _refuse_repeats(rows)
    _refuse(rows, F.coalesce("regex", F.lit("")) == "", "name", "no pattern under the name")
    _refuse(rows, F.col("name").isin(*[p.name for p in BUILTIN]), "name", "name of a builtin pattern")
    found = [r[:3] for r in rows.orderBy("at").limit(MAX_PATTERNS + 1).select("name", "regex", "replacement").collect()]
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns in {path}")
    patterns = []
    for name, regex, replacement in found:
        try:
            pattern = custom_pattern(name, regex, replacement or "")
            # Once on a text of no account: Spark compiles the pattern.
            spark.range(1).select(F.regexp_replace(F.lit("x"), pattern.regex, pattern.replacement)).head()
        except (PySparkException, re.error, ValueError) as e:
            raise ValueError(f"pattern {name!r} cannot be used: {e}") from e
        patterns.append(pattern)
    return patterns
