"""Digests of files, manifests and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def manifest(files: DataFrame) -> DataFrame:
    """``file``, ``content`` (binary or text) -> file, sha256, bytes. Narrow: no shuffle."""
    content = F.col("content").cast("binary")
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes"))


def manifest_lines(digests: DataFrame) -> DataFrame:
    """Text lines of the checksum format: digest, two spaces, file name."""
    return digests.select(F.concat_ws("  ", "sha256", "file").alias("value"))


def read_manifest_lines(lines: DataFrame) -> DataFrame:
    """Inverse of manifest_lines; lines without the two spaces are skipped."""
    cut = F.instr("value", "  ")
    return lines.where(cut > 0).select(
        F.expr("substring(value, instr(value, '  ') + 2)").alias("file"),
        F.expr("substring(value, 1, instr(value, '  ') - 1)").alias("sha256"))


def root_digest(digests: DataFrame, capture: str = "capture") -> DataFrame:
    """Digest over the manifest lines of each capture, sorted by file name.

    This puts one short line per file of one capture together (not the file contents)."""
    line = F.struct("file", F.concat_ws("  ", "sha256", "file").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda e: F.concat(e["line"], F.lit("\n")))
    return digests.groupBy(capture).agg(
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("root_sha256"),
        F.count(F.lit(1)).alias("files"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that differ from the manifest, are missing, or are extra. No rows = valid."""
    e = expected.select("file", F.col("sha256").alias("expected"))
    a = actual.select("file", F.col("sha256").alias("actual"))
    status = (F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra")
              .when(F.col("expected") != F.col("actual"), "mismatch"))
    return (e.join(a, "file", "full_outer").select("file", status.alias("status"), "expected", "actual")
            .where("status is not null"))
