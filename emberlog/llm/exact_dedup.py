"""Exact deduplication as a stream with keyed state that never expires.

Rows enter as (digest, identifier, locator). The state, held on disk by RocksDB and saved with
every batch, keeps for each digest the smallest identifier, the locator of that row's content and
the number of rows so far; it has no watermark, so nothing is forgotten. Batches add to it by
map-side combined aggregates, so a digest that a third of all rows share is no burden. After a
restart the stream goes on where its checkpoint ended. A digest seen twice is only a hit: the
full bytes of both rows are then compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import stored, text_of
from emberlog.session import scratch_dir, streaming_session

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Landed files that one batch takes; bounds the work lost with a failed batch.
FILES_PER_BATCH = 1000


def normalised(text: Column) -> Column:
    """Every run of space and U+0009 to U+000D as one space. Only runs that change are matched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _landed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """What the stream reads: each row's digest, identifier and where its content lies."""
    rows = docs.select("doc_id", normalised(text_of()).alias("text"), F.input_file_name().alias("file"))
    return rows.select(digest(F.col("text")).alias("digest"), F.col("doc_id").alias("id"),
                       F.struct("file", F.octet_length("text").alias("bytes")).alias("locator"))


def run_stream(landed_path: str, landed: DataFrame, files_per_batch: int, state: str, out: str) -> None:
    """Feed landed rows through the state. Each batch writes the entries it touched under its own
    number, so a batch that is run again replaces what it wrote."""
    spark = streaming_session(landed.sparkSession, int(landed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Executors hold a partition's state on disk only while a task works on it; between batches it
    # lies in the shared folder. An open store takes several MB of disk, however little it holds.
    spark.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    rows = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(landed_path)
    # The row with the smallest id; a row without an id counts as the last.
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "locator")
    entries = rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (entries.writeStream.outputMode("update").option("checkpointLocation", state)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()


def _entries(docs: DataFrame, digest: Callable[[Column], Column], files_per_batch: int) -> tuple[DataFrame, DataFrame]:
    """The landed rows, and the last entry of every digest."""
    spark = docs.sparkSession
    landed = _landed(docs, digest)
    path, out = scratch_dir(spark, "dedup-landed"), scratch_dir(spark, "dedup-entries")
    landed.write.parquet(path)
    run_stream(path, landed, files_per_batch, scratch_dir(spark, "dedup-state"), out)
    landed = spark.read.schema(landed.schema).parquet(path)
    schema = "digest string, first struct<unnamed:boolean,id:bigint,locator:struct<file:string,bytes:int>>, n bigint, batch int"
    written = spark.read.schema(schema).parquet(out)
    last = written.groupBy("digest").agg(F.max(F.struct("batch", "first", "n")).alias("e"))
    return landed, last.select("digest", F.col("e.first.id").alias("keep_id"), F.col("e.n").alias("group_size"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text, ...)``.

    Texts are equal if their normalised bytes are; null counts as empty. Of equal texts the row
    with the smallest ``doc_id`` stays. Rows that repeat an id with the same text count one by one
    and stay or go together; rows without an id come last, and stay only in a group without ids (they
    cannot be looked up, so their digest decides).
    Other columns are not looked at; an empty table gives no rows."""
    landed, entries = _entries(docs, digest, files_per_batch)
    found = stored(landed.join(entries, "digest").select("digest", F.col("id").alias("doc_id"), "keep_id", "group_size"), "dedup-found")
    own = docs.select("doc_id", normalised(text_of()).alias("text"))
    hits = found.where("group_size > 1")
    # Full bytes on every hit: the row's own text against that of the row its entry points to.
    pairs = hits.select("doc_id", "keep_id").where("doc_id <> keep_id").distinct()
    kept_text = own.join(hits.where("doc_id = keep_id").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    kept_text = kept_text.groupBy(F.col("doc_id").alias("keep_id")).agg(F.min("text").alias("kept_text"))
    other = own.join(pairs.hint("shuffle_hash"), "doc_id").join(kept_text, "keep_id").where("text <> kept_text")
    clashes = found.join(other.select("doc_id").distinct(), "doc_id", "left_semi").select("digest").distinct()
    if clashes.isEmpty():
        result = found
    else:
        result = found.join(clashes, "digest", "left_anti").unionByName(_apart(docs, digest, clashes))
    exact = result.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest")
    if digest is sha256:
        return exact.withColumnRenamed("digest", "text_sha256")
    return exact


def _apart(docs: DataFrame, digest: Callable[[Column], Column], clashes: DataFrame) -> DataFrame:
    """Groups by the full bytes, for the digests that different texts share."""
    rows = docs.select("doc_id", normalised(text_of()).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = rows.join(clashes, "digest", "left_semi")
    groups = rows.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")


def keep_first(docs: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The rows of ``docs`` that :func:`deduplicate` keeps, all columns kept."""
    dropped = deduplicate(docs, files_per_batch=files_per_batch).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    # An id alone may stand on rows with other texts, and a null id on any.
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (sha256(normalised(text_of())) == F.col("_digest"))
    return docs.join(dropped, same, "left_anti")
