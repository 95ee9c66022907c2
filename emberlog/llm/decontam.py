"""Benchmark decontamination as a prefix-filtered set join of word shingles, in DataFrame functions only.

Every item is cut into windows of consecutive words; equal windows are one. A window is the set
of its shingles. For exact containment all shingles of a window must occur, so its rarest
shingle, by occurrences in all documents, is a necessary prefix of length one: only places of
the prefix are candidates. A window with a shingle that no document has is dropped before. The
shingle's place in the window gives the place where the window must begin in the document,
and it must lie inside the text; then the words themselves are compared.

The documents are read and cut into words once. What leaves that scan is one short row per
document and the places of shingles that the items have, each with the few words around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import stored, text_of
from emberlog.session import scratch_dir

#: Words of a window and of a shingle. A shorter item is one window; shorter windows are one shingle.
WINDOW = 10
SHINGLE = 5
#: Shingles of items that are sent to all tasks at once: at 16 bytes each, a hash table of about 100 MB
#: at most. More are taken in blocks of this size, each with a scan of its own.
BLOCK_SHINGLES = 2_000_000
#: Windows, of some 300 bytes each, up to which the prefixes are sent to all tasks; more meet the places in a shuffled join.
SENT_WINDOWS = 100_000

#: Characters between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; an empty text has none."""
    # For ASCII texts the quick lower() is the same; other texts keep the case of their other letters.
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, SEPARATORS, -1), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, words`` for every different window of every item."""
    n = F.greatest(F.size("w") - window + 1, F.lit(1))
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(text_of()).alias("w")).where(F.size("w") > 0)
    return (own.select("item_id", "w", F.explode(F.sequence(F.lit(1), n)).alias("at"))
            .select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("words")).distinct())


def _hash_at(words: Column, at: Column, size: int) -> Column:
    """Hash of the shingle of ``size`` words from place ``at`` (0: the first); null if it passes the end."""
    return F.when(at + size <= F.size(words), F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size))))


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """``window_id, offset, shingle`` of windows, those shorter than a shingle as a whole."""
    sizes = range(1, shingle)
    whole = reduce(lambda c, k: c.when(F.size("words") == k, _hash_at(F.col("words"), F.lit(0), k)), sizes, F)
    whole = whole.otherwise(F.lit(None)) if shingle > 1 else F.lit(None).cast("bigint")
    last = F.greatest(F.size("words") - shingle, F.lit(0))
    return (windows.select("window_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("offset"))
            .select("window_id", "offset", F.coalesce(whole, _hash_at(F.col("words"), F.col("offset"), shingle)).alias("shingle")))


def _places(docs: DataFrame, known: DataFrame, sizes: list[int], window: int, shingle: int, heads: bool) -> DataFrame:
    """Rows of documents from one scan: every place ``at`` whose shingle is ``known``, with the words that
    a window over it can have (from place ``from``), and if ``heads`` also the first place of every document."""
    own = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), words_of(text_of()).alias("w"))
    own = own.select("doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("at", "word"))
    each = own.withColumn("at", F.coalesce("at", F.lit(0)))
    hashes = [_hash_at(F.col("w"), F.col("at"), k) for k in sizes]
    if len(hashes) == 1:
        each = each.withColumns({"shingle": hashes[0], "size": F.lit(0)})
    else:
        each = each.select("*", F.posexplode(F.array(*hashes)).alias("size", "shingle"))
    met = each.join(F.broadcast(known.withColumn("hit", F.lit(True))), "shingle", "left" if heads else "inner")
    start = F.greatest(F.col("at") - (window - shingle), F.lit(0))
    context = F.slice("w", start + 1, F.col("at") - start + window)
    head = (F.col("at") == 0) & (F.col("size") == 0) & F.lit(heads)
    return met.where(head | F.col("hit")).select(
        "doc_id", "text_hash", "n_words", head.alias("head"), F.when(F.col("hit"), F.col("shingle")).alias("shingle"),
        F.col("at").cast("int").alias("at"), start.cast("int").alias("from"), F.when(F.col("hit"), context).alias("context"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                block: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where windows of ``items(item_id, text)`` occur in ``docs(doc_id, text)``.

    Three tables: one row per document (``doc_id, text_hash, n_words``), the occurrences (``doc_id,
    text_hash, window_id, start, length``, places counted in words from 0), and the items of each
    window (``window_id, item_id``). A document is told by its id (which may be null or repeated) and
    the hash of its text. Nothing is capped: windows that many items share are found once, and
    places are taken one by one, so a passage that a third of the documents have is plain work
    for every task."""
    spark = docs.sparkSession
    shingle = min(shingle, window)
    own = stored(windows_of(items, window).select("item_id", F.md5(F.concat_ws(" ", "words")).alias("window_id"), "words"), "decontam-windows")
    windows = own.select("window_id", "words").distinct()
    shingles = stored(_window_shingles(windows, shingle), "decontam-shingles")
    known = stored(shingles.select("shingle").distinct(), "decontam-known")
    # Sizes of shingles that occur at all: at most ``shingle`` of them.
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()) or [shingle]
    blocks = max(1, -(-known.count() // block))
    path = scratch_dir(spark, "decontam-places")
    for i in range(blocks):
        part = known.where(F.pmod("shingle", F.lit(blocks)) == i) if blocks > 1 else known
        _places(docs, part, sizes, window, shingle, i == 0).write.mode("append").parquet(path)
    all_places = spark.read.parquet(path)
    heads = all_places.where("head").select("doc_id", "text_hash", "n_words")
    places = all_places.where("shingle is not null").drop("head")

    seen = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rated = shingles.join(seen, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = (rated.groupBy("window_id").agg(F.min(F.struct("n", "shingle", "offset")).alias("p"))
              .where("p.n > 0").select("window_id", "p.shingle", "p.offset"))
    prefix = stored(prefix.join(windows, "window_id"), "decontam-prefix")
    if prefix.count() <= SENT_WINDOWS:
        prefix = F.broadcast(prefix)
    start, length = F.col("at") - F.col("offset"), F.size("words")
    found = (places.join(prefix, "shingle")
             .where((start >= 0) & (start + length <= F.col("n_words")))
             .where(F.slice("context", start - F.col("from") + 1, length) == F.col("words"))
             .select("doc_id", "text_hash", "window_id", start.alias("start"), length.alias("length")))
    return heads, found, own.select("window_id", "item_id")


def _union_length(spans: Column) -> Column:
    """Words under sorted spans ``start, length``."""
    def step(acc: Column, s: Column) -> Column:
        stop = s["start"] + s["length"]
        return F.struct(F.greatest(acc["stop"], stop).alias("stop"),
                        (acc["n"] + F.greatest(stop - F.greatest(acc["stop"], s["start"]), F.lit(0))).alias("n"))
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  block: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of any window, ``n_items`` the items that have
    such windows; the digest is over their ids, sorted as text and joined by commas. Null texts
    have no words. Repeated rows each get their result. Items without words are never found; one
    without an id goes by the empty text; equal ids are one item. Empty tables give no rows, or
    rows without hits. Other columns are not looked at."""
    heads, found, items_of = occurrences(docs, items, window, shingle, block)
    key = ["doc_id", "text_hash"]
    # Copies with the same id have the same places more than once.
    by_doc = found.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("window_id").alias("windows"))
    by_doc = stored(by_doc.select(*key, _union_length(F.col("spans")).alias("n_hit"), "windows"), "decontam-found")
    named = (by_doc.select(*key, F.explode("windows").alias("window_id")).join(items_of, "window_id")
             .groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    named = named.select(*key, F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    none = F.lit("").cast("binary")

    hits = by_doc.drop("windows").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    names = named.withColumnsRenamed({"doc_id": "_id2", "text_hash": "_hash2"})
    hits = hits.join(names, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))).drop("_id2", "_hash2")
    return (heads.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
            .select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(none, 256)).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated")))
