"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves over a binary trie.

Equal fingerprints are one leaf. The trie is not stored: its node at a depth is the run of
fingerprints that share so many leading bits, with its least and greatest member. Pairs of nodes
are walked down together. The bits that all members of both nodes share tell how far the two
sides differ already; a pair over the budget is dropped with all that lies below it, and a
pair of leaves is decided at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from emberlog.llm.common import stored, text_of
from emberlog.llm.graph import components

SEED = 42
#: Shingles counted at a time; bounds the memory that a long text takes.
PIECE = 200_000
#: Depths at which pairs of nodes are met on the way from the root to the leaves. Down to the
#: first there are at most 2**8 nodes, which the driver walks itself.
DEPTHS = (8, 12, 16, 20, 24, 32, 44, 64)


def fingerprint_of(text: str, size: int = 3) -> int:
    """The 64 majority bits over the hashes of all word shingles; 0 if there is no word.

    A-Z are lower-cased; words are parted by space and U+0009 to U+000D; a text of fewer words
    than a shingle is one shingle. A bit is set if over half of the hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, PIECE):
        part = words[start:start + PIECE + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if n > 1 or len(words) == size else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint_of(t) for t in batch], np.uint64).view(np.int64), dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp bigint``, a row for every row of ``docs``; null and empty texts have 0."""
    return docs.select("doc_id", _fingerprints(text_of()).alias("fp"))


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _nodes(leaves: DataFrame, depth: int) -> DataFrame:
    """Nodes at a depth that have leaves below, with the least and the greatest leaf. All leaves of
    a node share their sign bit, so signed order is the order of the bits."""
    nodes = leaves.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("node")).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    # The leading bits that all leaves share: those above the first in which the extremes part.
    nodes = nodes.withColumn("parted", F.col("lo").bitwiseXOR(F.col("hi")))
    for shift in (1, 2, 4, 8, 16, 32):
        nodes = nodes.withColumn("parted", F.col("parted").bitwiseOR(F.shiftrightunsigned("parted", shift)))
    return nodes.select("node", "lo", F.bitwise_not("parted").alias("shared"), (F.col("lo") == F.col("hi")).alias("leaf"))


def _children(pairs: DataFrame, nodes: DataFrame, step: int, budget: int) -> DataFrame:
    """Pairs of nodes ``step`` bits further down that keep within the budget. A node paired with
    itself gives each pair of its children once, and each child with itself unless it is a leaf."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.shiftrightunsigned("node", step).alias(f"{name}_up"), F.col("node").alias(name),
                            *(F.col(c).alias(f"{name}_{c}") for c in ("lo", "shared", "leaf")))
    met = pairs.toDF("a_up", "b_up").join(side("a"), "a_up").join(side("b"), "b_up").where("a_up <> b_up or a <= b")
    # Bits in which the sides differ for sure; what lies below can only add to them.
    near = met.where(F.expr("bit_count((a_lo ^ b_lo) & a_shared & b_shared)") <= budget)
    return near.where("a <> b or not a_leaf").select("a", "b", "a_lo", "b_lo", F.expr("a_leaf and b_leaf").alias("decided"))


def _top(nodes: DataFrame, depth: int, budget: int) -> list[tuple[int, int]]:
    """Pairs of the first nodes within the budget: at most 2**depth nodes, walked from the root."""
    present, pairs = {r["node"] for r in nodes.select("node").collect()}, [(0, 0)]
    for level in range(1, depth + 1):
        here = {n >> depth - level for n in present}
        pairs = [(x, y) for a, b in pairs for x in (2 * a, 2 * a + 1) for y in (2 * b, 2 * b + 1)
                 if x <= y and x in here and y in here and (x ^ y).bit_count() <= budget]
    return pairs


def near_pairs(leaves: DataFrame, budget: int = 2) -> DataFrame:
    """Pairs ``a < b`` of the distinct values in ``leaves(fp bigint)`` with at most ``budget`` differing bits.

    Every such pair is found, once. Nulls must be left out before. An empty table gives no pairs."""
    above, found = DEPTHS[0], []
    pairs = leaves.sparkSession.createDataFrame(_top(_nodes(leaves, above), above, budget), "a bigint, b bigint")
    for depth in DEPTHS[1:]:
        met = stored(_children(pairs, _nodes(leaves, depth), depth - above, budget), "simhash-pairs")
        found.append(met.where("decided").select(F.least("a_lo", "b_lo").alias("a"), F.greatest("a_lo", "b_lo").alias("b")))
        pairs, above = met.where("not decided").select("a", "b"), depth
    return reduce(DataFrame.union, found)


def _named(prints: DataFrame, budget: int) -> DataFrame:
    """``fp, component, component_id`` of every fingerprint; ``component`` is the least fingerprint of its group."""
    leaves = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-leaves")
    parts = components(near_pairs(leaves.select("fp"), budget))
    named = leaves.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def groups(prints: DataFrame, budget: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``prints(doc_id, fp)``.

    Rows with the same fingerprint are linked, and so are those whose fingerprints differ in at
    most ``budget`` bits; ``component_id`` is the smallest ``doc_id`` that links lead to. Null
    ids take part and get the group's id (null if it has no other)."""
    return prints.join(_named(prints, budget), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of their group of near-duplicates, all
    columns kept.

    Rows are told apart by id and text, so an id on two texts may lose one of them. Of several texts
    of the smallest id in one group that with the least fingerprint stays (of equal ones that with
    the least hash); so it is among rows without an id in a group that has no id. Rows equal in both stay or go together."""
    text_hash = F.xxhash64(text_of())
    prints = stored(docs.select("doc_id", text_hash.alias("text_hash"), _fingerprints(text_of()).alias("fp")), "simhash-prints")
    rows = prints.join(_named(prints, budget), "fp")
    best = (rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component")
            .agg(F.min(F.struct("fp", "text_hash")).alias("best")))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.struct("fp", "text_hash") == F.col("best"))
    dropped = rows.join(best, "component").where(~stays).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash"))
    return docs.join(dropped, same, "left_anti")
