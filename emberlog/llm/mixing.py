"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source fall into blocks by a seeded hash. The source's target becomes a quota
of blocks: whole passes over all of them, then blocks in permuted order, of which the last is cut
at a document. A document that does not fit there is passed over, and those after it are tried in
the same order until none is left that fits. A tree over the output shards splits the quotas: at every node the left half draws
its blocks from what the node holds, hypergeometrically over all sources at once, so the quotas add
up exactly. Each shard then owns a run of every source's block order, disjoint from all
others, and is shuffled within itself. Only figures per source ever reach the driver; the
documents take one join with them and, to be written out, one shuffle to their shards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.llm.common import WORD_PATTERN, let, stored, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words; and the most often that a source or document may be taken.
SHARE = 1.5
MOST = 2
#: Documents in a block where a source has few; blocks of a source where it has many.
BLOCK_DOCS = 64
MOST_BLOCKS = 4096
SHARDS = 64
#: Words that one task shuffles; larger shards are dealt into several pieces of this size.
PIECE_WORDS = 25_000_000
SEED = 17
#: Sources up to which the recipes, of a few KB each, are broadcast; beyond, they are joined by source.
BROADCAST_SOURCES = 10_000
RUN = ("struct<after_block:bigint,after_h:bigint,after_id:bigint,has_after:boolean,upto_block:bigint,upto_h:bigint,upto_id:bigint,"
       "has_upto:boolean,limit:bigint>")


@dataclass
class Recipe:
    """What is known of one source."""
    source: str | None
    size: int
    docs: int
    target: float
    blocks: int
    passes: int
    rest: float
    whole: int = 0                 # blocks of the last pass that are taken whole
    # Runs of the order (block, hash, doc_id) that the last pass takes, as (after, upto, limit): both ends are
    # places or None, for the start and the end; of the first run all is taken, of the others the documents of 1 to limit words.
    runs: list = field(default_factory=list)
    bounds: list = field(default_factory=list)  # number of blocks that belong to shards up to each


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint")


def targets(sizes: list[int], weights: list[int], share: float = SHARE, most: int = MOST) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight; what is above ``most`` times a
    source's size goes to the others by weight, until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of every shard (rows) from every source (columns); each column adds up to its quota."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.concatenate([split(drawn, left, rng), split(quotas - drawn, shards - left, rng)])


def _permuted(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> list[Recipe]:
    """The recipes of the sources in ``sized(doc_id, source, size)``; figures per source only."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share)
    recipes = []
    for row, target in zip(totals, goal, strict=True):
        passes = int(target // row["size"]) if row["size"] else 0
        recipes.append(Recipe(row["source"], row["size"], row["docs"], target, min(MOST_BLOCKS, -(-row["docs"] // BLOCK_DOCS)),
                              passes, target - passes * row["size"]))
    if not recipes:
        return recipes

    # Rows of one id are taken alike, so they are one document here.
    places = stored(sized.groupBy("source", "doc_id").agg(F.sum("size").alias("size"), F.min("size").alias("least"), F.max("size").alias("most"))
                    .withColumn("h", _permuted(seed)), "mix-places")
    open_ = {r.source: (r, None, None) for r in recipes if r.rest >= 1}  # recipe, place passed over, limit
    while open_:
        columns = [(r.source, r.blocks, float(r.rest), after is not None, *(after or (None, None, None)), limit) for r, after, limit in open_.values()]
        own = _by_source(places, columns, "of string, blocks bigint, rest double, later boolean, after_block bigint, after_h bigint, after_id bigint, limit bigint")
        tried = places.join(own, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod("h", "blocks"))
        tried = tried.where(~F.col("later") | (F.struct("block", "h", F.col("doc_id").alias("id")) > F.struct(
            F.col("after_block").alias("block"), F.col("after_h").alias("h"), F.col("after_id").alias("id"))))
        tried = tried.where("limit is null or (most > 0 and least <= limit)")
        # Rows of one id of which only some would fit are passed over as well.
        tried = tried.withColumn("words", F.expr("if(limit is null or (least > 0 and most <= limit), size, size + limit + 1)"))
        sums = tried.groupBy("of", "rest", "block").agg(F.sum("words").alias("words"))
        upto = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        found = {r["of"]: r for r in sums.groupBy("of").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("block", F.expr("upto - words").alias("before")))).alias("at")).collect()}
        cut, ended = [], [source for source in open_ if source not in found]
        for source, row in found.items():
            r, after, limit = open_[source]
            if row["at"] is None:
                r.runs.append((after, None, limit))
                ended.append(source)
            else:
                cut.append((source, r.blocks, row["at"]["block"], float(r.rest - row["at"]["before"])))
        if cut:
            # Inside the block that the words end in: the last document that fits and the first that does not.
            own = _by_source(places, cut, "cut_of string, cut_blocks bigint, cut_block bigint, left double")
            edge = tried.join(own, F.col("of").eqNullSafe(F.col("cut_of")) & (F.col("block") == F.col("cut_block")))
            order = Window.partitionBy("of").orderBy("h", "doc_id")
            edge = edge.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            place, fits = F.struct("h", F.col("doc_id").alias("id")), F.col("upto") <= F.col("left")
            edge = edge.groupBy("of", "cut_block", "left").agg(F.max(F.when(fits, place)).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("words"),
                                                            F.min(F.when(~fits, place)).alias("next"))
            for row in edge.collect():
                r, after, limit = open_[row["of"]]
                block = row["cut_block"]
                if limit is None:
                    r.whole = block
                if row["last"] is not None or block > (after[0] if after else 0):
                    r.runs.append((after, (block, *(row["last"] or (None, None))), limit))
                r.rest = row["left"] - (row["words"] or 0)
                open_[row["of"]] = (r, (block, *row["next"]), int(r.rest))
                if r.rest < 1:
                    ended.append(row["of"])
        for source in ended:
            del open_[source]

    quotas = np.array([r.passes * r.blocks + r.whole + bool(r.runs) for r in recipes], np.int64)
    parts = split(quotas, shards, np.random.default_rng(seed))
    for r, column in zip(recipes, np.cumsum(parts, axis=0).T, strict=True):
        r.bounds = column.tolist()
    return recipes


def _by_source(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    own = like.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(own) if len(rows) <= BROADCAST_SOURCES else own


def mix(docs: DataFrame, recipes: list[Recipe], size: Column, seed: int = SEED) -> DataFrame:
    """The rows of ``docs(doc_id, source, ...)``, of ``size`` words each, with ``_of`` (their recipe's size and target) and
    ``_shards``, the shard of each time that they are taken (empty: not at all)."""
    rows = [(r.source, r.size, r.target, r.blocks, r.passes, r.whole, [(*(after or (None,) * 3), after is not None, *(upto or (None,) * 3), upto is not None, limit)
             for after, upto, limit in r.runs], r.bounds) for r in recipes]
    own = _by_source(docs, rows, f"of string, size bigint, target double, blocks bigint, passes bigint, whole bigint, runs array<{RUN}>, bounds array<bigint>")
    out = docs.join(own.select(F.struct("*").alias("_of")), F.col("source").eqNullSafe(F.col("_of.of")), "left")
    block = F.pmod(_permuted(seed), F.col("_of.blocks"))
    at = F.struct(block.alias("block"), _permuted(seed).alias("h"), F.col("doc_id").cast("bigint").alias("id"))

    def end(run: Column, name: str) -> Column:
        return F.struct(run[f"{name}_block"].alias("block"), run[f"{name}_h"].alias("h"), run[f"{name}_id"].alias("id"))
    # An end of a block alone is the place before its first document.
    part = let(size, lambda words: F.exists("_of.runs", lambda run: (
        (~run["has_after"] | (at > end(run, "after"))) & (~run["has_upto"] | (at <= end(run, "upto")))
        & (run["limit"].isNull() | ((words > 0) & (words <= run["limit"]))))))
    turns = F.when(F.col("_of.passes") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_of.passes") - 1)).otherwise(F.array().cast("array<bigint>"))
    turns = F.concat(turns, F.when(part, F.array("_of.passes")).otherwise(F.array().cast("array<bigint>")))
    # What the last pass takes beyond the cut is dealt over its units.
    unit = F.transform(turns, lambda t: t * F.col("_of.blocks") + F.when(t < F.col("_of.passes"), block).otherwise(F.pmod(block, F.col("_of.whole") + 1)))
    return out.withColumn("_shards", F.transform(unit, lambda u: F.size(F.filter("_of.bounds", lambda b: b <= u))))


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``, written once as several passes read it."""
    return stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size_of(text_of()).alias("size")), "mix-sizes")


def taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, source, text, ...)``.

    Null texts have no words; the null source is a source of its own, the last. Sources without
    words have target 0. Rows that repeat an id are taken alike. No rows give no rows."""
    sized = sizes(docs)
    mixed = mix(sized, plan(sized, **options), F.col("size"), options.get("seed", SEED))
    return mixed.select("doc_id", "size", F.col("_of.size").alias("source_size"), F.col("_of.target").alias("target"),
                        (F.col("size") * F.size("_shards")).alias("taken"), F.col("_shards").alias("shards"))


def mixture(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """The mixed documents themselves, as often as they are taken: the columns of ``docs``, dealt by
    shard and shuffled within it. A shard of more than PIECE_WORDS words is dealt into random
    pieces, so that no task grows with the input. Column names with a leading underscore are kept free."""
    recipes = plan(sizes(docs), shards=shards, seed=seed, **options)
    pieces = max(1, -(-int(sum(r.target for r in recipes)) // (shards * PIECE_WORDS)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = mix(docs, recipes, size_of(text_of()), seed).select(*columns, F.posexplode("_shards").alias("_turn", "_shard"))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed + 1), "_turn", "doc_id"))
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64("_order"), F.lit(pieces)))
    return (rows.repartition(shards * pieces, "_shard", "_piece").sortWithinPartitions("_shard", "_piece", "_order", "doc_id")
            .select(*columns))
