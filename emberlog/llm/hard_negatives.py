"""Hard negatives by exact inner-product search with lists that clusters of anchors share.

Anchors are clustered by direction. For each cluster, the candidates that a task holds are sorted once
by an upper bound: a candidate at the angle ``t`` from the centroid can score with a member of a cluster of
radius ``r`` at most ``|candidate| * |member| * cos(max(0, t - r))``. Every member walks that list from the top and
stops where the bound shows that nothing below can enter its result any more. Members of a cluster
walk together, a step of the list at a time, so that scores are matrix products.

Anchors go to all tasks in slices of bounded size; candidates are neither moved nor gathered. A task
keeps what its anchors need over all the rows it reads and gives it out at its end; the short
lists of all tasks are merged by anchor. Two such passes are made: one for the positives, one for
the negatives in the range that each positive's score leaves open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.llm.common import stored
from emberlog.session import scratch_dir

POSITIVES = 5
NEGATIVES = 3
#: A negative scores at least and at most these hundredths of the positive.
LOW, HIGH = 50, 95
#: Vectors that are compared have their components in steps of this part of one.
SCALE = 256
#: Components of the anchors in a slice: 32 MB of 8-byte integers.
SLICE_COMPONENTS = 4_000_000
#: Anchors the centroids are fitted on (those of least hash), members a cluster has on average, and the most clusters.
SAMPLE, MEMBERS, CLUSTERS = 20_000, 64, 256
#: Candidates sorted at a time, in components, and candidates of a step of the walk.
LIST_COMPONENTS, STEP = 4_000_000, 512

FOUND = pa.schema([("anchor_key", pa.int64()), ("slot", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor_key bigint, slot bigint, id bigint, score bigint"


def quantised(rows: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, q, key`` of the rows that take part: id, label and vector present, all components
    finite. ``q`` are the components in whole steps; ``key`` tells rows apart; repeated rows are one."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ok)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("label") if label is None else label).cast("bigint").alias("label"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).cast("array<bigint>").alias("q"))
            .distinct().withColumn("key", F.xxhash64("vec_id", "label", "q")))


# ---- in the tasks -------------------------------------------------------------------------

def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: in floating point where all sums stay below 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(_norms(a).max()) * float(_norms(b).max())
    if bound < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if bound < 2.0**62 else (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def fit_centroids(vectors: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit vectors that vectors of a sample gather around; any are right, good ones make lists short."""
    lengths = _norms(vectors)
    unit = vectors[lengths > 0] / lengths[lengths > 0][:, None]
    k = max(1, min(CLUSTERS, len(vectors) // MEMBERS))
    if not len(unit):
        return np.zeros((1, vectors.shape[1]))
    centroids = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds if k > 1 else 0):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        size = _norms(sums)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centroids)
    return centroids


def _angles(unit_or_not: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    size = _norms(unit_or_not) * np.sqrt((centroid**2).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = np.where(size > 0, unit_or_not.astype(np.float64) @ centroid / size, 1.0)
    return np.arccos(np.clip(cos, -1, 1))


class Best:
    """The first ``k`` of each row's finds by score and then smaller id, and the score they end with."""

    def __init__(self, rows: int, k: int):
        self.k, self.kth = k, np.full(rows, np.iinfo(np.int64).min)
        self.row = self.score = self.id = np.empty(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(row):
            return
        row, score, id_ = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        keep = place < self.k
        self.row, self.score, self.id, place = row[keep], score[keep], id_[keep], place[keep]
        full = place == self.k - 1
        self.kth[self.row[full]] = self.score[full]


class Searcher:
    """Anchors of one dimension, by cluster, and what they have found so far.

    ``ranges`` gives each anchor's slots as rows of (anchor, low, high): a find has a score in that range
    and the anchor's own label, or another one if ``other``."""

    def __init__(self, anchors: dict[str, np.ndarray], centroids: np.ndarray, ranges: np.ndarray, k: int, other: bool):
        self.a, self.other, self.ranges = anchors, other, ranges
        self.best = Best(len(ranges), k)
        vectors = anchors["q"]
        self.size = _norms(vectors)
        unit = vectors / np.maximum(self.size, 1e-300)[:, None]
        nearest = (unit @ centroids.T).argmax(axis=1)
        self.clusters = []
        order = np.argsort(ranges[:, 0], kind="stable")
        first = np.searchsorted(ranges[order, 0], np.arange(len(vectors) + 1))
        for c in np.unique(nearest):
            members = np.flatnonzero(nearest == c)
            slots = np.concatenate([order[first[m]:first[m + 1]] for m in members])
            if len(slots):
                self.clusters.append((members, slots, np.searchsorted(members, ranges[slots, 0]), centroids[c], _angles(vectors[members], centroids[c]).max()))
        self.walked = self.listed = 0

    def search(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        sizes = _norms(vectors)
        for members, slots, member_of, centroid, radius in self.clusters:
            bound = sizes * np.cos(np.maximum(0.0, _angles(vectors, centroid) - radius))
            order = np.argsort(-bound, kind="stable")
            bound = bound[order]
            active = np.arange(len(slots))
            for start in range(0, len(order), STEP):
                # Rounding must never make a bound too small.
                top = self.size[members[member_of[active]]] * bound[start]
                top = top + np.abs(top) * 1e-9 + 1e-6
                own = slots[active]
                active = active[top >= np.maximum(self.best.kth[own], self.ranges[own, 1])]
                if not len(active):
                    break
                chunk = order[start:start + STEP]
                self._step(members, slots[active], member_of[active], ids[chunk], labels[chunk], vectors[chunk])
                self.walked += len(chunk) * len(active)
            self.listed += len(order) * len(slots)

    def _step(self, members, slots, member_of, ids, labels, vectors) -> None:
        rows, back = np.unique(member_of, return_inverse=True)
        at = members[rows]
        scores = inner(self.a["q"][at], vectors)
        same = self.a["label"][at][:, None] == labels[None, :]
        fits = ~same if self.other else same & (self.a["id"][at][:, None] != ids[None, :])
        scores, fits = scores[back], fits[back]
        low = np.maximum(self.best.kth[slots], self.ranges[slots, 1])
        i, j = np.nonzero(fits & (scores >= low[:, None]) & (scores <= self.ranges[slots, 2][:, None]))
        self.best.add(slots[i], scores[i, j], ids[j])


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _search_all(slices: dict[int, tuple], k: int, other: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass of one slice: ``slices`` has anchors, centroids and ranges by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = {d: Searcher(*s, k, other) for d, s in slices.items()}
        waiting: dict[int, list] = {d: [] for d in slices}

        def walk(d: int) -> None:
            parts, waiting[d] = waiting[d], []
            if parts:
                searchers[d].search(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy()) if len(batch) else np.empty(0, int)
            for d in map(int, np.unique(sizes)):
                if d in slices:
                    own = batch.filter(pa.array(sizes == d))
                    waiting[d].append((own.column(0).to_numpy(), own.column(1).to_numpy(), _matrix(own.column(2), d)))
                    if sum(len(x[0]) for x in waiting[d]) * max(d, 1) >= LIST_COMPONENTS:
                        walk(d)
        for d, s in searchers.items():
            walk(d)
            at = s.ranges[s.best.row, 0]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (s.a["key"][at], s.ranges[s.best.row, 3], s.best.id, s.best.score)], schema=FOUND)
    return run


# ---- on Spark -----------------------------------------------------------------------------

def _slice(anchors: DataFrame, sample: dict[int, np.ndarray], ranged: bool) -> dict[int, tuple]:
    """The anchors of one slice by dimension, with centroids and ranges. Bounded by SLICE_COMPONENTS."""
    rows = anchors.toArrow()
    sizes = np.array([len(x) for x in rows["q"]], int)
    out = {}
    for d in map(int, np.unique(sizes)):
        own = rows.filter(pa.array(sizes == d)).combine_chunks()
        q = np.array(own["q"].to_pylist(), np.int64).reshape(len(own), d)
        a = {"key": own["key"].to_numpy(), "id": own["vec_id"].to_numpy(), "label": own["label"].to_numpy(), "q": q}
        if ranged:  # the slot is the positive's score
            ranges = [(i, -(-LOW * p // 100), HIGH * p // 100, p) for i, scores in enumerate(own["scores"].to_pylist()) for p in scores]
        else:
            least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            ranges = [(i, least, most, 0) for i in range(len(q))]
        out[d] = (a, sample[d], np.array(ranges, np.int64).reshape(-1, 4))
    return out


def _pass(candidates: DataFrame, anchors: DataFrame, n_slices: int, sample: dict, k: int, other: bool, ranged: bool, name: str) -> DataFrame:
    """The first ``k`` finds by anchor and slot over all candidates, slice by slice of the anchors."""
    spark = candidates.sparkSession
    path = scratch_dir(spark, name)
    for i in range(n_slices):
        part = anchors.where(F.pmod("key", F.lit(n_slices)) == i) if n_slices > 1 else anchors
        found = candidates.select("vec_id", "label", "q").mapInArrow(_search_all(_slice(part, sample, ranged), k, other), FOUND_SQL)
        found.write.mode("append").parquet(path)
    best = Window.partitionBy("anchor_key", "slot").orderBy(F.desc("score"), "id")
    return spark.read.schema(FOUND_SQL).parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _centroids(anchors: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by dimension, fitted on a bounded sample; a dimension outside the sample has one cluster."""
    dims = [r[0] for r in anchors.select(F.size("q")).distinct().collect()]
    rows = anchors.orderBy("key").limit(SAMPLE).select("q").collect()
    out = {}
    for d in dims:
        own = [r["q"] for r in rows if len(r["q"]) == d]
        out[d] = fit_centroids(np.array(own, np.float64)) if own and d else np.zeros((1, d))
    return out


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         slice_components: int = SLICE_COMPONENTS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``rows`` of
    :func:`quantised`, of which those of ``is_anchor`` ask.

    An anchor's positives are the first ``positives`` other rows (by id) of its label by inner product,
    ties by smaller id; for each, the first ``negatives`` rows of other labels that score within LOW and HIGH
    hundredths of the positive. Nothing is approximate. Only vectors of the same length are compared; empty
    ones score 0. Scores have to fit a long. An id on several different rows asks and is found once
    for each. No anchors or no candidates give no rows."""
    candidates = stored(rows, "negatives-rows")
    anchors = stored(candidates.where(is_anchor), "negatives-anchors")
    total = anchors.agg(F.sum(F.size("q") + 4)).first()[0] or 0
    n_slices = max(1, -(-total // slice_components))
    sample = _centroids(anchors)
    found = stored(_pass(candidates, anchors, n_slices, sample, positives, False, False, "negatives-near"), "negatives-positives")
    scores = found.groupBy(F.col("anchor_key").alias("key")).agg(F.sort_array(F.collect_set("score"), False).alias("scores"))
    asking = stored(anchors.join(scores, "key"), "negatives-asking")
    hard = _pass(candidates, asking, n_slices, sample, negatives, True, True, "negatives-far")
    hard = hard.select("anchor_key", F.col("slot").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = found.join(anchors.select(F.col("key").alias("anchor_key"), F.col("vec_id").alias("anchor_id")), "anchor_key")
    near = near.select("anchor_key", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(hard, ["anchor_key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
