"""Quality by compression: a text is good if a dictionary of good texts packs it better than one of bad texts.

Two zstandard dictionaries are trained on a bounded sample of labelled text. A text is compressed
whole, block by block, under both; the difference of the two sizes over the text's own, and how far it
shrinks at all (words said over and over shrink to nothing under either), go through a
logistic curve fitted on other labelled rows, which makes them a probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from emberlog.llm.common import text_of

#: Labelled rows per class that the dictionaries are made from, and those that the curve is fitted on.
DICTIONARY_ROWS = 3000
CURVE_ROWS = 3000
#: Blocks of one sampled row that may enter a dictionary's training.
ROW_BLOCKS = 4
DICTIONARY_BYTES = 112 << 10
#: Bytes compressed at a time. Short blocks keep the dictionary in play throughout a long text.
BLOCK = 2048
LEVEL = 3
#: A row is predicted good from this score on.
THRESHOLD = 0.3
FOLDS = 5


def fold_of(doc_id: Column) -> Column:
    """The fold that an id belongs to; fold 0 is never learned from."""
    return F.crc32(doc_id.cast("string")) % FOLDS


@dataclass
class Model:
    """Dictionaries of good and bad text, and the curve: 1 / (1 + exp(-(bias + weights . features)))."""
    good: bytes
    bad: bytes
    bias: float
    weights: tuple[float, ...]


def blocks_of(raw: bytes) -> list[bytes]:
    return [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; of samples too few or too short to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def features(texts: pd.Series, model: Model) -> np.ndarray:
    """Of each text, over its bytes: bad size - good size, the mean of both sizes, and the square of the
    mean; an empty text counts as one that neither shrinks nor differs."""
    packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                                        write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    out = np.tile([0.0, 1.0, 1.0], (len(texts), 1))
    for i, text in enumerate(texts):
        raw = blocks_of(text.encode())
        if raw:
            good, bad = (sum(len(p.compress(b)) for b in raw) for p in packers)
            size = sum(map(len, raw))
            share = (good + bad) / (2 * size)
            out[i] = (bad - good) / size, share, share * share
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Bias and weights by Newton steps with a weak pull to zero; no weights without rows."""
    if not len(x):
        return 0.0, ()
    centre, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w, pull = np.zeros(a.shape[1]), np.diag([1e-6] + [1e-1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + pull, a.T @ (p - y) + pull @ w)
    weights = w[1:] / scale
    return float(w[0] - weights @ centre), tuple(weights.tolist())


def _sample(labels: DataFrame, quality: int, folds: list[int], rows: int) -> DataFrame:
    """So many ids of a class, by hash."""
    own = labels.where(F.col("quality") == quality).where(fold_of(F.col("doc_id")).isin(folds))
    return own.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, fold 0 left out.

    At most DICTIONARY_ROWS rows per class (folds 1 and 2) make the dictionaries, with ROW_BLOCKS
    blocks each, and CURVE_ROWS per class (folds 3 and 4) the curve; the classes count there as
    often as they occur among the labels. Null labels, ids and texts are left out."""
    labels = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    texts = docs.where("text is not null").select("doc_id", "text")

    def chosen(folds: list[int], rows: int) -> DataFrame:
        # At most 2 * rows ids: their bound is a parameter.
        ids = _sample(labels, 0, folds, rows).union(_sample(labels, 1, folds, rows))
        return texts.join(F.broadcast(ids), "doc_id")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, quality in zip(batch["doc_id"], batch["text"], batch["quality"], strict=True):
                raw = blocks_of(text.encode())
                picked = np.random.default_rng(doc_id & (2**63 - 1)).permutation(len(raw))[:ROW_BLOCKS]
                rows += [(quality, doc_id, raw[k]) for k in sorted(picked.tolist())]
            yield pd.DataFrame(rows, columns=["quality", "doc_id", "block"])

    blocks = chosen([1, 2], DICTIONARY_ROWS).mapInPandas(pieces, "quality int, doc_id bigint, block binary").collect()
    blocks.sort(key=lambda r: (r["doc_id"], r["block"]))
    good, bad = (dictionary([bytes(r["block"]) for r in blocks if r["quality"] == q]) for q in (1, 0))
    model = Model(good, bad, 0.0, ())
    curve = chosen([3, 4], CURVE_ROWS).select("quality", _features(model)("text").alias("x")).collect()
    counts = dict(labels.where(fold_of(F.col("doc_id")).isin([3, 4])).groupBy("quality").count().collect())
    x, y = (np.array([r[k] for r in sorted(curve)], float) for k in ("x", "quality"))
    model.bias, model.weights = fit_curve(x, y)
    # The sample holds the classes in other shares than the labels do: move the bias by the log of both ratios.
    if (y == 1).any() and (y == 0).any():
        model.bias += float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
    return model


def _features(model: Model):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(list(features(batch, model)))
    return run


def _scores(model: Model):
    @F.pandas_udf(T.DoubleType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            line = model.bias + (features(batch, model) @ np.array(model.weights) if model.weights else np.zeros(len(batch)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(line, -700, 700))))
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, ``score`` from 0 to 1 and ``predicted``; null texts count as empty,
    and an empty text has the score of one that does not shrink and that neither dictionary suits better."""
    scored = docs.withColumn("score", _scores(model)(text_of()))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are predicted good, with the columns they came with."""
    return docs.where(_scores(model)(text_of()) >= THRESHOLD)
