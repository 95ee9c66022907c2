"""Substring deduplication by sliding sentence spans.

Every run of several consecutive sentences that just reaches a number of words is hashed, once
from each sentence forwards and once from each backwards, so that the runs inside a repeated
passage cover it to both ends. Long sentences are cut where their own words say, so a passage that
begins in the middle of one is cut like its copy. The hashes of all documents are joined; a run whose first
occurrence lies elsewhere has all its sentences removed. Counting is map-side combined and the
runs meet their group's first occurrence in a join, so a passage that a third of the
documents share is neither gathered in one task nor paired with itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from emberlog.llm.common import stored, text_of

#: A run has at least so many sentences and at least so many words.
RUN_SENTENCES = 2
RUN_WORDS = 24
#: A sentence of more words is cut into several, so that passages without full stops count too. No piece
#: has more words than this.
SENTENCE_WORDS = 12

#: Unicode's white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A sentence with the marks and the white space after it. Every character belongs to one.
SENTENCE = re.compile(rf"[^.!?\n]*+(?:[.!?\n]+[{SPACE}]*+|\Z)")
#: A word with the white space around it.
WORD = re.compile(rf"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+")
#: Sentences whose runs are made at a time; bounds a task's memory. The sentences of a text stay together.
AT_ONCE = 100_000
#: Number of repeated runs up to which a Bloom filter of them goes to all tasks (10 bits a run: 12.5 MB); it is no more than
#: a filter, what passes is joined. Beyond it, the filter is left out.
FILTERED_RUNS = 10_000_000

RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
                  ("again", pa.bool_())])
RUNS_SQL = "doc_id bigint, start int, stop int, h1 bigint, h2 bigint, again boolean"
CUT = pa.schema([("doc_id", pa.int64()), ("sizes", pa.list_(pa.int32())), ("hashes", pa.binary())])
CUT_SQL = "doc_id bigint, sizes array<int>, hashes binary"
FIRST = pa.schema([("h1", pa.int64()), ("doc_id", pa.int64()), ("again", pa.bool_())])
FIRST_SQL = "h1 bigint, doc_id bigint, again boolean"
#: Odd numbers that spread a hash over the places of a filter.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MASK = (1 << 64) - 1


class _Hashes:
    """Hashes of words. Hashing a word takes less time than looking it up, so none is kept."""

    @staticmethod
    def of(words: list[str]) -> list[int]:
        try:
            return list(map(xxhash.xxh3_64_intdigest, words))
        except UnicodeEncodeError:  # half of a surrogate pair
            return [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words]


def _ends(hashes: list[int]) -> list[int]:
    """Places after which a long sentence is cut, and its end: in every SENTENCE_WORDS words in a row, the last of those
    with the least hash. What lies around does not count, so all copies of a passage are cut at
    the same places, wherever their sentence begins."""
    out, n, at = [], len(hashes), -1
    for stop in range(SENTENCE_WORDS, n + 1):
        # The last of the least stays until it leaves the row or one as small comes in.
        if at < stop - SENTENCE_WORDS:
            own = hashes[stop - SENTENCE_WORDS:stop]
            at = stop - 1 - own[::-1].index(min(own))
            out.append(at)
        elif hashes[stop - 1] <= hashes[at]:
            at = stop - 1
            out.append(at)
    if at < n - 1:
        out.append(n - 1)
    return out


def sentences(text: str, known: _Hashes | None = None) -> list[str]:
    """The text cut after full stops, exclamation and question marks and line ends, sentences of more
    than SENTENCE_WORDS words also at places that their words choose. Joined, they are the text; an
    empty text has none."""
    known, out = _Hashes() if known is None else known, []
    for sentence in SENTENCE.findall(text):
        if len(sentence) > 2 * SENTENCE_WORDS and len(words := sentence.split()) > SENTENCE_WORDS:
            parts, start = WORD.findall(sentence), 0
            for end in _ends(known.of(words)):
                out.append("".join(parts[start:end + 1]))
                start = end + 1
        elif sentence:
            out.append(sentence)
    return out


def _count(text: str, known: _Hashes) -> int:
    """Number of :func:`sentences`, which are not made."""
    n = 0
    for sentence in SENTENCE.findall(text):
        if len(sentence) > 2 * SENTENCE_WORDS and len(words := sentence.split()) > SENTENCE_WORDS:
            n += len(_ends(known.of(words)))
        elif sentence:
            n += 1
    return n


def _pieces(text: str, known: _Hashes) -> tuple[list[int], bytes]:
    """Number of words of every sentence of :func:`sentences`, and the hashes of those that have words, 8 bytes each."""
    sizes, hashes = [], []
    for sentence in SENTENCE.findall(text):
        if not sentence:
            continue
        words = sentence.split()
        n = len(words)
        if n <= SENTENCE_WORDS or len(sentence) <= 2 * SENTENCE_WORDS:
            sizes.append(n)
            if n:
                hashes.append(xxhash.xxh3_64_digest(" ".join(words).encode("utf-8", "surrogatepass")))
            continue
        start = 0
        for end in _ends(known.of(words)):
            sizes.append(end + 1 - start)
            hashes.append(xxhash.xxh3_64_digest(" ".join(words[start:end + 1]).encode("utf-8", "surrogatepass")))
            start = end + 1
    return sizes, b"".join(hashes)


#: Odd numbers that mix the hashes of a run's sentences into its two.
MIXERS = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    """A one-to-one mixture of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(by)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _first_again(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether an earlier run of the same text has the same hashes; runs of a text are in order."""
    again = np.zeros(len(doc), bool)
    key = _mixed(h1 ^ _mixed(doc.astype(np.uint64) + np.uint64(1), MIXERS[0]), MIXERS[1])
    key_sorted = np.sort(key)
    twice = np.unique(key_sorted[1:][key_sorted[1:] == key_sorted[:-1]])
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        at = at[np.lexsort((at, h2[at], h1[at], doc[at]))]
        same = (doc[at[1:]] == doc[at[:-1]]) & (h1[at[1:]] == h1[at[:-1]]) & (h2[at[1:]] == h2[at[:-1]])
        again[at[1:][same]] = True
    return again


def _runs(sizes: np.ndarray, ends: np.ndarray, hashes: bytes) -> tuple[np.ndarray, ...]:
    """Text, start, stop, both hashes and ``again`` of every run of several texts, by text and place. ``sizes`` are the
    words of the sentences of all texts one after the other, ``ends`` the number of sentences up to the end of
    each text, ``hashes`` those of the sentences that have words."""
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    begin, end = (np.concatenate([[0], ends[:-1]]) if len(ends) else ends)[text], ends[text]
    at = np.arange(n)
    # From each sentence on, the first stop that has enough; and before each, the last start.
    stop = np.maximum(np.searchsorted(upto, upto[:-1] + RUN_WORDS), at + RUN_SENTENCES)
    on = stop <= end
    start = np.minimum(np.searchsorted(upto, upto[1:] - RUN_WORDS, side="right") - 1, at + 1 - RUN_SENTENCES)
    back = start >= begin
    back[back] = stop[start[back]] != at[back] + 1  # those that are not found forwards as well
    starts, stops = np.concatenate([at[on], start[back]]), np.concatenate([stop[on], at[back] + 1])
    order = np.argsort(starts * np.int64(n + 1) + stops)
    starts, stops = starts[order], stops[order]
    # The sentences with words of a run, one after the other; no more than RUN_WORDS have to be taken but for the ends.
    worded = np.concatenate([[0], np.cumsum(sizes > 0)])
    own, first, count = np.frombuffer(hashes, "<u8"), worded[starts], worded[stops] - worded[starts]
    h1, h2 = (_mixed(count.astype(np.uint64), m) for m in MIXERS)
    left, k = np.arange(len(starts)), 0
    while len(left := left[count[left] > k]):
        piece = own[first[left] + k]
        for h, m in ((h1, MIXERS[0]), (h2, MIXERS[1])):
            h[left] = _mixed(h[left] ^ piece, m) + piece
        k += 1
    which = text[starts] if n else starts
    return which, starts - begin[starts], stops - begin[starts], h1.view(np.int64), h2.view(np.int64), _first_again(which, h1, h2)


def runs(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(start, stop, h1, h2, again) of every run, in order; ``stop`` is exclusive, and ``again`` tells that
    the text has had the same run before. White space does not count. A run's hash is that of the hashes of its
    sentences, without those that have no word."""
    sizes, hashes = _pieces(text, _Hashes())
    found = _runs(np.array(sizes, np.int64), np.array([len(sizes)]), hashes)
    return list(zip(*(column.tolist() for column in found[1:]), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_pieces(text.as_py(), _Hashes()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], CUT.field(1).type), pa.array([r[1] for r in rows], pa.binary())], schema=CUT)


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Three places of every hash in a filter of so many bits."""
    h = h.astype(np.uint64)
    return [((h * np.uint64(m) >> np.uint64(20)) % np.uint64(size)).astype(np.int64) for m in SPREAD]


#: Bits of one of Spark's bitmaps.
BITMAP = 4096 * 8


def _bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of ``hashes(h1)``, ten bits a hash. The tasks make its pieces; only the filter is gathered."""
    size = max(1, -(-10 * n // BITMAP)) * BITMAP

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(batch.column(0).to_numpy(), size)) + 1, pa.int64())], ["place"])
    pieces = hashes.mapInArrow(places, "place bigint").groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in pieces.collect():
        out[(row["piece"] - 1) * 4096:row["piece"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([filter_[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1 for p in _bits(hashes, 8 * len(filter_))])


def _emit(schema: pa.Schema, packed: np.ndarray | None = None):
    """Runs of the cut texts as rows of ``schema``; with a filter, only those that pass it."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(batch.column(1).value_lengths().to_numpy(), dtype=np.int64)
            parts = np.flatnonzero(np.diff(upto // AT_ONCE)) + 1
            for first, last in zip([0, *parts], [*parts, len(upto)], strict=True):
                yield _batch(batch.slice(first, last - first), schema, packed)
    return of


def _batch(cut: pa.RecordBatch, schema: pa.Schema, packed: np.ndarray | None) -> pa.RecordBatch:
    ids, sizes, hashes = cut.columns
    text, start, stop, h1, h2, again = _runs(
        sizes.flatten().to_numpy(), np.cumsum(sizes.value_lengths().to_numpy(), dtype=np.int64), b"".join(hashes.to_pylist()))
    columns = {"start": start, "stop": stop, "h1": h1, "h2": h2, "again": again}
    if packed is not None:
        passes = _passes(packed, h1)
        text, columns = text[passes], {k: v[passes] for k, v in columns.items()}
    arrays = [ids.take(pa.array(text)) if f.name == "doc_id" else pa.array(columns[f.name]).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, start, stop`` of every run in ``docs(doc_id, text)`` that is not the first of its kind,
    by ``doc_id`` and place.

    Texts are cut once, into 8 bytes a sentence, which are written. A first pass over them finds the hashes that occur more than once, from 64 bits and the document alone, counted
    map-side. The second pass gives out only the runs that a filter of those hashes lets through, and joins
    them on 128 bits."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    own = stored(own.mapInArrow(_cut, CUT_SQL), "spans-cut")
    # Within a text the first place is known already; copies of one id are at the same place.
    firsts = own.mapInArrow(_emit(FIRST), FIRST_SQL).groupBy("h1").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("again").alias("again"), F.count(F.lit(1)).alias("n"))
    again = stored(firsts.where("n > 1 and (again or least <> most or least is null)").select("h1"), "spans-repeated")
    few = again.count()
    packed = _bloom(again, few) if few <= FILTERED_RUNS else None
    maybe = stored(own.mapInArrow(_emit(RUNS, packed), RUNS_SQL), "spans-runs")
    first = maybe.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return maybe.join(first, ["h1", "h2"]).where("again or doc_id > first").select("doc_id", "start", "stop")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()),
                            T.StructField("n_removed", T.LongType())]))
def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    # Texts that lose nothing stay where they are: null stands for them.
    rows, known = [], _Hashes()
    for text, own in zip(texts, spans, strict=True):
        if own is None:
            rows.append((None, _count(text, known), 0))
            continue
        parts = sentences(text, known)
        drop = set()
        for span in own:
            drop.update(range(span["start"], span["stop"]))
        rows.append(("".join(p for i, p in enumerate(parts) if i not in drop) if drop else None, len(parts), len(drop)))
    return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` for every row of ``docs(doc_id, text, ...)``: the text
    without the sentences of any repeated run that is not the first.

    Null texts are empty, and empty texts stay. Runs that repeat within one text are removed from
    their second place on. Rows of one ``doc_id`` are taken for copies at the same place: what one
    loses, all lose, and none counts as a repeat of another. Rows without an id come first in order
    and lose nothing."""
    spans = repeated(docs).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    own = docs.select("doc_id", text_of().alias("text"))
    cleaned = own.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", _without("text", "spans").alias("r"))
    return cleaned.select("doc_id", F.coalesce("r.text", "text").alias("text"), "r.n_sentences", "r.n_removed")
