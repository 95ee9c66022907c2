"""Byte-level BPE encoding and decoding by a published rank file.

Texts are split into words by a pattern; the bytes of each word start as single tokens, and the
neighbours whose joined piece has the lowest rank are merged until no rank is left. Decoding
joins the binary pieces that the ids stand for.

The fold over ranked merges exists twice. :func:`encode_words` writes it with higher-order
functions over the byte arrays of a table of distinct words, looking up each pair in a literal
rank map. :func:`encode` and :func:`encode_digests` do the same fold inside the tasks that read
the documents, once for each distinct word that a task meets: bringing the words of a table back
to their places in the documents would shuffle several times the input (see the README).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import let, text_of

#: Distinct words whose ids a task keeps before it starts anew; bounds its memory, not its results.
KEPT_WORDS = 400_000
#: Buckets of the rank map; a few pairs fall into each.
BUCKETS = 1 << 17
#: Mixes the left id of a pair into its bucket.
MIX = 40_503

#: A pair is packed as its rank above its left token; this rank means that no piece is made.
TOKEN_BITS = 17
NO_RANK = 1 << 20

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Piece to rank, as the file lists them."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


@lru_cache(maxsize=2)
def _rank_map_text(path: str) -> str:
    """Buckets of (pair key, merged rank) as JSON: every split of a piece into two other pieces."""
    ranks = read_ranks(path)
    keys: list[list[int]] = [[] for _ in range(BUCKETS)]
    values: list[list[int]] = [[] for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                at = (left * MIX + right) % BUCKETS
                keys[at].append(left << 32 | right)
                values[at].append(rank)
    return "[" + ",".join(f'{{"k":{k},"v":{v}}}' for k, v in zip(keys, values, strict=True)).replace(" ", "") + "]"


def rank_map(path: str) -> Column:
    """The merges as a literal array of buckets."""
    return F.from_json(F.lit(_rank_map_text(path)), "array<struct<k:array<bigint>,v:array<bigint>>>")


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _token(packed: Column) -> Column:
    return packed.bitwiseAND(_big((1 << TOKEN_BITS) - 1))


def _pack(ranks: Column, left: Column, right: Column) -> Column:
    """The left of two neighbours, below the rank of the piece that they make."""
    def found(bucket: Column) -> Column:
        place = F.array_position(bucket["k"], F.shiftleft(left, 32) + right) - _big(1)
        return F.shiftleft(F.coalesce(F.get(bucket["v"], place), _big(NO_RANK)), TOKEN_BITS) + left
    return let(F.get(ranks, (left * _big(MIX) + right).bitwiseAND(_big(BUCKETS - 1))), found)


def merge_bytes(tokens: Column, ranks: Column) -> Column:
    """Fold the ranked merges over an array of byte tokens: the lowest rank first, the leftmost of equals.

    The state is one packed number per token: the rank of the pair that it opens, and the token.
    A merge replaces two of them and works out only the two pairs that it touches. An array of n
    tokens needs n - 1 merges at most. Empty arrays stay empty."""
    n = F.size(tokens)
    start = F.concat(
        F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: _pack(ranks, a, b)),
        F.array(F.get(tokens, n - 1) + _big(NO_RANK << TOKEN_BITS)))

    def merged(s: Column, rank: Column, p: Column) -> Column:
        left, right = _token(F.get(s, p - _big(2))), _token(F.get(s, p + _big(1)))
        before = F.when(p > 1, F.concat(F.slice(s, F.lit(1), (p - 2).cast("int")), F.array(_pack(ranks, left, rank))))
        here = F.when(right.isNull(), rank + _big(NO_RANK << TOKEN_BITS)).otherwise(_pack(ranks, rank, right))
        return F.concat(F.coalesce(before, F.array().cast("array<bigint>")), F.array(here), F.slice(s, (p + 2).cast("int"), n))

    def step(s: Column, _: Column) -> Column:
        def at(rank: Column) -> Column:
            place = F.array_position(F.transform(s, lambda x: F.shiftright(x, TOKEN_BITS)), rank)
            return F.when(rank >= NO_RANK, s).otherwise(let(place, lambda p: merged(s, rank, p)))
        return let(F.shiftright(F.array_min(s), TOKEN_BITS), at)

    folded = F.aggregate(F.sequence(F.lit(2), n), start, step, lambda s: F.transform(s, _token))
    return F.when(n > 1, folded).otherwise(tokens)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``word, ids`` of every distinct ``word`` (binary) by higher-order functions alone.

    A word that has a rank itself is one token; the empty word has none; null stays null."""
    single = F.from_json(F.lit("[" + ",".join(str(read_ranks(path)[bytes([b])]) for b in range(256)) + "]"), "array<bigint>")
    whole = words.sparkSession.createDataFrame(sorted(read_ranks(path).items()), "word binary, rank bigint")
    at = F.sequence(F.lit(1), F.octet_length("word"))
    tokens = F.when(F.octet_length("word") > 0, F.transform(at, lambda i: F.get(single, F.conv(
        F.hex(F.substring(F.col("word"), i, F.lit(1))), 16, 10).cast("int")))).otherwise(F.array().cast("array<bigint>"))
    known = words.select("word").distinct().join(whole, "word", "left")
    folded = let(rank_map(path), lambda ranks: merge_bytes(F.col("tokens"), ranks))
    ids = F.when(F.col("rank").isNotNull(), F.array("rank")).otherwise(folded)
    return known.withColumn("tokens", tokens).select("word", ids.alias("ids"))


class _Words(dict):
    """Word to its ids; a word not met before is folded and kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        raw, ranks = word.encode(), self.ranks
        ids = [ranks[raw]] if raw in ranks else [ranks[p] for p in fold_bytes(raw, ranks)]
        self[word] = ids
        return ids


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word: of all neighbours the pair of lowest rank, the leftmost of equals, is
    merged, until no pair has a rank. Long words keep their pairs in a heap."""
    if len(word) > 64:
        return _fold_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i:i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return parts


_NONE = 1 << 40


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same over a heap of (rank, start): n log n instead of n squared."""
    n = len(word)
    end = list(range(1, n + 1))          # of the piece that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))      # start of the piece to the left
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, middle, stop = heappop(heap)
        if end[i] != middle or middle >= n or end[middle] != stop:
            continue  # one of the two has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heappush(heap, (r, i, stop, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heappush(heap, (r, left, i, stop))
    out, i = [], 0
    while i < n:
        out.append(word[i:end[i]])
        i = end[i]
    return out


def _documents(path: str, pattern: str, out, schema: pa.Schema, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, words = regex.compile(pattern).findall, _Words(read_ranks(path))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = list(chain.from_iterable(map(words.__getitem__, find(text.as_py()))))
                rows.append((doc_id, *out(ids, path)))
                if len(words) > kept:
                    words.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def _digests(ids: list[int], path: str) -> tuple[int, str, str]:
    decoded = b"".join(map(_pieces(path).__getitem__, ids))
    written = " ".join(map(_written(path).__getitem__, ids))
    return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def _written(path: str) -> list[str]:
    return [str(i) for i in range(len(_pieces(path)))]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, kept_words: int = KEPT_WORDS) -> DataFrame:
    """``doc_id, ids array<int>`` of every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no ids. Repeated rows and equal or null ``doc_id`` give a row
    each; other columns are not looked at. ``path`` is a rank file, ``pattern`` splits texts."""
    return _rows(docs).mapInArrow(_documents(path, pattern, lambda ids, _: (ids,), ENCODED, kept_words), "doc_id bigint, ids array<int>")


def encode_digests(docs: DataFrame, path: str, pattern: str, kept_words: int = KEPT_WORDS) -> DataFrame:
    """As :func:`encode`, but ``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids and the
    bytes they decode to are hashed where they are made, and do not leave their task."""
    return _rows(docs).mapInArrow(_documents(path, pattern, _digests, DIGESTS, kept_words),
                                  "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded binary`` of ``encoded(doc_id, ids)``: the pieces of the ids, concatenated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            joined = [b"".join([pieces[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.binary())], ["doc_id", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")
