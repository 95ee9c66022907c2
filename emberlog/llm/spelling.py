"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams are ordered by rarity. A word's gram prefix are its three first bigrams in that order (and
those equal to the third). Two of them that do not overlap are its pivots, chosen by dynamic programming
for the least number of words that have them. One edit destroys at most one pivot. So of
two words one edit apart, take the one whose prefix ends first in the order: one of its pivots stands in the
other, and as it comes before the end of the other's prefix, it is in that prefix.

Position limits sharpen this. If the edit comes after the first pivot, both words begin alike up to
the end of that pivot; else it comes before the second pivot, and both end alike from its start. So
the first pivot is looked up with all that stands before it, the second with all that stands after it, and
either with the length of the other word. What meets is verified by edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import stored, text_of

#: Code points and occurrences a word needs.
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is so many times as frequent as its variant.
FORM_RATIO = 10
#: Grams in a prefix for one edit and grams of two characters: 2 * 1 + 1.
PREFIX = 3
#: Pairs that one key may bring to a task; keys with more are split.
KEY_PAIRS = 20_000_000

#: Letters of a word, and those that are lower-cased.
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SIGNS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("mask", pa.int64()),
                   ("pivots", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])
SIGNS_SQL = "word string, n bigint, last int, mask bigint, pivots array<bigint>, prefix array<bigint>"


def word_counts(docs: DataFrame, divisor: int = 31, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words in ``docs(doc_id, text)``: runs of letters with A-Z lower-cased.

    Where ``divisor`` divides the crc32 of ``<doc_id>:<run>``, the run loses one code point, which the
    same number chooses (a stated way to plant misspellings; 0: none). Null texts have no words; a
    null id is read as empty."""
    run = F.translate("run", UPPER, LOWER)
    own = (docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split(text_of(), NOT_LETTERS, -1)).alias("run"))
           .where(F.char_length("run") >= min_length).select("id", run.alias("run")))
    word = F.col("run")
    if divisor:
        own = own.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        cut = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % divisor == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.char_length("run")))).otherwise(word)
    return (own.select(word.alias("word")).where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank in the order of rarity and number of places of every bigram. There are at most 90 letters
    and so 8100 bigrams, however many words."""
    last = F.char_length("word") - 1
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: (rank, r["n"]) for rank, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"])))}


def prefix_of(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], int]:
    """Places of the grams of the prefix, and the rank of its last gram."""
    order = [ranks[word[i:i + 2]][0] for i in range(len(word) - 1)]
    last = sorted(order)[min(PREFIX, len(order)) - 1]
    return [i for i, rank in enumerate(order) if rank <= last], last


def pivots_of(word: str, places: list[int], ranks: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """Two places of the prefix, at least two apart, with the least sum of occurrences; the first of equals.

    ``best[k]`` is the cheapest single gram that ends before a place, carried from left to right."""
    cheapest, waiting, best = None, [], None
    for i in places:
        while waiting and waiting[0][1] <= i - 2:
            one = waiting.pop(0)
            cheapest = one if cheapest is None or one < cheapest else cheapest
        cost = ranks[word[i:i + 2]][1]
        if cheapest is not None and (best is None or (cheapest[0] + cost, cheapest[1], i) < best):
            best = (cheapest[0] + cost, cheapest[1], i)
        waiting.append((cost, i))
    return best[1], best[2]


def _key(side: str, text: str, length: int) -> int:
    h = xxhash.xxh3_64_intdigest(f"{side}{length}:{text}".encode())
    return h - (1 << 64) if h >> 63 else h


def signature(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[int, int, list[int], list[int]]:
    """(last rank, mask of letters, keys under which pivots look, keys under which the prefix is found)."""
    places, last = prefix_of(word, ranks)
    first, second = pivots_of(word, places, ranks)
    mask, n = 0, len(word)
    for c in word:
        mask |= 1 << ord(c) % 64
    looks = [_key(side, text, n + d) for side, text in (("<", word[:first + 2]), (">", word[second:])) for d in (-1, 0, 1)]
    found = [_key("<", word[:i + 2], n) for i in places] + [_key(">", word[i:], n) for i in places]
    return last, mask - (1 << 64) if mask >> 63 else mask, looks, found


def signatures(words: DataFrame, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """The signature of every row of ``words(word, n)``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [signature(w, ranks) for w in batch.column(0).to_pylist()]
            columns = list(zip(*signs, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1),
                                              *(pa.array(c, f.type) for c, f in zip(columns, list(SIGNS)[2:], strict=True))], schema=SIGNS)
    return words.select("word", "n").mapInArrow(emit, SIGNS_SQL)


def near_pairs(words: DataFrame, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """``a, a_n, b, b_n``, ``a < b``: every pair of ``words(word, n)`` at edit distance one, once.

    Words are different, of at least four code points. A key that would bring over ``key_pairs`` pairs
    to one task is dealt out: lookers to parts, found words to all parts of it."""
    signs = stored(signatures(words, gram_ranks(words)), "spelling-signs")

    def side(name: str, keys: str) -> DataFrame:
        return signs.select(F.explode(keys).alias("key"), *(F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "last", "mask")))

    looks, found = side("s", "pivots"), side("r", "prefix")
    sizes = looks.groupBy("key").agg(F.count(F.lit(1)).alias("n_s")).join(found.groupBy("key").agg(F.count(F.lit(1)).alias("n_r")), "key")
    # Keys with so many pairs are few: the pairs that are looked at anyhow, divided by that number.
    crowded = stored(sizes.where(F.col("n_s") * F.col("n_r") > key_pairs)
                     .select("key", F.ceil(F.col("n_s") * F.col("n_r") / key_pairs).cast("int").alias("parts")), "spelling-crowded")
    parts = F.coalesce("parts", F.lit(1))
    looks = looks.join(crowded, "key", "left").withColumn("part", F.pmod(F.hash("s_word"), parts)).drop("parts")
    found = found.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    # Cheap tests first: one edit changes at most two letters of the mask.
    met = looks.join(found, ["key", "part"]).where(
        (F.col("s_last") <= F.col("r_last")) & (F.bit_count(F.col("s_mask").bitwiseXOR(F.col("r_mask"))) <= 2)
        & (F.col("s_word") != F.col("r_word")) & (F.levenshtein("s_word", "r_word", 1) == 1))
    first = F.col("s_word") < F.col("r_word")

    def pick(c: str, low: bool) -> Column:
        return F.when(first == F.lit(low), F.col(f"s_{c}")).otherwise(F.col(f"r_{c}"))
    return met.select(pick("word", True).alias("a"), pick("n", True).alias("a_n"), pick("word", False).alias("b"), pick("n", False).alias("b_n")).distinct()


def variants(words: DataFrame, ratio: int = FORM_RATIO, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words(word, n)``.

    The form is the near word of largest ``n`` (of equals the smallest), if that is at least
    ``ratio`` times the word's own; ``root`` follows forms to the last. A form is more frequent than its
    word by that factor, so forms make no circles, and chains have at most log(n) steps."""
    words = stored(words, "spelling-words")
    pairs = stored(near_pairs(words, key_pairs), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.max("n").alias("own"))
    has_form = -F.col("best.less") >= ratio * F.col("own")
    best = stored(best.select("word", "n_near", F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = best.where("form is not null").select("word", F.col("form").alias("root"))
    steps = math.log(max(words.agg(F.max("n")).first()[0] or 1, 1), ratio)
    for _ in range(math.ceil(math.log2(max(steps, 1))) + 1):  # each round doubles the steps followed
        roots = stored(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
                       .select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return (words.join(best, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"))
