"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A sketch has a few cells. The digest of every paragraph goes into one cell of each third of them,
adding one to the cell's count, the digest to its XOR of keys and a hash of it to its XOR of
checks. Sketches of two versions subtract cell by cell, which leaves only what differs; a cell
with a count of plus or minus one and a matching check gives up its digest, that digest leaves its other
cells, and so on until all are empty. Sketches that do not empty are made anew with more
cells, and then with the digests split over several sketches, which split again as long as they fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.llm.common import let, stored, text_of

#: Cells of the fingerprint, and of the retries within a row and of split digests.
CELLS = 12
RETRIES = (48, 144)
SPLIT_CELLS = 72
#: Sketches that the digests of one that failed are split over.
SPLIT = 8
#: Digests up to which a pair is retried within its row.
ROW_KEYS = 220
#: Rounds of peeling; each empties every cell that is ready.
ROUNDS = 12
#: Documents that share a slice when each is put beside the next.
SLICE_DOCS = 500

NO_KEYS = "array<bigint>"


def _none() -> Column:
    return F.array().cast(NO_KEYS)


def keys_of(text: Column) -> Column:
    """Sorted digests of the paragraphs (lines), each with its number among equal ones, so that all are
    different. The empty text has one empty paragraph."""
    digests = F.array_sort(F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p)))

    def numbered(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def spread(b: Column) -> Column:
            counts = F.zip_with(b, F.slice(F.concat(b, F.array(F.size(s))), F.lit(2), F.size(b)), lambda a, z: F.struct(a.alias("a"), (z - a).alias("n")))
            return F.flatten(F.transform(counts, lambda c: F.transform(
                F.sequence(F.lit(0), c["n"] - 1), lambda k: F.xxhash64(F.get(s, c["a"]), k))))
        return let(starts, spread)
    return let(digests, numbered)


def _cell(key: Column, third: int, cells: int, seed: int) -> Column:
    """The cell of a key in a third of the sketch."""
    return (F.pmod(F.xxhash64(key, F.lit(3 * seed + third)), F.lit(cells // 3)) + third * (cells // 3)).cast("int")


def _check(key: Column) -> Column:
    return F.hash(key, F.lit(7)).cast("bigint")


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def sketch(keys: Column, cells: int, seed: int = 0) -> Column:
    """Cells ``n, key, check`` over an array of different keys."""
    places = F.transform(keys, lambda k: F.struct(k.alias("k"), *(_cell(k, t, cells, seed).alias(f"p{t}") for t in range(3))))

    def cell(p: Column, i: Column, third: int) -> Column:
        own = F.transform(F.filter(p, lambda x: x[f"p{third}"] == i), lambda x: x["k"])
        return let(own, lambda k: F.struct(F.size(k).alias("n"), _xor(k).alias("key"), _xor(F.transform(k, _check)).alias("check")))

    def third(p: Column, t: int) -> Column:
        width = cells // 3
        return F.transform(F.sequence(F.lit(t * width), F.lit((t + 1) * width - 1)), lambda i: cell(p, i, t))
    return let(places, lambda p: F.concat(*(third(p, t) for t in range(3))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"),
                                                 x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(difference: Column, cells: int, seed: int = 0) -> Column:
    """The digests that differ, as ``n`` (1: in the first, -1: in the second) and ``k``; null if the
    sketch does not empty."""
    def ready(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"])

    def rounds(state: Column, _: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(state["cells"], ready), lambda c: F.struct(
            c["n"].alias("n"), c["key"].alias("k"), *(_cell(c["key"], t, cells, seed).alias(f"p{t}") for t in range(3)))))

        def emptied(new: Column) -> Column:
            def left(c: Column, i: Column) -> Column:
                own = F.filter(new, lambda x: (x["p0"] == i) | (x["p1"] == i) | (x["p2"] == i))
                return let(own, lambda o: F.when(F.size(o) == 0, c).otherwise(F.struct(
                    (c["n"] - F.aggregate(o, F.lit(0), lambda s, x: s + x["n"])).alias("n"),
                    c["key"].bitwiseXOR(_xor(F.transform(o, lambda x: x["k"]))).alias("key"),
                    c["check"].bitwiseXOR(_xor(F.transform(o, lambda x: _check(x["k"])))).alias("check"))))
            return F.when(F.size(new) == 0, state).otherwise(F.struct(
                F.transform(state["cells"], left).alias("cells"),
                F.concat(state["found"], F.transform(new, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k")))).alias("found")))
        return let(found, emptied)

    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<n:int,k:bigint>>").alias("found"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, rounds)
    return let(end, lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0)), s["found"]))


def as_text(cells: Column) -> Column:
    """A sketch in hex, 28 digits a cell: 4 of the count, 16 of the keys, 8 of the checks."""
    def digits(value: Column, n: int) -> Column:
        return F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(n))
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(digits(c["n"], 4), digits(c["key"], 16), digits(c["check"], 8))), ""))


def _likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared digests over all digests of both."""
    return (a + b - differing) / (a + b + differing)


def _recovered(a: Column, b: Column, first: Column) -> Column:
    """Digests that differ between two key arrays, from the fingerprints' own difference or, if that
    does not empty, from the sketches with more cells; null where none does."""
    def anew(seed: int, cells: int) -> Column:
        made = peel(subtract(sketch(a, cells, seed), sketch(b, cells, seed)), cells, seed)
        return F.when(F.size(a) + F.size(b) <= ROW_KEYS, made)
    return F.size(F.coalesce(peel(first, CELLS), *(anew(seed, cells) for seed, cells in enumerate(RETRIES, 1))))


def differing(pairs: DataFrame, seed: int = 10) -> DataFrame:
    """``pair, n``: how many digests differ between the arrays ``a`` and ``b`` of ``pairs(pair, a, b)``.

    Digests are split over SPLIT sketches by their own bits; those sketches that do not empty are
    split again with other hashes, until all do."""
    done, todo, level = [], pairs.select("pair", F.lit(0).cast("bigint").alias("part"), "a", "b"), 0
    while True:
        sides = todo.select("pair", "part", F.explode(F.concat(
            F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(1).alias("side"))),
            F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(-1).alias("side"))))).alias("x"))
        part = F.col("part") * SPLIT + F.pmod(F.xxhash64("x.k", F.lit(1000 + level)), F.lit(SPLIT))
        parts = sides.groupBy("pair", part.alias("part")).agg(
            F.collect_list(F.when(F.col("x.side") == 1, F.col("x.k"))).alias("a"),
            F.collect_list(F.when(F.col("x.side") == -1, F.col("x.k"))).alias("b"))
        own = seed + level
        tried = stored(parts.select("pair", "part", "a", "b", F.size(peel(
            subtract(sketch(F.col("a"), SPLIT_CELLS, own), sketch(F.col("b"), SPLIT_CELLS, own)), SPLIT_CELLS, own)).alias("n")), "iblt-parts")
        done.append(tried.where("n is not null").select("pair", "n"))
        todo, level = tried.where("n is null").select("pair", "part", "a", "b"), level + 1
        if todo.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def beside_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, keys)`` with the text and keys of the next row by ``doc_id`` as ``next``; after the
    last comes the first. Rows without an id come first; rows of one id are in order of their texts.

    Rows are dealt into slices of the id's range. A slice's last row looks for its next in the
    first row of the slice after it, which comes out of the same shuffle."""
    bounds = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    width = max(1, -(-((bounds[1] or 0) - (bounds[0] or 0) + 1) * SLICE_DOCS // max(1, bounds[2])))
    # Rows without an id have a slice of their own, before the others.
    slice_of = F.coalesce(F.floor((F.col("doc_id") - F.lit(bounds[0] or 0)) / F.lit(width)).cast("bigint"), F.lit(-1))
    order = Window.partitionBy("slice").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = docs.select(slice_of.alias("slice"), "doc_id", "text", "keys")
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead(F.struct("text", "keys")).over(order))
    # Each slice and the one before it that has rows; there is one short row per slice.
    slices = docs.select(slice_of.alias("slice")).distinct()
    around = Window.partitionBy(F.lit(0)).orderBy("slice")
    before = slices.select("slice", F.lag("slice").over(around).alias("before"))
    last = slices.agg(F.max("slice")).first()[0]
    heads = (placed.where("at = 1").select("slice", F.struct("text", "keys").alias("head"))
             .join(before, "slice").select(F.coalesce("before", F.lit(last)).alias("slice"), "head"))
    joined = placed.join(heads.hint("shuffle_hash"), (placed["slice"] == heads["slice"]) & placed["next"].isNull(), "left")
    return joined.select("doc_id", "text", "keys", F.coalesce("next", "head").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every
    row of ``docs(doc_id, text, ...)``.

    Null texts are empty; the next document of a lone one is itself. Likeness counts paragraphs,
    repeated ones as often as they occur. Equal texts have equal fingerprints."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("keys", keys_of(F.col("text")))
    rows = beside_next(own).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "keys", keys_of(F.col("edited")).alias("edited_keys"), F.col("next.keys").alias("next_keys"))
    made = let(F.struct(sketch(F.col("keys"), CELLS).alias("own"), sketch(F.col("edited_keys"), CELLS).alias("edited"),
                        sketch(F.col("next_keys"), CELLS).alias("next")), lambda s: F.struct(
        as_text(s["own"]).alias("fingerprint"), as_text(s["edited"]).alias("edited_fingerprint"),
        _recovered(F.col("keys"), F.col("edited_keys"), subtract(s["own"], s["edited"])).alias("edited"),
        _recovered(F.col("keys"), F.col("next_keys"), subtract(s["own"], s["next"])).alias("next")))
    first = rows.select("*", made.alias("m"))
    none = _none()
    first = stored(first.select(
        "doc_id", "n_chars", "edited_sha256", "m.fingerprint", "m.edited_fingerprint", F.expr("uuid()").alias("row"),
        F.size("keys").alias("n"), F.size("edited_keys").alias("n_edited"), F.size("next_keys").alias("n_next"),
        F.col("m.edited").alias("d_edited"), F.col("m.next").alias("d_next"),
        F.when(F.col("m.edited").isNull() | F.col("m.next").isNull(), F.col("keys")).otherwise(none).alias("keys"),
        F.when(F.col("m.edited").isNull(), F.col("edited_keys")).otherwise(none).alias("edited_keys"),
        F.when(F.col("m.next").isNull(), F.col("next_keys")).otherwise(none).alias("next_keys")), "iblt-first")
    failed = [first.where(f"d_{v} is null").select(F.concat(F.lit(v), F.col("row")).alias("pair"), F.col("keys").alias("a"), F.col(f"{v}_keys").alias("b"))
              for v in ("edited", "next")]
    found = differing(failed[0].union(failed[1]))
    out = first
    for v in ("edited", "next"):
        more = found.where(F.col("pair").startswith(v)).select(F.substring("pair", len(v) + 1, 36).alias("row"), F.col("n").alias(f"more_{v}"))
        out = out.join(more, "row", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      *(_likeness(F.col("n"), F.col(f"n_{v}"), F.coalesce(f"d_{v}", f"more_{v}")).alias(f"near_{v}") for v in ("edited", "next")))
