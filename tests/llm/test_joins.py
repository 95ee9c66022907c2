"""The set join, the spelling join and the hard negatives against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from emberlog.llm import decontam, hard_negatives, spans, spelling
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, shingle string, hit boolean, head int, w string, item_id int"
ITEMS = "item_id bigint, text string, window_id string, words string, doc_id int"


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item_id, other in items:
            x = words(other)
            for window_words in {tuple(x[i:i + window]) for i in range(max(1, len(x) - window + 1))} if x else ():
                k = len(window_words)
                for i in range(len(w) - k + 1):
                    if tuple(w[i:i + k]) == window_words:
                        hit.update(range(i, i + k))
                        names.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contaminated(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "s", True, 1, "w", 2) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "x", "y", 3) for r in items], ITEMS)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in decontam.decontaminate(d.repartition(3), i, **options).select(columns).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"window": 4, "shingle": 3}, {"window": 6, "shingle": 5, "block": 7}, {"window": 3, "shingle": 1}, {"window": 2, "shingle": 5}])
def test_decontamination(spark, monkeypatch, options):
    monkeypatch.setattr(decontam, "SENT_WINDOWS", 5 if "block" in options else 100_000)
    rng = random.Random(str(options))
    text = lambda n: "".join(rng.choice(["a", "B", "çÀ", "d1", "漢"]) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randrange(25))) for i in range(12)] + [(3, "a a a"), (None, text(30)), (5, None), (20, "..."), (21, "zz"), (22, "a b " * 40)]
    docs = [(i, text(rng.randrange(80))) for i in range(25)] + [(7, text(40)), (None, items[0][1]), (None, "a"), (50, None), (51, ""), (52, "!?"),
            (53, "zz"), (54, f"x {items[13][1]} y {items[13][1]}"), (54, f"x {items[13][1]} y {items[13][1]}"), (55, "a b " * 60)]
    want = brute(docs, items, options.get("window", 10))
    assert contaminated(spark, docs, items, **options) == want and any(r[5] for r in want)


def test_decontamination_of_nothing_and_of_much(spark):
    assert contaminated(spark, [], [(1, "a b")]) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert contaminated(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, 0, empty, False), (2, 0, 0, 0, empty, False)]
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"{i} start {passage} end") for i in range(300)] + [(1000, "long text " * 100_000 + passage)]
    got = {r[0]: r[2:4] for r in contaminated(spark, docs, [(i, passage) for i in range(20)])}
    assert set(got.values()) == {(30, 20)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("seed, key_pairs", [(0, 20_000_000), (1, 5), (2, 20_000_000)])
def test_words_one_edit_apart(spark, seed, key_pairs):
    rng = random.Random(seed)
    letters = "abé" if seed == 2 else "abcdefÿ"
    known = {"".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(250)} | {"aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab", "babababa"}
    for w in list(known)[:60]:
        i = rng.randrange(len(w))
        known |= {w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1:]}
    known = sorted(known)
    got = [(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in known], "word string, n bigint"), key_pairs).collect()]
    want = [(a, b) for a, b in itertools.combinations(known, 2) if one_edit(a, b)]
    assert len(got) == len(set(got)) and set(got) == set(want) and want


def test_pivots_are_the_cheapest_that_do_not_overlap():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 12)))
        grams = sorted({word[i:i + 2] for i in range(len(word) - 1)})
        ranks = {g: (r, rng.randrange(20)) for r, g in enumerate(grams)}
        places, last = spelling.prefix_of(word, ranks)
        assert all((ranks[word[i:i + 2]][0] <= last) == (i in places) for i in range(len(word) - 1)) and len(places) >= 3
        a, b = spelling.pivots_of(word, places, ranks)
        cost = lambda i: ranks[word[i:i + 2]][1]
        assert b - a >= 2 and cost(a) + cost(b) == min(cost(i) + cost(j) for i in places for j in places if j - i >= 2)


def test_spelling_of_odd_rows(spark):
    rows = [(1, None), (None, "Straßenbahn straßenbahn"), (2, ""), (3, "ÉCOLIERS éCOLIERS Écoliers " * 30), (3, "écolières écolières"), (3, "écolières écolières"), (4, "x" * 500_000 + " y"), (5, "漢字漢字漢字漢字")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    counts = {r["word"]: r["n"] for r in spelling.word_counts(docs, divisor=0).collect()}
    assert counts == {"straßenbahn": 2, "Écoliers": 60, "écoliers": 30, "écolières": 4}
    assert spelling.variants(spelling.word_counts(docs.where("false"))).collect() == []
    chain = spark.createDataFrame([("wordone", 2), ("wordonez", 20), ("wordonezz", 200), ("wordonezzz", 2000), ("wordonezzy", 2000), ("another", 5)], "word string, n bigint")
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variants(chain).collect()}
    assert got == {"wordone": ("wordonez", "wordonezzy", 1, 20), "wordonez": ("wordonezz", "wordonezzy", 2, 200), "wordonezz": ("wordonezzy", "wordonezzy", 3, 2000),
                   "wordonezzz": (None, "wordonezzz", 2, None), "wordonezzy": (None, "wordonezzy", 2, None), "another": (None, "another", 0, None)}


VECTORS = "vec_id bigint, embedding array<float>, label int, q string, key int, score int"


def hard(rows, is_anchor):
    ok = {(i, l, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, l in rows
          if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in ok:
        if not is_anchor(a[0]):
            continue
        other = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in ok if len(b[2]) == len(a[2]) and b != a]
        for p, pid, _ in sorted(x for x in other if x[2] == a[1] and x[1] != a[0])[:5]:
            fits = sorted(x for x in other if x[2] != a[1] and 50 * -p <= 100 * -x[0] <= 95 * -p)
            out += [(a[0], pid, k + 1, n[1], -p, -n[0]) for k, n in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("seed, dims, members, step, slice_components", [(0, 8, 4, 16, 10**6), (1, 3, 64, 7, 100), (2, 16, 8, 512, 10**6)])
def test_hard_negatives(spark, monkeypatch, seed, dims, members, step, slice_components):
    monkeypatch.setattr(hard_negatives, "MEMBERS", members)
    monkeypatch.setattr(hard_negatives, "STEP", step)
    monkeypatch.setattr(hard_negatives, "LIST_COMPONENTS", 50 * dims)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dims) + 2 * (rng.integers(3) == np.arange(dims) % 3)], int(rng.integers(4))) for i in range(300)]
    rows += [(i, rows[i % 7][1], int(rng.integers(4))) for i in range(300, 340)]  # ties
    rows += [rows[5], rows[10], (10, rows[11][1], 1), (None, rows[0][1], 1), (400, None, 1), (401, rows[0][1], None), (405, [float("nan")] * dims, 1), (410, [None] * dims, 1),
             (415, [float("inf")] * dims, 2), (420, [], 1), (421, [], 1), (422, [], 2), (425, [0.0] * dims, 1), (430, [1.0, 2.0], 1), (431, [1.0, 2.0], 1), (432, [0.8, 1.5], 2)]
    df = spark.createDataFrame([(*r, "q", 1, 2) for r in rows], VECTORS).repartition(3)
    got = hard_negatives.mine(hard_negatives.quantised(df), F.col("vec_id") % 5 == 0, slice_components=slice_components)
    assert sorted(tuple(r) for r in got.collect()) == hard(rows, lambda i: i % 5 == 0)
    assert hard_negatives.mine(hard_negatives.quantised(df.where("false")), F.lit(True)).collect() == []
    assert hard_negatives.mine(hard_negatives.quantised(df), F.lit(False)).collect() == []


def test_walks_end_before_the_list_and_large_numbers_are_exact():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12)) * 300
    q = np.floor(centres[rng.integers(20, size=4000)] + rng.normal(size=(4000, 12)) * 10).astype(np.int64)
    a = {"key": np.arange(100), "id": np.arange(100), "label": np.zeros(100, np.int64), "q": q[:100]}
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    s = hard_negatives.Searcher(a, hard_negatives.fit_centroids(q[:100].astype(float)), np.array([(i, least, most, 0) for i in range(100)], np.int64), 5, False)
    hard_negatives.STEP, step = 64, hard_negatives.STEP
    s.search(np.arange(4000), np.zeros(4000, np.int64), q)
    hard_negatives.STEP = step
    assert s.walked < 0.5 * s.listed
    big = rng.integers(2**29, size=(5, 4)) + 2**28
    assert (hard_negatives.inner(big, big) == big.astype(object) @ big.T.astype(object)).all()


def test_filter_of_repeated_runs(spark):
    rng = np.random.default_rng(1)
    inside, outside = (rng.integers(-2**63, 2**63 - 1, size=20_000) for _ in range(2))
    packed = spans._bloom(spark.createDataFrame([(int(h),) for h in inside], "h1 bigint"), len(inside))
    assert spans._passes(packed, inside).all() and spans._passes(packed, outside).mean() < 0.05
    assert spans._bloom(spark.createDataFrame([], "h1 bigint"), 0).sum() == 0


def test_sentences_are_counted_as_they_are_cut():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["word", "a", "thing", "漢字", ""]) + rng.choice([" ", "  ", " ", " ", ". ", "!", "\n", " x "]) for _ in range(rng.randrange(120)))
        known = spans._Hashes()
        assert spans._count(text, known) == len(spans.sentences(text, known)) == len(spans._pieces(text, known)[0])
