"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from emberlog.llm import bpe, compression, exact_dedup, graph, html_text, iblt, lcs, mixing, simhash, spans, urls, warc
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, keys string, component string, size string, digest string"
LONG = "A long line that goes on. " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null texts and ids, an empty text, copies, a long text; columns named like the operators' own."""
    texts = [(1, "One two three four. Five six!"), (2, None), (3, ""), (4, "One  two three\tfour. Five six!"), (5, LONG), (None, "nobody's text"),
             (7, LONG), (8, "İ ß 漢字 \u0085 \x1c x"), (8, "İ ß 漢字 \u0085 \x1c x")]
    return spark.createDataFrame([(i, t, None, None if i == 2 else "s", None, "f", "k", "c", "z", "d") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


PAGES = "page_id bigint, url string, html string, text string, path string, k1 string, verdict string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, None, None), (2, "no host", ""), (3, "http://a.b/x", "<p>one</p><p>two"), (4, "http://a.b/x", "<p>one</p><p>three"),
            (4, "http://a.b/x", "<p>one</p><p>three"), (None, "http://a.b/y\r\nX: 1", "<article>" + "<p>w</p>" * 3000)]
    return spark.createDataFrame([(*r, "t", "p", "k", "v") for r in rows], PAGES)


def test_bpe(spark, odd, none):
    got = bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count() and all(r["ids"] == [] for r in got if r["doc_id"] in (2, 3))
    back = {(r[0], bytes(r[1])) for r in bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert back == {(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()}
    assert bpe.encode_digests(none, RANKS, public_tokenizers.PATTERN).collect() == []
    few = bpe.encode_digests(odd, RANKS, public_tokenizers.PATTERN, kept_words=1).collect()
    assert sorted(map(str, few)) == sorted(map(str, bpe.encode_digests(odd, RANKS, public_tokenizers.PATTERN).collect()))


def test_higher_order_fold_equals_the_other(spark):
    ranks = bpe.read_ranks(RANKS)
    words = [b"", b" ", b"a", b" the", b"thanedble", b"aaaaaaaaaaa", b"\xff\xfe\xfd", "öüberschön".encode(), b"    ", b"zzzqqq" * 20]
    got = {bytes(r["word"]): r["ids"] for r in bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word binary"), RANKS).collect()}
    assert got == {w: [ranks[w]] if w in ranks else [ranks[p] for p in bpe.fold_bytes(w, ranks)] for w in words}


def test_long_words_fold_alike():
    ranks, rng = bpe.read_ranks(RANKS), random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice(["th", "e", " ", "a", "aa", "ing", "\n"]) for _ in range(rng.randrange(1, 25))).encode()[:64]
        assert bpe.fold_bytes(word, ranks) == bpe._fold_long(word, ranks)


def test_exact_dedup(spark, odd, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(odd, files_per_batch=1).collect()}
    assert got == {(1, 1, 2, True), (4, 1, 2, False), (2, 2, 2, True), (3, 2, 2, False), (5, 5, 2, True), (7, 5, 2, False),
                   (None, None, 1, True), (8, 8, 2, True)}
    assert exact_dedup.deduplicate(none).collect() == []
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 2, 5, 8, 8]


def test_rows_go_by_id_and_text(spark):
    rows = [(3, "a"), (5, "a"), (5, "b"), (None, "a"), (None, "c")]
    got = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(3, "a"), (5, "b"), (None, "c")]))


def test_equal_digests_of_different_texts_are_told_apart(spark, odd):
    got = exact_dedup.deduplicate(odd.where("doc_id is not null"), digest=lambda t: F.lit("same")).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in got} == {(1, 1), (4, 1), (2, 2), (3, 2), (5, 5), (7, 5), (8, 8)}


def test_state_carries_over_batches(spark, tmp_path):
    rows = spark.range(40).select("id", F.lit("t").alias("text"), F.col("id").alias("doc_id"))
    got = exact_dedup.deduplicate(rows.repartition(5), files_per_batch=1).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(0, 40)} and sum(r["kept"] for r in got) == 1


def test_one_near_duplicate_stays_by_id_and_text(spark):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "zz yy xx ww vv uu"), (None, "a b c d e f"), (None, "nobody has this text"), (9, "k l m n"), (9, "K L M N"),
            (None, "n o o n e"), (None, "N O O N E")]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len([r for r in got if r[0] == 9]) == 1 and len([r for r in got if r[1].lower() == "n o o n e"]) == 1
    assert {r for r in got if r[0] != 9 and r[1].lower() != "n o o n e"} == {(3, "a b c d e f"), (5, "zz yy xx ww vv uu"), (None, "nobody has this text")}


def test_simhash(spark, odd, none):
    prints = simhash.fingerprints(odd)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.groups(prints).collect()}
    assert {(1, 1), (4, 1), (2, 2), (3, 2), (5, 5), (7, 5), (8, 8)} <= got
    assert simhash.groups(simhash.fingerprints(none)).collect() == []
    assert simhash.keep_one(odd).columns == odd.columns


def test_fingerprint_of_long_and_short_texts(monkeypatch):
    words = [f"w{i % 97}" for i in range(1000)]
    whole = simhash.fingerprint_of(" ".join(words))
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint_of(" ".join(words)) == whole
    assert simhash.fingerprint_of("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint_of(" \n") == 0


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_finds_every_pair(spark, budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(6)} | set(base) | {0, 1, 2 ** 64 - 1}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in near)
    got = sorted(tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp bigint"), budget).collect())
    mask = (1 << 64) - 1
    assert got == [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & mask).bit_count() <= budget]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 240)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    frame = spark.createDataFrame([*edges, (None, 1), (2, None)], "a bigint, b bigint")
    assert {tuple(r) for r in graph.components(frame).collect()} == {(x, find(x)) for x in root}
    assert graph.components(frame.where("false")).collect() == []


def test_spans(spark, odd, none):
    assert spans.deduplicate(none).collect() == []
    got = spans.deduplicate(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["text"] == "" and by_id[1]["text"] == "One two three four. Five six!"
    assert by_id[7]["text"] == "" and 0 < by_id[5]["n_removed"] < by_id[5]["n_sentences"]
    for text in ("", ".", "\n\n", "no end", " a. b!?  c\n", "x " * 100, LONG[:999]):
        assert "".join(spans.sentences(text)) == text


def test_a_passage_goes_and_its_surroundings_stay(spark):
    passage = " ".join(f"Word{i} with some more words here." for i in range(10))
    rows = [(i, f"Own start number {i} of this page. {passage} Own end number {i} of this page.") for i in range(50)]
    got = {r["doc_id"]: r["text"] for r in spans.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"Own start number {i} of this page. Own end number {i} of this page." for i in range(1, 50))


def test_passages_that_begin_and_end_within_sentences(spark):
    """Of every 50 words in a row that an earlier text has, at least 24 go; words of no such place stay."""
    rng = random.Random(7)

    def words(n, stops):
        return [f"w{rng.randrange(10 ** 9)}" + ("." if rng.random() < stops else "") for _ in range(n)]
    rows = []
    for k in range(60):
        passage = words(rng.randrange(50, 90), rng.choice([0, 0, 0.03, 0.1]))
        rows += [(2 * k + copy, " ".join(words(rng.randrange(40), 0.02) + passage + words(rng.randrange(40), 0.02))) for copy in range(2)]
    got = {r["doc_id"]: r["text"].split() for r in spans.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen = set()
    for doc_id, text in rows:
        own, left = text.split(), set(got[doc_id])  # words are all different but for the copies
        windows = [tuple(own[i:i + 50]) for i in range(len(own) - 49)]
        repeated = [w for w in windows if w in seen]
        assert (len(repeated) > 0) == bool(doc_id % 2)
        assert all(sum(x not in left for x in w) >= 24 for w in repeated)
        assert set(own) - left <= {x for d, t in rows if d < doc_id for x in t.split()}
        seen.update(windows)


def test_mixing(spark, odd, none):
    got = mixing.taken(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.taken(none).collect() == [] and mixing.mixture(none).columns == none.columns
    mixed = mixing.mixture(odd, shards=3)
    assert mixed.columns == odd.columns and mixed.count() == sum(len(r["shards"]) for r in got)


def test_each_source_meets_its_target(spark):
    """One document of far more words than the others, some repeated ids: what it would have brought is taken from others."""
    rows = [(i, "word " * (20_000 if i == 500 else 40 + i % 3), "long") for i in range(501)]
    rows += [(1000 + i, "word " * (i % 90), f"s{i % 2}") for i in range(400)] + [(2000, "word " * n, "s0") for n in (5, 70, 300)] + [(None, "word " * 9, "s1")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in range(2):
        taken, target, of, sizes = {}, {}, {}, {}
        for r in mixing.taken(docs, seed=seed, share=0.5, weights=(1,)).collect():
            of.setdefault(r["doc_id"], set()).add(len(r["shards"]))
            source = "long" if r["doc_id"] is not None and r["doc_id"] <= 500 else "s1" if r["doc_id"] is None else f"s{r['doc_id'] % 2}"
            taken[source] = taken.get(source, 0) + r["taken"]
            target[source] = r["target"]
            sizes[source] = sizes.get(source, 0) + r["size"]
        assert all(len(x) == 1 for x in of.values())
        for source in target:
            miss = target[source] - taken[source]
            assert 0 <= miss <= max(42, 0.001 * target[source]), (seed, source)
        assert mixing.mixture(docs, seed=seed, share=0.5, weights=(1,)).count() == sum(
            len(r["shards"]) for r in mixing.taken(docs, seed=seed, share=0.5, weights=(1,)).collect())


def test_targets_and_tree():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.targets([0, 4], [5, 2]) == [0.0, 6.0] and mixing.targets([], []) == []
    quotas = np.array([1000, 30, 0, 7])
    parts = mixing.split(quotas, 7, np.random.default_rng(1))
    assert parts.shape == (7, 4) and (parts.sum(axis=0) == quotas).all() and (parts >= 0).all()
    assert np.ptp(parts.sum(axis=1)) <= 3


def test_compression(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = compression.fit(odd, labels)
    got = compression.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert compression.fit(none, labels.where("false")).weights == ()
    assert compression.keep_good(odd, model).columns == odd.columns and compression.score(none, model).collect() == []


def test_iblt(spark, odd, none):
    got = iblt.fingerprints(odd).collect()
    assert len(got) == odd.count() and iblt.fingerprints(none).collect() == []
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] and by_id[5]["fingerprint"] == by_id[7]["fingerprint"]
    assert by_id[2]["near_next"] == 1.0 and by_id[2]["n_chars"] == 0
    alone = iblt.fingerprints(odd.where("doc_id = 1")).collect()[0]
    assert alone["near_next"] == 1.0


def test_sketches_that_fail_are_split(spark):
    lines = [[str(random.Random(k).random()) for k in range(s, s + 3000)] for s in (0, 1500)]
    rows = spark.createDataFrame([(1, "\n".join(lines[0] + ["x"] * 40)), (2, "\n".join(lines[1] + ["x"] * 5)), (900_000_000, "end")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in iblt.fingerprints(rows).collect()}
    assert got[1]["near_next"] == pytest.approx(1505 / (3000 + 40 + 1500)) and got[2]["near_next"] == 0.0


def test_html_text(spark, odd_pages):
    got = html_text.extract(odd_pages).collect()
    assert len(got) == odd_pages.count() and html_text.extract(odd_pages.where("false")).collect() == []
    texts = {(r["page_id"], r["text"]) for r in got}
    assert {(1, ""), (2, ""), (3, "two"), (None, "\n".join(["w"] * 3000))} <= texts
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_lines_of_a_page():
    page = """<!DOCTYPE html><title>t</title><script>if (a < b) "<p>no</p>"</script><header><h1>Site</h1></header>
      <nav><ul><li><a href=/>Home</a></ul></nav><div class="top ad-box">Buy</div><main><article><header><h2>Head &amp; line</h2></header>
      <p>One <b>two<br>three</b><p>Four&nbsp;five<div id=comments><p>me too</div><form><p>mail</form><aside>see also</aside>
      </article></main><div>loose</div><footer>&copy; us</footer><!-- <p>hidden</p> -->"""
    lines = html_text.lines_of(page)
    assert html_text.kept_lines(lines, None) == ["Head & line", "One two three", "Four five"]
    plain = html_text.lines_of("<div>Menu A</div><p>Own words<div>Imprint</div>")
    assert html_text.kept_lines(plain, [0, 2]) == ["Own words"] and html_text.kept_lines([], None) == []


def test_neighbours_share_menus(spark):
    rows = [(i, f"http://h.org/a/{i:04}", f"<div>Menu of the site</div><p>Story {i}</p><div>Imprint</div>") for i in range(60)]
    rows += [(100, "http://other.org/", "<div>Menu of the site</div><p>Alone</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}" for i in range(60)) and got[100] == "Menu of the site\nAlone"


def test_copies_keep_their_text(spark, odd_pages):
    assert [r["text"] for r in html_text.extract(odd_pages).collect() if r["page_id"] == 4] == ["three", "three"]
    rows = [(i, f"http://h.org/a/{i:04}", f"<div>Menu of the site</div><p>Story {i}</p><div>Imprint</div>") for i in range(20)]
    story = "<div>Menu of the site</div><p>Long story</p><p>More of it</p><div>Imprint</div>"
    rows += [(100 + i, f"http://h.org/a/0007/c?print={i}", story) for i in range(40)]
    rows += [(200 + i, f"http://h.org/a/0009/d?v={i}", story.replace("Long", "Other") + f"<footer>Printed {i}</footer>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert all(got[i] == f"Story {i}" for i in range(20))
    assert all(got[100 + i] == "Long story\nMore of it" for i in range(40))
    assert all(got[200 + i] == "Other story\nMore of it" for i in range(3))


def test_lines_that_a_site_repeats_inside_its_articles_go(spark):
    rows = [(i, f"http://h.org/a/{i:04}", f"<article><h1>Title {i}</h1><div class=xyz>Rate this text</div><p>Story {i}</p><p>As they said</p></article>"
             if i in (5, 6) else f"<article><h1>Title {i}</h1><div class=xyz>Rate this text</div><p>Story {i}</p></article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nStory {i}" + ("\nAs they said" if i in (5, 6) else "") for i in range(30)}


@pytest.mark.parametrize("cells", [4_000_000, 6])
def test_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(lcs, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got, rest = lcs.shared(a, b), iter(b)
        assert len(got) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in got)


def test_url_aliases(spark, odd_pages):
    rules = [("block", "bad.org", "/"), ("allow", "good.org", "/"), ("block", "x.org", "/p"), ("allow", "x.org", "/p/ok")]
    rows = [(1, "http://A.com/x?q=1#f", '<link rel="canonical" href="https://b.net/y">'), (2, "https://b.net/y", None),
            (3, "http://c.net/", '<meta http-equiv=refresh content="0; url=//sub.bad.org/k">'), (4, "http://d.net/", ""),
            (5, "http://e.net/", '<!-- <link rel=canonical href="http://bad.org/"> -->'), (6, "http://f.net/1", '<link href="2" rel="x CANONICAL">'),
            (7, "http://f.net/2", '<link rel=canonical href=http://bad.org/z>'), (8, "http://g.net/", '<link rel=canonical href=http://bad.org/g>'),
            (9, "http://good.org/", '<link rel=canonical href=http://g.net/>'), (10, "http://x.org/p/ok/1", ""), (11, "http://x.org/p/1", "")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), rules).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "block"),
                   7: (None, "block"), 8: (None, "allow"), 9: ("good.org/", "allow"), 10: ("x.org/p/ok", "allow"), 11: ("x.org/p", "block")}
    odd = urls.judge(odd_pages, rules).collect()
    assert len(odd) == odd_pages.count() and {(r["host"], r["path"]) for r in odd if r["page_id"] in (1, 2)} == {("", "")}
    assert urls.judge(odd_pages.where("false"), rules).collect() == []


def test_links_are_read_as_browsers_read_them(spark):
    """``(page's url, html, resource that the link leads to)``; resources are host, path and query."""
    def canonical(href):
        return f'<link rel="canonical" href="{href}">'
    cases = [
        ("http://a.net/x", '<base href="http://example.org/es/">' + canonical("1"), "example.org/es/1"),
        ("http://a.net/x/y", '<base target=_top><base href="../z/"><base href="http://no.org/">' + canonical("?q=1"), "a.net/z/?q=1"),
        ("http://a.net/x", canonical("http&#58;//example.org/es/1"), "example.org/es/1"),
        ("http://a.net/x", canonical("http&#x3A;&sol;&#47;example.org/&#233;&#128512;"), "example.org/\u00e9\U0001F600"),
        ("http://a.net/x", canonical("/p?a=1&amp;b=2&copy=3&ampx=4&#0;"), "a.net/p?a=1&b=2&copy=3&ampx=4"),
        ("http://a.net/x", canonical("/p?v=&amp;lt;"), "a.net/p?v=&lt;"),
        ("http://a.net/x/y/z", canonical("../../es/./1"), "a.net/es/1"),
        ("http://a.net/x/y/z", canonical("../../../../es/%2E%2e/"), "a.net/"),
        ("http://a.net/x/y/z", canonical(".."), "a.net/x/"),
        ("http://a.net/x/../y", canonical("/y"), None),
        ("http://a.net/x?a=/../b", canonical("/x?a=/../b#c"), None),
        ("http://a.net/x", canonical("#top"), None),
        ("http://a.net/x", canonical("mailto:a@b.org"), None),
        ("http://a.net/x", canonical(" \n/p\tq\n "), "a.net/pq"),
        ("http://a.net/x", canonical("\\\\example.org\\es?c=\\"), "example.org/es?c=\\"),
        ("http://a.net/x", '<meta http-equiv="refresh" content="0; url&#61;&#39;//b.org/n&#39;">', "b.org/n"),
        ("http://a.net/x", '<link rel="&#99;anonical" href="//b.org">', "b.org/"),
        ("http://a.net/x", "<!-- <base href='http://no.org/'> -->" + canonical("n"), "a.net/n"),
    ]
    rows = [(u.replace("a.net", f"a{i}.net"), h) for i, (u, h, _) in enumerate(cases)]
    got = {r["a"].split("/")[0]: r["b"] for r in urls.edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {f"a{i}.net": b.replace("a.net", f"a{i}.net") for i, (_, _, b) in enumerate(cases) if b}
    rules = [("block", "example.org", "/es/")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(cases[:1] + cases[2:3])], "page_id bigint, url string, html string")
    assert [r["verdict"] for r in urls.judge(pages, rules).collect()] == ["block", "block"]


def test_warc_round_trip(spark, odd_pages):
    got = sorted(warc.round_trip(spark, odd_pages).collect(), key=str)
    assert len(got) == odd_pages.count() and all(r["record_type"] == "response" for r in got)
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 2)} == {0}
    assert warc.round_trip(spark, odd_pages.where("false")).collect() == []
    copies = spark.createDataFrame([(i, f"u{i}", "x" * 100) for i in (5, 3, 9)] + [(1, "u", "x" * 99), (2, "u", "x" * 99)], "page_id bigint, url string, html string")
    assert {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(spark, copies).collect()} == {
        (3, "response", None, 100), (5, "revisit", 3, 100), (9, "revisit", 3, 100), (1, "response", None, 99), (2, "response", None, 99)}


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(spark, tmp_path, compress):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 500) for i in range(20)], "page_id bigint, url string, html string").coalesce(1)
    folder = str(tmp_path)
    files = warc.write_archives(pages, folder, compress=compress)
    name = files.first()["file"]
    whole = list(warc.salvage(pa.BufferReader((tmp_path / name).read_bytes())))
    assert len(whole) == 20 and all(problem is None for _, _, problem, _ in whole)
    raw = bytearray((tmp_path / name).read_bytes())
    hurt = {whole[3][0] + 40, (whole[7][0] + whole[7][1]) // 2, whole[8][0]}
    for place in hurt:
        raw[place] ^= 0x5A
    (tmp_path / name).write_bytes(raw[:whole[18][1] + 30])  # the last record is cut off
    got = warc.read_archives(files, folder).collect()
    lost = {whole[i][3]["page_id"] for i in (3, 7, 8, 19)}
    assert {r["page_id"] for r in got if r["problem"] is None} == set(range(20)) - lost
    gaps = sorted((r["start"], r["stop"]) for r in got if r["problem"])
    assert gaps == [(whole[3][0], whole[3][1]), (whole[7][0], whole[8][1]), (whole[19][0], whole[18][1] + 30)]
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in got if r["problem"] is None)


def test_pipeline(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in kept.collect()]
            assert len(texts) == len(set(texts))
        if name == "simhash_dedup":
            prints = [simhash.fingerprint_of(r["text"]) for r in kept.collect()]
            assert len(prints) == len(set(prints))
    got = corpus_pipeline.run(spark, sf)
    want = bpe.encode_digests(kept, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
