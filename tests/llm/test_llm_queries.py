"""Every query of the subpackage, over the smallest tables, against SQL or a brute-force version."""

import base64
import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import zlib
from emberlog.llm import queries, spans
from emberlog.llm.simhash import fingerprint_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    got = rows(spark, name)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert set(got[0]) == set(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want.fetchall())


def test_html_text(spark, con):
    import html
    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    got = rows(spark, "op1_html_text")
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if x == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_quality_on_held_out_rows(spark, con):
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    got = rows(spark, "op3_compression_quality")
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    right = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(right) >= 0.9 * len(right)


def test_bpe_against_the_library(spark, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc_id, text, _ in docs:
        ids = known.encode_ordinary(text)
        want[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op4_bpe")}
    assert got == want


def test_url_filter(spark, con):
    for r in rows(spark, "op5_url_filter"):
        url = con.execute("SELECT url FROM pages WHERE page_id = ?", [r["page_id"]]).fetchone()[0]
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        fits = [x for x in queries.URL_RULES if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r["host"], r["path"]) == (host.lower(), path)
        assert (r["rule"], r["verdict"]) == ((best[1] + best[2], best[0]) if best else (None, "allow"))


def test_iblt_likeness(spark, docs):
    def likeness(a, b):
        a, b = Counter(a.split("\n")), Counter(b.split("\n"))
        return sum((a & b).values()) / sum((a | b).values())
    got = {r["doc_id"]: r for r in rows(spark, "op6_iblt")}
    assert len({(r["fingerprint"]) for r in got.values()}) <= len({t for _, t, _ in docs})
    for i, (doc_id, text, _) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited, r = text[:len(text) - half] + after[:half], got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(likeness(text, edited)) and r["near_next"] == pytest.approx(likeness(text, after))


def test_sentence_spans(spark, docs):
    seen, gone = {}, {d: set() for d, _, _ in docs}
    for doc_id, text, _ in docs:
        for start, stop, *h, _ in sorted(spans.runs(text)):
            if seen.setdefault(tuple(h), (doc_id, start)) != (doc_id, start):
                gone[doc_id].update(range(start, stop))
    want = {d: "".join(s for i, s in enumerate(spans.sentences(t)) if i not in gone[d]) for d, t, _ in docs}
    got = rows(spark, "op7_sentence_spans")
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert any(r["n_removed"] for r in got)


def test_mixing_meets_its_targets(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op8_mixing")}
    again = {r["doc_id"]: r["taken"] for r in rows(spark, "op8_mixing")}
    size, taken, target = Counter(), Counter(), {}
    for doc_id, text, source in docs:
        r = got[doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and r["taken"] <= 2 * r["size"] and r["taken"] == again[doc_id]
        size[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert abs(sum(taken.values()) - sum(target.values())) < 0.1 * sum(target.values())
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    free = [s for s in size if target[s] < 2 * size[s] - 1e-6]
    assert len({round(target[s] / weights[s], 6) for s in free}) <= 1


def test_simhash_groups(spark, docs):
    prints = {d: fingerprint_of(t) for d, t, _ in docs}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op10_simhash")}
    assert got == {d: (format(prints[d], "016x"), find(d)) for d in prints}


def test_spelling_variants(spark, docs):
    upper = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n = Counter()
    for doc_id, text, _ in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    # Words one edit apart share a word or a gap that lost one code point.
    near = {w: set() for w in words}
    holes, cut = {}, {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), set()).add(w)
            cut.setdefault(w[:i] + w[i + 1:], set()).add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for longer in cut.get(w, ()):
            near[w].add(longer)
            near[longer].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    want = {(w, form[w], root(w), k, len(near[w]), words.get(form[w])) for w, k in words.items()}
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(spark, "op12_spelling")]
    assert len(got) == len(want) and set(got) == want and any(f for _, f, *_ in got)
