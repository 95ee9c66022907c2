"""Runs of many texts made together."""

import random

import numpy as np
import pyarrow as pa

from emberlog.llm import spans


def plain(sizes, own):
    """(start, stop, hashes of the sentences with words) of every run, by the definition."""
    upto, found = np.concatenate([[0], np.cumsum(sizes)]), set()
    for i in range(len(sizes)):
        forwards = [j for j in range(i + spans.RUN_SENTENCES, len(sizes) + 1) if upto[j] - upto[i] >= spans.RUN_WORDS]
        backwards = [j for j in range(i + 2 - spans.RUN_SENTENCES) if upto[i + 1] - upto[j] >= spans.RUN_WORDS]
        found |= {(i, j) for j in forwards[:1]} | {(j, i + 1) for j in backwards[-1:]}
    places = np.concatenate([[0], np.cumsum(np.array(sizes) > 0)]).astype(int)
    return [(a, b, own[8 * places[a]:8 * places[b]]) for a, b in sorted(found)]


def test_runs_are_hashed_together_not_one_call_each(monkeypatch):
    def refuse(*_):
        raise AssertionError("a call for one run")
    rng, words = random.Random(5), ["a", "bb.", "c!", "\n", "... ", "long", "words", "here"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(60)]
    line = "The same line of nine words, over and over.\n"
    texts = ["", "one two.", line * 12, *texts, line * 12, "x " * 500, "\n\n"]
    cut = [spans._pieces(t, spans._Hashes()) for t in texts]
    monkeypatch.setattr(spans.xxhash, "xxh3_128_intdigest", refuse)
    monkeypatch.setattr(spans, "AT_ONCE", 50, raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(cut))], pa.int64()), pa.array([c[0] for c in cut], spans.CUT.field(1).type),
                                        pa.array([c[1] for c in cut], pa.binary())], schema=spans.CUT)
    batches = list(spans._emit(spans.RUNS)([batch]))
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert len(batches) > 10
    want, hashes = [], {}
    for doc_id, (sizes, own) in zip(batch.column(0).to_pylist(), cut, strict=True):
        seen = set()
        for start, stop, key in plain(sizes, own):
            want.append((doc_id, start, stop, key, key in seen))
            seen.add(key)
    assert [(d, a, b, again) for d, a, b, _, _, again in got] == [(d, a, b, again) for d, a, b, _, again in want]
    assert any(again for *_, again in want)
    for (*_, h1, h2, _), (*_, key, _) in zip(got, want, strict=True):
        assert hashes.setdefault((h1, h2), key) == key
    assert len(hashes) == len({key for *_, key, _ in want})
