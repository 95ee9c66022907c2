"""Longest common subsequence of two lists of line hashes."""

from __future__ import annotations

import numpy as np

#: Cells up to which the bit rows of a comparison are kept; larger ones are halved first.
CELLS = 4_000_000


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``, in order."""
    out: list[int] = []
    known_a, known_b = set(a), set(b)
    _walk([(i, x) for i, x in enumerate(a) if x in known_b], [x for x in b if x in known_a], out)
    return sorted(out)


def _walk(a: list[tuple[int, int]], b: list[int], out: list[int]) -> None:
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < stop_a and start < stop_b and a[start][1] == b[start]:
        out.append(a[start][0])
        start += 1
    while stop_a > start and stop_b > start and a[stop_a - 1][1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
        out.append(a[stop_a][0])
    a, b = a[start:stop_a], b[start:stop_b]
    if not a or not b:
        return
    if len(a) == 1:
        if a[0][1] in b:
            out.append(a[0][0])
        return
    if len(a) * len(b) <= CELLS:
        _trace(a, b, _rows([x for _, x in a], b), out)
        return
    # Too large to keep all rows: find where a best alignment crosses the middle of a, and do both halves.
    middle = len(a) // 2
    head = _lengths([x for _, x in a[:middle]], b)
    tail = _lengths([x for _, x in reversed(a[middle:])], b[::-1])[::-1]
    cut = int(np.argmax(head + tail))
    _walk(a[:middle], b[:cut], out)
    _walk(a[middle:], b[cut:], out)


def _rows(a: list[int], b: list[int], keep: bool = True) -> list[int]:
    """Bit j of row i is 0 if b[j] makes the subsequence with a[:i+1] longer; all columns at a time."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row = _rows(a, b, keep=False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _trace(a: list[tuple[int, int]], b: list[int], rows: list[int], out: list[int]) -> None:
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(a[i][0])
