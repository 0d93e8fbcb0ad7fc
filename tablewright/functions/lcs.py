"""Longest common subsequence lengths for many string pairs at once.

Bit-parallel recurrence (Hyyro 2004) over numpy vectors: one 64-bit word per
pair.  Longer strings use Python integers as arbitrarily wide words.
"""

from __future__ import annotations

import numpy as np

from ..session import ship_with_tasks

ship_with_tasks(__name__)


def _codes(strings, width: int, fill: int) -> np.ndarray:
    joined = "".join(s.ljust(width, "\0") for s in strings)
    out = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).reshape(len(strings), width).copy()
    lengths = np.array([len(s) for s in strings])
    out[np.arange(width)[None, :] >= lengths[:, None]] = fill
    return out


def _wide(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def lcs_lengths(left, right, chunk: int = 4096) -> np.ndarray:
    """LCS length of left[i] and right[i] for every i."""
    left, right = list(left), list(right)
    out = np.zeros(len(left), dtype=np.int32)
    narrow = []
    for i, (a, b) in enumerate(zip(left, right)):
        if len(a) > len(b):
            left[i], right[i] = a, b = b, a
        if len(a) <= 64:
            narrow.append(i)
        else:
            out[i] = _wide(a, b)
    for start in range(0, len(narrow), chunk):
        rows = narrow[start:start + chunk]
        a = [left[i] for i in rows]
        b = [right[i] for i in rows]
        m, n = max(map(len, a)), max(map(len, b))
        if m == 0:
            continue
        # Different fillers never match each other or a real character.
        ca, cb = _codes(a, m, 0xFFFFFFFE), _codes(b, n, 0xFFFFFFFF)
        bits = np.left_shift(np.uint64(1), np.arange(m, dtype=np.uint64))
        s = np.full(len(rows), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j in range(n):
            match = np.where(ca == cb[:, j:j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            u = s & match
            s = (s + u) | (s - u)
        out[rows] = np.bitwise_count(~s)
    return out
