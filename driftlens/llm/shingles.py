"""Word shingles as hashes, and the aligned similarity of two shingle sequences."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import xxhash

#: Words of a shingle.
K = 5

_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), "u8", len(tokens))


def shingle_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """One hash for each run of k words; for fewer words one for them all, for none none."""
    n = len(hashes) - k + 1
    if n < 1:
        return shingle_hashes(hashes, len(hashes)) if len(hashes) else hashes
    out = hashes[:n].copy()
    for i in range(1, k):
        out = mix(out * _MULTIPLIER + hashes[i : i + n])
    return mix(out)


def lcs_at_least(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether the longest common subsequence has `need` elements or more, by alignment within a band.

    need bounds what may be left out, and so how far from the main diagonal an
    alignment can go: only matches in that band are looked at. Texts seldom repeat
    a shingle, so as a rule the matches are few and are chained one by one; where
    they are many, the band is filled as a table. Both give the same answer.
    """
    n, m = len(a), len(b)
    if need <= 0:
        return True
    if need > min(n, m):
        return False
    skip_a, skip_b = n - need, m - need  # elements of each that may stay without a partner
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    first, behind = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    # A step of the chain costs about as much as 64 cells of the table, a row of which costs 32 steps more.
    if int((behind - first).sum()) > n * (32 + (skip_a + skip_b) // 64):
        return _table_at_least(a, b, need)
    return _chain_at_least(order.tolist(), first.tolist(), behind.tolist(), skip_a, skip_b, need)


def _chain_at_least(order: list[int], first: list[int], behind: list[int], skip_a: int, skip_b: int, need: int) -> bool:
    """lcs_at_least over the matches alone: order[first[i]:behind[i]] are the places of a[i] in b, ascending."""
    ends: list[int] = []  # ends[k]: the earliest place in b where a chain of k + 1 matches can end
    spare = len(first) - need  # elements of a that may still stay out
    for i, (lo, hi) in enumerate(zip(first, behind, strict=True)):
        before = len(ends)
        for at in range(hi - 1, lo - 1, -1):  # the last place first, so that a[i] is used once
            j = order[at]
            if i - skip_a <= j <= i + skip_b:
                k = bisect_left(ends, j)
                if k == len(ends):
                    ends.append(j)
                else:
                    ends[k] = j
        if len(ends) == before:
            spare -= 1
            if spare < 0:
                return False
        elif len(ends) >= need:
            return True
    return False


def _table_at_least(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """lcs_at_least by a table that has the band of each row."""
    n, m = len(a), len(b)
    skip_a, skip_b = n - need, m - need
    width = skip_a + skip_b + 1
    # row[c] is the best for a[:i] and b[:j], j = i - skip_a + c
    padded = np.concatenate([np.zeros(skip_a, b.dtype), b, np.zeros(width + n, b.dtype)])
    inside = np.zeros(len(padded), bool)
    inside[skip_a : skip_a + m] = True
    row = np.zeros(width + 1, np.int32)
    for i in range(n):
        match = (padded[i : i + width] == a[i]) & inside[i : i + width]
        # from (i, j) by a match, or from (i, j + 1) by leaving a[i] out
        grown = np.maximum(row[:-1] + match, row[1:])
        row[:-1] = np.maximum.accumulate(grown)
        row[-1] = 0
        if row[-2] + (n - 1 - i) < need:
            return False
    return bool(row[:-1].max() >= need)


def similar(a: np.ndarray, b: np.ndarray, least: float = 0.8) -> bool:
    """Whether the shingles that an alignment pairs are `least` of all: pairs / (len(a) + len(b) - pairs).

    The alignment keeps the order of both texts, so this is the Jaccard
    similarity of the shingles as sequences.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return False
    need = int(np.ceil(least / (1 + least) * (n + m) - 1e-9))
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= head + tail
    if need <= 0:
        return True
    if need > min(len(a), len(b)):
        return False
    left, n_left = np.unique(a, return_counts=True)
    right, n_right = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if np.minimum(n_left[i], n_right[j]).sum() < need:
        return False
    return lcs_at_least(a, b, need)
