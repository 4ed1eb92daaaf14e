"""Suffix arrays of a shard by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than the one after them; the leftmost smaller ones (LMS)
are sorted by their substrings, which an induction over the buckets does; equal substrings are told
apart by the suffix array of the string of their names; a second induction places all other suffixes.
An induction goes bucket by bucket, and within one all suffixes of the same step at once, so it is
linear in the shard but for the number of buckets.
"""

import numpy as np


def classified(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the shard is the least suffix."""
    n = len(s)
    rises = np.zeros(n, dtype=bool)
    if n > 1:
        change = np.flatnonzero(s[1:] != s[:-1])
        up = s[change + 1] > s[change]
        # each suffix goes the way of the next change at or after it; after the last one it falls
        following = np.searchsorted(change, np.arange(n))
        known = following < len(change)
        rises[known] = up[following[known]]
    return rises


def leftmost(rises: np.ndarray) -> np.ndarray:
    return np.flatnonzero(rises[1:] & ~rises[:-1]) + 1


def dealt(found: list, suffixes: np.ndarray, codes: np.ndarray):
    """Append the suffixes to the buckets of their codes, in order."""
    if not len(suffixes):
        return
    order = np.argsort(codes, kind="stable")
    codes, suffixes = codes[order], suffixes[order]
    cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    for code, part in zip(codes[np.concatenate([[0], cuts])].tolist(), np.split(suffixes, cuts), strict=True):
        found[code].append(part)


def swept(s, rises, buckets: range, falling: bool, seeds: list) -> list:
    """The suffixes of one type in each bucket, in the order of the sweep.

    `seeds[c]` are the suffixes of the other type in bucket c in sweep order; what stands before a placed
    suffix and is of the swept type is placed in turn, at once if it belongs to the same bucket.
    """
    found = [[] for _ in range(len(seeds))]
    if falling and len(s):
        found[int(s[-1])].append(np.array([len(s) - 1]))  # the suffix before the empty one
    done = [None] * len(seeds)
    for c in buckets:
        placed, wave = [], np.concatenate(found[c]) if found[c] else np.zeros(0, np.int64)
        while len(wave):
            placed.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(s[before] == c) & (rises[before] != falling)]
        done[c] = np.concatenate(placed) if placed else np.zeros(0, np.int64)
        other = np.asarray(seeds[c], np.int64)
        origin = np.concatenate([done[c], other])
        before = origin[origin > 0] - 1
        later = (s[before] > c) if falling else (s[before] < c)
        before = before[later & (rises[before] != falling)]
        dealt(found, before, s[before])
    return done


def induced(s: np.ndarray, rises: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array, given the LMS suffixes in order (or their substrings, to sort these)."""
    ups = [[] for _ in range(size)]
    dealt(ups, lms, s[lms])
    ups = [np.concatenate(u) if u else np.zeros(0, np.int64) for u in ups]
    larger = swept(s, rises, range(size), True, ups)
    smaller = swept(s, rises, range(size - 1, -1, -1), False, [x[::-1] for x in larger])
    parts = [p for c in range(size) for p in (larger[c], smaller[c][::-1])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def named(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A name for each LMS substring in text order: its rank among the distinct ones."""
    n = len(s)
    end = np.append(lms[1:], n)  # the last one runs to the end of the shard
    place = np.searchsorted(lms, ordered)
    length = (end - lms)[place]
    a, b = ordered[:-1], ordered[1:]
    same = (length[:-1] == length[1:]) & (np.maximum(a + length[:-1], b + length[1:]) < n)
    # equal length, so the closing LMS character is compared as well
    active, step = np.flatnonzero(same), 0
    while len(active):
        equal = s[a[active] + step] == s[b[active] + step]
        same[active[~equal]] = False
        active = active[equal]
        active = active[length[active] > step]
        step += 1
    names = np.zeros(len(lms), np.int64)
    names[place] = np.concatenate([[0], np.cumsum(~same)])
    return names


def doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string over a large alphabet, by doubling the compared prefix."""
    n, rank, width = len(names), names + 1, 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 2) + after
        order = np.argsort(key)
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(ranked[1:] != ranked[:-1])])
        if new[order[-1]] == n or width >= n:
            return order
        rank, width = new, 2 * width


SMALL_ALPHABET = 1 << 10


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `s` (small non-negative integers) in ascending order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    size = int(s.max()) + 1
    s = s.astype(np.uint16) if size <= 1 << 16 else s
    rises = classified(s)
    lms = leftmost(rises)
    if not len(lms):
        return induced(s, rises, lms, size)
    every = induced(s, rises, lms, size)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = every[is_lms[every]]
    names = named(s, lms, ordered)
    distinct = int(names.max()) + 1
    if distinct < len(lms):
        order = suffix_array(names) if distinct <= SMALL_ALPHABET else doubled(names)
        ordered = lms[order]
    return induced(s, rises, ordered, size)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, most: int, among: np.ndarray = None) -> np.ndarray:
    """For each suffix, in text order, the prefix it shares with the one before it in `order`, up to `most`.

    `s` holds values below 2^16. With `among` (a mask), only pairs of suffixes in it are compared.
    """
    n = len(s)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    packed = np.zeros(n + 3, np.uint64)
    packed[:n] = s
    packed = packed[:n] | packed[1 : n + 1] << np.uint64(16) | packed[2 : n + 2] << np.uint64(32) | packed[3:] << np.uint64(48)
    left, right = order[:-1], order[1:]
    if among is not None:
        both = among[left] & among[right]
        left, right = left[both], right[both]
    step = 0
    while len(left) and step < most:
        whole = np.maximum(left, right) + step + 4 <= n
        equal = np.zeros(len(left), dtype=bool)
        equal[whole] = packed[left[whole] + step] == packed[right[whole] + step]
        a, b = left[~equal], right[~equal]
        shared = np.full(len(a), step)
        same = np.ones(len(a), dtype=bool)
        for k in range(4):  # the first difference is among these
            same &= np.maximum(a, b) + step + k < n
            same[same] = s[a[same] + step + k] == s[b[same] + step + k]
            shared += same
        out[b] = np.minimum(shared, most)
        left, right = left[equal], right[equal]
        step += 4
    out[right] = most
    return out
