"""Texts of an Arrow batch as flat numpy arrays: bytes, words, shingles. Null texts are empty ones.

Work goes over rows of about PIECE bytes at a time, so memory follows PIECE or the longest single
text, not the batch.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x100000001B3


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x + STEP
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def filled(texts) -> pa.Array:
    """A text column without nulls, as one large_string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def flat(texts: pa.Array) -> tuple:
    """All bytes of a filled column, and the border of each text in them."""
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or borders[0] == borders[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[borders[0] : borders[-1]]
    return data, borders - borders[0]


def pieces(texts: pa.Array, size: int = PIECE):
    """(first row, rows as a filled column) of at most `size` bytes, or of one longer text."""
    _, borders = flat(texts)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(borders, borders[row] + size, "right")) - 1)
        yield row, texts.slice(row, last - row)
        row = last


def spans(data: np.ndarray, borders: np.ndarray) -> tuple:
    """Start, end and row of each word: a run of bytes other than blanks (0x20, 0x09-0x0D) in a text."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = SOLID[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[borders] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each non-empty, disjoint span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    terms = data[within + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    terms *= powers(int(sizes.max()))[within]
    return mixed(np.add.reduceat(terms, first) ^ (sizes.astype(np.uint64) << np.uint64(40)))


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int, whole: bool = True) -> tuple:
    """Hash and row of every `size` consecutive words; with `whole`, a shorter text gives its only one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    inside = np.ones(n, dtype=bool)
    for step in range(size):
        if step >= n:
            inside[:] = False
            break
        same = rows[step:] == rows[: n - step]
        total[: n - step] += np.where(same, mixed(words[step:] + np.uint64(step + 1)), np.uint64(0))
        inside[: n - step] &= same
        inside[n - step :] = False
    if whole:
        first = np.ones(n, dtype=bool)
        first[1:] = rows[1:] != rows[:-1]
        words_of = np.bincount(rows, minlength=int(rows[-1]) + 1)
        inside |= first & (words_of[rows] < size)
    return mixed(total[inside]), rows[inside]
