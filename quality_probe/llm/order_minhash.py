"""Document fingerprints by Order MinHash.

Every k-mer of a text (K bytes of its UTF-8 form) is numbered by how often it occurred before. The
numbered k-mers are hashed once and dealt to BINS bins; each bin keeps its KEEP least ones, puts them
back into text order and hashes the tuple. Two texts agree in a bin when they hold the same k-mers there
in the same order, so moved or edited parts lower the likeness, which a plain MinHash would not see.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.llm import words as W

K = 6
BINS = 64
KEEP = 2
CANDIDATES = 12  # a bin's share of the hash range shrinks with the text, to hold about so many k-mers
KMER_BITS = 30
ROW_BITS = 12
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def kmers(data: np.ndarray, borders: np.ndarray) -> tuple:
    """Hash (KMER_BITS), row and place in its text of every k-mer; a shorter text is one k-mer."""
    n = len(data)
    padded = np.zeros(n + K, np.uint64)
    padded[:n] = data
    packed = np.zeros(n, np.uint64)
    for step in range(K):
        packed |= padded[step : step + n] << np.uint64(8 * step)
    sizes = np.diff(borders)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - np.repeat(borders[:-1], sizes)
    left = np.repeat(borders[1:], sizes) - np.arange(n)
    good = left >= K
    short = (place == 0) & ~good
    if short.any():  # keep the bytes of this text only
        keep = left[short].astype(np.uint64) * np.uint64(8)
        packed[short] &= (np.uint64(1) << keep) - np.uint64(1)
        packed[short] |= left[short].astype(np.uint64) << np.uint64(56)
        good |= short
    return W.mixed(packed[good]) >> np.uint64(64 - KMER_BITS), row[good].astype(np.uint64), place[good].astype(np.uint64)


def piece_signatures(texts: pa.Array) -> np.ndarray:
    """(rows, BINS) uint16; 0 where a bin is empty. Rows are at most 2^ROW_BITS, or one long text."""
    data, borders = W.flat(texts)
    n = len(texts)
    out = np.zeros((n, BINS), np.uint16)
    if not len(data):
        return out
    hashed, row, place = kmers(data, borders)
    place_bits = np.uint64(64 - KMER_BITS - (ROW_BITS if n > 1 else 0))
    key = np.sort((row << np.uint64(KMER_BITS) | hashed) << place_bits | place)
    group = key >> place_bits
    first = np.ones(len(key), dtype=bool)
    first[1:] = group[1:] != group[:-1]
    at = np.arange(len(key))
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    hashed = group & np.uint64((1 << KMER_BITS) - 1)
    row = group >> np.uint64(KMER_BITS)
    place = key & ((np.uint64(1) << place_bits) - np.uint64(1))

    drawn = W.mixed(hashed * SPREAD + occurrence.astype(np.uint64))
    bins, value = drawn & np.uint64(BINS - 1), drawn >> np.uint64(16)
    total = np.bincount(row.astype(np.int64), minlength=n)
    share = np.minimum(1.0, CANDIDATES * BINS / np.maximum(total, 1))
    limit = (share * 2.0**48).astype(np.uint64)
    near = value < limit[row.astype(np.int64)]
    row, bins, value, hashed, place = (x[near] for x in (row, bins, value, hashed, place))

    order = np.lexsort((value, row * np.uint64(BINS) + bins))
    slot = (row * np.uint64(BINS) + bins)[order]
    first = np.ones(len(slot), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    at = np.arange(len(slot))
    rank = at - np.maximum.accumulate(np.where(first, at, 0))
    chosen = order[rank < KEEP]
    slot = slot[rank < KEEP]
    order = np.lexsort((place[chosen], slot))  # back into text order
    chosen, slot = chosen[order], slot[order]
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    turn = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
    terms = W.mixed(hashed[chosen] + (turn.astype(np.uint64) << np.uint64(KMER_BITS)))
    tuples = W.mixed(np.add.reduceat(terms, starts)) if len(starts) else terms
    out.ravel()[slot[starts].astype(np.int64)] = np.maximum(tuples >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    return out


def signatures(texts: list) -> np.ndarray:
    parts = []
    for at in range(0, len(texts), 1 << ROW_BITS):
        column = pa.array(texts[at : at + (1 << ROW_BITS)], pa.large_string())
        parts += [piece_signatures(part) for _, part in W.pieces(column)]
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either text fills; 1 for two empty texts."""
    filled = (a > 0) | (b > 0)
    total = filled.sum(axis=1)
    return np.where(total == 0, 1.0, (filled & (a == b)).sum(axis=1) / np.maximum(total, 1))


def spelled(signature: np.ndarray) -> list:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def split_points(docs: DataFrame, buckets: int) -> list:
    """Ids that cut the ascending ids into about equal ranges; the least id is the first of them."""
    shares = [i / buckets for i in range(buckets)]
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, 10000).alias("points")).first()
    return sorted({found["least"], *(found["points"] or [])} - {None})


def neighbours(docs: DataFrame) -> DataFrame:
    """_bucket, _tail, doc_id, text: ranges of ids, each followed by the first rows of the next range.

    One shuffle of the texts. The tail of the last range is the first document. Rows without an id have
    no place in the order and stand alone in range 0.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = split_points(docs, buckets)

    def ranged(batches):
        cuts = np.array(points, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.array(ids.is_valid())
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = np.where(known, np.searchsorted(cuts, value, "right"), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(np.zeros(len(bucket), bool)), ids, batch.column("text")],
                names=["_bucket", "_tail", "doc_id", "text"],
            )
            if len(cuts):
                begins = np.flatnonzero(known & (cuts[np.maximum(bucket, 1) - 1] == value))
                before = np.where(bucket[begins] == 1, len(cuts), bucket[begins] - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before, pa.int32()), pa.array(np.ones(len(begins), bool)), ids.take(pa.array(begins)),
                     batch.column("text").take(pa.array(begins))],
                    names=["_bucket", "_tail", "doc_id", "text"],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = narrow.mapInArrow(ranged, "_bucket int, _tail boolean, doc_id bigint, text string")
    return rows.repartition("_bucket").sortWithinPartitions("_bucket", "_tail", "doc_id", "text")


SHAPE = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
ROWS = 500  # handled at a time


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's and its edited text's fingerprint, and their likeness; see SHAPE.

    The edited text takes its last half from the next document by ascending id; the last document's next
    is the first one. Rows that share an id follow each other by text. Null texts are empty, rows without
    an id have an empty text for next, and a lone document is its own next. An empty table gives no rows.
    """

    def rows(frames):
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                yield frame.iloc[at : at + ROWS]

    def fingerprint(frames):
        held = None  # the last row, which waits for its next
        for frame in rows(frames):
            ids, texts = list(frame["doc_id"]), list(frame["text"])
            buckets, tails = list(frame["_bucket"]), list(frame["_tail"])
            own = signatures(texts)
            done = []
            for i, text in enumerate(texts):
                if held is not None and held[0] == buckets[i] and held[0] > 0:
                    done.append((*held[1:], text, own[i]))
                elif held is not None:
                    done.append((*held[1:], "", np.zeros(BINS, np.uint16)))
                held = None if tails[i] else (buckets[i], ids[i], text, own[i])
            yield result(done)
        if held is not None:
            yield result([(*held[1:], "", np.zeros(BINS, np.uint16))])

    def result(done):
        ids, texts, own, following, after = (list(c) for c in zip(*done)) if done else ([], [], [], [], [])
        changed = [edited(a, b) for a, b in zip(texts, following)]
        own, after = (np.array(x, np.uint16).reshape(-1, BINS) for x in (own, after))
        other = signatures(changed)
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"),
            "n_chars": np.array([len(t) for t in texts], np.int64),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": spelled(own),
            "edited_fingerprint": spelled(other),
            "near_edited": likeness(own, other),
            "near_next": likeness(own, after),
        })

    return neighbours(docs).mapInPandas(fingerprint, SHAPE)
