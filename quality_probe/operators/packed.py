"""Vocabularies of any size, kept and asked by hash in packed rows.

A gram is known by 63 bits of its words' hashes, a bit that tells pairs, and its bucket (12 bits more, drawn from the
words on their own). That any two of 10^9 different pairs share all of it has a chance of about 1 in 70,000, that any two
of 10^7 different words do, 1 in 200,000. Hashes travel in one row a run of texts and bucket, each gram once a run; answers
come back as counts in the order of the question. No table of gram occurrences is sorted, joined or shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quality_probe.functions import text as T
from quality_probe.scratch import written

BUCKET_BITS = 12
BUCKET_SHIFT = np.uint64(64 - BUCKET_BITS)
HOT = 128  # most frequent grams of each bucket, sent to every task
PACKED_RUN = 1 << 21  # grams that a task holds at once, in whole texts
NO_CHUNK = -1  # segment of a pair of words over the border of two chunks
NO_SEGMENT = -2  # of a text without words
WHOLE_RUN = -1  # bucket of the row that describes a run

VOCABULARY = (
    "bucket int, keys binary, counts binary, hot_keys binary, hot_counts binary, n_words bigint, n_pairs bigint, "
    "word_sums array<bigint>, pair_sums array<bigint>"
)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def run_grams(borders: np.ndarray, words: np.ndarray) -> tuple:
    """(key, bucket, text, last word in the text, whether a pair) of the grams of texts; `words` are hashes."""
    n = np.diff(borders)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - np.repeat(borders[:-1] - borders[0], n)
    first = np.flatnonzero(owner[1:] == owner[:-1])
    a, b = words[first], words[first + 1]
    pair = mixed(a * np.uint64(0x9E3779B97F4A7C15) ^ (b << np.uint64(31) | b >> np.uint64(33)))
    bucket = mixed(a + b * np.uint64(0xD6E8FEB86659FD93)) >> BUCKET_SHIFT
    keys = np.append(words & ~np.uint64(1), pair | np.uint64(1))
    buckets = np.append(mixed(words) >> BUCKET_SHIFT, bucket).astype(np.uint16)
    is_pair = np.arange(len(keys)) >= len(words)
    return keys, buckets, np.append(owner, owner[first]), np.append(at, at[first + 1]), is_pair


def distinct(keys: np.ndarray, buckets: np.ndarray) -> tuple:
    """(keys, buckets, number of each gram's) by bucket, then key; one that collides in half may stay twice."""
    order = np.argsort(keys)
    k, b = keys[order], buckets[order]
    new = np.append(True, (k[1:] != k[:-1]) | (b[1:] != b[:-1]))[: len(k)]
    k, b = k[new], b[new]
    by_bucket = np.argsort(b, kind="stable")
    rank = np.empty(len(k), np.int64)
    rank[by_bucket] = np.arange(len(k))
    number = np.empty(len(keys), np.int64)
    number[order] = rank[np.cumsum(new) - 1]
    return k[by_bucket], b[by_bucket], number


def packed_counts(counts: np.ndarray) -> bytes:
    """A (4, n) matrix in the narrowest whole numbers that hold it; the width follows from n."""
    most = int(counts.max()) if counts.size else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    return counts.astype(kind).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // (4 * n)}").reshape(4, n).astype(np.int64) if n else np.zeros((4, 0), np.int64)


def keys_of(column) -> list:
    return [np.frombuffer(value, np.uint64) for value in column.to_pylist()]


def joined(parts: list, blank: np.ndarray, axis: int = 0) -> np.ndarray:
    return np.concatenate(parts, axis=axis) if parts else blank


def runs_of(batch: pa.RecordBatch):
    """(first text, end, borders, word hashes) of runs of whole texts, about PACKED_RUN grams each."""
    column = batch.column("hashes")
    offsets = column.offsets.to_numpy()
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PACKED_RUN // 2, "right")) - 1)
        words = column.values.slice(offsets[low], offsets[high] - offsets[low])
        yield low, high, offsets[low : high + 1], words.to_numpy().view(np.uint64)
        low = high


def slices(buckets: np.ndarray) -> tuple:
    """(bucket, start, end) of the runs of equal buckets."""
    at = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(buckets)])
    return buckets[at], at, np.append(at[1:], len(buckets))


def word_hashes(words: Column) -> Column:
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w)).alias("hashes")


def counted(labelled: DataFrame, words: Column) -> DataFrame:
    """The vocabulary of documents with `quality` and `toxic`: a row a bucket, written."""

    def count(batches):
        for batch in batches:
            marks = [batch.column(c).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("quality", "toxic")]
            known = np.isin(marks[0], (0, 1)) & np.isin(marks[1], (0, 1))
            cells = np.where(known, 2 * marks[0] + marks[1], 4)
            for low, high, borders, found in runs_of(batch):
                keys, buckets, owner, _, _ = run_grams(borders, found)
                keys, buckets, number = distinct(keys, buckets)
                cell = cells[low:high][owner]
                counts = np.stack([np.bincount(number[cell == c], minlength=len(keys)) for c in range(4)])
                which, starts, ends = slices(buckets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(which.astype(np.int32)),
                    pa.array([keys[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                    pa.array([packed_counts(counts[:, s:e]) for s, e in zip(starts, ends)], pa.binary()),
                ], names=["bucket", "keys", "counts"])

    def merge(table):
        parts = keys_of(table.column("keys"))
        found = zip(parts, table.column("counts").to_pylist(), strict=True)
        counts = np.concatenate([unpacked(data, len(keys)) for keys, data in found], axis=1)
        keys, number = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros((4, len(keys)), np.int64)
        for row, more in zip(total, counts, strict=True):
            np.add.at(row, number, more)
        is_pair = keys & np.uint64(1) == 1
        hot = np.sort(np.argsort(-total.sum(axis=0), kind="stable")[:HOT])
        row = [table.column("bucket")[0].as_py(), keys.tobytes(), packed_counts(total), keys[hot].tobytes(), packed_counts(total[:, hot]),
               int((~is_pair).sum()), int(is_pair.sum()), total[:, ~is_pair].sum(axis=1).tolist(), total[:, is_pair].sum(axis=1).tolist()]
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [field.split()[0] for field in VOCABULARY.split(", ")]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    told = labelled.select("quality", "toxic", word_hashes(words)).mapInArrow(count, "bucket int, keys binary, counts binary")
    return written(told.groupBy("bucket").applyInArrow(merge, VOCABULARY), "packed-vocabulary")


def sums_of(vocabulary: DataFrame) -> list:
    """(number of grams, sums of the four cells) of words, then of pairs."""
    made = [[F.sum(f"n_{kind}s"), *[F.sum(F.get(f"{kind}_sums", i)) for i in range(4)]] for kind in ("word", "pair")]
    row = [n or 0 for n in vocabulary.agg(*[c.alias(f"c{i}") for i, c in enumerate(made[0] + made[1])]).first()]
    return [(row[0], row[1:5]), (row[5], row[6:])]


def settled_run(borders, words, hot: tuple) -> tuple:
    """(text of each segment, its numbers, open grams by segment, their distinct keys and buckets).

    The numbers are its name, grams, pairs, words, open grams and the sums over hot grams.
    """
    hot_keys, hot_buckets, hot_lifts = hot
    keys, buckets, owner, last, is_pair = run_grams(borders, words)
    n = np.diff(borders)
    chunks = -(-n // T.CHUNK_WORDS)
    segments = np.maximum(chunks, 1) + (chunks > 1)  # the last of several is that of pairs over borders
    base = np.cumsum(segments) - segments
    crosses = is_pair & (last % T.CHUNK_WORDS == 0)
    segment = base[owner] + np.where(crosses, chunks[owner], last // T.CHUNK_WORDS)
    total = int(segments.sum())
    text = np.repeat(np.arange(len(n)), segments)
    name = np.arange(total) - base[text]
    name[(name > 0) & (name == chunks[text])] = NO_CHUNK
    name[n[text] == 0] = NO_SEGMENT
    pairs, singles = (np.bincount(segment[m], minlength=total) for m in (is_pair, ~is_pair))

    keys, buckets, number = distinct(keys, buckets)
    place = np.searchsorted(hot_keys, keys)
    place[place == len(hot_keys)] = 0
    hit = (hot_keys[place] == keys) & (hot_buckets[place] == buckets) if len(hot_keys) else np.zeros(len(keys), bool)
    known = hit[number]
    at, which = segment[known], place[number[known]]
    # sums of integers far below 2^53 are exact
    sums = [np.bincount(at, weights=lift[which], minlength=total).astype(np.int64) for lift in hot_lifts]
    left = np.flatnonzero(~known)
    left = left[np.argsort(segment[left], kind="stable")]
    opened = (np.cumsum(~hit) - 1)[number[left]]
    rows = np.stack([name, singles + pairs, pairs, singles, np.bincount(segment[left], minlength=total), *sums])
    return text, rows, opened.astype(np.uint32), keys[~hit], buckets[~hit]


def summed(docs: DataFrame, vocabulary: DataFrame, words: Column, key: str, names: list, lifts, counts: list) -> DataFrame:
    """Gram counts and sums of each segment. `lifts(counts, is_pair)` gives the addends of grams, an array a name."""
    context = docs.sparkSession.sparkContext
    found = vocabulary.select("bucket", "hot_keys", "hot_counts").toArrow()
    parts = keys_of(found.column("hot_keys"))
    hot_keys = joined(parts, np.zeros(0, np.uint64))
    hot_buckets = np.repeat(found.column("bucket").to_numpy().astype(np.uint16), [len(p) for p in parts])
    data = zip(parts, found.column("hot_counts").to_pylist(), strict=True)
    hot_counts = joined([unpacked(d, len(k)) for k, d in data], np.zeros((4, 0), np.int64), 1)
    order = np.argsort(hot_keys)
    hot_lifts = lifts(hot_counts[:, order], hot_keys[order] & np.uint64(1) == 1)
    hot = context.broadcast((hot_keys[order], hot_buckets[order], hot_lifts))
    key_type = docs.schema[key].dataType.simpleString()

    def settle(batches):
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(key)
            for low, _, borders, hashes in runs_of(batch):
                text, rows, opened, keys, buckets = settled_run(borders, hashes, hot.value)
                which, starts, ends = slices(buckets)
                asked = len(which)
                owners = pa.array(np.append(0, np.full(1 + asked, len(text))).astype(np.int32))
                planes = opened.view(np.uint8).reshape(-1, 4).T.tobytes()  # upper bytes are mostly zero
                pairs = np.packbits(keys & np.uint64(1) == 1).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(1 + asked, run)),
                    pa.array(np.append(WHOLE_RUN, which.astype(np.int32)).astype(np.int32)),
                    pa.ListArray.from_arrays(owners, ids.take(pa.array(low + text))),
                    pa.array([rows.tobytes()] + [None] * asked, pa.binary()),
                    pa.array([planes] + [None] * asked, pa.binary()),
                    pa.array([pairs] + [keys[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                ], names=["run", "bucket", "owners", "segments", "opened", "keys"])
                run += 1

    def answer(asked, known):
        keys = joined(keys_of(known.column("keys")), np.zeros(0, np.uint64))  # of one row, if any
        questions = keys_of(asked.column("keys"))
        wanted = joined(questions, np.zeros(0, np.uint64))
        given = np.zeros((4, len(wanted)), np.int64)
        if len(keys):
            place = np.searchsorted(keys, wanted)
            place[place == len(keys)] = 0
            hit = keys[place] == wanted
            given[:, hit] = unpacked(known.column("counts")[0].as_py(), len(keys))[:, place[hit]]
        sizes = np.array([len(q) for q in questions], np.int32)
        made = [packed_counts(given[:, e - n : e]) for n, e in zip(sizes, np.cumsum(sizes, dtype=np.int64))]
        columns = [asked.column("run"), asked.column("bucket"), pa.array(sizes), pa.array(made, pa.binary())]
        return pa.table(columns, names=["run", "bucket", "size", "counts"])

    def add_up(runs, answers):  # one run
        owners = runs.column("owners")[0].values
        rows = np.frombuffer(runs.column("segments")[0].as_py(), np.int64).reshape(-1, len(owners))
        planes = np.frombuffer(runs.column("opened")[0].as_py(), np.uint8).reshape(4, -1)
        opened = np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)
        data, sizes = answers.column("counts").to_pylist(), answers.column("size").to_numpy()
        order = np.argsort(answers.column("bucket").to_numpy())
        given = joined([unpacked(data[i], sizes[i]) for i in order], np.zeros((4, 0), np.int64), 1)
        pairs = np.unpackbits(np.frombuffer(runs.column("keys")[0].as_py(), np.uint8), count=given.shape[1]) == 1
        segment = np.repeat(np.arange(len(owners)), rows[4])
        more = [np.bincount(segment, weights=lift[opened], minlength=len(owners)) for lift in lifts(given, pairs)]
        sums = [first + late.astype(np.int64) for first, late in zip(rows[5:], more, strict=True)]
        segments = pa.array(rows[0], mask=rows[0] == NO_SEGMENT)
        return pa.table([owners, segments, *map(pa.array, [*rows[1:4], *sums])], names=[key, "segment", *counts, *names])

    asked = "run bigint, bucket int, owners array<" + key_type + ">, segments binary, opened binary, keys binary"
    settled = written(docs.select(key, word_hashes(words)).mapInArrow(settle, asked), "packed-segments")
    questions = settled.filter(F.col("bucket") != WHOLE_RUN).select("run", "bucket", "keys")
    answers = questions.groupBy("bucket").cogroup(vocabulary.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(
        answer, "run bigint, bucket int, size int, counts binary"
    )
    shape = ", ".join([f"`{key}` {key_type}", "segment bigint", *[f"`{c}` bigint" for c in [*counts, *names]]])
    runs = settled.filter(F.col("bucket") == WHOLE_RUN).drop("bucket")
    rows = runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(add_up, shape)
    return rows.repartition(key).groupBy(key, "segment").agg(*[F.sum(c).alias(c) for c in [*counts, *names]])
