"""Removal of repeated byte strings by suffix arrays over shards of what can repeat.

A string of LENGTH bytes is owned by its anchor, the gram of GRAM bytes in it with the least hash (the
leftmost of equals). Equal strings have equal anchors at the same distance, so the strings that one place
of an anchor owns, an unbroken run, meet all their equals under the anchor's hash. Anchors that occur
once are dropped. The others' contexts (the bytes of their runs) are gathered by anchor into shards; each
shard's suffix array is built by induced sorting, and a string repeats if it shares LENGTH bytes with a
neighbour in it. Contexts that occur as a whole more than once stand in a shard once, with their count,
and an anchor all of whose contexts are equal needs no order at all.

An anchor with more than LIMIT different contexts would make a large shard: its strings are divided by
their distance to the anchor, half by half, and regrouped by the bytes that all strings of a half share,
until groups are small or hold a single distance, where equal strings are equal slices and are counted.
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.llm import words as W
from quality_probe.llm.suffix_array import permuted_prefixes, suffix_array
from quality_probe.operators.sizes import broadcast_if_small
from quality_probe.scratch import written

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM  # an anchor lies 0..REACH bytes into its string
PLACE_BITS = 24
SEGMENT = 1 << 19  # strings of a longer text are handled by segments of their starts
LIMIT = 4096
SHARD = 1 << 18
INVERSE = pow(W.BASE, -1, 1 << 64)
LIST_ROWS = 1_000_000  # spans in a broadcast

PLACES = "anchor bigint, context bigint, digest binary, low bigint, width int, reach int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (the last places are not filled)."""
    h = data.astype(np.uint64) + np.uint64(1)
    size, factor = 1, W.BASE
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(factor) + h[size:]
        factor = factor * factor & ((1 << 64) - 1)
        size *= 2
    return W.mixed(h)


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` consecutive values."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[: len(values) - width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def owned_runs(data: np.ndarray, borders: np.ndarray) -> tuple:
    """(row, low, width, anchor place, anchor hash) of each run of strings that one place owns."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data)
    high = ~np.uint64((1 << PLACE_BITS) - 1)
    owner = least_of((hashes & high) | np.arange(len(hashes), dtype=np.uint64), REACH + 1) & ~high
    owner = owner.astype(np.int64)
    sizes = np.diff(borders)
    inside = np.arange(len(owner)) + LENGTH <= np.repeat(borders[1:], sizes)[: len(owner)]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64)
    place = owner[starts]
    begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    low = starts[begins]
    width = np.diff(np.append(begins, len(starts)))
    return np.searchsorted(borders, low, "right") - 1, low, width, place[begins], hashes[place[begins]]


@functools.lru_cache(maxsize=1)
def power_tables(bits: int) -> tuple:
    """The first 2^bits powers of BASE and of its inverse."""
    back = np.full(1 << bits, INVERSE, np.uint64)
    back[0] = 1
    return W.powers(1 << bits), np.cumprod(back, dtype=np.uint64)


def range_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the bytes low..high-1, equal for equal bytes wherever they stand."""
    n = len(data)
    factors, back = power_tables(n.bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * factors[:n], out=sums[1:])
    return W.mixed((sums[high] - sums[low]) * back[low] ^ ((high - low).astype(np.uint64) << np.uint64(40)))


def segments(texts: pa.Array):
    """(first row, data, borders, bytes before) of pieces; a long text comes in overlapping segments."""
    for row, part in W.pieces(texts, SEGMENT):
        data, borders = W.flat(part)
        if len(part) > 1 or len(data) <= 2 * SEGMENT:
            yield row, data, borders, 0
        else:
            for at in range(0, len(data), SEGMENT):
                cut = data[at : at + SEGMENT + LENGTH - 1]
                yield row, cut, np.array([0, len(cut)]), at


def places(texts: DataFrame) -> DataFrame:
    """PLACES of each (digest, text): every run of strings with its anchor and the hash of its bytes."""

    def find(batches):
        for batch in batches:
            for row, data, borders, before in segments(W.filled(batch.column("text"))):
                rows, low, width, place, hashes = owned_runs(data, borders)
                if not len(rows):
                    continue
                reach = place - low
                context = W.mixed(range_hashes(data, low, low + width - 1 + LENGTH) ^ W.mixed(reach.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(context.view(np.int64)),
                     batch.column("digest").take(pa.array(rows + row)), pa.array(low - borders[rows] + before),
                     pa.array(width.astype(np.int32)), pa.array(reach.astype(np.int32))],
                    names=["anchor", "context", "digest", "low", "width", "reach"],
                )

    return texts.mapInArrow(find, PLACES)


SLICES = (
    "anchor bigint, context bigint, n bigint, skip int, width int, reach int, bytes binary, key bigint, "
    "part bigint, near int, far int"
)


def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """SLICES of one place of each wanted context: its bytes, read from the text that holds it."""
    kept = ["anchor", "context", "n", "width", "reach"]

    def cut(batches):
        for batch in batches:
            runs = batch.column("runs")
            for row, part in W.pieces(W.filled(batch.column("text"))):
                data, borders = W.flat(part)
                lists = runs.slice(row, len(part))
                run, holder = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
                low, width = run.field("low").to_numpy(), run.field("width").to_numpy()
                ends = np.cumsum(width.astype(np.int64) - 1 + LENGTH)
                sizes = np.diff(ends, prepend=0)
                picked = data[np.arange(int(sizes.sum())) + np.repeat(borders[holder] + low - (ends - sizes), sizes)]
                offsets = np.append(0, ends).astype(np.int32)
                cuts = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(offsets), pa.py_buffer(picked)])
                yield pa.RecordBatch.from_arrays([*[run.field(c) for c in kept], cuts], names=[*kept, "bytes"])

    runs = wanted.groupBy("digest").agg(F.collect_list(F.struct("anchor", "context", "n", "low", "width", "reach")).alias("runs"))
    holders = texts.join(broadcast_if_small(wanted.select("digest").distinct(), "digest"), "digest", "left_semi")
    found = holders.join(runs, "digest").select("text", "runs").mapInArrow(
        cut, "anchor bigint, context bigint, n bigint, width int, reach int, bytes binary"
    )
    return found.selectExpr(
        "anchor", "context", "n", "0 AS skip", "width", "reach", "bytes", "anchor AS key", "context AS part", "0 AS near", f"{REACH} AS far"
    )


def sliced(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = zip(*rows) if rows else [()] * len(kinds)
    names = [c.split()[0] for c in SLICES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def short_hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def halved(slices: DataFrame) -> DataFrame:
    """The strings of each slice, by the half of the distances near..far that theirs falls in."""

    def halve(batches):
        names = [c.split()[0] for c in SLICES.split(", ")]
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                anchor, context, n, skip, width, reach, raw, key, _, near, far = row
                middle = (near + far) // 2
                for low, high in ((near, middle), (middle + 1, far)):
                    first, last = max(0, reach - high), min(width - 1, reach - low)
                    if first > last:
                        continue
                    own = raw[first : last + LENGTH]
                    distance = reach - first
                    core = own[distance - low : distance - high + LENGTH]
                    out.append((
                        anchor, context, n, skip + first, last - first + 1, distance, own,
                        short_hash(key.to_bytes(8, "little", signed=True) + bytes([low, high]) + core),
                        short_hash(distance.to_bytes(2, "little") + own), low, high,
                    ))
            yield sliced(out)

    return slices.mapInArrow(halve, SLICES)


def ordered(slices: DataFrame) -> DataFrame:
    """(key, part, first, last): runs of strings in a slice that also start elsewhere in its shard."""

    def shards(batches):
        held, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "part", "width", "bytes")]
            for row in zip(*columns, strict=True):
                if size >= SHARD and row[0] != last:
                    yield held
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held:
            yield held

    def find(batches):
        for rows in shards(batches):
            raw = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).astype(np.uint16) + np.uint16(1)
            sizes = np.array([len(r[3]) for r in rows])
            text = np.zeros(len(raw) + len(rows), np.uint16)  # a zero after each slice
            begin = np.cumsum(sizes + 1) - sizes - 1
            text[np.arange(len(raw)) + np.repeat(np.arange(len(rows)), sizes)] = raw
            order = suffix_array(text)
            starts = np.zeros(len(text), dtype=bool)  # of strings; others run over the end of their slice
            widths = np.array([r[2] for r in rows])
            starts[np.arange(int(widths.sum())) + np.repeat(begin - (np.cumsum(widths) - widths), widths)] = True
            shared = permuted_prefixes(text, order, LENGTH, starts) >= LENGTH
            again = shared.copy()
            again[order[:-1][shared[order[1:]]]] = True
            marked = np.flatnonzero(again)
            row = np.searchsorted(begin, marked, "right") - 1
            place = marked - begin[row]
            fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]) if len(row) else np.zeros(0, bool)
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(row)) - 1 if len(row) else starts
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in row[starts]], pa.int64()), pa.array([rows[i][1] for i in row[starts]], pa.int64()),
                 pa.array(place[starts].astype(np.int32)), pa.array(place[ends].astype(np.int32))],
                names=["key", "part", "first", "last"],
            )

    rows = slices.select("key", "part", "width", "bytes").repartition("key").sortWithinPartitions("key", "part")
    return rows.mapInArrow(find, "key bigint, part bigint, first int, last int")


def repeated_in(wanted: DataFrame, texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(anchor, context, first, last): runs of repeated strings in the wanted contexts, whose bytes are in `texts`."""
    groups = wanted.groupBy("anchor").agg(F.count("*").alias("slices"))
    large = written(groups.where(F.col("slices") > limit).select("anchor"), "large-anchors")
    listed = broadcast_if_small(large)
    runs = ordered(contexts(texts, wanted.join(listed, "anchor", "left_anti")))
    marks = written(runs.selectExpr("key AS anchor", "part AS context", "first", "last"), "repeated").union(
        wanted.where("n > 1").selectExpr("anchor", "context", "0 AS first", "width - 1 AS last")
    )
    if large.isEmpty():
        return marks
    halves = written(halved(contexts(texts, wanted.join(listed, "anchor", "left_semi"))), "halves")
    return marks.union(repeated_in_halves(halves, limit))


def repeated_in_halves(level: DataFrame, limit: int) -> DataFrame:
    """(anchor, context, first, last): runs of repeated strings in the given SLICES, halved on while groups are large."""
    marks = None
    while True:
        parts = written(
            level.groupBy("key", "part").agg(
                F.sum("n").alias("n"), F.any_value("bytes").alias("bytes"), F.max("width").alias("width"),
                F.max("near").alias("near"), F.max("far").alias("far"),
            ),
            "slices",
        )
        groups = parts.groupBy("key").agg(F.count("*").alias("slices"), F.max(F.col("far") - F.col("near")).alias("span"))
        groups = written(groups.where("slices > 1"), "slice-groups")
        small = groups.where((F.col("slices") <= limit) & (F.col("span") > 0)).select("key")
        large = groups.where((F.col("slices") > limit) & (F.col("span") > 0)).select("key")
        whole = parts.where("n > 1").select("key", "part", F.lit(0).alias("first"), (F.col("width") - 1).alias("last"))
        runs = ordered(parts.join(broadcast_if_small(small), "key", "left_semi")).union(whole)
        back = level.select("key", "part", "anchor", "context", "skip").join(runs, ["key", "part"]).select(
            "anchor", "context", (F.col("first") + F.col("skip")).alias("first"), (F.col("last") + F.col("skip")).alias("last")
        )
        back = written(back, "repeated")
        marks = back if marks is None else marks.union(back)
        if large.isEmpty():
            return marks
        level = written(halved(level.join(broadcast_if_small(large), "key", "left_semi")), "halves")


def removal(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(digest, whole, spans) of each text (digest, text) that loses bytes."""
    long = texts.where(F.octet_length("text") >= LENGTH)
    copied = written(long.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "copied")
    marked = broadcast_if_small(copied)
    once = long.join(marked, "digest", "left_semi").groupBy("digest").agg(F.any_value("text").alias("text"))
    distinct = long.join(marked, "digest", "left_anti").select("digest", "text").union(once)

    found = written(places(distinct), "places")
    anchors = found.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("uniform")
    ).where("n > 1").select("anchor", "uniform")
    anchors = written(anchors, "anchors")
    again = written(found.join(broadcast_if_small(anchors), "anchor"), "repeated-places")
    varied = again.where("NOT uniform")
    wanted = varied.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("digest", "low", "width", "reach")).alias("one")
    ).select("anchor", "context", "n", "one.*")
    marks = repeated_in(written(wanted, "contexts"), distinct, limit)
    spans = varied.join(marks, ["anchor", "context"]).select(
        "digest", (F.col("low") + F.col("first")).alias("start"), (F.col("low") + F.col("last") + LENGTH).alias("end")
    )
    even = again.where("uniform").select(
        "digest", F.col("low").alias("start"), (F.col("low") + F.col("width") - 1 + LENGTH).alias("end")
    )
    listed = merged(spans.union(even).groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return copied.select("digest", F.lit(True).alias("whole"), none.alias("spans")).union(
        listed.join(marked, "digest", "left_anti").select("digest", F.lit(False), "spans")
    )


def merged(listed: DataFrame) -> DataFrame:
    """(digest, spans) with disjoint spans."""

    def merge(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [
                [{"start": a, "end": b} for a, b in union_of([(s["start"], s["end"]) for s in row])]
                for row in batch.column("spans").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(spans, kind)], names=["digest", "spans"])

    return listed.mapInArrow(merge, "digest binary, spans array<struct<start: bigint, end: bigint>>")


def union_of(spans: list) -> list:
    """Sorted, disjoint, not even touching spans."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def deduplicated(docs: DataFrame, limit: int = LIMIT, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and `kept`, the remaining bytes) of every row.

    Bytes covered by a string of LENGTH bytes that also starts at another place of the corpus go; places
    in the same text count, and strings never cross texts. Null texts are empty. Repeated rows are copies
    and lose each other's bytes; an empty table gives no rows; other columns are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.unhex(F.md5("text")).alias("digest")
    )
    gone = written(removal(base.select("digest", "text"), limit), "removal")
    total = gone.agg(F.sum(F.size("spans") + 1)).first()[0] or 0

    def cut(batches):
        for batch in batches:
            out = []
            texts = W.filled(batch.column("text")).cast(pa.large_binary())
            columns = [batch.column(c).to_pylist() for c in ("whole", "spans")]
            for value, whole, spans in zip(texts, *columns, strict=True):  # one text at a time leaves Arrow memory
                raw = value.as_py()
                runs = [[0, len(raw)]] if whole else union_of([(s["start"], s["end"]) for s in spans or []])
                kept, last = [], 0
                for start, end in runs:
                    kept.append(raw[last:start])
                    last = end
                kept = b"".join([*kept, raw[last:]])
                spelled = ",".join(f"{a}:{b}" for a, b in runs)
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), spelled, kept if with_bytes else None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 6 if with_bytes else 5]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if with_bytes else [])]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), "bigint", "bigint", "bigint", "string", "string", "binary"]
    shape = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    if total <= LIST_ROWS:
        marked = base.join(F.broadcast(gone), "digest", "left")
    else:  # only the texts that lose bytes are moved to their spans
        losing = broadcast_if_small(gone.select("digest"), "digest")
        spared = base.join(losing, "digest", "left_anti").withColumns({
            "whole": F.lit(None).cast("boolean"), "spans": F.lit(None).cast(gone.schema["spans"].dataType)
        })
        marked = base.join(losing, "digest", "left_semi").join(gone, "digest").unionByName(spared)
    return marked.select("doc_id", "text", "whole", "spans").mapInArrow(cut, shape)
