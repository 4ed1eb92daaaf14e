"""Mixture-controlled packing: deficit round-robin over source queues, cut into fixed-length sequences.

Each source is a queue of token streams in a drawn or a given order. A window of WINDOW tokens grants every source
its part; a source is served in units of UNIT tokens, and what it is granted beyond whole units is its
deficit, carried to the next window. The tokens that a source has received after w windows are therefore
UNIT * ((w * part) div (UNIT * PARTS / WINDOW)), a closed form, so every document finds its windows from
its offset in the queue alone and no window waits for another one, in whatever partition it lies. The
windows, one after the other, are cut every `length` tokens: all sequences are full but the last one.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quality_probe.llm import words as W
from quality_probe.operators.sizes import broadcast_if_small
from quality_probe.scratch import written

LENGTH = 2048
WINDOW = 1 << 16
PARTS = 1 << 20
UNIT = 256
GRANT = UNIT * PARTS // WINDOW  # parts a unit costs
END = 1  # id after each document
PIECE = 4 << 20
CACHE = 1 << 20  # words
BUCKETS = 1 << 12  # of a queue in a given order, of LEAST_BUCKET places at least
LEAST_BUCKET = 1 << 10
SENTINEL = "\x01"


class WordEncoder:
    """Token ids of texts, by way of their distinct blank-separated words.

    Right for tokenizers that drop blanks and never join tokens over them. Words are told apart by a
    64-bit hash; the ids of up to CACHE words are kept for later pieces of the task.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.sentinel = self.tokenizer.encode(SENTINEL, add_special_tokens=False).ids
        self.forget()

    def forget(self):
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def encode_words(self, words: list) -> list:
        """Ids of each word; blocks are encoded in one call, parted by a token that no word holds."""
        out = [None] * len(words)
        plain = [i for i, w in enumerate(words) if SENTINEL not in w]
        for i in set(range(len(words))) - set(plain):
            out[i] = self.tokenizer.encode(words[i], add_special_tokens=False).ids
        for at in range(0, len(plain), 256):
            block = plain[at : at + 256]
            found = self.tokenizer.encode(f" {SENTINEL} ".join(words[i] for i in block), add_special_tokens=False).ids
            ids = np.array(found, np.int64)
            cuts = np.flatnonzero(ids == self.sentinel[0])
            for i, part in zip(block, np.split(ids, cuts), strict=True):
                out[i] = part if i == block[0] else part[1:]
        return out

    def learn(self, hashes: np.ndarray, words: list):
        if len(self.known) + len(hashes) > CACHE:
            self.forget()
        found = self.encode_words(words)
        size = np.array([len(f) for f in found], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *[np.asarray(f, self.kind) for f in found]])
        order = np.argsort(np.concatenate([self.known, hashes]), kind="stable")
        self.known = np.concatenate([self.known, hashes])[order]
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, size])[order]

    def encode(self, texts: pa.Array) -> tuple:
        """(ids of all texts one after the other, each closed by END; border of each text)."""
        data, borders = W.flat(texts)
        starts, ends, rows = W.spans(data, borders)
        hashes, where, which = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        missing = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != hashes[inside]
        if missing.any():
            if len(self.known) + int(missing.sum()) > CACHE:
                self.forget()
                missing[:] = True
            raw = data.tobytes()
            chosen = where[missing]
            self.learn(hashes[missing], [raw[s:e].decode() for s, e in zip(starts[chosen], ends[chosen], strict=True)])
            at = np.searchsorted(self.known, hashes)
        first, size = self.first[at][which], self.size[at][which]
        per_text = np.bincount(rows, weights=size, minlength=len(texts)).astype(np.int64) + 1
        out_borders = np.concatenate([[0], np.cumsum(per_text)])
        out = np.full(int(out_borders[-1]), END, self.kind)
        place = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(place, size)
        target = np.arange(int(size.sum())) + np.repeat(rows, size)  # each earlier text has one END
        out[target] = self.ids[np.repeat(first, size) + within]
        return out, out_borders


ENCODERS: dict = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker, kept between tasks."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer_path: str, order: str = None) -> DataFrame:
    """doc_id, source, n (tokens with END), ids (little-endian, 2 bytes each where the vocabulary allows).

    With `order`, that column too, as `place`.
    """
    extra = ["place"] if order else []

    def encode(batches):
        words = encoder(tokenizer_path)
        for batch in batches:
            for row, part in W.pieces(W.filled(batch.column("_text")), PIECE):
                ids, borders = words.encode(part)
                width = np.dtype(words.kind).itemsize
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(borders * width), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(part)), batch.column("source").slice(row, len(part)),
                     pa.array(np.diff(borders)), binary.cast(pa.binary()),
                     *[batch.column(c).slice(row, len(part)) for c in extra]],
                    names=["doc_id", "source", "n", "ids", *extra],
                )

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, n bigint, ids binary"
    places = [F.col(order).cast("long").alias("place")] if order else []
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("text").alias("_text"), *places
    ).mapInArrow(encode, ", ".join([shape, *(f"{c} bigint" for c in extra)]))


def running(df: DataFrame, by: list, bucket, order: list, value: str, name: str) -> DataFrame:
    """Add the sum of `value` over all earlier rows of the group, first within buckets, then over buckets.

    `bucket` orders the rows coarsely; only one row per bucket meets in a group's own task.
    """
    marked = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    within = marked.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        within.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def parted(queue: DataFrame, weights: DataFrame = None) -> DataFrame:
    """(source, j, part): parts of PARTS by target weight; without weights, by the tokens each source has."""
    shares = queue.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is not None:
        given = weights.groupBy("source").agg(F.sum("weight").alias("weight"))
        shares = shares.alias("s").join(given.alias("w"), F.expr("s.source <=> w.source"), "left").select(
            "s.source", F.coalesce("w.weight", F.lit(0)).alias("tokens")
        )
    everything = Window.partitionBy(F.lit(0))  # a row per source
    part = F.round(F.lit(float(PARTS)) * F.col("tokens") / F.greatest(F.sum("tokens").over(everything), F.lit(1)))
    return shares.select(
        "source",
        F.row_number().over(everything.orderBy("source")).alias("j"),
        F.greatest(part.cast("long"), F.lit(1)).alias("part"),
    )


def placed(queue: DataFrame, weights: DataFrame = None) -> DataFrame:
    """(key, start, length, position): pieces of each document in the token stream of all windows.

    `queue` has key, source, n, and `place` where the queues are not to be drawn but in its order. A piece
    lies in one window; the order is window, source, queue.
    """
    parts = broadcast_if_small(written(parted(queue, weights), "parts"), "source")
    if "place" in queue.columns:
        last = queue.agg(F.max("place")).first()[0] or 0
        turn, bucket = F.col("q.place"), F.expr(f"_draw div {max(LEAST_BUCKET, last // BUCKETS + 1)}")
    else:
        turn, bucket = F.xxhash64("q.key"), F.shiftrightunsigned("_draw", 52)
    drawn = queue.alias("q").join(parts.alias("p"), F.expr("q.source <=> p.source")).select(
        "q.key", "q.n", "p.j", "p.part", turn.alias("_draw")
    )
    queued = running(drawn, ["j"], bucket, ["_draw", "key"], "n", "x")

    def window(token: str) -> str:  # the first window that grants the unit of a token of the queue
        return f"({GRANT} * ({token} div {UNIT} + 1) - 1) div part"

    def granted(w: str) -> str:  # tokens granted by the windows before w
        return f"{UNIT} * (({w} * part) div {GRANT})"

    spread = queued.select(
        "*", F.explode(F.expr(f"sequence({window('x')}, {window('(x + n - 1)')})")).alias("w")
    ).select(
        "key", "j", "w", "x",
        F.expr(f"greatest(x, {granted('w')})").alias("low"),
        F.expr(f"least(x + n, {granted('(w + 1)')})").alias("high"),
    ).where("low < high")
    pieces = written(
        spread.select("key", "j", "w", (F.col("low") - F.col("x")).alias("start"), "low",
                      (F.col("high") - F.col("low")).alias("length")),
        "pieces",
    )
    served = pieces.groupBy("w", "j").agg(F.sum("length").alias("served"), F.min("low").alias("first"))
    windows = served.groupBy("w").agg(F.sum("served").alias("all"))
    begun = running(windows, [], F.expr("w div 1024"), ["w"], "all", "begin")
    earlier = Window.partitionBy("w").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    bases = served.withColumn("_own", F.coalesce(F.sum("served").over(earlier), F.lit(0))).join(begun, "w").select(
        "w", "j", (F.col("begin") + F.col("_own") - F.col("first")).alias("base")
    )
    return pieces.join(bases, ["w", "j"]).select(
        "key", "start", "length", (F.col("base") + F.col("low")).alias("position"), "w"
    )


SHAPE = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "`window` bigint"
)


def packed(docs: DataFrame, tokenizer_path: str, weights: DataFrame = None, length: int = LENGTH,
           order: str = None) -> DataFrame:
    """doc_id, SHAPE: every token of every document in exactly one piece of one sequence of `length` tokens.

    `window` tells the piece's mixture window. Null texts are empty and give END alone; a null source is
    a source of its own; a source without a weight gets the least part. `order` names a column of row
    positions (from 0, dense) that the queues follow; without it their order is drawn. Repeated rows are
    packed each; an empty table gives no rows. Other columns are not read.
    """
    found = tokenized(docs, tokenizer_path, order)
    tokens = written(found.withColumn("key", F.monotonically_increasing_id()), "tokens")
    pieces = placed(tokens.drop("doc_id", "ids"), weights).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "position", "w"))).alias("pieces")
    )

    def cut(batches):
        for batch in batches:
            ids = batch.column("ids")
            doc_tokens = batch.column("n").to_pylist()
            rows, out = [], []
            for i, found in enumerate(batch.column("pieces").to_pylist()):
                raw = ids[i].as_py()
                values = np.frombuffer(raw, "<u2" if len(raw) == 2 * doc_tokens[i] else "<u4").astype("<u4")
                for piece in found:
                    start, left, position = piece["start"], piece["length"], piece["position"]
                    while left:
                        take = min(left, length - position % length)
                        crc = zlib.crc32(values[start : start + take].tobytes())
                        out.append((start, take, crc, doc_tokens[i], position // length, position % length, piece["w"]))
                        rows.append(i)
                        start, left, position = start + take, left - take, position + take
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), *[pa.array(c, pa.int64()) for c in zip(*out)]],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return tokens.select("key", "doc_id", "n", "ids").join(pieces, "key").select(
        "doc_id", "n", "ids", "pieces"
    ).mapInArrow(cut, f"doc_id {kind}, {SHAPE}")
