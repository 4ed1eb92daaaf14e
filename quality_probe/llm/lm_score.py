"""Language-model scores by online logistic context mixing, beside a unigram base.

A text is a string of symbols: frequent words, and bytes for all else. A word symbol stands for a blank
and the word; GLUE before it takes the blank away, TITLE makes its first letter a capital. Symbols are
spelled as the bits of a Huffman code. For every bit, predictors look up how often it was 0 and 1 in the
training texts at the same node of the code after the same last one, two or four symbols; node and context are hashed into SLOTS slots. The log odds are weighed by a weight vector that a
gate (depth in the code, confidence) selects; a logistic function gives the bit's probability. Weights
start alike for every text and learn from each of its bits before the next, so a text's score depends on the
training corpus and on the text alone. The texts of a batch go on side by side, a bit of each at a time.

Counts cover all training texts: each task counts its texts, slots are summed over tasks in two rounds.
Words are counted exactly; the FREQUENT most frequent are looked up where the text is read, all others
meet their counts in a join, so the model's word table need not fit anywhere.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.llm import words as W
from quality_probe.scratch import written

FOLDS, HELD = 7, 2
END_SYMBOL, GLUE, TITLE, FIRST_WORD = 256, 257, 258, 259
VOCABULARY = 1 << 16  # words that are symbols
RARE_BYTES = 8  # assumed length of other words, where the code is laid out
END_WORD = -1  # key of the end token, which no word's hash is given
SLOT_BITS = 20
ORDERS = (1, 2, 4)
PREDICTORS = len(ORDERS)
CHUNK = 1 << 16  # slots in a row of counts
SALTS = 32
FREQUENT = 1_000_000
SMOOTH = 0.2
CLIP = 8.0
DEPTHS = 8
GATES = 2 * DEPTHS
CONFIDENT = 2.0
START, BIAS, RATE = 0.5, 0.3, 12.0 / 2048
SCALE = math.sqrt(RATE)
LARGEST = np.float32(15)  # logit
LEAST = 1e-6  # least probability of a bit
PIECE = 1 << 19
TOGETHER = 1 << 24  # bytes of texts that are mixed together
EVENTS, LEAST_STEPS, MOST_STEPS = 1 << 19, 64, 4096  # of a window
KEEP = 1 << 20  # counted words a task holds before it passes them on
SYMBOL_FACTOR, NODE_FACTOR, SLOT_FACTOR = np.uint32(0xCC9E2D51), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
TURNS = np.repeat(np.array([1, -1], np.float32), DEPTHS) * np.float32(SCALE / 2)  # of a kind

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, borders: np.ndarray) -> tuple:
    """(start, end, row) of every word, the distinct hashes (A-Z in lower case) and which of them is the word's."""
    starts, ends, rows = W.spans(data, borders)
    keys = W.span_hashes(LOWER[data], starts, ends).view(np.int64)
    keys[keys == END_WORD] = 0
    return starts, ends, rows, *np.unique(keys, return_inverse=True)


def places_in(keys: np.ndarray, words: np.ndarray) -> tuple:
    """(place of each word in the sorted keys, whether it is one of them)."""
    place = np.searchsorted(keys, words)
    place[place == len(keys)] = 0
    return place, keys[place] == words if len(keys) else np.zeros(len(words), bool)


def is_training(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is in a fold to learn from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS != HELD


def counted(training: DataFrame) -> DataFrame:
    """(kind, key, n): occurrences of each word and the end (kind 0) and of each byte (kind 1)."""

    def count(batches):
        held, size = [], 0
        symbols = np.zeros(256, np.int64)
        texts = 0
        for batch in batches:
            for _, part in W.pieces(W.filled(batch.column("text")), 4 * PIECE):
                data, borders = W.flat(part)
                symbols += np.bincount(data, minlength=256)
                texts += len(part)
                distinct, which = words_of(data, borders)[3:]
                held.append((distinct, np.bincount(which, minlength=len(distinct))))
                size += len(held[-1][0])
                if size > KEEP:  # merged as seldom as memory allows
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > KEEP // 2:
                        yield rows(0, *held[0])
                        held, size = [], 0
        if texts:
            held.append((np.array([END_WORD]), np.array([texts])))
            yield rows(0, *summed(held))
            yield rows(1, np.arange(256), symbols)

    def summed(held):
        keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(which, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

    def rows(kind, keys, sums):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(sums.astype(np.int64))],
            names=["kind", "key", "n"],
        )

    found = training.select("text").mapInArrow(count, "kind int, key bigint, n bigint")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Code:
    """A Huffman code of the symbols, by their counts, and the words that are symbols.

    `first` has for each symbol where its bits, nodes and kinds (gate, then bit) begin in `bit`, `node` and `kind`.
    """

    def __init__(self, byte_counts: dict, texts: int, keys: np.ndarray, counts: np.ndarray, tokens: int):
        chosen = np.lexsort((keys, -counts))[:VOCABULARY]
        self.keys = np.sort(keys[chosen])
        word_counts = counts[chosen][np.argsort(keys[chosen])]
        spelled = max(0, tokens - int(word_counts.sum())) * RARE_BYTES + 1
        share = spelled / max(1, sum(byte_counts.values()))
        weights = [int(byte_counts.get(s, 0) * share) + 1 for s in range(256)]
        weights += [texts + 1, texts + 1, tokens // 10 + 1, *(word_counts + 1).tolist()]
        heap = [(w, s) for s, w in enumerate(weights)]
        heapq.heapify(heap)
        up = {}
        for node in range(len(weights) - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]], up[b[1]] = (node, 0), (node, 1)
            heapq.heappush(heap, (a[0] + b[0], len(weights) + node))
        nodes, bits, self.length = [], [], np.zeros(len(weights), np.int64)
        for symbol in range(len(weights)):
            path, at = [], symbol
            while at in up:
                path.append(up[at])
                at = len(weights) + up[at][0]
            nodes += [n for n, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            self.length[symbol] = len(path)
        self.node = np.array(nodes, np.uint32) * NODE_FACTOR
        self.bit = np.array(bits, np.uint8)
        self.first = np.cumsum(self.length) - self.length
        depth = np.arange(len(bits)) - np.repeat(self.first, self.length)
        gate = np.minimum(depth, DEPTHS - 1)  # of the node, as far as its depth decides
        self.kind = (gate + DEPTHS * self.bit).astype(np.uint8)


def symbols_of(data: np.ndarray, borders: np.ndarray, words: tuple, code: Code) -> tuple:
    """(symbols, border of each text in them): each text, with its `words`, closed by the end."""
    n = len(borders) - 1
    starts, ends, rows, distinct, which = words
    place, is_symbol = (found[which] for found in places_in(code.keys, distinct))
    is_capital = (data >= 65) & (data <= 90)
    capitals = np.zeros(len(data) + 1, np.int32)
    np.cumsum(is_capital, out=capitals[1:])
    many = capitals[ends] - capitals[starts]
    title = is_capital[starts] if len(starts) else np.zeros(0, bool)
    known = (many == title) & is_symbol
    starts, ends, place, title = starts[known], ends[known], place[known], title[known]
    # one blank between two words needs no symbol
    spaced = (starts >= 2) & (starts > borders[:-1][rows[known]] + 1)
    spaced[spaced] = (data[starts[spaced] - 1] == 0x20) & W.SOLID[data[starts[spaced] - 2]]
    change = np.zeros(len(data) + 1, np.int32)
    change[starts - spaced] += 1  # words do not overlap, so no place is named twice
    change[ends] -= 1
    counts = (np.cumsum(change[:-1]) == 0).astype(np.int64)
    counts[starts] = 1 + title + ~spaced
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    own = at[borders] + np.arange(n + 1)
    symbols = np.full(int(own[-1]), END_SYMBOL, np.int64)
    row_of = np.repeat(np.arange(n), np.diff(borders))
    at = at[:-1] + row_of
    spelled = counts > 0
    spelled[starts] = False
    symbols[at[spelled]] = data[spelled]
    to = at[starts]
    symbols[to[~spaced]] = GLUE
    to = to + ~spaced
    symbols[to[title]] = TITLE
    symbols[to + title] = FIRST_WORD + place
    return symbols, own


def contexts_of(symbols: np.ndarray, own: np.ndarray) -> list:
    """The last symbol, the last two and the last four, hashed; nothing before a text's start is seen."""
    before = [np.zeros(len(symbols), np.uint32)]
    before[0][1:] = symbols[:-1] + 1
    before[0][own[:-1]] = 0
    for _ in range(ORDERS[-1] - 1):
        further = np.zeros(len(symbols), np.uint32)
        further[1:] = before[-1][:-1]
        further[own[:-1]] = 0
        before.append(further)
    out, total = [], np.zeros(len(symbols), np.uint32)
    for order, symbol in enumerate(before, 1):
        total = (total ^ (symbol + np.uint32(0x1B873593))) * SYMBOL_FACTOR
        if order in ORDERS:
            h = total ^ (total >> np.uint32(15))
            h *= np.uint32(0x2C1B3C6D)
            out.append(h ^ (h >> np.uint32(13)))
    return out


def events(code: Code, symbols: np.ndarray, contexts: list) -> tuple:
    """(bits, places in the code, slots of each predictor, first event of each symbol) of a run of symbols."""
    length = code.length[symbols]
    first = np.append(0, np.cumsum(length))
    place = np.repeat(code.first[symbols] - first[:-1], length)
    place += np.arange(len(place))
    node = code.node.take(place)
    shift = np.uint32(32 - SLOT_BITS)
    slots = []
    for context in contexts:
        slot = np.repeat(context, length)
        slot ^= node
        slot *= SLOT_FACTOR
        slot >>= shift
        slots.append(slot)
    return code.bit.take(place), place, slots, first


def unpacked(blob: bytes) -> np.ndarray:
    """(CHUNK, 2) counts of a packed row."""
    return np.frombuffer(pa.decompress(blob, CHUNK * 16, codec="zstd", asbytes=True), np.int64).reshape(-1, 2)


def slot_counts(training: DataFrame, code) -> DataFrame:
    """(chunk, counts): occurrences of 0 and 1 in each slot, CHUNK slots of a predictor in a row.

    `code` is a broadcast Code.
    """

    def count(batches):
        both = np.zeros((PREDICTORS, 2 << SLOT_BITS), np.int64)
        seen = False
        for batch in batches:
            for _, part in W.pieces(W.filled(batch.column("text")), 4 * PIECE):
                seen = True
                data, borders = W.flat(part)
                symbols, own = symbols_of(data, borders, words_of(data, borders), code.value)
                contexts = contexts_of(symbols, own)
                for at in range(0, len(symbols), PIECE):
                    to = at + PIECE
                    bits, _, slots, _ = events(code.value, symbols[at:to], [c[at:to] for c in contexts])
                    for k, slot in enumerate(slots):
                        both[k] += np.bincount((slot << np.uint32(1)) | bits, minlength=2 << SLOT_BITS)
        if seen:
            yield from chunks(both.reshape(PREDICTORS, -1, 2))

    def chunks(both):
        for k in range(PREDICTORS):
            for at in range(0, 1 << SLOT_BITS, CHUNK):
                yield packed_rows([(k * (1 << SLOT_BITS) + at) // CHUNK], [both[k, at : at + CHUNK]])

    def packed_rows(numbers, arrays):
        blobs = [pa.compress(np.ascontiguousarray(a, np.int64).tobytes(), codec="zstd", asbytes=True) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                one = unpacked(blob)
                sums[chunk] = sums[chunk] + one if chunk in sums else one
        for chunk, total in sums.items():
            yield packed_rows([chunk], [total])

    shape = "chunk int, counts binary"
    rows = training.select("text").mapInArrow(count, shape).withColumn("salt", F.spark_partition_id() % SALTS)
    salted = rows.repartition("chunk", "salt").select("chunk", "counts").mapInArrow(add, shape)
    return salted.repartition("chunk").mapInArrow(add, shape)


def log_odds(counts: list) -> np.ndarray:
    """(PREDICTORS, slots) float32 from the collected rows, a table of fixed size."""
    out = np.zeros((PREDICTORS, 1 << SLOT_BITS), np.float32)
    flat_out = out.reshape(-1)
    for chunk, blob in counts:
        n = unpacked(blob)
        flat_out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.log((n[:, 1] + SMOOTH) / (n[:, 0] + SMOOTH))
    return np.clip(out, -CLIP, CLIP)


def window(at: int, steps: int, begin: np.ndarray, size: np.ndarray, symbols, contexts, first, code: Code, table) -> tuple:
    """(inputs, cells) of `steps` events from the `at`-th on of some texts, by event, then text.

    `begin` and `size` are the texts' first events and their numbers. Inputs are those of `mixed`. What is beyond
    a text's end has any value.
    """
    low = begin + at
    high = begin + np.minimum(size, at + steps)
    by_place, one, last = np.argsort(begin), np.empty_like(begin), np.empty_like(begin)
    one[by_place] = np.searchsorted(first, low[by_place], "right") - 1  # in order, as that is faster
    last[by_place] = np.searchsorted(first, high[by_place], "left") - 1
    many = last - one + 1
    ends = np.cumsum(many)
    which = np.repeat(one - (ends - many), many) + np.arange(ends[-1])
    at_event = first[which]
    times = first[which + 1] - at_event
    times[ends - many] -= low - first[one]
    times[ends - 1] += low + steps - first[last + 1]  # cut, or filled up beyond the end
    shape = (len(begin), steps)
    place = np.repeat(code.first[symbols[which]] - at_event, times).reshape(shape)
    place += low[:, None] + np.arange(steps)
    if size[-1] < at + steps:
        np.minimum(place, len(code.bit) - 1, out=place)
    kind = np.ascontiguousarray(code.kind.take(place).T)
    turn = TURNS.take(kind)
    cells = (kind & np.uint8(DEPTHS - 1)).astype(np.int64)
    cells += np.arange(len(begin)) * GATES
    node = code.node.take(place).reshape(-1)
    inputs = np.empty((steps, len(begin), PREDICTORS + 1), np.float32)
    for k, context in enumerate(contexts):
        slot = np.repeat(context[which], times)
        slot ^= node
        slot *= SLOT_FACTOR
        slot >>= np.uint32(32 - SLOT_BITS)
        odds = table[k].take(slot.reshape(shape).T)
        if k == 1:
            cells += (np.abs(odds) > CONFIDENT) * DEPTHS
        np.multiply(odds, turn, out=inputs[:, :, k])
    np.multiply(turn, np.float32(BIAS), out=inputs[:, :, PREDICTORS])
    return inputs, cells


def mixed(inputs: np.ndarray, cells: np.ndarray, active: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(events, texts): half the log odds against each bit; `weights` learn from a bit before the next one is met.

    A step goes over one bit of each text. `cells` are the rows of `weights` that each bit's gate selects; a text has
    its own. `active` is how many texts have the event. An input is turned against its bit and has the factor
    SCALE / 2; a weight is divided by SCALE, so it learns at the rate SCALE ** 2 without further factors.
    """
    half = np.zeros(cells.shape, np.float32)
    rows = weights.view(np.complex128).reshape(-1)  # the four weights of a cell move as one value
    for n, cell, x, z in zip(active.tolist(), cells, inputs, half, strict=True):
        cell, x, z = cell[:n], x[:n], z[:n]
        taken = rows.take(cell)
        w = taken.view(np.float32).reshape(-1, PREDICTORS + 1)
        product = w * x
        np.add(product[:, 0], product[:, 1], out=z)
        z += product[:, 2]
        z += product[:, 3]
        wrong = np.tanh(z)
        wrong += 1  # twice the probability that was not given to the bit
        w -= x * wrong.repeat(PREDICTORS + 1).reshape(x.shape)
        rows[cell] = taken
    return half


def text_bits(symbols: np.ndarray, own: np.ndarray, contexts: list, code: Code, table: np.ndarray) -> np.ndarray:
    """Total bits of each text, its end included; `own` has the texts' borders in `symbols`.

    All texts go on together, bit by bit, the longest first, so that those left over are always the first ones.
    """
    first = np.append(0, np.cumsum(code.length[symbols]))
    size = np.diff(first[own])
    order = np.argsort(-size, kind="stable")
    begin, size = first[own[:-1]][order], size[order]
    weights = np.full((len(order) * GATES, PREDICTORS + 1), START / SCALE, np.float32)
    weights[:, PREDICTORS] = 0
    out = np.zeros(len(order))
    at = 0
    while len(size) and at < size[0]:
        n = int(np.searchsorted(-size, -at))
        steps = min(max(EVENTS // n, LEAST_STEPS), MOST_STEPS, int(size[0]) - at)
        inputs, cells = window(at, steps, begin[:n], size[:n], symbols, contexts, first, code, table)
        z = 2 * mixed(inputs, cells, np.searchsorted(-size, -np.arange(at, at + steps)), weights)
        inverse = np.exp(np.clip(z, -LARGEST, LARGEST)) + 1  # the inverse of the probability of the bit
        logs = np.log(np.minimum(inverse, np.float32(1 / LEAST)))
        logs[np.arange(at, at + steps)[:, None] >= size[:n]] = 0
        out[order[:n]] += logs.sum(axis=0, dtype=np.float64)
        at += steps
    return out / math.log(2)


SHAPE = (
    "_id bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_bytes bigint, bits double, known bigint, "
    "logs double, rare array<struct<key: bigint, n: int>>"
)


def looked_up(docs: DataFrame, code, table, frequent) -> DataFrame:
    """SHAPE of each row: the mixed bits, sums over frequent words, and the other words with their counts."""

    def score(batches):
        keys, counts = frequent.value
        odds = table.value
        logs = np.log10(counts + 1.0)
        for batch in batches:
            for start, group in W.pieces(W.filled(batch.column("text")), TOGETHER):
                held, runs = [], []
                for at, part in W.pieces(group, PIECE):
                    data, borders = W.flat(part)
                    found = words_of(data, borders)
                    symbols, own = symbols_of(data, borders, found, code.value)
                    runs.append((symbols.astype(np.int32), np.diff(own), contexts_of(symbols, own)))
                    held.append((start + at, len(part), base_columns(borders, found, keys, logs)))
                symbols, sizes, *contexts = (np.concatenate(c) for c in zip(*((s, n, *c) for s, n, c in runs), strict=True))
                del runs
                bits = text_bits(symbols, np.append(0, np.cumsum(sizes)), contexts, code.value, odds)
                for at, n, (tokens, n_bytes, known, total, listed) in held:
                    own_bits = pa.array(bits[at - start : at - start + n])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).slice(at, n) for c in ("_id", "doc_id", "held_out")]
                        + [tokens, n_bytes, own_bits, known, total, listed],
                        names=["_id", "doc_id", "held_out", "n_tokens", "n_bytes", "bits", "known", "logs", "rare"],
                    )

    def base_columns(borders, found, keys, logs):
        n = len(borders) - 1
        rows, distinct, which = found[2:]
        words = distinct[which]
        place, hit = (at_word[which] for at_word in places_in(keys, distinct))
        known = np.bincount(rows[hit], minlength=n)
        total = np.bincount(rows[hit], weights=logs[place[hit]], minlength=n)
        order = np.lexsort((words[~hit], rows[~hit]))
        rare, owner = words[~hit][order], rows[~hit][order]
        first = np.ones(len(rare), dtype=bool)
        first[1:] = (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(first)
        times = np.diff(np.append(begin, len(rare))).astype(np.int32)
        listed = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner[begin], np.arange(n + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(rare[begin]), pa.array(times)], names=["key", "n"]),
        )
        return pa.array(np.bincount(rows, minlength=n) + 1), pa.array(np.diff(borders)), pa.array(known), pa.array(total), listed

    return docs.mapInArrow(score, SHAPE.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def most_frequent(words: DataFrame, most: int = FREQUENT) -> tuple:
    """(sorted keys, counts) of the words counted at least so often that at most `most` words are."""
    classes = words.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("size"))
    least, total = 62, 0
    for power, size in sorted(classes.collect(), reverse=True):  # 64 rows at most
        if total + size > most:
            break
        least, total = power, total + size
    rows = words.where(F.col("n") >= F.lit(1 << least).cast("bigint")).select("key", "n").toArrow()
    keys, counts = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def scored(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    `score` is the model's log10 probability of the whole text and its end. Null texts are empty; null
    ids count as an empty id when folds are drawn; repeated rows are each learned from and scored. With no
    training text the code and all odds are even. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.monotonically_increasing_id().alias("_id"), "doc_id", (~is_training()).alias("held_out"), "text")
    training = base.where("NOT held_out")
    counts = written(counted(training), "lm-counts")
    words = counts.where("kind = 0").select("key", "n")
    sums = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, distinct = sums["tokens"] or 0, sums["distinct"]
    ends = words.where(F.col("key") == END_WORD).agg(F.sum("n")).first()[0] or 0
    top = most_frequent(words.where(F.col("key") != END_WORD), frequent)
    in_bytes = dict(counts.where("kind = 1").select("key", "n").collect())  # 256 rows
    code = spark.sparkContext.broadcast(Code(in_bytes, ends, *top, tokens))
    table = log_odds(slot_counts(training, code).collect())  # PREDICTORS << SLOT_BITS slots
    found = written(
        looked_up(base, code, spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(top)), "lm-texts"
    )
    rare = found.select("_id", F.explode("rare").alias("w")).select("_id", "w.key", F.col("w.n").alias("times"))
    met = rare.join(words, "key").groupBy("_id").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_logs")
    )
    per_token = math.log10(tokens + distinct + 1)
    return found.drop("rare").join(met, "_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (
            F.col("logs") + F.coalesce("_logs", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * per_token
        ).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
