"""Native n-gram scorer: weights learned from labelled documents, scores summed per document.

Weights and scores are BIGINT micro-units of log-odds, so sums do not depend on their order. The
vocabulary is that of the labelled documents; a gram outside it has the weight of a gram seen in
neither class. A model is therefore fixed by its training rows and stored scores stay valid.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quality_probe.functions import text as T
from quality_probe.functions.heads import MICRO, exact_ratio
from quality_probe.operators import bloom, packed
from quality_probe.operators.packed import NO_CHUNK
from quality_probe.operators.sizes import BROADCAST_BYTES, BROADCAST_ROWS, is_small
from quality_probe.scratch import written

# Label cells: count columns of a gram in documents of (quality, toxic).
CELLS = {"n00": (0, 0), "n01": (0, 1), "n10": (1, 0), "n11": (1, 1)}

UNIGRAMS, BIGRAMS, ALL = "unigrams", "bigrams", "all"

# Weight tables: grams used, cells of the positive class, cells of the negative class.
WEIGHTS = {
    "quality": (ALL, ["n10", "n11"], ["n00", "n01"]),
    "toxic": (ALL, ["n01", "n11"], ["n00", "n10"]),
    "good": (ALL, ["n10"], ["n00", "n01", "n11"]),
    "poor": (ALL, ["n00", "n01"], ["n10", "n11"]),
    "mixed": (ALL, ["n11"], ["n00", "n01", "n10"]),
    "clean_quality": (ALL, ["n10"], ["n00"]),  # learned from documents that are not toxic
    "contrast_quality": (ALL, ["n10"], ["n01"]),  # the best against the worst
    "word_quality": (UNIGRAMS, ["n10", "n11"], ["n00", "n01"]),
    "pair_quality": (BIGRAMS, ["n10", "n11"], ["n00", "n01"]),
    "word_toxic": (UNIGRAMS, ["n01", "n11"], ["n00", "n10"]),
}

# Signals: text view and weight table behind one logit.
FULL, CHUNKS = "full", "chunks"
SIGNALS = {
    "full_quality": (FULL, "quality"),
    "full_toxic": (FULL, "toxic"),
    "full_good": (FULL, "good"),
    "full_poor": (FULL, "poor"),
    "full_mixed": (FULL, "mixed"),
    "full_clean": (FULL, "clean_quality"),
    "full_contrast": (FULL, "contrast_quality"),
    "chunk_word_quality": (CHUNKS, "word_quality"),
    "chunk_pair_quality": (CHUNKS, "pair_quality"),
    "chunk_word_toxic": (CHUNKS, "word_toxic"),
}

# Grams of more text than this are counted and looked up by hash, in packed rows.
PACKED_BYTES = 64 << 20

# At most so many frequent grams, none longer than so many bytes, are sent out of a larger vocabulary.
HOT_GRAMS = 500_000
HOT_BYTES = 128
RUN = 1 << 20  # grams that a task looks up at once
HOTTEST = 100_000  # at most so many grams that are hot in what is left


def tokens(text: Column) -> Column:
    return T.words(F.lower(text))


def grams(words: str) -> str:
    """SQL of the words, then the pairs of neighbours."""
    shorter = f"greatest(size({words}) - 1, 0)"
    pairs = f"zip_with(slice({words}, 1, {shorter}), slice({words}, 2, {shorter}), (a, b) -> concat(a, ' ', b))"
    return f"concat({words}, {pairs})"


@dataclass(frozen=True)
class NgramModel:
    """Cell counts per gram and their totals (a few numbers).

    Cells are a written table. With a packed `vocabulary`, which is one too, they are not and are made when asked for.
    """

    cells: DataFrame
    totals: dict  # grams used -> {"n00", .., "n11", "vocabulary", "bytes"}; no bytes with a packed vocabulary
    vocabulary: DataFrame = None

    def total(self, weight: str, cells: list) -> int:
        return sum(self.totals[WEIGHTS[weight][0]][c] for c in cells)

    def log_odds(self, weight: str, positive: str, negative: str) -> str:
        used, pos, neg = WEIGHTS[weight]
        vocabulary = self.totals[used]["vocabulary"]

        def share(count, cells):
            return f"ln(cast({count} + 1 AS double) / {self.total(weight, cells) + vocabulary}D)"

        return f"cast(rint({MICRO}D * ({share(positive, pos)} - {share(negative, neg)})) AS bigint)"

    def weight(self, weight: str) -> str:
        """SQL of the weight of a row of `cells`; null for a gram that the table does not use."""
        used, pos, neg = WEIGHTS[weight]
        value = self.log_odds(weight, " + ".join(pos), " + ".join(neg))
        return value if used == ALL else f"CASE WHEN is_pair = {str(used == BIGRAMS).lower()} THEN {value} END"

    def unseen(self, weight: str) -> str:
        return self.log_odds(weight, "0", "0")

    def weights(self, names=tuple(WEIGHTS)) -> DataFrame:
        return self.cells.selectExpr("gram", *[f"{self.weight(n)} AS {n}" for n in names])

    def lifts(self, names) -> DataFrame:
        """Weights above the unseen gram's, so that grams without a row add nothing to a sum."""
        return self.cells.selectExpr("gram", *[f"{self.weight(n)} - {self.unseen(n)} AS {n}" for n in names])

    def lift_numbers(self, names):
        """`lifts` of a (4, n) matrix of cell counts, given which grams are pairs: an array a name."""
        cells, shares = list(CELLS), []
        for name in names:
            used, pos, neg = WEIGHTS[name]
            sizes = [self.total(name, side) + self.totals[used]["vocabulary"] for side in (pos, neg)]
            shares.append((used, [cells.index(c) for c in pos], [cells.index(c) for c in neg], *sizes))

        def weight(positive, negative, positives, negatives):
            return np.rint(MICRO * (np.log((positive + 1) / positives) - np.log((negative + 1) / negatives)))

        def lifts(counts, is_pair):
            made, none = [], np.zeros(1)
            for used, pos, neg, *sizes in shares:
                lift = weight(counts[pos].sum(axis=0), counts[neg].sum(axis=0), *sizes) - weight(none, none, *sizes)
                made.append(lift if used == ALL else np.where(is_pair == (used == BIGRAMS), lift, 0))
            return made

        return lifts


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> NgramModel:
    """Count the grams of the labelled documents in the four label cells.

    Counts are combined inside each task before the shuffle, so a frequent gram costs one row a task. Labels within
    the bounds are sent out; of more, a Bloom filter of their keys is, so that hardly any other text moves. Grams of much
    text are counted by hash.
    """
    marks, texts = labels.select(key, "quality", "toxic"), docs.select(key, "text")
    if is_small(marks):
        labelled = texts.join(F.broadcast(marks), key)
    else:
        keys = bloom.filter_of(marks, key, marks.count())
        labelled = bloom.marked(texts, key, keys, "_maybe").filter("_maybe").drop("_maybe").join(marks, key)
    exploded = labelled.select("quality", "toxic", tokens("text").alias("words")).select(
        "quality", "toxic", F.expr(f"explode({grams('words')})").alias("gram")
    )
    counts = [F.expr(f"count_if(quality = {q} AND toxic = {t}) AS {cell}") for cell, (q, t) in CELLS.items()]
    cells = exploded.groupBy("gram").agg(*counts).selectExpr("*", "instr(gram, ' ') > 0 AS is_pair")
    if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > PACKED_BYTES:
        vocabulary = packed.counted(labelled, tokens(F.col("text")))
        return NgramModel(cells, packed_totals(vocabulary), vocabulary)
    cells = written(cells, "grams")
    sums = [F.sum(c).alias(c) for c in CELLS]
    sizes = [F.count("*").alias("vocabulary"), F.sum(F.octet_length("gram")).alias("bytes")]
    found = {row["is_pair"]: row.asDict() for row in cells.groupBy("is_pair").agg(*sums, *sizes).collect()}
    numbers = [*CELLS, "vocabulary", "bytes"]
    kinds = {
        kind: {n: found.get(pair, {}).get(n) or 0 for n in numbers}
        for kind, pair in ((UNIGRAMS, False), (BIGRAMS, True))
    }
    kinds[ALL] = {n: kinds[UNIGRAMS][n] + kinds[BIGRAMS][n] for n in numbers}
    return NgramModel(cells, kinds)


def packed_totals(vocabulary: DataFrame) -> dict:
    kinds = {
        kind: {**dict(zip(CELLS, sums, strict=True)), "vocabulary": size}
        for kind, (size, sums) in zip((UNIGRAMS, BIGRAMS), packed.sums_of(vocabulary), strict=True)
    }
    kinds[ALL] = {n: kinds[UNIGRAMS][n] + kinds[BIGRAMS][n] for n in kinds[UNIGRAMS]}
    return kinds


def occurrences(docs: DataFrame, key: str) -> DataFrame:
    """One row per gram occurrence with its segment: the chunk of CHUNK_WORDS words that it lies in."""
    word = "if(pos >= n, pos - n + 1, pos)"  # the gram's last word
    crosses = f"pos >= n AND ({word}) % {T.CHUNK_WORDS} = 0"
    return (
        docs.select(key, tokens(F.col("text")).alias("words"))
        .selectExpr(key, "size(words) AS n", f"posexplode_outer({grams('words')}) AS (pos, gram)")
        .selectExpr(
            key,
            "gram",
            "cast(pos >= n AS int) AS is_pair",
            f"CASE WHEN {crosses} THEN {NO_CHUNK}L ELSE ({word}) div {T.CHUNK_WORDS} END AS segment",
        )
    )


def frequent_from(cells: DataFrame, limit: int) -> int:
    """A count such that at most `limit` grams reach it; found among powers of two."""
    sizes = cells.selectExpr(f"cast(floor(log2({' + '.join(CELLS)})) AS int) AS power").groupBy("power").count()
    reached, power = 0, 64
    for row in sorted(sizes.collect(), reverse=True):  # at most 64 rows
        reached += row["count"]
        if reached > limit:
            break
        power = row["power"]
    return 1 << power


def looked_up(docs: DataFrame, model: NgramModel, names: list, key: str) -> DataFrame:
    """Sums and gram counts of each segment, by a vocabulary within the bounds that is sent to every task."""
    rows = occurrences(docs, key).join(F.broadcast(model.lifts(names)), "gram", "left")
    return rows.groupBy(key, "segment").agg(*gram_counts(), *[F.sum(n).alias(n) for n in names])


def gram_counts() -> list:
    return [F.expr(f"{sql} AS {name}") for name, sql in (
        (ALL, "count(gram)"), (BIGRAMS, "count_if(is_pair = 1)"), (UNIGRAMS, "count_if(is_pair = 0)")
    )]


def lookup_tables(known: DataFrame, vocabulary: DataFrame, names: list) -> tuple:
    """(sorted hashes of the frequent grams, their lifts, words of the Bloom filter), all of bounded size."""
    found = known.select(F.xxhash64("_gram").alias("_hash"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names]).toArrow()
    hashes = found.column("_hash").to_numpy()
    order = np.argsort(hashes)
    lifts = [found.column(n).to_numpy()[order] for n in names]
    words = vocabulary.orderBy("_array").select("words").toArrow().column("words").combine_chunks()
    return hashes[order], lifts, words.flatten().to_numpy().reshape(-1, bloom.WORDS)


def settled_segments(docs: DataFrame, known: DataFrame, vocabulary: DataFrame, names: list, key: str) -> DataFrame:
    """Gram counts and sums over frequent grams of each segment, and the grams that stay open as `_open`.

    A text's grams are in one task, so nothing is sorted or shuffled. Frequent grams are told by 64-bit hashes: that
    any of 10^9 different grams is taken for one of HOT_GRAMS others has a chance of 3 in 10^5. Open grams are strings.
    """
    tables = docs.sparkSession.sparkContext.broadcast(lookup_tables(known, vocabulary, names))
    counts = [ALL, BIGRAMS, UNIGRAMS]

    def settle(batches):
        hashes, lifts, filter_words = tables.value
        for batch in batches:
            texts, grams_of = batch.column("words"), batch.column("hashes")
            word_at, gram_at = texts.offsets.to_numpy(), grams_of.offsets.to_numpy()
            low = 0
            while low < len(texts):  # whole texts, about RUN grams at a time
                high = max(low + 1, int(np.searchsorted(gram_at, gram_at[low] + RUN, "right")) - 1)
                first, values = word_at[low], texts.values.slice(word_at[low], word_at[high] - word_at[low])
                found = grams_of.values.slice(gram_at[low], gram_at[high] - gram_at[low]).to_numpy()
                rows = settled_run(word_at[low : high + 1] - first, values, found, hashes, lifts, filter_words)
                owner, segment, numbers, sums, grams = rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(low + owner)), segment, *map(pa.array, numbers), *map(pa.array, sums), grams],
                    names=[key, "segment", *counts, *names, "_open"],
                )
                low = high

    split = docs.select(key, F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    hashed = split.withColumn("hashes", F.expr(f"transform({grams('words')}, g -> xxhash64(g))"))
    numbers = ", ".join(f"`{c}` bigint" for c in [*counts, *names])
    shape = f"`{key}` {docs.schema[key].dataType.simpleString()}, segment bigint, {numbers}, _open array<string>"
    return hashed.mapInArrow(settle, shape)


def settled_run(borders: np.ndarray, words: pa.Array, found: np.ndarray, hashes, lifts, filter_words) -> tuple:
    """(text, segment, counts, sums, open grams) of each segment of some texts; one without words has a null segment.

    `borders` are those of the texts in `words`, `found` the hashes of their grams, pairs after the words of a text.
    """
    n = np.diff(borders)
    size = n + np.maximum(n - 1, 0)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n)), size)
    position = np.arange(len(row)) - start[row]
    is_pair = position >= n[row]
    word = np.where(is_pair, position - n[row] + 1, position)  # the gram's last word
    chunks = -(-n // T.CHUNK_WORDS)
    segments = np.maximum(chunks, 1) + (chunks > 1)  # the last of several is that of pairs over borders
    base = np.cumsum(segments) - segments
    crosses = is_pair & (word % T.CHUNK_WORDS == 0)
    segment = base[row] + np.where(crosses, chunks[row], word // T.CHUNK_WORDS)
    total = int(segments.sum())
    owner = np.repeat(np.arange(len(n)), segments)
    number = np.arange(total) - base[owner]
    number[(number > 0) & (number == chunks[owner])] = NO_CHUNK
    pairs = np.bincount(segment[is_pair], minlength=total)
    singles = np.bincount(segment[~is_pair], minlength=total)

    place = np.searchsorted(hashes, found)
    place[place == len(hashes)] = 0
    hit = hashes[place] == found if len(hashes) else np.zeros(len(found), bool)
    at, which = segment[hit], place[hit]
    # sums of integers far below 2^53 are exact
    sums = [np.bincount(at, weights=lift[which], minlength=total).astype(np.int64) for lift in lifts]

    left = np.flatnonzero(~hit)
    left = left[bloom.in_hashes(found[left], filter_words)]
    left = left[np.argsort(segment[left], kind="stable")]
    last = borders[:-1][row[left]] + word[left]
    pair = is_pair[left]
    both = pc.binary_join_element_wise(words.take(pa.array(last[pair] - 1)), words.take(pa.array(last[pair])), " ")
    order = np.empty(len(left), np.int64)
    order[np.append(np.flatnonzero(~pair), np.flatnonzero(pair))] = np.arange(len(left))
    grams_left = pa.concat_arrays([words.take(pa.array(last[~pair])), both]).take(pa.array(order))
    ends = np.append(0, np.cumsum(np.bincount(segment[left], minlength=total))).astype(np.int32)
    return (
        owner, pa.array(number, mask=n[owner] == 0), [singles + pairs, pairs, singles], sums,
        pa.ListArray.from_arrays(pa.array(ends), grams_left),
    )


def hot_grams(settled: DataFrame) -> DataFrame:
    """gram: open grams of more than 1 in 2 * HOTTEST of all open occurrences, and all of more than 3 in 2 * HOTTEST.

    What is not hot in a batch of rows is not counted there, so a gram may be counted short by 1 in HOTTEST. Only the
    grams that are hot in a batch are shuffled.
    """
    most = HOTTEST

    def count(batches):
        for batch in batches:
            opened = batch.column("_open").flatten()
            found = opened.value_counts()
            found = found.filter(pc.greater(found.field("counts"), len(opened) // most))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["gram", "n"])

    total = settled.agg(F.sum(F.size("_open"))).first()[0] or 0
    counted = settled.select("_open").mapInArrow(count, "gram string, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > total // (2 * most)).select("gram")


def split_looked_up(docs: DataFrame, model: NgramModel, names: list, key: str) -> DataFrame:
    """The same sums by a vocabulary of any size; texts are read once.

    Each text is settled as far as it can be where it is read: grams are looked up among the frequent ones, which are
    sent out, and unknown grams fall to a Bloom filter: they count, but add nothing to a sum. Only what is left open
    is written, and looked up by a join. Of that, grams that are hot by their count in it are few, so they are sent
    out too.
    """
    frequent = f"{' + '.join(CELLS)} >= {frequent_from(model.cells, HOT_GRAMS)} AND octet_length(gram) <= {HOT_BYTES}"
    known = NgramModel(model.cells.filter(frequent), model.totals).lifts(names).withColumnRenamed("gram", "_gram")
    others = NgramModel(model.cells.filter(f"NOT ({frequent})"), model.totals)
    hashes = others.cells.select(F.xxhash64("gram").alias("_hash"))
    vocabulary, _ = bloom.filter_of(hashes, "_hash", model.totals[ALL]["vocabulary"], bloom.place_by_hash)
    settled = written(settled_segments(docs, known, vocabulary, names, key), "settled-segments")
    rows = settled.select(key, "segment", F.explode("_open").alias("gram"))
    often = hot_grams(settled)
    lifts = others.lifts(names)
    hot = written(lifts.join(F.broadcast(often), "gram", "left_semi"), "hot-grams")
    sent = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "gram", "left")
    joined = sent.filter("_hot IS NULL").select(key, "segment", "gram").join(lifts, "gram")
    summed = [F.sum(n).alias(n) for n in names]
    late = sent.filter("_hot").select(key, "segment", *names).unionByName(joined.select(key, "segment", *names))
    late = late.groupBy(key, "segment").agg(*summed)
    counts = [ALL, BIGRAMS, UNIGRAMS]
    return settled.drop("_open").unionByName(late, allowMissingColumns=True).groupBy(key, "segment").agg(
        *[F.sum(c).alias(c) for c in counts], *summed
    )


def ratio_columns(signals) -> list:
    """The exact ratio behind each signal: its parts, and its sortable key."""
    return [f"{s}_{part}" for s in signals for part in ("total", "grams", "high", "low")]


def score_signals(docs: DataFrame, model: NgramModel, signals=tuple(SIGNALS), carry=("id",),
                  max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, exact: bool = False) -> DataFrame:
    """Mean log-odds per gram of each document, one BIGINT column per signal; null without grams.

    With `exact`, the columns of `ratio_columns` too.

    Texts are read once for all signals; occurrences are summed in the task that made them, under
    one narrow key (`doc_pos`, else the first of `carry`). The other columns to carry are joined to
    the sums, one row per document.
    """
    key = "doc_pos" if "doc_pos" in docs.columns else carry[0]
    size = model.totals[ALL]
    broadcastable = model.vocabulary is None and size["vocabulary"] <= max_rows and size["bytes"] <= max_bytes
    made = [*signals, *(ratio_columns(signals) if exact else [])]
    found = summed_signals(docs, model, signals, key, broadcastable).select(key, *made)
    if list(carry) == [key]:
        return found
    return docs.select(*dict.fromkeys([key, *carry])).join(found, key).select(*carry, *made)


def summed_signals(docs: DataFrame, model: NgramModel, signals, key: str, broadcastable: bool) -> DataFrame:
    names = list(dict.fromkeys(SIGNALS[s][1] for s in signals))
    if model.vocabulary is not None:
        words, lifts = tokens(F.col("text")), model.lift_numbers(names)
        by_segment = packed.summed(docs, model.vocabulary, words, key, names, lifts, [ALL, BIGRAMS, UNIGRAMS])
    else:
        by_segment = (looked_up if broadcastable else split_looked_up)(docs, model, names, key)
    unseen = [f"{model.unseen(n)} AS unseen_{n}" for n in names]
    sums, parts = [], []
    for signal in signals:
        view, weight = SIGNALS[signal]
        used = WEIGHTS[weight][0]
        if view == FULL:
            total, count = f"coalesce(sum({weight}), 0)", f"sum(`{used}`)"
            sums.append(F.expr(f"{total} + {count} * max(unseen_{weight}) AS {signal}_total"))
            sums.append(F.expr(f"{count} AS {signal}_grams"))
            parts += [f"{signal}_total", f"{signal}_grams"]
        else:  # the best chunk
            total = f"(coalesce({weight}, 0) + `{used}` * unseen_{weight})"
            high, low = exact_ratio(total, f"`{used}`")
            best = f"named_struct('high', {high}, 'low', {low}, 'total', {total}, 'grams', `{used}`)"
            sums.append(F.expr(f"max(CASE WHEN segment <> {NO_CHUNK} AND `{used}` > 0 THEN {best} END) AS {signal}_best"))
            parts += [f"{signal}_best.total AS {signal}_total", f"{signal}_best.grams AS {signal}_grams"]
    summed = by_segment.selectExpr("*", *unseen).groupBy(key).agg(*sums).selectExpr(key, *parts)
    made = []
    for signal in signals:
        high, low = exact_ratio(f"{signal}_total", f"{signal}_grams")
        made += [f"{signal}_total div nullif({signal}_grams, 0) AS {signal}", f"{signal}_total", f"{signal}_grams",
                 f"{high} AS {signal}_high", f"{low} AS {signal}_low"]
    return summed.selectExpr(key, *made)
