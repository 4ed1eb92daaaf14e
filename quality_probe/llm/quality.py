"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each text gives a vector of transformed shares. For each (lang, source) the minimum covariance
determinant is approached by concentration steps (keep the COVERAGE share of different texts nearest by
Mahalanobis distance, take their mean and covariance, repeat while the determinant falls) from several
starts: coordinatewise medians and spreads, and the best of TRIES random subsets of a sample. The start
with the least determinant gives the estimate. A document is rejected when its squared distance from it
exceeds CUT.

Steps are partial aggregates (a quantile sketch and sums of products), so a source that holds a third
of all rows stays spread over tasks; only the sample and a row of sums per start are gathered from a group.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quality_probe.llm import words as W
from quality_probe.operators.sizes import BROADCAST_ROWS, broadcast_if_small, gathered
from quality_probe.scratch import written

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8)
MARKS = np.frombuffer(b"!?.,;:\"'()[]{}-_=+/\\@^~`", np.uint8)

DIMENSIONS = ["word_length", "symbols", "dup_lines", "repeats", "capitals", "marks"]
# Spreads below these (in transformed units) count as these: most clean texts have exactly no symbol.
FLOORS = [0.10, 0.04, 0.15, 0.15, 0.05, 0.05]
COVERAGE = 0.5
CONSISTENCY = 1.7845  # COVERAGE / P(chi2(8) <= q), q the COVERAGE quantile of chi2(6)
SAMPLE = 1000  # rows of a group among which starts are sought
TRIES = 200
STARTS = 3  # of these that go over all rows, beside the one of medians
FALL = 1e-4  # less is no fall of a log determinant
MIN_GROUP = 100  # smaller groups share their language's estimate, then one for the rest, then that of all
ALL = "all"
CUT = 22.46  # 99.9 % quantile of chi2(6)
ACCURACY = 2000
STARTS_A_TASK = 32  # whose sums and limits one task puts together
KEYS = ["_group", "_start"]
ESTIMATE = "_group string, _start int, centre array<double>, inverse array<double>"

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def per_row(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[borders[1:]] - total[borders[:-1]]


def of_kind(values: np.ndarray) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[values] = True
    return table


IS_SYMBOL, IS_MARK = of_kind(SYMBOLS), of_kind(MARKS)
IS_CAPITAL = of_kind(np.arange(65, 91))


def repeated(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which entries occur again in the same row."""
    keys = W.mixed(hashes ^ W.mixed(rows.astype(np.uint64)))
    order = np.argsort(keys)
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    found = np.zeros(len(keys), dtype=bool)
    found[order[1:][equal]] = True
    found[order[:-1][equal]] = True
    return found


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    keys = W.mixed(hashes ^ W.mixed(rows.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(rows[first], minlength=n)


def counts(texts: pa.Array) -> dict:
    """Base counts and the shares behind DIMENSIONS for one piece of a filled column."""
    data, borders = W.flat(texts)
    n = len(texts)
    starts, ends, rows = W.spans(data, borders)
    n_words = np.bincount(rows, minlength=n)
    solid = W.SOLID[data]
    points = solid & ((data & 0xC0) != 0x80)
    word_chars = per_row(points, borders)
    n_symbols = per_row(IS_SYMBOL[data], borders)
    n_marks = per_row(IS_MARK[data], borders)
    n_capitals = per_row(IS_CAPITAL[data], borders)

    breaks = np.flatnonzero(data == 0x0A)
    # a border is a line start; so is the byte after a line feed
    line_starts = np.unique(np.concatenate([borders[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    if len(line_starts):
        line_ends = line_ends - (data[line_ends - 1] == 0x0A)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    worded = total[line_ends] > total[line_starts]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_rows = np.searchsorted(borders, line_starts, "right") - 1
    lines = np.bincount(line_rows, minlength=n)
    hashes = W.span_hashes(data, line_starts, line_ends)
    n_dup = lines - distinct_per_row(hashes, line_rows, n)

    again = np.zeros(len(starts) + 2, dtype=bool)
    if len(starts) >= 3:
        word_hashes = W.span_hashes(data, starts, ends)
        triples, triple_rows = W.window_hashes(word_hashes, rows, 3, whole=False)
        at = np.flatnonzero(rows[2:] == rows[:-2])[repeated(triples, triple_rows)]
        for step in range(3):
            again[at + step] = True
    n_repeat = np.bincount(rows, weights=again[: len(rows)], minlength=n).astype(np.int64)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat, "lines": lines, "marks": n_marks, "capitals": n_capitals,
    }


def vector(c: dict) -> np.ndarray:
    """The transformed statistics, one row per text: a log, and arcsine roots of shares."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)

    def share(part, of):
        return np.arcsin(np.sqrt(np.clip(part / np.maximum(of, 1), 0, 1)))

    return np.stack([
        np.log(chars / words), share(c["n_symbols"], chars), share(c["n_dup_lines"], c["lines"]),
        share(c["n_repeat_words"], words), share(c["capitals"], chars), share(c["marks"], chars),
    ], axis=1)


def measured(docs: DataFrame, keys: list) -> DataFrame:
    """`keys` of each document with its base counts and DIMENSIONS."""

    def measure(batches):
        for batch in batches:
            for row, part in W.pieces(W.filled(batch.column("_text"))):
                found = counts(part)
                x = vector(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(row, len(part)) for k in keys]
                    + [pa.array(found[c.split()[0]].astype(np.int64)) for c in COUNTS.split(", ")]
                    + [pa.array(x[:, i]) for i in range(len(DIMENSIONS))],
                    names=[*keys, *(c.split()[0] for c in COUNTS.split(", ")), *DIMENSIONS],
                )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    shape = f"{kinds}, {COUNTS}, " + ", ".join(f"{d} double" for d in DIMENSIONS)
    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(measure, shape)


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance from `centre` by the `inverse` matrix (both arrays)."""
    p = len(DIMENSIONS)
    d = [F.col(f"{prefix}{name}") - F.col("centre")[i] for i, name in enumerate(DIMENSIONS)]
    terms = [d[i] * d[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def spread(mean: np.ndarray, product: np.ndarray) -> np.ndarray:
    """The covariance: consistent for the kept share of a normal sample, then a floor on every axis."""
    return (product - np.outer(mean, mean)) * CONSISTENCY + np.diag(np.array(FLOORS) ** 2)


def inverted(sums: DataFrame) -> DataFrame:
    """(KEYS, centre, inverse, log_det) from counts, sums and products: a row per group and start."""
    p = len(DIMENSIONS)

    def invert(frames):
        for frame in frames:
            centres, inverses, sizes = [], [], []
            for n, s, q in zip(frame["n"], frame["s"], frame["q"], strict=True):
                mean = np.array(s) / n
                product = np.zeros((p, p))
                product[np.triu_indices(p)] = np.array(q) / n
                covariance = spread(mean, product + np.triu(product, 1).T)
                centres.append(mean)
                inverses.append(np.linalg.inv(covariance).ravel())
                sizes.append(np.linalg.slogdet(covariance)[1])
            yield frame[KEYS].assign(centre=centres, inverse=inverses, log_det=sizes)

    return sums.mapInPandas(invert, f"{ESTIMATE}, log_det double")


def product_sums(rows: DataFrame) -> DataFrame:
    p = len(DIMENSIONS)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    col = [F.col(d) for d in DIMENSIONS]
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(col)],
        *[F.sum(col[i] * col[j]).alias(f"q{i}_{j}") for i, j in pairs],
    ).select(
        *KEYS, "n", F.array(*[f"s{i}" for i in range(p)]).alias("s"),
        F.array(*[f"q{i}_{j}" for i, j in pairs]).alias("q"),
    )


def started(rows: DataFrame) -> DataFrame:
    """Coordinatewise medians and spreads (half of the middle 68 %) of each group."""
    found = rows.groupBy("_group").agg(*[
        F.percentile_approx(d, [0.16, 0.5, 0.84], ACCURACY).alias(d) for d in DIMENSIONS
    ])
    p = len(DIMENSIONS)
    zero = F.lit(0.0)
    inverse = [
        1 / (F.pow((F.col(DIMENSIONS[i])[2] - F.col(DIMENSIONS[i])[0]) / 2, 2) + FLOORS[i] ** 2) if i == j else zero
        for i in range(p) for j in range(p)
    ]
    return found.select(
        "_group", F.lit(0).alias("_start"), F.array(*[F.col(d)[1] for d in DIMENSIONS]).alias("centre"),
        F.array(*inverse).alias("inverse"),
    )


def best_of_sample(x: np.ndarray) -> list:
    """(centre, inverse) of the STARTS least determinants that random subsets of p + 1 rows lead to."""
    rng = np.random.default_rng(len(x))
    x = x[np.lexsort(x.T)]  # the same whatever order the rows came in
    n, p = x.shape
    half = min(n, max(math.ceil(n * COVERAGE), p + 1))

    def estimate(rows):
        mean = rows.mean(axis=0)
        covariance = spread(mean, rows.T @ rows / len(rows))
        return np.linalg.slogdet(covariance)[1], mean, np.linalg.inv(covariance)

    def step(found):
        d = x - found[1]
        return estimate(x[np.argsort(np.einsum("ij,ij->i", d @ found[2], d), kind="stable")[:half]])

    tried = [step(step(estimate(x[rng.permutation(n)[: p + 1]]))) for _ in range(TRIES)]
    out = {}
    for found in sorted(tried, key=lambda t: t[0])[:STARTS]:
        while (better := step(found))[0] < found[0] - FALL:
            found = better
        out[round(found[0], 3)] = found
    return [(mean, inverse.ravel()) for _, mean, inverse in out.values()]


def sampled_starts(rows: DataFrame) -> DataFrame:
    """Starts of each group from about SAMPLE of its rows, chosen by their hash."""

    def search(key, frame):
        found = best_of_sample(frame[DIMENSIONS].to_numpy())
        return pd.DataFrame({
            "_group": [key[0]] * len(found), "_start": range(1, len(found) + 1),
            "centre": [c for c, _ in found], "inverse": [i for _, i in found],
        })

    sizes = rows.groupBy("_group").agg(F.count("*").alias("n"))
    chosen = rows.join(broadcast_if_small(sizes), "_group").where(
        F.pmod(F.xxhash64("_copy"), F.col("n")) < SAMPLE
    )
    return chosen.select("_group", *DIMENSIONS).groupBy("_group").applyInPandas(search, ESTIMATE)


def estimates(rows: DataFrame) -> DataFrame:
    """(_group, centre, inverse) of the least determinant found over rows (_group, _copy, DIMENSIONS).

    Every start takes concentration steps over all rows until its determinant stops falling. Rows of one
    `_copy` count once in a group: copies of a text tell nothing about the spread, and a point that holds
    many rows would make the determinant small wherever it lies.
    """
    rows = written(rows.select("_group", "_copy", *DIMENSIONS).distinct(), "mcd-rows")
    starts = started(rows).unionByName(sampled_starts(rows))
    found = written(starts.select("*", F.lit(math.inf).alias("log_det"), F.lit(True).alias("falls")), "mcd")
    while left := found.where("falls").count():
        falling = found.where("falls").select(*KEYS, "centre", "inverse")
        sent = F.broadcast if left <= BROADCAST_ROWS else lambda df: df
        near = rows.join(sent(falling), "_group").withColumn("_d", distance())
        limits = near.groupBy(*KEYS).agg(F.percentile_approx("_d", COVERAGE, ACCURACY).alias("_limit"))
        limited = written(falling.join(sent(gathered(limits, left, STARTS_A_TASK)), KEYS), "mcd-limits")
        kept = rows.join(sent(limited), "_group").withColumn("_d", distance()).where("_d <= _limit")
        stepped = inverted(gathered(product_sums(kept), left, STARTS_A_TASK))
        better = F.coalesce(F.col("s.log_det") < F.col("f.log_det") - FALL, F.lit(False))
        found = written(
            found.alias("f").join(sent(stepped).alias("s"), KEYS, "left").select(
                *KEYS, *[F.when(better, F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
                         for c in ("centre", "inverse", "log_det")],
                better.alias("falls"),
            ),
            "mcd",
        )
    least = found.groupBy("_group").agg(F.min_by(F.struct("centre", "inverse"), F.struct("log_det", "_start")).alias("_e"))
    return written(least.select("_group", "_e.centre", "_e.inverse"), "mcd")


def grouped(rows: DataFrame) -> DataFrame:
    """Add _group: language and source; for few texts the language's rest; for few again the rest of all.

    Sizes are those of what an estimate is made from, the different texts that passed the base rules. Where the rest of all is too small as well, its documents are of the group of ALL.
    """

    def named(*columns):
        return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in columns]))

    narrow = rows.withColumn("_own", named("lang", "source")).withColumn("_lang", named("lang"))
    sound = narrow.where("NOT base_failed")

    def large(texts, by):
        sizes = texts.select(by, "_copy").distinct().groupBy(by).agg(F.count("*").alias("n"))
        return written(sizes.where(F.col("n") >= MIN_GROUP).select(by, F.lit(True).alias(f"{by}_large")), "mcd-groups")

    def with_flag(df, sizes, by):
        return df.join(broadcast_if_small(sizes, by), by, "left")

    owns = large(sound, "_own")
    pooled = with_flag(sound, owns, "_own").where("_own_large IS NULL")
    langs = large(pooled, "_lang")
    rest = with_flag(pooled, langs, "_lang").where("_lang_large IS NULL")
    enough = rest.select("_copy").distinct().limit(MIN_GROUP).count() == MIN_GROUP
    flagged = with_flag(with_flag(narrow, owns, "_own"), langs, "_lang")
    return flagged.withColumn(
        "_group",
        F.when(F.col("_own_large"), F.col("_own")).when(F.col("_lang_large"), F.col("_lang"))
        .otherwise(F.lit("rest" if enough else ALL)),
    ).drop("_own", "_lang", "_own_large", "_lang_large")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept, distance of every document.

    Null texts have no words and fail the base rules; null languages and sources are groups of their
    own; groups with fewer than MIN_GROUP texts pool (see `grouped`), and what still falls short is
    judged by all sound rows of the corpus; only where these are fewer, the base rules alone apply.
    Repeated rows are judged each; an empty table gives no rows; columns other than doc_id, text, lang
    and source are not read.
    """
    base = docs.select("doc_id", "lang", "source", "text", F.xxhash64("text").alias("_copy"))
    stats = written(measured(base, ["doc_id", "lang", "source", "_copy"]), "quality-stats")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = grouped(stats.withColumn("base_failed", failed))
    sound = rows.where(~F.col("base_failed")).select("_group", "_copy", *DIMENSIONS)
    members = sound.where(F.col("_group") != ALL)
    short = not sound.where(F.col("_group") == ALL).isEmpty()
    if short and sound.select("_copy").distinct().limit(MIN_GROUP).count() == MIN_GROUP:
        members = members.unionByName(sound.withColumn("_group", F.lit(ALL)))
    found = broadcast_if_small(estimates(members))
    scored = rows.join(found, "_group", "left").withColumn("distance", distance())
    return scored.select(
        "doc_id", *[c.split()[0] for c in COUNTS.split(", ")], "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).alias("kept"), "distance",
        F.col("_group").alias("group"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass; rows that share an id all go if one is rejected."""
    gone = judged(docs).where("NOT kept").select("doc_id").distinct()
    gone = written(gone, "quality-rejected")
    return docs.alias("d").join(
        broadcast_if_small(gone).alias("g"), F.expr("d.doc_id <=> g.doc_id"), "left_anti"
    )
