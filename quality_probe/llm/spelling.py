"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One inserted or deleted letter moves a word's vector of letter counts by 1, one replaced letter by 2 (L1). So
the near words of a word lie within 2 of it among those of its length, and within 1 among those a letter
longer. For each length a k-d tree cuts the vectors into cells; a word is a member of one cell, and a query
of each cell that its range reaches, those of its own length and of the next one. Boxes further away are
pruned. Each cell is one group for a task: it builds its own tree over its members, searches it with all
queries at once, and verifies the letter order of what is left.

The cells' trees are fitted on about SAMPLE words, in a number that follows the vocabulary; every word is
placed by them. Equal vectors cannot be cut, nor can they be near each other: members beyond a cell's size are then
shared out by hash, and queries go to all shares. Nothing is capped.
"""

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quality_probe.llm.crc_sql import CRC_TABLE, crc32
from quality_probe.scratch import written

# Fixed values of the contract.
LEAST_LETTERS, LEAST_COUNT = 6, 5
DELETE_EVERY = 199
FORM_TIMES = 5  # a form occurs so many times as often as its variant
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEYOND = (0xC0, 0xFF)  # letters beyond ASCII, first and last

LETTERS = len(SMALL) + BEYOND[1] - BEYOND[0] + 1
PLACE = np.zeros(256, np.int64)  # of a letter in a vector
PLACE[[ord(c) for c in SMALL]] = np.arange(len(SMALL))
PLACE[BEYOND[0] :] = len(SMALL) + np.arange(BEYOND[1] - BEYOND[0] + 1)
MOST = 255  # larger counts are told apart no more, which never makes a distance longer

SAMPLE = 1 << 17
CELL = 1 << 19  # letters in the members of a cell
LEAST_CELL = 64  # words
LEAF = 64  # words
PAIRS = 1 << 23  # letters compared at a time

REPLACED, INSERTED = 2, 1  # L1 distance to words of the same length, and to those one letter longer
MEMBER, SAME, SHORTER = 0, 1, 2  # roles of a word in a cell

BITS = np.random.default_rng(12).integers(0, 64, (LETTERS, 32)).astype(np.uint64)  # of the k-th of a letter


# --- words ---------------------------------------------------------------------------------------


def lowered(run: Column) -> Column:
    """A-Z in lower case and nothing else; letters beyond ASCII stay."""
    ascii_only = F.octet_length(run) == F.char_length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, CAPITALS, SMALL))


def counted(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts after the drawn deletions, that are long and frequent enough.

    Runs that are too short at first stay too short. Without a doc_id nothing is drawn, so the run stays.
    """
    pattern = f"[A-Za-z\\u00{BEYOND[0]:X}-\\u00{BEYOND[1]:X}]{{{LEAST_LETTERS},}}"
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    drawn = found.select("doc_id", lowered(F.col("run")).alias("run")).withColumn(
        "h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    )
    at = "cast(h % char_length(run) AS int)"
    changed = f"CASE WHEN h % {DELETE_EVERY} = 0 THEN concat(left(run, {at}), substring(run, {at} + 2)) ELSE run END"
    words = drawn.select(F.expr(changed).alias("word")).filter(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- trees ---------------------------------------------------------------------------------------


def flat_letters(words: list) -> tuple:
    """The letters of all words as bytes, and their number in each word."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.array([len(w) for w in words], np.int64)


def vectors(words: list) -> np.ndarray:
    """Letter counts, a row per letter and a column per word."""
    data, sizes = flat_letters(words)
    rows = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(PLACE[data] * len(words) + rows, minlength=LETTERS * len(words))
    return np.minimum(counts, MOST).astype(np.uint8).reshape(LETTERS, len(words))


class Tree:
    """A k-d tree over letter-count vectors: cuts of one letter's count, and leaves."""

    def __init__(self, counts: np.ndarray, leaf_size: int):
        self.cuts, self.leaves = [], []  # (letter, last count to the left, low, high, left, right); word numbers
        self.root = self._build(counts, np.arange(counts.shape[1]), {}, leaf_size)

    def _build(self, counts: np.ndarray, rows: np.ndarray, bounds: dict, leaf_size: int):
        found = self._cut(counts, rows) if len(rows) > leaf_size else None
        if found is None:
            self.leaves.append(rows)
            return ~(len(self.leaves) - 1)
        letter, last = found
        low, high = bounds.get(letter, (0, MOST))
        values = counts[letter, rows]
        left = self._build(counts, rows[values <= last], {**bounds, letter: (low, last)}, leaf_size)
        right = self._build(counts, rows[values > last], {**bounds, letter: (last + 1, high)}, leaf_size)
        self.cuts.append((letter, last, low, high, left, right))
        return len(self.cuts) - 1

    @staticmethod
    def _cut(counts: np.ndarray, rows: np.ndarray):
        """The letter whose counts vary most, cut near their median; None for equal vectors."""
        some = counts[:, rows].astype(np.float32)
        letter = int(some.var(axis=1).argmax())
        values = counts[letter, rows]
        low, high = int(values.min()), int(values.max())
        if low == high:
            return None
        middle = int(np.partition(values, len(values) // 2)[len(values) // 2])
        below = np.count_nonzero(values < middle)
        last = middle if middle < high and len(values) - 2 * below > np.count_nonzero(values == middle) else middle - 1
        return letter, min(max(last, low), high - 1)

    def reached(self, counts: np.ndarray, radius: int):
        """(leaf, columns of `counts`) for all boxes within `radius` of a vector."""
        todo = [(self.root, np.arange(counts.shape[1]), np.zeros(counts.shape[1], np.int16))]
        while todo:
            node, rows, distance = todo.pop()
            if node < 0:
                yield ~node, rows
                continue
            letter, last, low, high, left, right = self.cuts[node]
            values = counts[letter, rows].astype(np.int16)

            def outside(low, high, values=values):
                return np.maximum(np.maximum(low - values, values - high), 0)

            others = distance - outside(low, high)
            for child, box in ((left, (low, last)), (right, (last + 1, high))):
                away = others + outside(*box)
                kept = away <= radius
                if kept.any():
                    todo.append((child, rows[kept], away[kept]))


class Cells:
    """One tree per word length, with numbers of its cells; small whatever the vocabulary."""

    def __init__(self, sizes: dict, sample: list):
        """`sizes`: words of each length in the vocabulary; `sample`: some of the words."""
        by_length = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        self.trees, self.number = {}, 0
        for length, words in sorted(sizes.items()):
            some = by_length.get(length, [])
            each = words / max(len(some), 1)  # words that one of the sample stands for
            room = max(CELL // length, LEAST_CELL)
            tree = Tree(vectors(some), max(int(room / each), 1) if words > room else words)
            shares = np.array([max(1, math.ceil(len(leaf) * each / room)) for leaf in tree.leaves], np.int64)
            if not some:
                shares[:] = max(1, math.ceil(words / room))
            first = self.number + np.cumsum(shares) - shares
            tree.leaves = []  # the words themselves are not needed
            self.trees[length] = (tree, first, shares)
            self.number += int(shares.sum())

    def places(self, words: list):
        """(cells, roles, word numbers) in blocks: members once, queries for each cell that they reach."""
        lengths = np.array([len(w) for w in words], np.int64)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            counts = vectors([words[i] for i in rows])
            hashes = np.array([zlib.crc32(words[i].encode()) for i in rows], np.int64)
            tree, first, shares = self.trees[length]
            home = np.zeros(len(rows), np.int64)
            for leaf, some in tree.reached(counts, 0):
                home[some] = first[leaf] + hashes[some] % shares[leaf]
            yield home, np.full(len(rows), MEMBER, np.int32), rows
            for target, radius, role in ((length, REPLACED, SAME), (length + 1, INSERTED, SHORTER)):
                if target not in self.trees:
                    continue
                tree, first, shares = self.trees[target]
                for leaf, some in tree.reached(counts, radius):
                    for cell in range(int(first[leaf]), int(first[leaf] + shares[leaf])):
                        asked = some[home[some] != cell] if role == SAME else some  # a member asks at home anyway
                        yield np.full(len(asked), cell), np.full(len(asked), role, np.int32), rows[asked]


# --- search in a cell ----------------------------------------------------------------------------


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits of each vector; two of them differ in no more bits than their vectors' L1 distance."""
    out = np.zeros(counts.shape[1], np.uint64)
    for letter in np.flatnonzero(counts.any(axis=1)):
        values = counts[letter]
        for k in range(min(int(values.max()), BITS.shape[1])):
            out ^= np.where(values > k, np.uint64(1) << BITS[letter, k], np.uint64(0))
    return out


def grid(words: list) -> np.ndarray:
    """The letters of words of one length, a row each."""
    data, sizes = flat_letters(words)
    return data.reshape(len(words), int(sizes[0]) if len(sizes) else 0)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a != b, axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of `b` is that of `a` with one more letter."""
    size = a.shape[1]
    head = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


def near(tree: Tree, signs: np.ndarray, letters: np.ndarray, queries: list, radius: int, verify) -> tuple:
    """(query numbers, member numbers) of all pairs one edit apart."""
    none = np.zeros(0, np.int64)
    found = [(none, none)]
    if not queries:
        return none, none
    counts, asked = vectors(queries), grid(queries)
    marks = signatures(counts)
    step = max(1, PAIRS // max(1, asked.shape[1]))
    for leaf, rows in tree.reached(counts, radius):
        members = tree.leaves[leaf]
        block = max(1, step // max(1, len(members)))
        for at in range(0, len(rows), block):
            some = rows[at : at + block]
            close = np.bitwise_count(marks[some][:, None] ^ signs[members][None, :]) <= radius
            q, m = np.nonzero(close)
            q, m = some[q], members[m]
            right = verify(asked[q], letters[m])
            found.append((q[right], m[right]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def searched(frame: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, best_n, best: for each word of the cell with near words there, their number and the best."""
    parts = {role: frame[frame["role"] == role] for role in (MEMBER, SAME, SHORTER)}
    members, same, shorter = (parts[role]["word"].tolist() for role in (MEMBER, SAME, SHORTER))
    counts = vectors(members)
    tree, signs, letters = Tree(counts, LEAF), signatures(counts), grid(members)
    q, m = near(tree, signs, letters, members + same, REPLACED, one_replaced)
    s, longer = near(tree, signs, letters, shorter, INSERTED, one_inserted)
    s = s + len(members) + len(same)
    words = np.array(members + same + shorter, dtype=object)
    n = np.concatenate([parts[role]["n"].to_numpy(np.int64) for role in (MEMBER, SAME, SHORTER)])
    target, other = np.concatenate([q, s, longer]), np.concatenate([m, longer, s])
    place = np.empty(len(words), np.int64)
    place[np.argsort(words, kind="stable")] = np.arange(len(words))  # code-point order
    order = np.lexsort((place[other], -n[other], target))
    target, other = target[order], other[order]
    starts = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else order
    return pd.DataFrame({
        "word": words[target[starts]],
        "n_near": np.diff(np.append(starts, len(target))),
        "best_n": n[other[starts]],
        "best": words[other[starts]],
    })


# --- whole vocabularies --------------------------------------------------------------------------


def fitted_cells(vocabulary: DataFrame) -> Cells:
    length = F.char_length("word")
    sizes = {r["length"]: r["count"] for r in vocabulary.groupBy(length.alias("length")).count().collect()}
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    kept = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return Cells(sizes, [r["word"] for r in vocabulary.filter(kept).select("word").collect()])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: near words of each word that has some, and the most frequent of them.

    `vocabulary` is a stored table of distinct words and their n.
    """
    cells = fitted_cells(vocabulary)

    def place(frames):
        for frame in frames:
            words = frame["word"].tolist()
            for cell, role, rows in cells.places(words):
                if len(rows):
                    part = frame.iloc[rows]
                    yield pd.DataFrame({"cell": cell, "role": role, "word": part["word"], "n": part["n"]})

    placed = vocabulary.select("word", "n").mapInPandas(place, "cell bigint, role int, word string, n bigint")
    in_cells = placed.repartition(max(1, cells.number), "cell").groupBy("cell")  # few bytes, but much work in each
    found = in_cells.applyInPandas(searched, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best")
    )


def rooted(forms: DataFrame, rounds: int) -> DataFrame:
    """word, root: `forms` (word, form) followed to the last one, twice as far in each round."""
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        links = written(links, "links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return links


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: the frequent words of all texts with their spelling variants.

    Null and empty texts have no words; a null doc_id draws no deletion; repeated rows count each; ties go to the
    first word in code-point order; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    vocabulary = written(counted(docs), "vocabulary")
    judged = vocabulary.join(near_words(vocabulary), "word", "left")
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    words = written(
        judged.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "judged",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(most, FORM_TIMES)))  # n grows with each step
    roots = rooted(words.filter("form IS NOT NULL"), math.ceil(math.log2(steps)))
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def grouped_sql() -> str:
    """The rows of `grouped` in DuckDB SQL: near words share a text with one letter masked, or left out."""
    letters = f"A-Za-z{chr(BEYOND[0])}-{chr(BEYOND[1])}"
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{letters}]{{{LEAST_LETTERS},}}')) AS raw FROM documents),
pairs AS (SELECT doc_id, translate(raw, '{CAPITALS}', '{SMALL}') AS run, count(*) AS n FROM runs GROUP BY ALL),
drawn AS (SELECT run, n, {crc32("doc_id::VARCHAR || ':' || run")} AS h FROM pairs, crc_table),
changed AS (
    SELECT n, CASE WHEN h % {DELETE_EVERY} = 0
        THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM drawn
),
vocabulary AS (
    SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LETTERS}
    GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary),
masked AS (SELECT word, n, left(word, i) || '_' || substr(word, i + 2) AS mask FROM places),
shorter AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less FROM places),
pairs_near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM masked a JOIN masked b USING (mask) WHERE a.word <> b.word
    UNION ALL SELECT s.word, v.word, v.n FROM shorter s JOIN vocabulary v ON v.word = s.less
    UNION ALL SELECT v.word, s.word, s.n FROM shorter s JOIN vocabulary v ON v.word = s.less
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place,
        count(*) OVER (PARTITION BY word) AS n_near
    FROM pairs_near
),
judged AS (
    SELECT v.word, v.n, coalesce(p.n_near, 0) AS n_near,
        CASE WHEN p.other_n >= {FORM_TIMES} * v.n THEN p.other END AS form,
        CASE WHEN p.other_n >= {FORM_TIMES} * v.n THEN p.other_n END AS form_n
    FROM vocabulary v LEFT JOIN placed p ON p.word = v.word AND p.place = 1
),
followed AS (
    SELECT word, word AS root, 0 AS step FROM judged
    UNION ALL SELECT f.word, j.form, f.step + 1 FROM followed f JOIN judged j ON j.word = f.root
    WHERE j.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, step) AS root FROM followed GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""
