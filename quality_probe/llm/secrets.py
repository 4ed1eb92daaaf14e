"""Secret scans: fixed base patterns, and values in credential contexts by their guess cost.

The cost of a value is the least total, over all ways to cut it into spans, of the log10 guesses that
each span takes: dictionary words by rank, dates, repeats, keyboard walks and runs, else brute force by
character class. A value that stands in a credential context and costs GUESSES or more is a span of kind
`guess`; so keys in free formats are found while placeholders are left alone. Where a blank alone parts
name and value, what has the shape of a word is prose unless it costs PROSE, and PER_LETTER for each letter.
"""

import functools
import hashlib
import json
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.llm import words as W

KINDS = ["assign", "access", "hex", "guess"]
LEAST = {"assign": 6, "access": 20, "hex": 24}
GUESSES = 10.0
PROSE = 20.0
PER_LETTER = 1.25  # random letters cost 1.41, long words and compounds less
MASK = "[SECRET]"

# The base patterns.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# A looser context: a name that holds a credential word, a separator, a value of four characters or more.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_\x20-]?key"""
    r"""|credentials?|bearer)[A-Za-z0-9_]{0,20}["']?\x20{0,3}(?:[:=]|=>|:=|\x20)\x20{0,3}["']?"""
    r"""([^\s"'<>,;()\[\]{}]{4,})"""
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")

IS_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
LONG_HEX = b"x" * LEAST["hex"]

# The rows of a keyboard, shifted by half a key each.
KEY_ROWS = ["`1234567890-=", "\tqwertyuiop[]", "\tasdfghjkl;'", "\tzxcvbnm,./"]
LEET = str.maketrans("4@31!05$7", "aaeiiosst")
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:[0-2]\d|3[01])|(?:[0-2]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"
    r"|(?:19|20)\d\d"
)
LONGEST_WORD = 24
SPAN = math.log10(3)  # for each cut


def neighbours() -> dict:
    place = {c: (y, 2 * x + y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row) if c != "\t"}
    return {
        a: {b for b, (v, u) in place.items() if a != b and abs(v - y) <= 1 and abs(u - x) <= 2}
        for a, (y, x) in place.items()
    }


NEAR = neighbours()
DEGREE = math.log10(sum(map(len, NEAR.values())) / len(NEAR))


@functools.lru_cache(maxsize=2)
def dictionary(path: str) -> dict:
    """log10 rank of the whole words in a public tokenizer's vocabulary, which lists frequent ones first."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranked = sorted(vocabulary, key=vocabulary.get)
    whole = [t[:-4] for t in ranked if t.endswith("</w>") and len(t) > 6 and t[:-4].isalpha()]
    return {word: math.log10(rank + 1) for rank, word in enumerate(whole, 1)}


def brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


def run_length(value: str, at: int, step) -> int:
    """Characters from `at` on of which each follows the one before by `step`."""
    end = at + 1
    while end < len(value) and step(value[end - 1], value[end]):
        end += 1
    return end - at


def segments(value: str, words: dict) -> list:
    """For each start, the (end, log10 guesses) of the patterns that begin there.

    Runs are measured once each: a run's later starts take the rest of it, so the work is linear.
    """
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    found = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = words.get(low[i:j])
            changed = 0.0
            if rank is None:
                rank, changed = words.get(plain[i:j]), math.log10(4)
            if rank is not None:
                changed += math.log10(2) if low[i:j] != value[i:j] else 0.0
                found[i].append((j, rank + changed))
    for m in DATE.finditer(value):
        found[m.start()].append((m.end(), math.log10(150 if m.end() - m.start() == 4 else 365 * 150 * 4)))
    steps = {
        "walk": lambda a, b: b in NEAR.get(a, ()),
        "up": lambda a, b: ord(b) - ord(a) == 1,
        "down": lambda a, b: ord(a) - ord(b) == 1,
    }
    for kind, step in steps.items():
        i = 0
        while i < n:
            size = run_length(low, i, step)
            for start in range(i, i + size - 2):
                rest = i + size - start
                cost = math.log10(47) + math.log10(rest) + (DEGREE * min(rest, 4) if kind == "walk" else 0.3)
                found[start].append((i + size, cost))
            i += size
    for unit in range(1, 5):
        i = 0
        while i + 2 * unit <= n:
            size = unit
            while i + size < n and value[i + size] == value[i + size - unit]:
                size += 1
            times = size // unit
            if times >= 2 and size >= 3:
                base = sum(map(brute, value[i : i + unit]))
                found[i].append((i + times * unit, base + math.log10(times)))
            i += max(1, size - unit + 1)
    return found


def guess_cost(value: str, words: dict) -> float:
    """log10 of the guesses for the cheapest segmentation of `value`; linear in its length."""
    n = len(value)
    found = segments(value, words)
    closed = [math.inf] * (n + 1)  # cheapest up to here, whatever came last
    open_brute = [math.inf] * (n + 1)  # cheapest up to here with a brute-force span that may go on
    closed[0] = 0.0
    for i in range(n):
        single = brute(value[i])
        through = min(open_brute[i] + single, closed[i] + (SPAN if i else 0.0) + single)
        open_brute[i + 1] = min(open_brute[i + 1], through)
        closed[i + 1] = min(closed[i + 1], through)
        for end, cost in found[i]:
            closed[end] = min(closed[end], closed[i] + (SPAN if i else 0.0) + cost)
    return closed[n]


def base_spans(text: str, raw: bytes) -> list:
    """(start, end, kind index) of the base patterns, leftmost and non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if LONG_HEX in raw.translate(IS_HEX):
        out += [(*m.span(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return out


def is_secret(value: str, bare: bool, words: dict) -> bool:
    """Whether the cost of `value` makes it a span; `bare`: a blank alone stands before it."""
    cost = guess_cost(value, words)
    if bare and value.isalpha() and value in (value.lower(), value.upper(), value.capitalize()):
        # words of other alphabets cannot be told from credentials by cost
        return value.isascii() and cost >= max(PROSE, PER_LETTER * len(value))
    return cost >= GUESSES


def guess_spans(text: str, words: dict) -> list:
    low = text.lower()
    if not any(word in low for word in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?")
        bare = not {":", "="} & set(text[m.start() : m.start(1)])
        if len(value) >= 4 and is_secret(value, bare, words):
            out.append((m.start(1), m.start(1) + len(value), 3))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, end, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def masked(text: str, spans: list) -> str:
    """The text with every maximal run of spans replaced by MASK."""
    out, last = [], 0
    for start, end, _ in sorted(spans):
        if start >= last:
            out += [text[last:start], MASK]
        last = max(last, end)
    return "".join([*out, text[last:]])


def scan(docs: DataFrame, dictionary_path: str, keys: list = ("doc_id",), redact: bool = False) -> DataFrame:
    """Per row: `keys`, n_assign, n_access, n_hex, n_guess, base_sha256, spans (and `masked`, the redacted text).

    Whole texts are read, in tasks, without a shuffle. Null texts count as empty, and a redacted null
    stays null. Positions are code points. Repeated rows are scanned each; an empty table gives no rows.
    """
    keys = list(keys)

    def find(batches):
        words = dictionary(dictionary_path)
        for batch in batches:
            texts = W.filled(batch.column("_text"))
            for row, part in W.pieces(texts):
                counted = [[], [], [], []]
                hashes, spelled, texts_out = [], [], []
                for text in part.to_pylist():
                    base = base_spans(text, text.encode())
                    more = guess_spans(text, words)
                    for k in range(4):
                        counted[k].append(sum(s[2] == k for s in (more if k == 3 else base)))
                    hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spelled.append(joined(base + more))
                    if redact:
                        texts_out.append(masked(text, base + more))
                columns = [batch.column(k).slice(row, len(part)) for k in keys]
                columns += [pa.array(c, pa.int64()) for c in counted]
                columns += [pa.array(hashes, pa.string()), pa.array(spelled, pa.string())]
                if redact:
                    given = batch.column("_text").slice(row, len(part))
                    columns.append(pc.if_else(pc.is_null(given), pa.scalar(None, pa.string()), pa.array(texts_out, pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *shape][: len(columns)])

    shape = ["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", *(["masked"] if redact else [])]
    kinds = ["bigint"] * 4 + ["string"] * 3
    ddl = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys]
    ddl += [f"{name} {kind}" for name, kind in zip(shape, kinds)]
    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(find, ", ".join(ddl))


def redacted_documents(docs: DataFrame, dictionary_path: str) -> DataFrame:
    """All documents, with every secret replaced by MASK and n_chars counted anew."""
    rest = [c for c in docs.columns if c != "text"]
    found = scan(docs, dictionary_path, rest, redact=True).withColumnRenamed("masked", "text")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
