"""Text cleaning, hashing and chunking as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HEAD_WORDS = 512
CHUNK_WORDS = 2046
CHUNK_CHARS = 10_000
UNBROKEN_CHARS = 10
LABEL_PREFIX = "__label__"
BLANK = "[ \n\t\r]"
NOT_BLANK = "[^ \n\t\r]"


def normalize_newlines(text) -> Column:
    """Every newline becomes a space."""
    return F.translate(text, "\n", " ")


def collapse_newlines(text) -> Column:
    """Every run of newlines becomes one space."""
    return F.regexp_replace(text, "\n+", " ")


def strip_label(label) -> Column:
    """Drop leading characters that occur in the label prefix (a set of characters, not a prefix)."""
    return F.ltrim(label, F.lit(LABEL_PREFIX))


def doc_hash(doc_id, text) -> Column:
    """A null text counts as an empty one, so that its record has a key of its own."""
    return F.sha2(F.concat(doc_id, F.lit(":"), F.coalesce(text, F.lit(""))), 256)


def words(text) -> Column:
    """Blank-separated pieces, without empty ones."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda word: word != "")


def first_words(text, count: int = HEAD_WORDS) -> Column:
    return F.slice(words(text), 1, count)


def trim_end(text: Column) -> Column:
    """Drop the last blank and what follows it; without any blank, the last ten characters."""
    shortened = F.substring(text, F.lit(1), F.greatest(F.length(text) - UNBROKEN_CHARS, F.lit(0)))
    trimmed = F.regexp_replace(text, f"{BLANK}{NOT_BLANK}*\\z", "")
    return F.when(F.regexp_like(text, F.lit(BLANK)), trimmed).otherwise(shortened)


def trim_start(text: Column) -> Column:
    """Drop everything up to the first blank; without any blank, the first ten characters."""
    shortened = F.substring(text, F.lit(UNBROKEN_CHARS + 1), F.length(text))
    trimmed = F.regexp_replace(text, f"\\A{NOT_BLANK}*{BLANK}", "")
    return F.when(F.regexp_like(text, F.lit(BLANK)), trimmed).otherwise(shortened)


def head_chunk(text: Column) -> Column:
    cut = F.substring(text, 1, CHUNK_CHARS)
    kept = F.array_join(F.slice(words(cut), 1, CHUNK_WORDS), " ")
    return F.when(F.size(words(cut)) > CHUNK_WORDS, kept).otherwise(cut)


def tail_chunk(text: Column) -> Column:
    cut = F.right(text, F.lit(CHUNK_CHARS))
    kept = F.array_join(F.slice(words(cut), -CHUNK_WORDS, CHUNK_WORDS), " ")
    return F.when(F.size(words(cut)) > CHUNK_WORDS, kept).otherwise(cut)


def is_long(text: Column) -> Column:
    return F.length(text) > 2 * CHUNK_CHARS


def raw_chunks(text: Column) -> Column:
    """One chunk (the head) of a text, or head and tail of a long one, before trimming."""
    return F.when(is_long(text), F.array(head_chunk(text), tail_chunk(text))).otherwise(
        F.array(head_chunk(text))
    )


def chunks(text: Column) -> Column:
    """Chunks as a model sees them: the head loses its last word, the tail its first."""
    head, tail = trim_end(head_chunk(text)), trim_start(tail_chunk(text))
    return F.when(is_long(text), F.array(head, tail)).otherwise(F.array(head))
