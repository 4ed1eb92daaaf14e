"""A Bloom filter as a small table: rows that certainly match nothing are settled where they are.

A value sets three bits of one 64-bit word. Words lie in arrays of WORDS, one row each, so a lookup is a
broadcast hash join on the array's number and a bit test, all in generated code.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.scratch import written

WORDS = 1024
BITS_PER_VALUE = 16
MOST_ARRAYS = 1 << 13  # 64 MB; more values than 2^25 only make more false positives


def arrays_for(values: int) -> int:
    return max(1, min(MOST_ARRAYS, -(-values * BITS_PER_VALUE // (64 * WORDS))))


def place(column: str, arrays: int) -> dict:
    """SQL of the array, the word in it and the bits of a value."""
    second = f"xxhash64({column}, 1)"
    bits = " | ".join(f"shiftleft(1L, cast(shiftright({second}, {6 * i}) & 63 AS int))" for i in range(3))
    return {
        "array": f"pmod(xxhash64({column}), {arrays})",
        "word": f"cast(shiftright({second}, 18) & {WORDS - 1} AS int)",
        "bits": f"({bits})",
    }


def place_by_hash(hashed: str, arrays: int) -> dict:
    """`place` for a value that is itself a 64-bit hash: its upper bits give the array, others the word and the bits."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftright({hashed}, {6 * i}) & 63 AS int))" for i in range(3))
    return {
        "array": f"pmod(shiftright({hashed}, 28), {arrays})",
        "word": f"cast(shiftright({hashed}, 18) & {WORDS - 1} AS int)",
        "bits": f"({bits})",
    }


def in_hashes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """False where a hash certainly is none of those in a filter made with `place_by_hash`; `words` is (arrays, WORDS)."""
    bits = np.zeros(len(hashes), np.int64)
    for i in range(3):
        bits |= np.int64(1) << ((hashes >> 6 * i) & 63)
    at = ((hashes >> 28) % len(words)) * WORDS + ((hashes >> 18) & (WORDS - 1))
    return words.reshape(-1).take(at) & bits == bits


def filter_of(df: DataFrame, column: str, values: int, place=place) -> tuple:
    """The filter of a column with about so many distinct values, and its number of arrays."""
    arrays = arrays_for(values)
    at = place(f"`{column}`", arrays)
    set_bits = df.selectExpr(f"{at['array']} AS array", f"{at['word']} AS word", f"{at['bits']} AS bits")
    blank = df.sparkSession.range(arrays).selectExpr("id AS array", f"explode(sequence(0, {WORDS - 1})) AS word", "0L AS bits")
    words = set_bits.unionByName(blank).groupBy("array", "word").agg(F.bit_or("bits").alias("bits"))
    whole = words.groupBy("array").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return written(whole.selectExpr("array AS _array", "words.bits AS words"), "bloom"), arrays


def marked(df: DataFrame, column: str, built: tuple, name: str) -> DataFrame:
    """Add `name`: false where the column's value certainly is none of the filter's."""
    words, arrays = built
    at = place(f"`{column}`", arrays)
    joined = df.withColumn("_array", F.expr(at["array"])).join(F.broadcast(words), "_array", "left")
    test = f"coalesce(get(words, {at['word']}) & {at['bits']} = {at['bits']}, false)"
    return joined.withColumn(name, F.expr(test)).drop("_array", "words")
