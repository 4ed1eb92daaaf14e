"""Sharding by a keyed Feistel permutation of global row numbers, native to the end.

Rows are numbered 0..n-1 by (doc_id, text checksum, size), on narrow rows only. A Feistel network on
two residues a x b >= n is a bijection on 0..ab-1; a value beyond n walks on along its cycle until it
falls below n. So the shuffled place of a row is computed from its number, and the other way round,
without any sort: place p lies in shard p mod k, slot p div k.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quality_probe.operators.ordering import number_rows, without_slices

ROUNDS = 6


def domain(n: int) -> tuple:
    """The smallest near-square a x b that holds n numbers; less than a of its values lie beyond n."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def whole(x: Column, by: int) -> Column:
    """Exact integer quotient of a non-negative BIGINT."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network over the numbers r * a + l with l < a, r < b."""

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed), F.lit("l")), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(left, i, F.lit(seed), F.lit("r")), F.lit(b)), F.lit(b))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct((x % a).cast("long").alias("l"), whole(x, a).alias("r"))
    turns = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, start, turn, lambda s: s["r"] * F.lit(a) + s["l"])


def with_places(df: DataFrame, number: str, n: int, seed: int, name: str = "place") -> DataFrame:
    """Add the place of row `number` (0..n-1) in the shuffle of n rows that `seed` fixes.

    A walk meets at most the values beyond n, so a fold over that many steps always ends it. Few rows
    walk at all: their share is at most 1 / sqrt(n).
    """
    a, b = domain(n)
    beyond = a * b - n
    steps = F.sequence(F.lit(1), F.when(F.col("_once") < n, F.lit(1)).otherwise(F.lit(beyond + 1)))
    walked = F.aggregate(
        steps, F.col("_once"), lambda x, _: F.when(x < n, x).otherwise(network(x, a, b, seed))
    )
    once = df.withColumn("_once", network(F.col(number), a, b, seed))
    return once.withColumn(name, walked if beyond else F.col("_once")).drop("_once")


def shard_rows(docs: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, place.

    Law `rows`: shard counts differ by at most one and slots have no gap. A null text has no bytes; null
    ids come first; repeated rows get numbers of their own; an empty table gives no rows; other columns
    are not read.
    """
    n = docs.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered = without_slices(number_rows(narrow, [], ["doc_id", "text_crc32", "size"]))
    placed = numbered.withColumn("row_number", F.col("row_number") - 1)
    placed = with_places(placed, "row_number", n, seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
        "place",
    )
