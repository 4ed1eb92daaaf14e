"""Row numbers, ranks and order statistics over whole corpora, without a one-task window.

Rows are range-partitioned on the full sort key, so equal scores still split over tasks by their
tie-break. Only one small row per slice of the range is summed up to offsets.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quality_probe.scratch import written

SLICE, OFFSET = "_slice", "_offset"
BUCKETS = 256
WITHIN_SLICE = (1 << 33) - 1  # low bits of monotonically_increasing_id()


def number_rows(df: DataFrame, by: list, order: list, name: str = "row_number", total: str = None) -> DataFrame:
    """Number the rows 1..n of each `by` group in `order`; the key must be unique within a group.

    `total` adds the size of the group. Groups are few (scorers, benchmark types), their rows may be
    many. Pass narrow frames: all columns travel through one shuffle.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = written(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(SLICE, F.spark_partition_id())
        .withColumn(OFFSET, F.monotonically_increasing_id().bitwiseAND(F.lit(WITHIN_SLICE))),
        "ranged",
    )
    slices = ranged.groupBy(*by, SLICE).agg(F.count("*").alias("_rows"), F.min(OFFSET).alias("_first"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(
        F.sum("_rows").over(group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    shifts = slices.select(
        *by,
        SLICE,
        (before - F.col("_first") + 1).alias("_shift"),
        *([F.sum("_rows").over(group).alias(total)] if total else []),
    )
    return (
        ranged.join(F.broadcast(shifts), [*by, SLICE])  # at most slices + groups rows
        .withColumn(name, F.col(OFFSET) + F.col("_shift"))
        .drop(OFFSET, "_shift")
    )


def without_slices(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)


def min_ranks(numbered: DataFrame, by: list, value: str, number: str = "row_number", name: str = "rank",
              worst: str = None) -> DataFrame:
    """Add the rank that equal values share (the lowest row number among them); `worst` adds the group's largest one.

    `numbered` comes from number_rows(..., order=[desc(value), ...]). Inside a slice the rank is a
    window; a value that began in an earlier slice takes its start from the slices' edge rows.
    """
    edges = numbered.groupBy(*by, SLICE).agg(
        F.max(value).alias("_top"),
        F.min(F.struct(F.col(value), F.col(number))).alias("_bottom"),
        F.min(number).alias("_start"),
    )
    begun = edges.groupBy(*by, F.col(f"_bottom.{value}").alias("_top")).agg(
        F.min(f"_bottom.{number}").alias("_begun")
    )
    starts = edges.join(begun, [*by, "_top"], "left").select(*by, SLICE, "_top", "_begun", "_start")
    if worst:  # that of the lowest value, known from the slices' edge rows
        lowest = edges.groupBy(*by).agg(F.min("_bottom").alias("_lowest"))
        starts = starts.join(lowest.select(*by, F.col(f"_lowest.{number}").alias(worst)), by)
    inside = F.rank().over(Window.partitionBy(*by, SLICE).orderBy(F.desc(value)))
    carried = (F.col(value) == F.col("_top")) & F.col("_begun").isNotNull()
    return (
        numbered.withColumn("_inside", inside)
        .join(F.broadcast(starts), [*by, SLICE])
        .withColumn(
            name,
            F.when(carried, F.least("_begun", "_start")).otherwise(F.col("_start") + F.col("_inside") - 1),
        )
        .drop("_inside", "_top", "_begun", "_start")
    )


class Bracket:
    """A range of values that holds the order statistics of some ranks; `below` rows lie under it."""

    def __init__(self, low: float, high: float, below: int, ranks: set):
        self.low, self.high, self.below, self.ranks = low, high, below, ranks

    def refined(self, buckets: list) -> list:
        """The brackets within this one, from (count, low, high) of its buckets in ascending order."""
        out, below = [], self.below
        for count, low, high in buckets:
            inside = {rank for rank in self.ranks if below <= rank < below + count}
            if inside:
                out.append(Bracket(low, high, below, inside))
            below += count
        return out


def quantiles(df: DataFrame, by: str, value: str, shares: dict) -> DataFrame:
    """(`by`, label, `value`): exact interpolated quantiles of each of a few groups, without a sort.

    `shares` maps a label to a share in 0..1 of the ascending order. Each round counts the rows in BUCKETS parts of
    every bracket and goes on with the parts that hold a wanted rank, between their least and greatest values, until
    they hold one value. A bracket's width falls BUCKETS times a round; only counts are shuffled.
    """
    rows = df.select(by, value).filter(F.col(value).isNotNull())
    size = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
    wanted, brackets = {}, {}
    for group, n, low, high in size:
        for label, share in shares.items():
            at = share * (n - 1)
            first = int(at)
            wanted[group, label] = (first, min(first + 1, n - 1), at - first)
        ranks = {rank for label in shares for rank in wanted[group, label][:2]}
        brackets[group] = [Bracket(low, high, 0, ranks)]
    while any(b.low < b.high for found in brackets.values() for b in found):
        given = [(g, i, b.low, b.high) for g, found in brackets.items() for i, b in enumerate(found) if b.low < b.high]
        shape = f"{by} {rows.schema[by].dataType.simpleString()}, number int, low double, high double"
        inside = rows.join(F.broadcast(df.sparkSession.createDataFrame(given, shape)), by).filter(
            F.col(value).between(F.col("low"), F.col("high"))
        )
        bucket = F.width_bucket(value, "low", "high", F.lit(BUCKETS))
        counts = inside.groupBy(by, "number", bucket.alias("bucket")).agg(
            F.count("*").alias("count"), F.min(value).alias("least"), F.max(value).alias("greatest")
        )
        parts = {}
        for group, number, _, count, low, high in sorted(counts.collect(), key=lambda r: r["bucket"]):
            parts.setdefault((group, number), []).append((count, low, high))
        brackets = {
            group: [part for i, b in enumerate(found) for part in (b.refined(parts[group, i]) if b.low < b.high else [b])]
            for group, found in brackets.items()
        }
    values = {(group, rank): b.low for group, found in brackets.items() for b in found for rank in b.ranks}
    out = []
    for (group, label), (first, second, part) in wanted.items():
        low, high = values[group, first], values[group, second]
        out.append((group, label, low + (high - low) * part))
    label_type = "double" if all(isinstance(label, float) for label in shares) else "string"
    shape = f"{by} {rows.schema[by].dataType.simpleString()}, label {label_type}, {value} double"
    return df.sparkSession.createDataFrame(out, shape)
