"""Files that hold one JSON object of many entries, in any layout, read by many tasks.

A file is scanned in pieces between quotation marks, so a split may begin anywhere. One pass counts the real quotes
of each split and, for either case of what its start lies in, the brackets outside strings. Prefix sums over
the splits then tell for each start whether it lies in a string, and how deep. A second pass cuts the entries; what
a split has of an entry that began earlier or goes on later is joined by the splits in between.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quality_probe.scratch import written

QUOTE = '"'
OPEN, CLOSED = "{[", "}]"
SPLIT = ["file", "block"]
WHOLE, HEAD, TAIL, ALL = "whole", "head", "tail", "all"


def escapes(piece: str) -> bool:
    """Whether the quotation mark after a piece is escaped; outside strings no piece ends in backslashes."""
    return (len(piece) - len(piece.rstrip("\\"))) % 2 == 1


def depth_change(piece: str) -> int:
    return sum(map(piece.count, OPEN)) - sum(map(piece.count, CLOSED))


def split_counts(batches):
    """(file, block, quotes, outside, inside): parity of real quotes, bracket sums if the start is outside or inside a string."""
    split, parity, sums = None, 0, [0, 0]
    for batch in batches:
        rows = []
        for *where, piece in zip(*[batch.column(c).to_pylist() for c in (*SPLIT, "value")], strict=True):
            if where != split:
                if split:
                    rows.append([*split, parity, *sums])
                split, parity, sums = where, 0, [0, 0]
            sums[parity] += depth_change(piece)
            parity ^= not escapes(piece)
        yield from as_batch(rows, [*SPLIT, "quotes", "outside", "inside"])
    if split:
        yield from as_batch([[*split, parity, *sums]], [*SPLIT, "quotes", "outside", "inside"])


def as_batch(rows: list, names: list):
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


class Cutter:
    """Cuts the pieces of one split into entries of the outermost object."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = in_string, depth
        self.text, self.cut = [], False

    def entry(self) -> tuple:
        part, text = (WHOLE if self.cut else HEAD), "".join(self.text)
        self.text, self.cut = [], True
        return part, text

    def add(self, piece: str):
        """Take a piece and the mark after it; yield the entry that ends in it, if any."""
        if self.in_string:
            self.text.append(piece)
        else:
            if self.depth == 0 and OPEN[0] in piece:
                piece, self.depth = piece[piece.index(OPEN[0]) + 1 :], 1
            before, self.depth = self.depth, self.depth + depth_change(piece)
            last = max(map(piece.rfind, CLOSED))
            comma = piece.rfind(",")
            if self.depth == 1 and comma > last:
                self.text.append(piece[:comma])
                yield self.entry()
                self.text.append(piece[comma + 1 :])
            elif self.depth == 0 and before > 0:
                self.text.append(piece[:last])
                yield self.entry()
            elif self.depth > 0:
                self.text.append(piece)
        if self.in_string or self.depth > 0:
            self.text.append(QUOTE)
        self.in_string ^= not escapes(piece)

    def rest(self):
        if self.text:
            yield (TAIL if self.cut else ALL), "".join(self.text)


def cut_entries(batches):
    """(file, block, part, text): whole entries of each split, and what it has of those at its ends."""
    split, cutter = None, None
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in (*SPLIT, "in_string", "depth", "value")]
        for file, block, in_string, depth, piece in zip(*columns, strict=True):
            if [file, block] != split:
                if split:
                    rows.extend([*split, *found] for found in cutter.rest())
                split, cutter = [file, block], Cutter(in_string, depth)
            rows.extend([*split, *found] for found in cutter.add(piece))
        yield from as_batch(rows, [*SPLIT, "part", "text"])
    if split:
        yield from as_batch([[*split, *found] for found in cutter.rest()], [*SPLIT, "part", "text"])


def entries(spark: SparkSession, path: str) -> DataFrame:
    """entry: the text of each entry of the objects in the files, one object a file, key and value."""
    pieces = spark.read.option("lineSep", QUOTE).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    counted = written(
        pieces.mapInArrow(split_counts, "file string, block bigint, quotes bigint, outside bigint, inside bigint"), "json-splits"
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    in_string = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    starts = counted.withColumn("in_string", in_string).withColumn("change", change).select(
        *SPLIT, "in_string", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth")
    )
    placed = pieces.join(F.broadcast(starts), SPLIT)
    cut = written(placed.mapInArrow(cut_entries, "file string, block bigint, part string, text string"), "json-entries")
    ends = cut.filter(F.col("part") != WHOLE)
    has_cut = F.count_if(F.col("part") == HEAD)
    begun = ends.groupBy(*SPLIT).agg(has_cut.alias("cuts")).select(
        *SPLIT, F.coalesce(F.sum("cuts").over(earlier), F.lit(0)).alias("number")
    )
    number = F.col("number") + F.when(F.col("part") == TAIL, 1).otherwise(0)
    joined = ends.join(begun, SPLIT).groupBy("file", number.alias("number")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("entry")
    )
    found = cut.filter(F.col("part") == WHOLE).select(F.col("text").alias("entry")).unionByName(joined.select("entry"))
    return found.filter(F.trim("entry", F.lit(" \n\t\r")) != "")
