"""Ranks of a few documents among many, without sorting the many.

The chosen documents of each scorer, best first, split its order into intervals. Each task finds the interval of its
documents by binary search and counts them; a rank is the sum of the counts before. No document is moved.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quality_probe.scratch import written

TOP_BIT = np.uint64(1 << 63)
LAST = np.uint64(2**64 - 1)


def descending(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the reverse order of doubles or signed integers."""
    if values.dtype.kind == "f":
        bits = (values + 0.0).view(np.uint64)  # no negative zero
        return ~np.where(bits & TOP_BIT, ~bits, bits | TOP_BIT)
    return ~(values.view(np.uint64) ^ TOP_BIT)


def keys_of(scores, high, low) -> np.ndarray:
    """Byte strings in the order of score, high and low, largest first and nulls last."""
    out = np.empty((len(scores), 3), ">u8")
    out[:, 0] = descending(np.asarray(scores, np.float64))
    for place, column in ((1, high), (2, low)):
        valid = np.asarray(column.is_valid())
        numbers = np.asarray(column.fill_null(0), np.int64)
        out[:, place] = np.where(valid, descending(numbers), LAST)
    return out.view("S24").ravel()


class Splits:
    """The chosen documents of one scorer, best first."""

    def __init__(self, keys: np.ndarray, ids: list):
        order = sorted(range(len(ids)), key=lambda i: (keys[i], ids[i]))
        self.keys = keys[order]
        self.ids = np.array([ids[i].encode() for i in order])
        self.first = np.searchsorted(self.keys, self.keys)

    def places(self, keys: np.ndarray, ids: pa.Array) -> np.ndarray:
        """How many of the chosen documents stand before or at each document."""
        first, last = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        ties = np.flatnonzero(first < last)
        if len(ties):  # told apart by id
            names = np.array([i.encode() for i in ids.take(pa.array(ties)).to_pylist()])
            size = max(names.dtype.itemsize, self.ids.dtype.itemsize)

            def joined(groups, names):
                out = np.zeros(len(names), [("group", ">u8"), ("name", f"S{size}")])
                out["group"], out["name"] = groups, names
                return out.view(f"S{8 + size}").ravel()

            first[ties] = np.searchsorted(joined(self.first, self.ids), joined(first[ties], names), "right")
        return first


def counted(batches, splits: dict):
    """(classifier, place, count): documents of the task in each interval."""
    counts = {name: np.zeros(len(found.ids) + 1, np.int64) for name, found in splits.items()}
    for batch in batches:
        coded = batch.column("classifier").dictionary_encode()
        which = coded.indices.to_numpy()
        for number, name in enumerate(coded.dictionary.to_pylist()):
            if name in splits:
                some = batch.filter(pa.array(which == number))
                keys = keys_of(*(some.column(c) for c in ("score", "rank_high", "rank_low")))
                places = splits[name].places(keys, some.column("id"))
                counts[name] += np.bincount(places, minlength=len(counts[name]))
    for name, found in counts.items():
        places = np.flatnonzero(found)
        if len(places):
            yield pa.RecordBatch.from_pydict({
                "classifier": [name] * len(places), "place": pa.array(places), "count": pa.array(found[places])
            })


def interval_ranks(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """`chosen` with the rank of each of its rows among `scores`, and the number of scores, by classifier.

    Both hold classifier, score, rank_high, rank_low and id; `chosen` is a checked few of `scores`.
    """
    order = [F.desc("score"), F.desc("rank_high"), F.desc("rank_low"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("classifier").orderBy(*order)) - 1
    chosen = written(chosen.withColumn("place", place.cast("long")), "chosen")
    columns = ["classifier", "score", "rank_high", "rank_low", "id"]
    few = chosen.select(columns).toArrow().combine_chunks()
    splits = {}
    for name in few.column("classifier").unique().to_pylist():
        rows = few.filter(pc.equal(few.column("classifier"), name)).combine_chunks()
        keys = keys_of(*(rows.column(c).combine_chunks() for c in columns[1:4]))
        splits[name] = Splits(keys, rows.column("id").to_pylist())
    sent = scores.sparkSession.sparkContext.broadcast(splits)
    counts = scores.select(columns).mapInArrow(
        lambda batches: counted(batches, sent.value), "classifier string, place bigint, count bigint"
    ).groupBy("classifier", "place").agg(F.sum("count").alias("count"))
    everything = Window.partitionBy("classifier")  # a row per interval
    before = counts.select(
        "classifier", "place",
        F.sum("count").over(everything.orderBy("place")).alias("before"), F.sum("count").over(everything).alias("total"),
    )
    # an interval without documents has no row: the last one before it counts
    marked = chosen.select("*", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("total"))
    walk = everything.orderBy("place", F.col("id").isNotNull())
    joined = marked.unionByName(before, allowMissingColumns=True)
    return joined.withColumn("rank", F.coalesce(F.max("before").over(walk), F.lit(0)) + 1).withColumn(
        "total", F.max("total").over(everything)
    ).filter("id IS NOT NULL").drop("place", "before")
