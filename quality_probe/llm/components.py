"""Connected components of a large graph, by least labels and pointer jumps over written tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.operators.sizes import gathered
from quality_probe.scratch import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each end of an edge (a, b) reaches; nodes are BIGINT.

    Every round hooks each tree onto the least tree next to it and halves the paths, so rounds grow with
    the logarithm of a chain's length. Only narrow rows move, and each round is written, so a lost
    executor costs no more than a round. Tasks follow the number of edges. No edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both.distinct(), "edges")
    size = both.count()  # no table below has more rows
    first = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node")
    labels = written(gathered(first, size), "labels")
    while True:
        # the least label among a node and its neighbours
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        near = gathered(near, size)
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "root", F.least("root", "near").alias("new")
        )
        # a root takes the least label that any node of its tree found
        offers = gathered(hooked.groupBy("root").agg(F.min("new").alias("offer")), size)
        moved = hooked.join(offers, "root").select("node", "root", F.least("new", "offer").alias("new"))
        moved = written(gathered(moved, size), "labels")
        jump = moved.select(F.col("node").alias("_at"), F.col("new").alias("_far"))
        jumped = moved.join(jump, F.col("new") == F.col("_at"), "left").select(
            "node", "root", F.least("new", F.coalesce("_far", "new")).alias("new")
        )
        jumped = written(gathered(jumped, size), "labels")
        removed(labels, moved)
        changed = jumped.where("new <> root").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("root"))
        if not changed:
            removed(both)
            return labels
