"""Put benchmark items into a corpus: inside documents, or as documents of their own."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quality_probe.operators.sizes import broadcast_if_small, is_small
from quality_probe.schemas import DOCUMENT, names

# Fixed values.
SPLIT_ABOVE = 5000
GAP = "\n\n"


def range_start(type_pos: Column, types: int, docs: int) -> Column:
    return F.floor(type_pos.cast("bigint") * docs / types).cast("bigint")


def range_end(type_pos: Column, types: int, docs: int) -> Column:
    """Inclusive, so it is also the start of the next type's range."""
    return F.least(range_start(type_pos + 1, types, docs), F.lit(docs - 1).cast("bigint"))


def seeded_number(*parts: Column) -> Column:
    """32 bits of the MD5 of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def placed_items(items: DataFrame, docs: int, types: int, seed: int = 42) -> DataFrame:
    """Items with the position of the document they go into; two items may meet in one."""
    low, high = range_start(F.col("type_pos"), types, docs), range_end(F.col("type_pos"), types, docs)
    draw = seeded_number(F.lit(str(seed)), F.col("benchmark_type"), F.col("benchmark_index").cast("string"))
    return (
        items.withColumn("range_start", low)
        .withColumn("range_end", high)
        .withColumn("doc_pos", F.col("range_start") + F.pmod(draw, F.col("range_end") - F.col("range_start") + 1))
    )


def insert(text: Column, item: Column, split_above: int = SPLIT_ABOVE) -> Column:
    """A long text takes the item in its middle, a short one at its end."""
    half = F.floor(F.length(text) / 2).cast("int")
    middle = F.concat(
        F.substring(text, F.lit(1), half),
        F.lit(GAP), item, F.lit(GAP),
        F.substring(text, half + 1, F.length(text)),
    )
    return F.when(F.length(text) > split_above, middle).otherwise(F.concat(text, F.lit(GAP), item))


def insert_all(text: Column, items: Column, split_above: int = SPLIT_ABOVE) -> Column:
    """Items go in one after another; each sees the length its predecessors left."""
    return F.aggregate(items, text, lambda grown, item: insert(grown, item["text"], split_above))


def grouped_by_document(placed: DataFrame) -> DataFrame:
    """One row per touched document with its items in order."""
    item = F.struct("type_pos", "benchmark_index", "benchmark_type", "subject", "text")
    return placed.groupBy("doc_pos").agg(F.array_sort(F.collect_list(item)).alias("items"))


def inject_inside(docs: DataFrame, placed: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Documents with their items inserted; the last item gives the type and index.

    The last item that has a subject gives the subject. Untouched documents pass through unmoved
    while the items are small enough to be sent to every task.
    """
    hits = grouped_by_document(placed)
    if is_small(placed, "text"):
        hits = F.broadcast(hits)
    last = F.element_at("items", -1)
    with_subject = F.filter("items", lambda item: item["subject"].isNotNull())
    touched = F.col("items").isNotNull()
    changed = {
        "text": F.when(touched, insert_all(F.col("text"), F.col("items"), split_above)).otherwise(F.col("text")),
        "contains_benchmark": touched,
        "benchmark_type": last["benchmark_type"],
        "benchmark_index": last["benchmark_index"],
        "benchmark_subject": F.when(F.size(with_subject) > 0, F.element_at(with_subject, -1)["subject"]),
    }
    return docs.join(hits, "doc_pos", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns]
    )


def items_as_documents(items: DataFrame, docs: int) -> DataFrame:
    """One document per item, numbered after the web documents."""
    return items.select(
        (F.col("item_pos") + docs).cast("bigint").alias("doc_pos"),
        F.concat_ws("_", "benchmark_type", F.col("benchmark_index").cast("string")).alias("id"),
        F.col("benchmark_type").alias("source"),
        "text",
        F.lit(True).alias("contains_benchmark"),
        "benchmark_type",
        "benchmark_index",
        F.col("subject").alias("benchmark_subject"),
        F.col("text").alias("original_text"),
        F.lit(None).cast("double").alias("original_score"),
    )


def inject_separate(docs: DataFrame, items: DataFrame, count: int) -> DataFrame:
    return docs.select(names(DOCUMENT)).unionByName(items_as_documents(items, count))


def positions_inside(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """Position log: one row per item. `ids` maps `doc_pos` to the document id."""
    return ids.select("doc_pos", F.col("id").alias("doc_id")).join(broadcast_if_small(placed), "doc_pos").select(
        "doc_id",
        F.col("doc_pos").alias("doc_index"),
        "benchmark_type",
        F.col("benchmark_index").alias("index"),
        "subject",
    )


def positions_separate(items: DataFrame, docs: int) -> DataFrame:
    return items_as_documents(items, docs).select(
        F.col("id").alias("doc_id"),
        F.col("doc_pos").alias("doc_index"),
        "benchmark_type",
        F.col("benchmark_index").alias("index"),
        F.col("benchmark_subject").alias("subject"),
    )
