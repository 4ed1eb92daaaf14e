"""Mixing sources to target weights by a Pfair schedule of document blocks, native to the end.

A source with `parts` of `period` slots owes block k (from 0) the window from its release
floor(k * period / parts) to its deadline ceil((k + 1) * period / parts). Serving the released block
with the earliest deadline in every slot keeps each source less than one block off its share at any
time. The schedule repeats after `period` slots, so one period (PERIOD slots or so, whatever the data)
is laid out by a fold, and every block finds its slot by arithmetic. Where a source has run out, its
slots are left out and the others go on in the same order.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quality_probe.operators.ordering import number_rows, without_slices
from quality_probe.scratch import written

PERIOD = 1000
BLOCK = 8
TEMPER = 0.7
SEED = 42
QUEUE_ORDER = ["_draw", "doc_id"]
SLOT_ORDER = ["_at", "source", "row_number"]

# One period: `done` counts the blocks served of each source, `out` has the source of each slot.
FOLD = """
aggregate(
  sequence(0L, period - 1),
  named_struct('done', transform(parts, p -> 0L), 'out', cast(array() as array<int>)),
  (s, t) -> aggregate(
    array(array_min(transform(parts, (p, i) ->
      if((s.done[i] * period) div p <= t,
         named_struct('deadline', ((s.done[i] + 1) * period + p - 1) div p, 'i', i), null))).i),
    s,
    (u, chosen) -> named_struct(
      'done', transform(u.done, (d, i) -> if(i = chosen, d + 1, d)),
      'out', concat(u.out, array(chosen)))),
  s -> s.out)
"""


def tempered(docs: DataFrame, power: float = TEMPER) -> DataFrame:
    """(source, weight): shares of rows raised to `power`, which lifts small sources."""
    return docs.groupBy("source").agg(F.pow(F.count("*"), F.lit(power)).alias("weight"))


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, parts, period, turn, slot) of one period, a bounded table.

    Weights are rounded to parts of about `period`, one part at least, so there may be at most `period`
    sources. Null is a source of its own.
    """
    sources = weights.groupBy("source").agg(F.sum("weight").alias("weight")).where("weight > 0")
    if sources.limit(period + 1).count() > period:
        raise ValueError(f"more than {period} sources: raise `period`")
    shared = sources.withColumn("all", F.sum("weight").over(Window.partitionBy(F.lit(0))))
    parted = shared.select(
        "source", F.greatest(F.lit(1), F.round(F.col("weight") * period / F.col("all"))).cast("long").alias("parts")
    )
    one = parted.agg(F.sort_array(F.collect_list(F.struct("source", "parts"))).alias("all")).select(
        "all",
        F.expr("transform(all, x -> x.parts)").alias("parts"),
        F.expr("aggregate(all, 0L, (s, x) -> s + x.parts)").alias("period"),
    )
    slots = one.where("period > 0").select("all", "period", F.posexplode(F.expr(FOLD)).alias("slot", "i"))
    turn = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return slots.select(
        F.expr("all[i].source").alias("source"),
        F.expr("all[i].parts").alias("parts"),
        "period",
        turn.cast("long").alias("turn"),
        F.col("slot").cast("long").alias("slot"),
    )


def queued(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, _draw, row_number: each source's documents in a seeded order, ids breaking ties."""
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # never null
    queue = docs.select("doc_id", "source", named.alias("_queue"), F.xxhash64("doc_id", F.lit(seed)).alias("_draw"))
    return without_slices(number_rows(queue, ["_queue"], QUEUE_ORDER)).drop("_queue")


def slotted(numbered: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """Add block, release, deadline, slot and `_at`, the slot or a last one, to rows with source and row_number."""
    blocks = numbered.withColumn("block", F.expr(f"(row_number - 1) div {block}"))
    parts = F.broadcast(plan.groupBy("source").agg(F.max("parts").alias("parts"), F.max("period").alias("period")))
    timed = blocks.alias("b").join(parts.alias("p"), F.expr("b.source <=> p.source"), "left").select(
        "b.*",
        "p.parts",
        "p.period",
        F.expr("block % parts").alias("turn"),
        F.expr("(block * period) div parts").alias("release"),
        F.expr("((block + 1) * period + parts - 1) div parts").alias("deadline"),
    )
    found = timed.alias("t").join(
        F.broadcast(plan).alias("s"), F.expr("t.source <=> s.source AND t.turn = s.turn"), "left"
    ).select("t.*", F.expr("(t.block div t.parts) * t.period + s.slot").alias("slot"))
    return found.drop("parts", "period", "turn").withColumn("_at", F.coalesce(F.col("slot"), F.lit((1 << 62) - 1)))


def positions(docs: DataFrame, plan: DataFrame, block: int, seed: int) -> DataFrame:
    placed = number_rows(slotted(queued(docs, seed), plan, block), [], SLOT_ORDER, name="position")
    return without_slices(placed).withColumn("position", F.col("position") - 1)


def mix(docs: DataFrame, weights: DataFrame = None, block: int = BLOCK, period: int = PERIOD, seed: int = SEED) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, position (from 0, no gaps) of every document.

    `weights` is (source, weight); without it the tempered shares. A source that it leaves out, or gives
    no weight, follows after all others. Documents of a source are taken in a seeded order, ids breaking
    ties; repeated rows and null ids keep rows of their own; texts and other columns are not read. An
    empty table gives no rows.
    """
    plan = schedule(tempered(docs) if weights is None else weights, period)  # about `period` rows
    return positions(docs, plan, block, seed).select(
        "doc_id", "source", "block", "release", "deadline", "slot", "position"
    )


def mixed_documents(docs: DataFrame, weights: DataFrame = None, slices: int = None) -> DataFrame:
    """The documents in mixed order: `slices` partitions of equal ranges of positions, one after the other.

    Texts move once. In each source a slice begins at some draw; these borders, at most sources times slices rows,
    tell every document its slice and the rank with which the slice begins, so ranks and slots are counted anew
    where the texts arrive. Rows of one source that share an id stay together. `slices` is the number of shuffle
    partitions unless given. An empty table gives no rows; other columns pass, whatever their names.
    """
    slices = slices or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = written(schedule(tempered(docs) if weights is None else weights), "schedule")
    total = max(docs.count(), 1)
    found = positions(docs, plan, BLOCK, SEED).withColumn("_slice", F.expr(f"cast(position * {slices} div {total} AS int)"))
    key = F.struct("_draw", "doc_id")
    begun = found.groupBy("source", "_slice").agg(F.min(key).alias("key"), F.min("row_number").alias("first"))
    borders = begun.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("key", "_slice", "first"))).alias("_borders"))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), "doc_id", "source", F.xxhash64("doc_id", F.lit(SEED)).alias("_draw")
    )
    border = F.expr("element_at(filter(_borders, b -> b.key <= struct(_draw, doc_id)), -1)")
    sliced = rows.alias("d").join(F.broadcast(borders).alias("p"), F.expr("d.source <=> p.source"), "left").select(
        "d.*", border.alias("_border")
    ).select("_row", "doc_id", "source", "_draw", F.col("_border._slice").alias("_slice"), F.col("_border.first").alias("_first"))
    moved = sliced.repartitionByRange(slices, "_slice")
    rank = F.row_number().over(Window.partitionBy("_slice", "source").orderBy(*QUEUE_ORDER))
    numbered = moved.withColumn("row_number", F.col("_first") - 1 + rank)
    return slotted(numbered, plan, BLOCK).sortWithinPartitions("_slice", *SLOT_ORDER).select("_row.*")


def stored_order(docs: DataFrame, name: str) -> DataFrame:
    """Add `name`: the place of each row (from 0, dense) in a stored Parquet table, as it was written.

    Scans take files by size, so partition numbers of a scan do not tell; names of files and rows in them do.
    """
    number = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")
    marked = docs.select(
        F.struct(*docs.columns).alias("_doc"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    sizes = marked.groupBy("_file").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    begun = sizes.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_begin"))
    return marked.join(F.broadcast(begun), "_file").select("_doc.*", (F.col("_begin") + F.col("_at")).alias(name))
