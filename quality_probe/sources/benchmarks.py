"""Benchmark items: registry, sampling, numbering and rendering."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quality_probe.functions import templates
from quality_probe.functions.templates import quoted
from quality_probe.operators.ordering import number_rows, without_slices
from quality_probe.schemas import ITEM_DATA, StructField, StructType, S, L


@dataclass(frozen=True)
class Benchmark:
    """One benchmark: how its rows become text and how they are sampled.

    `render` takes the names of the data struct and of the subject and gives SQL. `sampling` is "by_subject" (the first rows of each subject), "strict" (a random sample that must
    be full) or "capped" (a random sample of at most all rows).
    """

    name: str
    render: Callable[[str, str], str]
    sampling: str = "capped"

    def text(self) -> Column:
        return F.expr(self.render("data", "subject"))


BENCHMARKS: dict = {}


def register_benchmark(benchmark: Benchmark) -> None:
    BENCHMARKS[benchmark.name] = benchmark


register_benchmark(Benchmark("mmlu", templates.mmlu, "by_subject"))
register_benchmark(Benchmark("gsm8k", templates.gsm8k, "strict"))
register_benchmark(Benchmark("gpqa", templates.gpqa, "strict"))
register_benchmark(Benchmark("arc_challenge", templates.arc("arc_challenge")))
register_benchmark(Benchmark("arc_easy", templates.arc("arc_easy")))
register_benchmark(Benchmark("hellaswag", templates.hellaswag))
register_benchmark(Benchmark("piqa", templates.piqa))
register_benchmark(Benchmark("truthfulqa", templates.truthfulqa))


def benchmark(name: str) -> Benchmark:
    if name not in BENCHMARKS:
        raise ValueError(f"Unknown benchmark type: {name}")
    return BENCHMARKS[name]


def read_rows(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Raw rows of one benchmark (`item_id`, `subject`, `data`) from a parquet table."""
    fields = [StructField("item_id", L), StructField("subject", S), StructField("data", ITEM_DATA[name])]
    return spark.read.schema(StructType(fields)).parquet(path)


def ordered_rows(rows: DataFrame, name: str, subjects=None, seed: int = 42) -> DataFrame:
    """Rows with the keys that order them for sampling: `subject_pos` and `order_key`."""
    if benchmark(name).sampling == "by_subject":
        if not subjects:
            raise ValueError(f"{name} requires subjects")
        listed = ", ".join(quoted(s) for s in subjects)
        return rows.filter(F.col("subject").isin(list(subjects))).selectExpr(
            "*",
            f"cast(array_position(array({listed}), subject) AS int) AS subject_pos",
            "lpad(cast(item_id AS string), 20, '0') AS order_key",
        )
    draw = f"md5(concat_ws('|', '{seed}', {quoted(name)}, cast(item_id AS string)))"  # seeded random order
    return rows.selectExpr("*", "0 AS subject_pos", f"{draw} AS order_key")


def checked_counts(rows: DataFrame, name: str, count: int, subjects=None) -> None:
    """Raise if a benchmark whose sample must be full has too few rows."""
    kind = benchmark(name).sampling
    if kind == "strict" and rows.count() < count:
        raise ValueError(f"{name}: sample of {count} is larger than the benchmark")
    if kind == "by_subject":
        found = {r["subject"]: r["count"] for r in rows.groupBy("subject").count().collect()}
        short = [s for s in subjects if found.get(s, 0) < count]
        if short:
            raise ValueError(f"{name}: fewer than {count} rows for {short}")


def load_samples(rows: DataFrame, name: str, count: int = 5, subjects=None, seed: int = 42) -> DataFrame:
    """Sampled raw rows of one benchmark; `count` None keeps every row.

    The count is small, so each task keeps at most `count` rows per subject before the shuffle.
    """
    ordered = ordered_rows(rows, name, subjects, seed)
    if count is None:
        return ordered
    checked_counts(ordered, name, count, subjects)
    window = Window.partitionBy("subject_pos").orderBy("order_key")
    return ordered.withColumn("_k", F.row_number().over(window)).filter(F.col("_k") <= count).drop("_k")


def rendered(samples: DataFrame, name: str, type_pos: int = 0) -> DataFrame:
    """Samples as text, with the keys that number them."""
    has_subject = benchmark(name).sampling == "by_subject"
    return samples.selectExpr(
        f"{type_pos} AS type_pos",
        f"{quoted(name)} AS benchmark_type",
        "subject_pos",
        "order_key",
        f"{'subject' if has_subject else 'cast(NULL AS string)'} AS subject",
        f"{benchmark(name).render('data', 'subject')} AS text",
    )


def numbered_items(texts: DataFrame) -> DataFrame:
    """Items in append order: `item_pos` over all types and `benchmark_index` within each type."""
    order = ["type_pos", "subject_pos", "order_key"]
    placed = without_slices(number_rows(texts, [], order, "item_pos")).withColumn("item_pos", F.col("item_pos") - 1)
    starts = placed.groupBy("type_pos").agg(F.min("item_pos").alias("_start"))  # one row per type
    return placed.join(F.broadcast(starts), "type_pos").select(
        "item_pos",
        "type_pos",
        "benchmark_type",
        (F.col("item_pos") - F.col("_start")).cast("int").alias("benchmark_index"),
        "subject",
        "text",
    )


def sampled_items(frames: dict, config: dict, seed: int = 42) -> DataFrame:
    """Items of all configured benchmarks: `config` maps a type to {"count", "subjects"}."""
    texts = [
        rendered(load_samples(frames[name], name, c.get("count", 5), c.get("subjects"), seed), name, pos)
        for pos, (name, c) in enumerate(config.items())
    ]
    return numbered_items(reduce(DataFrame.unionByName, texts))
