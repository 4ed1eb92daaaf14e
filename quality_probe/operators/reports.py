"""Reports over scores: summaries, thresholds, top documents, filters, effects."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quality_probe.operators.ordering import number_rows, quantiles
from quality_probe.operators.ranking import BY, RANK_KEYS, best_first, needles, scored, with_rank_keys
from quality_probe.schemas import DOCUMENT_KEYS
from quality_probe.sources.benchmarks import BENCHMARKS
from quality_probe.sources.web import WEB

ALL = "All"
PRESET = "Paper"

# Fixed values.
PRESET_BENCHMARKS = ["mmlu", "gsm8k", "gpqa"]
PRESET_SCORERS = ["three_class", "edu_regression", "binary_ngram", "top_label"]
BENCHMARK_ORDER = ["gpqa", "mmlu", "gsm8k"]
TOP_SHARES = [0.1, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9]
TEXT_MISSING = "[Text not cached - run the experiment to store top documents]"
RULE = "-" * 100


# --- summaries -----------------------------------------------------------------------------------


def needle_summary(ranked: DataFrame) -> DataFrame:
    """Mean, median, best and worst of the needles per scorer; `ranked` holds rank and percentile.

    Rank, percentile and score have one common order, so one numbering gives all three medians.
    """
    columns = ["rank", "percentile", "score"]
    numbered = number_rows(needles(ranked).dropna(subset=["rank"]).select(*BY, "id", *columns), BY, ["rank", "id"],
                           "row_number", "total")
    middle = F.abs(2 * F.col("row_number") - F.col("total") - 1) <= 1

    def median(c: str) -> Column:
        return F.avg(F.when(middle, F.col(c))).alias(f"{c}_median")

    return numbered.groupBy(*BY).agg(
        F.avg("rank").alias("rank_mean"),
        median("rank"),
        F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"),
        F.avg("percentile").alias("percentile_mean"),
        median("percentile"),
        F.avg("score").alias("score_mean"),
        median("score"),
    )


SUMMARY_TITLES = {
    "classifier": "Classifier",
    "rank_mean": "Mean Rank",
    "rank_median": "Median Rank",
    "rank_min": "Best Rank",
    "rank_max": "Worst Rank",
    "percentile_mean": "Mean Percentile",
    "percentile_median": "Median Percentile",
    "score_mean": "Mean Score",
    "score_median": "Median Score",
}


def two_decimals(column) -> Column:
    return F.rint(F.col(column) * 100) / 100


def rounded_summary(summary: DataFrame) -> DataFrame:
    """Two decimals, half-even, under display titles, best mean rank first."""
    rounded = [c for c in SUMMARY_TITLES if c.endswith(("_mean", "_median"))]
    return (
        summary.select(*[two_decimals(c).alias(c) if c in rounded else F.col(c) for c in SUMMARY_TITLES])
        .orderBy("rank_mean", "classifier")
        .withColumnsRenamed(SUMMARY_TITLES)
    )


def score_thresholds(scores: DataFrame) -> DataFrame:
    """Score that the top p percent reach, interpolated, over all scored documents."""
    shares = {float(p): (100 - p) / 100 for p in TOP_SHARES}
    found = quantiles(scored(scores), BY[0], "score", shares)
    return found.select(*BY, F.col("label").alias("p"), F.round("score", 10).alias("threshold"))


def score_stats(scores: DataFrame) -> DataFrame:
    """Mean, median, min and max over all scored documents of each scorer."""
    median = quantiles(scored(scores), BY[0], "score", {"median": 0.5})
    stats = scored(scores).groupBy(*BY).agg(
        F.round(F.avg("score"), 6).alias("score_mean"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
    )
    return stats.join(F.broadcast(median.select(*BY, F.round("score", 10).alias("score_median"))), BY)


def score_range(scores: DataFrame) -> DataFrame:
    return scored(scores).groupBy(*BY).agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"))


def corpus_counts(scores: DataFrame) -> DataFrame:
    """Scored rows of each scorer and the largest such number."""
    counts = scores.groupBy(*BY).agg(
        F.count("*").alias("documents"),
        F.count("score").alias("scored"),
        F.count_if("contains_benchmark").alias("needles"),
    )
    return counts.withColumn("num_docs", F.max("documents").over(Window.partitionBy(F.lit(0))))


def facets(scores: DataFrame) -> DataFrame:
    """Distinct scorers and benchmark types, the choices of a filter."""
    kinds = F.array(
        F.struct(F.lit("classifier").alias("facet"), F.col("classifier").alias("value")),
        F.struct(F.lit("benchmark_type").alias("facet"), F.col("benchmark_type").alias("value")),
    )
    return (
        scores.select(F.inline(kinds)).filter(F.col("value").isNotNull()).distinct().orderBy("facet", "value")
    )


def inferred_mode(scores: DataFrame) -> DataFrame:
    """"injected" if any web document carries benchmark text, else "separate"."""
    inside = F.coalesce(F.bool_or((F.col("source") == WEB) & F.col("contains_benchmark")), F.lit(False))
    return scores.agg(F.when(inside, "injected").otherwise("separate").alias("mode"))


# --- filters and order ---------------------------------------------------------------------------


def expanded(selection: list, preset: list) -> list:
    """Names to keep, or None for all: the preset stands for its members."""
    if not selection or ALL in selection:
        return None
    if PRESET not in selection:
        return list(selection)
    return preset + [s for s in selection if s != PRESET]


def filtered(df: DataFrame, column: str, selection: list, preset: list) -> DataFrame:
    kept = expanded(selection, preset)
    return df if kept is None else df.filter(F.col(column).isin(kept))


def filter_benchmarks(df: DataFrame, selection: list) -> DataFrame:
    return filtered(df, "benchmark_type", selection, PRESET_BENCHMARKS)


def filter_scorers(df: DataFrame, selection: list) -> DataFrame:
    return filtered(df, "classifier", selection, PRESET_SCORERS)


def preset_position(column, preset: list) -> Column:
    """Place in the preset, or behind all of it."""
    place = F.array_position(F.array(*[F.lit(p) for p in preset]), F.col(column))
    return F.coalesce(F.nullif(place, F.lit(0).cast("bigint")), F.lit(999).cast("bigint"))


# --- top documents -------------------------------------------------------------------------------


def top_documents(scores: DataFrame, top_n: int) -> DataFrame:
    """The `top_n` best documents of each scorer; every task keeps at most `top_n` per scorer."""
    order = Window.partitionBy(*BY).orderBy(*best_first())
    kept = with_rank_keys(scored(scores)).select(*BY, *DOCUMENT_KEYS, "score", *RANK_KEYS)
    best = kept.withColumn("top_rank", F.row_number().over(order)).drop(*RANK_KEYS)
    return best.filter(F.col("top_rank") <= top_n)


def top_ids(scores: DataFrame, top_n: int) -> DataFrame:
    """Ids that any scorer has among its best; at most scorers x `top_n`."""
    return top_documents(scores, top_n).select("id").distinct()


def top_texts(scores: DataFrame, docs: DataFrame, top_n: int) -> DataFrame:
    return docs.select("id", "text").join(F.broadcast(top_ids(scores, top_n)), "id", "left_semi")


def merged_texts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both stores' texts; an id already present keeps its text."""
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti"))


def top_document_cards(scores: DataFrame, texts: DataFrame, top_n: int = 10) -> DataFrame:
    """One card per top document: header line and text, or a note where the text is not stored."""
    top = top_documents(scores, top_n).join(F.broadcast(score_range(scores)), BY)
    kind = F.when(F.col("contains_benchmark"), "🔴 BENCHMARK").otherwise("🟢 Regular")
    suffix = F.when(F.col("contains_benchmark"), F.concat(F.lit(" | Type: "), F.col("benchmark_type"))).otherwise("")
    header = F.format_string(
        "Top %d | %s | %s | ID: %s | Score: %.6f | Range: %.6f–%.6f%s",
        "top_rank", "classifier", kind, "id", "score", "score_min", "score_max", suffix,
    )
    # The top rows are few, so they go to the texts; how long these are is not known.
    found = texts.select("id", "text").join(F.broadcast(top.select("id").distinct()), "id", "left_semi")
    return top.join(found, "id", "left").select(
        *BY,
        "top_rank",
        "id",
        F.format_string("Score Range: %.6f (min) to %.6f (max)", "score_min", "score_max").alias("score_range"),
        header.alias("header"),
        F.coalesce("text", F.lit(TEXT_MISSING)).alias("text"),
    )


def rendered_cards(cards: DataFrame) -> DataFrame:
    """The cards of each scorer as one text; at most `top_n` cards each."""
    ordered = F.array_sort(F.collect_list(F.struct("top_rank", "header", "text")))
    return (
        cards.groupBy(*BY, "score_range").agg(ordered.alias("cards"))
        .select(*BY, F.concat(
            F.col("score_range"), F.lit("\n\n"),
            F.array_join(F.transform("cards", lambda c: F.concat(
                F.lit(f"\n{RULE}\n"), c["header"], F.lit(f"\n{RULE}\n"), c["text"], F.lit("\n"))), "\n"),
        ).alias("report"))
    )


# --- rank report and effect ----------------------------------------------------------------------


def rank_report(ranked: DataFrame) -> DataFrame:
    """One row per needle with a map from scorer to its rank, percentile and score."""
    entry = F.struct("classifier", F.struct("rank", "percentile", "score").alias("result"))
    return ranked.groupBy("id", "benchmark_type", "benchmark_index").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scorers")
    )


def rank_report_wide(ranked: DataFrame, scorers: list) -> DataFrame:
    """One row per needle with flat columns per scorer; null where a scorer has no result."""
    found = F.col("scorers")
    columns = [
        found[s][field].alias(f"{s}_{field}") for s in scorers for field in ("rank", "percentile", "score")
    ]
    return rank_report(ranked).select("id", "benchmark_type", "benchmark_index", *columns)


def rank_report_json(ranked: DataFrame) -> DataFrame:
    """The report as JSON text, scorers nested under their names."""
    report = rank_report(ranked)
    key = F.to_json(F.struct("id", "benchmark_type", "benchmark_index"))
    nested = F.to_json("scorers")
    merged = F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit(","),
                      F.substring(nested, F.lit(2), F.length(nested)))
    return report.select("id", "benchmark_type", "benchmark_index", merged.alias("report"))


def injection_effect(positions: DataFrame, touched: DataFrame, benchmark_scores: DataFrame,
                     original_scores: DataFrame) -> DataFrame:
    """Score with and without the items, one row per item; nulls for items that stand alone.

    `touched` (id, source), `benchmark_scores` (id, score) and `original_scores` (id, score) hold
    the documents of the log only.
    """
    standalone = F.col("source").isin(list(BENCHMARKS))
    original = F.when(~standalone, F.col("original_score"))
    return (
        positions.join(touched.select(F.col("id").alias("doc_id"), "source"), "doc_id")
        .join(benchmark_scores.select(F.col("id").alias("doc_id"), F.col("score").alias("benchmark_score")), "doc_id")
        .join(original_scores.select(F.col("id").alias("doc_id"), F.col("score").alias("original_score")),
              "doc_id", "left")
        .select(
            "doc_id",
            "benchmark_type",
            "index",
            "subject",
            standalone.alias("is_standalone"),
            original.alias("original_score"),
            "benchmark_score",
            F.round(F.col("benchmark_score") - original, 6).alias("difference"),
        )
    )
