"""Ranks and percentiles of documents under each scorer.

Two definitions live side by side. The report ranks 1..N with ties broken by id and gives
(N - rank) / N * 100; the view lets ties share the best rank and gives
(worst rank - rank + 1) / worst rank * 100. Both order by the shown score and then by its exact rank key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quality_probe.operators.needles import interval_ranks
from quality_probe.operators.ordering import SLICE, min_ranks, number_rows, without_slices
from quality_probe.operators.sizes import is_small
from quality_probe.schemas import DOCUMENT_KEYS
from quality_probe.scratch import written

BY = ["classifier"]
RANK_KEYS = ["rank_high", "rank_low"]
FEW = 1_000_000  # needles times scorers


def scored(scores: DataFrame) -> DataFrame:
    """Rows with a score: neither null nor NaN."""
    return scores.dropna(subset=["score"])


def needles(scores: DataFrame) -> DataFrame:
    """Documents that carry benchmark text."""
    return scores.filter(F.col("contains_benchmark"))


def coerced(column) -> Column:
    """A number, or null where the value is none (NaN included)."""
    number = F.col(column).try_cast("double")
    return F.when(~F.isnan(number), number)


def percentile_of(rank: Column, total: Column) -> Column:
    return (total - rank) / total * 100


def with_rank_keys(scores: DataFrame) -> DataFrame:
    """Null rank keys where a scorer or a store has none; then the shown score alone ranks."""
    lacking = [c for c in RANK_KEYS if c not in scores.columns]
    return scores.withColumns({c: F.lit(None).cast("long") for c in lacking})


def best_first() -> list:
    """Order of a scorer's documents: what the shown score rounds to one value is told apart by the exact key."""
    return [F.desc("score"), *[F.desc(c) for c in RANK_KEYS], F.col("id")]


def ordinal_ranks(scores: DataFrame) -> DataFrame:
    """Report rank of every scored document, with `total` documents per scorer."""
    kept = with_rank_keys(scored(scores)).select(*BY, *DOCUMENT_KEYS, "score", *RANK_KEYS)
    return number_rows(kept, BY, best_first(), "rank", "total").drop(*RANK_KEYS)


def shared_ranks(scores: DataFrame) -> DataFrame:
    """View rank and percentile of every document; an unscored one keeps its place without them."""
    kept = with_rank_keys(scores).select(*BY, *DOCUMENT_KEYS, coerced("score").alias("score"), *RANK_KEYS)
    numbered = number_rows(kept.dropna(subset=["score"]), BY, best_first(), "row_number")
    value = F.struct("score", *[F.coalesce(c, F.lit(0)).alias(c) for c in RANK_KEYS])
    ranked = min_ranks(numbered.withColumn("_value", value), BY, "_value", worst="_worst")
    ranked = ranked.withColumn("percentile", (F.col("_worst") - F.col("rank") + 1) / F.col("_worst") * 100)
    missing = kept.filter(F.col("score").isNull()).drop(*RANK_KEYS)
    return ranked.drop("row_number", SLICE, "_value", "_worst", *RANK_KEYS).unionByName(missing, allowMissingColumns=True)


def needle_ranks(scores: DataFrame) -> DataFrame:
    """Report ranks of the needles alone.

    While the needles are few, all other documents are only counted between them; many needles are taken from the
    ranking of all documents.
    """
    kept = with_rank_keys(scored(scores)).select(*BY, *DOCUMENT_KEYS, "score", *RANK_KEYS)
    found = written(needles(kept), "needles")
    if is_small(found, "id", max_rows=FEW):
        ranked = interval_ranks(kept, found).select(*BY, *DOCUMENT_KEYS, "score", "rank", "total")
    else:
        ranked = without_slices(needles(ordinal_ranks(scores)))
    return ranked.withColumn("percentile", percentile_of(F.col("rank"), F.col("total")))
