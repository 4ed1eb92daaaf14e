"""Report files. Folders hold the parts that the tasks wrote."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_suffix(injected: bool, prefiltered: bool, num_docs: int) -> str:
    mode = "injected" if injected else "separate"
    return f"_{mode}{'_prefiltered' if prefiltered else ''}_{num_docs}docs"


def run_folder(base: str, now: datetime = None) -> str:
    return f"{base}/{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def tagged(df: DataFrame, run_id: str, injected: bool, prefiltered: bool, num_docs: int) -> DataFrame:
    """Add the columns that tell runs apart; use them as partition columns."""
    return (
        df.withColumn("run_id", F.lit(run_id))
        .withColumn("mode", F.lit("injected" if injected else "separate"))
        .withColumn("prefiltered", F.lit(prefiltered))
        .withColumn("num_docs", F.lit(num_docs))
    )


def write_sorted_scores(ordinal: DataFrame, path: str) -> None:
    """Score table as CSV, best first over all parts of a scorer."""
    keys = ["classifier", "rank"]
    (
        ordinal.drop("_slice")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.option("header", True)
        .csv(path)
    )


def write_rank_report(report: DataFrame, path: str) -> None:
    """One JSON line per needle from `rank_report_json`."""
    report.select(F.col("report").alias("value")).write.text(path)


def write_needle_rankings(ranked: DataFrame, path: str) -> None:
    ranked.select("classifier", "id", "rank", F.col("total").alias("total_docs"), "percentile", "score").write.json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Thresholds, effects and other flat reports."""
    df.write.json(path)
