"""The web corpus: first-N scan and quality-prefiltered scan."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.functions import heads
from quality_probe.operators.ordering import number_rows, without_slices
from quality_probe.operators.sizes import broadcast_if_small
from quality_probe.schemas import DOCUMENT, names
from quality_probe.scratch import written

WEB = "web"
QUALITY = "full_quality"  # signal that lets documents in
DEFAULT_SUBSET = "sample-10BT"
FIRST_RANGE = 1000  # positions that the adaptive scan judges at least before it knows a rate
MARGIN = 1.1  # on the number of positions that the rate so far asks for
GROWTH = 4  # a range has at least 1 / GROWTH and at most GROWTH times the positions before it


def dataset_name(path: str, subset: str = DEFAULT_SUBSET) -> str:
    """Last part of the path, plus the subset unless it is the default one."""
    base = path.split("/")[-1]
    return f"{base}-{subset}" if subset and subset != DEFAULT_SUBSET else base


def with_positions(docs: DataFrame, key: str = "doc_id") -> tuple:
    """Add `doc_pos` (0-based, in the order of the unique integer `key`) and return the row count.

    A key without gaps already is the position: n keys in a range of n are all different if their
    hashes sum to those of the range, which takes no shuffle. Otherwise the keys alone are numbered
    and joined back. Null and repeated keys raise a ValueError.
    """
    total = F.sum(F.xxhash64(F.col(key).cast("bigint")).cast("decimal(38,0)")).alias("total")
    stats = docs.agg(
        F.count("*").alias("rows"), F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), total
    ).first()
    n, low, high = stats["n"], stats["low"], stats["high"]
    if stats["rows"] > n:
        raise ValueError(f"{stats['rows'] - n} documents have no {key}")
    if n == 0:
        return docs.withColumn("doc_pos", F.lit(0).cast("bigint")), 0
    gapless = high - low + 1 == n
    if gapless:
        repeated = docs.sparkSession.range(low, high + 1).toDF(key).agg(total).first()["total"] != stats["total"]
    else:
        repeated = not docs.groupBy(key).count().filter("count > 1").isEmpty()
    if repeated:
        raise ValueError(f"{key} is not unique")
    if gapless:
        shifted = F.col(key) if low == 0 else F.col(key) - low  # the bare key lets filters reach the scan
        placed = docs.withColumn("doc_pos", shifted.cast("bigint"))
    else:
        numbered = without_slices(number_rows(docs.select(key), [], [key], "doc_pos"))
        placed = docs.join(numbered.withColumn("doc_pos", F.col("doc_pos") - 1), key)
    return placed, n


def as_documents(docs: DataFrame) -> DataFrame:
    """Document columns from `doc_pos`, `text` and optionally `original_score`; other columns stay."""
    score = F.col("original_score") if "original_score" in docs.columns else F.lit(None)
    known = names(DOCUMENT)
    return docs.select(
        *[c for c in docs.columns if c not in known and c != "source"],
        "doc_pos",
        F.concat(F.lit(f"{WEB}_"), F.col("doc_pos").cast("string")).alias("id"),
        F.lit(WEB).alias("source"),
        "text",
        F.lit(False).alias("contains_benchmark"),
        F.lit(None).cast("string").alias("benchmark_type"),
        F.lit(None).cast("int").alias("benchmark_index"),
        F.lit(None).cast("string").alias("benchmark_subject"),
        F.col("text").alias("original_text"),
        score.cast("double").alias("original_score"),
    )


def first_documents(docs: DataFrame, rows: int, num_docs: int = None) -> tuple:
    """The first `num_docs` of positioned documents (all, if None) and their number."""
    if num_docs is None or num_docs >= rows:
        return docs, rows
    return docs.filter(F.col("doc_pos") < num_docs), num_docs


def web_documents(docs: DataFrame, num_docs: int = None, subset=None, key: str = "doc_id") -> tuple:
    """The first `num_docs` documents (all, if None) and their number. `subset` filters first."""
    if subset is not None:
        docs = docs.filter(subset)
    placed, rows = first_documents(*with_positions(docs.select(key, "text"), key), num_docs)
    return as_documents(placed), rows


def prefiltered(scores: DataFrame, min_score: float, num_docs: int = None, key: str = "doc_id") -> DataFrame:
    """Accepted documents: `key`, position among the accepted, source position and score.

    `scores` holds `key`, `doc_pos`, `original_score` and the exact key of QUALITY, which decides; only narrow rows
    are numbered.
    """
    accepted = number_rows(
        scores.filter(heads.reaches(QUALITY, min_score)).select(key, "doc_pos", "original_score"),
        [],
        ["doc_pos"],
        "accepted",
    )
    if num_docs is not None:
        accepted = accepted.filter(F.col("accepted") <= num_docs)
    return without_slices(accepted).select(
        key, (F.col("accepted") - 1).alias("doc_pos"), F.col("doc_pos").alias("source_pos"), "original_score"
    )


def next_range(processed: int, found: int, wanted: int) -> int:
    """How many positions to judge next, from the share accepted so far."""
    if not processed:
        return max(FIRST_RANGE, wanted)
    asked = int(MARGIN * (wanted - found) * processed / found) + 1 if found else GROWTH * processed
    return min(max(asked, processed // GROWTH + 1), GROWTH * processed)


def first_accepted(docs: DataFrame, rows: int, judge, min_score: float, num_docs: int, key: str = "doc_id") -> DataFrame:
    """`prefiltered`, but reading stops soon after the `num_docs`-th accepted of the positioned `docs`.

    `judge(part)` gives the scores of some documents. Ranges of positions are judged one after the other; the share
    accepted so far sizes the next one, and ranges grow with what is behind them, so their number is logarithmic. A
    range also goes to the scan as a range of keys, as positions follow the keys. Only accepted keys are kept between.
    """
    found, processed, accepted = 0, 0, None
    while processed < rows and found < num_docs or accepted is None:
        end = min(rows, processed + next_range(processed, found, num_docs))
        inside = docs.filter((F.col("doc_pos") >= processed) & (F.col("doc_pos") < end))
        low, high = inside.agg(F.min(key), F.max(key)).first()
        part = inside if low is None else inside.filter(F.col(key).between(low, high))
        judged = judge(part).filter(heads.reaches(QUALITY, min_score))
        kept = written(judged, "accepted-range")
        found, processed = found + kept.count(), end
        accepted = kept if accepted is None else accepted.unionByName(kept)
    return prefiltered(accepted, min_score, num_docs, key)


def prefiltered_documents(docs: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents numbered over the accepted ones, with the score that let them in."""
    return as_documents(docs.select(key, "text").join(broadcast_if_small(kept), key))


def acceptance(docs_rows: int, kept: DataFrame, num_docs: int = None) -> DataFrame:
    """Accepted and processed counts: reading stops at the `num_docs`-th accepted document."""
    reached = F.count("*") >= num_docs if num_docs is not None else F.lit(False)
    return kept.agg(
        F.count("*").alias("accepted"),
        F.when(reached, F.max("source_pos") + 1).otherwise(F.lit(docs_rows)).cast("bigint").alias("processed"),
    ).withColumn("acceptance_rate", F.round(F.try_divide("accepted", "processed"), 6))
