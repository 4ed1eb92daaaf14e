"""Size checks before a broadcast, and tasks by the number of rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20


def is_small(df: DataFrame, text: str = None, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows (and the bytes of `text`) are within the bounds."""
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    found = df.agg(F.count("*").alias("rows"), size.alias("bytes")).first()
    return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, text: str = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, text, max_rows) else df


def gathered(df: DataFrame, rows: int, per_task: int = 1 << 14) -> DataFrame:
    """`df`, of `rows` rows at most, in no more tasks than these need; many rows keep the partitions they have."""
    return df.coalesce(max(1, -(-rows // per_task)))
