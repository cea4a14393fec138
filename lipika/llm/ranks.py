"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one group are ranked in buckets of about this many.
BUCKET_ROWS = 200_000


def rank_within(df: DataFrame, key: str, unique: list[str], rows: int) -> DataFrame:
    """``df``, a table of ``rows`` rows, with ``rank``: 0, 1, .. within each ``key``.

    Rows fall into hash buckets; counts by bucket, aggregated before they are
    shuffled, give each bucket its first rank. ``unique`` tells rows apart, so
    that the order is the same on every run; equal rows rank in any order. A
    null key is a group.
    """
    buckets = max(4, -(-rows // BUCKET_ROWS))
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(*unique), F.lit(buckets)).cast("int"))
    n = salted.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offset = n.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_offset"))
    row = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*unique)) - 1
    ranked = salted.withColumn("_row", row).join(offset, (F.col("_bucket") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_key")))
    return ranked.withColumn("rank", F.col("_offset") + F.col("_row")).drop("_bucket", "_key", "_b", "_offset", "_row")
