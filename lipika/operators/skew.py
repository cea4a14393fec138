"""Joins that stay balanced when a key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 256
#: Fewer rows than this under one key are no burden to a task, whatever their share.
HOT_ROWS = 100_000


def hot_keys(big: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, rows: int = HOT_ROWS) -> list[tuple]:
    """Keys of ``big`` that hold at least ``share`` of its rows, and ``rows`` of them: at most ``1 / share`` keys.

    The counts are pre-aggregated before the shuffle, so the hot key itself
    moves as one row a task. Mostly there is none, which one row tells.
    """
    n = big.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, total = n.agg(F.max("_n"), F.sum("_n")).first()
    least = max(share * (total or 0), rows)
    if not total or most < least:
        return []
    return [tuple(r) for r in n.where(F.col("_n") >= least).select(*keys).collect()]


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", share: float = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """Join ``big`` with ``small``, which has each key once, without a hot task.

    Rows under hot keys are joined by broadcast (at most ``1 / share`` rows of
    ``small`` by construction); all others by a shuffle on the keys. ``how`` is
    ``left`` or ``inner``. A null key matches nothing. ``big`` is counted
    first, so a costly one should be a written table.
    """
    keys = list(keys)
    found = hot_keys(big, keys, share, rows)
    if not found:
        return big.join(small, keys, how)
    hot = big.sparkSession.createDataFrame([(*k, True) for k in found], big.select(*keys).schema.add("_hot", "boolean"))
    marked = big.join(F.broadcast(hot), keys, "left")
    few = small.join(F.broadcast(hot), keys, "left_semi")
    is_hot = F.col("_hot").isNotNull()
    a = marked.where(is_hot).drop("_hot").join(F.broadcast(few), keys, how)
    b = marked.where(~is_hot).drop("_hot").join(small, keys, how)
    return a.unionByName(b)
