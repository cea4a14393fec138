"""Global order without a global task: row numbers, ranks and running sums.

A window without partition columns, or over a group that holds a third of all
rows, runs in one task. Here rows are range-partitioned by their order; each
partition's totals (one row a partition) give the others their offsets, and
running sums stay within partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipika.operators.skew import broadcast_if_small
from lipika.session import written

#: Groups whose sizes may be broadcast; with more, no group is large enough to matter beside AQE's splitting.
GROUPS = 1_000_000


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, its running total in the global order, the row itself included.

    ``order`` must end in a unique column for a stable result. The ordered
    rows are written once, so both passes see the same partitions.
    """
    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = part.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = part.withColumns({f"_w_{k}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *[(F.col(f"_s_{k}") + F.col(f"_w_{k}")).alias(k) for k in sums])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn", size: str | None = None) -> DataFrame:
    """Row numbers from 1 within each group of ``by``, in ``order``; ``size`` also names the group's size.

    The groups lie one after another in one global order, so a group of any
    size spreads over many tasks. Null keys form a group.
    """
    by = list(by)
    ranked = running(df, [*[F.col(c).asc_nulls_first() for c in by], *order], {"_all": F.lit(1)})
    if not by:
        out = ranked.withColumnRenamed("_all", name)
        return out if size is None else out.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(size))))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    starts = running(sizes, [F.col(c).asc_nulls_first() for c in by], {"_end": F.col("_n")})
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    starts = starts.select(*keys, (F.col("_end") - F.col("_n")).alias("_start"), F.col("_n").alias("_size"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = ranked.join(broadcast_if_small(starts, GROUPS), same, "left").withColumn(name, F.col("_all") - F.col("_start"))
    out = out.withColumnRenamed("_size", size) if size else out.drop("_size")
    return out.drop("_all", "_start", *[f"_k{i}" for i in range(len(by))])


def tile(rn: Column, n: Column, k: int) -> Column:
    """The bin 1..k of row ``rn`` among ``n``: equal bins, of which the first take the remainder."""
    each, rest = F.floor(n / k), n % k
    cut = rest * (each + 1)
    return F.when(rn <= cut, F.floor((rn - 1) / (each + 1)) + 1).otherwise(rest + F.floor((rn - 1 - cut) / F.greatest(each, F.lit(1))) + 1).cast("int")


def midranks(df: DataFrame, by: Sequence[str], value: str, name: str = "midrank", size: str = "n_all") -> DataFrame:
    """(by, value, ties, ``name``, ``size``): the average rank of each distinct value in its group.

    Equal values are counted first, so ties never meet in one task. Nulls are
    left out.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    upto = running(counts, [*[F.col(c).asc_nulls_first() for c in by], F.col(value)], {"_upto": F.col("ties")})
    if by:
        sizes = counts.groupBy(*by).agg(F.sum("ties").alias(size))
        starts = running(sizes, [F.col(c).asc_nulls_first() for c in by], {"_end": F.col(size)}).withColumn("_start", F.col("_end") - F.col(size)).drop("_end")
        upto = upto.join(broadcast_if_small(starts, GROUPS), by)
    else:
        upto = upto.crossJoin(F.broadcast(counts.agg(F.sum("ties").alias(size)))).withColumn("_start", F.lit(0))
    return upto.withColumn(name, F.col("_upto") - F.col("_start") - (F.col("ties") - 1) / 2.0).drop("_upto", "_start")
