"""Aggregations that recur (D): confidence statistics, histograms, two-level means, calibration bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.operators.ordering import numbered, tile


def conf_stats(c: Column) -> list[Column]:
    """n, mean, sd (ddof 1, null below two), sem and the 95 % interval."""
    n, sd = F.count(c), F.stddev_samp(c)
    sem = sd / F.sqrt(F.nullif(n, F.lit(0)))
    return [n.alias("n"), F.avg(c).alias("mean"), sd.alias("sd"), sem.alias("sem"), (F.avg(c) - 1.96 * sem).alias("lo"), (F.avg(c) + 1.96 * sem).alias("hi")]


def above(c: Column, t: float) -> Column:
    """Share of values strictly above ``t``."""
    return F.avg((c > t).cast("double"))


def edge_bin(c: Column, edges: Sequence[float]) -> Column:
    """The bin [lo, hi) of a value, the last one closed; null outside."""
    out = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        upper = c <= edges[i + 1] if i == last else c < edges[i + 1]
        out = F.when((c >= edges[i]) & upper, i).otherwise(out)
    return out


def equal_width(c: Column, bins: int, close_top: bool = False) -> Column:
    """Bin of a value in [0, 1); the top edge is out unless ``close_top``."""
    b = F.floor(c * bins).cast("int")
    return F.when((c >= 0) & (c < 1), b).when((c == 1.0) & F.lit(close_top), bins - 1)


def two_level(df: DataFrame, group: Sequence[str], rep: str, value: Column, least: int = 2) -> DataFrame:
    """Mean and sd over repetitions of each repetition's mean; withheld (null) below ``least`` repetitions."""
    inner = df.groupBy(*group, rep).agg(F.avg(value).alias("_m")).where("_m is not null")
    n = F.count(F.lit(1))
    return inner.groupBy(*group).agg(n.alias("n_rep"), F.when(n >= least, F.avg("_m")).alias("mean"), F.when(n >= least, F.stddev_samp("_m")).alias("sd"), (n >= least).alias("ready"))


def equal_mass_bins(df: DataFrame, by: Sequence[str], conf: str, correct: Column, order: Sequence[Column], k: int = 10) -> DataFrame:
    """(by, bin, n, conf, acc): ``k`` bins of equal size in order of confidence; the first take the remainder."""
    d = df.where(F.col(conf).isNotNull()).withColumn("_ok", F.coalesce(correct, F.lit(False)).cast("double"))
    r = numbered(d, by, [F.col(conf), *order], "_rn", "_n").withColumn("bin", tile(F.col("_rn"), F.col("_n"), k))
    return r.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("conf"), F.avg("_ok").alias("acc"))


def calibration_error(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected calibration error of reliability bins."""
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def mode_share(df: DataFrame, by: Sequence[str], value: str, first: str) -> DataFrame:
    """The most frequent value of each group and its share; ties go to the value seen first."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"))
    best = F.max_by(F.col(value), F.struct("_n", (-F.col("_first")).alias("f")))
    return n.groupBy(*by).agg(best.alias("mode"), (F.max("_n") / F.sum("_n")).alias("share"))


def flip_decomposition(df: DataFrame, by: Sequence[str], divergence: str, agree: str) -> DataFrame:
    """Share of steps whose top choice flips, and the share of all divergence that lies in them."""
    flip = ~F.col(agree)
    return df.groupBy(*by).agg(F.avg(flip.cast("double")).alias("flip_rate"), F.try_divide(F.sum(F.when(flip, F.col(divergence))), F.sum(divergence)).alias("flip_share"))


def confusion_edges(subs: DataFrame, by: list[str], prob: str, rank: str, example: str, order: list[str], top: int = 5, rounded: bool = True) -> DataFrame:
    """Edges of substitutions (``true_cluster``, ``predicted_cluster``) by group: n, mean_prob, mean_rank of those with a probability, top5_share, first_example in ``order``.

    Plain partial aggregates, so a frequent confusion combines map-side.
    """
    fix = (lambda c: F.round(c, 6)) if rounded else (lambda c: c)
    mean_rank = F.avg(F.when(F.col(prob).isNotNull(), F.col(rank)))
    out = subs.groupBy(*by, "true_cluster", "predicted_cluster").agg(
        F.count(F.lit(1)).alias("n"), fix(F.avg(prob)).alias("mean_prob"), fix(mean_rank).alias("mean_rank"), fix(F.avg((F.col(rank) <= top).cast("int"))).alias("top5_share"), F.min_by(example, F.struct(*order)).alias("first_example")
    )
    return out


def nested_conditions(rows: DataFrame, by: str, condition: str, names: list[str], value: str) -> DataFrame:
    """(by, bundle): a struct with n and mean of each named condition, and the mean over all of them."""
    of = lambda c: F.when(F.col(condition) == c, F.col(value))
    parts = [F.struct(F.count(of(c)).alias("n"), F.avg(of(c)).alias("mean")).alias(c) for c in names]
    return rows.groupBy(by).agg(F.struct(*parts, F.avg(value).alias("mean")).alias("bundle"))
