"""Problem 1: a sample whose categories have given proportions.

The distinct records are written once. One pass over them keeps, for each
category, the histogram of permanent random priorities: a reservoir that holds
counts, not records, so two of them (of two partitions, or of two categories
that one target covers) add up, and no category ever meets in one task. After
it the final counts give feasible quotas, and a selecting pass trims each
target uniformly to its quota by a priority threshold; the one bin that holds
the threshold is divided again until it is small enough to be ranked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipika.llm.labels import engine, image_key, label
from lipika.operators.skew import broadcast_if_small
from lipika.session import pick, written

CATEGORY = ("engine", "language", "variant")
BINS = 4096
#: Records of one target that are ranked in one task; a bin that holds more is divided.
EDGE = 100_000
#: Targets are a table of wishes that people write; more than this is refused.
MAX_TARGETS = 200_000
#: Pairs of category and target that may be broadcast; with more (labels that are free text) the join is shuffled.
MAX_CELLS = 500_000

#: Far below one record; sums of shares are that inexact.
TINY = 1e-6

_QUOTA_SCHEMA = "target_id int, plan_name string, wanted long, available long, quota long, met boolean, exhausted boolean"


def records(readings: DataFrame) -> DataFrame:
    """Distinct (engine, language, image, variant), with the smallest ``row_no`` of each.

    Labels and ids are read in one writing; null engine is the default engine.
    Null or empty language, variant or image id are values of their own. An
    empty table gives no records; other columns are ignored.
    """
    keyed = pick(readings, "engine", "language", "image_id", "variant", "row_no").select(
        engine("engine").alias("engine"), label("language").alias("language"), image_key("image_id").alias("image_id"), label("variant").alias("variant"), "row_no"
    )
    return keyed.groupBy("engine", "language", "image_id", "variant").agg(F.min("row_no").alias("row_no"))


#: Bits of a priority.
BITS = 60


def _priority(seed: int) -> Column:
    """60 uniform bits from the record's own values: the same on every run, partitioning and engine."""
    parts = [F.coalesce(F.col(c), F.lit("-")) for c in ("engine", "language", "image_id", "variant")]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, BITS // 4), 16, 10).cast("long")


def _bin(bits: int, of: str = "priority") -> Column:
    """The leading ``bits`` bits of a priority."""
    return F.shiftright(F.col(of), BITS - bits)


@dataclass
class ProportionalSample:
    """The operator: reservoirs, quotas, report and sample over one set of records."""

    readings: DataFrame
    targets: DataFrame
    bins: int = BINS
    seed: int = 0
    _drawn: DataFrame | None = field(default=None, init=False, repr=False)

    def __post_init__(self) -> None:
        self.bits = max(1, (self.bins - 1).bit_length())
        wishes = pick(self.targets, "target_id", "plan_name", "plan_size", "engine", "language", "variant", "target_share", "min_rows").select(
            "target_id", "plan_name", "plan_size", label("engine").alias("t_engine"), label("language").alias("t_language"), label("variant").alias("t_variant"), "target_share", F.coalesce("min_rows", F.lit(0)).alias("min_rows")
        )
        rows = wishes.limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.wishes = self.targets.sparkSession.createDataFrame(rows, wishes.schema)

    @property
    def drawn(self) -> DataFrame:
        """The distinct records with their priorities and bins, written once for all passes."""
        if self._drawn is None:
            found = records(self.readings).withColumn("priority", _priority(self.seed))
            self._drawn = written(found.withColumn("bin", _bin(self.bits)), "records")
        return self._drawn

    def reservoirs(self) -> DataFrame:
        """(engine, language, variant, bin, n): each category's priorities, at most ``bins`` rows a category."""
        return self.drawn.groupBy(*CATEGORY, "bin").agg(F.count(F.lit(1)).alias("n"))

    def _cells(self, counts: DataFrame) -> DataFrame:
        """``counts``, a table of categories, with the ``target_id`` of each target that covers the category.

        A target covers a category that has its value in each of its non-null
        columns. So every category is looked up, by equality, under each
        subset of its columns; a null value is under no subset that names it.
        """
        subsets = [tuple(c for i, c in enumerate(CATEGORY) if k >> i & 1) for k in range(1 << len(CATEGORY))]
        named = lambda cols, prefix: F.to_json(F.struct(*[F.col(prefix + c).alias(c) for c in cols])) if cols else F.lit("{}")
        known = lambda cols: F.forall(F.array(*[F.col(c).isNotNull() for c in cols]), lambda x: x) if cols else F.lit(True)
        keys = F.array_compact(F.array(*[F.when(known(cols), named(cols, "")) for cols in subsets]))
        wishes = self.wishes.select("target_id", named(CATEGORY, "t_").alias("key"))  # a null column is left out of the JSON
        return counts.withColumn("key", F.explode(keys)).join(broadcast_if_small(wishes, MAX_CELLS), "key").drop("key")

    def _have(self) -> DataFrame:
        """(target_id, available): the records that belong to each target."""
        cells = (records(self.readings) if self._drawn is None else self._drawn).groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("cell_n"))
        return self._cells(cells).groupBy("target_id").agg(F.sum("cell_n").alias("available"))

    def report(self) -> DataFrame:
        """One row a target: wanted, available, quota, whether it can be met and whether its category is exhausted.

        ``wanted`` is the larger of ``min_rows`` and the rounded share. Quotas
        of a plan are in proportion to the shares, but not below the floor
        nor above what there is, and add up to the plan's size as far as
        floors and records allow. A null share counts as 0.
        """
        wanted = F.greatest(F.col("min_rows").cast("long"), F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("plan_size", F.lit(0))).cast("long"))
        t = self.wishes.join(self._have(), "target_id", "left").select("target_id", "plan_name", F.coalesce("plan_size", F.lit(0)).alias("plan_size"), "target_share", "min_rows", wanted.alias("wanted"), F.coalesce("available", F.lit(0)).alias("available"))
        rows = t.toPandas()  # as many as targets
        spark = self.targets.sparkSession
        made = [feasible(g) for _, g in rows.groupby("plan_name", dropna=False, sort=True)]
        out = pd.concat(made) if made else rows.assign(quota=[], met=[], exhausted=[])
        return spark.createDataFrame([tuple(None if x is None else x for x in r) for r in out[["target_id", "plan_name", "wanted", "available", "quota", "met", "exhausted"]].astype(object).values.tolist()], _QUOTA_SCHEMA)

    def unmet(self) -> DataFrame:
        """(target_id): targets for which there are fewer records than wanted."""
        return self.report().where(~F.col("met")).select("target_id")

    def sample(self) -> DataFrame:
        """The drawn records of each plan: plan, target, category, image and ``row_no``.

        Each target keeps its ``quota`` records of least priority, ties broken
        by ``row_no``.
        """
        drawn = self.drawn
        quota = self.report().where("quota > 0").select("target_id", "plan_name", "quota")
        cells = written(self._cells(self.reservoirs()), "cells")
        cut = self._cut(cells.groupBy("target_id", "bin").agg(F.sum("n").alias("n")), quota.select("target_id", "quota"))
        plan = cells.select("target_id", *CATEGORY).distinct().join(broadcast_if_small(cut.join(quota.drop("quota"), "target_id"), MAX_TARGETS), "target_id")
        plan = plan.select("target_id", "plan_name", "last_bin", "need", *[F.col(c).alias(f"c_{c}") for c in CATEGORY])
        cols = ["plan_name", "target_id", *CATEGORY, "image_id", "row_no"]
        found = drawn.join(broadcast_if_small(plan, MAX_CELLS), _same() & (F.col("bin") <= F.col("last_bin")))
        whole = found.where((F.col("bin") < F.col("last_bin")) | F.col("need").isNull()).select(*cols)
        edge = found.where((F.col("bin") == F.col("last_bin")) & F.col("need").isNotNull()).select(*cols, "priority", "need")
        out, bits = [whole], self.bits
        edge = written(edge, "edge")
        while bits < BITS and (edge.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > EDGE:
            bits = min(BITS, bits + self.bits)
            binned = edge.withColumn("bin", _bin(bits))
            cut = self._cut(binned.groupBy("target_id", "bin").agg(F.count(F.lit(1)).alias("n")), edge.groupBy("target_id").agg(F.first("need").alias("quota")))
            found = binned.drop("need").join(broadcast_if_small(cut, MAX_TARGETS), "target_id").where("bin <= last_bin")
            out.append(found.where("bin < last_bin or need is null").select(*cols))
            edge = written(found.where("bin = last_bin and need is not null").select(*cols, "priority", "need"), "edge")
        rank = F.row_number().over(Window.partitionBy("target_id").orderBy("priority", "row_no"))
        out.append(edge.withColumn("rank", rank).where("rank <= need").select(*cols))
        made = out[0]
        for d in out[1:]:
            made = made.unionByName(d)
        return made

    @staticmethod
    def _cut(bins: DataFrame, quota: DataFrame) -> DataFrame:
        """(target_id, last_bin, need): the last bin that a target's quota reaches, and how many it needs of it, null for all."""
        upto = F.sum("n").over(Window.partitionBy("target_id").orderBy("bin"))
        reached = bins.withColumn("upto", upto).join(broadcast_if_small(quota, MAX_TARGETS), "target_id").where(F.col("upto") - F.col("n") < F.col("quota"))
        last = reached.groupBy("target_id").agg(F.max(F.struct("bin", "n", "upto", "quota")).alias("x"))
        need = F.col("x.quota") - (F.col("x.upto") - F.col("x.n"))
        return last.select("target_id", F.col("x.bin").alias("last_bin"), F.when(need < F.col("x.n"), need).alias("need"))


def _same() -> Column:
    hit = F.lit(True)
    for c in CATEGORY:
        hit &= F.col(f"c_{c}").eqNullSafe(F.col(c))
    return hit


def feasible(plan: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one plan: in proportion to the shares, held between the floor and what there is.

    One factor for all shares makes the clipped quotas add up to the plan's
    size; where floors alone exceed it, or all records fall short of it, they
    stand. What rounding down leaves over goes to the largest fractions, of
    equal ones to the smaller ``target_id``.
    """
    p = plan.copy().sort_values("target_id")
    p["met"] = p["available"] >= p["wanted"]
    p["exhausted"] = p["available"] <= p["wanted"]
    size = int(p["plan_size"].max())
    share = p["target_share"].fillna(0.0).clip(lower=0).to_numpy(float)
    most = p["available"].to_numpy(float)
    least = p[["min_rows", "available"]].min(axis=1).clip(lower=0).to_numpy(float)
    most = np.where(share > 0, most, least)
    clipped = lambda f: np.clip(f * share, least, most)
    turns = np.unique(np.concatenate([x[share > 0] / share[share > 0] for x in (least, most)]))  # the sum is linear between these factors
    reached = [t for t in turns.tolist() if clipped(t).sum() <= size + TINY]
    factor = max(reached, default=0.0)
    rises = ((least <= factor * share + TINY) & (factor * share < most - TINY) & (share > 0)).astype(float) @ share
    if rises > 0:
        factor += max(0.0, size - clipped(factor).sum()) / rises
    exact = clipped(factor)
    quota = np.floor(exact + TINY)
    over = int(min(size, np.round(exact.sum(), 6)) - quota.sum())
    if over > 0:
        room = np.flatnonzero(quota < most)
        order = room[np.lexsort((room, -np.round(exact - quota, 6)[room]))]
        quota[order[:over]] += 1
    p["quota"] = quota.astype("int64")
    return p
