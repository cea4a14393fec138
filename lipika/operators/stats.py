"""Rank statistics, panels, regressions and tests (J) as aggregates over rows of any number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.operators.ordering import midranks, running
from lipika.operators.sampling import weighted_draws
from lipika.operators.skew import broadcast_if_small, lookup_join
from lipika.session import written

#: Repetitions of a panel, and groups whose sizes may be broadcast.
MAX_REPS, GROUPS = 256, 1_000_000


def _with_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value`` in its group, and the group's size as ``n_all``."""
    r = midranks(df, by, value, name).select(*by, value, name, "n_all")
    return lookup_join(df, r, [*by, value], "inner")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): Pearson correlation of average ranks over rows with both values; null if one is constant.

    Equal pairs are counted before ranks are looked up, so ties never meet in one task.
    """
    by = list(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = written(d.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_k")), "pairs")
    rank = lambda c, name: midranks(d, by, c, name).select(*by, F.col(c).alias(name[:2]), name)
    r = pairs.join(rank(x, "_x_rank"), [*by, "_x"]).join(rank(y, "_y_rank"), [*by, "_y"])
    r = r.join(pairs.groupBy(*by).agg(F.sum("_k").alias("n")), by) if by else r.crossJoin(F.broadcast(pairs.agg(F.sum("_k").alias("n"))))
    dx, dy = (F.col(c) - (F.col("n") + 1) / 2 for c in ("_x_rank", "_y_rank"))  # ranks' mean is known, so a constant side gives exactly 0
    rho = F.try_divide(F.sum(F.col("_k") * dx * dy), F.sqrt(F.sum(F.col("_k") * dx * dx)) * F.sqrt(F.sum(F.col("_k") * dy * dy)))
    return r.groupBy(*by, "n").agg(rho.alias("rho"))


def auroc(df: DataFrame, by: Sequence[str], score: str, positive: str) -> DataFrame:
    """(by, n_pos, n_neg, auroc): the rank form, ties counting half; null if a class is empty."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_k"))
    r = midranks(df, by, score, "_r").select(*by, score, "_r")
    d = counts.join(r, [*by, score])
    pos, n = F.sum("_pos"), F.sum("_k")
    area = F.try_divide(F.sum(F.col("_r") * F.col("_pos")) - pos * (pos + 1) / 2, (pos * (n - pos)).cast("double"))
    return d.groupBy(*by).agg(pos.alias("n_pos"), (n - pos).alias("n_neg"), area.alias("auroc"))


def variance_shares(panel: DataFrame, unit: str, rep: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, unit_share, rep_share, residual_share) in percent of balanced panels; negative components count as 0.

    Mean squares come from sums of squares of group means, so the panel is
    aggregated thrice and never gathered.
    """
    by, v = list(by), F.col(value)
    g = panel.groupBy(*by).agg(F.avg(v).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(v * v).alias("ss"), F.count_distinct(unit).alias("u"), F.count_distinct(rep).alias("r"))
    su = panel.groupBy(*by, unit).agg(F.avg(v).alias("a")).groupBy(*by).agg(F.sum(F.col("a") * F.col("a")).alias("su"))
    sr = panel.groupBy(*by, rep).agg(F.avg(v).alias("b")).groupBy(*by).agg(F.sum(F.col("b") * F.col("b")).alias("sr"))
    d = g.join(su, by).join(sr, by) if by else g.crossJoin(F.broadcast(su)).crossJoin(F.broadcast(sr))
    mm = F.col("m") * F.col("m")
    ssu = F.col("r") * (F.col("su") - F.col("u") * mm)
    ssr = F.col("u") * (F.col("sr") - F.col("r") * mm)
    sse = F.col("ss") - F.col("n") * mm - ssu - ssr
    mse = F.try_divide(sse, ((F.col("u") - 1) * (F.col("r") - 1)).cast("double"))
    d = d.select(*by, F.try_divide(ssu, (F.col("u") - 1).cast("double")).alias("msu"), F.try_divide(ssr, (F.col("r") - 1).cast("double")).alias("msr"), mse.alias("mse"), "u", "r")
    return _shares(d, by)


def resampled_shares(panel: DataFrame, unit: str, rep: str, value: str, draws: int, seed: str = "u") -> DataFrame:
    """(draw, unit_share, rep_share, residual_share): variance shares of resamples of the units, each with all its repetitions.

    All that the shares need are sums over units, so each unit only enters as
    often as it was drawn. A panel has few repetitions (at most :data:`MAX_REPS`).
    """
    reps = [r[0] for r in panel.select(rep).distinct().orderBy(rep).limit(MAX_REPS + 1).collect()]
    if len(reps) > MAX_REPS:
        raise ValueError(f"more than {MAX_REPS} repetitions")
    cells = [F.max(F.when(F.col(rep) == r, F.col(value))).alias(f"_v{i}") for i, r in enumerate(reps)]
    u = panel.groupBy(unit).agg(F.avg(value).alias("_a"), F.sum(F.col(value) * F.col(value)).alias("_q"), *cells).withColumn("_aa", F.col("_a") * F.col("_a"))
    d = weighted_draws(u, [], F.col(unit), ["_a", "_aa", "_q", *[f"_v{i}" for i in range(len(reps))]], draws, seed)
    n, r, m = F.col("w"), float(len(reps)), F.try_divide("_a", "w")
    ssu = r * (F.col("_aa") - n * m * m)
    ssr = n * (sum((F.pow(F.try_divide(f"_v{i}", "w"), 2) for i in range(len(reps))), F.lit(0.0)) - r * m * m)
    sse = F.col("_q") - n * r * m * m - ssu - ssr
    d = d.select("draw", F.try_divide(ssu, n - 1).alias("msu"), F.try_divide(ssr, F.lit(r - 1)).alias("msr"), F.try_divide(sse, (n - 1) * (r - 1)).alias("mse"), n.alias("u"), F.lit(r).alias("r"))
    return _shares(d, ["draw"])


def _shares(d: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percent shares from mean squares (msu, msr, mse) of ``u`` units and ``r`` repetitions."""
    vu = F.greatest(F.lit(0.0), F.try_divide(F.col("msu") - F.col("mse"), F.col("r").cast("double")))
    vr = F.greatest(F.lit(0.0), F.try_divide(F.col("msr") - F.col("mse"), F.col("u").cast("double")))
    ve = F.greatest(F.lit(0.0), F.col("mse"))
    return d.select(*by, *[F.try_divide(100.0 * x, vu + vr + ve).alias(n) for x, n in ((vu, "unit_share"), (vr, "rep_share"), (ve, "residual_share"))])


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by, q0, q1, ..): quantiles of a column, linear between order statistics, from counts of its distinct values.

    Equal values combine map-side and the counts are ordered globally, so no
    group has to fit a task. Nulls are left out.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    upto = running(counts, [*[F.col(c).asc_nulls_first() for c in by], F.col("_v")], {"_upto": F.col("_k")})
    sizes = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    starts = running(sizes, [F.col(c).asc_nulls_first() for c in by], {"_end": F.col("_n")}) if by else sizes.withColumn("_end", F.col("_n"))
    starts = starts.select(*[F.col(c).alias(f"_b_{c}") for c in by], "_n", (F.col("_end") - F.col("_n")).alias("_start"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    d = upto.join(broadcast_if_small(starts, GROUPS), same) if by else upto.crossJoin(F.broadcast(starts))
    at = lambda k: F.min(F.when(F.col("_upto") - F.col("_start") > k, F.col("_v")))
    out = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * float(p)
        out += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_f{i}")]
    return d.groupBy(*by).agg(*out).select(*by, *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i in range(len(probs))])


def signed_ranks(df: DataFrame, by: Sequence[str], diff: str) -> DataFrame:
    """(by, n, w_plus, w_minus, r, z, d_z): Wilcoxon's signed ranks without zeros, rank-biserial r, normal z, and d_z of all."""
    nz = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).select(*by, F.abs(diff).alias("_a"), (F.col(diff) > 0).alias("_up"))
    counts = written(nz.groupBy(*by, "_a").agg(F.count(F.lit(1)).alias("_k"), F.count_if("_up").alias("_p")), "counts")
    upto = running(counts, [*[F.col(c).asc_nulls_first() for c in by], F.col("_a")], {"_upto": F.col("_k")})
    sizes = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    starts = running(sizes, [F.col(c).asc_nulls_first() for c in by], {"_end": F.col("_n")}) if by else sizes.withColumn("_end", F.col("_n"))
    starts = starts.select(*by, (F.col("_end") - F.col("_n")).alias("_start"))
    d = upto.join(broadcast_if_small(starts, GROUPS), list(by)) if by else upto.crossJoin(F.broadcast(starts))
    rank, k, p = F.col("_upto") - F.col("_start") - (F.col("_k") - 1) / 2.0, F.col("_k"), F.col("_p")
    out = d.groupBy(*by).agg(F.sum("_k").alias("n"), F.sum(rank * p).alias("w_plus"), F.sum(rank * (k - p)).alias("w_minus"), F.sum(k * k * k - k).alias("_ties"))
    n = F.col("n").cast("double")
    join = (lambda a, b: a.join(b, list(by))) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))
    dz = df.groupBy(*by).agg(F.try_divide(F.avg(diff), F.stddev_samp(diff)).alias("d_z"))
    out = join(out, dz)
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48.0)
    return out.select(*by, "n", "w_plus", "w_minus", F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")).alias("r"), F.try_divide(F.col("w_plus") - n * (n + 1) / 4, sigma).alias("z"), "d_z")


def cluster_t(df: DataFrame, by: Sequence[str], cluster: str, diff: str) -> DataFrame:
    """(by, clusters, mean, t, df): t of the clusters' mean differences, k - 1 degrees of freedom."""
    m = df.groupBy(*by, cluster).agg(F.avg(diff).alias("_m"))
    k, sd = F.count("_m"), F.stddev_samp("_m")
    return m.groupBy(*by).agg(k.alias("clusters"), F.avg("_m").alias("mean"), F.try_divide(F.avg("_m"), sd / F.sqrt(F.nullif(k, F.lit(0)))).alias("t"), (k - 1).alias("df"))


def least_squares(df: DataFrame, by: Sequence[str], y: Column, x: Column) -> DataFrame:
    """(by, n, slope, intercept, r, r2, t): the line, its correlation and the slope's t with n - 2 degrees of freedom; null where x is constant."""
    d = df.select(*by, y.cast("double").alias("_y"), x.cast("double").alias("_x")).dropna(subset=["_y", "_x"])
    slope = F.try_divide(F.covar_pop("_x", "_y"), F.var_pop("_x"))
    r = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"), (F.avg("_y") - slope * F.avg("_x")).alias("intercept"), r.alias("r")).withColumns(
        {"r2": F.col("r") * F.col("r"), "t": F.try_divide(F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))), F.sqrt(1 - F.col("r") * F.col("r")))}
    )


def rank_sum(df: DataFrame, by: Sequence[str], value: str, first: str) -> DataFrame:
    """(by, n_a, n_b, u, z): Mann-Whitney U of the rows flagged ``first`` against the others, with tie correction."""
    d = df.where(F.col(value).isNotNull())
    counts = d.groupBy(*by, value).agg(F.sum(F.col(first).cast("long")).alias("_a"))
    r = midranks(d, by, value, "_r").join(counts, [*by, value])
    a, n = F.sum("_a"), F.sum("ties")
    t = F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties"))
    g = r.groupBy(*by).agg(a.alias("n_a"), (n - a).alias("n_b"), (F.sum(F.col("_r") * F.col("_a")) - a * (a + 1) / 2).alias("u"), n.cast("double").alias("_n"), t.cast("double").alias("_t"))
    ab = F.col("n_a") * F.col("n_b")
    sigma = F.sqrt(ab / 12.0 * (F.col("_n") + 1 - F.try_divide(F.col("_t"), F.col("_n") * (F.col("_n") - 1))))
    return g.select(*by, "n_a", "n_b", "u", F.try_divide(F.col("u") - ab / 2.0, sigma).alias("z"))


def fixed_effects(cells: DataFrame, effect: str, y: str, x: str, weight: str, least: int = 2, rows: int = 20) -> DataFrame:
    """(rows, groups, beta, r2): weighted slope of y on x within levels of ``effect`` that have ``least`` rows.

    Weighted demeaning within levels gives the slope of the regression with a
    dummy for each level, without building one. ``r2`` is that of the plain
    residuals; both are null with fewer than ``rows`` rows.
    """
    w = F.col(weight)
    m = cells.groupBy(effect).agg((F.sum(w * F.col(x)) / F.sum(w)).alias("_mx"), (F.sum(w * F.col(y)) / F.sum(w)).alias("_my"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least)
    d = cells.join(m, effect)
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    a = d.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(effect).alias("groups"), F.try_divide(F.sum(w * dx * dy), F.sum(w * dx * dx)).alias("b"),
        F.sum(dy * dy).alias("yy"), F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), (F.var_pop(y) * F.count(y)).alias("all"),
    )
    b = F.col("b")
    enough = lambda c: F.when(F.col("rows") >= rows, c)
    return a.select("rows", "groups", enough(b).alias("beta"), enough(1 - F.try_divide(F.col("yy") - 2 * b * F.col("xy") + b * b * F.col("xx"), F.col("all"))).alias("r2"))


def contrasts(df: DataFrame, group: str, value: str, critical: float) -> DataFrame:
    """(a, b, diff, se, z, significant): all pairs of a few groups' means, from one row a group; ``critical`` is the bound of |z|.

    At most :data:`MAX_REPS` groups.
    """
    g = written(df.groupBy(F.col(group).alias("g")).agg(F.avg(value).alias("m"), F.try_divide(F.var_samp(value), F.count(value)).alias("v")), "groups")
    if g.count() > MAX_REPS:
        raise ValueError(f"more than {MAX_REPS} groups")
    a, b = (g.select(F.col("g").alias(x), F.col("m").alias(f"m_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    d = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (F.col("m_a") - F.col("m_b")).alias("diff"), F.sqrt(F.col("v_a") + F.col("v_b")).alias("se"))
    z = F.try_divide("diff", "se")
    return d.select("a", "b", "diff", "se", z.alias("z"), (F.abs(z) > critical).alias("significant"))


def difference_z(df: DataFrame, by: Sequence[str], value: str, first: str) -> DataFrame:
    """(by, diff, se, z, equivalent): difference of two means, its z, and whether its 90 % interval lies within 0.05."""
    a, b = F.when(F.col(first), F.col(value)), F.when(~F.col(first), F.col(value))
    se2 = F.try_divide(F.var_samp(a), F.count(a)) + F.try_divide(F.var_samp(b), F.count(b))
    d = df.groupBy(*by).agg((F.avg(a) - F.avg(b)).alias("diff"), F.sqrt(se2).alias("se"))
    half = 1.6448536269514722 * F.col("se")
    inside = (F.col("diff") - half > -0.05) & (F.col("diff") + half < 0.05)
    return d.select(*by, "diff", "se", F.try_divide("diff", "se").alias("z"), inside.alias("equivalent"))
