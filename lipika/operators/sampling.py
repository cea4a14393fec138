"""Seeded samples, quotas and resampling (K): every draw is made of MD5 integers, so it is the same everywhere."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import accumulate, cycle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lipika.functions.digests import hash_orders
from lipika.operators.ordering import numbered
from lipika.session import written


def hash_sample(df: DataFrame, by: Sequence[str], key: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group by order of a seeded hash; groups of fewer rows are whole."""
    d = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))))
    return numbered(d, by, [F.col("_h"), key], "_rn").where(F.col("_rn") <= n).drop("_h", "_rn")


#: Strata are categories; with more of them (a column of free text) the sample is refused.
MAX_STRATA = 100_000


def _level(most: list[int], n: int) -> tuple[int, int]:
    """(level, rest): the highest level to which all can be filled, each up to its ``most``, with ``n`` in all, and what is then left over."""
    filled, waiting, before = 0, len(most), 0
    for m in sorted(most):
        step = min(m - before, (n - filled) // waiting)
        filled, before, waiting = filled + step * waiting, before + step, waiting - 1
        if before < m:
            break
    return before, n - filled


def seats(sizes: dict[str, int], n: int, hamilton: bool = False) -> dict[str, int]:
    """Seats of ``n`` for strata: the rounded-down share, at least one, at most the stratum.

    What the least seats take too many is cut off from the top: all are capped
    at one level, and what that level leaves goes to the smallest shares above
    it. What is left over goes to the strata in order of their remainders,
    each filled up in turn; with ``hamilton`` to all at one level.
    """
    total = sum(sizes.values())
    if total <= n:
        return dict(sizes)
    exact = {k: n * sizes[k] / total for k in sorted(sizes)}
    out = {k: min(sizes[k], max(1, int(x))) for k, x in exact.items()}
    spare = n - sum(out.values())
    if spare < 0:
        level, rest = _level(list(out.values()), n)
        above = sorted((k for k in reversed(out) if out[k] > level), key=lambda k: exact[k])
        return {k: max(1, min(v, level) + (k in above[:rest])) for k, v in out.items()}
    order = sorted(exact, key=lambda k: (int(exact[k]) - exact[k], -exact[k]))
    room = {k: sizes[k] - out[k] for k in order}
    if hamilton:
        level, rest = _level(list(room.values()), spare)
        first = [k for k in order if room[k] > level][:rest]
        return {k: v + min(room[k], level) + (k in first) for k, v in out.items()}
    ends = dict(zip(order, accumulate(room.values())))
    return {k: v + max(0, min(room[k], spare - ends[k] + room[k])) for k, v in out.items()}


def stratified_sample(df: DataFrame, stratum: str, key: Column, n: int, seed: int = 0, hamilton: bool = False) -> DataFrame:
    """``n`` rows over the strata of a column: seats on the driver (one number a stratum), draws by hash order."""
    d = df.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("\u0000")))
    sizes = {r["_s"]: r["n"] for r in d.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).limit(MAX_STRATA + 1).collect()}
    if len(sizes) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    quota = df.sparkSession.createDataFrame(list(seats(sizes, n, hamilton).items()), "_s string, _q long")
    d = d.join(F.broadcast(quota), "_s").withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))))
    return numbered(d, ["_s"], [F.col("_h"), key], "_rn").where(F.col("_rn") <= F.col("_q")).drop("_s", "_q", "_h", "_rn")


def largest_remainder(pmf: DataFrame, item: str, mass: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, item, quota): whole counts that sum to ``n`` in each group, by largest remainder; ties go to the larger item."""
    by = list(by)
    t = pmf.groupBy(*by).agg(F.sum(mass).alias("_t"))
    e = pmf.join(t, by) if by else pmf.crossJoin(F.broadcast(t))
    e = e.select(*by, item, F.round(n * F.col(mass) / F.col("_t"), 9).alias("_e")).withColumn("_f", F.floor("_e"))
    left = e.groupBy(*by).agg((F.lit(n) - F.sum("_f")).alias("_left"))
    r = numbered(e, by, [F.round(F.col("_e") - F.col("_f"), 9).desc(), F.col(item).desc()], "_rn")
    r = r.join(left, by) if by else r.crossJoin(F.broadcast(left))
    return r.select(*by, item, (F.col("_f") + (F.col("_rn") <= F.col("_left")).cast("long")).alias("quota"))


def target_masses(counts: DataFrame, by: str, item: str, n: str) -> DataFrame:
    """(by, mode, item, mass): the natural masses of each group's items, equal ones, and the natural ones given to the items of opposite rank."""
    t = counts.groupBy(by).agg(F.sum(n).alias("_t"), F.count(F.lit(1)).alias("_k"))
    d = written(counts.join(F.broadcast(t), by).select(by, item, (F.col(n) / F.col("_t")).alias("mass"), "_k"), "masses")
    up = numbered(d, [by], [F.col("mass"), F.col(item)], "_r").select(by, item, "_r")
    down = numbered(d, [by], [F.col("mass").desc(), F.col(item).desc()], "_r").select(by, "mass", "_r")
    of = lambda x, mode: x.select(by, F.lit(mode).alias("mode"), item, "mass")
    return of(d, "natural").unionByName(of(d.withColumn("mass", 1 / F.col("_k")), "flattened")).unionByName(of(up.join(down, [by, "_r"]), "inverted"))


#: A prime below which hashes of units and the numbers of draws lie, so that products fit 64 bits.
PRIME = (1 << 31) - 1
#: A unit takes part as often as thresholds are reached: Poisson with mean 1.
POISSON = np.array([int(PRIME * c) for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])], np.int64)
#: Numbers of one block of draws by units.
CELLS = 2_000_000


def unit_hash(key: Column) -> Column:
    """28 bits of a unit's digest."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long")


def draw_numbers(seed: str, draws: int) -> np.ndarray:
    """Three numbers a draw, from the digest of seed and draw."""
    digests = [hashlib.md5(f"{seed}|{d}".encode()).hexdigest() for d in range(draws)]
    return np.array([[int(x[k : k + 7], 16) for k in (0, 7, 14)] for x in digests], np.int64).reshape(-1, 3)


def multiplicities(h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """How often each unit (by its hash) takes part in each draw: draws x units."""
    x = (numbers[:, :1] * h + numbers[:, 1:2]) % PRIME
    return np.searchsorted(POISSON, x * ((x + numbers[:, 2:]) % PRIME) % PRIME, side="right")


def weighted_draws(units: DataFrame, by: Sequence[str], key: Column, values: Sequence[str], draws: int, seed: str = "b") -> DataFrame:
    """(by, draw, w, one column a value): sums over the units of each resample, each unit as often as it was drawn.

    Bootstrap for any number of units: every unit takes part in every draw a
    Poisson number of times, found from its own hash, so no unit meets another
    and nothing is joined. A task adds up ``draws`` sums a group, and those of
    all tasks add up. Units with a null value are left out; a null group is one.
    """
    by, values = list(by), list(values)
    numbers = draw_numbers(seed, draws)
    d = units.dropna(subset=values).select(*by, unit_hash(key).alias("_h"), *[F.col(v).cast("double").alias(v) for v in values])
    schema = StructType([*[d.schema[c] for c in by], StructField("draw", LongType()), *[StructField(c, DoubleType()) for c in ("w", *values)]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[: len(by)]]
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*cols) if by else [()] * batch.num_rows):
                groups.setdefault(k, []).append(i)
            h = batch.column(len(by)).to_numpy()
            v = np.stack([np.ones(batch.num_rows), *(c.to_numpy() for c in batch.columns[len(by) + 1 :])], 1)
            for k, rows in groups.items():
                out = sums.setdefault(k, np.zeros((draws, 1 + len(values))))
                step = max(1, CELLS // draws)
                for s in range(0, len(rows), step):
                    at = rows[s : s + step]
                    out += multiplicities(h[at], numbers).astype(float) @ v[at]
        for k, out in sums.items():
            keys = [pa.array([x] * draws, batch.schema.field(i).type) for i, x in enumerate(k)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(draws)), *(pa.array(np.ascontiguousarray(c)) for c in out.T)], [f.name for f in schema])

    found = d.mapInArrow(add, schema)
    return found.groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in ("w", *values)])


def bootstrap_means(units: DataFrame, by: Sequence[str], key: Column, value: str, draws: int, seed: str = "b") -> DataFrame:
    """(by, draw, mean): means of resamples within each group, of units (images, pages) of any number."""
    d = weighted_draws(units, by, key, [value], draws, seed)
    return d.select(*by, "draw", F.try_divide(value, "w").alias("mean"))


def two_sample_bootstrap(units: DataFrame, by: Sequence[str], key: Column, value: str, first: str, draws: int, delta: float, seed: str = "two") -> DataFrame:
    """(by, n_a, n_b, diff, lo95, hi95, lo90, hi90, p_lower, p_upper): difference of two means, the units of both sides resampled apart.

    ``p_lower`` and ``p_upper`` are the shares of resampled differences at most
    ``-delta`` and at least ``delta``.
    """
    by = list(by)
    side = lambda yes, name: bootstrap_means(units.where(F.col(first) == yes), by, key, value, draws, f"{seed}-{name}").withColumnRenamed("mean", name)
    d = side(True, "a").join(side(False, "b"), [*by, "draw"]).withColumn("mean", F.col("a") - F.col("b"))
    q = [F.percentile("mean", p).alias(n) for n, p in (("lo95", 0.025), ("hi95", 0.975), ("lo90", 0.05), ("hi90", 0.95))]
    share = lambda c: F.avg(c.cast("int"))
    boot = d.groupBy(*by).agg(*q, share(F.col("mean") <= -delta).alias("p_lower"), share(F.col("mean") >= delta).alias("p_upper"))
    a, b = F.when(F.col(first), F.col(value)), F.when(~F.col(first), F.col(value))
    point = units.groupBy(*by).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), (F.avg(a) - F.avg(b)).alias("diff"))
    return point.join(boot, by) if by else point.crossJoin(F.broadcast(boot))


def interval(means: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of bootstrap means."""
    a = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("mean", a).alias("lo"), F.percentile("mean", 1 - a).alias("hi"))


_WALK = "script string, line int, text string, glyphs array<string>"


def corpus_walk(bigrams: DataFrame, quotas: DataFrame, lengths: DataFrame | None = None, length: int = 20) -> DataFrame:
    """Lines that use up each glyph's quota, by a bigram walk: serial within a script, scripts side by side.

    ``bigrams`` (script, a, b, n) and ``quotas`` (script, glyph, quota) are
    tables of glyphs. The next glyph is the commonest successor with quota
    left, else the glyph with most left. ``lengths`` (script, length, n) are
    those of the corpus' lines: lines of each length come as often as there,
    the commonest first; without them all lines have ``length``. Each glyph is
    drawn from heaps, so a walk takes the time of its glyphs.
    """
    keyed = bigrams.select("script", F.struct("a", "b", "n").alias("pair"), F.lit(None).cast("struct<length:int,n:bigint>").alias("size"))
    if lengths is not None:
        keyed = keyed.unionByName(lengths.select("script", F.lit(None).cast(keyed.schema["pair"].dataType).alias("pair"), F.struct(F.col("length").cast("int").alias("length"), F.col("n").cast("long").alias("n")).alias("size")))

    def walk(key: tuple, given: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        quota = {g: int(q) for g, q in zip(left["glyph"], left["quota"]) if q > 0}
        after: dict[str, list[str]] = {}
        for p in sorted(given["pair"].dropna(), key=lambda p: (p["n"], p["b"]), reverse=True):
            after.setdefault(p["a"], []).append(p["b"])  # taken from the end of what is left: least first
        for a in after:
            after[a].reverse()
        most = [(-q, g) for g, q in quota.items()]
        heapify(most)
        sizes = sorted(((z["n"], z["length"]) for z in given["size"].dropna() if z["length"] > 0), reverse=True) or [(1, length)]
        lines, now, last = [], [], None
        plan = cycle([z for n, z in sizes for _ in range(max(1, round(100 * n / sum(k for k, _ in sizes))))])
        end = next(plan)
        while quota:
            g, successors = None, after.get(last, [])
            while successors and g is None:
                if successors[-1] in quota:
                    g = successors[-1]
                else:
                    successors.pop()
            while g is None:
                q, x = most[0]
                if quota.get(x, 0) == -q:
                    g = x
                else:
                    heappop(most)
                    if x in quota:
                        heappush(most, (-quota[x], x))
            now.append(g)
            quota[g] -= 1
            if not quota[g]:
                del quota[g]
            last = g
            if len(now) == end or not quota:
                lines.append(now)
                now, last, end = [], None, next(plan)
        return pd.DataFrame({"script": key[0], "line": range(len(lines)), "text": ["".join(x) for x in lines], "glyphs": lines})

    return keyed.groupBy("script").cogroup(quotas.groupBy("script")).applyInPandas(walk, _WALK)


def within_tolerance(made: DataFrame, target: DataFrame, by: Sequence[str], item: str, tolerance: float) -> DataFrame:
    """(by, tv, matches): total variation between the masses of counts ``n`` made and of the target's ``mass``, and whether it is small enough."""
    by = list(by)
    t = made.groupBy(*by).agg(F.sum("n").alias("_t"))
    p = made.join(t, by).select(*by, item, (F.col("n") / F.col("_t")).alias("_p"))
    d = p.join(target.select(*by, item, F.col("mass").alias("_q")), [*by, item], "full").groupBy(*by)
    return d.agg((F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))) / 2).alias("tv")).withColumn("matches", F.col("tv") <= tolerance)


def imputed_rate(rows: DataFrame, by: Sequence[str], sure: str, unknown: str, hit: str) -> DataFrame:
    """(by, n, rate, sd, lo, hi): share of sure hits and of unknown rows taken to hit as often as the adjudicated ones, with its 95 % interval.

    Resampling the rows and imputing each unknown one anew makes a resample's
    hits binomial with the rate itself, so the interval is that of the binomial
    distribution, exact and without draws. All is null where no row is adjudicated.
    """
    n1, nu = F.count_if(F.col(sure)), F.count_if(F.col(unknown))
    p = F.try_divide(F.count_if(F.col(hit)), F.count(F.col(hit)))
    d = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ((n1 + nu * p) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("rate"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return d.select(*by, "n", "rate", sd.alias("sd"), (_binomial(F.col("n"), F.col("rate"), F.lit(0.025)) / F.col("n")).alias("lo"), (_binomial(F.col("n"), F.col("rate"), F.lit(0.975)) / F.col("n")).alias("hi"))


@F.pandas_udf(LongType())
def _binomial(n: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(b) else binomial_quantile(int(a), float(b), float(c)) for a, b, c in zip(n, p, q)], dtype="Int64")


def binomial_quantile(n: int, p: float, q: float) -> int:
    """The least count of hits with at least ``q`` of the binomial distribution up to it; sums reach 12 deviations around the mean."""
    if p <= 0 or p >= 1:
        return n if p >= 1 else 0
    sd = math.sqrt(n * p * (1 - p))
    lo, hi = max(0, math.floor(n * p - 12 * sd - 12)), min(n, math.ceil(n * p + 12 * sd + 12))
    k = np.arange(lo, hi + 1)
    steps = np.log((n - k[:-1]) / (k[:-1] + 1.0)) + math.log(p) - math.log1p(-p)
    start = math.lgamma(n + 1) - math.lgamma(lo + 1) - math.lgamma(n - lo + 1) + lo * math.log(p) + (n - lo) * math.log1p(-p)
    return int(k[min(np.searchsorted(np.cumsum(np.exp(start + np.r_[0, np.cumsum(steps)])), q - 1e-12), len(k) - 1)])


#: Units of a group that one task holds (about 40 bytes each) while it shuffles them; a larger group is shuffled by Spark.
HELD = 10_000_000
#: Units times draws of one task of shuffles, and parts into which the draws of a group go at most.
SHUFFLED, PARTS = 5_000_000, 64
#: Tasks of shuffles of all groups at most.
MAX_TASKS = 1_000


def permuted_spearman(units: DataFrame, by: Sequence[str], key: Column, x: str, y: str, draws: int, seed: str = "perm") -> DataFrame:
    """(by, n, rho, p): rank correlation of units, and the share of shuffles that reach it, counting the data once.

    Each shuffle permutes the ranks of y by hash order. A task holds the ranks
    of a group and makes a part of its shuffles from them, so a unit moves once
    for each part of the draws and not for each draw. Null without at least
    three units or where a side is constant.
    """
    from lipika.operators.stats import _with_rank

    by = list(by)
    u = written(units.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, key.alias("_key"), x, y), "units")
    d = _with_rank(_with_rank(u, by, x, "_rx").drop("n_all"), by, y, "_ry").drop("n_all")
    d = written(numbered(d, by, [F.col("_key")], "_i", "_n").select(*by, F.col("_n").cast("long"), F.col("_i").cast("long"), "_rx", "_ry"), "ranked")
    parts = F.least(F.lit(PARTS), F.lit(draws), F.ceil(F.col("_n") * draws / SHUFFLED)).cast("int")
    tasks, most = d.where("_i = 1").agg(F.sum(parts), F.max("_n")).first()
    hits = _held_shuffles(d.where(F.col("_n") <= HELD), by, parts, min(tasks or 1, MAX_TASKS), draws, seed)
    if (most or 0) > HELD:
        hits = hits.unionByName(_sorted_shuffles(d.where(F.col("_n") > HELD), by, draws, seed))
    p = (F.sum("hits") + 1) / (F.lit(draws) + 1)
    return hits.groupBy(*by, "n").agg(F.max("rho").alias("rho"), F.when((F.col("n") >= 3) & F.max("rho").isNotNull(), p).alias("p"))


def _held_shuffles(d: DataFrame, by: list[str], parts: Column, tasks: int, draws: int, seed: str) -> DataFrame:
    """(by, n, rho, hits) for each part of a group's draws: how many of its shuffles reach the correlation."""
    schema = StructType([*[d.schema[c] for c in by], StructField("n", LongType()), StructField("rho", DoubleType()), StructField("hits", LongType())])

    def shuffle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last = (k.as_py() for k in key[len(by) :])
        ranks = np.empty((2, n))
        for batch in batches:
            ranks[:, batch.column("_i").to_numpy() - 1] = [batch.column(c).to_numpy() for c in ("_rx", "_ry")]
        ranks -= (n + 1) / 2  # the ranks' mean, so a constant side gives exactly 0
        rho, hits = shuffles_that_reach(*ranks, first, last, seed)
        columns = [*key[: len(by)], *(pa.scalar(v, t) for v, t in ((n, pa.int64()), (rho, pa.float64()), (hits, pa.int64())))]
        yield pa.RecordBatch.from_arrays([pa.array([c.as_py()], c.type) for c in columns], [f.name for f in schema])

    cut = lambda k: F.floor(k * draws / F.col("_parts")).cast("int")
    t = d.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    t = t.select(*by, "_n", cut(F.col("_part")).alias("_first"), cut(F.col("_part") + 1).alias("_last"), "_i", "_rx", "_ry")
    return t.repartition(tasks, *by, "_first").groupBy(*by, "_n", "_first", "_last").applyInArrow(shuffle, schema)


def shuffles_that_reach(x: np.ndarray, y: np.ndarray, first: int, last: int, seed: str) -> tuple[float | None, int]:
    """(rho, hits): correlation of two sides of centred ranks, and how many of the shuffles from ``first`` to below ``last`` are as far from 0."""
    n, norm = len(x), math.sqrt(x @ x) * math.sqrt(y @ y)
    if n < 3 or not norm:
        return (float(x @ y / norm) if norm else None), 0
    least, hits, step = abs(x @ y) - 1e-12 * norm, 0, max(1, CELLS // n)
    for d in range(first, last, step):
        hits += int(np.count_nonzero(np.abs(x[hash_orders(seed, d, min(last, d + step), n)] @ y) >= least))
    return float(x @ y / norm), hits


def _sorted_shuffles(d: DataFrame, by: list[str], draws: int, seed: str) -> DataFrame:
    """As :func:`_held_shuffles`, for groups that no task holds: every draw of every unit is a row, sorted by Spark; a shuffle of one group is a task of its own."""
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    base = d.groupBy(*by, F.col("_n").alias("n")).agg(rho.alias("rho"))
    shuffled = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "draw", "_i")))
    place = F.row_number().over(Window.partitionBy(*by, "draw").orderBy("_h", "_i"))
    order = shuffled.select(*by, "draw", "_rx", place.cast("long").alias("_i"))
    stats = order.join(d.select(*by, "_i", "_ry"), [*by, "_i"]).groupBy(*by, "draw").agg(rho.alias("r"))
    joined = stats.join(F.broadcast(base), by) if by else stats.crossJoin(F.broadcast(base))
    return joined.groupBy(*by, "n", "rho").agg(F.count_if(F.abs("r") >= F.abs("rho") - 1e-12).alias("hits"))
