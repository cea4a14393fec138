"""Distributions and nested arrays (I1-I8, L1-L9) as higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, not once for each element of an array it is used on."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column, empty: float | None = None) -> Column:
    """Mean of an array; ``empty`` (null or a number) for an empty one."""
    return F.when(F.size(a) > 0, total(a) / F.nullif(F.size(a), F.lit(0))).otherwise(F.lit(empty))


def floored(p: Column, floor: float) -> Column:
    """Probabilities of at least ``floor``, summing to 1 again."""
    up = F.transform(p, lambda x: F.greatest(x, F.lit(floor)))
    return let(up, lambda u: let(total(u), lambda s: F.transform(u, lambda x: x / s)))


def softmax(a: Column) -> Column:
    e = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return let(e, lambda u: let(total(u), lambda s: F.transform(u, lambda x: x / s)))


def kl(p: Column, q: Column, floor: float = 1e-8) -> Column:
    """Kullback-Leibler divergence in nats after flooring and renormalising both."""
    return total(F.zip_with(floored(p, floor), floored(q, floor), lambda x, y: x * F.ln(x / y)))


def overlap(p: Column, q: Column) -> Column:
    """Sum of the smaller masses: 1 minus the total variation."""
    return total(F.zip_with(p, q, lambda x, y: F.least(x, y)))


def entropy(p: Column, floor: float = 1e-12) -> Column:
    """Shannon entropy in nats."""
    return -total(F.transform(floored(p, floor), lambda x: x * F.ln(x)))


def argmax(p: Column) -> Column:
    """Position, from 0, of the first largest element; null for an empty array."""
    return F.nullif(F.array_position(p, F.array_max(p)), F.lit(0)) - 1


def rank_of(p: Column, k: Column) -> Column:
    """1 plus the number of elements above element ``k``."""
    return F.size(F.filter(p, lambda x: x > F.get(p, k))) + 1


def log_floor(p: Column, floor: float = 1e-12) -> Column:
    return F.ln(F.greatest(p, F.lit(floor)))


def top_k(p: Column, k: int) -> Column:
    """The ``k`` largest as struct(p, i), largest first, ties by position."""
    return F.slice(F.transform(F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("m"), i.alias("i")))), lambda s: F.struct((-s["m"]).alias("p"), s["i"].alias("i"))), 1, k)


def zip_shortest(a: Column, b: Column) -> Column:
    """Pairs up to the end of the shorter array."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b")))


def implied_top(entropy_nats: Column, steps: int = 60) -> Column:
    """The larger mass of a two-way distribution with this entropy, by bisection."""
    h = lambda p: -(p * F.ln(p) + (1 - p) * F.ln(1 - p))
    start = F.struct(F.lit(0.5).alias("lo"), F.lit(1 - 1e-12).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        high = h(mid) > entropy_nats
        return F.struct(F.when(high, mid).otherwise(s["lo"]).alias("lo"), F.when(high, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length of two intervals."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def kendall(order: Column) -> Column:
    """Kendall's tau of a permutation against ascending order; 1 for fewer than two elements."""
    n = F.size(order)
    conc = F.aggregate(F.transform(order, lambda x, i: F.aggregate(F.slice(order, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0), lambda s, y: s + F.when(y > x, 1).otherwise(-1))), F.lit(0), lambda s, x: s + x)
    return F.when(n <= 1, 1.0).otherwise(conc / F.nullif(n * (n - 1) / 2.0, F.lit(0.0)))


def projection_bands(profile: Column, width: int, share: float, floor: float = 1e-9) -> Column:
    """array<struct(lo, hi, mass)>: runs of a profile above ``floor``, at least ``width`` long and with at least ``share`` of all runs' mass."""
    band = "struct<lo:int,hi:int,mass:double>"
    start = F.struct(F.array().cast(f"array<{band}>").alias("done"), F.lit(None).cast(band).alias("open"))

    def step(s: Column, x: Column) -> Column:
        grown = F.when(s["open"].isNull(), F.struct(x["i"].alias("lo"), (x["i"] + 1).alias("hi"), x["v"].alias("mass"))).otherwise(F.struct(s["open"]["lo"].alias("lo"), (x["i"] + 1).alias("hi"), (s["open"]["mass"] + x["v"]).alias("mass")))
        inside = x["v"] > floor
        done = F.when(~inside & s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(inside, grown).alias("open"))

    runs = F.aggregate(F.transform(profile, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), start, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return let(runs, lambda b: F.filter(b, lambda x: (x["hi"] - x["lo"] >= width) & (x["mass"] >= share * F.aggregate(b, F.lit(0.0), lambda s, y: s + y["mass"]))))
