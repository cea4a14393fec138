"""Problem 5: filling containers of fixed capacity with texts.

The length histogram (at most ``capacity`` classes) is all that the driver
sees. A configuration linear program over it is solved by multiplicative
weights: classes hold weights, each round a knapsack dynamic program finds the
configuration of most weight, and the classes it covers lose weight. The
solution is rounded down to whole containers, each refilled in exact sizes
until nothing fits; the program is solved again for the remainder, and what
little is left by best fit. Items then find their slot by their rank within
their size, which is counted in salted buckets.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.llm.ranks import rank_within
from lipika.session import pick, written

CAPACITY = 4096
#: About so many classes of sizes in the linear program; exact sizes return when it is rounded.
CLASSES = 128
#: The linear program is solved again while more than so many items a class are left over.
MANY = 16
#: About so many rounds of multiplicative weights; the fewer classes, the smaller the steps that they allow.
ROUNDS = 800
#: Sizes up to this part of the capacity stay out of the linear program and fill the gaps that it leaves.
SMALL = 1 / 8
#: Slots of the packing that may be sent to the tasks (40 bytes each). They depend on the histogram's classes, not on the items.
MAX_SLOTS = 1_000_000

_PIECES = "doc_id long, piece int, pieces int, start_pos int, end_pos int, tokens int"


def byte_tokens(text: Column) -> Column:
    """Tokens of the byte-level tokenizers: one per UTF-8 byte and one end mark."""
    return (F.octet_length(text) + 1).cast("int")


def cut_points(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of pieces of at most ``capacity`` tokens, cut between code points.

    All but the last are as full as the code points allow; the last holds the
    end mark too.
    """
    raw, out, at, chars = text.encode("utf-8", "surrogatepass"), [], 0, 0
    while len(raw) - at + 1 > capacity:
        end = at + capacity
        if end >= len(raw):  # the text fits, its end mark does not
            end = len(raw) - 1
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        n = len(raw[at:end].decode("utf-8", "surrogatepass"))
        out.append((chars, chars + n, end - at))
        at, chars = end, chars + n
    out.append((chars, len(text), len(raw) - at + 1))
    return out


def items(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, pieces, start_pos, end_pos, tokens): what has to be packed.

    Null texts are no items; an empty text is its end mark alone. Only texts
    above the capacity are cut and pass through Python; repeated rows are
    repeated items.
    """
    if capacity < 8:
        raise ValueError("a container must hold the longest code point and an end mark")
    sized = pick(documents, "doc_id", "text").select("doc_id", "text", byte_tokens(F.col("text")).alias("tokens")).where("text is not null")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, len(p), s, e, t) for d, text in zip(b["doc_id"], b["text"]) for p in [cut_points(text, capacity)] for i, (s, e, t) in enumerate(p)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "pieces", "start_pos", "end_pos", "tokens"])

    whole = sized.where(F.col("tokens") <= capacity).select("doc_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start_pos"), F.char_length("text").alias("end_pos"), "tokens")
    return whole.unionByName(sized.where(F.col("tokens") > capacity).select("doc_id", "text").mapInPandas(cut, _PIECES))


class Knapsack:
    """How often to take each class so that the price is largest: unbounded knapsack by dynamic programming.

    ``units`` ascends. A block of as many capacities as the smallest class is
    long depends on earlier blocks only, so it is computed at once; what each
    capacity leaves behind every class is the same for all prices.
    """

    def __init__(self, units: np.ndarray, room: int):
        self.units, self.room, least = units, room, int(units[0])
        self.blocks = []
        for lo in range(least, room + 1, least):
            hi = min(lo + least, room + 1)
            left = np.arange(lo, hi)[:, None] - units[None, : np.searchsorted(units, hi - 1, side="right")]
            self.blocks.append((lo, hi, np.where(left < 0, room + 1, left)))

    def best(self, price: np.ndarray) -> np.ndarray:
        value, pick = np.zeros(self.room + 2), np.full(self.room + 1, -1)
        value[-1] = -np.inf  # no room for that class
        for lo, hi, left in self.blocks:
            gain = value[left]
            gain += price[: left.shape[1]]
            best = gain.argmax(1)
            value[lo:hi], pick[lo:hi] = gain[np.arange(hi - lo), best], best
        take, c = np.zeros(len(self.units), dtype=np.int64), self.room
        while pick[c] >= 0:
            take[pick[c]] += 1
            c -= self.units[pick[c]]
        return take


def configuration_lp(units: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Fractional solution [(configuration, copies)] that covers every class about once.

    Rounds of multiplicative weights; a round's configuration is used as often
    as its scarcest class allows.
    """
    m, knapsack = len(units), Knapsack(units, room)
    epsilon = min(0.25, (m * np.log(m + 1) / (10 * ROUNDS)) ** 0.5)
    covered, made = np.zeros(m), {}
    goal = max(2.0, np.log(m + 1) / epsilon**2 / 4)
    while covered.min() < goal:
        price = np.exp(-epsilon * (covered - covered.min())) / counts
        a = knapsack.best(price)
        used = a > 0
        step = float((counts[used] / a[used]).min())
        covered[used] += a[used] * step / counts[used]
        key = a.tobytes()
        made[key] = (a, made.get(key, (a, 0.0))[1] + step)
    scale = np.median(covered)
    return [(a, x / scale) for a, x in made.values()]


def grouped(hist: dict[int, int], classes: int) -> dict[int, int]:
    """size -> class: linear grouping of the sizes, each class named by its largest size.

    A size that holds its share of all items, or all of them where there are
    no more sizes than ``classes``, is a class of its own, in its exact size;
    runs of rarer sizes share a class.
    """
    sizes = sorted(hist)
    if len(sizes) <= classes:
        return {s: s for s in sizes}
    share, out, run, held = sum(hist.values()) * 2 / classes, {}, [], 0
    for s in sizes:
        if run and held + hist[s] > share:
            out |= dict.fromkeys(run, run[-1])
            run, held = [], 0
        run.append(s)
        held += hist[s]
    return out | dict.fromkeys(run, run[-1])


def pack_histogram(hist: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, tuple[int, ...]]]:
    """[(copies, sizes)]: whole containers that hold each size as often as the histogram says.

    The linear program is solved again for what its rounding left over, as
    long as that places items; what then is left is fitted by best fit.
    """
    small = {s: n for s, n in hist.items() if n > 0 and s <= capacity * SMALL}
    left = {s: n for s, n in hist.items() if n > 0 and s not in small}
    groups: list[tuple[int, tuple[int, ...]]] = []
    while sum(left.values()) > MANY * classes or not groups and left:
        name = grouped(left, classes)
        units = np.array(sorted(set(name.values())), dtype=np.int64)
        at = {int(u): i for i, u in enumerate(units)}
        counts = np.zeros(len(units))
        for s, n in left.items():
            counts[at[name[s]]] += n
        stock = _Stock(left, lambda s: at[name[s]])
        for a, x in sorted(configuration_lp(units, counts, capacity), key=lambda t: (-t[1], t[0].tobytes())):
            groups += stock.fill(a, int(x), capacity)
        before, left = sum(left.values()), {s: n for s, n in stock.left.items() if n}
        if sum(left.values()) == before:
            break
    return _fit(groups, small | left, capacity)


class _Stock:
    """Exact sizes still to be placed, by class of the linear program."""

    def __init__(self, left: dict[int, int], class_of):
        self.left, self.class_of, self.sizes = dict(left), class_of, sorted(left)
        self.by_class: dict[int, list[int]] = {}
        self.in_class: dict[int, int] = {}
        for s in self.sizes:
            self.by_class.setdefault(class_of(s), []).append(s)
            self.in_class[class_of(s)] = self.in_class.get(class_of(s), 0) + self.left[s]

    def _take(self, s: int, k: int) -> None:
        self.left[s] -= k
        self.in_class[self.class_of(s)] -= k
        if not self.left[s]:
            self.sizes.pop(bisect_left(self.sizes, s))
            own = self.by_class[self.class_of(s)]
            own.pop(bisect_left(own, s))

    def fill(self, a: np.ndarray, copies: int, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
        """Whole containers of configuration ``a``, as runs of equal ones.

        All items but the smallest come from their classes; then the largest
        exact size that still fits goes in, from whatever class, until none does.
        """
        chosen = [int(i) for i in np.flatnonzero(a) for _ in range(int(a[i]))]
        first = chosen[1:] or chosen
        need = {i: first.count(i) for i in set(first)}
        copies = min([copies, *(self.in_class[i] // n for i, n in need.items())])
        if copies <= 0:
            return []
        runs = []
        for i in first:
            run, k = [], copies
            while k:
                s = self.by_class[i][-1]
                n = min(k, self.left[s])
                self._take(s, n)
                run.append((s, n))
                k -= n
            runs.append(run)
        out, todo = [], _aligned(runs, copies)
        while todo:
            k, g = todo.pop()
            j = bisect_left(self.sizes, capacity - sum(g) + 1) - 1
            if j < 0:
                out.append((k, g))
                continue
            s = self.sizes[j]
            n = min(k, self.left[s])
            self._take(s, n)
            todo.append((n, (*g, s)))
            if n < k:
                todo.append((k - n, g))
        return out


def _aligned(runs: list[list[tuple[int, int]]], copies: int) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of (size, containers) side by side, cut wherever one of them changes."""
    ends = sorted({copies} | {int(e) for run in runs for e in np.cumsum([k for _, k in run])})
    out, start, pos, used = [], 0, [0] * len(runs), [0] * len(runs)
    for e in ends:
        k = e - start
        out.append((k, tuple(run[p][0] for run, p in zip(runs, pos))))
        for j, run in enumerate(runs):
            used[j] += k
            if used[j] == run[pos[j]][1]:
                pos[j], used[j] = pos[j] + 1, 0
        start = e
    return out


def _fit(groups: list[tuple[int, tuple[int, ...]]], rest: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, largest size first, of what rounding left over: into gaps, else into new containers."""
    by_gap: list[tuple[int, tuple[int, ...], int]] = sorted((capacity - sum(g), g, k) for k, g in groups)
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            i = bisect_left(by_gap, (s, (), 0))
            if i < len(by_gap):
                gap, g, k = by_gap.pop(i)
                each = 1 if k > 1 else min(gap // s, n)
            else:  # new containers, each as full of this size as can be
                each = min(capacity // s, n)
                gap, g, k = capacity, (), n // each
            full = min(k, n // each)
            if full < k and g:
                insort(by_gap, (gap, g, k - full))
            if full:
                insort(by_gap, (gap - s * each, g + (s,) * each, full))
            n -= full * each
    out: dict[tuple[int, ...], int] = {}
    for _, g, k in by_gap:
        out[tuple(sorted(g))] = out.get(tuple(sorted(g)), 0) + k
    return [(k, g) for g, k in sorted(out.items())]


def slots(groups: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (tokens, lo, hi, each, first), sorted: ranks lo..hi-1 of a size go to containers first + (rank - lo) // each."""
    out, seen, first = [], {}, 0
    for copies, g in groups:
        for s in sorted(set(g)):
            each = g.count(s)
            lo = seen.get(s, 0)
            seen[s] = lo + copies * each
            out.append((s, lo, seen[s], each, first))
        first += copies
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def container_of(table: np.ndarray, tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The container of each item by its size and its rank within it, by binary search in the slots."""
    i = np.searchsorted((table[:, 0] << 48) + table[:, 1], (tokens.astype(np.int64) << 48) + rank, side="right") - 1
    return table[i, 4] + (rank - table[i, 1]) // table[i, 3]


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, pieces, start_pos, end_pos, tokens, container) for every text.

    No container holds more than ``capacity`` tokens; a text is in several
    pieces only if it alone is larger. An empty table gives no rows.
    """
    spark = documents.sparkSession
    parts = written(items(documents, capacity), "items")
    hist = {int(r.tokens): int(r.n) for r in parts.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    found = slots(pack_histogram(hist, capacity))
    if len(found) > MAX_SLOTS:
        raise ValueError(f"more than {MAX_SLOTS} slots")
    table = spark.sparkContext.broadcast(found)

    @F.pandas_udf("long")
    def container(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(container_of(table.value, tokens.to_numpy(), rank.to_numpy()))

    ranked = rank_within(parts, "tokens", ["doc_id", "piece"], sum(hist.values()))
    return ranked.select("doc_id", "piece", "pieces", "start_pos", "end_pos", "tokens", container("tokens", "rank").alias("container"))


def split_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id): documents that the packing had to split, since their pieces lie in several containers."""
    lies = pack(documents, capacity).where("pieces > 1").groupBy("doc_id").agg(F.min("container").alias("lo"), F.max("container").alias("hi"))
    return lies.where("lo < hi").select("doc_id")


def containers(documents: DataFrame, capacity: int = CAPACITY, slack: float = 0.005) -> DataFrame:
    """One row (documents, tokens, overfull, close): what was packed, containers above the capacity, and whether there are at most ``slack`` more (rounded up) than the sum of sizes needs.

    Every document counts once, by its first piece.
    """
    held = pack(documents, capacity).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.when(F.col("piece") == 0, 1)).alias("documents"))
    n = held.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("tokens") > capacity, 1)).alias("overfull"), F.count(F.lit(1)).alias("containers"))
    return n.select("documents", "tokens", "overfull", (F.col("containers") <= F.ceil(F.col("tokens") / capacity * (1 + slack))).alias("close"))
