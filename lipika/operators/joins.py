"""Joins beyond a plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.functions.arrays import let, span_overlap
from lipika.operators.ordering import numbered
from lipika.operators.skew import lookup_join


def last_write(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row of each key that ``order`` puts last: an aggregate, not a window, so a hot key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def resume(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose keys are not done yet."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def leaking(train: DataFrame, held: DataFrame, path: str, forbidden: str) -> DataFrame:
    """Rows of ``train`` whose path, or whose file name, occurs in ``held``, or whose path contains ``forbidden``."""
    base = lambda c: F.element_at(F.split(F.replace(F.col(c), F.lit("\\"), F.lit("/")), "/"), -1)
    names = held.select(base(path).alias("_base")).distinct()
    t = train.withColumn("_base", base(path))
    by_name = t.join(names, "_base", "left_semi")
    return by_name.unionByName(t.join(names, "_base", "left_anti").where(F.col(path).contains(forbidden))).drop("_base")


def assert_none(df: DataFrame, message: str) -> None:
    """Raise if there is any row; names the first twenty."""
    bad = df.limit(20).collect()
    if bad:
        raise ValueError(f"{message}: {bad}")


def length_matched(a: DataFrame, b: DataFrame, length: str, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Pairs one to one of equal length, in ``order`` on each side; surplus rows of either side go unmatched."""
    keys = [*by, length]
    x = numbered(a, keys, list(order), "_rn")
    y = numbered(b, keys, list(order), "_rn")
    y = y.select(*keys, "_rn", *[F.col(c).alias(f"{c}_b") for c in y.columns if c not in (*keys, "_rn")])
    return x.join(y, [*keys, "_rn"]).drop("_rn")


def deranged(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Each row with the ``columns`` of another row of its group: the next in ``order``, the last with the first.

    A single cycle, so no row meets itself unless it is alone in its group;
    such rows are left out.
    """
    by = list(by)
    r = numbered(df, by, list(order), "_rn", "_n").where("_n > 1")
    nxt = r.select(*by, F.when(F.col("_rn") == 1, F.col("_n")).otherwise(F.col("_rn") - 1).alias("_rn"), *[F.col(c).alias(f"paired_{c}") for c in columns])
    return r.join(nxt, [*by, "_rn"]).drop("_rn", "_n")


def bind_to_headers(cells: DataFrame, headers: DataFrame, table: Sequence[str]) -> DataFrame:
    """Each cell with the header column of largest x-overlap in its table; ties, and no overlap at all, give the smaller column.

    ``cells`` have x0, x1; ``headers`` are few to a table and are gathered as
    an array for each, so a cell row never multiplies.
    """
    h = headers.groupBy(*table).agg(F.sort_array(F.collect_list(F.struct("col", "x0", "x1"))).alias("_h"))
    scored = F.transform("_h", lambda x: F.struct(span_overlap(F.col("x0"), F.col("x1"), x["x0"], x["x1"]).alias("o"), (-x["col"]).alias("c")))
    return lookup_join(cells, h, list(table), "inner").withColumn("bound", -F.array_max(scored)["c"]).drop("_h")


def votes_order(blocks: Column, band: float = 0.02) -> Column:
    """Ids of blocks (struct id, x, y) by pairwise votes: above wins; within a band the left one, else the later in the array.

    Works on the array of one page, whose length is the page's; ties by id.
    """
    before = lambda a, b: F.when(a["y"] + band < b["y"], True).when(b["y"] + band < a["y"], False).otherwise(a["x"] < b["x"])

    def votes(a: Column, i: Column) -> Column:
        won = F.transform(blocks, lambda b, j: F.when(j > i, before(a, b)).when(j < i, ~before(b, a)).otherwise(False))
        return F.struct((-F.size(F.filter(won, lambda w: w))).alias("s"), a["id"].alias("id"))

    return F.transform(F.array_sort(F.transform(blocks, votes)), lambda s: s["id"])


def ngrams(tokens: Column, n: int, bos: str = "<BOS>", eos: str = "<EOS>") -> Column:
    """struct(ctx, tok, pos) for every event of a token array, the end of text included."""
    event = lambda f, i: F.struct(F.array_join(F.slice(f, i + 1, n - 1), "\u0001").alias("ctx"), F.get(f, i + (n - 1)).alias("tok"), i.alias("pos"))
    padded = F.concat(F.array_repeat(F.lit(bos), n - 1), tokens, F.array(F.lit(eos)))
    return let(padded, lambda f: F.transform(F.sequence(F.lit(0), F.size(f) - n), lambda i: event(f, i)))


def ngram_log_probs(train: DataFrame, pairs: DataFrame, tokens: str, n: int, alpha: float = 0.01) -> DataFrame:
    """``pairs`` (ctx, tok, and what else they carry) with add-alpha log-probabilities under counts of ``train``.

    The end of text counts as an event in training. The vocabulary is the
    training tokens and two more. Counts of pairs and contexts are joined to
    ``pairs`` as tables of distinct keys, so ``pairs`` should be aggregated.
    """
    events = train.select(F.explode(ngrams(F.col(tokens), n)).alias("e")).select("e.ctx", "e.tok")
    pair = events.groupBy("ctx", "tok").agg(F.count(F.lit(1)).alias("c"))
    ctx = pair.groupBy("ctx").agg(F.sum("c").alias("cc"))
    v = pair.where("tok <> '<EOS>'").agg((F.count_distinct("tok") + 2).alias("v"))
    scored = pairs.join(pair, ["ctx", "tok"], "left").join(ctx, "ctx", "left").crossJoin(F.broadcast(v))
    p = (F.coalesce("c", F.lit(0)) + alpha) / (F.coalesce("cc", F.lit(0)) + alpha * F.col("v"))
    return scored.withColumn("log_p", F.ln(p)).drop("c", "cc", "v")


def ngram_scores(train: DataFrame, test: DataFrame, tokens: str, n: int, alpha: float = 0.01) -> DataFrame:
    """(id, pos, log_p) for every event of ``test``; the end of text is not scored."""
    t = test.select("id", F.explode(ngrams(F.col(tokens), n)).alias("e")).select("id", "e.ctx", "e.tok", "e.pos").where(F.col("tok") != "<EOS>")
    probs = ngram_log_probs(train, t.select("ctx", "tok").distinct(), tokens, n, alpha)
    return lookup_join(t, probs, ["ctx", "tok"], "inner").select("id", "pos", "log_p")
