"""Problem 2: splits that keep related records together.

Pages are tied by (script, mode, page number) and by the layout source that
their ``layout_source`` holds; lines follow their page. Components come from
:mod:`lipika.llm.components`; their label vectors are aggregated and placed by
grouped iterative stratification: the component with the rarest outstanding
label goes to the split that needs that label most.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.llm.components import components, links_through
from lipika.llm.labels import label
from lipika.llm.ranks import rank_within
from lipika.operators.ordering import numbered
from lipika.operators.skew import broadcast_if_small, lookup_join
from lipika.session import pick, shared_path, written

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Classes of equal label vectors that the driver places together; more are placed block after block, with the needs carried on.
BLOCK = 100_000
#: Label values are categories; with more of them (labels that are free text) the split is refused.
MAX_LABELS = 500_000
#: Different lengths of layout ids.
MAX_LENGTHS = 256
#: Columns of a page whose values are to be spread evenly.
LABELS = ("script", "mode", "tier", "layout_category")

_STEM = r"(?i)^\s*([a-z]+)_page0*(\d+)\s*$"
_PATH = r"(?i)([^/\\]+)[/\\]+([a-z]+)_page0*(\d+)(?:_r0*(\d+))?\.[a-z]+\s*$"


def pages_keyed(pages: DataFrame) -> DataFrame:
    """``pages`` reduced to page_id, script, mode, page_no, layout_source, tier and layout_category.

    Where ``page_idx`` or ``mode`` is null, ``stem`` gives it. A page whose
    script, mode or number stays unknown ties to nothing by page.
    """
    number = F.coalesce(F.col("page_idx").cast("long"), F.expr(f"try_cast(nullif(regexp_extract(stem, r'{_STEM}', 2), '') as bigint)"))
    mode = F.coalesce(label("mode"), F.nullif(F.lower(F.regexp_extract("stem", _STEM, 1)), F.lit("")))
    return pick(pages, "page_id", "script", "mode", "page_idx", "stem", "layout_source", "tier", "layout_category").select("page_id", label("script").alias("script"), mode.alias("mode"), number.alias("page_no"), "layout_source", label("tier").alias("tier"), label("layout_category").alias("layout_category"))


def lines_keyed(lines: DataFrame) -> DataFrame:
    """(line_id, script, mode, page_no, row_no): the page that ``image_path`` names, in any writing of the path.

    ``row_no`` is ``line_index``, or where that is null the row in the path.
    """
    part = lambda k: F.nullif(F.regexp_extract("image_path", _PATH, k), F.lit(""))
    row = F.coalesce(F.col("line_index").cast("long"), part(4).try_cast("long"))
    return pick(lines, "line_id", "image_path", "line_index").select("line_id", label(part(1)).alias("script"), F.lower(part(2)).alias("mode"), part(3).try_cast("long").alias("page_no"), row.alias("row_no"))


def _form(c: Column) -> Column:
    """Letters and digits in lower case, without separators; each run of digits in angle brackets, so that it only equals whole runs."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(c), "[<>]", " "), r"(\p{Nd}+)", "<$1>")
    return F.regexp_replace(apart, r"[^\p{L}\p{Nd}<>]", "")


def _spans(n: int) -> Column:
    """Every stretch of ``n`` characters as (at, len, source)."""
    return F.when(F.length("t") >= n, F.transform(F.sequence(F.lit(0), F.length("t") - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.substring("t", i + 1, F.lit(n)).alias("source")))).otherwise(F.array().cast("array<struct<at:int,len:int,source:string>>"))


def sources_named(pages: DataFrame, bank: DataFrame) -> DataFrame:
    """(page_id, source): the bank sources whose ``source_id`` the page's ``layout_source`` holds.

    Both are read as letters and whole numbers: letter case, separators and
    additions before or behind don't matter (``Wiki-12 v2`` and ``xwiki12``
    hold ``wiki12``), but a longer number is another one (``wiki123`` doesn't).
    Each stretch as long as some bank id is looked up by equality; where one id
    lies within another, the longer counts. Values that hold none give no row.
    Distinct values are looked up once and joined back without a hot task.
    """
    ids = pick(bank, "source_id").select(_form(F.col("source_id")).alias("source")).where("source <> ''").distinct()
    lens = [r.len for r in ids.select(F.length("source").alias("len")).distinct().orderBy("len").limit(MAX_LENGTHS + 1).collect()]
    if len(lens) > MAX_LENGTHS:
        raise ValueError(f"layout ids of more than {MAX_LENGTHS} different lengths")
    values = pages.select("layout_source").where("layout_source is not null").distinct().withColumn("t", _form(F.col("layout_source")))
    if not lens:
        return values.sparkSession.createDataFrame([], "page_id long, source string")
    spans = F.flatten(F.array(*[_spans(n) for n in lens]))
    found = values.select("layout_source", F.inline(spans)).join(ids, "source")
    inner = found.groupBy("layout_source").agg(F.collect_set(F.struct("at", "len", "source")).alias("hits"))
    inside = lambda x, y: (y["at"] <= x["at"]) & (y["at"] + y["len"] >= x["at"] + x["len"]) & (y["len"] > x["len"])
    best = inner.select("layout_source", F.array_distinct(F.transform(F.filter("hits", lambda x: ~F.exists("hits", lambda y: inside(x, y))), lambda x: x["source"])).alias("sources"))
    best = written(best, "sources")
    return lookup_join(pages.select("page_id", "layout_source").dropna(), best, ["layout_source"], "inner").select("page_id", F.explode("sources").alias("source"))


def page_components(pages: DataFrame, bank: DataFrame) -> DataFrame:
    """(page_id, root): every page row with the smallest ``page_id`` of its group.

    Ties through the page key and through the layout source chain. A page
    without any tie is a group of its own.
    """
    keyed = written(pages_keyed(pages), "pages")
    key = F.when(F.col("script").isNotNull() & F.col("mode").isNotNull() & F.col("page_no").isNotNull(), F.concat_ws("\u0001", "script", "mode", "page_no"))
    by_page = links_through(keyed.select("page_id", key.alias("k")), "page_id", "k")
    by_source = links_through(sources_named(keyed, bank), "page_id", "source")
    roots = components(by_page.unionByName(by_source))
    return keyed.select("page_id").join(roots, keyed.page_id == roots.node, "left").select("page_id", F.coalesce("root", "page_id").alias("root"))


def tied(pages: DataFrame, bank: DataFrame) -> DataFrame:
    """(first_page_id, page_id): every page row but the first of its group."""
    return page_components(pages, bank).where("root <> page_id").select(F.col("root").alias("first_page_id"), "page_id")


def assign(pages: DataFrame, lines: DataFrame, bank: DataFrame, splits: dict[str, float] | None = None) -> DataFrame:
    """(record_kind, record_id, component, split) for every page row and line row.

    ``component`` is the smallest ``page_id`` of the group; lines whose page
    has no row form a group by their page, and lines whose path names no page
    a group of their own (both with negative numbers). Empty tables give no
    rows; repeated lines stay repeated, in one split.
    """
    splits = splits or SPLITS
    roots = page_components(pages, bank)
    keyed = pages_keyed(pages).join(roots, "page_id")
    page_key = ["script", "mode", "page_no"]
    of_page = keyed.dropna(subset=page_key).groupBy(*page_key).agg(F.min("root").alias("root"))
    named = lines_keyed(lines)
    alone = -F.abs(F.coalesce(F.when(F.col("page_no").isNotNull(), F.xxhash64(*page_key)), F.xxhash64("line_id"))) - 1
    line_rows = lookup_join(written(named, "lines").dropna(subset=page_key), written(of_page, "page-roots"), page_key, "left").unionByName(named.where("script is null or mode is null or page_no is null").withColumn("root", F.lit(None).cast("long"))).select(F.lit("line").alias("record_kind"), F.col("line_id").alias("record_id"), F.coalesce("root", alone).alias("component"), "script", "mode", F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("layout_category"))
    page_rows = keyed.select(F.lit("page").alias("record_kind"), F.col("page_id").alias("record_id"), F.col("root").alias("component"), *LABELS)
    both = written(page_rows.unionByName(line_rows), "split-rows")
    placed = place(written(vectors(both), "vectors"), splits)
    return lookup_join(both.select("record_kind", "record_id", "component"), placed, ["component"], "inner").select("record_kind", "record_id", "component", "split")


def vectors(rows: DataFrame) -> DataFrame:
    """(component, label, n): label vectors, with the label ``*`` for the rows of each kind."""
    marks = F.array(F.concat(F.lit("*="), "record_kind"), *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("-"))) for c in LABELS])
    return rows.select("component", F.explode(marks).alias("label")).where("label not like '%=-'").groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))


def place(vecs: DataFrame, splits: dict[str, float]) -> DataFrame:
    """(component, split): grouped iterative stratification.

    Components with equal label vectors form a class, and only classes and
    their counts are seen by the driver. The label with the fewest outstanding
    rows is taken first; its classes, those of the largest components first,
    are spread over the splits so that each component goes where that label is
    needed most. Then every component takes a split by its rank in its class.
    Classes beyond one block of :data:`BLOCK` follow in the order of their
    rarest label, and the splits' needs are carried on.
    """
    spark = vecs.sparkSession
    names = list(splits)
    total = {r.label: r.n for r in vecs.groupBy("label").agg(F.sum("n").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(total) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} label values")
    parts = vecs.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("vector"))
    parts = written(parts.select("component", F.md5(F.to_json("vector")).alias("class"), "vector"), "components")
    size = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + F.when(x["label"].startswith("*="), x["n"]).otherwise(0))
    ranks = spark.createDataFrame([(lab, i) for i, lab in enumerate(sorted(total, key=lambda x: (total[x], x)))], "label string, o int")
    rarest = vecs.join(broadcast_if_small(ranks, BLOCK), "label").groupBy("component").agg(F.min("o").alias("o"))
    classes = parts.join(rarest, "component").groupBy("class").agg(F.first("vector").alias("vector"), F.first("o").alias("o"), F.count(F.lit(1)).alias("copies")).withColumn("size", size)
    classes = written(numbered(written(classes, "classes"), [], [F.col("o"), F.col("size").desc(), F.col("class")], "rn"), "classes")
    n = classes.count()
    found = shared_path(spark, "placed")
    schema = "class string, " + ", ".join(f"s{i} long" for i in range(len(names)))
    spark.createDataFrame([], schema).write.parquet(found)
    needs = Needs(total, splits)
    for b in range(-(-n // BLOCK)):
        block = classes.where((F.col("rn") > b * BLOCK) & (F.col("rn") <= (b + 1) * BLOCK)).collect()
        rows = needs.place([(r["class"], {x.label: x.n for x in r.vector}, r.copies) for r in sorted(block, key=lambda r: r.rn)])
        spark.createDataFrame(rows, schema).write.mode("append").parquet(found)
    ranked = rank_within(parts.select("component", "class"), "class", ["component"], parts.count())
    split, upto = F.lit(names[-1]), F.lit(0)
    for i, name in reversed(list(enumerate(names[:-1]))):
        upto = sum((F.col(f"s{k}") for k in range(1, i + 1)), F.col("s0"))
        split = F.when(F.col("rank") < upto, name).otherwise(split)
    return lookup_join(written(ranked, "ranked"), spark.read.schema(schema).parquet(found), ["class"], "inner").select("component", split.alias("split"))


class Needs:
    """What every split still needs of every label, and how many rows of it are outstanding."""

    def __init__(self, total: dict[str, int], splits: dict[str, float]):
        self.left, self.names = dict(total), list(splits)
        whole = sum(splits.values())
        self.need = {lab: [n * splits[s] / whole for s in self.names] for lab, n in total.items()}

    def place(self, classes: list[tuple[str, dict[str, int], int]]) -> list[tuple]:
        """(class, components by split) for classes (name, label vector, components), the largest first within a label."""
        holds: dict[str, list[int]] = {}
        for k, (_, vector, _) in enumerate(classes):
            for lab in vector:
                holds.setdefault(lab, []).append(k)
        waiting = [(self.left[lab], lab) for lab in holds]
        heapify(waiting)
        out: dict[int, list[int]] = {}
        while waiting:
            n, lab = heappop(waiting)
            if n != self.left[lab]:
                continue  # a fewer number of it is further on
            mine = [k for k in holds[lab] if k not in out]
            touched: set[str] = set()
            for k in sorted(mine, key=lambda k: -sum(v for x, v in classes[k][1].items() if x.startswith("*="))):
                out[k] = self._spread(lab, classes[k][1], classes[k][2])
                touched |= classes[k][1].keys()
            for x in touched - {lab}:
                heappush(waiting, (self.left[x], x))
        return [(name, *out[k]) for k, (name, _, _) in enumerate(classes)]

    def _spread(self, lab: str, vector: dict[str, int], copies: int) -> list[int]:
        """How many of ``copies`` equal components each split takes, so that each goes where ``lab`` is needed most."""
        each, need = vector[lab], self.need[lab]
        took = [0] * len(need)
        level, rest = float("inf"), copies
        if copies > len(need):  # level the needs: all but a few at once
            order = sorted(need, reverse=True)
            for k in range(1, len(order) + 1):
                level = (sum(order[:k]) - copies * each) / k
                if k == len(order) or level >= order[k]:
                    break
            took = [max(0, int((x - level) / each)) for x in need]
            rest = copies - sum(took)
        self._take(vector, took)
        while rest > 0:
            s = max(range(len(need)), key=lambda s: (need[s], sum(self.need[x][s] for x in vector), -s))
            took[s] += 1
            self._take(vector, [int(s == t) for t in range(len(need))])
            rest -= 1
        return took

    def _take(self, vector: dict[str, int], took: list[int]) -> None:
        for x, v in vector.items():
            self.left[x] -= v * sum(took)
            self.need[x] = [n - v * k for n, k in zip(self.need[x], took)]


def balance(pages: DataFrame, lines: DataFrame, bank: DataFrame, splits: dict[str, float] | None = None, tolerance: float = 0.02) -> DataFrame:
    """One row a kind of record (record_kind, records, broken, close): how many were placed, components in several splits, and whether the splits' shares are met.

    A share is met if it is ``tolerance`` away at most, or by the rows of the
    largest component.
    """
    splits = splits or SPLITS
    rows = written(assign(pages, lines, bank, splits), "assigned")
    comp = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))
    broken = comp.agg(F.count(F.when(F.col("splits") > 1, 1)).alias("broken"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    whole = sum(splits.values())
    off = [F.abs(F.count(F.when(F.col("split") == s, 1)) - F.count(F.lit(1)) * (share / whole)) for s, share in splits.items()]
    kinds = rows.groupBy("record_kind").agg(F.count(F.lit(1)).alias("records"), F.greatest(*off).alias("off"))
    return kinds.crossJoin(F.broadcast(broken)).select("record_kind", "records", "broken", (F.col("off") <= F.greatest(F.col("records") * tolerance, F.col("largest"))).alias("close"))
