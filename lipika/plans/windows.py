"""E, F, G: ranks, running sums, top-k, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lipika.functions import arrays, text
from lipika.operators.ordering import midranks, numbered, running
from lipika.plans.registry import query
from lipika.plans.views import CALLS, READINGS, READS, STEPS, calls, clusters_read, clusters_sql, glyphs_sql, readings, steps, ws_sql
from lipika.session import load

_COST = "case when sarvam_text = ground_truth then 0.0 else 1.0 end"


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """(probe_id, script, score, cost) of calls with a confidence."""
    cost = F.when(F.col("sarvam_text") == F.col("ground_truth"), 0.0).otherwise(1.0)
    return calls(spark, root).where("confidence is not null").select("probe_id", "script", F.col("confidence").alias("score"), cost.alias("cost"))


_SCORED = f"{CALLS}, scored as (select probe_id, script, confidence as score, {_COST} as cost from calls where confidence is not null)"


@query(f"with {_SCORED}, r as (select script, score, rank() over (partition by script order by score) as r, count(*) over (partition by script, score) as ties from scored) select distinct script, score, ties, r + (ties - 1) / 2.0 as midrank from r")
def e1_average_ranks(spark: SparkSession, root: str) -> DataFrame:
    return midranks(_scored(spark, root), ["script"], "score").select("script", "score", "ties", "midrank")


@query(f"with {STEPS} select vec_id, len(list_filter(p, lambda x: x > p[label + 1])) + 1 as rank from steps")
def e2_token_rank(spark: SparkSession, root: str) -> DataFrame:
    return steps(spark, root).select("vec_id", arrays.rank_of(F.col("p"), F.col("label")).cast("long").alias("rank"))


@query(f"""with {_SCORED}, r as (select probe_id, script, row_number() over (partition by script order by score, probe_id) as lo, row_number() over (partition by script order by score desc, probe_id) as hi from scored)
  select probe_id, lo <= 20 as low, hi <= 20 as high from r""")
def e3_topk_masks(spark: SparkSession, root: str) -> DataFrame:
    """Which calls are among the 20 lowest and the 20 highest scores of their script."""
    s = _scored(spark, root)
    lo = numbered(s, ["script"], [F.col("score"), F.col("probe_id")], "lo").select("probe_id", (F.col("lo") <= 20).alias("low"))
    hi = numbered(s, ["script"], [F.col("score").desc(), F.col("probe_id")], "hi").select("probe_id", (F.col("hi") <= 20).alias("high"))
    return lo.join(hi, "probe_id")


@query(f"""with {_SCORED} select probe_id, row_number() over (order by score, probe_id) as k, round((sum(cost) over () - sum(cost) over (order by score, probe_id rows unbounded preceding)) / count(*) over (), 9) as residual from scored""")
def e4_cascade_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Error that remains when the k lowest scores are passed on, for every k, in one pass."""
    s = _scored(spark, root)
    t = s.agg(F.sum("cost").alias("t"), F.count(F.lit(1)).alias("n"))
    r = running(s, [F.col("score"), F.col("probe_id")], {"k": F.lit(1), "upto": F.col("cost")})
    return r.crossJoin(F.broadcast(t)).select("probe_id", F.col("k").cast("long").alias("k"), F.round((F.col("t") - F.col("upto")) / F.col("n"), 9).alias("residual"))


@query(f"""with {_SCORED}, g as (select score, sum(cost) as pos, sum(1 - cost) as neg from scored group by score), c as (select score, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from g window w as (order by score desc))
  select score, round(fp / nullif(n, 0), 9) as fpr, round(tp / nullif(p, 0), 9) as tpr from c""")
def e5_roc_points(spark: SparkSession, root: str) -> DataFrame:
    """One point for each distinct score, ties collapsed."""
    g = _scored(spark, root).groupBy("score").agg(F.sum("cost").alias("pos"), F.sum(1 - F.col("cost")).alias("neg"))
    t = g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    r = running(g, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}).crossJoin(F.broadcast(t))
    return r.select("score", F.round(F.try_divide("fp", "n"), 9).alias("fpr"), F.round(F.try_divide("tp", "p"), 9).alias("tpr"))


@query(f"""with w as (select {glyphs_sql('text')} as t from line_gt where text is not null), b as (select case when i = 0 then '' else t[i] end as a, t[i + 1] as b from (select t, unnest(range(0, len(t))) as i from w)) select a, b, count(*) as n from b group by a, b""")
def e7_adjacent_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Glyph bigrams of lines, within each array; under an empty first glyph the counts of those that begin a line."""
    g = text.glyph_clusters(F.col("text"))
    d = load(spark, root, "line_gt").where("text is not null").select(F.concat(F.array(F.lit("")), g).alias("t"))
    pairs = F.when(F.size("t") > 1, F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b")))
    return d.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {READINGS}, w as (select row_no, string_split({ws_sql('hyp')}, ' ') as t from readings where {ws_sql('hyp')} <> ''), u as (select row_no, i, t[i] as x from (select row_no, t, unnest(range(1, len(t) + 1)) as i from w)),
  g as (select *, i - row_number() over (partition by row_no, x order by i) as grp from u), r as (select row_no, x, grp, count(*) as n, min(i) as s from g group by all), b as (select *, row_number() over (partition by row_no order by n desc, s) as rn from r)
  select n::int as n, count(*) as rows from b where rn = 1 group by 1""")
def e8_longest_run(spark: SparkSession, root: str) -> DataFrame:
    """Longest run of one repeated word in a reading, by length of run."""
    w = text.words(F.col("hyp"))
    return readings(spark, root).select(text.longest_run(w)["n"].alias("n")).where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("rows"))


_FREQ = f"freq as (select ch, count(*) as n from (select unnest({glyphs_sql('text')}) as ch from line_gt where text is not null) group by ch)"


def _freq(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "line_gt").where("text is not null").select(F.explode(text.glyph_clusters(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_FREQ}, a as (select ch, n, row_number() over (order by n, ch) as up, row_number() over (order by n desc, ch) as down from freq) select x.ch, round(y.n / (select sum(n) from freq), 9) as inverted from a x join a y on x.up = y.down""")
def e10_rank_inversion(spark: SparkSession, root: str) -> DataFrame:
    """Each glyph with the mass of the glyph at the opposite rank."""
    f = _freq(spark, root)
    up = numbered(f, [], [F.col("n"), F.col("ch")], "k").select("ch", "k")
    down = numbered(f, [], [F.col("n").desc(), F.col("ch")], "k").select("n", "k")
    t = f.agg(F.sum("n").alias("t"))
    return up.join(down, "k").crossJoin(F.broadcast(t)).select("ch", F.round(F.col("n") / F.col("t"), 9).alias("inverted"))


@query(f"""with recursive {READS} select true_cluster as a, predicted_cluster as b, count(*) as n from readings join texts using (gt, hyp) join reads using (k) where true_cluster <> predicted_cluster group by a, b order by n desc, a, b limit 15""")
def f1_top_confusions(spark: SparkSession, root: str) -> DataFrame:
    """The most frequent confusions of clusters anywhere in a text."""
    r = clusters_read(spark, root).where("true_cluster <> predicted_cluster")
    return r.groupBy(F.col("true_cluster").alias("a"), F.col("predicted_cluster").alias("b")).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "a", "b").limit(15)


_TWO = f"""x as (select ch, count(*) as n from (select unnest({glyphs_sql('text')}) as ch from line_gt where text is not null) group by ch), y as (select ch, count(*) as n from (select unnest({glyphs_sql('text')}) as ch from page_gt where text is not null) group by ch),
  d as (select coalesce(x.ch, y.ch) as ch, coalesce(x.n, 0) / (select sum(n) from x) as p, coalesce(y.n, 0) / (select sum(n) from y) as q from x full join y on x.ch = y.ch)"""


def _two(spark: SparkSession, root: str) -> DataFrame:
    def pmf(table: str, name: str) -> DataFrame:
        c = load(spark, root, table).where("text is not null").select(F.explode(text.glyph_clusters(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
        return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("ch", (F.col("n") / F.col("t")).alias(name))

    return pmf("line_gt", "p").join(pmf("page_gt", "q"), "ch", "full").select("ch", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


@query(f"with {_TWO} select ch, round(p - q, 9) as delta from d order by round(abs(p - q), 12) desc, ch limit 12")
def f2_largest_deltas(spark: SparkSession, root: str) -> DataFrame:
    return _two(spark, root).select("ch", F.round(F.col("p") - F.col("q"), 9).alias("delta"), F.round(F.abs(F.col("p") - F.col("q")), 12).alias("m")).orderBy(F.col("m").desc(), "ch").limit(12).drop("m")


@query(f"with v as (select ch, count(*) as n from (select unnest({clusters_sql('text')}) as ch from line_gt where text is not null) group by ch having count(*) >= 5) select ch, row_number() over (order by n desc, ch) + 3 as id from v")
def f3_vocabulary_order(spark: SparkSession, root: str) -> DataFrame:
    """Ids of clusters seen five times or more by frequency, after the four special ids."""
    v = load(spark, root, "line_gt").where("text is not null").select(F.explode(text.graphemes(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return numbered(v.where("n >= 5"), [], [F.col("n").desc(), F.col("ch")], "k").select("ch", (F.col("k") + 3).alias("id"))


@query("""with r as (select layout_id, r.* from (select layout_id, unnest(regions) as r from layout_bank)) select layout_id, string_agg(name, ',' order by y, x, name) as ord from r group by layout_id""")
def f4_reading_order(spark: SparkSession, root: str) -> DataFrame:
    s = F.array_sort(F.transform("regions", lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["name"].alias("name"))))
    return load(spark, root, "layout_bank").where(F.size("regions") > 0).select("layout_id", F.array_join(F.transform(s, lambda r: r["name"]), ",").alias("ord"))


@query(f"with {CALLS} select probe_id, row_number() over (order by coalesce(try_cast(image_id as bigint), 0), probe_id) as pos from calls")
def f5_numeric_string_sort(spark: SparkSession, root: str) -> DataFrame:
    """Ids sorted as numbers; what is none counts as 0."""
    d = calls(spark, root).select("probe_id", F.coalesce(F.col("image_id").try_cast("long"), F.lit(0)).alias("k"))
    return numbered(d, [], [F.col("k"), F.col("probe_id")], "pos").select("probe_id", "pos")


@query(f"""with {READINGS}, {CALLS} select distinct image_id, language from readings semi join (select image_id, script as language from calls where condition = 'real') c using (image_id, language) where image_id is not null and language is not null order by language, image_id limit 20""")
def f6_first_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty images that both tables have."""
    r = readings(spark, root).select("image_id", "language").dropna().distinct()
    c = calls(spark, root).where("condition = 'real'").select("image_id", F.col("script").alias("language"))
    return r.join(c, ["image_id", "language"], "left_semi").orderBy("language", "image_id").limit(20)


@query(f"with {STEPS}, r as (select vec_id, i - 1 as i, p[i] as p, row_number() over (partition by vec_id order by p[i] desc, i) as k from (select *, unnest(range(1, 33)) as i from steps)) select vec_id, k, i, round(p, 9) as p from r where k <= 5")
def f7_top5_steps(spark: SparkSession, root: str) -> DataFrame:
    d = steps(spark, root).select("vec_id", F.posexplode(arrays.top_k(F.col("p"), 5)).alias("k", "t"))
    return d.select("vec_id", (F.col("k") + 1).cast("long").alias("k"), F.col("t.i").cast("long").alias("i"), F.round("t.p", 9).alias("p"))


@query(f"with {_SCORED}, n as (select script, count(*) as n from scored group by script) select script, round_even(0.2 * n, 0)::bigint as k from n")
def f8_half_even_k(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root).groupBy("script").agg(F.bround(0.2 * F.count(F.lit(1)), 0).cast("long").alias("k"))


@query(f"with {READINGS}, {CALLS} select source, count(*) as n, count(distinct txt) as texts from (select 'taxonomy' as source, gt as txt from readings union all select 'probe', ground_truth from calls) group by source")
def g1_concatenation(spark: SparkSession, root: str) -> DataFrame:
    a = readings(spark, root).select(F.lit("taxonomy").alias("source"), F.col("gt").alias("txt"))
    b = calls(spark, root).select(F.lit("probe").alias("source"), F.col("ground_truth").alias("txt"))
    return a.unionByName(b).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("txt").alias("texts"))


@query(f"with {READINGS} select count(*) as common from (select language, image_id from readings where engine = 'surya' intersect select language, image_id from readings where engine = 'tesseract')")
def g2_key_intersection(spark: SparkSession, root: str) -> DataFrame:
    r = readings(spark, root)
    side = lambda e: r.where(F.col("engine") == e).select("language", "image_id")
    return side("surya").intersect(side("tesseract")).agg(F.count(F.lit(1)).alias("common"))


@query(f"with {READINGS} select count(*) as only_plain from (select language, image_id from readings where variant = 'plain' except select language, image_id from readings where variant = 'degraded')")
def g3_key_difference(spark: SparkSession, root: str) -> DataFrame:
    r = readings(spark, root)
    side = lambda v: r.where(F.col("variant") == v).select("language", "image_id")
    return side("plain").subtract(side("degraded")).agg(F.count(F.lit(1)).alias("only_plain"))


@query(f"with {_TWO} select round(0.5 * sum(abs(p - q)), 9) as tv, 0.5 * sum(abs(p - q)) <= 0.08 as within from d")
def g4_total_variation(spark: SparkSession, root: str) -> DataFrame:
    """Total variation over the union of two supports, and the tolerance gate."""
    tv = 0.5 * F.sum(F.abs(F.col("p") - F.col("q")))
    return _two(spark, root).agg(F.round(tv, 9).alias("tv"), (tv <= 0.08).alias("within"))


_W = "list_sort(string_split({c}, ' '))"


@query(f"""with {READINGS} select engine, count(*) filter (where {_W.format(c=ws_sql('gt'))} = {_W.format(c=ws_sql('hyp'))}) as same_words, count(*) filter (where {_W.format(c=ws_sql('gt'))} = {_W.format(c=ws_sql('hyp'))}
  and {ws_sql('gt')} <> {ws_sql('hyp')} and len(string_split({ws_sql('gt')}, ' ')) >= 3) as reordered from readings group by engine""")
def g5_multiset_equality(spark: SparkSession, root: str) -> DataFrame:
    """Readings with the same words, and those with the same words in another order."""
    g, h = text.words(F.col("gt")), text.words(F.col("hyp"))
    return readings(spark, root).groupBy("engine").agg(F.count_if(F.array_sort(g) == F.array_sort(h)).alias("same_words"), F.count_if(text.reordered(F.col("gt"), F.col("hyp"))).alias("reordered"))


@query(f"""with {READINGS}, a as (select row_no, ch, count(*) as n from (select row_no, unnest({clusters_sql('gt')}) as ch from readings) where ch <> '' group by all), b as (select row_no, ch, count(*) as n from (select row_no, unnest({clusters_sql('hyp')}) as ch from readings) where ch <> '' group by all),
  s as (select a.row_no, sum(least(a.n, coalesce(b.n, 0))) / sum(a.n) as cov from a left join b using (row_no, ch) group by a.row_no) select count(*) as n, round(avg(cov), 6) as coverage from s""")
def g6_multiset_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Share of a truth's characters that the reading has, counted with multiplicity."""
    r = readings(spark, root)
    side = lambda c, n: r.select("row_no", F.explode(text.graphemes(F.col(c))).alias("ch")).where("ch <> ''").groupBy("row_no", "ch").agg(F.count(F.lit(1)).alias(n))
    s = side("gt", "a").join(side("hyp", "b"), ["row_no", "ch"], "left").groupBy("row_no").agg((F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a")).alias("cov"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cov"), 6).alias("coverage"))


@query("""select layout_id, list_sort(list_transform(regions, lambda r: r.reading_order)) = range(0, len(regions)) or list_sort(list_transform(regions, lambda r: r.reading_order)) = range(1, len(regions) + 1) as permutation from layout_bank""")
def g7_permutation_check(spark: SparkSession, root: str) -> DataFrame:
    o = F.array_sort(F.transform("regions", lambda r: r["reading_order"]))
    n = F.size("regions")
    from_0, from_1 = F.sequence(F.lit(0), n - 1), F.sequence(F.lit(1), n)
    ok = F.when(n == 0, True).otherwise((o == from_0) | (o == from_1))
    return load(spark, root, "layout_bank").select("layout_id", ok.alias("permutation"))


@query("select image_path, min(line_id) as first_line from line_gt group by image_path")
def g8_ordered_unique(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "line_gt").groupBy("image_path").agg(F.min("line_id").alias("first_line"))


@query("select event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as seen, lag(value) over (partition by user_id order by ts, event_id) as before from events")
def e12_running_by_user(spark: SparkSession, root: str) -> DataFrame:
    """Running counts and previous values of a user's events: groups bounded by a user's history."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, root, "events").select("event_id", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"), F.lag("value").over(w).alias("before"))
