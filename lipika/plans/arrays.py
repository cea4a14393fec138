"""I, L: distributions and nested data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import arrays, text
from lipika.operators.joins import ngrams
from lipika.plans.registry import query
from lipika.plans.views import CALLS, STEPS, calls, clusters_sql, steps
from lipika.session import load

_F = "list_transform({v}, lambda x: greatest(x, {f}))"
_FL = f"fl as (select *, {_F.format(v='p', f='1e-8')} as pf, {_F.format(v='q', f='1e-8')} as qf, {_F.format(v='p', f='1e-12')} as pe from steps)"
_KL = "list_sum(list_transform(range(1, 33), lambda i: {a}[i] / list_sum({a}) * ln(({a}[i] / list_sum({a})) / ({b}[i] / list_sum({b})))))"


@query(f"with {STEPS}, {_FL} select vec_id, round({_KL.format(a='pf', b='qf')}, 6) as kl from fl")
def i1_kl_divergence(spark: SparkSession, root: str) -> DataFrame:
    return steps(spark, root).select("vec_id", F.round(arrays.kl(F.col("p"), F.col("q")), 6).alias("kl"))


@query(f"with {STEPS} select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: least(p[i], q[i]))), 9) as sufficiency from steps")
def i2_prior_sufficiency(spark: SparkSession, root: str) -> DataFrame:
    return steps(spark, root).select("vec_id", F.round(arrays.overlap(F.col("p"), F.col("q")), 9).alias("sufficiency"))


@query(f"with {STEPS}, {_FL} select vec_id, round({_KL.format(a='pf', b='qf')}, 6) as forward, round({_KL.format(a='qf', b='pf')}, 6) as backward, list_position(p, list_max(p)) = list_position(q, list_max(q)) as agree, round(list_max(p), 9) as max_p, round(list_max(q), 9) as max_q from fl")
def i3_step_comparison(spark: SparkSession, root: str) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    return steps(spark, root).select("vec_id", F.round(arrays.kl(p, q), 6).alias("forward"), F.round(arrays.kl(q, p), 6).alias("backward"), (arrays.argmax(p) == arrays.argmax(q)).alias("agree"), F.round(F.array_max(p), 9).alias("max_p"), F.round(F.array_max(q), 9).alias("max_q"))


@query(f"with {STEPS}, {_FL} select vec_id, round(-list_sum(list_transform(pe, lambda x: x / list_sum(pe) * ln(x / list_sum(pe)))), 6) as entropy from fl")
def i4_entropy(spark: SparkSession, root: str) -> DataFrame:
    return steps(spark, root).select("vec_id", F.round(arrays.entropy(F.col("p")), 6).alias("entropy"))


@query(f"with {STEPS} select vec_id, round(ln(greatest(p[label + 1], 1e-12)), 6) as log_p, round(list_sum(list_transform(p, lambda x: ln(greatest(x, 1e-12)))), 5) as total from steps")
def i5_log_floor(spark: SparkSession, root: str) -> DataFrame:
    total = arrays.total(F.transform("p", lambda x: arrays.log_floor(x)))
    return steps(spark, root).select("vec_id", F.round(arrays.log_floor(F.get("p", F.col("label"))), 6).alias("log_p"), F.round(total, 5).alias("total"))


@query(f"""with tr as (select {clusters_sql('text')} as t from line_gt where text is not null and text <> ''), ev as (select case when i = 1 then '<BOS>' else t[i - 1] end as ctx, case when i = len(t) + 1 then '<EOS>' else t[i] end as tok from (select t, unnest(range(1, len(t) + 2)) as i from tr)),
  pc as (select ctx, tok, count(*) as c from ev group by all), v as (select count(distinct tok) as v from pc), cc as (select ctx, sum(c) as cc, count(*) as k, max(c) as top from pc group by ctx)
  select ctx, cc::bigint as n, round((top + 0.01) / (cc + 0.01 * v), 9) as top_p, round(0.01 * (v - k) / (cc + 0.01 * v), 9) as unseen from cc cross join v""")
def i8_next_distribution(spark: SparkSession, root: str) -> DataFrame:
    """Add-alpha next-token distribution of each context: its largest mass, and the mass of unseen tokens."""
    e = load(spark, root, "line_gt").where("text <> ''").select(F.explode(ngrams(text.graphemes(F.col("text")), 2)).alias("e"))
    pc = e.groupBy("e.ctx", "e.tok").agg(F.count(F.lit(1)).alias("c"))
    v = pc.agg(F.count_distinct("tok").alias("v"))
    cc = pc.groupBy("ctx").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.max("c").alias("top")).crossJoin(F.broadcast(v))
    mass = F.col("n") + 0.01 * F.col("v")
    return cc.select("ctx", "n", F.round((F.col("top") + 0.01) / mass, 9).alias("top_p"), F.round(0.01 * (F.col("v") - F.col("k")) / mass, 9).alias("unseen"))


@query("""with r as (select layout_id, r.* from (select layout_id, unnest(regions) as r from layout_bank)) select layout_id, name, round(least(greatest(x, 0.0), 1.0), 6) as x0, round(least(greatest(x + width, 0.0), 1.0), 6) as x1 from r""")
def i10_box_clamp(spark: SparkSession, root: str) -> DataFrame:
    clamp = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)
    return load(spark, root, "layout_bank").select("layout_id", F.inline("regions")).select("layout_id", "name", clamp(F.col("x")).alias("x0"), clamp(F.col("x") + F.col("width")).alias("x1"))


_PROFILE = """bins as (select layout_id, r, unnest(range(0, 50)) as i from (select layout_id, unnest(regions) as r from layout_bank)),
  profile as (select layout_id, i, sum(greatest(0.0, least(r.y + r.height, (i + 1) / 50.0) - greatest(r.y, i / 50.0)) * r.width) as v from bins group by all), island as (select *, i - row_number() over (partition by layout_id order by i) as g from profile where v > 1e-9),
  band as (select layout_id, g, min(i) as lo, max(i) + 1 as hi, sum(v) as mass from island group by all), total as (select layout_id, sum(mass) as t from band group by layout_id)"""


@query(f"""with {_PROFILE} select l.layout_id, count(lo) as bands, coalesce(sum(hi - lo), 0)::bigint as width from layout_bank l left join (select * from band join total using (layout_id) where hi - lo >= 3 and mass >= 0.1 * t) b using (layout_id) group by 1""")
def i11_projection_bands(spark: SparkSession, root: str) -> DataFrame:
    """Bands of each page's projection profile that are wide and heavy enough: its regions' ink by fiftieths of the height."""
    part = lambda r, i: F.greatest(F.lit(0.0), F.least(r["y"] + r["height"], (i + 1) / 50.0) - F.greatest(r["y"], i / 50.0)) * r["width"]
    profile = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.aggregate("regions", F.lit(0.0), lambda s, r: s + part(r, i)))
    bands = arrays.projection_bands(profile, 3, 0.1)
    return load(spark, root, "layout_bank").select("layout_id", bands.alias("b")).select("layout_id", F.size("b").cast("long").alias("bands"), F.aggregate("b", F.lit(0), lambda s, x: s + x["hi"] - x["lo"]).cast("long").alias("width"))


@query(f"with {STEPS} select vec_id, len(list_filter(range(1, 1 + least(len(p), label + 3)), lambda i: p[i] > q[i])) as above from steps")
def l3_zip_shortest(spark: SparkSession, root: str) -> DataFrame:
    """Positions in which the first of two arrays of different length is larger; the shorter one ends the count."""
    z = arrays.zip_shortest(F.col("p"), F.slice("q", F.lit(1), F.col("label") + 3))
    return steps(spark, root).select("vec_id", F.size(F.filter(z, lambda x: x["a"] > x["b"])).cast("long").alias("above"))


@query(f"with {CALLS} select probe_id, coalesce(usage.pages_total, 0) as total, coalesce(usage.pages_failed, 0) as failed, coalesce(confidence, 0.0) as confidence from calls")
def l5_nested_defaults(spark: SparkSession, root: str) -> DataFrame:
    return calls(spark, root).select("probe_id", F.coalesce("usage.pages_total", F.lit(0)).alias("total"), F.coalesce("usage.pages_failed", F.lit(0)).alias("failed"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("select event_type, count(*) as n, round(avg(try_cast(json_extract_string(props, '$.k') as double)), 6) as mean_k from events group by event_type")
def l8_json_fields(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return load(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(k), 6).alias("mean_k"))


@query("select line_id, round(list_avg(bbox), 6) as mean_or_null, coalesce(round(list_avg(bbox), 6), 0.0) as mean_or_zero from line_gt")
def l9_empty_safe_means(spark: SparkSession, root: str) -> DataFrame:
    b = F.col("bbox").cast("array<double>")
    return load(spark, root, "line_gt").select("line_id", F.round(arrays.mean_of(b), 6).alias("mean_or_null"), F.coalesce(F.round(arrays.mean_of(b, 0.0), 6), F.lit(0.0)).alias("mean_or_zero"))


@query("select line_id, bbox[1] as x0, bbox[3] - bbox[1] as width, len(bbox) as k from line_gt")
def l1_elements(spark: SparkSession, root: str) -> DataFrame:
    b = lambda i: F.get("bbox", F.lit(i))
    return load(spark, root, "line_gt").select("line_id", b(0).alias("x0"), (b(2) - b(0)).alias("width"), F.nullif(F.size("bbox"), F.lit(-1)).alias("k"))


@query("""with l as (select regexp_extract(replace(image_path, '\\', '/'), 'line_crops/(.*)_r[0-9]+[.]png$', 1) as page, region, bbox, reading_order, line_id from line_gt where region is not null)
  select page, region, arg_min(bbox[1], struct_pack(a := reading_order, b := line_id)) as x0, count(*) as lines from l group by page, region""")
def l7_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of a page: its regions, each with the box of its first line."""
    page = F.regexp_extract(F.replace("image_path", F.lit("\\"), F.lit("/")), r"line_crops/(.*)_r[0-9]+\.png$", 1)
    d = load(spark, root, "line_gt").where("region is not null").withColumn("page", page)
    return d.groupBy("page", "region").agg(F.min_by(F.get("bbox", F.lit(0)), F.struct("reading_order", "line_id")).alias("x0"), F.count(F.lit(1)).alias("lines"))
