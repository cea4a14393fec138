"""J: rank statistics, panels, regressions and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import arrays, special, text
from lipika.operators import stats
from lipika.plans.registry import query
from lipika.plans.samples import SHARE_DRAWS, draws_sql
from lipika.plans.views import CALLS, PANEL, READINGS, calls, clusters_sql, distance_sql, panel, readings, tier1_sql
from lipika.session import load, written

_OK = "case when sarvam_text = ground_truth then 1 else 0 end"


def _calls(spark: SparkSession, root: str) -> DataFrame:
    ok = F.coalesce(F.col("sarvam_text") == F.col("ground_truth"), F.lit(False))
    return calls(spark, root).where("condition = 'real'").select("probe_id", "script", "confidence", F.char_length("ground_truth").alias("len"), ok.alias("ok"))


_RANKS = f"""{CALLS}, d as (select script, confidence as x, length(ground_truth) as y, {_OK} as ok from calls where condition = 'real'), s as (select * from d where x is not null and y is not null),
  r as (select script, rank() over (partition by script order by x) + (count(*) over (partition by script, x) - 1) / 2.0 as rx, rank() over (partition by script order by y) + (count(*) over (partition by script, y) - 1) / 2.0 as ry, ok from s)"""


@query(f"with {_RANKS} select script, count(*) as n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) as rho from r group by script")
def j1_spearman(spark: SparkSession, root: str) -> DataFrame:
    return stats.spearman(_calls(spark, root), ["script"], "confidence", "len").select("script", "n", F.round("rho", 6).alias("rho"))


@query(f"""with {CALLS}, d as (select script, confidence as x, {_OK} as ok from calls where condition = 'real' and confidence is not null), r as (select script, ok, rank() over (partition by script order by x) + (count(*) over (partition by script, x) - 1) / 2.0 as rx from d)
  select script, sum(ok)::bigint as n_pos, (count(*) - sum(ok))::bigint as n_neg, round((sum(rx * ok) - sum(ok) * (sum(ok) + 1) / 2.0) / nullif(sum(ok) * (count(*) - sum(ok)), 0), 6) as auroc from r group by script""")
def j3_auroc(spark: SparkSession, root: str) -> DataFrame:
    """How well the confidence tells right from wrong, by rank sums."""
    return stats.auroc(_calls(spark, root), ["script"], "confidence", "ok").select("script", "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


_J5 = f"""{CALLS}, texts as materialized (select gt, hyp, row_number() over () as k from (select distinct coalesce(ground_truth, '') as gt, coalesce(sarvam_text, '') as hyp from calls where condition = 'real' and confidence is not null)),
  pairs as materialized (select k, {clusters_sql('gt')} as a, {clusters_sql('hyp')} as b from (select k, {tier1_sql('gt')} as gt, {tier1_sql('hyp')} as hyp from texts)), {distance_sql('pairs')},
  e as (select script, confidence as x, {_OK} as ok, case when len(a) > 0 then dist / len(a) else (len(b) > 0)::int end as cer from calls c join texts t on coalesce(c.ground_truth, '') = t.gt and coalesce(c.sarvam_text, '') = t.hyp join pairs using (k) join dist using (k) where condition = 'real' and confidence is not null),
  d as (select script, x, ok, (cer < (select median(cer) from e))::int as low from e union all select 'pooled', x, ok, (cer < (select median(cer) from e))::int from e),
  r as (select *, rank() over (partition by script order by x) + (count(*) over (partition by script, x) - 1) / 2.0 as rx from d)"""
_AREA = "round((sum(rx * {f}) - sum({f}) * (sum({f}) + 1) / 2.0) / nullif(sum({f}) * (count(*) - sum({f})), 0), 6)"


@query(f"""with recursive {_J5} select script, count(*) as n, round(avg(x), 6) as mean_conf, round(avg(ok), 6) as accuracy, round(avg(x) - avg(ok), 6) as gap, sum(low)::bigint as below_median, {_AREA.format(f='ok')} as auroc, {_AREA.format(f='low')} as auroc_low from r group by script""")
def j5_calibration_block(spark: SparkSession, root: str) -> DataFrame:
    """Calibration by script and pooled, with the AUROC of the confidence for right texts and for error rates below the pooled median."""
    c = calls(spark, root).where("condition = 'real' and confidence is not null")
    m = text.measured(text.tier1(F.coalesce("ground_truth", F.lit(""))), text.tier1(F.coalesce("sarvam_text", F.lit(""))))
    e = written(c.select("script", "confidence", F.coalesce(F.col("sarvam_text") == F.col("ground_truth"), F.lit(False)).alias("ok"), m.alias("m")).withColumn("cer", text.error_rate(F.col("m.dist"), F.col("m.n_gt"), F.col("m.n_hyp"), "one")), "rates")
    med = stats.quantiles(e, [], "cer", [0.5])
    d = e.crossJoin(F.broadcast(med)).withColumn("low", F.col("cer") < F.col("q0"))
    d = d.select("script", "confidence", "ok", "low").unionByName(d.select(F.lit("pooled").alias("script"), "confidence", "ok", "low"))
    acc = F.avg(F.col("ok").cast("int"))
    a = d.groupBy("script").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_conf"), F.round(acc, 6).alias("accuracy"), F.round(F.avg("confidence") - acc, 6).alias("gap"), F.count_if("low").alias("below_median"))
    area = lambda f, name: stats.auroc(d, ["script"], "confidence", f).select("script", F.round("auroc", 6).alias(name))
    return a.join(area("ok", "auroc"), "script").join(area("low", "auroc_low"), "script")


_ANOVA = """g as (select avg(value) as m, count(*) as n, sum(value * value) as ss, count(distinct unit) as u, count(distinct rep) as r from panel),
  su as (select sum(a * a) as su from (select avg(value) as a from panel group by unit)), sr as (select sum(b * b) as sr from (select avg(value) as b from panel group by rep)),
  s as (select u, r, r * (su - u * m * m) as ssu, u * (sr - r * m * m) as ssr, ss - n * m * m - r * (su - u * m * m) - u * (sr - r * m * m) as sse from g, su, sr),
  k as (select u, r, ssu / (u - 1) as msu, ssr / (r - 1) as msr, sse / ((u - 1) * (r - 1)) as mse from s),
  c as (select greatest(0, (msu - mse) / r) as vu, greatest(0, (msr - mse) / u) as vr, greatest(0, mse) as ve from k)"""


@query(f"with {PANEL}, {_ANOVA} select round(100 * vu / (vu + vr + ve), 4) as unit_share, round(100 * vr / (vu + vr + ve), 4) as rep_share, round(100 * ve / (vu + vr + ve), 4) as residual_share from c")
def j6_variance_shares(spark: SparkSession, root: str) -> DataFrame:
    d = stats.variance_shares(panel(spark, root), "unit", "rep", "value")
    return d.select(*[F.round(c, 4).alias(c) for c in ("unit_share", "rep_share", "residual_share")])


_J7 = f"""{PANEL}, un as (select unit, avg(value) as a, avg(value) * avg(value) as aa, sum(value * value) as q, max(value) filter (where rep = 'click') as v0, max(value) filter (where rep = 'error') as v1, max(value) filter (where rep = 'purchase') as v2, max(value) filter (where rep = 'signup') as v3, max(value) filter (where rep = 'view') as v4 from panel group by unit),
  {draws_sql('un', '', 'unit', ['a', 'aa', 'q', 'v0', 'v1', 'v2', 'v3', 'v4'], SHARE_DRAWS, 'u')}, r as (select count(distinct rep)::double as r from panel),
  g as (select w as u, r, r * (aa - w * pow(a / w, 2)) as ssu, w * ((v0 * v0 + v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4) / (w * w) - r * pow(a / w, 2)) as ssr, q - w * r * pow(a / w, 2) as ss from sums, r),
  k as (select u, r, ssu / (u - 1) as msu, ssr / (r - 1) as msr, (ss - ssu - ssr) / ((u - 1) * (r - 1)) as mse from g), c as (select greatest(0, (msu - mse) / r) as vu, greatest(0, (msr - mse) / u) as vr, greatest(0, mse) as ve from k)"""


@query(f"with {_J7} select round(quantile_cont(100 * vu / (vu + vr + ve), 0.025), 4) as lo, round(quantile_cont(100 * vu / (vu + vr + ve), 0.975), 4) as hi, round(avg(100 * ve / (vu + vr + ve)), 4) as residual from c")
def j7_share_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Interval of the units' variance share: units resampled with all their repetitions."""
    d = stats.resampled_shares(panel(spark, root), "unit", "rep", "value", SHARE_DRAWS)
    return d.agg(F.round(F.percentile("unit_share", 0.025), 4).alias("lo"), F.round(F.percentile("unit_share", 0.975), 4).alias("hi"), F.round(F.avg("residual_share"), 4).alias("residual"))


_DIFF = f"""{READINGS}, p as (select engine, language, image_id, avg(length(hyp)) as v from readings where variant = 'plain' group by all), q as (select engine, language, image_id, avg(length(hyp)) as v from readings where variant = 'degraded' group by all),
  diffs as (select engine, language, image_id, round(p.v - q.v, 9) as diff from p join q using (engine, language, image_id))"""


def _diffs(spark: SparkSession, root: str) -> DataFrame:
    by = ["engine", "language", "image_id"]
    r = readings(spark, root)
    side = lambda v: r.where(F.col("variant") == v).groupBy(*by).agg(F.avg(F.char_length("hyp")).alias(v))
    return side("plain").join(side("degraded"), by).select(*by, F.round(F.col("plain") - F.col("degraded"), 9).alias("diff"))


@query(f"""with {_DIFF}, nz as (select engine, diff, abs(diff) as a from diffs where diff <> 0), r as (select engine, diff, a, rank() over (partition by engine order by a) + (count(*) over (partition by engine, a) - 1) / 2.0 as rk from nz),
  w as (select engine, count(*) as n, sum(case when diff > 0 then rk else 0.0 end) as w_plus, sum(case when diff < 0 then rk else 0.0 end) as w_minus from r group by engine), t as (select engine, sum(k * k * k - k) as ties from (select engine, a, count(*) as k from nz group by all) group by engine),
  z as (select engine, avg(diff) / nullif(stddev_samp(diff), 0) as d_z from diffs group by engine)
  select engine, n, w_plus, w_minus, round((w_plus - w_minus) / nullif(w_plus + w_minus, 0), 6) as r, round((w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48.0), 0), 6) as z, round(d_z, 6) as d_z from w join t using (engine) join z using (engine)""")
def j8_signed_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Paired differences of plain and degraded readings: Wilcoxon, rank-biserial r and d_z."""
    d = stats.signed_ranks(_diffs(spark, root), ["engine"], "diff")
    return d.select("engine", "n", "w_plus", "w_minus", F.round("r", 6).alias("r"), F.round("z", 6).alias("z"), F.round("d_z", 6).alias("d_z"))


_TEST = f"""{_DIFF}, nz as (select engine, diff, abs(diff) as a from diffs where diff <> 0), rk as (select engine, diff, a, rank() over (partition by engine order by a) + (count(*) over (partition by engine, a) - 1) / 2.0 as rk from nz),
  ti as (select engine, sum(k * k * k - k) as ties from (select engine, a, count(*) as k from nz group by all) group by engine), wi as (select engine, (sum(case when diff > 0 then rk else 0.0 end) - count(*) * (count(*) + 1) / 4.0) / nullif(sqrt(count(*) * (count(*) + 1) * (2.0 * count(*) + 1) / 24 - ties / 48.0), 0) as z from rk join ti using (engine) group by engine, ties),
  me as (select engine, language, avg(diff) as m from diffs group by all), te as (select engine, avg(m) / nullif(stddev_samp(m) / sqrt(count(*)), 0) as t, count(*) - 1 as df from me group by engine)"""
#: Tails by the midpoint rule: of the normal density, and of Student's as an angle.
_NORMAL_TAIL = "list_sum(list_transform(range(0, 20000), lambda i: exp(-pow(abs({z}) + (i + 0.5) * 0.0006, 2) / 2))) * 0.0006 * 2 / sqrt(2 * pi())"
_T_TAIL = "exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) * 2 / sqrt(pi()) * (pi() / 2 - atan(abs({t}) / sqrt({df}))) / 20000 * list_sum(list_transform(range(0, 20000), lambda i: pow(cos(atan(abs({t}) / sqrt({df})) + (i + 0.5) * (pi() / 2 - atan(abs({t}) / sqrt({df}))) / 20000), {df} - 1)))"


@query(f"with {_TEST} select engine, round({_NORMAL_TAIL.format(z='z')}, 5) as p_signed_rank, round({_T_TAIL.format(t='t', df='df')}, 5) as p_cluster_t from te left join wi using (engine) where t is not null and df > 0")
def j8_p_values(spark: SparkSession, root: str) -> DataFrame:
    """Two-sided p-values of the tests, a row an engine."""
    d = written(_diffs(spark, root), "diffs")
    t = stats.cluster_t(d, ["engine"], "language", "diff").where("t is not null and df > 0")
    both = t.join(stats.signed_ranks(d, ["engine"], "diff").select("engine", "z"), "engine", "left")
    return both.select("engine", F.round(special.normal_p(F.col("z")), 5).alias("p_signed_rank"), F.round(special.t_p(F.col("t"), F.col("df")), 5).alias("p_cluster_t"))


@query(f"with {_DIFF}, m as (select engine, language, avg(diff) as m from diffs group by all) select engine, count(*) as clusters, round(avg(m), 6) as mean, round(avg(m) / nullif(stddev_samp(m) / sqrt(count(*)), 0), 6) as t, count(*) - 1 as df from m group by engine")
def j9_cluster_t(spark: SparkSession, root: str) -> DataFrame:
    d = stats.cluster_t(_diffs(spark, root), ["engine"], "language", "diff")
    return d.select("engine", "clusters", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"), "df")


_J10 = f"""{READINGS}, f as (select language, count(*) as n, regr_slope(length(hyp), length(gt)) as slope, regr_intercept(length(hyp), length(gt)) as intercept, corr(length(hyp), length(gt)) as r from readings group by language),
  j10 as (select *, r * sqrt(n - 2) / nullif(sqrt(1 - r * r), 0) as t from f)"""


@query(f"with {_J10} select language, n, round(slope, 6) as slope, round(intercept, 5) as intercept, round(r, 6) as r, round(r * r, 6) as r2, round(t, 4) as t, round({_T_TAIL.format(t='t', df='(n - 2)')}, 6) as p from j10")
def j10_least_squares(spark: SparkSession, root: str) -> DataFrame:
    """Reading length on true length: line, r, R2, and the slope's t and p."""
    d = stats.least_squares(readings(spark, root), ["language"], F.char_length("hyp"), F.char_length("gt"))
    return d.select("language", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r", 6).alias("r"), F.round("r2", 6).alias("r2"), F.round("t", 4).alias("t"), F.round(special.t_p(F.col("t"), F.col("n") - 2), 6).alias("p"))


_BAND = "case when length(gt) <= 19 then 'short' when length(gt) <= 35 then 'middle' else 'long' end"


@query(f"""with {READINGS}, d as (select {_BAND} as band, length(hyp) as v, (bucket = 'GENUINE')::int as g from readings), r as (select band, g, rank() over (partition by band order by v) + (count(*) over (partition by band, v) - 1) / 2.0 as rk from d),
  t as (select band, sum(k * k * k - k) as t from (select band, v, count(*) as k from d group by all) group by band), u as (select band, sum(g)::bigint as n_a, (count(*) - sum(g))::bigint as n_b, sum(rk * g) - sum(g) * (sum(g) + 1) / 2.0 as u, count(*)::double as n from r group by band)
  select band, n_a, n_b, u, round((u - n_a * n_b / 2.0) / nullif(sqrt(n_a * n_b / 12.0 * (n + 1 - t / (n * (n - 1)))), 0), 6) as z from u join t using (band)""")
def j11_rank_sum_by_length(spark: SparkSession, root: str) -> DataFrame:
    """Mann-Whitney of reading lengths, genuine errors against others, within bands of length."""
    n = F.char_length("gt")
    band = F.when(n <= 19, "short").when(n <= 35, "middle").otherwise("long")
    d = readings(spark, root).select(band.alias("band"), F.char_length("hyp").alias("v"), (F.col("bucket") == "GENUINE").alias("g"))
    return stats.rank_sum(d, ["band"], "v", "g").select("band", "n_a", "n_b", F.col("u").cast("double").alias("u"), F.round("z", 6).alias("z"))


@query("""with c as (select l_partkey as part, l_returnflag as cond, avg(l_discount) as y, ln(count(*) + 1) as x, count(*)::double as w from lineitem group by all), m as (select part, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my, count(*) as k from c group by part having count(*) >= 2)
  , d as (select *, x - mx as dx, y - my as dy from c join m using (part)), b as (select sum(w * dx * dy) / sum(w * dx * dx) as b from d)
  select count(*) as rows, count(distinct part) as groups, round(any_value(b), 9) as beta, round(1 - sum(pow(dy - b * dx, 2)) / (var_pop(y) * count(*)), 6) as r2 from d, b""")
def j12_fixed_effects(spark: SparkSession, root: str) -> DataFrame:
    """Slope of mean discount on log exposure within parts, weighted by exposure."""
    n = F.count(F.lit(1))
    c = load(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("cond")).agg(F.avg("l_discount").alias("y"), F.ln(n + 1).alias("x"), n.cast("double").alias("w"))
    return stats.fixed_effects(c, "part", "y", "x", "w").select("rows", "groups", F.round("beta", 9).alias("beta"), F.round("r2", 6).alias("r2"))


@query(f"""with {READINGS}, d as (select engine, length(hyp) / greatest(length(gt), 1) as v, variant = 'plain' as f from readings where variant is not null), s as (select engine, avg(v) filter (where f) - avg(v) filter (where not f) as diff,
  sqrt(var_samp(v) filter (where f) / count(*) filter (where f) + var_samp(v) filter (where not f) / count(*) filter (where not f)) as se from d group by engine)
  select engine, round(diff, 6) as diff, round(se, 6) as se, round(diff / nullif(se, 0), 5) as z, diff - 1.6448536269514722 * se > -0.05 and diff + 1.6448536269514722 * se < 0.05 as equivalent from s""")
def j13_difference_and_equivalence(spark: SparkSession, root: str) -> DataFrame:
    """Two-sample z of length ratios, plain against degraded, and equivalence within 0.05."""
    d = readings(spark, root).where("variant is not null").select("engine", (F.char_length("hyp") / F.greatest(F.char_length("gt"), F.lit(1))).alias("v"), (F.col("variant") == "plain").alias("f"))
    s = stats.difference_z(d, ["engine"], "v", "f")
    return s.select("engine", F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), F.round("z", 5).alias("z"), "equivalent")


@query(f"""with {READINGS}, g as (select engine, avg(v) as m, var_samp(v) / count(*) as s from (select engine, length(hyp) / greatest(length(gt), 1) as v from readings) group by engine)
  select a.engine as a, b.engine as b, round(a.m - b.m, 6) as diff, round(sqrt(a.s + b.s), 6) as se, round((a.m - b.m) / nullif(sqrt(a.s + b.s), 0), 5) as z, abs((a.m - b.m) / nullif(sqrt(a.s + b.s), 0)) > 2.3939797998185104 as significant from g a join g b on a.engine < b.engine""")
def j13_bonferroni_contrasts(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of engines' mean length ratios, at 5 % over three contrasts."""
    d = readings(spark, root).select("engine", (F.char_length("hyp") / F.greatest(F.char_length("gt"), F.lit(1))).alias("v"))
    c = stats.contrasts(d, "engine", "v", 2.3939797998185104)
    return c.select("a", "b", F.round("diff", 6).alias("diff"), F.round("se", 6).alias("se"), F.round("z", 5).alias("z"), "significant")


@query("""with r as (select layout_id, r.reading_order as o, row_number() over (partition by layout_id order by r.y, r.x, r.name) as pos from (select layout_id, unnest(regions) as r from layout_bank)), p as (select a.layout_id, sum(case when b.o > a.o then 1 else -1 end) as s, count(*) as n from r a join r b on a.layout_id = b.layout_id and b.pos > a.pos group by 1)
  select l.layout_id, round(coalesce(s / n, 1.0), 9) as tau from (select layout_id from layout_bank where len(regions) > 0) l left join p using (layout_id)""")
def j15_kendall_tau(spark: SparkSession, root: str) -> DataFrame:
    """Agreement of geometric order with the given reading order, by page."""
    s = F.array_sort(F.transform("regions", lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["name"].alias("name"), r["reading_order"].alias("o"))))
    d = load(spark, root, "layout_bank").where(F.size("regions") > 0).select("layout_id", F.transform(s, lambda r: r["o"]).alias("o"))
    return d.select("layout_id", F.round(arrays.kendall(F.col("o")), 9).alias("tau"))


@query("""with r as (select layout_id, coalesce(category, 'unknown') as category, r.reading_order as o, row_number() over (partition by layout_id order by r.y, r.x, r.name) as pos from (select layout_id, category, unnest(regions) as r from layout_bank)),
  p as (select a.layout_id, sum(case when b.o > a.o then 1 else -1 end) / count(*) as tau from r a join r b on a.layout_id = b.layout_id and b.pos > a.pos group by 1), t as (select coalesce(l.category, 'unknown') as category, coalesce(p.tau, 1.0) as tau from (select * from layout_bank where len(regions) > 0) l left join p using (layout_id)),
  c as (select unnest(['single-column', 'two-column', 'table-embedded', 'form', 'marginalia', 'unknown']) as category) select c.category, count(tau) as n, round(avg(tau), 6) as mean_tau from c left join t using (category) group by c.category""")
def d34_tau_by_category(spark: SparkSession, root: str) -> DataFrame:
    """Mean tau of each category of the dimension; categories without pages stay, with a null mean."""
    c = spark.createDataFrame([(x,) for x in ("single-column", "two-column", "table-embedded", "form", "marginalia", "unknown")], "category string")
    s = F.array_sort(F.transform("regions", lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["name"].alias("name"), r["reading_order"].alias("o"))))
    d = load(spark, root, "layout_bank").where(F.size("regions") > 0).select(F.coalesce("category", F.lit("unknown")).alias("category"), arrays.kendall(F.transform(s, lambda r: r["o"])).alias("tau"))
    return F.broadcast(c).join(d, "category", "left").groupBy("category").agg(F.count("tau").alias("n"), F.round(F.avg("tau"), 6).alias("mean_tau"))


@query(f"with {CALLS}, d as (select script, 1 - {_OK} as cost from calls where condition = 'real') select script, k, round((1 - k / 10.0) * avg(cost), 9) as expected from d cross join (select unnest(range(0, 11)) as k) group by script, k")
def j16_random_router(spark: SparkSession, root: str) -> DataFrame:
    """Expected residual when a tenth, two tenths ... of the rows are passed on at random: closed form."""
    d = _calls(spark, root).groupBy("script").agg(F.avg(1 - F.col("ok").cast("int")).alias("m"))
    return d.select("script", "m", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")).select("script", F.col("k").cast("long").alias("k"), F.round((1 - F.col("k") / 10.0) * F.col("m"), 9).alias("expected"))
