"""K: seeded samples, quotas and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import text
from lipika.functions.labels import label
from lipika.operators import sampling
from lipika.operators.joins import ngrams
from lipika.plans.registry import query
from lipika.plans.views import CALLS, PANEL, READINGS, calls, glyphs_sql, panel, readings
from lipika.session import load, written

_H = "('0x' || substr(md5({k}), 1, 8))::bigint"


@query(f"with {READINGS}, r as (select engine, row_no, row_number() over (partition by engine order by md5('0|' || row_no::varchar), row_no) as rn from readings) select engine, row_no from r where rn <= 60")
def k1_hash_sample(spark: SparkSession, root: str) -> DataFrame:
    """Sixty readings of each engine by seeded hash order."""
    return sampling.hash_sample(readings(spark, root).select("engine", "row_no"), ["engine"], F.col("row_no"), 60)


_K2 = f"""{READINGS}, d as (select row_no, concat_ws('/', engine, language) as stratum from readings where bucket <> 'TIER1'), s as (select stratum, count(*) as size, 200 * count(*) / sum(count(*)) over () as exact, sum(count(*)) over () as total from d group by stratum),
  o as (select *, least(size, greatest(1, floor(exact)))::bigint as base from s), lv as (select max(l) as level from (select l, sum(least(base, l)) as taken from o cross join range(0, 201) r(l) group by l) where taken <= 200),
  t as (select *, 200 - sum(base) over () as spare, 200 - sum(least(base, level)) over () as rest, row_number() over (order by base > level desc, exact, stratum desc) as place, sum(size - base) over (order by floor(exact) - exact, -exact, stratum) as ends from o, lv),
  q as (select stratum, case when total <= 200 then size when spare < 0 then greatest(1, least(base, level) + (base > level and place <= rest)::int) else base + greatest(0, least(size - base, spare - ends + size - base)) end as seats from t)"""


@query(f"""with {_K2} select row_no, stratum, true as adjudication_sample, 42 as sample_seed from (select row_no, stratum, seats, row_number() over (partition by stratum order by md5('42|' || row_no), row_no) as rn from d join q using (stratum)) where rn <= seats""")
def k2_stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    """Two hundred readings by stratum (engine and language): seats and draws."""
    d = readings(spark, root).where("bucket <> 'TIER1'").select("row_no", F.concat_ws("/", "engine", "language").alias("stratum"))
    s = sampling.stratified_sample(d, "stratum", F.col("row_no"), 200, seed=42)
    return s.withColumns({"adjudication_sample": F.lit(True), "sample_seed": F.lit(42)})


_FREQ = f"freq as (select ch, count(*) as n from (select unnest({glyphs_sql('text')}) as ch from line_gt where text is not null) group by ch)"


def _freq(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "line_gt").where("text is not null").select(F.explode(text.glyph_clusters(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_FREQ}, e as (select ch, round(5000 * n / (select sum(n) from freq), 9) as e from freq), f as (select ch, e, floor(e) as f, row_number() over (order by round(e - floor(e), 9) desc, ch desc) as rn from e)
  select ch, (f + case when rn <= 5000 - (select sum(f) from f) then 1 else 0 end)::bigint as quota from f""")
def k3_largest_remainder(spark: SparkSession, root: str) -> DataFrame:
    """Five thousand glyphs in proportion to the corpus, whole counts that sum exactly."""
    return sampling.largest_remainder(_freq(spark, root), "ch", "n", 5000)


@query(f"with {_FREQ} select ch, round(n / (select sum(n) from freq), 9) as natural, round(1.0 / (select count(*) from freq), 9) as flattened from freq")
def k4_target_masses(spark: SparkSession, root: str) -> DataFrame:
    f = _freq(spark, root)
    t = f.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return f.crossJoin(F.broadcast(t)).select("ch", F.round(F.col("n") / F.col("t"), 9).alias("natural"), F.round(1.0 / F.col("k"), 9).alias("flattened"))


_K5 = f"""g as (select nullif(lower(regexp_replace(script, '^\\s+|\\s+$', '', 'g')), '') as script, {glyphs_sql('text')} as t from page_gt where text is not null), c as (select script, glyph, count(*) as n from (select script, unnest(t) as glyph from g) where script is not null group by all),
  m as (select script, glyph, n / sum(n) over (partition by script) as mass, count(*) over (partition by script) as k, row_number() over (partition by script order by n, glyph) as up, row_number() over (partition by script order by n desc, glyph desc) as down from c),
  masses as (select script, 'natural' as mode, glyph, mass from m union all select script, 'flattened', glyph, 1.0 / k from m union all select a.script, 'inverted', a.glyph, b.mass from m a join m b on a.script = b.script and a.up = b.down),
  e as (select *, round(5000 * mass / sum(mass) over (partition by script, mode), 9) as e from masses), f as (select *, row_number() over (partition by script, mode order by round(e - floor(e), 9) desc, glyph desc) as rn, 5000 - sum(floor(e)) over (partition by script, mode) as more from e),
  quotas as (select script, mode, glyph, mass, (floor(e) + (rn <= more)::int)::bigint as n from f)"""


def _synthesis(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(script, mode, glyph, n) of synthesised lines, and the masses that they go for: five thousand glyphs a script and mode."""
    t = load(spark, root, "page_gt").where("text is not null").select(label("script").alias("script"), text.glyph_clusters(F.col("text")).alias("t")).where("script is not null")
    t = written(t, "glyphs")
    b = t.select("script", F.explode(ngrams(F.col("t"), 2)).alias("e")).select("script", F.col("e.ctx").alias("a"), F.col("e.tok").alias("b")).where("a <> '<BOS>' and b <> '<EOS>'").groupBy("script", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    masses = written(sampling.target_masses(t.select("script", F.explode("t").alias("glyph")).groupBy("script", "glyph").agg(F.count(F.lit(1)).alias("n")), "script", "glyph", "n"), "targets")
    of_mode = lambda d: d.withColumn("script", F.concat_ws("|", "script", "mode")).drop("mode")
    quotas = sampling.largest_remainder(masses, "glyph", "mass", 5000, ["script", "mode"])
    modes = F.explode(F.array(*[F.lit(m) for m in ("natural", "flattened", "inverted")]))
    sizes = t.select("script", F.size("t").alias("length")).groupBy("script", "length").agg(F.count(F.lit(1)).alias("n"))
    lines = sampling.corpus_walk(of_mode(b.withColumn("mode", modes)), of_mode(quotas), of_mode(sizes.withColumn("mode", modes)))
    key = F.split("script", r"\|")
    made = lines.select(key[0].alias("script"), key[1].alias("mode"), F.explode("glyphs").alias("glyph")).groupBy("script", "mode", "glyph").agg(F.count(F.lit(1)).alias("n"))
    return made, masses


@query(f"with {_K5} select script, mode, glyph, n from quotas where n > 0")
def k5_corpus_walk(spark: SparkSession, root: str) -> DataFrame:
    """Glyphs of lines synthesised toward natural, flattened and inverted masses, one walk a script and mode."""
    return _synthesis(spark, root)[0]


@query(f"with {_K5} select script, mode, round(sum(abs(n / 5000.0 - mass)) / 2, 6) as tv, sum(abs(n / 5000.0 - mass)) / 2 <= 0.08 as matches from quotas group by script, mode")
def k5_tolerance_gate(spark: SparkSession, root: str) -> DataFrame:
    """How far the synthesised lines are from their target, and whether that is near enough."""
    made, masses = _synthesis(spark, root)
    return sampling.within_tolerance(made, masses, ["script", "mode"], "glyph", 0.08).select("script", "mode", F.round("tv", 6).alias("tv"), "matches")


#: Draws of the bootstraps and shuffles, and of the share bootstrap.
DRAWS, SHARE_DRAWS = 10_000, 2_000


def draws_sql(units: str, by: str, key: str, values: list[str], draws: int, seed: str, name: str = "sums") -> str:
    """CTE ``name`` (by, draw, w, values): sums over the units of each resample, each unit as often as it was drawn."""
    of = "".join(f"{by}, " if by else "")
    lot = f"(lot_a * h + lot_b) % {sampling.PRIME}"
    times = " + ".join(f"(u >= {t})::int" for t in sampling.POISSON.tolist())
    seven = lambda k: f"('0x' || substr(m, {k}, 7))::bigint"
    return f"""lots_{name} as materialized (select draw, {seven(1)} as lot_a, {seven(8)} as lot_b, {seven(15)} as lot_c from (select draw, md5('{seed}|' || draw) as m from range(0, {draws}) t(draw))),
  units_{name} as materialized (select {of}('0x' || substr(md5({key}::varchar), 1, 7))::bigint as h, {', '.join(f'{v}::double as {v}' for v in values)} from {units} where {' and '.join(f'{v} is not null' for v in values)}),
  {name} as (select {of}draw, sum(n)::double as w, {', '.join(f'sum(n * {v}) as {v}' for v in values)} from (select *, {times} as n from (select *, x * ((x + lot_c) % {sampling.PRIME}) % {sampling.PRIME} as u from (select *, {lot} as x from units_{name} cross join lots_{name}))) group by {of}draw)"""


_K6 = f"""{READINGS}, u as (select language, image_id, avg((bucket = 'GENUINE')::int) as v from readings where language is not null and image_id is not null group by all), {draws_sql('u', 'language', 'image_id', ['v'], DRAWS, 'b')}"""


@query(f"with {_K6} select language, round(quantile_cont(v / nullif(w, 0), 0.025), 6) as lo, round(quantile_cont(v / nullif(w, 0), 0.975), 6) as hi from sums group by language")
def k6_bootstrap_interval(spark: SparkSession, root: str) -> DataFrame:
    """Percentile intervals of error rates, images resampled within languages."""
    u = readings(spark, root).dropna(subset=["language", "image_id"]).groupBy("language", "image_id").agg(F.avg((F.col("bucket") == "GENUINE").cast("int")).alias("v"))
    i = sampling.interval(sampling.bootstrap_means(u, ["language"], F.col("image_id"), "v", DRAWS), ["language"])
    return i.select("language", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_K7 = f"""{PANEL}, wide as (select unit, max(value) filter (where rep = 'click') - max(value) filter (where rep = 'view') as d from panel group by unit), {draws_sql('wide', '', 'unit', ['d'], DRAWS, 'pair')}"""


@query(f"with {_K7} select round(quantile_cont(d / nullif(w, 0), 0.025), 6) as lo, round(quantile_cont(d / nullif(w, 0), 0.975), 6) as hi from sums")
def k7_paired_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Interval of a paired difference: pairs are resampled together."""
    w = panel(spark, root).groupBy("unit").pivot("rep", ["click", "view"]).agg(F.max("value")).select("unit", (F.col("click") - F.col("view")).alias("d"))
    m = sampling.bootstrap_means(w, [], F.col("unit"), "d", DRAWS, "pair")
    return sampling.interval(m, []).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_K8 = f"""{READINGS}, u as (select engine, concat_ws('|', language, image_id) as img, variant = 'plain' as f, avg(length(hyp) / greatest(length(gt), 1)) as v from readings where variant in ('plain', 'degraded') and language is not null and image_id is not null group by all),
  ua as (select * from u where f), ub as (select * from u where not f), {draws_sql('ua', 'engine', 'img', ['v'], DRAWS, 'two-a', 'sa')}, {draws_sql('ub', 'engine', 'img', ['v'], DRAWS, 'two-b', 'sb')},
  m as (select engine, sa.v / sa.w - sb.v / sb.w as d from sa join sb using (engine, draw)), p as (select engine, count(v) filter (where f) as n_a, count(v) filter (where not f) as n_b, avg(v) filter (where f) - avg(v) filter (where not f) as diff from u group by engine)"""


@query(f"""with {_K8} select engine, n_a, n_b, round(diff, 6) as diff, round(quantile_cont(d, 0.025), 6) as lo95, round(quantile_cont(d, 0.975), 6) as hi95, round(quantile_cont(d, 0.05), 6) as lo90, round(quantile_cont(d, 0.95), 6) as hi90,
  round(avg((d <= -0.05)::int), 4) as p_lower, round(avg((d >= 0.05)::int), 4) as p_upper from m join p using (engine) group by all""")
def k8_two_sample_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Difference of plain and degraded images' length ratios: both sides resampled apart."""
    r = readings(spark, root).where(F.col("variant").isin("plain", "degraded")).dropna(subset=["language", "image_id"])
    ratio = F.char_length("hyp") / F.greatest(F.char_length("gt"), F.lit(1))
    u = written(r.groupBy("engine", F.concat_ws("|", "language", "image_id").alias("img"), (F.col("variant") == "plain").alias("f")).agg(F.avg(ratio).alias("v")), "units")
    d = sampling.two_sample_bootstrap(u, ["engine"], F.col("img"), "v", "f", DRAWS, 0.05)
    return d.select("engine", "n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("diff", "lo95", "hi95", "lo90", "hi90")], *[F.round(c, 4).alias(c) for c in ("p_lower", "p_upper")])


_HIT = "case when label is not null then label = 'dropped-matra-nukta' end"


_K9 = f"""{READINGS}, d as (select engine, bucket = 'TIER1' as sure, bucket = 'UNREVIEWED' as unk, {_HIT} as hit from readings),
  r as (select engine, count(*) as n, (count(*) filter (where sure) + count(*) filter (where unk) * (count(*) filter (where hit) * 1.0 / nullif(count(hit), 0))) / count(*) as rate from d group by engine),
  terms as (select engine, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(rate) + (n - k) * ln(1 - rate)) as p from (select *, unnest(range(0, n + 1)) as k from r where rate > 0 and rate < 1)),
  upto as (select engine, n, k, sum(p) over (partition by engine order by k) as c from terms), ends as (select engine, min(k) filter (where c >= 0.025 - 1e-12) / n as lo, min(k) filter (where c >= 0.975 - 1e-12) / n as hi from upto group by engine, n)"""


@query(f"with {_K9} select engine, n, round(rate, 6) as rate, round(sqrt(rate * (1 - rate) / n), 6) as sd, round(lo, 6) as lo, round(hi, 6) as hi from r left join ends using (engine)")
def k9_imputed_rate(spark: SparkSession, root: str) -> DataFrame:
    """Rate of encoding variants when unreviewed readings count as the adjudicated ones, with its interval."""
    d = readings(spark, root).select("engine", (F.col("bucket") == "TIER1").alias("sure"), (F.col("bucket") == "UNREVIEWED").alias("unk"), F.when(F.col("label").isNotNull(), F.col("label") == "dropped-matra-nukta").alias("hit"))
    return sampling.imputed_rate(d, ["engine"], "sure", "unk", "hit").select("engine", "n", *[F.round(c, 6).alias(c) for c in ("rate", "sd", "lo", "hi")])


@query(f"""with {READINGS}, {CALLS}, h as (select language as script, image_id, avg((bucket = 'GENUINE')::int) as x from readings where language is not null and image_id is not null group by all), c as (select script, image_id, avg(confidence) as y from calls where condition = 'real' and confidence is not null and script is not null and image_id is not null group by all),
  d as (select script, image_id, x, y from h join c using (script, image_id)), r as materialized (select script, row_number() over (partition by script order by image_id) as i, rank() over (partition by script order by x) + (count(*) over (partition by script, x) - 1) / 2.0 as rx, rank() over (partition by script order by y) + (count(*) over (partition by script, y) - 1) / 2.0 as ry from d),
  b as (select script, count(*) as n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as rho from r group by script), s as (select script, draw, rx, row_number() over (partition by script, draw order by md5('perm|' || draw || '|' || i), i) as k from (select *, unnest(range(0, {DRAWS})) as draw from r)),
  p as (select s.script, draw, covar_pop(s.rx, r.ry) / nullif(stddev_pop(s.rx) * stddev_pop(r.ry), 0) as r from s join r on r.i = s.k and r.script = s.script group by all)
  select script, n, round(rho, 6) as rho, case when n >= 3 and rho is not null then round((count(*) filter (where abs(r) >= abs(rho) - 1e-12) + 1) / (count(*) + 1), 6) end as p from p join b using (script) group by script, n, rho""")
def j2_permutation_p(spark: SparkSession, root: str) -> DataFrame:
    """Rank correlation of difficulty and external confidence over each script's images, with a permutation p-value."""
    h = readings(spark, root).dropna(subset=["language", "image_id"]).groupBy(F.col("language").alias("script"), "image_id").agg(F.avg((F.col("bucket") == "GENUINE").cast("int")).alias("x"))
    c = calls(spark, root).where("condition = 'real'").dropna(subset=["script", "image_id", "confidence"]).groupBy("script", "image_id").agg(F.avg("confidence").alias("y"))
    d = sampling.permuted_spearman(h.join(c, ["script", "image_id"]), ["script"], F.col("image_id"), "x", "y", DRAWS)
    return d.select("script", "n", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))
