"""D: aggregations over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lipika.functions import arrays, text
from lipika.operators import aggregates as agg
from lipika.operators import stats
from lipika.operators.alignment import read_as, substitutions
from lipika.operators.classify import position_bucket
from lipika.operators.joins import ngrams
from lipika.plans.registry import query
from lipika.plans.views import CALLS, CHARSET, LATEST, READINGS, READS, STEPS, calls, clusters_sql, glyphs_sql, last_readings, readings, reads_sql, steps, tier1_sql
from lipika.session import load, written

_BUCKET_SQL = "case when {i} = 0 then '0' when {i} = 1 then '1' when {i} between 2 and 9 then '2-9' when {i} between 10 and 19 then '10-19' when {i} between 20 and 39 then '20-39' when {i} >= 40 then '40+' end"


def _n():
    return F.count(F.lit(1)).alias("n")


@query(f"with {CALLS} select script, condition, count(*) as n, round(avg(confidence), 6) as mean_conf, round(avg(confidence) - avg(case when sarvam_text = ground_truth then 1.0 else 0.0 end), 6) as gap from calls group by all")
def d1_group_mean(spark: SparkSession, root: str) -> DataFrame:
    ok = F.when(F.col("sarvam_text") == F.col("ground_truth"), 1.0).otherwise(0.0)
    return calls(spark, root).groupBy("script", "condition").agg(_n(), F.round(F.avg("confidence"), 6).alias("mean_conf"), F.round(F.avg("confidence") - F.avg(ok), 6).alias("gap"))


@query(f"""with {CALLS} select script, count(confidence) as n, round(avg(confidence), 6) as mean, round(stddev_samp(confidence), 6) as sd, round(stddev_samp(confidence) / sqrt(nullif(count(confidence), 0)), 6) as sem,
  round(avg(confidence) - 1.96 * stddev_samp(confidence) / sqrt(nullif(count(confidence), 0)), 6) as lo, round(avg(confidence) + 1.96 * stddev_samp(confidence) / sqrt(nullif(count(confidence), 0)), 6) as hi from calls group by script""")
def d2_conf_stats(spark: SparkSession, root: str) -> DataFrame:
    d = calls(spark, root).groupBy("script").agg(*agg.conf_stats(F.col("confidence")))
    return d.select("script", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sem", "lo", "hi")])


@query(f"""with {READINGS} select engine, count(*) as total, count(*) filter (where bucket = 'TIER1') as tier1, count(*) filter (where bucket = 'GENUINE') as genuine, count(*) filter (where bucket = 'UNREVIEWED') as unreviewed,
  round(100.0 * count(*) filter (where bucket = 'TIER1') / count(*), 6) as tier1_pct from readings group by engine""")
def d3_category_counts(spark: SparkSession, root: str) -> DataFrame:
    b = lambda x: F.count_if(F.col("bucket") == x)
    return readings(spark, root).groupBy("engine").agg(F.count(F.lit(1)).alias("total"), b("TIER1").alias("tier1"), b("GENUINE").alias("genuine"), b("UNREVIEWED").alias("unreviewed"), F.round(100.0 * b("TIER1") / F.count(F.lit(1)), 6).alias("tier1_pct"))


@query(f"with {READINGS} select engine, language, count(*) as n, round(avg(case when bucket = 'GENUINE' then 1.0 else 0.0 end), 6) as genuine_rate from readings group by grouping sets ((engine), (language), (engine, language))")
def d4_error_rates_grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    """Error rates by engine, language and both, in one pass."""
    r = readings(spark, root)
    return r.groupingSets([["engine"], ["language"], ["engine", "language"]], "engine", "language").agg(_n(), F.round(F.avg((F.col("bucket") == "GENUINE").cast("double")), 6).alias("genuine_rate"))


@query(f"""with {READINGS}, s as (select language, engine, avg(case when bucket = 'GENUINE' then 1.0 else 0.0 end) as a, avg(case when bucket in ('GENUINE', 'UNREVIEWED') then 1.0 else 0.0 end) as b from readings where language is not null group by all)
  select language, list(engine order by round(a, 9), engine) <> list(engine order by round(b, 9), engine) as changed from s group by language""")
def d5_order_changed(spark: SparkSession, root: str) -> DataFrame:
    """Whether engines rank differently when unreviewed readings count as errors."""
    r = readings(spark, root).where("language is not null")
    s = r.groupBy("language", "engine").agg(F.avg((F.col("bucket") == "GENUINE").cast("double")).alias("a"), F.avg(F.col("bucket").isin("GENUINE", "UNREVIEWED").cast("double")).alias("b"))
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.round(c, 9).alias("r"), "engine"))), lambda x: x["engine"])
    return s.groupBy("language").agg((names("a") != names("b")).alias("changed"))


@query(f"with {READINGS} select batch_no, count(*) as n, round(avg(length(hyp)), 6) as mean_len from readings group by rollup (batch_no)")
def d6_rollup_pooled(spark: SparkSession, root: str) -> DataFrame:
    """Each batch, and the pooled row over all records."""
    return readings(spark, root).rollup("batch_no").agg(_n(), F.round(F.avg(F.char_length("hyp")), 6).alias("mean_len"))


@query(f"""with {READINGS}, i as (select language, batch_no, avg(length(gt)) as m from readings group by all) select language, count(*) as n_rep, case when count(*) >= 2 then round(avg(m), 6) end as mean, case when count(*) >= 2 then round(stddev_samp(m), 6) end as sd, count(*) >= 2 as ready from i group by language""")
def d7_two_level_mean(spark: SparkSession, root: str) -> DataFrame:
    d = agg.two_level(readings(spark, root), ["language"], "batch_no", F.char_length("gt"))
    return d.select("language", "n_rep", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "ready")


@query(f"""with {READINGS}, i as (select engine, language, avg(length(gt)) as m from readings where language is not null group by all) select engine, arg_min(language, m) as lowest, arg_max(language, m) as highest, round(max(m) - min(m), 6) as spread from i group by engine""")
def d8_range_of_conditions(spark: SparkSession, root: str) -> DataFrame:
    i = readings(spark, root).where("language is not null").groupBy("engine", "language").agg(F.avg(F.char_length("gt")).alias("m"))
    return i.groupBy("engine").agg(F.min_by("language", "m").alias("lowest"), F.max_by("language", "m").alias("highest"), F.round(F.max("m") - F.min("m"), 6).alias("spread"))


@query(f"with {CALLS} select script, round(avg(case when confidence > 0.95 then 1.0 when confidence is not null then 0.0 end), 6) as above_95, round(avg(case when confidence > 0.99 then 1.0 when confidence is not null then 0.0 end), 6) as above_99 from calls group by script")
def d9_ceiling_fractions(spark: SparkSession, root: str) -> DataFrame:
    c = F.col("confidence")
    return calls(spark, root).groupBy("script").agg(F.round(agg.above(c, 0.95), 6).alias("above_95"), F.round(agg.above(c, 0.99), 6).alias("above_99"))


@query("select case when value >= 0 and value < 5 then 0 when value >= 5 and value < 20 then 1 when value >= 20 and value < 50 then 2 when value >= 50 and value <= 100 then 3 end as bin, count(*) as n from events where value between 0 and 100 group by 1")
def d10_histogram_edges(spark: SparkSession, root: str) -> DataFrame:
    """Custom edges, the last bin closed, values outside dropped."""
    d = load(spark, root, "events").select(agg.edge_bin(F.col("value"), [0.0, 5.0, 20.0, 50.0, 100.0]).alias("bin"))
    return d.where("bin is not null").groupBy("bin").agg(_n())


@query(f"with {CALLS} select floor(confidence * 10)::int as bin, count(*) as n, round(avg(case when sarvam_text = ground_truth then 1.0 else 0.0 end), 6) as accuracy from calls where confidence >= 0 and confidence < 1 group by 1")
def d11_reliability_equal_width(spark: SparkSession, root: str) -> DataFrame:
    ok = F.when(F.col("sarvam_text") == F.col("ground_truth"), 1.0).otherwise(0.0)
    d = calls(spark, root).withColumn("bin", agg.equal_width(F.col("confidence"), 10)).where("bin is not null")
    return d.groupBy("bin").agg(_n(), F.round(F.avg(ok), 6).alias("accuracy"))


_ECE = f"""{CALLS}, t as (select script, confidence, case when sarvam_text = ground_truth then 1.0 else 0.0 end as ok, ntile(10) over (partition by script order by confidence, probe_id) as bin from calls where confidence is not null),
  b as (select script, bin, count(*) as n, avg(confidence) as conf, avg(ok) as acc from t group by all)"""


@query(f"with {_ECE} select script, round(sum(n * abs(conf - acc)) / sum(n), 6) as ece from b group by script")
def d12_calibration_error(spark: SparkSession, root: str) -> DataFrame:
    """Expected calibration error over ten equal-mass bins."""
    b = agg.equal_mass_bins(calls(spark, root), ["script"], "confidence", F.col("sarvam_text") == F.col("ground_truth"), [F.col("probe_id")])
    return agg.calibration_error(b, ["script"]).select("script", F.round("ece", 6).alias("ece"))


@query(f"with {_ECE} select script, bin::int as bin, n, round(conf, 6) as conf, round(acc, 6) as acc from b")
def d12_reliability_bins(spark: SparkSession, root: str) -> DataFrame:
    b = agg.equal_mass_bins(calls(spark, root), ["script"], "confidence", F.col("sarvam_text") == F.col("ground_truth"), [F.col("probe_id")])
    return b.select("script", "bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


@query(f"""with {READINGS}, h as (select engine, substr(hyp, 1, 1) as ch, count(*) as n, min(row_no) as f from readings where hyp <> '' group by all), r as (select *, row_number() over (partition by engine order by n desc, f) as rn, sum(n) over (partition by engine) as t from h)
  select engine, ch as mode, round(n / t, 6) as share from r where rn = 1""")
def d13_mode_first_token(spark: SparkSession, root: str) -> DataFrame:
    d = readings(spark, root).where("hyp <> ''").select("engine", F.substring("hyp", 1, 1).alias("ch"), "row_no")
    return agg.mode_share(d, ["engine"], "ch", "row_no").select("engine", "mode", F.round("share", 6).alias("share"))


@query(f"""with {READINGS}, g as (select engine, language, hyp, count(*) as k from readings where hyp <> '' group by all) select engine, language, sum(k)::bigint as n, count(*) as distinct_texts, round(sum(k * (k - 1) / 2) / nullif(sum(k) * (sum(k) - 1) / 2, 0), 9) as identical from g group by engine, language""")
def d14_degeneracy(spark: SparkSession, root: str) -> DataFrame:
    """Distinct outputs, and the share of identical pairs from counts of copies, without forming pairs."""
    g = readings(spark, root).where("hyp <> ''").groupBy("engine", "language", "hyp").agg(F.count(F.lit(1)).alias("k"))
    k, n = F.col("k"), F.sum("k")
    same = F.try_divide(F.sum(k * (k - 1) / 2), n * (n - 1) / 2)
    return g.groupBy("engine", "language").agg(n.alias("n"), F.count(F.lit(1)).alias("distinct_texts"), F.round(same, 9).alias("identical"))


_KLSQL = """fl as (select *, list_transform(p, lambda x: greatest(x, 1e-8)) as pf, list_transform(q, lambda x: greatest(x, 1e-8)) as qf from steps),
  k as (select vec_id, label, p, q, list_sum(list_transform(range(1, 33), lambda i: pf[i] / list_sum(pf) * ln((pf[i] / list_sum(pf)) / (qf[i] / list_sum(qf))))) as kl,
  list_position(p, list_max(p)) = list_position(q, list_max(q)) as agree from fl)"""


@query(f"with {STEPS}, {_KLSQL} select label, round(avg(case when agree then 0.0 else 1.0 end), 6) as flip_rate, round(sum(case when not agree then kl end) / sum(kl), 6) as flip_share from k group by label")
def d15_flip_decomposition(spark: SparkSession, root: str) -> DataFrame:
    d = steps(spark, root).select("label", arrays.kl(F.col("p"), F.col("q")).alias("kl"), (arrays.argmax(F.col("p")) == arrays.argmax(F.col("q"))).alias("agree"))
    return agg.flip_decomposition(d, ["label"], "kl", "agree").select("label", F.round("flip_rate", 6).alias("flip_rate"), F.round("flip_share", 6).alias("flip_share"))


_POS = "pos as (select vec_id, label, i - 1 as i, p[i] as p, q[i] as q from (select *, unnest(range(1, 33)) as i from steps))"


def _positions(spark: SparkSession, root: str) -> DataFrame:
    return steps(spark, root).select("vec_id", "label", F.posexplode(F.arrays_zip("p", "q")).alias("i", "z")).select("vec_id", "label", "i", "z.p", "z.q")


@query(f"with {STEPS}, {_POS} select case when i = 0 then 'first' else 'later' end as part, count(*) as n, round(avg(case when p > 0.03125 then 1.0 else 0.0 end), 6) as share from pos group by 1")
def d16_flag_by_position(spark: SparkSession, root: str) -> DataFrame:
    part = F.when(F.col("i") == 0, "first").otherwise("later")
    return _positions(spark, root).groupBy(part.alias("part")).agg(_n(), F.round(agg.above(F.col("p"), 0.03125), 6).alias("share"))


@query(f"with {STEPS}, {_POS} select {_BUCKET_SQL.format(i='i')} as bucket, count(*) as n, round(avg(p), 9) as mean_p, round(avg(ln(p)), 6) as mean_log_p from pos group by 1")
def d17_position_bucket_means(spark: SparkSession, root: str) -> DataFrame:
    return _positions(spark, root).groupBy(position_bucket(F.col("i")).alias("bucket")).agg(_n(), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.avg(F.ln("p")), 6).alias("mean_log_p"))


@query(f"with {STEPS}, {_POS}, s as (select label, i, avg(p) as m from pos group by all) select i, round(avg(m), 9) as mean, round(min(m), 9) as lo, round(max(m), 9) as hi from s group by i")
def d18_position_curve_band(spark: SparkSession, root: str) -> DataFrame:
    """Mean over repetitions of each position's mean, with its band."""
    s = _positions(spark, root).groupBy("label", "i").agg(F.avg("p").alias("m"))
    return s.groupBy("i").agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.min("m"), 9).alias("lo"), F.round(F.max("m"), 9).alias("hi"))


@query(f"with {READINGS} select language, round(avg(length(gt)), 6) as mean, median(length(gt)) as median, round(stddev_samp(length(gt)), 6) as sd, min(length(gt)) as lo, max(length(gt)) as hi, count(*) filter (where length(gt) >= 40) as n_40 from readings group by language")
def d19_length_summary(spark: SparkSession, root: str) -> DataFrame:
    n = F.char_length("gt")
    return readings(spark, root).groupBy("language").agg(F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.round(F.stddev_samp(n), 6).alias("sd"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.count_if(n >= 40).alias("n_40"))


@query(f"with {READINGS}, m as (select engine, variant, avg(length(hyp)) as v from readings where variant is not null group by all) select engine, round(max(v) - min(v), 6) as band from m group by engine")
def d20_condition_band(spark: SparkSession, root: str) -> DataFrame:
    m = readings(spark, root).where("variant is not null").groupBy("engine", "variant").agg(F.avg(F.char_length("hyp")).alias("v"))
    return m.groupBy("engine").agg(F.round(F.max("v") - F.min("v"), 6).alias("band"))


@query(f"with {CALLS} select script, round(exp(avg(ln(least(greatest(confidence, 1e-30), 1.0)))), 9) as geo from calls where confidence is not null group by script")
def d21_geometric_mean(spark: SparkSession, root: str) -> DataFrame:
    c = F.least(F.greatest(F.col("confidence"), F.lit(1e-30)), F.lit(1.0))
    return calls(spark, root).where("confidence is not null").groupBy("script").agg(F.round(F.exp(F.avg(F.ln(c))), 9).alias("geo"))


@query("select event_type, round(median(value), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(avg(value), 6) as mean from events group by event_type")
def d22_quantiles(spark: SparkSession, root: str) -> DataFrame:
    e = load(spark, root, "events")
    q = stats.quantiles(e, ["event_type"], "value", [0.5, 0.9]).select("event_type", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p90"))
    return q.join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), "event_type")


@query(f"with {STEPS} select label, round(exp(avg(ln(p[1]))), 9) as geo, round(avg(p[1]), 9) as mean, round(avg(case when p[1] > 1.0 / 32 then 1.0 else 0.0 end), 6) as above_chance, round(min(p[1]), 9) as lo, round(max(p[1]), 9) as hi from steps group by label")
def d23_first_position(spark: SparkSession, root: str) -> DataFrame:
    x = F.get("p", F.lit(0))
    return steps(spark, root).groupBy("label").agg(F.round(F.exp(F.avg(F.ln(x))), 9).alias("geo"), F.round(F.avg(x), 9).alias("mean"), F.round(agg.above(x, 1.0 / 32), 6).alias("above_chance"), F.round(F.min(x), 9).alias("lo"), F.round(F.max(x), 9).alias("hi"))


@query(f"""with recursive {READS} select true_cluster as a, predicted_cluster as b, count(*) as n, round(avg(length(hyp)), 6) as mean_w, arg_min(hyp, row_no) as first_example
  from readings join texts using (gt, hyp) join reads using (k) where true_cluster <> predicted_cluster group by a, b""")
def d24_confusion_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of confusions anywhere in a text, by alignment of its clusters, with the first example."""
    r = readings(spark, root).where("gt <> hyp").select(F.struct("row_no", "hyp").alias("of"), text.graphemes(F.col("gt")).alias("a"), text.graphemes(F.col("hyp")).alias("b"))
    d = substitutions(r, "a", "b").select(F.col("true_cluster").alias("a"), F.col("predicted_cluster").alias("b"), "of.*")
    return d.groupBy("a", "b").agg(_n(), F.round(F.avg(F.char_length("hyp")), 6).alias("mean_w"), F.min_by("hyp", "row_no").alias("first_example"))


_CALL_PAIRS = f"""texts as materialized (select ground_truth, sarvam_text, row_number() over () as k from (select distinct ground_truth, sarvam_text from calls where ground_truth <> sarvam_text)),
  pairs as materialized (select k, {clusters_sql('ground_truth')} as a, {clusters_sql('sarvam_text')} as b from texts)"""
_EDGES = f"""{CALLS}, {_CALL_PAIRS}, {reads_sql('pairs')}, sub as (select script, probe_id, confidence, true_cluster, predicted_cluster, i, rank() over (partition by script order by coalesce(confidence, -1) desc) as place
  from calls join texts using (ground_truth, sarvam_text) join reads using (k) where true_cluster <> predicted_cluster)"""


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """(script, probe_id, confidence, true_cluster, predicted_cluster, gt_index, place): substitutions of the probe calls, with the confidence's rank among those of the script."""
    c = calls(spark, root).where("ground_truth <> sarvam_text").select(F.struct("script", "probe_id", "confidence").alias("of"), text.graphemes(F.col("ground_truth")).alias("a"), text.graphemes(F.col("sarvam_text")).alias("b"))
    d = written(substitutions(c, "a", "b").select("of.*", "true_cluster", "predicted_cluster", "gt_index"), "edges")
    n = d.groupBy("script", F.coalesce("confidence", F.lit(-1.0)).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    place = n.withColumn("place", F.coalesce(F.sum("k").over(Window.partitionBy("script").orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).drop("k")
    return d.withColumn("c", F.coalesce("confidence", F.lit(-1.0))).join(place, ["script", "c"]).drop("c")


@query(f"""with recursive {_EDGES} select script, true_cluster, predicted_cluster, count(*) as n, round(avg(confidence), 6) as mean_prob, round(avg(case when confidence is not null then place end), 6) as mean_rank,
  round(avg((place <= 5)::int), 6) as top5_share, arg_min(probe_id, probe_id * 1000000 + i) as first_example from sub group by all""")
def d24_scored_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of the probe's confusions: count, mean confidence, mean rank of those that have one, share within the top five, first example."""
    return agg.confusion_edges(_edges(spark, root), ["script"], "confidence", "place", "probe_id", ["probe_id", "gt_index"])


@query(f"""with recursive {_EDGES}, e as (select script, true_cluster, predicted_cluster, count(*) as n, avg(confidence) as p, avg(case when confidence is not null then place end) as r from sub group by all)
  select true_cluster, predicted_cluster, sum(n)::bigint as n, round(sum(p * n) / sum(case when p is not null then n end), 6) as mean_prob, round(sum(r * n) / sum(case when r is not null then n end), 6) as mean_rank from e group by all""")
def d25_merged_edges(spark: SparkSession, root: str) -> DataFrame:
    """The scripts' confusion edges merged again, each mean weighted by the edge's count."""
    e = agg.confusion_edges(_edges(spark, root), ["script"], "confidence", "place", "probe_id", ["probe_id", "gt_index"], rounded=False)
    merged = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), 6).alias(c)
    return e.groupBy("true_cluster", "predicted_cluster").agg(merged("mean_prob"), merged("mean_rank"), F.sum("n").alias("n"))


@query(f"with {READINGS}, p as (select engine, batch_no, count(*) as n, avg(length(hyp)) as m from readings group by all) select engine, sum(n)::bigint as n, round(sum(m * n) / sum(n), 6) as merged from p group by engine")
def d25_weighted_merge(spark: SparkSession, root: str) -> DataFrame:
    p = readings(spark, root).groupBy("engine", "batch_no").agg(F.count(F.lit(1)).alias("k"), F.avg(F.char_length("hyp")).alias("m"))
    return p.groupBy("engine").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("m") * F.col("k")) / F.sum("k"), 6).alias("merged"))


@query(f"with {STEPS}, {_POS} select case when p < 0.01 then '<.01' when p < 0.05 then '.01-.05' when p < 0.2 then '.05-.2' else '>=.2' end as mass, count(*) as n, round(avg(q), 9) as mean_q from pos group by 1")
def d26_mass_bins(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("p")
    mass = F.when(p < 0.01, "<.01").when(p < 0.05, ".01-.05").when(p < 0.2, ".05-.2").otherwise(">=.2")
    return _positions(spark, root).groupBy(mass.alias("mass")).agg(_n(), F.round(F.avg("q"), 9).alias("mean_q"))


@query(f"select ch, count(*) as n from (select unnest({glyphs_sql('text')}) as ch from page_gt where text is not null) group by ch")
def d27_glyph_counts(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "page_gt").select(F.explode(text.glyph_clusters(F.col("text"))).alias("ch")).groupBy("ch").agg(_n())


_WHOLE = f"""{READINGS}, w as (select language, gt, case when {tier1_sql('gt')} = {tier1_sql('hyp')} then gt else hyp end as hyp from readings where language is not null),
  texts as materialized (select gt, hyp, row_number() over () as k from (select distinct gt, hyp from w)), pairs as materialized (select k, {glyphs_sql('gt')} as a, {glyphs_sql('hyp')} as b from texts), {reads_sql('pairs')}"""


@query(f"""with recursive {_WHOLE} select language, true_cluster as ch, count(*) as total, count(*) filter (where true_cluster = predicted_cluster) as correct from w join texts using (gt, hyp) join reads using (k) group by all""")
def d28_glyph_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Glyph clusters of each language and how many are read right: all of a line that is right as a whole (tier 1), else those that the alignment matches."""
    r = readings(spark, root).where("language is not null")
    hyp = F.when(text.tier1(F.col("gt")) == text.tier1(F.col("hyp")), F.col("gt")).otherwise(F.col("hyp"))
    d = read_as(r.select("language", text.glyph_clusters(F.col("gt")).alias("a"), text.glyph_clusters(hyp).alias("b")), "a", "b")
    return d.groupBy("language", F.col("true_cluster").alias("ch")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("true_cluster") == F.col("predicted_cluster"), F.col("n")).otherwise(0)).alias("correct"))


@query(f"with {CALLS} select script, round(avg(coalesce(sarvam_text = ground_truth, false)::int), 6) as accuracy, count(*) as n from calls group by script")
def d29_line_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """A missing text counts as wrong."""
    ok = F.coalesce(F.col("sarvam_text") == F.col("ground_truth"), F.lit(False))
    return calls(spark, root).groupBy("script").agg(F.round(F.avg(ok.cast("int")), 6).alias("accuracy"), _n())


@query(f"""with c as (select ch, count(*) as n from (select unnest({glyphs_sql('text')}) as ch from line_gt where text is not null) group by ch), t as (select sum(n) as t from c)
  select (select count(*) from line_gt where text is not null) as lines, (select round(avg(len({glyphs_sql('text')})), 6) from line_gt where text is not null) as mean_length, (select arg_min(text, line_id) from line_gt where text is not null) as first_line, count(*) as glyphs, sum(n)::bigint as tokens, round(-sum(n / t * ln(n / t + 1e-12) / ln(2)), 6) as entropy_bits from c cross join t""")
def d30_corpus_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    d = load(spark, root, "line_gt").where("text is not null")
    c = d.select(F.explode(text.glyph_clusters(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("k"))
    t = c.agg(F.sum("k").alias("t"))
    p = F.col("k") / F.col("t")
    a = c.crossJoin(F.broadcast(t)).agg(F.count(F.lit(1)).alias("glyphs"), F.sum("k").alias("tokens"), F.round(-F.sum(p * F.ln(p + 1e-12) / F.ln(F.lit(2.0))), 6).alias("entropy_bits"))
    whole = d.agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg(F.size(text.glyph_clusters(F.col("text")))), 6).alias("mean_length"), F.min_by("text", "line_id").alias("first_line"))
    return whole.crossJoin(F.broadcast(a))


@query(f"""with tr as (select {clusters_sql('text')} as t from line_gt where text is not null and text <> ''), ev as (select case when i = 1 then '<BOS>' else t[i - 1] end as ctx, case when i = len(t) + 1 then '<EOS>' else t[i] end as tok from (select t, unnest(range(1, len(t) + 2)) as i from tr))
  select ctx, tok, count(*) as n from ev group by all""")
def d31_ngram_counts(spark: SparkSession, root: str) -> DataFrame:
    d = load(spark, root, "line_gt").where("text <> ''").select(F.explode(ngrams(text.graphemes(F.col("text")), 2)).alias("e"))
    return d.groupBy("e.ctx", "e.tok").agg(_n())


@query(f"""with {READINGS}, {CHARSET.format(c='hyp', by='language')}, g as (select language, trained / n as fr from charset where n > 0 union all select language, null from charset where n = 0)
  select language, count(fr) as n, round(avg(fr), 6) as mean, round(stddev_pop(fr), 6) as sd, count(*) filter (where fr = 0) as zero from g group by language""")
def d32_charset_summary(spark: SparkSession, root: str) -> DataFrame:
    """Share of Devanagari clusters in readings; blank ones have none (population sd)."""
    fr = readings(spark, root).select("language", text.charset(F.col("hyp"), r"[\u0900-\u097f]", r"[\u0980-\u09ff]")["trained_script_fraction"].alias("fr"))
    return fr.groupBy("language").agg(F.count("fr").alias("n"), F.round(F.avg("fr"), 6).alias("mean"), F.round(F.stddev_pop("fr"), 6).alias("sd"), F.count_if(F.col("fr") == 0).alias("zero"))


@query("""with c as (select unnest(['single-column', 'two-column', 'table-embedded', 'form', 'marginalia', 'unknown']) as category), b as (select coalesce(category, 'unknown') as category, len(regions) as k from layout_bank)
  select c.category, count(b.k) as n, round(avg(b.k), 6) as mean_regions from c left join b using (category) group by c.category""")
def d34_empty_categories_kept(spark: SparkSession, root: str) -> DataFrame:
    """Every category of the dimension, also those without pages."""
    c = spark.createDataFrame([(x,) for x in ("single-column", "two-column", "table-embedded", "form", "marginalia", "unknown")], "category string")
    b = load(spark, root, "layout_bank").select(F.coalesce("category", F.lit("unknown")).alias("category"), F.size("regions").alias("k"))
    return F.broadcast(c).join(b, "category", "left").groupBy("category").agg(F.count("k").alias("n"), F.round(F.avg("k"), 6).alias("mean_regions"))


@query("""with r as (select source, source_id, page_index, r.* from (select source, source_id, page_index, unnest(regions) as r from layout_bank))
  select source, count(*) as regions, count(distinct source_id) as sources, count(*) filter (where width >= 0.2 and height >= 0.15) as large, round(avg(width * height), 6) as mean_area from r group by source""")
def d35_layout_inventory(spark: SparkSession, root: str) -> DataFrame:
    r = load(spark, root, "layout_bank").select("source", "source_id", F.inline("regions"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("regions"), F.count_distinct("source_id").alias("sources"), F.count_if((F.col("width") >= 0.2) & (F.col("height") >= 0.15)).alias("large"), F.round(F.avg(F.col("width") * F.col("height")), 6).alias("mean_area"))


@query(f"""with {READINGS}, l as materialized (select engine, hyp, {clusters_sql('gt')} as a, {clusters_sql('hyp')} as b from readings),
  c as (select engine, hyp, case when len(a) = 0 then 1.0 else list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) / len(a) end as cov from l)
  select engine, count(*) filter (where hyp = '') as empties, round(avg(cov), 6) as coverage, count(*) filter (where cov < 0.5) as short from c group by engine""")
def d37_reward_summary(spark: SparkSession, root: str) -> DataFrame:
    """Empty readings, and how much of the truth's clusters, counted with multiplicity, the readings have."""
    d = readings(spark, root).select("engine", "hyp", text.covered(F.col("gt"), F.col("hyp")).alias("cov"))
    return d.groupBy("engine").agg(F.count_if(F.col("hyp") == "").alias("empties"), F.round(F.avg("cov"), 6).alias("coverage"), F.count_if(F.col("cov") < 0.5).alias("short"))


@query("with r as (select coalesce(category, 'unknown') as category, i - 1 as layer, regions[i].height as v from (select category, regions, unnest(range(1, len(regions) + 1)) as i from layout_bank)) select category, layer, count(*) as n, round(avg(v), 6) as mean from r group by all")
def d38_per_layer_means(spark: SparkSession, root: str) -> DataFrame:
    r = load(spark, root, "layout_bank").select(F.coalesce("category", F.lit("unknown")).alias("category"), F.posexplode("regions").alias("layer", "r"))
    return r.groupBy("category", "layer").agg(_n(), F.round(F.avg("r.height"), 6).alias("mean"))


@query(f"""with {CALLS}, dim(script, published) as (values ('hindi', 0.9::double), ('bengali', 0.85), ('santhali', 0.6), ('kashmiri', 0.5)) select script, count(*) as n, round(avg(confidence), 6) as mean_conf, published from calls left join dim using (script) group by script, published""")
def d39_confidence_by_script(spark: SparkSession, root: str) -> DataFrame:
    dim = spark.createDataFrame([("hindi", 0.9), ("bengali", 0.85), ("santhali", 0.6), ("kashmiri", 0.5)], "script string, published double")
    return calls(spark, root).join(F.broadcast(dim), "script", "left").groupBy("script", "published").agg(_n(), F.round(F.avg("confidence"), 6).alias("mean_conf"))


@query(f"""with {READINGS}, k as (select count(distinct engine) as k from readings) select language, image_id, round(0.0 - avg(case when bucket = 'GENUINE' then 1.0 else 0.0 end), 6) as difficulty from readings where language is not null and image_id is not null group by all having count(distinct engine) = (select k from k)""")
def d40_difficulty_by_id(spark: SparkSession, root: str) -> DataFrame:
    """Images that every engine has read."""
    r = readings(spark, root)
    k = r.agg(F.count_distinct("engine").alias("k"))
    d = r.dropna(subset=["language", "image_id"]).groupBy("language", "image_id").agg(F.count_distinct("engine").alias("e"), F.round(F.lit(0.0) - F.avg((F.col("bucket") == "GENUINE").cast("double")), 6).alias("difficulty"))
    return d.join(F.broadcast(k), F.col("e") == F.col("k")).select("language", "image_id", "difficulty")


@query(f"with {READINGS} select image_id, min(row_no) as first_row from readings where language = 'hindi' group by image_id")
def d41_first_seen(spark: SparkSession, root: str) -> DataFrame:
    """Distinct ids with the row in which each is seen first."""
    return readings(spark, root).where("language = 'hindi'").groupBy("image_id").agg(F.min("row_no").alias("first_row"))


@query(f"""with {READINGS}, g as (select language, batch_no, avg(length(hyp)) - avg(length(gt)) as gap from readings where language is not null group by all)
  select language, count(*) as n, bool_or(gap > 0) and bool_or(gap < 0) as flips, coalesce(stddev_samp(gap) > abs(avg(gap)), false) as noisy from g group by language""")
def d42_gap_sign_stability(spark: SparkSession, root: str) -> DataFrame:
    g = readings(spark, root).where("language is not null").groupBy("language", "batch_no").agg((F.avg(F.char_length("hyp")) - F.avg(F.char_length("gt"))).alias("gap"))
    return g.groupBy("language").agg(_n(), (F.bool_or(F.col("gap") > 0) & F.bool_or(F.col("gap") < 0)).alias("flips"), F.coalesce(F.stddev_samp("gap") > F.abs(F.avg("gap")), F.lit(False)).alias("noisy"))


_BUNDLE = f"""{READINGS}, {CALLS}, l as (select language as script, 'synthetic' as domain, variant as condition, (bucket <> 'GENUINE')::int as ok from readings where variant in ('plain', 'degraded') and language is not null
  union all select script, 'real', condition, coalesce(sarvam_text = ground_truth, false)::int from calls where condition in ('real', 'blank') and script is not null), g as (select script, domain, condition, count(*) as n, avg(ok) as acc from l group by all),
  m as (select script, avg(ok) filter (where domain = 'synthetic') as synthetic, avg(ok) filter (where domain = 'real') as real from l group by script)"""


@query(f"with {_BUNDLE} select script, domain, condition, n, round(acc, 6) as accuracy, round(synthetic - real, 6) as gap from g join m using (script)")
def d43_domain_bundle(spark: SparkSession, root: str) -> DataFrame:
    """Conditions of two domains, nested by script and unpivoted again, with the gap of the domains' means; a domain may be absent."""
    r = readings(spark, root).where(F.col("variant").isin("plain", "degraded")).select(F.col("language").alias("script"), F.col("variant").alias("condition"), (F.col("bucket") != "GENUINE").cast("int").alias("ok"))
    c = calls(spark, root).where(F.col("condition").isin("real", "blank")).select("script", "condition", F.coalesce(F.col("sarvam_text") == F.col("ground_truth"), F.lit(False)).cast("int").alias("ok"))
    s, k = agg.nested_conditions(r, "script", "condition", ["plain", "degraded"], "ok"), agg.nested_conditions(c, "script", "condition", ["real", "blank"], "ok")
    both = s.withColumnRenamed("bundle", "synthetic").join(k.withColumnRenamed("bundle", "real"), "script", "full").where("script is not null")
    gap = F.round(F.col("synthetic.mean") - F.col("real.mean"), 6)
    parts = [F.struct(F.lit(d).alias("domain"), F.lit(x).alias("condition"), F.col(f"{d}.{x}.n").alias("n"), F.round(F.col(f"{d}.{x}.mean"), 6).alias("accuracy")) for d, xs in (("synthetic", ("plain", "degraded")), ("real", ("real", "blank"))) for x in xs]
    return both.select("script", gap.alias("gap"), F.inline(F.array(*parts))).where("n > 0")


@query("select script, field, count(v) as n, round(avg(v), 6) as mean from (select lower(trim(script, E' \\t')) as script, unnest(['processed', 'succeeded', 'failed']) as field, unnest([usage.pages_processed, usage.pages_succeeded, usage.pages_failed]) as v from sarvam_transfer_probe) group by all")
def l6_unpivot_nested(spark: SparkSession, root: str) -> DataFrame:
    """Nested fields as rows, then aggregated."""
    from lipika.functions.labels import label

    d = load(spark, root, "sarvam_transfer_probe").select(label("script").alias("script"), F.expr("stack(3, 'processed', usage.pages_processed, 'succeeded', usage.pages_succeeded, 'failed', usage.pages_failed) as (field, v)"))
    return d.groupBy("script", "field").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


_HALF = "-(m * ln(m) + (1 - m) * ln(1 - m))"


@query(f"""with recursive {STEPS}, e as (select vec_id, label, list_sum(list_transform(p, lambda x: greatest(x, 1e-12))) as s, p from steps), h as (select vec_id, label, -list_sum(list_transform(p, lambda x: greatest(x, 1e-12) / s * ln(greatest(x, 1e-12) / s))) / 8 as h from e),
  b(vec_id, label, h, lo, hi, k) as (select vec_id, label, h, 0.5::double, 1 - 1e-12::double, 0 from h union all select vec_id, label, h, case when {_HALF} > h then m else lo end, case when {_HALF} > h then hi else m end, k + 1 from (select *, (lo + hi) / 2 as m from b where k < 60))
  select label, round(avg((lo + hi) / 2), 6) as implied from b where k = 60 group by label""")
def d44_implied_top(spark: SparkSession, root: str) -> DataFrame:
    """The larger mass that a two-way choice of each step's entropy would have."""
    h = arrays.entropy(F.col("p")) / 8
    return steps(spark, root).groupBy("label").agg(F.round(F.avg(arrays.implied_top(h)), 6).alias("implied"))


@query(f"with {LATEST} select engine, language, count(*) as n from latest group by cube (engine, language)")
def d45_latest_cube(spark: SparkSession, root: str) -> DataFrame:
    return last_readings(spark, root).cube("engine", "language").agg(_n())
