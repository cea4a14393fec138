"""H: text scalars over the project's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import text
from lipika.plans.registry import query
from lipika.plans.views import CALLS, CHARSET, bare_sql, signals_sql, READINGS, TEXTS, calls, clusters_sql, distance_sql, glyphs_sql, phonetic_sql, readings, tier1_sql, ws_sql
from lipika.session import load


def _sized(spark: SparkSession, root: str) -> DataFrame:
    """Readings with the clusters of both tier-1 forms, counted, and their distance, computed once."""
    d = readings(spark, root).select("row_no", "engine", "language", text.measured(text.tier1(F.col("gt")), text.tier1(F.col("hyp"))).alias("m"))
    return d.select("row_no", "engine", "language", "m.*")


#: The views ``readings``, ``texts`` (gt, hyp, k), ``pairs`` (k, a, b: clusters of the tier-1 forms) and ``dist`` (k, dist), for ``with recursive``.
_SIZED = f"""{READINGS}, {TEXTS}, pairs as materialized (select k, {clusters_sql('gt')} as a, {clusters_sql('hyp')} as b from (select k, {tier1_sql('gt')} as gt, {tier1_sql('hyp')} as hyp from texts)), {distance_sql('pairs')},
  sized as (select engine, language, dist, len(a) as n_gt, len(b) as n_hyp, case when len(a) > 0 then dist / len(a) when len(b) = 0 then 0 else 'inf'::double end as cer from readings join texts using (gt, hyp) join pairs using (k) join dist using (k))"""


@query(f"with {READINGS} select language, sum(length_grapheme(gt))::bigint as clusters, sum(length(gt))::bigint as chars from readings group by language")
def h1_grapheme_counts(spark: SparkSession, root: str) -> DataFrame:
    return readings(spark, root).groupBy("language").agg(F.sum(F.size(text.graphemes(F.col("gt")))).alias("clusters"), F.sum(F.char_length("gt")).alias("chars"))


@query(f"with {READINGS} select language, g, count(*) as n from (select language, unnest({glyphs_sql('gt')}) as g from readings) group by all")
def h1b_glyph_clusters(spark: SparkSession, root: str) -> DataFrame:
    g = readings(spark, root).select("language", F.explode(text.glyph_clusters(F.col("gt"))).alias("g"))
    return g.groupBy("language", "g").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {READINGS} select row_no, {tier1_sql('hyp')} as form from readings")
def h2_tier1_form(spark: SparkSession, root: str) -> DataFrame:
    return readings(spark, root).select("row_no", text.tier1(F.col("hyp")).alias("form"))


@query(f"select doc_id, length({ws_sql('text')}) as n, {ws_sql('text')} = text as clean from documents where text is not null")
def h2a_whitespace(spark: SparkSession, root: str) -> DataFrame:
    w = text.whitespace(F.col("text"))
    return load(spark, root, "documents").where("text is not null").select("doc_id", F.char_length(w).cast("long").alias("n"), (w == F.col("text")).alias("clean"))


def _anusvara_sql(c: str) -> str:
    for nasal, (first, last) in text.NASALS.items():
        for k in range(ord(first), ord(last) + 1):
            c = f"replace({c}, '{nasal}्{chr(k)}', 'ं{chr(k)}')"
    return c


@query(f"with {READINGS} select language, count(*) filter (where {_anusvara_sql('gt')} <> gt) as changed, sum(length({_anusvara_sql('gt')}))::bigint as chars from readings group by language")
def h2b_anusvara(spark: SparkSession, root: str) -> DataFrame:
    a = text.anusvara(F.col("gt"))
    return readings(spark, root).groupBy("language").agg(F.count_if(a != F.col("gt")).alias("changed"), F.sum(F.char_length(a)).alias("chars"))


@query(f"with {CALLS} select probe_id, {tier1_sql('ground_truth')} = {tier1_sql('sarvam_text')} as equivalent from calls where ground_truth is not null and sarvam_text is not null")
def h2c_equivalent(spark: SparkSession, root: str) -> DataFrame:
    d = calls(spark, root).where("ground_truth is not null and sarvam_text is not null")
    return d.select("probe_id", (text.tier1(F.col("ground_truth")) == text.tier1(F.col("sarvam_text"))).alias("equivalent"))


@query(f"""with {READINGS}, t as (select *, {phonetic_sql('gt', 'language')} = {phonetic_sql('hyp', 'language')} as same from readings where language in ('hindi', 'bengali'))
  select language, count(*) as n, count(*) filter (where same) as same_sound, count(*) filter (where same and {tier1_sql('gt')} <> {tier1_sql('hyp')}) as by_sound_alone from t group by language""")
def h3_phonetic_equivalence(spark: SparkSession, root: str) -> DataFrame:
    """Readings that transliterate to the same letters, and those that no encoding variant explains."""
    d = readings(spark, root).where(F.col("language").isin(*text.ISO_LANGUAGES)).select("language", text.tier2(F.col("gt"), F.col("hyp"), F.col("language")).alias("same"), (text.tier1(F.col("gt")) != text.tier1(F.col("hyp"))).alias("other"))
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same_sound"), F.count_if(F.col("same") & F.col("other")).alias("by_sound_alone"))


@query(f"with recursive {_SIZED} select engine, dist, count(*) as n from sized group by all")
def h4_cluster_distance(spark: SparkSession, root: str) -> DataFrame:
    return _sized(spark, root).groupBy("engine", "dist").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {_SIZED} select engine, language, count(*) as n, round(avg(case when cer <> 'inf' then cer end), 9) as mean_cer, round(avg(greatest(0, 1 - cer)), 9) as accuracy, round(avg(case when cer = 'inf' then 1 else cer end), 9) as finite_cer from sized group by all""")
def h5_error_rates(spark: SparkSession, root: str) -> DataFrame:
    """Cluster error rate and accuracy by engine and language; infinite rates stay out of the mean."""
    d = _sized(spark, root).withColumn("cer", text.error_rate(F.col("dist"), F.col("n_gt"), F.col("n_hyp")))
    ok = F.when(F.col("cer") != float("inf"), F.col("cer"))
    return d.groupBy("engine", "language").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok), 9).alias("mean_cer"), F.round(F.avg(text.accuracy(F.col("cer"))), 9).alias("accuracy"), F.round(F.avg(text.finite(F.col("cer"))), 9).alias("finite_cer"))


@query(f"with recursive {_SIZED} select engine, round(avg(case when cer = 'inf' then 1 else cer end), 9) as mean_cer, count(*) filter (where n_gt = 0) as no_truth from sized group by engine")
def h5b_one_for_empty(spark: SparkSession, root: str) -> DataFrame:
    """Error rates that count 1 where there is no truth but a reading."""
    d = _sized(spark, root).withColumn("cer", text.error_rate(F.col("dist"), F.col("n_gt"), F.col("n_hyp"), "one"))
    return d.groupBy("engine").agg(F.round(F.avg("cer"), 9).alias("mean_cer"), F.count_if(F.col("n_gt") == 0).alias("no_truth"))


@query(f"""with {READINGS}, {CHARSET.format(c='hyp', by='language')} select language, sum(n)::bigint as n, round(avg(case when n > 0 then trained / n end), 9) as trained, round(avg(case when n > 0 then image / n end), 9) as image,
  round(avg(case when n > 0 then (n - trained - image) / n end), 9) as other from charset group by language""")
def h6_charset_composition(spark: SparkSession, root: str) -> DataFrame:
    c = text.charset(F.col("hyp"), r"[\u0900-\u097f]", r"[\u0980-\u09ff]")
    d = readings(spark, root).select("language", c.alias("c"))
    mean = lambda f: F.round(F.avg(f"c.{f}_fraction"), 9)
    return d.groupBy("language").agg(F.sum("c.n_graphemes").alias("n"), mean("trained_script").alias("trained"), mean("image_script").alias("image"), mean("other").alias("other"))


@query(f"with {READINGS} select engine, count(*) filter (where {bare_sql('gt')} = {bare_sql('hyp')}) as marks_only, count(*) as n from readings where gt <> hyp group by engine")
def h7_without_marks(spark: SparkSession, root: str) -> DataFrame:
    """Readings that differ in vowel signs and nuktas alone."""
    d = readings(spark, root).where("gt <> hyp").select("engine", text.without_marks(F.col("gt")).alias("a"), text.without_marks(F.col("hyp")).alias("b"))
    return d.groupBy("engine").agg(F.count_if(F.col("a") == F.col("b")).alias("marks_only"), F.count(F.lit(1)).alias("n"))


@query(f"with {READINGS} select language, sum(case when {ws_sql('gt')} = '' then 0 else len(string_split({ws_sql('gt')}, ' ')) end)::bigint as words from readings group by language")
def h8_words(spark: SparkSession, root: str) -> DataFrame:
    return readings(spark, root).groupBy("language").agg(F.sum(F.size(text.words(F.col("gt")))).alias("words"))


_SIGNALS = f"{READINGS}, {TEXTS}, {signals_sql('texts')}"


@query(f"with recursive {_SIGNALS} select label, repeated, count(*) as n from readings join texts using (gt, hyp) join signals using (k) group by all")
def h9_repeated_text(spark: SparkSession, root: str) -> DataFrame:
    d = readings(spark, root).select("label", text.repeated_text(F.col("gt"), F.col("hyp")).alias("repeated"))
    return d.groupBy("label", "repeated").agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {_SIGNALS} select engine, misread, count(*) as n from readings join texts using (gt, hyp) join signals using (k) where gt <> hyp group by all")
def h12_misread_signal(spark: SparkSession, root: str) -> DataFrame:
    d = readings(spark, root).where("gt <> hyp").select("engine", text.misread(F.col("gt"), F.col("hyp")).alias("misread"))
    return d.groupBy("engine", "misread").agg(F.count(F.lit(1)).alias("n"))


_H13 = f"""{READINGS}, {TEXTS}, pairs as materialized (select k, {clusters_sql('gt')} as a, {clusters_sql('hyp')} as b from texts), {distance_sql('pairs', 'whole')}, heads as materialized (select k, a[1:len(b)] as a, b from pairs), {distance_sql('heads', 'head')},
  s as (select k, case when len(a) = 0 then (len(b) = 0)::int else greatest(0, 1 - w.dist / len(a)) end as acc, case when len(b) = 0 then (len(a) = 0)::int else greatest(0, 1 - h.dist / len(b)) end as emitted,
    case when len(a) = 0 then 1.0 else list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) / len(a) end as cov from pairs join whole w using (k) join head h using (k)),
  f as (select engine, acc, emitted, cov from readings join texts using (gt, hyp) join s using (k))"""


@query(f"with recursive {_H13} select engine, round(avg(acc), 9) as char_acc, round(avg(emitted), 9) as emitted_acc, round(avg(cov), 9) as coverage, round(avg(emitted - (1 - cov)), 9) as reward, round(avg(emitted), 9) as reward_lambda0 from f group by engine")
def h13_emitted_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy against the whole truth, and against as much of it as was emitted; reward with its coverage penalty."""
    d = readings(spark, root).select("engine", text.graphemes(F.col("gt")).alias("g"), text.graphemes(F.col("hyp")).alias("h"), text.covered(F.col("gt"), F.col("hyp")).alias("covered"))
    g, h = F.col("g"), F.col("h")
    d = d.select("engine", text.char_accuracy(g, h).alias("whole"), text.emitted_accuracy(g, h).alias("emitted"), "covered")
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    e, c = F.col("emitted"), F.col("covered")
    return d.groupBy("engine").agg(mean("whole", "char_acc"), mean("emitted", "emitted_acc"), mean("covered", "coverage"), mean(text.reward(e, c), "reward"), mean(text.reward(e, c, penalty=0.0), "reward_lambda0"))


_COVER = "case when len(g) = 0 then 1.0 else list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))) / len(g) end"
_H14 = f"""{READINGS}, t as materialized (select row_number() over () as k, gt, substr(gt, 1, length(gt) // 2) as easy from (select distinct gt from readings where length(gt) > 1)),
  w as materialized (select k, gt, {clusters_sql('gt')} as g, {clusters_sql('easy')} as e, {clusters_sql("easy || ' ' || repeat('x', greatest(1, length(gt) - length(easy)))")} as f from t),
  parts as materialized (select k, g[1:len(e)] as a, e as b from w), {distance_sql('parts', 'part')}, wholes as materialized (select k, g[1:len(f)] as a, f as b from w), {distance_sql('wholes', 'wide')},
  s as (select gt, greatest(0, 1 - p.dist / len(e)) as part, greatest(0, 1 - d.dist / len(f)) as full_acc, {_COVER.format(b='e')} as ce, {_COVER.format(b='f')} as cf from w join part p using (k) join wide d using (k))"""


@query(f"with recursive {_H14} select language, count(*) as n, count(*) filter (where part > full_acc - 1e-9 and ce < cf) as beats, count(*) filter (where ce < 1) as punished from readings join s using (gt) group by language")
def h14_omission_signal(spark: SparkSession, root: str) -> DataFrame:
    """How often leaving out the second half of a text would pay, and how often the coverage term lowers its reward."""
    d = readings(spark, root).where(F.char_length("gt") > 1)
    o = text.omission(F.col("gt"), F.expr("substring(gt, 1, cast(floor(char_length(gt) / 2) as int))"))
    return d.select("language", o.alias("o")).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if("o.beats").alias("beats"), F.count_if("o.punished").alias("punished"))


@query(f"""with f as (select ch, count(*) as n from (select unnest({clusters_sql('text')}) as ch from line_gt where text is not null) where ch <> '' group by ch), v as (select ch, row_number() over (order by n desc, ch) + 3 as id from f where n >= 2),
  t as (select probe_id, unnest({clusters_sql('ground_truth')}) as ch from sarvam_transfer_probe where ground_truth is not null) select probe_id, sum(coalesce(id, 3))::bigint + 3 as id_sum, count(*) + 2 as n, count(*) filter (where id is null) as rare from t left join v using (ch) where t.ch <> '' group by probe_id""")
def h15_encode(spark: SparkSession, root: str) -> DataFrame:
    """Texts as ids of a trained vocabulary, unknown characters as the rare id, between start and end."""
    from lipika.operators.ordering import numbered

    f = load(spark, root, "line_gt").where("text is not null").select(F.explode(text.graphemes(F.col("text"))).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    v = numbered(f.where("n >= 2"), [], [F.col("n").desc(), F.col("ch")], "k").select("ch", (F.col("k") + 3).alias("id"))
    t = load(spark, root, "sarvam_transfer_probe").where("ground_truth is not null").select("probe_id", F.explode(text.graphemes(F.col("ground_truth"))).alias("ch")).where("ch <> ''")
    return t.join(v, "ch", "left").groupBy("probe_id").agg((F.sum(F.coalesce("id", F.lit(3))) + 3).alias("id_sum"), (F.count(F.lit(1)) + 2).alias("n"), F.count_if(F.col("id").isNull()).alias("rare"))


@query("select probe_id, ('0x' || substr(sha256(image_path), 1, 8))::bigint as seed, ('0x' || substr(md5(image_path), 1, 8))::bigint as draw, sha256(image_path) as digest from sarvam_transfer_probe")
def h18_stable_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Per-key seeds and content digests."""
    p = F.col("image_path")
    return load(spark, root, "sarvam_transfer_probe").select("probe_id", text.stable_seed(p).alias("seed"), text.stable_int(p).alias("draw"), F.sha2(p, 256).alias("digest"))


@query(f"""with t as (select {clusters_sql('ground_truth')} as t from sarvam_transfer_probe where ground_truth is not null and ground_truth <> ''), p as (select list_concat(['<BOS>', '<BOS>', '<BOS>', '<BOS>'], t, ['<EOS>']) as f, len(t) as n from t),
  e as (select array_to_string(f[i + 1:i + 4], chr(1)) as ctx, f[i + 5] as tok from (select f, unnest(range(0, n + 1)) as i from p)) select count(*) as events, count(distinct ctx) as contexts, count(distinct ctx || chr(2) || tok) as pairs from e""")
def h16_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Five-gram contexts of texts, padded at the start and closed at the end."""
    from lipika.operators.joins import ngrams

    e = load(spark, root, "sarvam_transfer_probe").where("ground_truth <> ''").select(F.explode(ngrams(text.graphemes(F.col("ground_truth")), 5)).alias("e")).select("e.ctx", "e.tok")
    return e.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("ctx").alias("contexts"), F.count_distinct(F.concat_ws("\u0002", "ctx", "tok")).alias("pairs"))
