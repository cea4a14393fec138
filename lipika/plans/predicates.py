"""B: projections, filters and classifications over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import text
from lipika.operators import classify
from lipika.plans.registry import query
from lipika.plans.views import CALLS, LATEST, READINGS, READS, TEXTS, calls, clusters_read, clusters_sql, glyphs_sql, last_readings, phonetic_sql, readings, signals_sql, tier1_sql, ws_sql
from lipika.session import load


@query(f"with {CALLS} select script, count(*) as n from calls where condition = 'real' and script = 'hindi' group by script")
def b1_equality_filter(spark: SparkSession, root: str) -> DataFrame:
    return calls(spark, root).where("condition = 'real' and script = 'hindi'").groupBy("script").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CALLS} select script, count(*) as n, round(avg(confidence), 6) as mean_conf from calls where confidence is not null and sarvam_text is not null and ground_truth is not null group by script")
def b2_null_aware_filter(spark: SparkSession, root: str) -> DataFrame:
    return calls(spark, root).dropna(subset=["confidence", "sarvam_text", "ground_truth"]).groupBy("script").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_conf"))


@query(f"with {CALLS} select count(*) as attempted, count(*) filter (where coalesce(sarvam_text, '') = '') as empty_kept from calls where coalesce(error, '') = ''")
def b3_not_attempted(spark: SparkSession, root: str) -> DataFrame:
    """Rows with a reason for skipping go; empty predictions stay and count."""
    kept = calls(spark, root).where("coalesce(error, '') = ''")
    return kept.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.coalesce("sarvam_text", F.lit("")) == "").alias("empty_kept"))


@query(f"with {READINGS} select engine, count(*) as n, sum(case when hyp = '' then 1 else 0 end)::bigint as empty, sum(length(hyp))::bigint as chars from readings group by engine")
def b4_defaults(spark: SparkSession, root: str) -> DataFrame:
    return readings(spark, root).groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("hyp") == "").cast("int")).alias("empty"), F.sum(F.char_length("hyp")).alias("chars"))


_STEM = r"([a-z]+)_page0*([0-9]+)_r0*([0-9]+)[.]png$"


@query(rf"""select nullif(regexp_extract(image_path, '{_STEM}', 1), '') as mode, count(*) as n, sum(try_cast(regexp_extract(image_path, '{_STEM}', 2) as bigint))::bigint as pages,
  count(distinct replace(regexp_extract(replace(image_path, '\', '/'), 'line_crops/([a-z]+)/', 1), '\', '')) as scripts from line_gt group by 1""")
def b5_path_columns(spark: SparkSession, root: str) -> DataFrame:
    """Mode, page and row from the path of a line; paths that don't match give null."""
    d = load(spark, root, "line_gt")
    part = lambda k: F.nullif(F.regexp_extract("image_path", _STEM, k), F.lit(""))
    script = F.regexp_extract(F.replace("image_path", F.lit("\\"), F.lit("/")), r"line_crops/([a-z]+)/", 1)
    return d.groupBy(part(1).alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.sum(part(2).try_cast("long")).alias("pages"), F.count_distinct(script).alias("scripts"))


@query(f"with {CALLS} select concat('data/raw/', script, '/images/', list_last(string_split(image_path, '/'))) as path, count(*) as n from calls where condition = 'real' group by 1")
def b6_canonical_path(spark: SparkSession, root: str) -> DataFrame:
    d = calls(spark, root).where("condition = 'real'")
    return d.groupBy(F.concat(F.lit("data/raw/"), "script", F.lit("/images/"), F.element_at(F.split("image_path", "/"), -1)).alias("path")).agg(F.count(F.lit(1)).alias("n"))


def _forms(df: DataFrame) -> DataFrame:
    return df.withColumns({"gt_form": text.tier1(F.col("gt")), "hyp_form": text.tier1(F.col("hyp"))})


_B7 = f"""{READINGS}, forms as (select *, {tier1_sql('gt')} as gt_form, {tier1_sql('hyp')} as hyp_form from readings)"""
_STRIP = r"regexp_replace({c}, '^{b}+|{b}+$', '', 'g')"


_SOUND = f"coalesce({phonetic_sql('gt', 'language')} = {phonetic_sql('hyp', 'language')}, false)"


@query(f"""with {_B7} select engine, language, case when gt_form = hyp_form and {_STRIP.format(c='gt', b=text.BLANKS)} = {_STRIP.format(c='hyp', b=text.BLANKS)} then 'EXACT' when gt_form = hyp_form then 'TIER1'
  when {_SOUND} then 'TIER2' when label is not null then 'GENUINE' else 'UNREVIEWED' end as outcome, count(*) as n from forms group by all""")
def b7_outcome_classifier(spark: SparkSession, root: str) -> DataFrame:
    """Readings classified anew from their texts, by engine and language."""
    d = _forms(readings(spark, root))
    o = classify.outcome(F.col("gt"), F.col("hyp"), F.col("gt_form"), F.col("hyp_form"), F.col("language"), F.col("label"), text.tier2(F.col("gt"), F.col("hyp"), F.col("language")))
    return d.groupBy("engine", "language", o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_B7} select language, case when {ws_sql('gt')} = {ws_sql('hyp')} then 'EXACT' when gt_form = hyp_form then 'TIER1' when {_SOUND} then 'TIER2' else 'UNEXPLAINED' end as outcome, count(*) as n from forms group by all""")
def b8_review_classifier(spark: SparkSession, root: str) -> DataFrame:
    d = _forms(readings(spark, root))
    o = classify.review_outcome(F.col("gt"), F.col("hyp"), F.col("gt_form"), F.col("hyp_form"), F.col("language"), text.tier2(F.col("gt"), F.col("hyp"), F.col("language")))
    return d.groupBy("language", o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {CALLS} select script, count(*) filter (where {tier1_sql("coalesce(ground_truth, '')")} = {tier1_sql("coalesce(sarvam_text, '')")}) as correct, count(*) as n from calls where condition = 'real' group by script""")
def b9_correctness_gate(spark: SparkSession, root: str) -> DataFrame:
    d = calls(spark, root).where("condition = 'real'")
    ok = text.tier1(F.coalesce("ground_truth", F.lit(""))) == text.tier1(F.coalesce("sarvam_text", F.lit("")))
    return d.withColumn("ok", ok).groupBy("script").agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("n"))


_RESIDUAL = f"""{READINGS}, {TEXTS}, other as materialized (select k, {ws_sql('gt')} as gt, {ws_sql('hyp')} as hyp from texts where {tier1_sql('gt')} <> {tier1_sql('hyp')}), {signals_sql('other')}"""


@query(f"""with recursive {_RESIDUAL} select label, case when o.gt = o.hyp then null when repeated then 'hallucinated-repeated-text' when reordered then 'reading-order-break' when dropped then 'dropped-matra-nukta' when misread then 'genuine-misread' end as suggested, count(*) as n
  from readings r join texts t on r.gt = t.gt and r.hyp = t.hyp join other o on t.k = o.k join signals s on o.k = s.k group by all""")
def b10_residual_label(spark: SparkSession, root: str) -> DataFrame:
    """Suggested labels for readings that no tier explains, against the recorded ones."""
    d = _forms(readings(spark, root)).where("gt_form <> hyp_form").withColumns({"gt": text.whitespace(F.col("gt")), "hyp": text.whitespace(F.col("hyp"))})
    d = d.withColumns({"gt_bare": text.without_marks(F.col("gt")), "hyp_bare": text.without_marks(F.col("hyp"))})
    s = classify.residual_label(F.col("gt"), F.col("hyp"), F.col("gt_bare"), F.col("hyp_bare"))
    return d.groupBy(F.col("label"), s.alias("suggested")).agg(F.count(F.lit(1)).alias("n"))


_NOTES = f"""{LATEST}, asked as (select engine, coalesce(label, case when length(hyp) > 40 then 's' else '' end) as typed, case when length(hyp) > 2 then 'genuine-misread' end as suggestion from latest),
  notes as (select *, case when lower(typed) in ('s', 'skip') or typed = '' and suggestion is null then 'skipped' when suggestion is not null and (typed = '' or typed = suggestion) then 'agent-suggested-and-confirmed' else 'human-overridden' end as outcome from asked)"""


def _notes(spark: SparkSession, root: str) -> DataFrame:
    """Last readings with the note of a reviewer who types the recorded label, skips long texts without one and else confirms the suggestion of a misreading."""
    n = F.char_length("hyp")
    typed = F.coalesce("label", F.when(n > 40, "s").otherwise(""))
    note = classify.review_note(typed, F.when(n > 2, "genuine-misread"))
    return last_readings(spark, root).select("engine", note.alias("note")).select("engine", "note.*")


@query(f"with {_NOTES} select outcome, count(*) as n from notes group by outcome")
def b11_review_outcome(spark: SparkSession, root: str) -> DataFrame:
    return _notes(spark, root).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_NOTES} select engine, count(*) filter (where outcome <> 'skipped') as adjudicated, count(*) as n from notes group by engine")
def b12_adjudicated(spark: SparkSession, root: str) -> DataFrame:
    return _notes(spark, root).groupBy("engine").agg(F.count_if(classify.adjudicated(F.col("label"), F.col("outcome"))).alias("adjudicated"), F.count(F.lit(1)).alias("n"))


_L = classify.LAYOUT
_T = "list_filter(regions, lambda r: coalesce(r.kind, '') = 'table')"
_C = f"list_transform(list_filter(regions, lambda r: coalesce(r.kind, '') = 'text' and r.width >= {_L['body_width']} and r.height >= {_L['body_height']}), lambda r: r.x + r.width / 2)"


@query(f"""select case when len(list_filter(regions, lambda r: coalesce(r.kind, '') = 'form_field')) > 0 then 'form'
  when len(list_filter({_T}, lambda r: r.height >= {_L['table_height']} and r.width >= {_L['table_width']})) > 0 or coalesce(list_sum(list_transform({_T}, lambda r: r.width * r.height)), 0) >= {_L['table_area']} then 'table-embedded'
  when len({_C}) >= 2 and list_max({_C}) - list_min({_C}) >= {_L['column_gap']} then 'two-column'
  when len(list_filter(regions, lambda r: coalesce(r.kind, '') = 'margin' or ((r.x < {_L['left_edge']} or r.x + r.width > {_L['right_edge']}) and r.width < {_L['margin_width']} and r.height > {_L['margin_height']}))) > 0 then 'marginalia'
  else 'single-column' end as derived, count(*) as n from layout_bank group by 1""")
def b13_layout_category(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "layout_bank").groupBy(classify.layout_category(F.col("regions")).alias("derived")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {READS}, ends as (select true_cluster as a, coalesce(predicted_cluster, '') as b from readings join texts using (gt, hyp) join reads using (k)),
  o as (select a, b, ord(a) as x, ord(b) as y from ends), z as (select *, x between 2304 and 2431 and y between 2304 and 2431 as deva from o)
  select case when a = '' or b = '' then 'empty' when a = b then 'identical' when x = y and length(a) <> length(b) then 'same-base-matra-diff' when x = y then 'same-base' when deva and abs(x - y) <= {classify.NEIGHBOURS} then 'adjacent-codepoint'
  when deva then 'both-devanagari' else 'dissimilar' end as tag, count(*) as n from z group by 1""")
def b14_confusion_tag(spark: SparkSession, root: str) -> DataFrame:
    """How each cluster of a text and what it is read as are alike; 'empty' if it is read as nothing."""
    return clusters_read(spark, root).groupBy(classify.confusion_tag(F.col("true_cluster"), F.col("predicted_cluster")).alias("tag")).agg(F.sum("n").alias("n"))


@query("""select case when line_index = 0 then '0' when line_index = 1 then '1' when line_index between 2 and 9 then '2-9' when line_index between 10 and 19 then '10-19'
  when line_index between 20 and 39 then '20-39' when line_index >= 40 then '40+' end as bucket, count(*) as n from line_gt group by 1""")
def b15_range_bucket(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "line_gt").groupBy(classify.position_bucket(F.col("line_index")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_CURVE = """curve as (select user_id, count(*) as k, arg_min(value, struct_pack(a := ts, b := event_id)) as first_v, arg_max(value, struct_pack(a := ts, b := event_id)) as last_v from events where value is not null group by user_id)"""


@query(f"""with {_CURVE} select case when k < 2 then 'insufficient' when last_v > 0 and first_v / last_v >= 100 and abs((last_v - first_v) / 1000) < 0.05 then 'a' when (last_v - first_v) / 1000 > 0.05 then 'b'
  when last_v > 0 and first_v / last_v < 10 then 'modest' else 'undecided' end as reading, count(*) as n from curve group by 1""")
def b16_curve_interpretation(spark: SparkSession, root: str) -> DataFrame:
    """First against last value of each user's events."""
    e = load(spark, root, "events").where("value is not null")
    at = F.struct("ts", "event_id")
    c = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), F.min_by("value", at).alias("first_v"), F.max_by("value", at).alias("last_v"))
    return c.groupBy(classify.curve_reading(F.col("k"), F.col("first_v"), F.col("last_v"), (F.col("last_v") - F.col("first_v")) / 1000).alias("reading")).agg(F.count(F.lit(1)).alias("n"))


_FEAS = f"""{READINGS}, g as (select language, avg((bucket = 'TIER1')::int) filter (where engine = 'tesseract') as a, avg((bucket = 'TIER1')::int) filter (where engine = 'surya') as b, avg((bucket = 'TIER1')::int) filter (where engine = 'paddleocr') as c from readings group by language),
  t as (select language, engine, glyph from (select language, engine, unnest({glyphs_sql('gt')}) as glyph from readings) group by all having count(*) >= 5),
  i as (select language, count(*) filter (where k >= 2) as common from (select language, glyph, count(*) as k from t group by all) group by language)"""


@query(f"""with {_FEAS} select g.language, array_to_string(list_filter([case when coalesce(a, 0) < 0.05 then 'natural below 5 %' end, case when coalesce(b, 1) < 0.02 and coalesce(c, 1) < 0.02 then 'flattened and inverted below 2 %' end,
  case when coalesce(b, 0) < 0.05 then 'flattened below 5 %' end, case when common < 50 then 'fewer than 50 in common' end], lambda x: x is not null), '; ') as reasons from (select g.language, a, b, c, coalesce(common, 0) as common from g left join i on g.language is not distinct from i.language) g""")
def b17_feasibility(spark: SparkSession, root: str) -> DataFrame:
    """Reasons against comparing three conditions (the engines stand for them) within a language; glyphs seen five times in two of them are in common."""
    r = readings(spark, root)
    acc = lambda e: F.avg(F.when(F.col("engine") == e, (F.col("bucket") == "TIER1").cast("double")))
    g = r.groupBy("language").agg(acc("tesseract").alias("a"), acc("surya").alias("b"), acc("paddleocr").alias("c"))
    t = r.select("language", "engine", F.explode(text.glyph_clusters(F.col("gt"))).alias("glyph")).groupBy("language", "engine", "glyph").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    i = t.groupBy("language", "glyph").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("language").alias("l")).agg(F.count_if(F.col("k") >= 2).alias("common"))
    common = F.coalesce("common", F.lit(0))
    return g.join(F.broadcast(i), g.language.eqNullSafe(i.l), "left").select("language", F.array_join(classify.feasibility(F.col("a"), F.col("b"), F.col("c"), common), "; ").alias("reasons"))


@query(f"""with {READINGS}, c as (select language, unnest({clusters_sql('gt')}) as ch from readings)
  select language, case when trim(ch) = '' then 'other' when regexp_matches(ch, '[\\x{{0900}}-\\x{{097f}}]') then 'trained' when regexp_matches(ch, '[\\x{{0980}}-\\x{{09ff}}]') then 'image' else 'other' end as cls, count(*) as n from c where ch <> '' group by all""")
def b18_script_class(spark: SparkSession, root: str) -> DataFrame:
    c = readings(spark, root).select("language", F.explode(text.graphemes(F.col("gt"))).alias("ch")).where("ch <> ''")
    return c.groupBy("language", classify.script_class(F.col("ch"), r"[ऀ-ॿ]", r"[ঀ-৿]").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {READINGS}, s as (select language, batch_no, avg(case when bucket = 'GENUINE' then 1.0 else 0.0 end) as rate from readings group by all)
  select language, bool_and(rate > 0.2) as replicates, bool_or(rate > 0.2) and not bool_and(rate > 0.2) as retracted from s group by language""")
def b19_replication_flags(spark: SparkSession, root: str) -> DataFrame:
    """Whether the share of genuine errors is above a fifth in every batch, or only in some."""
    s = readings(spark, root).groupBy("language", "batch_no").agg(F.avg((F.col("bucket") == "GENUINE").cast("double")).alias("rate"))
    over = F.col("rate") > 0.2
    return s.groupBy("language").agg(F.bool_and(over).alias("replicates"), (F.bool_or(over) & ~F.bool_and(over)).alias("retracted"))


@query(f"""with {READINGS}, want as (select distinct language, image_id from readings where language is not null and image_id is not null), {CALLS},
  done as (select distinct script as language, image_id from calls where condition = 'real' and sarvam_text is not null), cached as (select distinct script as language, image_id from calls where condition = 'real' and cached)
  select case when d.image_id is not null then 'done' when c.image_id is not null then 'cached' else 'new' end as state, count(*) as n
  from want w left join done d using (language, image_id) left join cached c using (language, image_id) group by 1""")
def b20_spend_gate(spark: SparkSession, root: str) -> DataFrame:
    """Images done, cached or new: what another run would cost."""
    want = readings(spark, root).select("language", "image_id").dropna().distinct()
    real = calls(spark, root).where("condition = 'real'").withColumnRenamed("script", "language")
    key = ["language", "image_id"]
    seen = real.groupBy(*key).agg(F.bool_or(F.col("sarvam_text").isNotNull()).alias("done"), F.bool_or(F.coalesce("cached", F.lit(False))).alias("cached"))
    state = F.when(F.coalesce("done", F.lit(False)), "done").when(F.coalesce("cached", F.lit(False)), "cached").otherwise("new")
    return want.join(seen, key, "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))



