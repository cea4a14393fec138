"""C: joins over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import text
from lipika.operators import joins
from lipika.plans.registry import query
from lipika.plans.views import CALLS, KEY, LATEST, PANEL, READINGS, READS, calls, clusters_read, clusters_sql, lab, last_readings, panel, readings
from lipika.session import load

_IMG = ["language", "image_id"]


@query(f"""with {LATEST}, {CALLS}, truth as (select script as language, image_id, min(ground_truth) as truth from calls where condition = 'real' and ground_truth is not null group by all)
  select engine, count(*) as n, count(*) filter (where gt = truth) as same from latest join truth using (language, image_id) group by engine""")
def c1_truth_join(spark: SparkSession, root: str) -> DataFrame:
    """Readings with the ground truth of their image, by language and id."""
    truth = calls(spark, root).where("condition = 'real' and ground_truth is not null").groupBy(F.col("script").alias("language"), "image_id").agg(F.min("ground_truth").alias("truth"))
    return last_readings(spark, root).join(truth, _IMG).groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") == F.col("truth")).alias("same"))


@query(f"""with {LATEST}, notes as (select engine, language, image_id, variant, max(label) as note from readings where label is not null group by all)
  select coalesce(note, 'none') as note, count(*) as n from latest l left join notes t on l.engine = t.engine and l.language is not distinct from t.language and l.image_id is not distinct from t.image_id and l.variant is not distinct from t.variant group by 1""")
def c2_label_left_join(spark: SparkSession, root: str) -> DataFrame:
    r = readings(spark, root).where("label is not null").groupBy(*KEY).agg(F.max("label").alias("note"))
    last = last_readings(spark, root)
    on = F.lit(True)
    for c in KEY:
        on &= last[c].eqNullSafe(r[c])
    return last.join(r, on, "left").groupBy(F.coalesce("note", F.lit("none")).alias("note")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {READINGS}, tasks as (select distinct engine, language, image_id, variant from readings where batch_no > 6), done as (select engine, language, image_id, variant from readings where batch_no <= 6)
  select engine, count(*) as n from tasks t where not exists (select 1 from done d where d.engine = t.engine and d.language = t.language and d.image_id = t.image_id and d.variant = t.variant) group by engine""")
def c3_resume_anti_join(spark: SparkSession, root: str) -> DataFrame:
    """Keys that only later batches bring."""
    r = readings(spark, root)
    return joins.resume(r.where("batch_no > 6").select(*KEY).distinct(), r.where("batch_no <= 6"), KEY).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PANEL} select unit, round(max(value) filter (where rep = 'click'), 6) as click, round(max(value) filter (where rep = 'error'), 6) as error, round(max(value) filter (where rep = 'view'), 6) as view from panel group by unit")
def c4_panel_pivot(spark: SparkSession, root: str) -> DataFrame:
    """One row a unit, with its repetitions side by side; units that lack one are left out."""
    return panel(spark, root).groupBy("unit").pivot("rep", ["click", "error", "view"]).agg(F.round(F.max("value"), 6))


@query(f"""with {READINGS}, p as (select engine, language, image_id, avg(length(hyp)) as v from readings where variant = 'plain' group by all), d as (select engine, language, image_id, avg(length(hyp)) as v from readings where variant = 'degraded' group by all)
  select engine, count(*) as pairs, round(avg(p.v - d.v), 6) as mean_diff from p join d using (engine, language, image_id) group by engine""")
def c5_paired_conditions(spark: SparkSession, root: str) -> DataFrame:
    """Plain and degraded readings of an image, paired within an engine."""
    r = readings(spark, root)
    by = ["engine", "language", "image_id"]
    side = lambda v: r.where(F.col("variant") == v).groupBy(*by).agg(F.avg(F.char_length("hyp")).alias(v))
    return side("plain").join(side("degraded"), by).groupBy("engine").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("plain") - F.col("degraded")), 6).alias("mean_diff"))


@query(f"""with {READINGS}, {CALLS}, h as (select language, image_id, avg(case when bucket = 'GENUINE' then 1.0 else 0.0 end) as difficulty from readings where language is not null and image_id is not null group by all having count(distinct engine) >= 2),
  c as (select script as language, image_id, avg(confidence) as confidence from calls where condition = 'real' and confidence is not null group by all)
  select language, count(*) as n, round(avg(difficulty), 6) as difficulty, round(avg(confidence), 6) as confidence from h join c using (language, image_id) group by language""")
def c6_cohort(spark: SparkSession, root: str) -> DataFrame:
    """Difficulty of images read by at least two engines against the external confidence."""
    h = readings(spark, root).dropna(subset=_IMG).groupBy(*_IMG).agg(F.avg((F.col("bucket") == "GENUINE").cast("double")).alias("difficulty"), F.count_distinct("engine").alias("k")).where("k >= 2")
    c = calls(spark, root).where("condition = 'real' and confidence is not null").groupBy(F.col("script").alias("language"), "image_id").agg(F.avg("confidence").alias("confidence"))
    return h.join(c, _IMG).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difficulty"), 6).alias("difficulty"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"""with {READINGS}, {CALLS}, s as (select language, image_id, count(*) as k from readings where engine = 'surya' group by all), t as (select language, image_id, avg(length(hyp)) as tess from readings where engine = 'tesseract' group by all),
  c as (select script as language, image_id, max(confidence) as confidence from calls where condition = 'real' group by all)
  select language, count(*) as n, count(tess) as with_fallback, round(sum(confidence), 5) as conf from s join c using (language, image_id) left join t using (language, image_id) group by language""")
def c7_cascade_rows(spark: SparkSession, root: str) -> DataFrame:
    """Three-way rows: inner with the confidence, left with the fallback engine."""
    r = readings(spark, root)
    s = r.where("engine = 'surya'").groupBy(*_IMG).agg(F.count(F.lit(1)).alias("k"))
    t = r.where("engine = 'tesseract'").groupBy(*_IMG).agg(F.avg(F.char_length("hyp")).alias("tess"))
    c = calls(spark, root).where("condition = 'real'").groupBy(F.col("script").alias("language"), "image_id").agg(F.max("confidence").alias("confidence"))
    return s.join(c, _IMG).join(t, _IMG, "left").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count("tess").alias("with_fallback"), F.round(F.sum("confidence"), 5).alias("conf"))


_BASE = "list_last(string_split(replace(image_path, '\\', '/'), '/'))"


@query(f"select count(*) as n from line_gt where {_BASE} in (select {_BASE} from sarvam_transfer_probe) or contains(image_path, 'raw/hindi')")
def c8_leakage_check(spark: SparkSession, root: str) -> DataFrame:
    """Training lines whose file is among the held-out ones."""
    return joins.leaking(load(spark, root, "line_gt"), load(spark, root, "sarvam_transfer_probe"), "image_path", "raw/hindi").agg(F.count(F.lit(1)).alias("n"))


@query("""with flagged as (select l.line_id, l.text in (select ground_truth from error_taxonomy where ground_truth is not null) as seen from line_gt l where l.text is not null)
  select seen, count(*) as n from flagged group by seen""")
def c9_verbatim_split(spark: SparkSession, root: str) -> DataFrame:
    """Lines whose text occurs verbatim among the taxonomy's texts, and those whose doesn't."""
    known = load(spark, root, "error_taxonomy").select(F.col("ground_truth").alias("text")).dropna().distinct().withColumn("hit", F.lit(True))
    return load(spark, root, "line_gt").select("text").dropna().join(known, "text", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("seen")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, count(distinct text) as texts from line_gt where text is not null and text not in (select ground_truth from sarvam_transfer_probe where ground_truth is not null)")
def c10_train_minus_eval(spark: SparkSession, root: str) -> DataFrame:
    held = load(spark, root, "sarvam_transfer_probe").select(F.col("ground_truth").alias("text")).dropna().distinct()
    return load(spark, root, "line_gt").select("text").dropna().join(held, "text", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"))


@query("""with r as (select source_id, page_index, r.name as name, r.y as y from (select source_id, page_index, unnest(regions) as r from layout_bank))
  select count(*) as pairs, round(avg(abs(a.y - b.y)), 6) as mean_gap from r a join r b on a.source_id = b.source_id and a.page_index = b.page_index and a.name < b.name""")
def c11_unordered_pairs(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of regions of a page: pairs within one page's few regions only."""
    r = load(spark, root, "layout_bank").select("source_id", "page_index", F.inline("regions")).select("source_id", "page_index", "name", "y")
    b = r.select("source_id", "page_index", F.col("name").alias("name_b"), F.col("y").alias("y_b"))
    return r.join(b, ["source_id", "page_index"]).where("name < name_b").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.abs(F.col("y") - F.col("y_b"))), 6).alias("mean_gap"))


@query(f"""with {READINGS}, a as (select language, length(gt) as len, row_no, row_number() over (partition by language, length(gt) order by row_no) as rn from readings where engine = 'surya'),
  b as (select language, length(gt) as len, row_no, row_number() over (partition by language, length(gt) order by row_no) as rn from readings where engine = 'paddleocr')
  select a.language, count(*) as pairs, sum(a.row_no)::bigint as row_a, sum(b.row_no)::bigint as row_b from a join b on a.language = b.language and a.len = b.len and a.rn = b.rn group by a.language""")
def c12_length_matched(spark: SparkSession, root: str) -> DataFrame:
    """Readings of two engines matched one to one by exact length, in row order."""
    r = readings(spark, root).where("language is not null").select("engine", "language", F.char_length("gt").alias("len"), "row_no")
    m = joins.length_matched(r.where("engine = 'surya'").drop("engine"), r.where("engine = 'paddleocr'").drop("engine"), "len", [F.col("row_no")], ["language"])
    return m.groupBy("language").agg(F.count(F.lit(1)).alias("pairs"), F.sum("row_no").alias("row_a"), F.sum("row_no_b").alias("row_b"))


@query("""with r as (select lab, probe_id, row_number() over (partition by lab order by md5(probe_id::varchar), probe_id) as rn, count(*) over (partition by lab) as n from (select lower(trim(condition)) as lab, probe_id from sarvam_transfer_probe))
  select a.probe_id, b.probe_id as paired_probe_id from r a join r b on a.lab = b.lab and b.rn = a.rn % a.n + 1 where a.n > 1""")
def c13_derangement(spark: SparkSession, root: str) -> DataFrame:
    """Every call paired with another of its condition, in one cycle by hash order."""
    d = load(spark, root, "sarvam_transfer_probe").select(F.lower(F.trim("condition")).alias("lab"), "probe_id")
    return joins.deranged(d, ["lab"], [F.md5(F.col("probe_id").cast("string")), F.col("probe_id")], ["probe_id"]).select("probe_id", "paired_probe_id")


_REG = "select layout_id, r.* from (select layout_id, unnest(regions) as r from layout_bank)"


@query(f"""with r as ({_REG}), h as (select layout_id, reading_order as col, x as x0, x + width as x1 from r where reading_order <= 2), c as (select layout_id, name, reading_order, x as x0, x + width as x1 from r where reading_order > 2),
  s as (select c.layout_id, c.name, c.reading_order, h.col, greatest(0.0, least(c.x1, h.x1) - greatest(c.x0, h.x0)) as o from c join h using (layout_id)),
  b as (select *, row_number() over (partition by layout_id, name, reading_order order by o desc, col) as rn from s) select col as bound, count(*) as n from b where rn = 1 group by col""")
def c14_interval_binding(spark: SparkSession, root: str) -> DataFrame:
    """Later regions bound to the first ones by largest horizontal overlap."""
    r = load(spark, root, "layout_bank").select("layout_id", F.inline("regions"))
    box = lambda d: d.select("layout_id", "name", F.col("reading_order").alias("col"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"))
    b = joins.bind_to_headers(box(r.where("reading_order > 2")), box(r.where("reading_order <= 2")), ["layout_id"])
    return b.groupBy("bound").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with r as ({_REG}), h as (select layout_id, reading_order as col, kind, x as x0, x + width as x1 from r where reading_order <= 2), c as (select layout_id, name, kind, x as x0, x + width as x1 from r where reading_order > 2),
  s as (select c.layout_id, c.name, c.kind, h.kind as hk, h.col, greatest(0.0, least(c.x1, h.x1) - greatest(c.x0, h.x0)) as o from c join h using (layout_id)), b as (select *, row_number() over (partition by layout_id, name order by o desc, col) as rn from s)
  select count(*) as n, count(*) filter (where kind = hk) as correct, round(count(*) filter (where kind = hk) / nullif(count(*), 0)::double, 6) as accuracy from b where rn = 1""")
def d36_binding_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """How often a region is bound to one of its own kind; null accuracy where nothing is bound."""
    r = load(spark, root, "layout_bank").select("layout_id", F.inline("regions"))
    box = lambda d: d.select("layout_id", "name", "kind", F.col("reading_order").alias("col"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"))
    heads = box(r.where("reading_order <= 2"))
    b = joins.bind_to_headers(box(r.where("reading_order > 2")).drop("col"), heads, ["layout_id"])
    k = b.join(heads.select("layout_id", F.col("col").alias("bound"), F.col("kind").alias("hk")), ["layout_id", "bound"])
    ok = F.count_if(F.col("kind") == F.col("hk"))
    return k.agg(F.count(F.lit(1)).alias("n"), ok.alias("correct"), F.round(F.try_divide(ok, F.count(F.lit(1))), 6).alias("accuracy"))


@query(f"with {LATEST} select engine, count(*) as n, sum(row_no)::bigint as row_sum from latest group by engine")
def c15_last_write_wins(spark: SparkSession, root: str) -> DataFrame:
    r = readings(spark, root)
    order = F.struct(F.coalesce("recorded_at", F.lit("1970-01-01").cast("timestamp")).alias("at"), F.col("row_no").alias("no"))
    return joins.last_write(r, KEY, order).groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("row_sum"))


@query(f"""with recursive {READS}, g as (select language, true_cluster, count(*) as exposure, count(*) filter (where true_cluster = predicted_cluster) as correct from readings join texts using (gt, hyp) join reads using (k) where language is not null group by all)
  select language, count(*) as glyphs, round(sum(correct) / sum(exposure), 6) as weighted from g group by language""")
def c16_exposure_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """How often a cluster is read right anywhere in a text, weighted by how often it is seen."""
    d = clusters_read(spark, root).where("language is not null").groupBy("language", "true_cluster")
    right = F.sum(F.when(F.col("true_cluster") == F.col("predicted_cluster"), F.col("n")).otherwise(0))
    g = d.agg(F.sum("n").alias("exposure"), right.alias("correct"))
    return g.groupBy("language").agg(F.count(F.lit(1)).alias("glyphs"), F.round(F.sum("correct") / F.sum("exposure"), 6).alias("weighted"))


_BEFORE = "case when {a}.y + 0.02 < {b}.y then true when {b}.y + 0.02 < {a}.y then false else {a}.x < {b}.x end"


@query(f"""with r as (select layout_id, i, regions[i].name as name, regions[i].x as x, regions[i].y as y from (select layout_id, regions, unnest(range(1, len(regions) + 1)) as i from layout_bank)),
  v as (select a.layout_id, a.i, a.name, count(*) filter (where b.i > a.i and {_BEFORE.format(a='a', b='b')} or b.i < a.i and not ({_BEFORE.format(a='b', b='a')})) as s from r a join r b on a.layout_id = b.layout_id group by all)
  select layout_id, string_agg(name, ',' order by s desc, name) as ord from v group by layout_id""")
def c17_order_votes(spark: SparkSession, root: str) -> DataFrame:
    """Reading order of a page's regions by pairwise votes."""
    blocks = F.transform("regions", lambda r: F.struct(r["name"].alias("id"), r["x"].alias("x"), r["y"].alias("y")))
    return load(spark, root, "layout_bank").where(F.size("regions") > 0).select("layout_id", F.array_join(joins.votes_order(blocks), ",").alias("ord"))


@query(f"""with p as (select distinct {lab('script')} as script, lower(trim(mode)) as mode, coalesce(page_idx, try_cast(regexp_extract(stem, '([0-9]+)$', 1) as int)) as page_no from page_gt),
  l as (select distinct replace(regexp_extract(replace(image_path, '\\', '/'), 'line_crops/([a-z]+)/', 1), '\\', '') as script, regexp_extract(image_path, '([a-z]+)_page', 1) as mode, try_cast(regexp_extract(image_path, '_page([0-9]+)', 1) as int) as page_no from line_gt)
  select script, count(*) as missing from p where not exists (select 1 from l where l.script = p.script and l.mode = p.mode and l.page_no = p.page_no) group by script""")
def c18_missing_files(spark: SparkSession, root: str) -> DataFrame:
    """Pages for which no line crop exists."""
    k = ["script", "mode", "page_no"]
    from lipika.functions.labels import label

    p = load(spark, root, "page_gt").select(label("script").alias("script"), F.lower(F.trim("mode")).alias("mode"), F.coalesce("page_idx", F.regexp_extract("stem", r"([0-9]+)$", 1).try_cast("int")).alias("page_no")).distinct()
    l = load(spark, root, "line_gt").select(F.regexp_extract(F.replace("image_path", F.lit("\\"), F.lit("/")), r"line_crops/([a-z]+)/", 1).alias("script"), F.regexp_extract("image_path", r"([a-z]+)_page", 1).alias("mode"), F.regexp_extract("image_path", r"_page([0-9]+)", 1).try_cast("int").alias("page_no")).distinct()  # noqa: E741
    return p.join(l, k, "left_anti").groupBy("script").agg(F.count(F.lit(1)).alias("missing"))


@query(f"""with {READINGS}, {CALLS}, a as (select language, avg(length(gt)) as synth from readings where language is not null group by 1), b as (select script as language, avg(length(ground_truth)) as real from calls where condition = 'real' group by 1)
  select language, round(synth, 6) as synth, round(real, 6) as real, round(synth - real, 6) as gap from a left join b using (language)""")
def c19_domain_means(spark: SparkSession, root: str) -> DataFrame:
    """Means of two domains side by side; a domain may be missing."""
    a = readings(spark, root).where("language is not null").groupBy("language").agg(F.avg(F.char_length("gt")).alias("s"))
    b = calls(spark, root).where("condition = 'real'").groupBy(F.col("script").alias("language")).agg(F.avg(F.char_length("ground_truth")).alias("r"))
    return a.join(b, "language", "left").select("language", F.round("s", 6).alias("synth"), F.round("r", 6).alias("real"), F.round(F.col("s") - F.col("r"), 6).alias("gap"))


@query(f"""with {READINGS}, {CALLS}, a as (select distinct language, image_id from readings where variant = 'plain' and language is not null and image_id is not null), b as (select distinct language, image_id from readings where variant = 'degraded' and language is not null and image_id is not null),
  u as (select *, 'plain' as source from a union all select *, 'degraded' from b where (language, image_id) not in (select (language, image_id) from a))
  select source, count(*) as n from u where (language, image_id) not in (select (script, image_id) from calls where condition = 'real' and script is not null and image_id is not null) group by source""")
def c20_set_difference(spark: SparkSession, root: str) -> DataFrame:
    """Images not yet extracted: those with a plain variant first, then those with a degraded one only."""
    r = readings(spark, root).dropna(subset=_IMG)
    a = r.where("variant = 'plain'").select(*_IMG).distinct()
    b = r.where("variant = 'degraded'").select(*_IMG).distinct().join(a, _IMG, "left_anti")
    done = calls(spark, root).where("condition = 'real'").select(F.col("script").alias("language"), "image_id").dropna().distinct()
    u = a.withColumn("source", F.lit("plain")).unionByName(b.withColumn("source", F.lit("degraded")))
    return u.join(done, _IMG, "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with tr as (select {clusters_sql('text')} as t from line_gt where text is not null and text <> ''), v as (select count(distinct c) + 2 as v from (select unnest(t) as c from tr)),
  ev as (select case when i = 1 then '<BOS>' else t[i - 1] end as ctx, case when i = len(t) + 1 then '<EOS>' else t[i] end as tok from (select t, unnest(range(1, len(t) + 2)) as i from tr)),
  pc as (select ctx, tok, count(*) as c from ev group by all), cc as (select ctx, sum(c) as cc from pc group by ctx),
  te as (select probe_id, {clusters_sql('ground_truth')} as t from sarvam_transfer_probe where ground_truth is not null and ground_truth <> ''),
  e2 as (select probe_id, i - 1 as pos, case when i = 1 then '<BOS>' else t[i - 1] end as ctx, t[i] as tok from (select probe_id, t, unnest(range(1, len(t) + 1)) as i from te)),
  s as (select pos, ln((coalesce(c, 0) + 0.01) / (coalesce(cc, 0) + 0.01 * v)) as lp from e2 left join pc using (ctx, tok) left join cc using (ctx) cross join v)
  select case when pos = 0 then '0' when pos = 1 then '1' when pos <= 9 then '2-9' when pos <= 19 then '10-19' when pos <= 39 then '20-39' else '40+' end as bucket, count(*) as n, round(avg(lp), 6) as mean_log_p from s group by 1""")
def c21_ngram_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Bigram log-probabilities of held-out texts by position."""
    from lipika.operators.classify import position_bucket

    chars = lambda c: text.graphemes(F.col(c))
    train = load(spark, root, "line_gt").where("text <> ''").select(chars("text").alias("t"))
    events = load(spark, root, "sarvam_transfer_probe").where("ground_truth <> ''").select(F.explode(joins.ngrams(chars("ground_truth"), 2)).alias("e")).where("e.tok <> '<EOS>'")
    pairs = events.groupBy(position_bucket(F.col("e.pos")).alias("bucket"), "e.ctx", "e.tok").agg(F.count(F.lit(1)).alias("k"))
    s = joins.ngram_log_probs(train, pairs, "t", 2)
    return s.groupBy("bucket").agg(F.sum("k").alias("n"), F.round(F.sum(F.col("log_p") * F.col("k")) / F.sum("k"), 6).alias("mean_log_p"))


@query(f"""with recursive {READS} select true_cluster, predicted_cluster, count(*) as n from readings join texts using (gt, hyp) join reads using (k) where true_cluster <> predicted_cluster group by all""")
def c22_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Substitutions between truth and reading by global alignment of clusters, as aggregated edges."""
    from lipika.operators.alignment import substitutions

    r = readings(spark, root).where("gt <> hyp").select("row_no", text.graphemes(F.col("gt")).alias("a"), text.graphemes(F.col("hyp")).alias("b"))
    return substitutions(r, "a", "b").groupBy("true_cluster", "predicted_cluster").agg(F.count(F.lit(1)).alias("n"))


