"""The pN_ queries over the intended tables, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from lipika.llm import contamination, grouped_split, lookalikes, packing, sentences, stable_sample
from lipika.llm.proportions import ProportionalSample
from lipika.session import load, shared_dir


def _proportions(spark: SparkSession, root: str) -> ProportionalSample:
    return ProportionalSample(load(spark, root, "error_taxonomy"), load(spark, root, "sample_targets"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _proportions(spark, root).unmet()


def p1_sample(spark: SparkSession, root: str) -> DataFrame:
    return _proportions(spark, root).sample()


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    return _proportions(spark, root).report()


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return grouped_split.tied(load(spark, root, "page_gt"), load(spark, root, "layout_bank"))


def p2_splits(spark: SparkSession, root: str) -> DataFrame:
    return grouped_split.assign(load(spark, root, "page_gt"), load(spark, root, "line_gt"), load(spark, root, "layout_bank"))


def p2_balance(spark: SparkSession, root: str) -> DataFrame:
    return grouped_split.balance(load(spark, root, "page_gt"), load(spark, root, "line_gt"), load(spark, root, "layout_bank"))


def _images(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, root, "error_taxonomy"), load(spark, root, "sarvam_transfer_probe"), load(spark, root, "prior_sample")


def _registry(spark: SparkSession, root: str, name: str) -> stable_sample.Registry:
    """The registry of a folder of tables: one place in the shared folder, which a later session finds again."""
    folder = hashlib.md5(f"{root.rstrip('/')}|{name}".encode()).hexdigest()[:12]
    return stable_sample.Registry(spark, f"{shared_dir(spark).rstrip('/')}/lipika-registry/{folder}")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return stable_sample.kept(*_images(spark, root), registry=_registry(spark, root, "found"))


def p3_sample(spark: SparkSession, root: str) -> DataFrame:
    return stable_sample.grown(*_images(spark, root), _registry(spark, root, "sample"), until=6)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.same_looking(load(spark, root, "sarvam_transfer_probe"), load(spark, root, "page_gt"))


def p4_texts(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.normalised(load(spark, root, "sarvam_transfer_probe"), load(spark, root, "page_gt"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return packing.split_documents(load(spark, root, "documents"))


def p5_pack(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(load(spark, root, "documents"))


def p5_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.containers(load(spark, root, "documents"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return contamination.leaks(load(spark, root, "documents"), load(spark, root, "eval_items"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(load(spark, root, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_texts, p5_found, p5_pack, p5_containers, p6_found, p7_found, p1_found, p1_sample, p1_report, p2_found, p2_splits, p2_balance, p3_found, p3_sample)}


_LABEL = r"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"
_KEY = r"nullif(regexp_replace(regexp_replace({c}, '\s+', '', 'g'), '^0+(.)', '\1'), '')"

_P1 = f"""
with r as (select coalesce({_LABEL.format(c='engine')}, 'tesseract') as engine, {_LABEL.format(c='language')} as language,
  {_KEY.format(c='image_id')} as image_id, {_LABEL.format(c='variant')} as variant, min(row_no) as row_no from error_taxonomy group by 1, 2, 3, 4),
c as (select engine, language, variant, count(*) as n from r group by all),
w as (select target_id, plan_name, coalesce(plan_size, 0) as size, {_LABEL.format(c='engine')} as e, {_LABEL.format(c='language')} as l, {_LABEL.format(c='variant')} as v,
  greatest(coalesce(target_share, 0), 0) as share, coalesce(min_rows, 0) as floor_rows, greatest(coalesce(min_rows, 0), round(coalesce(target_share, 0) * coalesce(plan_size, 0)))::bigint as wanted from sample_targets),
t as (select w.*, coalesce(x.n, 0)::bigint as available from w left join (
  select target_id, sum(n) as n from w join c on (e is null or e = c.engine) and (l is null or l = c.language) and (v is null or v = c.variant) group by 1) x using (target_id)),
b as (select *, least(floor_rows, available)::double as lo, case when share > 0 then available else least(floor_rows, available) end::double as hi from t),
turn as (select distinct plan_name, unnest([lo / share, hi / share]) as f from b where share > 0),
reach as (select plan_name, f from turn join b using (plan_name) group by plan_name, f having sum(greatest(lo, least(f * share, hi))) <= max(size) + 1e-6),
f0 as (select plan_name, coalesce(max(f), 0) as f0 from (select distinct plan_name from b) left join reach using (plan_name) group by 1),
rise as (select plan_name, f0, sum(case when share > 0 and lo <= f0 * share + 1e-6 and f0 * share < hi - 1e-6 then share else 0 end) as up, max(size) - sum(greatest(lo, least(f0 * share, hi))) as gap from b join f0 using (plan_name) group by 1, 2),
x as (select b.*, greatest(lo, least((f0 + case when up > 0 then greatest(gap, 0) / up else 0 end) * share, hi)) as exact from b join rise using (plan_name)),
y as (select *, floor(exact + 1e-6) as base, least(size, round(sum(exact) over (partition by plan_name), 6)) - sum(floor(exact + 1e-6)) over (partition by plan_name) as more from x),
z as (select *, base + (base < hi and row_number() over (partition by plan_name order by base < hi desc, round(exact - base, 6) desc, target_id) <= floor(more))::int as quota from y)
"""
_P1_REPORT = _P1 + "select target_id, plan_name, wanted, available, quota::bigint as quota, available >= wanted as met, available <= wanted as exhausted from z"
_P1_SAMPLE = _P1 + """, d as (select z.plan_name, z.target_id, z.quota, r.*, row_number() over (partition by z.target_id
  order by ('0x' || substr(md5(concat_ws('|', '0', r.engine, coalesce(r.language, '-'), coalesce(r.image_id, '-'), coalesce(r.variant, '-'))), 1, 15))::bigint, r.row_no) as k
  from r join z on (z.e is null or z.e = r.engine) and (z.l is null or z.l = r.language) and (z.v is null or z.v = r.variant))
select plan_name, target_id, engine, language, variant, image_id, row_no from d where k <= quota"""

_P3_SEEN = f"""
with p as (select distinct {_LABEL.format(c='language')} as language, {_KEY.format(c='image_id')} as image_id from prior_sample),
e as (select distinct {_LABEL.format(c='language')} as language, {_KEY.format(c='image_id')} as image_id, batch_no from error_taxonomy),
seen as (select language, image_id from e
  union select coalesce({_LABEL.format(c='script')}, lower(regexp_extract(image_path, '([^/]+)/images/', 1))), coalesce({_KEY.format(c='image_id')}, {_KEY.format(c="regexp_extract(image_path, 'images/([0-9]+)_', 1)")})
  from sarvam_transfer_probe where lower(trim(condition)) = 'real')
"""
_P3 = _P3_SEEN + "select language, image_id from p semi join seen using (language, image_id)"
_P3_SAMPLE = _P3_SEEN + """, u as (select language, image_id, ('0x' || substr(md5(concat_ws('|', 'lipika-prn', language, image_id)), 1, 13))::bigint::double / 4503599627370496.0 as u from seen where language is not null and image_id is not null)
select language, image_id, case when p.language is not null then u * 0.1 else u end as value,
  case when p.language is not null then 'prior' when exists (select 1 from e where e.language = u.language and e.image_id = u.image_id and batch_no <= 6) then 'earlier' else 'later' end as first_seen
from u left join p using (language, image_id) where p.language is not null or u < 0.1"""

_FORM = r"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[<>]', ' ', 'g'), '(\p{{Nd}}+)', '<\1>', 'g'), '[^\p{{L}}\p{{Nd}}<>]', '', 'g')"
_P2 = f"""
with recursive pg as (select page_id, {_LABEL.format(c='script')} as s, {_LABEL.format(c='mode')} as m, coalesce(page_idx, try_cast(regexp_extract(stem, '([0-9]+)[^0-9]*$', 1) as int)) as n, layout_source from page_gt),
b as (select distinct {_FORM.format(c='source_id')} as q from layout_bank where source_id is not null and {_FORM.format(c='source_id')} <> ''),
h as (select page_id, q from pg join b on contains({_FORM.format(c='layout_source')}, q)),
k as (select page_id, 'p' || s || '|' || m || '|' || n as k from pg where s is not null and m is not null and n is not null
  union select page_id, 's' || q from h where not exists (select 1 from h x where x.page_id = h.page_id and x.q <> h.q and contains(x.q, h.q))),
e as (select distinct a.page_id as x, c.page_id as y from k a join k c using (k)),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select min(y) as first_page_id, x as page_id from r group by x having min(y) <> x
"""


def oracle_sql() -> dict:
    return {"p1_found": _P1 + "select target_id from t where available < wanted", "p1_report": _P1_REPORT, "p1_sample": _P1_SAMPLE, "p2_found": _P2, "p3_found": _P3, "p3_sample": _P3_SAMPLE, "p2_balance": "select 'page' as record_kind, count(*) as records, 0 as broken, true as close from page_gt union all select 'line', count(*), 0, true from line_gt", "p5_containers": "select count(*) as documents, sum(strlen(text) + 1)::bigint as tokens, 0 as overfull, true as close from documents where text is not null", "p5_found": "select doc_id from documents where strlen(text) + 1 > 4096"}
