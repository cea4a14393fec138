"""Tables in one writing, that the queries share, and the same views as SQL."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.functions import text
from lipika.functions.labels import engine, image_key, label
from lipika.operators.alignment import read_as
from lipika.session import load


def lab(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


def key(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace({c}, '\s+', '', 'g'), '^0+(.)', '\1'), '')"


def clusters_sql(c: str) -> str:
    """The grapheme clusters of a text in SQL, as :func:`lipika.functions.text.graphemes` gives them."""
    conjunct, virama, extending = (re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", x) for x in (text.CONSONANTS, text.VIRAMAS, text.EXTENDING))
    return rf"regexp_extract_all({c}, '(?:[{conjunct}][{extending}]*[{virama}][{extending}]*)*[{conjunct}][{text.JOINING}]*|\r\n|[{text.ALONE}]|[^{text.ALONE}][{text.JOINING}]*')"


def glyphs_sql(c: str) -> str:
    """The glyph clusters of a text in SQL: those with a letter of an Indic or Arabic block."""
    blocks = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", text.GLYPH_BLOCKS)
    return rf"list_filter({clusters_sql(c)}, lambda g: regexp_matches(g, '{blocks}') and trim(g) <> '')"


#: CTE ``charset`` ({by}, n, trained, image) after ``readings``: clusters of a text that aren't blank, and those of two scripts.
CHARSET = f"""charset as (select {{by}}, len(g) as n, len(list_filter(g, lambda x: regexp_matches(x, '[\\x{{{{0900}}}}-\\x{{{{097f}}}}]'))) as trained, len(list_filter(g, lambda x: not regexp_matches(x, '[\\x{{{{0900}}}}-\\x{{{{097f}}}}]') and regexp_matches(x, '[\\x{{{{0980}}}}-\\x{{{{09ff}}}}]'))) as image
  from (select {{by}}, list_filter({clusters_sql('{c}').replace('{', '{{').replace('}', '}}').replace('{{c}}', '{c}')}, lambda x: not regexp_full_match(x, '{text.BLANKS.replace('{', '{{').replace('}', '}}')}+')) as g from readings))"""


def readings(spark: SparkSession, root: str) -> DataFrame:
    """error_taxonomy with labels and ids in one writing; texts are never null."""
    d = load(spark, root, "error_taxonomy")
    return d.select("row_no", engine("engine").alias("engine"), label("language").alias("language"), image_key("image_id").alias("image_id"), label("variant").alias("variant"), "bucket", label("taxonomy_label").alias("label"), F.coalesce("ground_truth", F.lit("")).alias("gt"), F.coalesce("predicted", F.lit("")).alias("hyp"), "batch_no", "recorded_at")


READINGS = f"""readings as (select row_no, coalesce({lab('engine')}, 'tesseract') as engine, {lab('language')} as language, {key('image_id')} as image_id, {lab('variant')} as variant,
  bucket, {lab('taxonomy_label')} as label, coalesce(ground_truth, '') as gt, coalesce(predicted, '') as hyp, batch_no, recorded_at from error_taxonomy)"""


def clusters_read(spark: SparkSession, root: str) -> DataFrame:
    """Every cluster of the true texts by language and what the alignment of the whole text reads it as (null: nothing); counts n to be added up."""
    r = readings(spark, root).select("language", text.graphemes(F.col("gt")).alias("a"), text.graphemes(F.col("hyp")).alias("b"))
    return read_as(r, "a", "b")


def reads_sql(pairs: str, suffix: str = "") -> str:
    """CTEs after ``pairs`` (k, a, b: arrays) for ``with recursive``: ``reads`` (k, i, true_cluster, predicted_cluster), every item of ``a`` and what the alignment reads it as.

    The score table by its diagonals, each cell with the direction of its best
    step (diagonal before up before left); then the way back by those.
    """
    cell, way, back, hits, reads = (f"{n}{suffix}" for n in ("cell", "way", "back", "hits", "reads"))
    return f"""{cell}(k, i, d, s, p, way) as (select k, 0, 0, 0, null::int, 3 from {pairs} where len(a) > 0 and len(b) > 0
    union all select k, i, d, s, l, case when i = 0 or i = d then 3 when s = dg then 0 when s = up - 1 then 1 else 2 end from (
      select *, case when i = 0 or i = d then -d else greatest(dg, up - 1, l - 1) end as s from (
        select x.k, x.i, x.d, l, up, dg + case when a[x.i] = b[x.d - x.i] then 1 else -1 end as dg from (
          select k, i + m as i, d + 1 as d, max(case when m = 0 then s end) as l, max(case when m = 1 then s end) as up, max(case when m = 1 then p end) as dg from (select *, unnest([0, 1]) as m from {cell}) group by 1, 2, 3) x
        join {pairs} q on x.k = q.k where x.i <= len(a) and x.d - x.i <= len(b)))),
  {way} as materialized (select k, i, list(way order by d) as way from {cell} group by k, i),
  {back}(k, i, j, hi, hj) as (select k, len(a)::int, len(b)::int, 0, 0 from {pairs} where len(a) > 0 and len(b) > 0
    union all select t.k, t.i - (w.way[t.j + 1] < 2)::int, t.j - (w.way[t.j + 1] <> 1)::int, case when w.way[t.j + 1] = 0 then t.i else 0 end, t.j from {back} t join {way} w on t.k = w.k and t.i = w.i where t.i > 0 and t.j > 0),
  {hits} as (select k, hi as i, hj as j from {back} where hi > 0),
  {reads} as (select u.k, u.i, u.c as true_cluster, b[h.j] as predicted_cluster from (select k, b, unnest(a) as c, unnest(range(1, len(a) + 1)) as i from {pairs}) u left join {hits} h on u.k = h.k and u.i = h.i)"""


def distance_sql(pairs: str, name: str = "dist") -> str:
    """A CTE after ``pairs`` (k, a, b: arrays) for ``with recursive``: ``name`` (k, dist), their edit distance, by the diagonals of the table."""
    cell = f"{name}_cell"
    return f"""{cell}(k, i, d, s, p) as (select k, 0, 0, 0, null::int from {pairs} where len(a) > 0 and len(b) > 0
    union all select k, i, d, case when i = 0 or i = d then d else least(dg, up + 1, l + 1) end, l from (select x.k, x.i, x.d, l, up, dg + (a[x.i] <> b[x.d - x.i])::int as dg from (
      select k, i + m as i, d + 1 as d, max(case when m = 0 then s end) as l, max(case when m = 1 then s end) as up, max(case when m = 1 then p end) as dg from (select *, unnest([0, 1]) as m from {cell}) group by 1, 2, 3) x
      join {pairs} q on x.k = q.k where x.i <= len(a) and x.d - x.i <= len(b))),
  {name} as (select k, s as dist from {cell} join {pairs} using (k) where i = len(a) and d = len(a) + len(b) union all select k, greatest(len(a), len(b)) from {pairs} where len(a) = 0 or len(b) = 0)"""


TEXTS = "texts as materialized (select gt, hyp, row_number() over () as k from (select distinct gt, hyp from readings))"
#: The views ``readings``, ``texts`` (gt, hyp, k) and ``reads`` (k, i, true_cluster, predicted_cluster), for ``with recursive``.
READS = f"{READINGS}, {TEXTS}, pairs as materialized (select k, {clusters_sql('gt')} as a, {clusters_sql('hyp')} as b from texts), {reads_sql('pairs')}"


def calls(spark: SparkSession, root: str) -> DataFrame:
    """sarvam_transfer_probe in one writing; the path gives what script or id leave out."""
    d = load(spark, root, "sarvam_transfer_probe")
    return d.select("probe_id", label("script").alias("script"), label("condition").alias("condition"), F.coalesce(image_key("image_id"), image_key(F.regexp_extract("image_path", r"([^/]+)_[a-z]+\.png$", 1))).alias("image_id"), "image_path", "ground_truth", "sarvam_text", "sarvam_status", "cached", "confidence", "usage", "error", "job_id", "language_code", "recorded_at")


CALLS = f"""calls as (select probe_id, {lab('script')} as script, {lab('condition')} as condition, coalesce({key('image_id')}, {key("regexp_extract(image_path, '([^/]+)_[a-z]+[.]png$', 1)")}) as image_id,
  image_path, ground_truth, sarvam_text, sarvam_status, cached, confidence, usage, error, job_id, language_code, recorded_at from sarvam_transfer_probe)"""


def latest(df: DataFrame, by: list[str]) -> DataFrame:
    """The last write of each key: the latest time (nulls first), then the largest row number."""
    rest = [c for c in df.columns if c not in by]
    order = F.struct(F.coalesce("recorded_at", F.lit("1970-01-01").cast("timestamp")).alias("_at"), F.col("row_no" if "row_no" in rest else "probe_id").alias("_no"))
    last = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*by, "_r.*")


KEY = ["engine", "language", "image_id", "variant"]
LATEST = f"""{READINGS}, latest as (select * exclude (rn) from (select *, row_number() over (partition by engine, language, image_id, variant order by coalesce(recorded_at, timestamptz '1970-01-01 00:00:00+00') desc, row_no desc) as rn from readings) where rn = 1)"""


def last_readings(spark: SparkSession, root: str) -> DataFrame:
    return latest(readings(spark, root), KEY)


def tier1_sql(c: str) -> str:
    """The tier-1 form in SQL, from the same fixed values."""
    ws = text.BLANKS
    c = f"trim(regexp_replace(nfc_normalize({c}), '{ws}+', ' ', 'g'))"
    for nasal, (first, last) in text.NASALS.items():
        for k in range(ord(first), ord(last) + 1):
            c = f"replace({c}, '{nasal}्{chr(k)}', 'ं{chr(k)}')"
    for a, b in text.SAME_READING.items():
        c = f"replace({c}, '{a}', '{b}')"
    return rf"regexp_replace(translate({c}, '{text.SINGLE_FROM}', '{text.SINGLE_TO}'), '{ws}+(\.+)', '\1', 'g')"


def phonetic_sql(c: str, language: str) -> str:
    """A form that is equal where ISO 15919 transliterations are: one script's letters, joiners gone, an independent vowel behind a virama as its sign."""
    c = f"replace(replace(regexp_replace(nfc_normalize({c}), '[\u200c\u200d]', '', 'g'), '\u09ce', '\u09a4\u09cd'), '\u0950', '\u0913\u0902')"
    for shift in text.ISO_LANGUAGES.values():
        signs = dict(zip(text.ISO_SIGNS, range(0x93E + shift, 0x94D + shift))) | {"a": None}
        for k, v in enumerate(text.ISO_VOWELS):
            c = f"replace({c}, '{chr(0x94D + shift)}{chr(0x905 + shift + k)}', '{chr(signs[v]) if signs.get(v) else ''}')" if v in signs else c
    return f"case when {language} in ('hindi', 'bengali') then translate({c}, '\u0964{text.SINGLE_FROM[2:]}', '.{text.SINGLE_TO[2:]}') end"


def bare_sql(c: str) -> str:
    """A text without nuktas and vowel signs, composed (:func:`lipika.functions.text.without_marks` is decomposed)."""
    left = {chr(k): "".join(x for x in unicodedata.normalize("NFD", chr(k)) if not text.is_mark(x)) for k in range(0x300, 0x20000) if any(map(text.is_mark, unicodedata.normalize("NFD", chr(k))))}
    marks = "".join(x for x, to in left.items() if not to)
    kept = {x: to for x, to in left.items() if len(to) == 1 and unicodedata.normalize("NFC", x) == x}
    return f"translate(regexp_replace(nfc_normalize({c}), '[{marks}]', '', 'g'), '{''.join(kept)}', '{''.join(kept.values())}')"


def signals_sql(texts: str) -> str:
    """CTEs after ``texts`` (k, gt, hyp) for ``with recursive``: ``signals`` (k, repeated, reordered, dropped, misread), why two texts may differ."""
    block = lambda n, k: f"h[len(h) - {(k + 1) * n - 1}:len(h) - {k * n}]"
    tail = " or ".join(f"len(h) >= {3 * n} and {block(n, 0)} = {block(n, 1)} and {block(n, 1)} = {block(n, 2)}" for n in (2, 3, 4))
    split = lambda c: f"case when {ws_sql(c)} = '' then [] else string_split({ws_sql(c)}, ' ') end"
    return f"""words as materialized (select k, gt, hyp, {split('gt')} as g, {split('hyp')} as h from {texts}),
  placed as (select k, i, h[i] as w, i - row_number() over (partition by k, h[i] order by i) as run from (select k, h, unnest(range(1, len(h) + 1)) as i from words)),
  longest as (select k, arg_max(w, n * 1000000 - first) as w, max(n) as n from (select k, w, run, count(*) as n, min(i) as first from placed group by all) group by k),
  chars as materialized (select k, string_split(gt, '') as a, string_split(hyp, '') as b from {texts} where gt <> '' and hyp <> '' and least(length(gt), length(hyp)) >= 0.4 * greatest(length(gt), length(hyp))), {distance_sql('chars', 'edits')},
  signals as (select w.k, len(h) > 0 and (coalesce(l.n >= 3 and l.n > len(list_filter(g, lambda x: x = l.w)) + 1, false) or {tail}
      or len(g) > 0 and (length(array_to_string(h, ' ')) - length(replace(array_to_string(h, ' '), array_to_string(g, ' '), ''))) / length(array_to_string(g, ' ')) >= 2) as repeated,
    len(g) >= 3 and len(h) >= 3 and list_sort(g) = list_sort(h) and g <> h as reordered,
    {bare_sql('gt')} = {bare_sql('hyp')} and ({bare_sql('gt')} <> nfc_normalize(gt) or {bare_sql('hyp')} <> nfc_normalize(hyp)) as dropped,
    coalesce(dist > 0 and dist <= 0.75 * greatest(length(gt), length(hyp)), false) as misread from words w left join longest l using (k) left join edits using (k))"""


def ws_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{text.BLANKS}+', ' ', 'g'))"


def panel(spark: SparkSession, root: str) -> DataFrame:
    """(unit, rep, value): mean event value by user and event type, of users that have every type."""
    e = load(spark, root, "events")
    cells = e.groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("rep")).agg(F.avg("value").alias("value"))
    reps = e.select(F.count_distinct("event_type").alias("k"))
    whole = cells.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(reps), F.col("n") == F.col("k")).select("unit")
    return cells.join(whole, "unit", "left_semi")


PANEL = """cells as (select user_id as unit, event_type as rep, avg(value) as value from events group by all),
panel as (select * from cells where unit in (select unit from cells group by unit having count(*) = (select count(distinct event_type) from events)))"""


def steps(spark: SparkSession, root: str) -> DataFrame:
    """(vec_id, label, p, q): two step distributions of each vector, as softmax of its two halves."""
    from lipika.functions.arrays import softmax

    d = load(spark, root, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return d.select("vec_id", "label", softmax(F.slice("v", 1, 32)).alias("p"), softmax(F.slice("v", 33, 32)).alias("q"))


STEPS = """raw as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
ex as (select vec_id, label, list_transform(v[1:32], lambda x: exp(x - list_max(v[1:32]))) as a, list_transform(v[33:64], lambda x: exp(x - list_max(v[33:64]))) as b from raw),
steps as (select vec_id, label, list_transform(a, lambda x: x / list_sum(a)) as p, list_transform(b, lambda x: x / list_sum(b)) as q from ex)"""
