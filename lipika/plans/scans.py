"""A: sources and sinks, each as a round trip through files in the shared folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.plans.registry import query
from lipika.plans.views import CALLS, READINGS, calls, readings
from lipika.session import load, shared_path
from lipika.sources import records


@query(f"with {CALLS} select script, count(*) as n, count(confidence) as n_conf, round(avg(confidence), 6) as mean_conf from calls group by script")
def a1_jsonl_scan(spark: SparkSession, root: str) -> DataFrame:
    """JSON lines, written and read again with the explicit schema."""
    path = shared_path(spark, "jsonl")
    calls(spark, root).select("script", "condition", "image_id", "confidence", "usage").write.json(path)
    d = records.read_lines(spark, path, "extract_pages")
    return d.groupBy("script").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_conf"), F.round(F.avg("confidence"), 6).alias("mean_conf"))


@query(f"with {CALLS} select condition, count(*) as n, round(sum(confidence), 4) as total from calls group by condition")
def a2_records_document(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold their rows under ``records``, one document for each script."""
    path = shared_path(spark, "documents")
    c = calls(spark, root).select("condition", "confidence", F.pmod("probe_id", F.lit(64)).alias("part"))
    c.groupBy("part").agg(F.collect_list(F.struct("condition", "confidence")).alias("records")).write.partitionBy("part").json(path)
    d = records.read_records(spark, path, "condition string, confidence double")
    return d.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query(f"with {READINGS} select bucket, count(*) as n, count(distinct gt) as texts from readings group by bucket")
def a3_csv_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """The taxonomy as CSV with header and quoted fields."""
    path = shared_path(spark, "csv")
    records.write_csv(readings(spark, root).select("engine", "language", "image_id", "variant", "bucket", F.col("label").alias("taxonomy_label"), F.col("gt").alias("ground_truth"), F.col("hyp").alias("predicted")), path)
    d = records.read_csv(spark, path, "error_taxonomy")
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("ground_truth", F.lit(""))).alias("texts"))


@query("select source, count(*) as pages, sum(len(regions)) as regions from layout_bank group by source")
def a4_layout_document(spark: SparkSession, root: str) -> DataFrame:
    """Nested JSON with arrays of structs."""
    path = shared_path(spark, "bank")
    records.write_document(load(spark, root, "layout_bank").drop("layout_id"), path)
    d = records.read_lines(spark, path, "layout_bank")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("regions")).alias("regions"))


@query(f"with {READINGS} select engine, coalesce(language, 'none') as language, count(*) as n from readings group by all")
def a6_partitioned_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Predictions in folders by engine and language, read back from their paths."""
    path = shared_path(spark, "predictions")
    r = readings(spark, root).select(F.col("image_id").alias("id"), F.col("hyp").alias("predicted_text"), "engine", F.coalesce("language", F.lit("none")).alias("language"))
    r.write.partitionBy("engine", "language").json(path)
    d = records.read_partitions(spark, path, "id string, predicted_text string", r"engine=([^/]+)/language=([^/]+)/", ["engine", "language"])
    return d.groupBy("engine", "language").agg(F.count(F.lit(1)).alias("n"))


@query("select batch_no, count(*) as n from error_taxonomy group by batch_no")
def a12_append_and_skip(spark: SparkSession, root: str) -> DataFrame:
    """Rows arrive twice, in overlapping parts; the sink keeps each once."""
    path = shared_path(spark, "appended")
    d = load(spark, root, "error_taxonomy").select("row_no", "batch_no")
    records.append_new(d.where("batch_no <= 8 or batch_no is null"), path, ["row_no"])
    records.append_new(d.where("batch_no >= 4 or batch_no is null"), path, ["row_no"])
    return records.read_lines(spark, path, "row_no long, batch_no int").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))


@query("select state, count(*) as n from (select unnest(['OK', 'STALE', 'MISSING']) as state) group by state")
def a20_freshness(spark: SparkSession, root: str) -> DataFrame:
    """Results against the checkpoints that they were made from: one made after, one before, one without."""
    at = lambda path, hour: (path, 1, datetime(2025, 1, 1, hour))
    schema = "path string, length long, modificationTime timestamp"
    results = spark.createDataFrame([at("r/a_seed0.jsonl", 9), at("r/b_seed0.jsonl", 3), at("r/c_seed0.jsonl", 3)], schema)
    checkpoints = spark.createDataFrame([at("m/a_seed0.pt", 5), at("m/b_seed0.pt", 5), at("m/b_seed0.pt", 1)], schema)
    stem = F.regexp_extract("path", r"([a-z]+_seed\d)", 1)
    return records.freshness(results, checkpoints, stem).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, sum(row_no)::bigint as row_sum from error_taxonomy")
def a13_torn_tail(spark: SparkSession, root: str) -> DataFrame:
    """A torn last line is left out; everything before it counts."""
    path = shared_path(spark, "torn")
    d = load(spark, root, "error_taxonomy").select("row_no", "bucket")
    lines = d.select(F.to_json(F.struct("row_no", "bucket")).alias("value"))
    lines.write.text(path)
    spark.createDataFrame([('{"row_no": 999999999, "buck',)], "value string").coalesce(1).write.mode("append").text(path)
    return records.read_checked_tail(spark, path, "row_no long, bucket string").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("row_sum"))


@query("""select count(*) as n, sum(length(sarvam_text))::bigint as chars, (select count(distinct sarvam_text) from sarvam_transfer_probe where cached) as first_filled, (select count(distinct sarvam_text) from sarvam_transfer_probe where sarvam_text is not null) as filled from sarvam_transfer_probe where sarvam_text is not null""")
def a11_content_cache(spark: SparkSession, root: str) -> DataFrame:
    """Texts go through a cache keyed by the digest of their content: the first calls fill it, the others look it up and fill what it lacks."""
    d = load(spark, root, "sarvam_transfer_probe").where("sarvam_text is not null").select("sarvam_text", "cached", F.sha2("sarvam_text", 256).alias("digest"))
    path = shared_path(spark, "cache")
    measure = lambda new: new.select("digest", F.char_length("sarvam_text").alias("chars"))
    first = records.through_cache(d.where("cached"), path, "digest", measure).agg(F.count_distinct("digest").alias("first_filled"))
    out = records.through_cache(d, path, "digest", measure)
    filled = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("filled"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(filled))


@query(f"""with {CALLS}, r as (select script, image_id, ground_truth, row_number() over (partition by script, image_id order by coalesce(recorded_at, timestamptz '1970-01-01 00:00:00+00') desc, probe_id desc) as rn from calls where condition = 'real' and ground_truth is not null)
  select script, count(*) as n, sum(length(ground_truth))::bigint as chars from r where rn = 1 group by script""")
def a5_keyed_truth(spark: SparkSession, root: str) -> DataFrame:
    """One ground truth for each image: a later duplicate overwrites an earlier one."""
    from lipika.plans.views import latest

    d = latest(calls(spark, root).where("condition = 'real' and ground_truth is not null").select("script", "image_id", "ground_truth", "recorded_at", "probe_id"), ["script", "image_id"])
    return d.groupBy("script").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("ground_truth")).alias("chars"))


@query()
def a8_directory_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files of the tables by name, listed without reading them."""
    d = records.list_files(spark, root, "*.parquet")
    return d.select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name"), "length")


@query(f"with {CALLS} select language_code, count(*) as n from calls where language_code in ('hi-IN', 'bn-IN', 'sat-IN') group by language_code")
def a9_filtered_codes(spark: SparkSession, root: str) -> DataFrame:
    return calls(spark, root).where(F.col("language_code").isin("hi-IN", "bn-IN", "sat-IN")).groupBy("language_code").agg(F.count(F.lit(1)).alias("n"))


@query("select engine, count(*) as n, sum(row_no)::bigint as row_sum from (select coalesce(engine, 'none') as engine, row_no from error_taxonomy) group by engine")
def s1_streamed_append(spark: SparkSession, root: str) -> DataFrame:
    """The taxonomy arrives in two overlapping parts as a stream of files; each row is appended once."""
    from lipika.streaming.records import append_once, stream_lines

    source, sink, state = (shared_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    d = load(spark, root, "error_taxonomy").select("row_no", F.coalesce("engine", F.lit("none")).alias("engine"), "batch_no")
    for part in ("batch_no <= 8", "batch_no >= 6 or batch_no is null"):
        d.where(part).select("row_no", "engine").write.mode("append").json(source)
        append_once(stream_lines(spark, source, "row_no long, engine string"), sink, ["row_no"], state).awaitTermination()
    out = records.read_lines(spark, sink, "row_no long, engine string")
    return out.groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("row_sum"))
