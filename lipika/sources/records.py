"""Record files: JSON lines, JSON documents, CSV, partitions, listings, and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.operators.skew import lookup_join

from lipika.schemas import SCHEMAS


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def schema_of(name: str) -> str:
    """A named record schema, or a schema string as it is."""
    return SCHEMAS.get(name, name)


def read_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines with an explicit schema, blank lines skipped; a missing path is empty if ``missing_ok``."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema_of(schema))
    return spark.read.schema(schema_of(schema)).json(path)


def read_records(spark: SparkSession, path: str, record_schema: str) -> DataFrame:
    """The ``records`` of JSON documents, as rows."""
    return spark.read.schema(f"records array<struct<{schema_of(record_schema)}>>").option("multiLine", True).json(path).select(F.inline("records"))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON document (or each element, if the document is an array)."""
    return spark.read.schema(schema_of(schema)).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks."""
    return spark.read.schema(schema_of(schema)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_partitions(spark: SparkSession, root: str, schema: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """JSON lines below ``root`` with columns taken from each file's path by a pattern's groups.

    Files whose path doesn't match give null columns. An absent root is empty.
    """
    full = f"{schema_of(schema)}"
    if not _exists(spark, root):
        return spark.createDataFrame([], full + "".join(f", {n} string" for n in names))
    d = spark.read.schema(full).option("recursiveFileLookup", True).json(root)
    path = F.col("_metadata.file_path")
    return d.select("*", *[F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_checked_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of which the last may be torn; a broken line anywhere else is an error.

    A line is identified by its byte offset within its file, so the check is an
    aggregate by file and no file is read in one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    raw = raw.where(F.trim("value") != "")
    full = schema_of(schema)
    parsed = raw.withColumn("_r", F.from_json("value", f"{full}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_r._bad").isNotNull()
    place = F.struct("_block", "_n")
    check = parsed.groupBy("_file").agg(F.max(F.when(~broken, place)).alias("last_good"), F.min(F.when(broken, place)).alias("first_bad"), F.count_if(broken).alias("bad"))
    check = check.select("_file", F.when((F.col("bad") > 1) | (F.col("first_bad") < F.col("last_good")), F.raise_error(F.concat(F.lit("broken line within "), "_file"))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return parsed.where(~broken).join(check, "_file").where("_ok").select("_r.*").drop("_bad")


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) below a folder, without reading contents."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(root).select("path", "length", "modificationTime")


def content_keys(spark: SparkSession, root: str) -> DataFrame:
    """(path, key): the SHA-256 of each file, the key of the extract cache."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("key"))


def freshness(results: DataFrame, checkpoints: DataFrame, stem: Column) -> DataFrame:
    """(path, state): OK, STALE (older than its checkpoint) or MISSING (no checkpoint of that stem)."""
    c = checkpoints.select(stem.alias("stem"), F.col("modificationTime").alias("made")).groupBy("stem").agg(F.max("made").alias("made"))
    r = results.select("path", stem.alias("stem"), "modificationTime")
    state = F.when(F.col("made").isNull(), "MISSING").when(F.col("modificationTime") < F.col("made"), "STALE").otherwise("OK")
    return r.join(c, "stem", "left").select("path", state.alias("state"))


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys the JSON lines at ``path`` don't hold; repeats within ``rows`` are written once."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(list(keys))
    if _exists(spark, path):
        new = new.join(spark.read.schema(rows.schema).json(path).select(*keys), list(keys), "left_anti")
    new.write.mode("append").json(path)


def through_cache(rows: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``compute`` gives for their ``key`` (a digest of the content), from the Parquet cache at ``path``.

    Keys that the cache lacks are computed once each and appended; ``compute``
    takes rows and returns the key and its results. Of a key that two runs
    appended at the same time, one row counts.
    """
    spark = rows.sparkSession
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    compute(new).write.mode("append").parquet(path)
    return lookup_join(rows, spark.read.parquet(path).dropDuplicates([key]), [key], "left")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_document(rows: DataFrame, path: str) -> None:
    """JSON lines; the committer renames finished files into place."""
    rows.write.mode("overwrite").json(path)
