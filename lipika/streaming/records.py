"""Growing folders of records as streams: the append-and-resume behaviour as an exactly-once pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lipika.sources.records import append_new, schema_of


def stream_lines(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON lines files as they arrive; a torn line gives a row of nulls, which is left out by its ``required`` filter downstream."""
    return spark.readStream.schema(schema_of(schema)).option("maxFilesPerTrigger", files_per_batch).json(path)


def first_by_key(stream: DataFrame, keys: Sequence[str], time: str, late: str = "30 days") -> DataFrame:
    """Each key once; state is kept for ``late`` behind the latest time seen, so it doesn't grow for ever."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_means(stream: DataFrame, time: str, by: Sequence[str], value: Column, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, by, n, mean): event-time windows; rows later than ``late`` are dropped by the watermark."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def running_counts(stream: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of all rows so far, for output in complete mode."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def append_once(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append each key once to the JSON lines at ``path``; a batch that is replayed adds nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: append_new(batch, path, keys)).start()


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Everything that is there now, into a table of the session (for looking at small results)."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
