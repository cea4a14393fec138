"""Problem 3: a reproducible sample that stays stable as data grows.

Permanent random numbers: each image gets a uniform value when it is first
seen, through an anti-join insert into a registry; the sample is always the
images whose value is under a threshold that never falls. So a chosen image
stays chosen whatever is added, and neither row order nor partitioning matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.labels import image_key, label
from lipika.session import pick, shared_path, written

SHARE = 0.1
KEY = ["language", "image_id"]
_SCHEMA = "language string, image_id string, value double, first_seen string"
_PATH = r"(?i)([^/\\]+)[/\\]+images[/\\]+0*(\d+)_[a-z]+\.[a-z]+\s*$"


def taxonomy_images(readings: DataFrame) -> DataFrame:
    """(language, image_id) of error_taxonomy rows; rows without a language or id name no image."""
    return pick(readings, "language", "image_id").select(label("language").alias("language"), image_key("image_id").alias("image_id")).dropna()


def probe_images(calls: DataFrame) -> DataFrame:
    """(language, image_id) of probe calls under condition ``real``, failed ones included.

    Where ``script`` or ``image_id`` is null, ``image_path`` names it.
    """
    from_path = lambda k: F.nullif(F.regexp_extract("image_path", _PATH, k), F.lit(""))
    real = pick(calls, "script", "condition", "image_id", "image_path").where(label("condition") == "real")
    return real.select(F.coalesce(label("script"), label(from_path(1))).alias("language"), F.coalesce(image_key("image_id"), image_key(from_path(2))).alias("image_id")).dropna()


def uniform(salt: str) -> Column:
    """A uniform value in [0, 1) from 52 bits of the identifier's digest, the same on every engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *KEY)), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(1 << 52))


class Registry:
    """The persisted values: an append-only Parquet table of images, and its thresholds.

    ``path`` outlives the session: a later draw that names it finds all values
    and thresholds of earlier ones. ``insert`` adds images not yet in the
    registry (anti-join); values already given never rise. Images that an
    earlier draw selected, whose value nobody kept, are inserted with a value
    scaled below the threshold, so they are under it for good; if they are
    known with a higher value, the lower one counts. So two inserts at the same
    time, which may both add an image, do no harm: of its rows the least value
    counts. A job that fails leaves nothing behind that a rerun would not find:
    files appear on commit only, and a value depends on the identifier and the
    salt alone.
    """

    def __init__(self, spark: SparkSession, path: str, salt: str = "lipika-prn"):
        self.spark, self.path, self.salt = spark, path.rstrip("/"), salt
        spark.createDataFrame([], _SCHEMA).write.mode("append").parquet(f"{self.path}/values")
        spark.createDataFrame([], "threshold double").write.mode("append").parquet(f"{self.path}/thresholds")

    def values(self) -> DataFrame:
        """(language, image_id, value, first_seen), one row an image."""
        rows = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/values")
        return rows.groupBy(*KEY).agg(F.min(F.struct("value", "first_seen")).alias("x")).select(*KEY, "x.value", "x.first_seen")

    def threshold(self) -> float:
        """The largest threshold used so far, 0 at first."""
        return self.spark.read.schema("threshold double").parquet(f"{self.path}/thresholds").agg(F.max("threshold")).first()[0] or 0.0

    def raise_threshold(self, share: float) -> float:
        """Raise the threshold to ``share``; a smaller share leaves it where it is."""
        now = self.threshold()
        if share > now:
            self.spark.createDataFrame([(float(share),)], "threshold double").write.mode("append").parquet(f"{self.path}/thresholds")
        return max(now, share)

    def insert(self, images: DataFrame, seen: str, below: float | None = None) -> None:
        """Give each new image its value; ``below`` scales the values under that threshold.

        With ``below``, images known with a value not under it count as new.
        Repeats, and other images already known, change nothing; null keys are
        left out.
        """
        known = self.values().select(*KEY) if below is None else self.values().where(F.col("value") < below).select(*KEY)
        value = uniform(self.salt) * F.lit(1.0 if below is None else float(below))
        new = images.select(*KEY).dropna().distinct().join(known, KEY, "left_anti")
        new.select(*KEY, value.alias("value"), F.lit(seen).alias("first_seen")).write.mode("append").parquet(f"{self.path}/values")

    def select(self) -> DataFrame:
        """(language, image_id, value, first_seen) of all known images under the threshold."""
        return self.values().where(F.col("value") < F.lit(self.threshold()))


def present_images(readings: DataFrame, calls: DataFrame) -> DataFrame:
    """(language, image_id): the images that now occur, each once."""
    return taxonomy_images(readings).unionByName(probe_images(calls)).distinct()


def selected_before(prior: DataFrame) -> DataFrame:
    """(language, image_id) of the rows of an earlier selection."""
    return pick(prior, "language", "image_id").select(label("language").alias("language"), image_key("image_id").alias("image_id"))


def draw(readings: DataFrame, calls: DataFrame, prior: DataFrame, share: float = SHARE, registry: Registry | None = None, seen: str = "present") -> DataFrame:
    """(language, image_id, value, first_seen): the sample of images that now occur.

    Images of ``prior`` come first, with values under the threshold; then the
    present rows, with values of their own, marked ``seen``. Images since
    withdrawn from all tables stay registered but are not in the sample. A
    ``registry`` given is one to be kept; without one the values are those of a
    first draw. Empty tables are fine.
    """
    spark = readings.sparkSession
    registry = registry or Registry(spark, shared_path(spark, "registry"))
    threshold = registry.raise_threshold(share)
    registry.insert(selected_before(prior), "prior", below=threshold)
    present = written(present_images(readings, calls), "present")
    registry.insert(present, seen)
    return registry.select().join(present, KEY, "left_semi")


def kept(readings: DataFrame, calls: DataFrame, prior: DataFrame, share: float = SHARE, registry: Registry | None = None) -> DataFrame:
    """(language, image_id): images of earlier draws that the new sample holds."""
    return draw(readings, calls, prior, share, registry).select(*KEY).join(selected_before(prior).dropna().distinct(), KEY, "left_semi")


def grown(readings: DataFrame, calls: DataFrame, prior: DataFrame, registry: Registry, until: int, share: float = SHARE) -> DataFrame:
    """As :func:`draw`, over two arrivals into one registry: first the readings of batches up to ``until``, then all rows.

    A reading without a batch arrives with the later ones.
    """
    draw(readings.where(F.col("batch_no") <= until), calls.limit(0), prior, share, registry, "earlier")
    return draw(readings, calls, prior, share, registry, "later")
