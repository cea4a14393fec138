"""One writing for labels and image ids, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ENGINE = "tesseract"


def label(c: Column | str) -> Column:
    """Trimmed (any Unicode white space) and in lower case; an empty label is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def engine(c: Column | str) -> Column:
    """As :func:`label`; a missing engine is the default one."""
    return F.coalesce(label(c), F.lit(DEFAULT_ENGINE))


def image_key(c: Column | str) -> Column:
    """An image id without blanks and leading zeros; an empty id is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), r"^0+(?=.)", ""), F.lit(""))
