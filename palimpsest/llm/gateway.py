"""Settings of the active embedding gateway."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.runtime import table


class Gateway(NamedTuple):
    provider: str = "local"
    dim: int = 64
    max_chars: int = 1200
    overlap_chars: int = 120
    neighbours: int = 10


def active(spark: SparkSession, sf_dir: str) -> Gateway:
    """The active row (of several the first by provider; of none the defaults). One row reaches the driver."""
    row = table(spark, sf_dir, "embed_gateway").where(F.col("active")).orderBy("provider").select(*Gateway._fields).first()
    return Gateway(**row.asDict()) if row else Gateway()
