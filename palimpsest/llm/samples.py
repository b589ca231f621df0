"""Samples of bounded size for models and trees that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 40


def by_hash(rows: DataFrame, key: str, value: str, most: int, total: int) -> list:
    """Values of about `most` of `total` rows, in the order of the key's hash; all if there are no more. Rows are chosen by the
    hash alone before anything is sent, so the driver gets about `most` however many partitions there are, and cuts what
    chance has added."""
    chosen = rows.select(F.xxhash64(key).alias("h"), F.col(value).alias("v"))
    if total > most:
        chosen = chosen.where(F.pmod("h", F.lit(STEPS)) < int(STEPS * most / total))
    return [r.v for r in sorted(chosen.collect(), key=lambda r: r.h)[:most]]
