"""Reading rules of the record model: schema gate, replay removal, reference normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.runtime import table

SCHEMA_VERSION = 1


def ref_key(ref: Column) -> Column:
    """The form in which a reference and an id are compared: trimmed, lower case, without chunk suffix; null if blank."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(ref, r"(?U)^\s+|\s+$", "")), r"#c\d+$", "")
    return F.when(bare != "", bare)


def first_arrivals(df: DataFrame, keep: dict[str, Column] | list[str], key: str = "id", at: str = "ingested_at") -> DataFrame:
    """One row per `key`: of the rows with the current schema version, the one with the earliest `at`.

    Equal times are broken by a hash of the row kept; a null time comes last; rows whose key is null are no records.
    Aggregates map-side first, so a key replayed millions of times still shuffles one row per map task.
    Only the columns in `keep` travel.
    """
    keep = {c: F.col(c) for c in keep} if isinstance(keep, list) else keep
    body = F.struct(*[c.alias(n) for n, c in keep.items()])
    order = F.struct(F.col(at).isNull().alias("n"), F.col(at).alias("t"), F.xxhash64(body).alias("h"))
    rows = df.where((F.col("schema") == SCHEMA_VERSION) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), body.alias("_b"), order.alias("_o"))
    return rows.groupBy("_k").agg(F.min_by("_b", "_o").alias("_b")).select(F.col("_k").alias(key), *[F.col(f"_b.{n}").alias(n) for n in keep if n != key])


def records(spark: SparkSession, sf_dir: str, keep: dict[str, Column] | list[str]) -> DataFrame:
    return first_arrivals(table(spark, sf_dir, "memory_record"), keep)


def notes(spark: SparkSession, sf_dir: str, keep: dict[str, Column] | list[str]) -> DataFrame:
    return first_arrivals(table(spark, sf_dir, "note_record"), keep)
