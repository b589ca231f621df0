"""References to records that do not exist.

Parent and child keys are united in one tagged long form and grouped by parent table and key; groups without a valid
parent flag are orphans and their counts are summed by period. Children are counted per (table, key, period) before
the shuffle, so a key that a third of all rows refer to is a handful of rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_keys(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(field, key, period, n, reason) of the references that have no valid target.

    children(field, key, period): one row per reference; rows with a null key are no references.
    parents(field, key, since, gone, ever): `since` is the period from which the target is there (null: always),
    `gone` the period from which it is deleted (null: never); with `ever` a deletion counts whenever it happens.
    Periods are strings that sort by time. A null child period is only held against deletions that count whenever they
    happen and against absence. Repeated parent rows: the earliest `since` and `gone` count. Empty tables give no rows.
    """
    counted = children.where(F.col("key").isNotNull()).groupBy("field", "key", "period").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None)
    long = counted.select("field", "key", F.lit(False).alias("is_parent"), F.struct("period", "n").alias("child"), nothing.cast("string").alias("since"), nothing.cast("string").alias("gone"), F.lit(False).alias("ever")).unionByName(
        parents.where(F.col("key").isNotNull()).select("field", "key", F.lit(True).alias("is_parent"), nothing.cast("struct<period:string,n:bigint>").alias("child"), F.coalesce("since", F.lit("")).alias("since"), "gone", "ever")
    )
    grouped = long.groupBy("field", "key").agg(F.max("is_parent").alias("has_parent"), F.min("since").alias("since"), F.min("gone").alias("gone"), F.max("ever").alias("ever"), F.collect_list("child").alias("children"))
    each = grouped.select("field", "key", "has_parent", "since", "gone", "ever", F.explode("children").alias("c")).select("field", "key", "has_parent", "since", "gone", "ever", "c.period", "c.n")
    reason = (
        F.when(~F.col("has_parent"), "missing")
        .when(F.col("gone").isNotNull() & (F.col("ever") | (F.col("gone") <= F.col("period"))), "deleted")
        .when(~F.col("ever") & (F.col("since") > F.col("period")), "late")
    )
    return each.select("field", "key", "period", "n", reason.alias("reason")).where(F.col("reason").isNotNull())


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table and period."""
    return orphans.groupBy("field", "period").agg(F.sum("n").cast("bigint").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.when(F.col("reason") == "missing", F.col("n")).otherwise(0)).alias("n_missing"), F.sum(F.when(F.col("reason") == "deleted", F.col("n")).otherwise(0)).alias("n_deleted"), F.sum(F.when(F.col("reason") == "late", F.col("n")).otherwise(0)).alias("n_late"))
