"""Queries that run as streams until what is there has been read, with the SQL of the batch that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.streaming import events


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log appended replay-safe: entries and last turn of each scope."""
    s = events.table_stream(spark, sf_dir, "access_log").where(F.col("scope").isNotNull() & F.col("seq").isNotNull())
    path = events.append_once(s, ["scope", "id", "seq"], ["logged_at"], events.work_dir(spark))
    return spark.read.parquet(path).groupBy("scope").agg(F.count(F.lit(1)).alias("entries"), F.max("turn").alias("last_turn"))


def stream_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical clocks of the scopes of the stored records' stream."""
    s = events.table_stream(spark, sf_dir, "memory_record").where((F.col("schema") == 1) & F.col("scope").isNotNull()).select("scope", "turn")
    return events.collect_updates(events.clocks(s), events.work_dir(spark), ["scope"], "turns").select("scope", "turns", "newest")


def stream_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each vector key as the stream leaves it."""
    s = events.table_stream(spark, sf_dir, "vector_entry").where(F.col("key").isNotNull())
    latest = s.groupBy("key").agg(F.max("seq").alias("seq"))
    return events.collect_updates(latest, events.work_dir(spark), ["key"], "seq")


QUERIES = {"stream_append": stream_append, "stream_clocks": stream_clocks, "stream_vectors": stream_vectors}
SQL = {
    "stream_append": "select scope, count(*) entries, max(turn) last_turn from (select distinct scope, id, seq, turn from access_log where scope is not null and seq is not null) group by 1",
    "stream_clocks": "select scope, count(*) turns, greatest(0, max(turn)) newest from memory_record where schema = 1 and scope is not null group by 1",
    "stream_vectors": "select key, max(seq) seq from vector_entry where key is not null group by 1",
}
