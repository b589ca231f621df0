"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import gateway, vectors
from palimpsest.runtime import table

SIMILARITY = 0.88


def current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry with the highest seq of every key, whatever its vector; replays with equal seq are one entry."""
    v = table(spark, sf_dir, "vector_entry").where(F.col("key").isNotNull())
    return v.groupBy("key").agg(F.max_by(F.struct("vec"), F.struct("seq", F.xxhash64("vec"))).alias("e")).select("key", "e.vec")


def _index(spark: SparkSession, sf_dir: str) -> tuple[vectors.Index, gateway.Gateway]:
    g = gateway.active(spark, sf_dir)
    return vectors.Index(current_vectors(spark, sf_dir), "key", "vec", g.dim), g


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].pairs(SIMILARITY).select("key_a", "key_b")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, g = _index(spark, sf_dir)
    return index.neighbours(g.neighbours)


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
SQL = {
    "p2_found": """
with cur as (select key, vec from (select *, row_number() over (partition by key order by seq desc) rn from vector_entry) where rn = 1),
ok as (select key, vec::double[64] v from cur where len(vec) = (select dim from embed_gateway where active) and len(list_filter(vec, lambda x: isnan(x) or isinf(x) or x is null)) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0)
select a.key key_a, b.key key_b from ok a join ok b on a.key < b.key and array_cosine_similarity(a.v, b.v) >= 0.88"""
}
