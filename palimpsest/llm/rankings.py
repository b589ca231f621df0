"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import rankwalk
from palimpsest.runtime import table

SCORES = ["semanticScore", "score", "bm25Score", "rerankScore"]


def current_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the highest seq of each (query_id, id); replays with equal seq are one row."""
    s = table(spark, sf_dir, "score_signal").where(F.col("query_id").isNotNull() & F.col("id").isNotNull())
    body = F.struct(*SCORES)
    return s.groupBy("query_id", "id").agg(F.max_by(body, F.struct("seq", F.xxhash64(F.to_json(body)))).alias("b")).select("query_id", "id", "b.*")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current candidate of every query with its place in the one ranking."""
    return rankwalk.rank(current_signals(spark, sf_dir), "query_id", "id", SCORES)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "recall_query").where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.max("top_k").alias("top_k"))
    return p6_ranking(spark, sf_dir).join(asked, "query_id").where(F.col("place") <= F.col("top_k")).select("query_id", "id")


QUERIES = {"p6_found": p6_found, "p6_ranking": p6_ranking}
_S = ["coalesce(case when isnan({0}) then '-inf'::double else {0} end, '-inf'::double)".format(c) for c in SCORES]
_BEATS = " + ".join(f"(a.s{i} > b.s{i})::int" for i in range(4))
SQL = {
    "p6_found": f"""
with cur as (select query_id, id, {', '.join(f'{s} s{i}' for i, s in enumerate(_S))} from (select *, row_number() over (partition by query_id, id order by seq desc) rn from score_signal) where rn = 1),
pairs as (select a.query_id, a.id, sum((({_BEATS}) >= 3)::int) wins, any_value(q.top_k) k, count(*) + 1 n
  from cur a join cur b on a.query_id = b.query_id and a.id <> b.id join recall_query q on q.query_id = a.query_id group by 1, 2)
select query_id, id from (select *, row_number() over (partition by query_id order by wins desc) rn from pairs) where rn <= k"""
}
