"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import gateway, pieces
from palimpsest.sources.records import records


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gateway.active(spark, sf_dir)
    # Texts within the limit are dropped before the shuffle that removes replays; which arrival counts is still decided over all.
    long = records(spark, sf_dir, {"id": F.col("id"), "content": F.when(F.length("content") > g.max_chars, F.col("content"))})
    cut = pieces.pieces(long, "id", "content", g.max_chars, g.overlap_chars)
    return cut.groupBy("id").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddable pieces of every record; key is the id, with a chunk suffix where there are several."""
    g = gateway.active(spark, sf_dir)
    all_pieces = pieces.pieces(records(spark, sf_dir, ["id", "content"]), "id", "content", g.max_chars, g.overlap_chars)
    return all_pieces.select("id", F.concat("id", F.when(F.col("pieces") > 1, F.concat(F.lit("#c"), "piece")).otherwise("")).alias("key"), "piece", "start", "end", "content", "forced")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {
    "p1_found": r"""
select id, case when regexp_matches(content, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}。！？；，]{1000}[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}。！？；，]{201}') then 'forced' else 'natural' end cut
from (select id, content, row_number() over (partition by id order by ingested_at) rn from memory_record where schema = 1 and id is not null) where rn = 1 and length(content) > 1200"""
}
