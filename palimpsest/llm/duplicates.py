"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import neardup
from palimpsest.sources.records import records

# TESTDATA.md's settings of the problem.
SIMILARITY, WIDTH, LEAST_WORDS = 0.6, 3, 40


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.links(records(spark, sf_dir, ["id", "content"]), "id", "content", SIMILARITY, WIDTH, LEAST_WORDS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.expand(*_links(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(*_links(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
_SETS = r"""
with rec as (select id, content from (select *, row_number() over (partition by id order by ingested_at) rn from memory_record where schema = 1 and id is not null) where rn = 1 and content is not null),
w as (select id, regexp_extract_all(regexp_replace(lower(content), '([\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') ws from rec),
s as (select id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) runs from w where len(ws) >= 40),
e as (select id, len(runs) n, unnest(runs) run from s),
c as (select a.id id_a, b.id id_b, count(*) c, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.run = b.run and a.id < b.id group by 1, 2)
"""
SQL = {"p5_found": _SETS + "select id_a, id_b from c where c >= 0.6 * (na + nb - c)"}
