"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import sentences
from palimpsest.runtime import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.split(docs, "doc_id", "text", sentences.fitted(docs, "doc_id", "text"))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units themselves, numbered from 0 in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.units(docs, "doc_id", "text", sentences.fitted(docs, "doc_id", "text"))


QUERIES = {"p10_found": p10_found, "p10_sentences": p10_sentences}
SQL: dict[str, str] = {}
