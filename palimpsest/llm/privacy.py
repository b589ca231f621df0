"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import pii
from palimpsest.runtime import table
from palimpsest.sources.records import notes, records


def _field(spark: SparkSession, sf_dir: str) -> pii.Field:
    # The lexicon is a table of fixed size, part of the operator's settings.
    names = [(r.name, r.role) for r in table(spark, sf_dir, "name_lexicon").where("name is not null and role is not null").collect()]
    return pii.trained(spark, names)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, ["id", "content"]).unionByName(notes(spark, sf_dir, ["id", "content"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = _field(spark, sf_dir)
    return pii.find(_texts(spark, sf_dir), "id", "content", field).select("id", "kind", "value").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record and note with its finds replaced by placeholders."""
    field = _field(spark, sf_dir)
    return pii.redact(_texts(spark, sf_dir), "id", "content", field)


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
SQL: dict[str, str] = {}
