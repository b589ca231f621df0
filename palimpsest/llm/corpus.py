"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, mixture
from palimpsest.runtime import cut, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[dict, dict, dict, DataFrame]:
    # Target weights are one row per source: the table is part of the query's settings.
    wanted = table(spark, sf_dir, "mix_target").where(F.col("source").isNotNull()).select(mixture.source_key(F.col("source")).alias("s"), "weight", "max_repeats").collect()
    targets = {r.s: (float(r.weight or 0), int(r.max_repeats or 0)) for r in sorted(wanted) if r.s}
    docs = table(spark, sf_dir, "documents").select("doc_id", mixture.source_key(F.col("source")).alias("source"), "text").where(F.col("source").isin(list(targets)))
    sized = cut(bpe.lengths(docs, ["doc_id", "source"], "text"))
    sums = {r.source: (r.tokens, r.docs) for r in sized.where(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    rate = mixture.rates(targets, {s: t for s, (t, _) in sums.items()})
    return targets, sums, rate, mixture.draw(sized, "doc_id", rate)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the mixture."""
    return _mixture(spark, sf_dir)[3]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source was to have and has of the mixture's tokens."""
    targets, sums, rate, drawn = _mixture(spark, sf_dir)
    plan = spark.createDataFrame([(s, w, m, *(int(x) for x in sums.get(s, (0, 0))), float(rate.get(s, 0.0))) for s, (w, m) in targets.items()], "source string, weight double, max_repeats int, tokens_available bigint, documents_available bigint, copies_expected double")
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max("copy").alias("most_copies"))
    total = drawn.agg(F.sum("n_tokens").alias("all_tokens"))
    both = plan.join(got, "source", "left").join(F.broadcast(total))  # one row
    return both.select("source", "weight", (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", "tokens_available", "documents_available", "copies_expected")


QUERIES = {"p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
