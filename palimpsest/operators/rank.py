"""Ranking of a query's pool: access feedback, dual strengths, hybrid relevance, fidelity levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import score, text
from palimpsest.functions import vocabulary as V


def fold_access(log: DataFrame, key: str = "id") -> DataFrame:
    """(key, extra): turns of an access log in order of seq; replayed rows once; rows without key or turn are left out."""
    rows = log.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).select(key, "seq", "turn").distinct()
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "turn"))), lambda x: x["turn"]).alias("extra"))


def with_access(records: DataFrame, folded: DataFrame, now) -> DataFrame:
    """records with log, ss and rs as they are after their accesses."""
    return accessed(records.join(folded, "id", "left"), now)


def accessed(records: DataFrame, now) -> DataFrame:
    """The same for records that have their accesses, `extra`, already."""
    return records.withColumns(score.accessed(F.col("accessLog"), F.col("extra"), F.col("turn"), F.col("storageStrength"), F.col("retrievalStrength"), now))


def scored(pool: DataFrame, weights: tuple[float, float, float], query: str = "query") -> DataFrame:
    """pool(query, content, turn, log, ss, rs, sem, w, now) with lexical and score."""
    t = pool.withColumns({"_q": text.tokens(F.col(query)), "_r": text.tokens(F.col("content"))})
    lexical = text.overlap(F.col("_q"), F.col("_r")) * F.when(text.shared(F.col("_q"), F.col("_r")) == 1, V.SINGLE_TERM).otherwise(1.0)
    t = t.withColumn("lexical", lexical).drop("_q", "_r")
    relevance = score.corroborated(F.col("lexical"), F.col("sem"), F.col("w"))
    return t.withColumn("score", score.record_score(relevance, score.retrieval_strength(F.col("rs"), F.col("turn"), F.col("now")), F.col("ss"), score.base_level(F.col("log"), F.col("now")), weights))


def placed(rows: DataFrame, group: str = "query_id", by: str = "score", tie: str = "id") -> DataFrame:
    """rows with pos, from 1, by falling score; scores equal to nine digits are ordered by the id."""
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(group).orderBy(F.round(by, 9).desc(), tie)))


def fidelity(rows: DataFrame, group: str = "query_id") -> DataFrame:
    """Level of each placed row: the first part full, the next summary, the rest anchor; at least one is full."""
    n = F.count(F.lit(1)).over(W.partitionBy(group))
    full = F.greatest(F.lit(1), F.floor(n * V.LEVELS[0] + 1e-9))
    summary = F.greatest(F.lit(0), F.floor(n * (V.LEVELS[0] + V.LEVELS[1]) + 1e-9) - full)
    return rows.withColumn("level", F.when(F.col("pos") <= full, "full").when(F.col("pos") <= full + summary, "summary").otherwise("anchor"))


def per_trace(rows: DataFrame, k: int, group: str = "query_id") -> DataFrame:
    """At most k placed rows of a trace; rows without one are all kept."""
    n = F.row_number().over(W.partitionBy(group, "trace").orderBy("pos"))
    return rows.withColumn("_n", n).where(F.col("trace").isNull() | (F.col("_n") <= max(1, k))).drop("_n")


def first_of_content(rows: DataFrame, group: str = "query_id") -> DataFrame:
    n = F.row_number().over(W.partitionBy(group, "content").orderBy("pos"))
    return rows.withColumn("_n", n).where(F.col("_n") == 1).drop("_n")


def budget_prefix(rows: DataFrame, budget, k, group: str = "query_id", size: str = "content") -> DataFrame:
    """The first rows within k places and a budget of characters; the first is always let in."""
    w = W.partitionBy(group).orderBy("pos")
    sized = rows.withColumns({"place": F.row_number().over(w), "chars_so_far": F.sum(F.length(size)).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return sized.where((F.col("place") <= k) & ((F.col("chars_so_far") <= budget) | (F.col("place") == 1)))


def diverse(rows: DataFrame, bonus: float, group: str = "query_id") -> DataFrame:
    """Places with each trace's best row raised by the bonus: what picking greedily by score and novelty gives, for scores of 0 and more."""
    best = F.row_number().over(W.partitionBy(group, "trace").orderBy("pos"))
    raised = rows.withColumn("adjusted", F.col("score") * F.when(best == 1, 1 + bonus).otherwise(1.0))
    return raised.withColumn("diverse_pos", F.row_number().over(W.partitionBy(group).orderBy(F.round("adjusted", 9).desc(), "pos")))


def reranked(rows: DataFrame, scores: str, group: str = "query_id", top: int = 40) -> DataFrame:
    """The first rows reordered by outside scores, missing ones last; nothing is dropped."""
    outside = F.when(F.col("pos") <= top, F.coalesce(F.nanvl(scores, F.lit(-1.0)), F.lit(-1.0)))
    return rows.withColumn("reranked", F.row_number().over(W.partitionBy(group).orderBy((F.col("pos") > top).cast("int"), outside.desc(), "pos")))


def session_sample(rows: DataFrame, key: list[str], session: str, order: list[str], each: int = 3, most: int = 90) -> DataFrame:
    """rows with `number`: the first `each` of every session, up to `most` of a key, in order; rows without a session are one.
    The first window is cut to `each` rows of a session before the second one sees them."""
    own = W.partitionBy(*key, F.coalesce(session, F.lit("?"))).orderBy(*order)
    few = rows.withColumn("_i", F.row_number().over(own)).where(F.col("_i") <= each).drop("_i")
    return few.withColumn("number", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("number") <= most)
