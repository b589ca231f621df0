"""Mixing sources to target weights.

Every document of a source is expected in the mixture equally often. Systematic sampling: with the documents of a source
in order of size, the expected copies are summed up from a random offset, and a document is emitted once for each whole
number passed within it. Ordered by size, the tokens drawn are close to what is expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.runtime import cut

#: Rows that are numbered in one task.
RANGE_ROWS = 2_000_000


def source_key(source: Column) -> Column:
    """Sources are equal when letter case, surrounding blanks and `-` versus `_` are ignored; blank ones are none."""
    key = F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), "_", "-")
    return F.when(key != "", key)


def rates(targets: dict[str, tuple[float, int]], sizes: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Expected copies of each document, by source.

    targets: weight and most copies by source; sizes: tokens there are. The mixture is to have `total` tokens (all there
    are, if not given). A source that can't fill its share gives all it may, and the others share the rest by weight.
    """
    present = {s: w for s, (w, _) in targets.items() if sizes.get(s, 0) > 0 and w > 0}
    room = {s: sizes[s] * max(0, targets[s][1]) for s in present}
    left, open_, tokens = float(sum(sizes.get(s, 0) for s in targets) if total is None else total), set(present), {}
    while open_:
        weight = sum(present[s] for s in open_)
        full = {s for s in open_ if room[s] < left * present[s] / weight}
        if not full:
            tokens |= {s: left * present[s] / weight for s in open_}
            break
        tokens |= {s: float(room[s]) for s in full}
        left -= sum(room[s] for s in full)
        open_ -= full
    return {s: min(float(max(0, targets[s][1])), t / sizes[s]) for s, t in tokens.items()}


def numbered(rows: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """rows with `rank`, counted from 1 within `group` in the given order, without gathering a group in one task:
    ranges of (group, order) are numbered on their own and moved on by the counts of the ranges before."""
    parts = parts or max(2, rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    chunks = cut(rows.repartitionByRange(parts, group, *order).withColumn("_chunk", F.spark_partition_id()))
    before = W.partitionBy(group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = chunks.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = chunks.withColumn("_i", F.row_number().over(W.partitionBy(group, "_chunk").orderBy(*order)))
    return inside.join(base, [group, "_chunk"]).withColumn("rank", F.col("_base") + F.col("_i")).drop("_base", "_i", "_chunk")


def draw(sized: DataFrame, key: str, copies: dict[str, float], seed: int = 0) -> DataFrame:
    """(source, key, n_tokens, copy): a row for each copy of a document in the mixture, copies numbered from 1.

    sized(source, key, n_tokens). Sources without a rate, null sources and documents without tokens are left out.
    Equal sizes are ordered by the key. Repeated rows count as documents of their own. Empty input gives no rows.
    """
    spark = sized.sparkSession
    rate = spark.createDataFrame([(s, float(r)) for s, r in copies.items() if r > 0], "source string, rate double")
    rows = sized.where((F.col("n_tokens") > 0) & F.col("source").isin(list(copies)))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ranked = numbered(rows.select("source", key, "n_tokens"), "source", ["n_tokens", key]).join(rate, "source")
    n = F.floor(F.col("rate") * F.col("rank") + offset) - F.floor(F.col("rate") * (F.col("rank") - 1) + offset)
    return ranked.withColumn("_n", n.cast("int")).where(F.col("_n") > 0).select("source", key, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
