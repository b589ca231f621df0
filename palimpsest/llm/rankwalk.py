"""One ranking from several differently scaled scores.

A walker on the items picks one of the scores at random and an item uniformly, and jumps there if that score ranks it
higher, so all higher items are as likely; else it stays. With a small probability it starts anew anywhere. Items are
ordered by where the walk dwells. Only ranks matter, so no score's range or offset does. A step costs one prefix sum per
score over the sorted items.

An exact check follows: an item moves up past its neighbour while most scores prefer it. So a set whose members each win
most scores against every other item comes first even where the walk should put an outsider between them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.runtime import cut

DAMPING, STEPS, BUCKET_ROWS, HUGE = 0.9, 60, 50_000, 200_000
BLOCK, WINDOW = 2_000, 4_096  # rows settled by insertion, and looked at together when two settled runs are merged
SETTLE_ROWS, PIVOTS = 50_000, 63  # rows of a huge group settled in one task, and items by which larger parts are split


def clean(score):
    """Null and NaN become the lowest value there is."""
    return F.coalesce(F.when(~F.isnan(score), score), F.lit(float("-inf")))


def walk(group: np.ndarray, scores: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Stationary weights of the items of all groups at once. group: consecutive numbers from 0; scores: items by scores."""
    n, k = scores.shape
    size = np.bincount(group)[group].astype(float)
    plans = []
    stay = np.ones(n)
    for s in range(k):
        order = np.lexsort((-scores[:, s], group))  # by group, best first
        g, v = group[order], scores[order, s]
        new_group = np.r_[True, g[1:] != g[:-1]]
        new_tie = new_group | np.r_[True, v[1:] != v[:-1]]
        first = np.flatnonzero(new_tie)[np.cumsum(new_tie) - 1]  # of the item's tie
        start = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
        stay[order] -= (first - start) / size[order] / k
        ends = np.r_[np.flatnonzero(new_group)[1:], n]
        end = ends[np.cumsum(new_group) - 1]
        after = np.r_[np.flatnonzero(new_tie)[1:], n][np.cumsum(new_tie) - 1]  # first item below the tie
        plans.append((order, after, end))
    pi = 1 / size
    for _ in range(steps):
        new = stay * pi
        for order, after, end in plans:
            total = np.r_[0.0, np.cumsum(pi[order])]
            new[order] += (total[end] - total[after]) / size[order] / k
        pi = (1 - damping) / size + damping * new
    return pi


def _inserted(scores: np.ndarray) -> np.ndarray:
    """Each row moves up past its neighbour while the majority of the scores prefers it."""
    n, k = scores.shape
    out = np.empty(n, int)
    for m in range(n):
        at, step = m, 16
        while at:
            beats = ((scores[m] > scores[out[max(0, at - step) : at]]).sum(1) * 2 > k)[::-1]
            at -= len(beats) if beats.all() else int(beats.argmin())
            if not beats.all():
                break
            step *= 4
        out[at + 1 : m + 1] = out[at:m]
        out[at] = m
    return out


def _merged(scores: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two settled runs as one: the head of b goes first only where the majority prefers it, so all new neighbours were compared."""
    out, k, i, j, at = np.empty(len(a) + len(b), int), scores.shape[1], 0, 0, 0
    while i < len(a) and j < len(b):
        xs, ys, second = scores[a[i : i + WINDOW]].tolist(), scores[b[j : j + WINDOW]].tolist(), []
        p = q = 0
        while p < len(xs) and q < len(ys):
            won = sum([y > x for x, y in zip(xs[p], ys[q], strict=True)]) * 2 > k
            second.append(won)
            p, q = p + (not won), q + won
        took, part = np.array(second), out[at : at + len(second)]
        part[took], part[~took] = b[j : j + q], a[i : i + p]
        i, j, at = i + p, j + q, at + len(second)
    out[at:] = np.r_[a[i:], b[j:]]
    return out


def settle(scores: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Order of rows, given in the walk's order, in which no neighbours are against the majority of the scores.

    Down such an order nobody is beaten by the next, so no step leads from outside of a set whose members beat all
    others into it: all such sets come first, however many rows there are. n log n comparisons.
    """
    runs = [a + _inserted(scores[a : a + block]) for a in range(0, len(scores), block)]
    while len(runs) > 1:
        runs = [_merged(scores, *runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0] if runs else np.empty(0, int)


def _places(group: np.ndarray, item: np.ndarray, weight: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places from 1. Rounding makes items whose walks are equal equal, however they were summed; the item decides."""
    place = np.empty(len(group), int)
    order = np.lexsort((item, -weight.round(12), group))
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
        place[rows[settle(scores[rows])]] = np.arange(1, len(rows) + 1)
    return place


def _bucket(cols: list[str], steps: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf[["_g", "_id"]].assign(weight=0.0, place=0)
        group, scores = pd.factorize(pdf["_g"])[0], pdf[cols].to_numpy(float)
        weight = walk(group, scores, steps=steps)
        return pdf[["_g", "_id"]].assign(weight=weight, place=_places(group, pd.factorize(pdf["_id"], sort=True)[0], weight, scores))

    return run


def _huge(items: DataFrame, cols: list[str], steps: int, block: int = 20_000) -> DataFrame:
    """The same walk for groups too large for one task: prefix sums by blocks of ranks, totals of blocks first.

    items(_g, _id, scores, _n). Each step is a union of the scores' rank orders; a block holds at most about `block` ranks.
    """
    long = items.select("_g", "_id", "_n", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(c).alias("v")) for i, c in enumerate(cols)])).alias("x")).select("_g", "_id", "_n", "x.*")
    counts = long.groupBy("_g", "s", "v").agg(F.count(F.lit(1)).alias("c"))
    # Number of higher items per value: within range-sorted chunks, then the chunks before.
    chunks = cut(counts.repartitionByRange(max(2, items.sparkSession.sparkContext.defaultParallelism), "_g", "s", F.col("v").desc()).withColumn("chunk", F.spark_partition_id()))
    before = chunks.groupBy("_g", "s", "chunk").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(W.partitionBy("_g", "s").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inner = W.partitionBy("_g", "s", "chunk").orderBy(F.col("v").desc())
    ranked = chunks.join(before, ["_g", "s", "chunk"]).select("_g", "s", "v", (F.col("base") + F.coalesce(F.sum("c").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("higher"))
    # Of a value that many items share one row stands on the other side of each join, so adaptive execution can split it.
    ranked = cut(long.join(ranked, ["_g", "s", "v"]).select("_g", "_id", "s", "higher", F.floor(F.col("higher") / block).alias("blk")))
    stay = ranked.groupBy("_g", "_id").agg(F.sum("higher").alias("_h"))
    pi = cut(items.select("_g", "_id", "_n", (1 / F.col("_n")).alias("pi")).join(stay, ["_g", "_id"]).withColumn("stay", 1 - F.col("_h") / F.col("_n") / len(cols)).drop("_h"))
    for _ in range(steps):
        x = ranked.join(pi, ["_g", "_id"])
        ties = cut(x.groupBy("_g", "s", "blk", "higher").agg(F.sum("pi").alias("a")))
        totals = ties.groupBy("_g", "s", "blk").agg(F.sum("a").alias("t"))
        below = totals.withColumn("base", F.coalesce(F.sum("t").over(W.partitionBy("_g", "s").orderBy(F.col("blk").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("t")
        inside = F.coalesce(F.sum("a").over(W.partitionBy("_g", "s", "blk").orderBy(F.col("higher").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        flow = ties.withColumn("inside", inside).join(below, ["_g", "s", "blk"]).select("_g", "s", "higher", (F.col("base") + F.col("inside")).alias("inflow"))
        got = x.join(flow, ["_g", "s", "higher"]).groupBy("_g", "_id").agg(F.sum("inflow").alias("got"), F.first("pi").alias("pi"), F.first("_n").alias("_n"), F.first("stay").alias("stay"))
        pi = cut(got.select("_g", "_id", "_n", ((1 - DAMPING) / F.col("_n") + DAMPING * (F.col("stay") * F.col("pi") + F.col("got") / F.col("_n") / len(cols))).alias("pi"), "stay"))
    weighed = pi.select("_g", "_id", F.col("pi").alias("weight")).join(items.drop("_n"), ["_g", "_id"])
    return _settled_by_parts(weighed, cols)


def _beats(cols: list[str], other: str):
    """Whether a row is to stand before the item in the struct column `other`: most scores prefer it, or as many prefer
    either and the walk, then the item's name, does."""
    here = sum(((F.col(c) > F.col(f"{other}.{c}")).cast("int") for c in cols), F.lit(0))
    there = sum(((F.col(c) < F.col(f"{other}.{c}")).cast("int") for c in cols), F.lit(0))
    mine, its = F.round("weight", 12), F.round(F.col(f"{other}.weight"), 12)
    tied = (mine > its) | ((mine == its) & (F.col("_id") < F.col(f"{other}._id")))
    return (2 * here > len(cols)) | ((2 * there <= len(cols)) & tied)


def _settled_by_parts(weighed: DataFrame, cols: list[str], settle_rows: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(_g, _id, weight, place) of groups of any size: quicksort by several pivots at a time. A part of more than
    settle_rows is split by a settled sample of its own, each row between the last pivot that it doesn't beat and the next
    one, which it does; so neighbours are right across parts too, and each part is settled in a task of its own."""
    settle_rows = settle_rows or SETTLE_ROWS
    kinds = [weighed.schema[c].dataType.simpleString() for c in ("_g", "_id")]
    rows = cut(weighed.withColumn("_p", F.array().cast("array<int>")))
    done = None
    item = F.struct("_id", "weight", *cols)

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_w=-pdf["weight"].round(12)).sort_values(["_w", "_id"], ignore_index=True).drop(columns="_w")
        return pdf.iloc[settle(pdf[cols].to_numpy(float))]

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        pdf["_at"] = np.arange(len(pdf), dtype=np.int32)
        return pdf[["_g", "_p", "_at", "_id", "weight", *cols]]

    level = 0
    while True:
        sizes = rows.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("c"))
        large = cut(sizes.where(F.col("c") > settle_rows))
        small = rows.join(large.drop("c"), ["_g", "_p"], "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            break
        part = rows.join(large, ["_g", "_p"])
        # About 4 times as many by hash as are asked for, of which the first by hash are taken: no part is gathered.
        drawn = part.withColumn("h", F.xxhash64("_id", F.lit(level))).where(F.pmod("h", F.lit(1 << 40)) < (4.0 * pivots * (1 << 40)) / F.col("c"))
        first = drawn.withColumn("i", F.row_number().over(W.partitionBy("_g", "_p").orderBy("h", "_id"))).where(F.col("i") <= pivots)
        chosen = cut(first.select("_g", "_p", "_id", "weight", *cols).groupBy("_g", "_p").applyInPandas(ordered, f"_g {kinds[0]}, _p array<int>, _at int, _id {kinds[1]}, weight double, {', '.join(f'{c} double' for c in cols)}"))
        by = chosen.groupBy("_g", "_p").agg(F.array_sort(F.collect_list(F.struct("_at", item.alias("x")))).alias("pivots"))
        rest = part.drop("c").join(chosen.select("_g", "_p", "_id"), ["_g", "_p", "_id"], "left_anti").join(by, ["_g", "_p"])
        rest = rest.withColumn("lo", F.lit(0)).withColumn("hi", F.size("pivots"))
        for _ in range(pivots.bit_length() + 1):  # bisection: lo becomes the number of pivots that stand before the row
            middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
            rest = rest.withColumn("mid", middle).withColumn("at", F.get("pivots", F.col("mid"))["x"])
            open_ = F.col("lo") < F.col("hi")
            wins = _beats(cols, "at")
            rest = rest.withColumn("hi_", F.when(open_ & wins, F.col("mid")).otherwise(F.col("hi"))).withColumn("lo", F.when(open_ & ~wins, F.col("mid") + 1).otherwise(F.col("lo"))).drop("hi").withColumnRenamed("hi_", "hi")
        split = rest.select("_g", "_id", "weight", *cols, F.concat("_p", F.array(2 * F.col("lo"))).alias("_p"))
        done = done.unionByName(chosen.select("_g", "_id", "weight", *cols, F.concat("_p", F.array(2 * F.col("_at") + 1)).alias("_p")).select(done.columns))
        rows, level = cut(split.select(rows.columns)), level + 1

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        return pdf[["_g", "_p", "_id", "weight"]].assign(pos=np.arange(1, len(pdf) + 1))

    done = cut(done)
    inside = done.groupBy("_g", "_p").applyInPandas(numbered, f"_g {kinds[0]}, _p array<int>, _id {kinds[1]}, weight double, pos bigint")
    before = done.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    return inside.join(before, ["_g", "_p"]).select("_g", "_id", "weight", (F.col("before") + F.col("pos")).alias("place"))


def rank(items: DataFrame, group: str, item: str, scores: list[str], huge: int = HUGE, steps: int = STEPS) -> DataFrame:
    """(group, item, weight, place): one ranking per group.

    items: one row per (group, item); null and NaN scores rank below any other; infinite ones as they compare. Equal
    weights are ordered by the item; neighbours are swapped in the whole group. Rows with a null group or item are left
    out. Extra columns are ignored; an empty table gives no rows. Groups of more than `huge` items are walked by
    distributed prefix sums and settled in parts, smaller ones are gathered, whole, into buckets of about 50 000 rows per
    task.
    """
    rows = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("_g"), F.col(item).alias("_id"), *[clean(F.col(c)).alias(f"_s{i}") for i, c in enumerate(scores)])
    cols = [f"_s{i}" for i in range(len(scores))]
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    total, n_huge = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum((F.col("_n") > huge).cast("int")), F.lit(0))).first()
    buckets = max(1, -(-total // BUCKET_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    small = rows
    if n_huge:
        rows = rows.join(sizes, "_g")
        small = rows.where(F.col("_n") <= huge).drop("_n")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_g", "_id")]
    out = small.groupBy(F.pmod(F.xxhash64("_g"), F.lit(buckets)).alias("_b")).applyInPandas(_bucket(cols, steps), f"_g {kinds[0]}, _id {kinds[1]}, weight double, place int")
    if n_huge:
        out = out.unionByName(_huge(cut(rows.where(F.col("_n") > huge)), cols, steps))
    return out.select(F.col("_g").alias(group), F.col("_id").alias(item), "weight", F.col("place").cast("int").alias("place"))
