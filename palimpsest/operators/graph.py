"""Association graph and spreading activation.

Records are tied by what they share: a task, a file, a source. Groups up to `bound` members give an edge for each pair;
larger ones a hub node of their own, so a group of a third of all rows stays linear: activation passes through the hub
with the pair's weight and what a member sent comes off its own share. Records that share several keys of a kind are
tied once: activation passes between sets of large keys that have one in common, not through each key by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V
from palimpsest.runtime import cut

BOUND = 500


def memberships(pool: DataFrame, part: str) -> DataFrame:
    """(part, kind, key, id) of every tie of pool(part, id, taskref, path, paths, sourceRefs)."""
    files = F.array_distinct(F.filter(F.concat(F.array("path"), F.coalesce("paths", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != "")))
    refs = F.array_distinct(F.filter(F.coalesce("sourceRefs", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")))
    ties = [pool.where(F.trim("taskref") != "").select(part, F.lit("task").alias("kind"), F.trim("taskref").alias("key"), "id"), pool.select(part, F.lit("file").alias("kind"), F.explode(files).alias("key"), "id"), pool.select(part, F.lit("source").alias("kind"), F.explode(refs).alias("key"), "id")]
    return ties[0].unionByName(ties[1]).unionByName(ties[2]).distinct()


def _in_blocks(sized: DataFrame, part: str, block: int) -> DataFrame:
    """(part, src, dst, kind) of all pairs of members of sized(part, kind, key, id, n); a large group's pairs of blocks of
    about `block` members meet in rows of their own."""
    b = sized.withColumn("of", F.ceil(F.col("n") / block)).withColumn("b", F.pmod(F.xxhash64("id"), F.col("of")))
    left = b.select(part, "kind", "key", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.col("of") - 1)).alias("j"), F.col("id").alias("x"))
    right = b.select(part, "kind", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b"))).alias("i"), F.col("b").alias("j"), F.col("id").alias("y"))
    both = left.join(right, [part, "kind", "key", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return both.select(part, F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "kind")


def _key_sets(hubs: DataFrame, part: str) -> DataFrame:
    """(part, kind, id, keys, weight): the large keys of each record."""
    return hubs.groupBy(part, "kind", "id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.first("weight").alias("weight"))


def edges(pool: DataFrame, part: str, bound: int | None = BOUND) -> tuple[DataFrame, DataFrame]:
    """(pairs(part, src, dst, kind, weight), hubs(part, kind, key, id, weight)): pairs with src < dst, once for each kind.

    Pairs that share a large key as well are left to its hub. Without a bound all groups give their pairs, in blocks, and
    there are no hubs.
    """
    m = memberships(pool, part)
    size = m.groupBy(part, "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    sized = m.join(size.where(F.col("n") > 1), [part, "kind", "key"])
    weight = F.element_at(F.create_map(*[x for k, v in V.EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    if bound is None:
        tied, large = _in_blocks(sized, part, BOUND), sized.where(F.lit(False))
    else:
        small, large = sized.where(F.col("n") <= bound), sized.where(F.col("n") > bound)
        both = small.select(part, "kind", "key", F.col("id").alias("src")).join(small.select(part, "kind", "key", F.col("id").alias("dst")), [part, "kind", "key"]).where(F.col("src") < F.col("dst"))
        sets = _key_sets(large.withColumn("weight", weight), part)
        of = lambda end: sets.select(part, "kind", F.col("id").alias(end), F.col("keys").alias(f"{end}_keys"))
        own = both.select(part, "src", "dst", "kind").join(of("src"), [part, "kind", "src"], "left").join(of("dst"), [part, "kind", "dst"], "left")
        tied = own.where(~F.coalesce(F.arrays_overlap("src_keys", "dst_keys"), F.lit(False))).select(part, "src", "dst", "kind")
    ids = pool.select(part, "id")
    sup = pool.where(F.col("supersededBy").isNotNull()).select(part, F.col("id").alias("a"), F.lower(F.trim("supersededBy")).alias("b")).join(ids.withColumnRenamed("id", "b"), [part, "b"]).where(F.col("a") != F.col("b"))
    superseding = sup.select(part, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit("supersede").alias("kind"))
    w = W.partitionBy(part).orderBy("turn", "id")
    near = pool.withColumn("episode", (F.col("layer") == "L0") & (F.col("kind") == "episodic")).select(part, "id", "turn", "episode").withColumns({"to": F.lead("id").over(w), "to_episode": F.lead("episode").over(w)})
    adjacent = near.where(F.col("episode") & F.col("to_episode")).select(part, F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"), F.lit("adjacent").alias("kind"))
    pairs = tied.unionByName(superseding).unionByName(adjacent).distinct().withColumn("weight", weight)
    return pairs, large.select(part, "kind", "key", "id").withColumn("weight", weight)


def spread(pairs: DataFrame, hubs: DataFrame, seeds: DataFrame, part: str, hops: int = 2) -> DataFrame:
    """(part, id, energy, place): records that the seeds' activation reaches, the seeds themselves left out.

    seeds(part, id, energy). Each hop passes half of the energy times the edge's weight; what arrives is summed up.
    """
    sets = cut(_key_sets(hubs, part))
    each = sets.select(part, "kind", "keys").distinct().withColumn("key", F.explode("keys"))
    meets = cut(each.join(each.withColumnRenamed("keys", "to"), [part, "kind", "key"]).select(part, "kind", "keys", "to").distinct())
    out = pairs.select(part, F.col("src").alias("id"), F.col("dst").alias("to"), "weight").unionByName(pairs.select(part, F.col("dst").alias("id"), F.col("src").alias("to"), "weight"))
    frontier, total = seeds.select(part, "id", "energy"), None
    for _ in range(hops):
        direct = frontier.join(out, [part, "id"]).select(part, F.col("to").alias("id"), (F.col("energy") * F.col("weight") * V.SPREAD_DECAY).alias("gain"))
        sent = sets.join(frontier, [part, "id"], "left").withColumn("own", F.coalesce("energy", F.lit(0.0)))
        sums = sent.where(F.col("own") > 0).groupBy(part, "kind", "keys").agg(F.sum("own").alias("sum"))
        arrived = meets.join(sums, [part, "kind", "keys"]).groupBy(part, "kind", F.col("to").alias("keys")).agg(F.sum("sum").alias("all"))
        through = sent.join(arrived, [part, "kind", "keys"]).select(part, "id", ((F.col("all") - F.col("own")) * F.col("weight") * V.SPREAD_DECAY).alias("gain")).where(F.col("gain") > 0)
        frontier = cut(direct.unionByName(through).groupBy(part, "id").agg(F.sum("gain").alias("energy")))
        total = frontier if total is None else total.unionByName(frontier)
    reached = total.groupBy(part, "id").agg(F.sum("energy").alias("energy")).join(seeds.select(part, "id"), [part, "id"], "left_anti")
    reached = reached.where(F.round("energy", 9) >= V.SPREAD_LEAST)
    return reached.withColumn("place", F.row_number().over(W.partitionBy(part).orderBy(F.round("energy", 9).desc(), "id"))).where(F.col("place") <= V.SPREAD_MOST)


def similar(pool: DataFrame, part: str, least: float = 0.75, most: int = 2000) -> DataFrame:
    """(part, src, dst, weight): similarity edges of parts of up to `most` records (larger parts have none by definition).
    pool(part, id, vec)."""
    import numpy as np
    import pandas as pd

    rows = pool.where(F.size("vec") > 0).select(part, "id", "vec")
    n = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(2, most))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("id")
        for _, same in pdf.groupby(pdf["vec"].map(len)):
            v = np.stack([np.asarray(x, float) for x in same["vec"]])
            norm = np.linalg.norm(v, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            v, ids = v[ok] / norm[ok][:, None], same["id"].to_numpy()[ok]
            i, j = np.nonzero(np.triu(v @ v.T >= least, 1))
            out += list(zip([pdf[part].iloc[0]] * len(i), ids[i], ids[j], (v[i] * v[j]).sum(1), strict=True))
        return pd.DataFrame(out, columns=[part, "src", "dst", "weight"])

    return rows.join(n, part).drop("_n").groupBy(part).applyInPandas(near, f"{part} string, src string, dst string, weight double")
