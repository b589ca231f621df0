"""Parent-child links of unknown depth to full hierarchies.

Each level contracts the chains that lie within one partition to their exits, solves the smaller forest of the exits'
fragments the same way, and expands. A node is placed with its parent by coin flips (child heads, parent tails), so an
expected constant share of the inner nodes vanishes at each level however the keys are spread; a level that fits one
task (`leaf_rows`, a fixed bound) ends the recursion. Loops inside a partition are found there, loops across
partitions at the level where they have become local; the smallest id on the way is carried along. Fragments carry the
nodes they pass only where paths are asked for: depth and root need none, so chains of any length fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import cut

EDGE = "node string, exit string, hops bigint, least string, frag array<string>, looped boolean"
HEAVY, LEAF_ROWS = 20_000, 1_000


def contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chains within one task to their exits. frag: the nodes passed, the node itself first, the exit not included; null
    where no paths are asked for."""
    node, to, least, looped = (pdf[c].tolist() for c in ("node", "exit", "least", "looped"))
    hops, frag = pdf["hops"].tolist(), [None if f is None else list(f) for f in pdf["frag"].tolist()]
    at = {x: i for i, x in enumerate(node)}
    nxt = [-1 if looped[i] else at.get(to[i], -1) for i in range(len(node))]
    state = [0] * len(node)  # 0 untouched, 1 on the way, 2 done
    for start in range(len(node)):
        trail, i = [], start
        while i >= 0 and state[i] == 0:
            state[i] = 1
            trail.append(i)
            i = nxt[i]
        if i >= 0 and state[i] == 1:  # a loop inside this task
            low = min(least[x] for x in trail[trail.index(i) :])
            for x in trail:
                to[x], hops[x], least[x], looped[x], state[x] = low, 0, low, True, 2
                frag[x] = None if frag[x] is None else [node[x]]
            continue
        for x in reversed(trail):
            state[x], n = 2, nxt[x]
            if n < 0:
                continue
            if looped[n]:
                to[x], hops[x], least[x], looped[x] = to[n], hops[n], least[n], True
                frag[x] = None if frag[x] is None else [node[x]]
            else:
                to[x], hops[x], least[x] = to[n], hops[x] + hops[n], min(least[x], least[n])
                frag[x] = None if frag[x] is None else frag[x] + frag[n]
    return pd.DataFrame({"node": node, "exit": to, "hops": hops, "least": least, "frag": frag, "looped": looped})


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if parts:
        yield contract(pd.concat(parts, ignore_index=True))


def _solve(edges: DataFrame, level: int, leaf_rows: int, most: int) -> DataFrame:
    n = edges.count()
    if n <= leaf_rows:
        return cut(edges.coalesce(1).mapInPandas(_local, EDGE)) if n else edges
    if level >= most:
        raise RuntimeError(f"{n} links left after {most} levels")
    inner = edges.groupBy(F.col("exit").alias("node")).agg(F.count(F.lit(1)).alias("indegree"))
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2))
    # A leaf stays where it is; an inner node moves to its parent unless that would pile a hub's children on one task.
    heavy = inner.where(F.col("indegree") > HEAVY).select(F.col("node").alias("hub"))
    own = inner.select(F.col("node").alias("inner"))
    e = edges.join(own, F.col("node") == F.col("inner"), "left").join(heavy, F.col("exit") == F.col("hub"), "left")
    moves = F.col("inner").isNotNull() & F.col("hub").isNull() & (coin(F.col("node")) == 1) & (coin(F.col("exit")) == 0)
    parts = max(2, -(-n // leaf_rows))
    placed = e.select(*edges.columns, F.when(moves, F.col("exit")).otherwise(F.col("node")).alias("_at")).repartition(parts, "_at").drop("_at")
    short = cut(placed.mapInPandas(_local, EDGE))
    entries = short.where(~F.col("looped")).select(F.col("exit").alias("e")).distinct()
    quotient = cut(short.join(entries, F.col("node") == F.col("e"), "left_semi"))
    solved = _solve(quotient, level + 1, leaf_rows, most)
    up = solved.select(F.col("node").alias("u"), F.col("exit").alias("u_exit"), F.col("hops").alias("u_hops"), F.col("least").alias("u_least"), F.col("frag").alias("u_frag"), F.col("looped").alias("u_looped"))
    j = short.join(up, (F.col("exit") == F.col("u")) & ~F.col("looped"), "left")
    hit, loop = F.col("u").isNotNull(), F.coalesce("u_looped", F.lit(False))
    return cut(
        j.select(
            "node",
            F.when(hit, F.col("u_exit")).otherwise(F.col("exit")).alias("exit"),
            F.when(loop, F.lit(0)).when(hit, F.col("hops") + F.col("u_hops")).otherwise(F.col("hops")).alias("hops"),
            F.when(loop, F.col("u_least")).when(hit, F.least("least", "u_least")).otherwise(F.col("least")).alias("least"),
            F.when(F.col("frag").isNull(), None).when(loop, F.array("node")).when(hit, F.concat("frag", "u_frag")).otherwise(F.col("frag")).alias("frag"),
            (F.col("looped") | loop).alias("looped"),
        )
    )


def resolve(links: DataFrame, leaf_rows: int = LEAF_ROWS, most_levels: int = 200, paths: bool = True) -> DataFrame:
    """(node, root, depth, path, looped) of every node of the forest that `links(node, parent)` spans.

    One parent per node is expected; of several the smallest counts. Null nodes or parents are no links. A node that
    is only a parent is a root: depth 0, path of itself. path runs from the root to the node. A chain that runs into a
    loop (a node that is its own parent is one) has looped true, depth -1, root the smallest node on the loop and a
    null path. An empty table gives no rows. Extra columns are ignored. Without `paths` all paths are null, and a chain
    of n nodes costs n rows rather than the square of it.
    """
    edges = links.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("exit"))
    edges = cut(edges.select("node", "exit", F.lit(1).cast("bigint").alias("hops"), F.col("node").alias("least"), (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("frag"), F.lit(False).alias("looped")))
    solved = _solve(edges, 0, leaf_rows, most_levels)
    below = solved.select("node", F.when(F.col("looped"), F.col("least")).otherwise(F.col("exit")).alias("root"), F.when(F.col("looped"), F.lit(-1)).otherwise(F.col("hops")).cast("int").alias("depth"), F.when(~F.col("looped"), F.reverse(F.concat("frag", F.array("exit")))).alias("path"), "looped")
    roots = below.where(~F.col("looped")).select("root").distinct().select(F.col("root").alias("node"), "root", F.lit(0).alias("depth"), (F.array("root") if paths else F.lit(None).cast("array<string>")).alias("path"), F.lit(False).alias("looped"))
    return below.unionByName(roots)


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair on a path; nodes that run into a loop have none."""
    ancestors = resolved.where(F.col("depth") > 0).select(F.col("node").alias("descendant"), F.col("depth"), F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "ancestor"))
    return ancestors.select("ancestor", "descendant", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
