"""Most similar vectors for every vector.

Unit vectors are projected on a few Gaussian directions. Such projections are stable: the squared projected distance of
a pair at distance d is d² times a chi-square variable. A kd-tree over the projections, its upper part fitted on a bounded
sample and its lower parts on the rows of a block, is searched for the nearest projected neighbours, which are verified
with the true vectors. The search of a query stops at the projected distance beyond which the chi-square test leaves less
than 1 - `confidence` for a vector within the wanted distance (that of the k-th best so far, or a fixed one).

For all pairs above a similarity the boxes of cells exclude little, so a vector isn't sent to all cells in reach: it has one
cell in each of several tables, that of the Gaussian direction on which its projection is largest, with the sign. Two vectors
share a cell of a table with a chance that follows from their cosine alone, and there are as many tables as leave less than
the wanted share of pairs without a common cell. The rows of a cell are divided again in the same way and then searched.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import samples
from palimpsest.runtime import cut

DIRECTIONS, CONFIDENCE, SAMPLE_ROWS, BLOCK_ROWS, LEAF_ROWS = 16, 0.999, 20_000, 50_000, 512
#: Other blocks that a query is sent to in the rounds of a search for neighbours; None: all that may still hold a nearer one.
ROUNDS = (2, None)
#: Rows of a cell of a table on average at most, and beyond which it is searched in pairs of parts; rows that are searched at once;
#: share of the alike pairs in a cell that its own division finds.
CELL_ROWS, PART_ROWS, GROUP_ROWS, GROUPED = 400_000, 1_000_000, 256, 0.95
#: Rows that are sent before the next tables are begun, and the fewest tables at a time; what was sent for the last can then be deleted.
PASS_ROWS, PASS_TABLES = 4_000_000, 4


def chi2_quantile(p: float, m: int) -> float:
    """Of the chi-square distribution with an even number `m` of degrees of freedom, by bisection."""
    lo, hi = 0.0, 40.0 * m
    for _ in range(100):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


def directions(dim: int, m: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m))


@functools.lru_cache
def shared_chance(m: int, similarity: float) -> float:
    """Chance that two unit vectors of the cosine have their largest projection on the same of m Gaussian directions, with the
    same sign, by simulation: projections of the two on a direction are normal and correlate by the cosine."""
    r, hits, n, step = np.random.default_rng(7), 0, 0, max(1, (1 << 20) // m)
    while n < 50_000:
        a = r.normal(size=(step, m))
        hits += int((peaks(a) == peaks(similarity * a + math.sqrt(max(0.0, 1 - similarity**2)) * r.normal(size=a.shape))).sum())
        n += step
    return max(hits, 1) / n


def tables(chance: float, missed: float) -> int:
    """Tables after which at most the share `missed` of pairs has had no common cell."""
    return 1 if chance >= 1 - missed else math.ceil(math.log(missed) / math.log1p(-chance))


def peaks(p: np.ndarray) -> np.ndarray:
    """Of each row the place of its largest entry by size, twice, and one more if that is negative."""
    at = np.abs(p).argmax(1)
    return 2 * at + (p[np.arange(len(p)), at] < 0)


def codes(u: np.ndarray) -> np.ndarray:
    """Vectors in a byte for each component; their directions differ from the vectors' by `code_angle` at most."""
    return np.rint(u * (127 / np.abs(u).max(axis=1, keepdims=True))).astype(np.int8)


def code_angle(c: np.ndarray) -> float:
    """Largest angle between a vector and its code."""
    least = math.sqrt(float((c.astype(np.float32) ** 2).sum(1).min()))
    return math.asin(min(1.0, math.sqrt(c.shape[1]) / 2 / least))


def grouped(c: np.ndarray, own: np.ndarray, similarity: float, stop: float, gauss: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), i before j, of coded vectors that may have at least the cosine, from groups of rows with equal peaks on two
    sets of directions. own: pairs within the first part or the second alone are left out, unless all rows have one value."""
    m = max(1, math.ceil(math.sqrt(len(c) / GROUP_ROWS) / 2))
    rounds = tables(shared_chance(m, similarity) ** 2, 1 - GROUPED) if len(c) > 2 * GROUP_ROWS else 1
    angle = 2 * code_angle(c)
    least = math.cos(min(math.pi, math.acos(min(1.0, similarity)) + angle)) - 1e-6
    reach = (math.sqrt(stop) + angle * math.sqrt(stop / max(1e-12, 2 - 2 * similarity))) ** 2
    two = own.any() and not own.all()
    r = np.random.default_rng([5, seed])
    for _ in range(rounds):
        group = np.zeros(len(c), np.int64)
        if rounds > 1:
            turn = r.normal(size=(c.shape[1], 2 * m)).astype(np.float32)
            for at in range(0, len(c), 1 << 16):
                p = c[at : at + (1 << 16)].astype(np.float32) @ turn
                group[at : at + (1 << 16)] = peaks(p[:, :m]) * (2 * m) + peaks(p[:, m:])
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True])
        left, right, n = [], [], 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[a:b]
            if b - a < 2 or two and len(set(own[rows].tolist())) < 2:
                continue
            v = c[rows].astype(np.float32)
            v /= np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
            p = v @ gauss
            for i, j, _cos in within(v, p, v, p, least, reach, True):
                i, j = rows[i], rows[j]
                if two:
                    apart = own[i] != own[j]
                    i, j = i[apart], j[apart]
                left.append(np.minimum(i, j))
                right.append(np.maximum(i, j))
                n += len(i)
                if n > 1 << 18:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, n = [], [], 0
        if n:
            yield np.concatenate(left), np.concatenate(right)


def usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector has `dim` finite components, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Splits:
    """The upper part of the kd-tree: `axis` and `at` of its inner nodes in heap order, boxes of its cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.depth, m = depth, sample.shape[1]
        self.axis, self.at = np.zeros(2**depth, int), np.zeros(2**depth)
        parts = {1: np.arange(len(sample))}
        box = {1: np.array([np.full(m, -np.inf), np.full(m, np.inf)])}
        for node in range(1, 2**depth):
            rows = parts.pop(node)
            p = sample[rows]
            a = int(np.argmax(np.ptp(p, axis=0))) if len(rows) else 0
            t = float(np.median(p[:, a])) if len(rows) else 0.0
            self.axis[node], self.at[node] = a, t
            left = p[:, a] < t if len(rows) else np.zeros(0, bool)
            parts[2 * node], parts[2 * node + 1] = rows[left], rows[~left]
            b = box.pop(node)
            box[2 * node], box[2 * node + 1] = b.copy(), b.copy()
            box[2 * node][1, a], box[2 * node + 1][0, a] = t, t
        self.boxes = np.array([box[2**depth + i] for i in range(2**depth)])

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), int)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] >= self.at[node])
        return node - 2**self.depth


def box_distance2(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of points to a box."""
    d = np.maximum(np.maximum(lo - p, p - hi), 0)
    return np.einsum("ij,ij->i", d, d)


def leaves(p: np.ndarray, size: int = LEAF_ROWS) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree over p."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        a = int(np.argmax(np.ptp(p[rows], axis=0)))
        order = np.argpartition(p[rows, a], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def within(q: np.ndarray, qp: np.ndarray, d: np.ndarray, dp: np.ndarray, similarity: float, stop: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of d, cosines) of the pairs with at least the cosine, some at a time. stop: squared projected distance to
    stop at."""
    left = np.c_[qp, -(qp**2).sum(1) / 2, np.ones(len(qp))].astype(np.float32)
    right = np.c_[dp, np.ones(len(dp)), -(dp**2).sum(1) / 2].astype(np.float32)
    bound = np.float32(-stop / 2 - 1e-3)
    for rows in leaves(dp):
        whole = len(rows) == len(dp)
        near = np.arange(len(qp)) if whole else np.flatnonzero(box_distance2(qp, dp[rows].min(0), dp[rows].max(0)) <= stop)
        for at in range(0, len(near), 4096):
            some = near[at : at + 4096]
            i, j = np.divmod(np.flatnonzero(left[some] @ right[rows].T >= bound), len(rows))
            i, j = some[i], rows[j]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            for b in range(0, len(i), 1 << 16):
                x, y = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                cos = np.einsum("ij,ij->i", q[x], d[y])
                ok = cos >= similarity
                if ok.any():
                    yield x[ok], y[ok], cos[ok]


def nearest(q: np.ndarray, qp: np.ndarray, d: np.ndarray, dp: np.ndarray, k: int, chi2: float, same: bool, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of d, cosines) of the k most similar to each row of q, best first; -1 where there are fewer. least: a cosine of
    each row of q up to which nothing is wanted."""
    best, who = np.full((len(q), k), -2.0, np.float32), np.full((len(q), k), -1)
    if least is not None:
        best[:] = least[:, None]
    q32, d32 = q.astype(np.float32), d.astype(np.float32)
    parts = leaves(dp)
    boxes = [(dp[r].min(0), dp[r].max(0)) for r in parts]
    centre = qp.mean(0, keepdims=True)
    for leaf in sorted(range(len(parts)), key=lambda x: box_distance2(centre, *boxes[x])[0]):
        rows = parts[leaf]
        reach = np.where(best[:, -1] > -2, chi2 * np.maximum(2 - 2 * best[:, -1], 0), np.inf)
        near = np.flatnonzero(box_distance2(qp, *boxes[leaf]) <= reach)
        for at in range(0, len(near), 4096):
            some = near[at : at + 4096]
            sim = q32[some] @ d32[rows].T
            if same:
                sim[some[:, None] == rows[None, :]] = -2
            better = sim > best[some, -1][:, None]
            hit = np.flatnonzero(better.any(1))
            if not len(hit):
                continue
            some, sim = some[hit], sim[hit]
            both, ids = np.c_[best[some], sim], np.c_[who[some], np.broadcast_to(rows, sim.shape)]
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            b, w = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
            order = np.argsort(-b, axis=1, kind="stable")
            best[some], who[some] = np.take_along_axis(b, order, 1), np.take_along_axis(w, order, 1)
    return who, best


class Index:
    """Rows (key, vec) as blocks of bounded size in the cells of the kd-tree, kept in the shared folder."""

    def __init__(self, rows: DataFrame, key: str, vec: str, dim: int, m: int = DIRECTIONS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 0):
        """One row per key is expected. Null keys and unusable vectors take no part."""
        self.base = cut(usable(rows.select(F.col(key).alias("key"), F.col(vec).cast("array<float>").alias("vec")).where(F.col(key).isNotNull()), "vec", dim).withColumn("rid", F.monotonically_increasing_id()))
        self.n, self.dim, self.m, self.sample_rows, self.block_rows = self.base.count(), dim, m, sample_rows, block_rows
        self.gauss, self.seed = directions(dim, m, seed), seed

    @functools.cached_property
    def _placed(self) -> tuple[DataFrame, list[tuple[int, int, int]], list[np.ndarray]]:
        """The rows with their blocks; (cell, number in it, blocks of it) of each block; its box."""
        spark, dim, gauss, block_rows = self.base.sparkSession, self.dim, self.gauss, self.block_rows
        rows = self.base.select("key", "vec")
        taken = np.array(samples.by_hash(rows, "key", "vec", self.sample_rows, self.n), float).reshape(-1, dim)
        cells = max(4, -(-self.n // block_rows)) if self.n else 1
        splits = Splits(unit(taken) @ gauss if len(taken) else np.zeros((0, self.m)), cells)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = unit(_matrix(b.column(1), dim)) @ gauss
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(splits.cell(p).astype(np.int32))], names=["key", "vec", "cell"])

        placed = cut(rows.mapInArrow(assign, "key string, vec array<float>, cell int"))
        sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # one row per cell
        # A cell that the sample has underrated, or that holds many copies of a vector, is dealt out over several blocks.
        blocks = [(c, s, -(-n // block_rows)) for c, n in sorted(sizes.items()) for s in range(-(-n // block_rows))]
        first, b = {}, 0
        for c, s, _ in blocks:
            first.setdefault(c, b)
            b += 1
        meta = spark.createDataFrame([(int(c), int(first[c]), int(-(-n // block_rows))) for c, n in sizes.items()] or [(0, 0, 1)], "cell int, first int, parts int")
        there = cut(placed.join(F.broadcast(meta), "cell").select("key", "vec", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("block")))  # meta: one row per cell
        return there, blocks, [splits.boxes[c] for c, *_ in blocks]

    rows = property(lambda self: self._placed[0])
    blocks = property(lambda self: self._placed[1])
    boxes = property(lambda self: self._placed[2])

    def _own(self) -> DataFrame:
        return self.rows.select("block", F.lit(0).alias("part"), F.lit(0).alias("side"), "key", "vec", F.lit(None).cast("float").alias("least"))

    def _sent(self, queries: DataFrame, reach2, first: int | None, skip: int) -> DataFrame:
        """Each of queries(key, vec, block, least) at the other blocks within its reach in the projection, nearest first, from
        number `skip` up to `first` more. reach2: squared reach by `least`."""
        lo, hi = (np.array([x[i] for x in self.boxes]).reshape(-1, self.m) for i in (0, 1))
        gauss, dim = self.gauss, self.dim

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 2048):
                    batch = big.slice(at, 2048)
                    p, own, least = unit(_matrix(batch.column(1), dim)) @ gauss, batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
                    far = np.stack([box_distance2(p, lo[b], hi[b]) for b in range(len(lo))], axis=1)
                    far[np.arange(len(p)), own] = np.inf
                    ok = far <= reach2(least)[:, None]
                    if first is not None or skip:
                        place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable")
                        ok &= (place >= skip) & (place < (len(lo) if first is None else skip + first))
                    row, block = np.nonzero(ok)
                    for x in range(0, len(row), 8192):
                        take = pa.array(row[x : x + 8192])
                        yield pa.RecordBatch.from_arrays([pa.array(block[x : x + 8192].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take)], names=["block", "key", "vec", "least"])

        return queries.select("key", "vec", "block", F.col("least").cast("float").alias("least")).mapInArrow(send, "block int, key string, vec array<float>, least float")

    def _met(self, sent: DataFrame) -> DataFrame:
        """(block, part, side, key, vec, least): queries with the rows of the block they are sent to. A block that many are sent to
        meets them in several parts, each with all of its rows."""
        sent = cut(sent)
        parts = sent.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int").alias("parts"))  # one row per block
        queries = sent.join(F.broadcast(parts), "block").select("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "key", "vec", "least")
        rows = self.rows.join(F.broadcast(parts), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "key", "vec", F.lit(None).cast("float").alias("least"))
        return queries.unionByName(rows)

    def pairs(self, similarity: float, confidence: float = CONFIDENCE) -> DataFrame:
        """(key_a, key_b, cosine), key_a < key_b, of all pairs with at least the cosine; no cap on partners.

        A pair is missed with at most the probability 1 - confidence, if its cosine is just the one asked for.
        """
        missed = (1 - confidence) / 2  # by the stop, and by the tables
        stop = chi2_quantile(1 - missed, self.m) * max(0.0, 2 - 2 * similarity)
        dim, gauss, seed, spark = self.dim, self.gauss.astype(np.float32), self.seed, self.base.sparkSession
        wide = 2 * spark.sparkContext.defaultParallelism
        cell_rows = min(CELL_ROWS, max(self.block_rows, self.n // wide)) if self.n < wide * CELL_ROWS else CELL_ROWS
        m = math.ceil(self.n / cell_rows / 2)
        several = self.n > cell_rows
        times = tables(GROUPED * shared_chance(m, similarity), missed) if several else tables(GROUPED, missed)
        turns = directions(dim, max(1, m) * times, seed + 1).astype(np.float32) if several else None

        def cells(u: np.ndarray, some: range) -> Iterator[np.ndarray]:
            u = u.astype(np.float32)
            for t in some:
                yield 2 * m * t + peaks(u @ turns[:, m * t : m * (t + 1)]) if several else np.full(len(u), t)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(times * max(1, 2 * m), np.int64)
            for big in batches:
                for at in range(0, big.num_rows, 4096):
                    for c in cells(unit(_matrix(big.column(0).slice(at, 4096), dim)), range(times)):
                        n += np.bincount(c, minlength=len(n))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["cell", "n"])

        sizes = {r.cell: r.n for r in self.base.select("vec").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # one row per cell
        parts = np.ones(times * max(1, 2 * m), np.int64)
        for c, n in sizes.items():
            parts[c] = -(-n // PART_ROWS)

        def send(batches: Iterator[pa.RecordBatch], some: range) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 2048):
                    b = big.slice(at, 2048)
                    u, rid = unit(_matrix(b.column(1), dim)), b.column(0).to_numpy()
                    code = codes(u)
                    for cell in cells(u, some):
                        much = parts[cell]
                        own, row = rid % much, np.repeat(np.arange(len(u)), much)
                        other = np.arange(len(row)) - np.repeat(np.cumsum(much) - much, much)
                        mine = own[row]
                        low, high = np.minimum(mine, other), np.maximum(mine, other)
                        for x in range(0, len(row), 8192):
                            r = row[x : x + 8192]
                            flat = pa.py_buffer(np.ascontiguousarray(code[r]).tobytes())
                            data = pa.Array.from_buffers(pa.binary(dim), len(r), [None, flat]).cast(pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.array(v[x : x + 8192].astype(np.int32)) for v in (cell[row], low, high)] + [pa.array(mine[x : x + 8192] > low[x : x + 8192]), pa.array(rid[r]), data], names=["cell", "a", "b", "second", "rid", "code"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(-1, dim), b.column("rid").to_numpy(), b.column("second").to_numpy(zero_copy_only=False), b.column("cell")[0].as_py()) for b in batches if b.num_rows]
            c, rid, second = (np.concatenate([g[i] for g in got]) for i in range(3))
            number = got[0][3]
            del got
            for i, j in grouped(c, second, similarity, stop, gauss, number + seed):
                x, y = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], names=["x", "y"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cos = np.einsum("ij,ij->i", unit(_matrix(b.column(2), dim)), unit(_matrix(b.column(3), dim)))
                ok = pa.array(cos >= similarity)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(cos).filter(ok)], names=["key_a", "key_b", "cosine"])

        at_once, maybe = max(PASS_TABLES, PASS_ROWS // max(1, self.n)), None
        for first in range(0, times, at_once):
            some = range(first, min(times, first + at_once))
            sent = self.base.select("rid", "vec").mapInArrow(functools.partial(send, some=some), "cell int, a int, b int, second boolean, rid bigint, code binary")
            found = cut(sent.groupBy("cell", "a", "b").applyInArrow(run, "x bigint, y bigint").distinct())
            maybe = found if maybe is None else maybe.unionByName(found)
        maybe = maybe.distinct() if times > at_once else maybe
        # Vectors are sent once, to the ends of the pairs that the codes leave.
        ends = maybe.select("x", "y", F.explode(F.array("x", "y")).alias("rid")).join(self.base, "rid")
        end = lambda side, what: F.first(F.when(F.col("rid") == F.col(side), F.col(what)), ignorenulls=True)
        both = ends.groupBy("x", "y").agg(*[end(side, what).alias(f"{what}_{side}") for what in ("key", "vec") for side in ("x", "y")])
        swap = F.col("key_x") > F.col("key_y")
        named = both.select(F.least("key_x", "key_y").alias("key_a"), F.greatest("key_x", "key_y").alias("key_b"), F.when(swap, F.col("vec_y")).otherwise(F.col("vec_x")).alias("a"), F.when(swap, F.col("vec_x")).otherwise(F.col("vec_y")).alias("b"))
        return named.mapInArrow(verify, "key_a string, key_b string, cosine double")

    def neighbours(self, k: int, confidence: float = CONFIDENCE, rounds: tuple[int | None, ...] = ROUNDS) -> DataFrame:
        """(key, neighbour, cosine, place): the k most similar other keys of every key, ties by key.

        A query is searched in its own block first, then in rounds in the others, nearest first, that the chi-square test
        doesn't rule out at the distance of its k-th best of all rounds before.
        """
        dim, gauss, chi2 = self.dim, self.gauss, chi2_quantile(confidence, self.m)

        def run(table: pa.Table) -> pa.Table:
            q, d, same = _sides(table, dim)
            least = None if same else table["least"].to_numpy()[table["side"].to_numpy() == 0].astype(np.float32)
            who, sim = nearest(q[1], q[1] @ gauss, d[1], d[1] @ gauss, k, chi2, same, None if least is None else np.where(np.isnan(least), np.float32(-2), least)) if len(d[0]) else (np.full((len(q[0]), k), -1), np.full((len(q[0]), k), -2.0))
            ok = who >= 0
            offsets = pa.array(np.r_[0, np.cumsum(ok.sum(1))].astype(np.int32))
            return pa.table({"key": pa.array(q[0], pa.string()), "ids": pa.ListArray.from_arrays(offsets, pa.array(d[0][who[ok]], pa.string())), "sims": pa.ListArray.from_arrays(offsets, pa.array(sim[ok].astype(np.float64)))})

        def found(met: DataFrame) -> DataFrame:
            each = met.groupBy("block", "part").applyInArrow(run, "key string, ids array<string>, sims array<double>")
            item = F.transform(F.arrays_zip("ids", "sims"), lambda x: F.struct((-x["sims"]).alias("far"), x["ids"].alias("id")))
            return each.select("key", item.alias("c")).where(F.size("c") > 0)

        def merged(lists: DataFrame) -> DataFrame:  # at most k candidates per block
            return cut(lists.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k).alias("c")))

        best, seen = merged(found(self._own())), 0
        for first in rounds:
            if len(self.blocks) < 2:
                break
            bound = F.when(F.size("c") == k, -F.element_at("c", -1)["far"]).cast("float").alias("least")
            queries = self.rows.join(best.select("key", bound), "key", "left")
            reach2 = lambda x: np.where(np.isnan(x), np.inf, chi2 * np.maximum(2 - 2 * x, 0))
            best = merged(best.unionByName(found(self._met(self._sent(queries, reach2, first, seen)))))
            seen += first or 0
        return best.select("key", F.posexplode("c").alias("p", "x")).select("key", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("p") + 1).alias("place"))


def _sides(table: pa.Table, dim: int):
    side = table["side"].to_numpy()
    same = table.num_rows > 0 and table["least"].null_count == table.num_rows and not side.any()
    keys, vec = np.array(table["key"].to_pylist(), object), unit(_matrix(table["vec"], dim))
    q = (keys[side == 0], vec[side == 0])
    return q, (q if same else (keys[side == 1], vec[side == 1])), same
