"""Near-duplicate records with small edits.

A record is the set of its runs of `width` consecutive words, and has a fingerprint whose Hamming distance to another's
follows from the share of runs the two have in common (one bit of each of many min-hashes). BK-trees over fingerprints,
with children keyed by the integer distance to their parent, are searched within a radius by following only the edges
whose key is within the radius of the distance at hand. There is a tree for each shard, and a record goes to the shards
of its rarest runs: as two records of the wanted similarity share at least one of these, no pair is lost by sharding. For
that any order of the runs will do that is the same for all records; how frequent a run is, is taken from a sample, so the
sets are never sent. What the trees find is verified exactly. Records with the same set are one class and searched once.

Shards too large for one tree are split by a second of the rarest runs (two records of the wanted similarity share two
of one more of them), then by a third, as long as that leaves parts too large; rows so grow with the shard, not with its
square. What even then stays together is searched in pairs of blocks.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import cut, shuffle_width, spread

BITS, SIGMAS, SHARD_ROWS = 128, 4.5, 4_096
#: Shards of more than so many trees' rows are split by a further run, MOST_RUNS in all at most; above COPIES a class's copies are paired in parts.
SPLIT, MOST_RUNS, COPIES = 16, 4, 1_000
#: Records from which the frequent runs are known, about; classes whose shards are searched at a time, so that their files can be deleted.
SAMPLE_ROWS, SLICE_ROWS, SLICES = 8_000, 250_000, 8
#: Pairs whose texts are sent at a time, and the most times.
PAIR_ROWS, PAIR_SLICES = 500_000, 4
_WORD = re.compile(r"[぀-ヿ一-鿿]|(?:(?![぀-ヿ一-鿿])[^\W_])+")
_MASK = (1 << 64) - 1


def words(text: str) -> list[str]:
    """Runs of letters or digits of the lower-cased text; a kana or Han character is a word by itself."""
    return _WORD.findall(text.lower())


def radius(similarity: float, bits: int = BITS, sigmas: float = SIGMAS) -> int:
    """Distance within which fingerprints of sets of at least the similarity lie but for `sigmas` standard deviations."""
    p = (1 - similarity) / 2
    return int(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5) + 1


_SEEDS = np.random.default_rng(20).integers(1, 1 << 31, (2, BITS)).astype(np.uint32) | np.uint32(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, well mixed."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of `width` words of each text, as sorted 64-bit numbers one text after another, and how many each
    has. hashes: of all words of all texts; sizes: words of each text, at least `width`."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = max(0, len(hashes) - width + 1)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    whole = text[:n] == text[width - 1 :]
    h, text = h[whole], text[:n][whole]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.bincount(text[new], minlength=len(sizes))


def minima(runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each set its least value under each of BITS hash functions, mixed."""
    low = (runs ^ (runs >> np.uint64(32))).astype(np.uint32)
    best = np.full((len(sizes), BITS), np.uint32(0xFFFFFFFF))
    text = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(low), 4096):
        h = low[at : at + 4096, None] * _SEEDS[0]
        h ^= h >> np.uint32(15)
        h *= _SEEDS[1]
        some = text[at : at + 4096]
        first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        best[some[first]] = np.minimum(best[some[first]], np.minimum.reduceat(h, first, axis=0))
    return mix(best.astype(np.uint64))


def fingerprints(runs: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set, a bit of each of its minima."""
    return prints_of(minima(runs, sizes))


def prints_of(least: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.packbits((least & np.uint64(1)).astype(np.uint8), axis=1)]


def finer(least: np.ndarray) -> list[bytes]:
    """Four bits of each minimum: what is alike in these tells more of two sets than one bit does."""
    b = ((least >> np.uint64(1)) & np.uint64(15)).astype(np.uint8)
    return [x.tobytes() for x in b[:, ::2] << 4 | b[:, 1::2]]


def equal_minima(similarity: float, sigmas: float = SIGMAS) -> int:
    """So many of two sets' four bits are equal at least but for `sigmas` standard deviations, at the similarity."""
    p = similarity + (1 - similarity) / 16
    return max(0, int(BITS * p - sigmas * (BITS * p * (1 - p)) ** 0.5))


class BKTree:
    """Fingerprints as whole numbers; equal ones share a node."""

    def __init__(self):
        self.root, self.visited = None, 0

    def near(self, x: int, radius: int) -> list:
        """What was added within the radius of x."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            value, items, children = todo.pop()
            self.visited += 1
            d = (x ^ value).bit_count()
            if d <= radius:
                out += items
            if children:
                todo += [c for key, c in children.items() if -radius <= key - d <= radius]
        return out

    def add(self, x: int, item) -> None:
        if self.root is None:
            self.root = (x, [item], {})
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            child = node[2].get(d)
            if child is None:
                node[2][d] = (x, [item], {})
                return
            node = child
        node[1].append(item)


def _word_runs(batches: Iterator[pa.RecordBatch], width: int, least_words: int) -> Iterator[tuple[pa.RecordBatch, list[int], np.ndarray, np.ndarray]]:
    """(slice, places in it, runs, sizes) of the texts with enough words; the text is the last column."""
    known: dict[str, int] = {}
    import xxhash

    for big in batches:
        for at in range(0, big.num_rows, 1000):
            b = big.slice(at, 1000)
            places, hashes, sizes = [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                w = words(text)
                if len(w) < max(least_words, width):
                    continue
                if len(known) > 1 << 18:
                    known.clear()
                for x in set(w).difference(known):
                    known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
                places.append(i)
                hashes += [known[x] for x in w]
                sizes.append(len(w))
            if places:
                yield b, places, *shingles(np.array(hashes, np.uint64), np.array(sizes), width)


def _lists(runs: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(runs.view(np.int64)))


def _sets(rows: DataFrame, width: int, least_words: int) -> DataFrame:
    """(id, runs, print) of the rows with enough words; runs are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, places, runs, n in _word_runs(batches, width, least_words):
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), _lists(runs, n), pa.array(fingerprints(runs, n), pa.binary())], names=["id", "runs", "print"])

    return spread(rows).mapInArrow(run, "id string, runs array<bigint>, print binary")


def rarest(runs: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, chosen, how many) of each set: the runs that come first in the order of all, at most `more` beyond the first
    floor((1 - similarity) n) + 1. frequent: sorted runs and how often the sample has them; others come before these."""
    some, often = frequent
    text = np.repeat(np.arange(len(sizes)), sizes)
    df = np.zeros(len(runs), np.int64)
    if len(some):
        at = np.minimum(np.searchsorted(some, runs), len(some) - 1)
        df[some[at] == runs] = often[at[some[at] == runs]]
    order = np.lexsort((runs, df, text))
    first = np.floor((1 - similarity) * sizes + 1e-9).astype(np.int64) + 1
    place = np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < (first + more)[text]
    return first, runs[order][keep], np.minimum(sizes, first + more)


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that two sets or more have, sorted, and how many; at most half of all runs of the sets reach the driver."""
    t = sets.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1).toArrow()
    run, df = t["run"].to_numpy().view(np.uint64), t["df"].to_numpy()
    order = np.argsort(run)
    return run[order], df[order]


def _sampled(rows: DataFrame, name: str) -> DataFrame:
    """About SAMPLE_ROWS of the rows, by the hash of a column; all if there are no more."""
    total = rows.count()
    return rows if total <= SAMPLE_ROWS else rows.where(F.pmod(F.xxhash64(name), F.lit(1 << 40)) < int((1 << 40) * SAMPLE_ROWS / total))


def _rarest(classes: DataFrame, similarity: float, more: int) -> DataFrame:
    """(rid, first, runs): each class's rarest runs in order, up to `more` beyond the `first`."""
    frequent = _frequent(_sampled(classes, "rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first, chosen, many = rarest(lists.flatten().to_numpy().view(np.uint64), n, frequent, similarity, more)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first.astype(np.int32)), _lists(chosen, many)], names=["rid", "first", "runs"])

    return classes.select("rid", "runs").mapInArrow(run, "rid bigint, first int, runs array<bigint>")


def _prints(rows: DataFrame, width: int, least_words: int, similarity: float) -> DataFrame:
    """(id, same, size, fine, first, runs, print) of the rows with enough words: a hash of the whole set and its size, the rarest runs."""
    frequent = _frequent(_sets(_sampled(rows, "id"), width, least_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b, places, runs, n in _word_runs(batches, width, least_words):
            first, chosen, many = rarest(runs, n, frequent, similarity, MOST_RUNS - 1)
            ends, least = np.cumsum(n), minima(runs, n)
            same = [xxhash.xxh3_128_digest(runs[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(places)), pa.array(same, pa.binary()), pa.array(n.astype(np.int32)), pa.array(finer(least), pa.binary()), pa.array(first.astype(np.int32)), _lists(chosen, many), pa.array(prints_of(least), pa.binary())],
                names=["id", "same", "size", "fine", "first", "runs", "print"],
            )

    return spread(rows).mapInArrow(run, "id string, same binary, size int, fine binary, first int, runs array<bigint>, print binary")


def _near(found: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """(x, y, class_x, class_y) of the pairs found(x, y) whose sizes allow the similarity and whose finer prints don't tell against it."""
    side = lambda n: names.select(F.col("rid").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("class", "size", "fine")])
    fits = F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y") - 1e-6
    pairs = found.join(side("x"), "x").join(side("y"), "y").where(fits).select("x", "y", "class_x", "class_y", "fine_x", "fine_y")
    least = equal_minima(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (4, 5))
            apart = p ^ q
            ok = pa.array(((apart & 15) == 0).sum(1) + ((apart & 240) == 0).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(4)], names=["x", "y", "class_x", "class_y"])

    return pairs.mapInArrow(run, "x bigint, y bigint, class_x string, class_y string")


def _verified(near: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b, similarity), a < b, of the pairs near(x, y, class_x, class_y) whose sets have the similarity. Texts are sent once,
    to the pairs that they are in."""
    ends = near.select("x", "y", F.explode(F.array(F.struct(F.col("x").alias("rid"), F.col("class_x").alias("class")), F.struct(F.col("y").alias("rid"), F.col("class_y").alias("class")))).alias("e"))
    ends = ends.select("x", "y", "e.rid", "e.class").join(rows, F.col("class") == F.col("id"))
    end = lambda side, what: F.first(F.when(F.col("rid") == F.col(side), F.col(what)), ignorenulls=True)
    both = ends.groupBy("x", "y").agg(*[end(side, what).alias(f"{what}_{side}") for what in ("class", "text") for side in ("x", "y")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                sides = [[None] * b.num_rows for _ in range(2)]
                for side in (0, 1):
                    column = pa.RecordBatch.from_arrays([b.column(2 + side)], names=["text"])
                    for _, places, runs, n in _word_runs(iter([column]), width, 0):
                        for place, part in zip(places, np.split(runs, np.cumsum(n)[:-1]), strict=True):
                            sides[side][place] = part
                share = [len(c := np.intersect1d(p, q, assume_unique=True)) / (len(p) + len(q) - len(c)) for p, q in zip(*sides, strict=True)]
                ok = pa.array(np.array(share) >= similarity)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(share, pa.float64()).filter(ok)], names=["a", "b", "similarity"])

    alike = both.select("class_x", "class_y", "text_x", "text_y").mapInArrow(run, "a string, b string, similarity double")
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def _shards(classes: DataFrame, similarity: float, shard_rows: int) -> DataFrame:
    """(shard, a, b, second, rid, print): each class at the shards of its rarest runs, those that no other has left out."""
    return _placed(cut(_rarest(classes, similarity, MOST_RUNS - 1)), classes.select("rid", "print"), shard_rows)


def _placed(rare: DataFrame, prints: DataFrame, shard_rows: int, slices: int = 1, number: int = 0) -> DataFrame:
    """Of _shards, those of one of the slices of all runs."""
    at = rare.select("rid", F.posexplode(F.slice("runs", 1, F.col("first"))).alias("last", "shard"))
    if slices > 1:
        at = at.where(F.pmod(F.xxhash64("shard"), F.lit(slices)) == number)
    done = []
    for runs in range(1, MOST_RUNS + 1):
        at = cut(at) if runs > 1 else at
        load = cut(at.groupBy("shard").agg(F.count(F.lit(1)).alias("load")).where(F.col("load") > 1))
        large = load.where(F.col("load") > SPLIT * shard_rows)
        if runs == MOST_RUNS or large.isEmpty():
            done.append(at.join(load, "shard"))
            break
        done.append(at.join(load.where(F.col("load") <= SPLIT * shard_rows), "shard"))
        # One more of the rarest, behind those that the shard has: of first + runs of them two alike records share runs + 1.
        further = at.join(large, "shard").select("rid", "shard", "last").join(rare, "rid")
        rest = F.posexplode(F.slice("runs", F.col("last") + 2, F.greatest(F.lit(0), F.col("first") + runs - F.col("last") - 1)))
        at = further.select("rid", "shard", "last", rest.alias("p", "run")).select("rid", (F.col("last") + F.col("p") + 1).alias("last"), F.xxhash64("shard", "run").alias("shard"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    placed = placed.join(prints, "rid")
    blocks = F.ceil(F.col("load") / shard_rows).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    low, high = F.least(F.col("own"), F.col("other")), F.greatest(F.col("own"), F.col("other"))
    return (
        placed.withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("shard", "rid", "print", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("shard", low.alias("a"), high.alias("b"), (F.col("own") > F.col("other")).alias("second"), "rid", "print")
    )


def _search(shards: DataFrame, within: int) -> DataFrame:
    """(x, y), numbers of the classes whose fingerprints lie within the radius, by one BK-tree after another."""
    parts = max(shuffle_width(shards), 2 * shards.sparkSession.sparkContext.defaultParallelism)
    sorted_ = shards.repartition(parts, "shard", "a", "b").sortWithinPartitions("shard", "a", "b", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, seen = BKTree(), None, set()
        for batch in batches:
            left, right = [], []
            shard, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.ones(len(shard), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[:1] = at != (shard[0], a[0], b[0]) if len(shard) else False
            own = ~batch.column(3).to_numpy(zero_copy_only=False) | (a == b)  # of two blocks only the first is in the tree
            for fresh, name, x, kept in zip(new.tolist(), batch.column(4).to_pylist(), map(int.from_bytes, batch.column(5).to_pylist()), own.tolist(), strict=True):
                if fresh:
                    tree = BKTree()
                elif tree.root is not None:
                    for other in tree.near(x, within):
                        pair = (name, other) if name < other else (other, name)
                        if pair not in seen:
                            seen.add(pair)
                            left.append(pair[0])
                            right.append(pair[1])
                if kept:
                    tree.add(x, name)
            if len(shard):
                at = (shard[-1], a[-1], b[-1])
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["x", "y"])

    return sorted_.mapInArrow(run, "x bigint, y bigint").distinct()


def links(items: DataFrame, key: str, text: str, similarity: float = 0.8, width: int = 5, least_words: int = 0, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members(class, id), pairs(a, b, similarity)): the records with enough words by class of equal sets, named by its
    smallest id, and the pairs of classes, a < b, whose sets have the similarity.

    One row per key is expected. Null keys and texts take no part, nor do texts with fewer words than asked for or than
    a run has; very long texts count whole. Extra columns are ignored. Empty tables give no rows.
    """
    rows = items.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    sets = cut(_prints(rows, width, least_words, similarity))
    same = sets.groupBy("same", "size").agg(F.min("id").alias("class"))
    members = cut(sets.select("id", "same", "size").join(same, ["same", "size"]).select("class", "id"))
    # Shuffles carry a class's number, fixed once it is written, instead of its name.
    classes = cut(sets.join(members.where(F.col("class") == F.col("id")).select("class"), F.col("id") == F.col("class")).select("class", "size", "fine", "first", "runs", "print").withColumn("rid", F.monotonically_increasing_id()))
    del sets, same
    near, slices = [], min(SLICES, -(-classes.count() // SLICE_ROWS) or 1)
    for i in range(slices):
        found = cut(_search(_placed(classes.select("rid", "first", "runs"), classes.select("rid", "print"), shard_rows, slices, i), radius(similarity)))
        near.append(cut(_near(found, classes, similarity)))
    del classes, found
    near = functools.reduce(DataFrame.unionByName, near)
    near, alike = cut(near.distinct()) if slices > 1 else near, []
    slices = min(PAIR_SLICES, -(-near.count() // PAIR_ROWS) or 1)
    for i in range(slices):
        some = near.where(F.pmod(F.xxhash64("x", "y"), F.lit(slices)) == i)
        alike.append(cut(_verified(some, rows, width, similarity)))
    return members, functools.reduce(DataFrame.unionByName, alike)


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records, copies too."""
    m = lambda side: members.select(F.col("class").alias(side), F.col("id").alias(f"id_{side}"))
    # A class of many copies is dealt out: each part of it meets the whole class.
    sizes = members.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("parts"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    sized = members.join(sizes.drop("size"), "class")
    left = sized.select("class", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("id_a"))
    right = sized.select("class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_b"))
    copies = left.join(right, ["class", "part"]).where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
    across = pairs.select("a", "b").join(m("a"), "a").join(m("b"), "b")
    return copies.unionByName(across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the connected parts that pairs(a, b) span; root is the smallest node. Stars are contracted in turn
    towards larger and smaller neighbours, so the rounds grow with the logarithm of the longest chain."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 30))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"parts not settled after {most_rounds} rounds")


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id, n_links) of every record: the smallest id of its group and the number of records it is linked to."""
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    sides = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    degree = sides.join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("size").alias("linked"))
    roots = components(pairs).select(F.col("node").alias("class"), "root")
    info = sizes.join(degree, "class", "left").join(roots, "class", "left")
    return members.join(info, "class").select("id", F.coalesce("root", "class").alias("group_id"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
