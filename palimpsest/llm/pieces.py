"""Splitting oversized items at natural boundaries.

Every position of a text has a boundary strength. A sparse table of range maxima over (strength, position) gives the
strongest cut of any window, the rightmost of equals, in constant time. Pieces follow one another: the strongest cut in
the upper half of the permissible lengths, else in the lower half, else, with less overlap, the next natural cut in
reach; only then the limit itself. The next piece starts `overlap` characters before the cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that end a sentence, those that end a clause, and those that may close either.
ENDS, CLAUSES, CLOSERS = ".!?。！？", ",;:，；、：", "\"'”’»)]）」』】"
#: Separators besides white space: text runs without any are cut by force.
SEPARATORS = "。！？；，"
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, EDGE = 6, 5, 4, 3, 2, 1
SEGMENT = 1 << 16
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_codes = lambda s: np.array([ord(c) for c in s], np.uint32)


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character, and at the end; 0: not natural."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    space, wide = np.isin(c, _SPACES), np.isin(c, _codes(SEPARATORS))
    # The last character before each position that is neither white space nor a closer.
    idx = np.where(space | np.isin(c, _codes(CLOSERS)), -1, np.arange(n))
    last = c[np.maximum(np.maximum.accumulate(idx), 0)] if n else c
    out = np.zeros(n + 1, np.int8)
    sep = space | wide
    out[:n][sep] = EDGE
    after = out[1:]
    after[sep] = np.maximum(after[sep], EDGE)
    after[space] = SPACE
    stop = space | wide | np.isin(c, _codes(CLOSERS + "、："))
    cjk = last > 0x2E80
    after[stop & np.isin(last, _codes(CLAUSES)) & (space | cjk)] = CLAUSE
    after[stop & np.isin(last, _codes(ENDS)) & (space | cjk)] = SENTENCE
    lines = c == 10
    after[lines] = LINE
    solid = np.where(space & ~lines, -1, np.arange(n))
    before = np.r_[-1, np.maximum.accumulate(solid)[:-1]] if n else solid
    after[lines & (before >= 0) & lines[np.maximum(before, 0)]] = PARAGRAPH
    out[n] = PARAGRAPH + 1
    return out


class Cuts:
    """Range maxima over (strength, position), held for one segment of the text at a time."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.key = (strength.astype(np.int64) << 40) | np.arange(len(strength))
        self.widest, self.base, self.levels = widest, 0, []

    def _load(self, lo: int) -> None:
        self.base = lo
        self.levels = [self.key[lo : lo + max(SEGMENT, 2 * self.widest)]]
        width = 1
        while 2 * width <= min(self.widest, len(self.levels[0])):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) of the strongest cut in lo..hi, the rightmost of equals; (0, hi) of an empty window."""
        hi = min(hi, len(self.key) - 1)
        if lo > hi:
            return 0, hi
        if not self.levels or lo < self.base or hi >= self.base + len(self.levels[0]):
            self._load(lo)
        k = (hi - lo + 1).bit_length() - 1
        row, lo, hi = self.levels[k], lo - self.base, hi - self.base
        top = int(max(row[lo], row[hi - (1 << k) + 1]))
        return top >> 40, top & ((1 << 40) - 1)

    def first(self, lo: int, hi: int) -> int:
        """The first natural cut in lo..hi, by halving; -1 if there is none."""
        hi = min(hi, len(self.key) - 1)
        if lo > hi or self.best(lo, hi)[0] < EDGE:
            return -1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.best(lo, mid)[0] >= EDGE else (mid + 1, hi)
        return lo


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces. No piece is longer than `limit`; together they cover the text.

    A text within the limit, an empty one too, is one piece. Overlap is `overlap` characters, less only where the next
    natural cut is otherwise out of reach. forced: the end isn't natural. A forced cut keeps combining marks with their base.
    """
    n, overlap = len(text), max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n, False)]
    cuts, out, start, done = Cuts(strengths(text), limit + 1), [], 0, 0
    while n - start > limit:
        half = max(done + 1, start + limit // 2)
        strength, at = cuts.best(half, start + limit)
        if strength < EDGE:
            strength, at = cuts.best(done + 1, half - 1)
        if strength < EDGE and (at := cuts.first(start + limit + 1, done + limit)) > 0:
            strength, start = EDGE, at - limit
        if strength < EDGE:
            at = start + limit
            while at > done + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️"):
                at -= 1
        out.append((start, at, strength < EDGE))
        if at == n:
            return out
        start, done = max(at - overlap, start + 1), at
    return [*out, (start, n, False)]


def pieces(items: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(key, piece, pieces, start, end, content, forced): the ordered pieces of every item with a non-null text.

    Items within the limit stay whole and never leave the JVM. Null texts give no piece, empty ones an empty piece.
    Positions are code points. Repeated keys are split each. Extra columns are ignored. A null key stays null.
    """
    rows = items.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    kind = rows.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cuts = [(k, t, split(t, limit, overlap)) for k, t in zip(pdf["_k"], pdf["_t"], strict=True)]
            out = [(k, i, len(found), a, b, t[a:b], forced) for k, t, found in cuts for i, (a, b, forced) in enumerate(found)]
            yield pd.DataFrame(out, columns=["_k", "piece", "pieces", "start", "end", "content", "forced"])

    short = rows.where(F.length("_t") <= limit).select("_k", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.length("_t").alias("end"), F.col("_t").alias("content"), F.lit(False).alias("forced"))
    long = rows.where(F.length("_t") > limit).mapInPandas(run, f"_k {kind}, piece int, pieces int, start int, end int, content string, forced boolean")
    return short.unionByName(long).withColumnRenamed("_k", key)

