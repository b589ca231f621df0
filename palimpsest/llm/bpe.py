"""Exact byte-pair encoding in linear time.

Bytes are read as Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds all tokens in a word.
Encoding goes left to right with the longest token that fits; two neighbouring tokens fit if merging would not have
joined across their border, which is decided once per pair and remembered. Where nothing fits, the last token is taken
back and a shorter one tried; a position left for good is never visited again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits a text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 1 << 19


class Encoder:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.words = regex.compile(pattern)
        self.id = {k.decode("latin-1"): v for k, v in rank.items()}
        self.size = {v: len(k) for k, v in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        # The longest token that begins each token, shorter than it.
        self.shorter: dict[int, int | None] = {}
        for text, i in self.id.items():
            self.shorter[i] = next((self.id[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id), None)
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for text, i in sorted(self.id.items(), key=lambda x: x[1]):
            self.halves[i] = (i, i)
            left = self.shorter[i]
            while left is not None:
                right = self.id.get(text[self.size[left] :])
                if right is not None and left < i and right < i and self._fit(left, right):
                    self.halves[i], self.joined[left, right] = (left, right), i
                    break
                left = self.shorter[left]
        self.fits.clear()
        self.seen: dict[str, list[int]] = {}

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two tokens: their halves next to it never join first."""
        bound = 1 << 60
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            if left > right:  # the later merge is undone first
                bound, inner = left, self.halves[left][1]
                if inner == left:
                    bound, inner = right + 1, self.halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                bound, inner = right + 1, self.halves[right][0]
                if inner == right:
                    bound, inner = left, self.halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def word(self, text: str) -> list[int]:
        """Ids of one word, given as Latin-1 characters."""
        whole = self.id.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest: list[int | None] = [None] * n
        size, fits = self.size, self.fits
        for end, i in self.automaton.iter(text):
            at = end + 1 - size[i]
            if longest[at] is None or size[longest[at]] < size[i]:
                longest[at] = i
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, try_ = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while try_ is not None:
                end = at + size[try_]
                if open_[end]:
                    if last is None:
                        break
                    ok = fits.get((last, try_))
                    if ok is None:
                        if len(fits) > REMEMBERED:
                            fits.clear()
                        ok = fits[last, try_] = self._fit(last, try_)
                    if ok:
                        break
                try_ = self.shorter[try_]
            if try_ is None:
                open_[at] = 0
                try_ = out.pop()
                at -= size[try_]
            else:
                out.append(try_)
                at += size[try_]
                try_ = longest[at] if at < n else None
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, strings of special tokens being ordinary text; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for word in self.words.findall(text):
            ids = seen.get(word)
            if ids is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                ids = self.word(word.encode().decode("latin-1"))
                if len(word) <= 64:
                    seen[word] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """One per worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: the token ids of its text; an empty list for null and empty texts.

    Repeated keys and null keys keep a row each; extra columns are ignored; very long texts are encoded whole.
    """
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [np.array(enc.encode(t), np.int32) for t in b.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.array([], np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["_k", "ids"])

    return spread(rows).mapInArrow(run, f"_k {rows.schema['_k'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_k", key)


def lengths(docs: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens of every row; only the count leaves the worker."""
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_t"))
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], n], names=[*names, "n_tokens"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return spread(rows).mapInArrow(run, f"{kinds}, n_tokens bigint").toDF(*keep, "n_tokens")
