"""Sentence boundaries across languages and scripts.

A text is cut into blocks at blank lines and before lines that open with a marker; headings, to-do lines and lines that
hold a label only are sentences by themselves. Within a block, candidate boundaries are the places after sentence marks
(and, in Thai, the spaces between Thai words) outside quotation marks, brackets and code. A maximum-entropy classifier
decides on each from the tokens around it, their case, length, digits and script. It is trained on boundaries that are
reliable without it: where blocks end and begin, where a lower-case letter follows, and at words that occur before marks
again and again but never end a block, or after them but never begin one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import samples
from palimpsest.runtime import spread

#: Bounds of the sample the classifier is fitted on: texts, and characters of each (longer texts aren't in the sample).
FIT_TEXTS, FIT_CHARS = 4_000, 8_000
MARKS = ".!?…。！？।؟۔"
OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“”", "‘": "’", "《": "》", "〈": "〉"}
CLOSERS = ")]}）】」』»”“’》〉\""
ROLES = ("user", "assistant", "system", "tool", "human", "developer", "agent", "function")
TODO = "○◐✓✗☐☑☒✔✘●"
_EDGE = " \t\r\n\v\f\x1c\x1d\x1e\x1f\x85\xa0                　﻿"
_HEADING = re.compile(r"#{1,6}(?=\s)")
_TODO = re.compile(f"[{TODO}]|[-*] \\[[ xX]\\] ")
_LABEL = re.compile(r"\[[^\[\]\n]{1,80}\](?: *\(session [^()\n]*\))?$")
_MARKER = re.compile(r"[*+•-](?=\s)|\[[^\[\]\n]{1,80}\]|(?:" + "|".join(ROLES) + r"):(?=\s|$)", re.I)
_CANDIDATE = re.compile(f"[{MARKS}]+|(?<=[฀-๿])[ \t\n\r\xa0]+(?=[฀-๿])")
_TOKEN_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}_'’-]+", regex.REVERSE)
_TOKEN_AFTER = regex.compile(r"[\p{L}\p{M}\p{N}_'’-]+")
_WIDE_MARKS = "。！？"


class Candidate(NamedTuple):
    at: int  # end of the sentence, if it is one
    after: int  # where the next one would begin
    left: tuple[str, ...]
    right: tuple[str, ...]


def strip(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _EDGE:
        a += 1
    while b > a and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the blocks; whole ones are one sentence each."""
    out: list[tuple[int, int, bool]] = []
    open_ = None
    at = 0
    for line in text.split("\n"):
        a, b = strip(text, at, at + len(line))
        at += len(line) + 1
        if a == b:
            open_ = None
            continue
        body = text[a:b]
        if _HEADING.match(body) or _TODO.match(body) or _LABEL.match(body):
            out.append((a, b, True))
            open_ = None
        elif open_ is None or _MARKER.match(body):
            open_ = len(out)
            out.append((a, b, False))
        else:
            out[open_] = (out[open_][0], b, False)
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Outermost (start, end) of quotations, brackets and code; openers without a closer are none."""
    found, stack = [], []
    closes: dict[str, list[int]] = {c: [] for c in CLOSERS}  # where in the stack is what each sign closes

    def push(at: int, signs: str) -> None:
        for s in signs:
            closes[s].append(len(stack))
        stack.append((at, signs))

    def close(sign: str, end: int) -> None:
        at = closes[sign][-1]
        found.append((stack[at][0], end))
        while len(stack) > at:
            for s in stack.pop()[1]:
                closes[s].pop()

    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "`":
            j = text.find("`", i + 1)
            if j > 0:
                found.append((i, j + 1))
                i = j + 1
                continue
        elif c == '"' and (closes[c] or not (i and text[i - 1].isdigit())):
            if closes[c]:
                close(c, i + 1)
            else:
                push(i, c)
        elif c in CLOSERS and closes[c] and not (c == "’" and i + 1 < n and text[i + 1].isalpha()):
            close(c, i + 1)
        elif c in OPENERS:
            push(i, OPENERS[c])
        i += 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin" if c.isalpha() else "digit" if c.isdigit() else "other"
    for name, a, b in (("cyrillic", 0x400, 0x530), ("arabic", 0x600, 0x780), ("indic", 0x900, 0xE00), ("thai", 0xE00, 0xE80), ("kana", 0x3040, 0x3100), ("han", 0x3400, 0xA000), ("hangul", 0xAC00, 0xD7B0), ("greek", 0x370, 0x400)):
        if a <= o < b:
            return name
    return "other"


def _kind(c: str) -> str:
    return "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "letter" if c.isalpha() else "open" if c in OPENERS or c in '"¿¡' else "dash" if c in "-–—" else "mark"


def _word(token: str, first: bool) -> str:
    """A token as a feature: unspaced scripts by two characters, names made of parts and numbers by their kind."""
    end = token[0] if first else token[-1]
    if script(end) in ("han", "kana", "thai"):
        wide = re.match if first else re.search
        m = wide(r"[฀-๿]{1,6}", token) if script(end) == "thai" and first else None
        return m.group() if m else token[:2] if first else token[-6:] if script(end) == "thai" else token[-2:]
    if any(c.isdigit() for c in token):
        return "9" if token.isdigit() else "a9"
    if "_" in token or "-" in token.strip("-"):
        return "a-b"
    return token.lower()[:12]


def left_features(text: str, start: int, mark: int, end: int, quoted: tuple[int, int] | None) -> tuple[str, ...]:
    """Of what stands before text[end:]; the marks are text[mark:..], `quoted` the span that ends with them."""
    m = _TOKEN_BEFORE.search(text, start, mark)
    near = m is not None and m.end() == mark
    token = m.group() if m else ""
    marks = text[mark:end].strip()
    run = "".join(c for c in marks if c in MARKS)
    kind = "thai" if not run else "..." if len(run) > 1 and set(run) == {"."} else run[-1] if len(set(run)) == 1 else "mix"
    word = _word(token, False) if token else ""
    close = ""
    if quoted:
        before = text[max(start, quoted[0] - 64) : quoted[0]].rstrip()
        close = text[quoted[1] - 1] + ("^" if not before else ":" if before[-1] in ":：" else ",")
    shape = ("1" if len(token) == 1 else "s" if len(token) < 4 else "l") + ("U" if token[:1].isupper() else "d" if token[:1].isdigit() else "x")
    dotted = near and m.start() > start and text[m.start() - 1] == "."
    return (f"m{kind}", f"w{word}|{kind}" if near else f"far|{kind}", f"s{shape}|{kind}", f"c{close}|{kind}", f"d{dotted}|{kind}", f"z{script(token[-1]) if token else ''}|{kind}")


def right_features(text: str, at: int, end: int) -> tuple[str, ...]:
    at = strip(text, at, end)[0]
    if at >= end:
        return ("k$", "n$")
    m = _TOKEN_AFTER.search(text, at, end)
    near = m is not None and m.start() - at <= 1
    return (f"k{_kind(text[at])}", f"n{_word(m.group(), True)}" if near else f"n{text[at]}", f"o{text[at] if not text[at].isalnum() else ''}")


def candidates(text: str, a: int, b: int) -> list[Candidate]:
    """Of one block, without its end."""
    body = text[a:b]
    held = [(x + a, y + a) for x, y in spans(body)] if any(c in body for c in '("[{（【「『«“„‘《〈`') else []
    out, h, begin = [], 0, a
    for m in _CANDIDATE.finditer(text, a, b):
        while h < len(held) and held[h][1] <= m.start():
            h += 1
        mark, end, quoted = m.start(), m.end(), None
        if h < len(held) and held[h][0] <= mark:
            if not text[m.start()].strip() or text[end : held[h][1]].strip(CLOSERS + " \xa0 "):
                continue
            end, quoted = held[h][1], held[h]
        if not text[m.start()].strip():
            out.append(Candidate(m.start(), m.end(), left_features(text, begin, m.start(), m.end(), None), right_features(text, m.end(), b)))
            continue
        while quoted is None and end < b and text[end] in CLOSERS and not any(x == end for x, _ in held):
            end += 1
        if end >= b or not text[end:b].strip(_EDGE):
            continue
        last = text[m.end() - 1]
        spaced = text[end] in _EDGE
        if not spaced and not (last in _WIDE_MARKS or (last == "…" and script(text[end]) in ("han", "kana")) or (quoted and script(text[end]) in ("han", "kana"))):
            continue
        out.append(Candidate(end, end, left_features(text, begin, mark, end, quoted), right_features(text, end, b)))
    return out


def _joint(left: tuple[str, ...], right: tuple[str, ...]) -> list[str]:
    return [*left, *right, f"{left[0]}&{right[0]}", f"{left[1]}&{right[0]}", f"{left[2]}&{right[0]}", f"{left[3]}&{right[0]}", f"{left[3]}&{right[1]}", f"{left[5]}&{right[0]}"]


def _ending(text: str, a: int, b: int) -> tuple[str, ...] | None:
    """Left features of the end of a block, if it ends with a mark (or in Thai)."""
    held = [(x + a, y + a) for x, y in spans(text[a:b])]
    quoted = next((s for s in held if s[1] == b), None)
    end = b
    while end > a and (text[end - 1] in CLOSERS or text[end - 1] in " \xa0 "):
        end -= 1
    mark = end
    while mark > a and text[mark - 1] in MARKS:
        mark -= 1
    if mark == end:
        return left_features(text, a, b, b, None) if script(text[b - 1]) == "thai" else None
    return left_features(text, a, mark, b, quoted)


def _beginning(text: str, a: int, b: int) -> int:
    m = _MARKER.match(text, a, b)
    return strip(text, m.end(), b)[0] if m else a


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def boundary(self, c: Candidate) -> bool:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in _joint(c.left, c.right)) > 0

    def split(self, text: str | None) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b, whole in blocks(text or ""):
            start = a
            if not whole:
                for c in candidates(text, a, b):
                    if c.at > start and self.boundary(c):
                        out.append(strip(text, start, c.at))
                        start = strip(text, c.after, b)[0]
            if start < b:
                out.append(strip(text, start, b))
        return [(x, y) for x, y in out if x < y]


def reliable(texts: Iterable[str]) -> tuple[list[list[str]], list[int]]:
    """Training cases: features and 1 for boundaries, 0 for none."""
    ends, begins, inside = [], {}, []
    for t in texts:
        for a, b, whole in blocks(t):
            if whole:
                continue
            left, begin = _ending(t, a, b), _beginning(t, a, b)
            if left and begin < b:
                right = right_features(t, begin, b)
                ends.append((left, left[5].split("|")[0]))
                begins.setdefault(_family(t, begin, b), []).append(right)
            inside += [(c.left, c.right) for c in candidates(t, a, b)]
    final, initial = Counter(x[1] for x, _ in ends), Counter(r[1] for rs in begins.values() for r in rs)
    last, next_ = Counter(x[1] for x, _ in inside), Counter(r[1] for _, r in inside)
    cases, labels = [], []
    every = [r for rs in begins.values() for r in rs]
    for i, (left, family) in enumerate(ends):
        pool = begins.get(family.replace("zhan", "zkana") if family == "zhan" and "zhan" not in begins else family) or every
        cases.append(_joint(left, pool[(i * 7919) % len(pool)]))
        labels.append(1)
    for left, right in inside:
        never = (last[left[1]] >= 4 and not final[left[1]]) or (next_[right[1]] >= 4 and not initial[right[1]])
        if right[0] in ("klower", "kdash") or never:
            cases.append(_joint(left, right))
            labels.append(0)
    return cases, labels


def _family(text: str, a: int, b: int) -> str:
    m = _TOKEN_AFTER.search(text, a, b)
    return f"z{script(m.group()[0])}" if m else "z"


def fit(texts: Iterable[str], steps: int = 150, decay: float = 2e-4) -> Model:
    """Maximum entropy by gradient steps of equal size per feature (AdaGrad), both classes weighing the same."""
    cases, labels = reliable(texts)
    if not labels or len(set(labels)) < 2:
        return Model({"klower": -9.0, "kdash": -9.0}, 1.0)
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(f, len(index)) for c in cases for f in c])
    row = np.repeat(np.arange(len(cases)), [len(c) for c in cases])
    y = np.array(labels, float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, g2, bias = np.zeros(len(index)), np.full(len(index), 1e-12), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(cases)) + bias, -30, 30)))
        e = (y - p) * weight
        g = np.bincount(flat, e[row], len(index)) - decay * w / len(index)
        g2 += g * g
        w += 0.5 * g / np.sqrt(g2)
        bias += 0.5 * e.sum()
    return Model(dict(zip(index, w.tolist(), strict=True)), float(bias))


def fitted(docs: DataFrame, key: str, text: str, fit_texts: int = FIT_TEXTS, fit_chars: int = FIT_CHARS) -> Model:
    """A model fitted on about `fit_texts` rows by hash of the key, those of them with at most `fit_chars` characters."""
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= fit_chars))
    return fit(samples.by_hash(rows, key, text, fit_texts, docs.count()))


def _mapped(docs: DataFrame, key: str, text: str, model: Model, whole: bool) -> DataFrame:
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, bias)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [m.split(t) for t in texts]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            pos = np.array([p for f in found for p in f], np.int32).reshape(-1, 2)
            cols = {"_k": batch.column(0).take(take), "start_pos": pa.array(pos[:, 0]), "end_pos": pa.array(pos[:, 1])}
            if whole:
                cols |= {"number": pa.array([i for f in found for i in range(len(f))], pa.int32()), "sentence": pa.array([t[a:b] for t, f in zip(texts, found, strict=True) for a, b in f], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    kinds = f"_k {rows.schema['_k'].dataType.simpleString()}, start_pos int, end_pos int" + ", number int, sentence string" * whole
    return spread(rows).mapInArrow(run, kinds).withColumnRenamed("_k", key)


def split(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, start_pos, end_pos): the sentences of every text, without white space or byte-order mark at their ends.

    Positions are code points, the end is exclusive. Null, empty and blank texts have none; very long ones are split
    whole. Repeated and null keys are split each; extra columns are ignored.
    """
    return _mapped(docs, key, text, model, False)


def units(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """As split, with each sentence's number in its text, from 0, and the sentence."""
    return _mapped(docs, key, text, model, True)
