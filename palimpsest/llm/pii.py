"""Personal information inside free text.

A linear-chain conditional random field labels the tokens of a text: begin or inside of an email address, phone number,
identity number, street address or personal name, or none. Its features are word shapes: of the token and its
neighbours, of the whole run of digits and separators it stands in, kinds of cue words around that run; for names also
the lexicon's roles. It is trained on a small labelled table by forward-backward, and decoded by Viterbi over batches of
texts in numpy. Found spans are then held against the least that a find of their kind must have.

Where no find can be by that check (no long run of digits, no mail sign, no capitals in a row, no road with a number,
no name of the lexicon) the label is none by definition. A chain through such tokens falls apart into independent
parts, so only the regions between them are scored, with the words around them as context, in training as in decoding.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import inspect
import random
import re
import sys
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import labelled
from palimpsest.runtime import shared_dir, spread

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
WINDOW = 3
#: In training: the size of a table (labelled.SHARE times this), the tables' seeds; the share of sequences with new words, that of the new among their words, that of sequences for which the lexicon is used.
SCALE, SEEDS, STRANGE = 1.6, (11, 12), (0.65, 0.85, 0.65)
#: Characters around a region that are its context, and of them those in which cue words are looked for.
LEFT, RIGHT, CUE_LEFT, CUE_RIGHT = 64, 40, 44, 26
#: Most tokens, padding included, that are decoded at once, and words whose scores are kept.
BATCH_TOKENS, KNOWN_WORDS = 1 << 15, 60_000
_TOKEN = re.compile(r"[㐀-鿿぀-ヿ]|[^\W\d_㐀-鿿぀-ヿ]+|\d+|\n+|[^\w\s]|_")
_MIXED = r"[A-Z](?<![A-Za-z0-9][A-Z])(?=[A-Z0-9]{7,11}(?![A-Za-z0-9]))[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*|\d{1,3}[A-Z]{1,3}\d{4,8}(?![A-Za-z0-9])(?<![A-Za-z0-9]{13})"
#: Letters that open or close a number: apart from it only capitals, or two small ones before pairs of digits.
_BEFORE = r"(?:(?<![A-Za-z0-9])(?:[A-Z]{1,2}[ -]?|[A-Z]{3}-?|[a-z]{1,3}|[a-z]{2}-(?=\d{3}-\d{3}-[a-z])|[a-z]{2} (?=\d\d \d\d \d\d [a-z](?![A-Za-z0-9])))(?=\d))"
_AFTER = r"(?:(?:[ -]?[A-Z]|(?<=\d\d \d\d \d\d) [a-z]|-?[a-z])(?![A-Za-z0-9]))"
_RUN = re.compile(rf"{_MIXED}|{_BEFORE}?[+(]?\d[\d ().\-/]*\d{_AFTER}?|\d")
_USER, _PART = r"(?:(?![㐀-鿿])[\w.+-])+", r"(?:(?![㐀-鿿])[\w-])+"
_MAIL = re.compile(rf"{_USER}(?: ?@ ?| ?\[at\] ?| ?\(at\) ?){_PART}(?:(?:\.|\[dot\]|\(dot\)| dot ){_PART})*(?:\.|\[dot\]|\(dot\)| dot )[A-Za-z]{{2,}}|{_USER} at {_PART}(?: dot {_PART})+", re.I)
_AT = re.compile(r"@|[\[(]at[\])]| dot ", re.I)
_LONG_END = tuple("straße strasse gasse allee platz gatan vägen veien straat gracht plein".split())
_STREET_END = (*_LONG_END, *"str weg ring ufer damm steig stieg laan gade vej".split())
_ROADS = {w.lower().strip(".") for w in (*labelled.ROADS_EN, *labelled.ROADS_FR, *labelled.ROADS_ES, *labelled.ROADS_XX, *labelled.ROADS_DE)}
_ROADS_FIRST = {w.lower().strip(".") for w in (*labelled.ROADS_FR, *labelled.ROADS_ES, *labelled.ROADS_XX)}
_PARTICLES = set("von van de der den del della di da du la le el al bin ibn zu zur dos y ter ten".split())
_ROADS_CAPITAL = {w.lower().strip(".") for w in labelled.ROADS_EN}
_TITLES = {"dr", "mr", "mrs", "ms", "prof", "professor", "herr", "herrn", "frau", "mme", "sr", "sra", "hr", "fr", "doctor", "miss", "sir", "m", "captain", "monsieur", "madame", "señor", "señora"}
_CUE: dict[str, tuple[str, ...]] = {}
for _kind, _words in labelled.CUES.items():
    for _word in _words.split():
        _CUE[_word] = (*_CUE.get(_word, ()), _kind)

# Where finds can be.
_CAP = r"[A-ZÀ-ÖØ-ÞĄĆČĎĘĚĞİŁŃŇŐŘŚŞŠŤŮŰŹŻŽ][\w'’-]*"
_SMALL = r"(?:von|van|de|der|den|del|della|di|da|du|la|le|el|al|bin|ibn|zu|zur|dos|y|ter|ten)"
# Patterns begin with the rarest sign, so that a scan is one search for it; what may stand before is looked at where one is found.
_LONG = re.compile(rf"\d(?:[ ().\-/]{{0,3}}\d){{5,}}{_AFTER}?")
_LONG_LEFT = re.compile(r"(?:(?<![A-Za-z0-9])(?:[A-Z]{1,2}[ -]?|[A-Z]{3}-?|[a-z]{1,3}))?[+(]{0,2}$")
_SMALL_PAIR = re.compile(r"(?<![A-Za-z0-9])[a-z]{2}[ -]$")
_CAPITAL = "A-ZÀ-ÖØ-ÞĄĆČĎĘĚĞİŁŃŇŐŘŚŞŠŤŮŰŹŻŽ"
_NAMES = re.compile(rf"[{_CAPITAL}](?<![^\W_][{_CAPITAL}])[\w'’-]*(?:[ ,.&-]{{1,3}}(?:{_SMALL}[ -]){{0,3}}(?:[dl]['’]|al-)?{_CAP})+")
_NAMES_LEFT = re.compile(rf"(?:(?<![\w]){_SMALL} )?(?:(?<![\w])(?:[dl]['’]|al-))?$")
_HAN, _MIXED_RUN = re.compile("[㐀-鿿]"), re.compile(_MIXED)
_NUMBERED = re.compile(r"[㐀-鿿]{2,14}\d{1,5}号")
_BORN = re.compile(r"\d{6}(?:19|20)\d\d[01]\d[0-3]\d{4}[\dXx]")
_DATE = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d(?![-\d])")
# Around a road's word: a number before it, or one after it, with the words between.
_NUMBER = r"\d{1,4}(?:-\d{1,4})?(?:[A-Za-z]?(?![A-Za-z0-9])(?: (?:bis|ter|[A-Za-z])(?![A-Za-z0-9]))?)"
_NUMBER_LEFT = re.compile(rf"(?<![A-Za-z0-9.]){_NUMBER},?(?: [\w'’.-]+){{0,4}} ?$")
_WORDS_LEFT, _WORDS_RIGHT = re.compile(r"(?:[^\W\d_][\w'’.-]* ){0,3}$"), re.compile(r"\.?(?: [^\W\d_][\w'’.-]*){0,4}")
_NUMBER_RIGHT = re.compile(rf"\.?(?: [^\W\d_][\w'’.-]*){{0,4}},? (?:n\.?º ?|nr\. ?|no\. ?)?{_NUMBER}")


class Lexicon:
    """Roles of lower-cased name parts; family names of one Han character apart."""

    def __init__(self, rows: Iterable[tuple[str, str]]):
        self.rows, self.role = list(rows), {}
        for name, role in self.rows:
            for part in re.split(r"[\s'’-]+", name.lower()):
                if len(part) > 1 or ord(part[:1] or " ") > 0x2E80:
                    self.role[part] = "both" if self.role.get(part, role) != role else role
        wide = "".join(re.escape(x) for x in self.role if len(x) == 1)
        self.han = re.compile(f"[{labelled.ZH_FAMILY}{wide}][㐀-鿿]{{1,3}}")
        self.parts = ahocorasick.Automaton()
        for part in _ROADS:
            self.parts.add_word(part, (len(part), True, part in _STREET_END))
        for part in _STREET_END:
            self.parts.add_word(part, (len(part), True, True))
        for part in self.role:
            if part[0] < "\u2e80":
                self.parts.add_word(part, (len(part), part in _ROADS or part in _STREET_END, part in _STREET_END))
        self.parts.make_automaton()
        for part in ("von", "van", "de", "der", "d", "o"):
            self.role.setdefault(part, "particle")

    def regions(self, text: str) -> list[tuple[int, int]]:
        """The parts of a line in which finds can be, in order and apart."""
        out = [m.span() for m in _MIXED_RUN.finditer(text)]
        for m in _LONG.finditer(text):
            a, b = m.span()
            if not ((d := _DATE.match(text, a)) and sum(map(str.isdigit, text[d.end() : b])) < 6):
                left = len(_LONG_LEFT.search(text[max(0, a - 7) : a])[0])
                out.append((a - (3 if not left and _SMALL_PAIR.search(text[max(0, a - 4) : a]) and text[b - 2] in " -" and text[b - 1].islower() else left), b))
        for m in _NAMES.finditer(text):
            a, b = m.span()
            out.append((a - len(_NAMES_LEFT.search(text[max(0, a - 9) : a])[0]) if a else 0, b))
        if any_han := _HAN.search(text):
            out += [m.span() for m in _NUMBERED.finditer(text, any_han.start())]
            out += [m.span() for m in self.han.finditer(text, any_han.start())]
        if _AT.search(text):
            out += [m.span() for m in _MAIL.finditer(text)]
        low = text.lower()
        if len(low) != len(text):  # a capital whose small form is two characters
            low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        for end, (size, road, suffix) in self.parts.iter(low):
            a, b = end + 1 - size, end + 1
            if text[b : b + 1].isalpha():
                continue
            whole = not text[a - 1 : a].isalpha() if a else True
            if road and (whole or suffix):
                kept = a
                while not whole and a and text[a - 1].isalpha():
                    a -= 1
                if not whole and not text[a].isupper() and not low[kept:b] in _LONG_END:
                    continue
                left = text[max(0, a - 56) : a]
                if m := _NUMBER_LEFT.search(left):
                    out.append((a - len(left) + m.start(), b + len(_WORDS_RIGHT.match(text, b)[0])))
                elif m := _NUMBER_RIGHT.match(low, b):
                    out.append((a - len(_WORDS_LEFT.search(left)[0]), m.end()))
            if whole and text[a:b].islower() and low[a:b] in self.role:  # a name in small letters: with the two words around it
                left, right = _TWO_LEFT.search(text[max(0, a - 40) : a]), _TWO_RIGHT.match(text[b : b + 40])
                out.append((a - len(left[0]), b + len(right[0])))
        out.sort()
        merged: list[tuple[int, int]] = []
        for a, b in out:
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged


_TWO_LEFT, _TWO_RIGHT = re.compile(r"(?:[^\W\d_][\w'’-]*\.?,? ?){0,2}$"), re.compile(r"(?:[ ,.-]{1,2}[^\W\d_][\w'’-]*){0,2}")


def windows(line: str, lexicon: Lexicon) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(start, text, free parts of the text): the line's regions with their context; those with common context are one."""
    out: list[tuple[int, int, list]] = []
    for a, b in lexicon.regions(line):
        left = max(0, a - LEFT)
        if left:
            blank = line.rfind(" ", max(0, left - 16), left)
            left = blank + 1 if blank >= 0 else left
        right = min(len(line), b + RIGHT)
        if out and left <= out[-1][1]:
            out[-1] = (out[-1][0], right, [*out[-1][2], (a, b)])
        else:
            out.append((left, right, [(a, b)]))
    return [(left, line[left:right], [(a - left, b - left) for a, b in free]) for left, right, free in out]


def shape(w: str) -> str:
    c = w[0]
    if c.isdigit():
        return f"d{min(len(w), 12)}"
    if "㐀" <= c <= "鿿":
        return "H"
    if c.isalpha():
        return ("X" if w.isupper() else "x" if w.islower() else "Xx" if w[0].isupper() and w[1:].islower() else "xX") + ("1" if len(w) == 1 else "s" if len(w) < 4 else "")
    return "\n" if c == "\n" else c


def word_features(w: str, lexicon: Lexicon, known: bool = True, listed: bool = True) -> list[str]:
    """Features of a token; without `known`, only those that words never seen before have too, and without `listed`, those of
    a word that the lexicon lacks."""
    low, s = w.lower(), shape(w)
    out = ["s" + s]
    if w[0].isdigit():
        return out
    role = lexicon.role.get(low)
    if role and (listed or role == "particle"):
        out += ["l" + role, f"l{role}{s}"]
    elif w[0].isalpha():
        out.append("no" + s)
    if low in _ROADS:
        out += ["road", "road" + s]
    if low.endswith(_STREET_END if w[0].isupper() else _LONG_END) and len(low) > 4:
        out.append("strasse")
    if low in _TITLES:
        out.append("title")
    out += ["k" + k for k in _CUE.get(low, ())]
    if s == "H" and low in labelled.ZH_FAMILY:
        out.append("zhfamily")
    if known:
        out.append("w" + low[:16])
        if len(low) > 4:
            out.append("e" + low[-3:])
    return out


CATEGORIES = ("", "digits", "number", "Xx", "XX", "X", "x", "x1", "xX", "han", "zhfamily", "road", "strasse", "org", "title", "person", "given", "family", "both", "particle", "cue", *",.-:'()@;[]/+<>", "\n", "sign")
_CATEGORY = {c: i for i, c in enumerate(CATEGORIES)}


def category(w: str, lexicon: Lexicon, listed: bool = True) -> int:
    """What a token is, as far as the order of neighbours goes; 0 stands for no token."""
    c, low = w[0], w.lower()
    if c.isdigit():
        return _CATEGORY["digits" if len(w) > 4 else "number"]
    if not c.isalpha():
        return _CATEGORY.get("'" if c in "’'" else c, _CATEGORY["sign"])
    if "㐀" <= c <= "鿿":
        return _CATEGORY["zhfamily" if c in labelled.ZH_FAMILY or (listed and lexicon.role.get(low) == "family") else "han"]
    role = lexicon.role.get(low)
    if role and (listed or role == "particle"):
        return _CATEGORY[role]
    if low in _TITLES:
        return _CATEGORY["title"]
    cues = _CUE.get(low, ())
    if "org" in cues:
        return _CATEGORY["org"]
    if low in _ROADS:
        return _CATEGORY["road"]
    if low.endswith(_STREET_END if c.isupper() else _LONG_END) and len(low) > 4:
        return _CATEGORY["strasse"]
    if cues:
        return _CATEGORY["person" if "person" in cues else "cue"]
    if len(w) == 1:
        return _CATEGORY["X" if w.isupper() else "x1"]
    return _CATEGORY["XX" if w.isupper() else "x" if w.islower() else "Xx" if c.isupper() and w[1:].islower() else "xX"]


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    words, starts, ends = [], [], []
    for m in _TOKEN.finditer(text):
        words.append(m.group())
        a, b = m.span()
        starts.append(a)
        ends.append(b)
    return words, starts, ends


def is_free(starts: list[int], free: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens begin in a free part."""
    s = np.array(starts)
    i = np.searchsorted([a for a, _ in free], s, side="right") - 1
    return (i >= 0) & (s < np.array([b for _, b in free])[np.maximum(i, 0)])


@functools.lru_cache(KNOWN_WORDS)
def run_shapes(run: str) -> tuple[str, str, str]:
    """Shape, kind and signs of a run."""
    return (run_shape(run), "date" if _DATE.match(run) else "cn" if _BORN.fullmatch(run) else run_kind(run), re.sub(r"[\dA-Za-z]+", "x", run.strip())[:12])


def run_shape(run: str) -> str:
    """Digits by their number, separators as they are: `+d2 d2 d4 d4`."""
    return "r" + re.sub(r"\d+", lambda m: f"d{min(len(m.group()), 19)}", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", run.strip())))[:40]


def run_kind(run: str) -> str:
    """What runs that look alike have in common: how they open, letters, number of digits, groups and signs between."""
    groups = re.findall(r"\d+", run)
    opener = "+" if run[:1] == "+" or run[:2] == "(+" else "(" if run[:1] == "(" else "00" if run[:2] == "00" else "0" if run[:1] == "0" else "A" if run[:1].isalpha() else "d"
    return f"{opener}{'A' if run[-1:].isalpha() else ''}{'m' if re.search('[A-Za-z]', run[1:-1].lstrip('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')) else ''}{sum(map(len, groups))}"


_WORDS = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")


def extras(text: str, starts: list[int], ok: np.ndarray) -> list[tuple[int, tuple]]:
    """(token, key) of each free token in a run of digits or a mail form: its shapes, the two words before it, kinds of cues around it."""
    spans = [(*m.span(), m[0]) for m in _RUN.finditer(text)]
    if _AT.search(text):
        mails = [(*m.span(), "mail") for m in _MAIL.finditer(text)]
        spans = sorted(mails + [s for s in spans if not any(a < s[1] and s[0] < b for a, b, _ in mails)])
    out, n = [], len(starts)
    for a, b, run in spans:
        j = k = bisect.bisect_left(starts, a)
        while k < n and starts[k] < b:
            k += 1
        if not ok[j:k].any():
            continue
        before = _WORDS.findall(text[max(0, a - CUE_LEFT) : a].lower())[::-1]
        around = (*(before[:2] + ["^", "^"])[:2], tuple([x for w in before for x in _CUE.get(w, ())][:3]), tuple([x for w in _WORDS.findall(text[b : b + CUE_RIGHT].lower()) for x in _CUE.get(w, ())][:1]))
        shapes = ("mail", "mail", "") if run == "mail" else run_shapes(run)
        out += [(i, ("B" if i == j else "I", *shapes, *around)) for i in range(j, k) if ok[i]]
    return out


def extra_features(key: tuple, known: bool = True) -> list[str]:
    at, run, kind, signs, cue1, cue2, before, after = key
    out = [f"R{at}{run}", f"N{at}{kind}", f"N{kind[:1]}{at}", f"S{at}{signs}", f"NS{at}{kind}{signs}"]
    out += [f"K-{k}" for k in set(before)] + [f"K+{k}" for k in after]
    if before:
        out += [f"K1{before[0]}", f"K1{before[0]}{kind}"]
    else:
        out += ["K0", f"K0{kind}"]
    if known:
        out += [f"C{cue1}", f"D{cue2}"]
    return out


FORBIDDEN = -1e4


def order_keys(cats: np.ndarray, line: np.ndarray) -> list[np.ndarray]:
    """Of each token, the three categories that end with it, have it in their middle, and begin with it, each as one number."""
    k, n = len(CATEGORIES), len(cats)

    def near(o: int) -> np.ndarray:
        out = np.zeros(n, int)
        if o < 0 and -o < n:
            out[-o:] = np.where(line[:o] == line[-o:], cats[:o], 0)
        elif 0 < o < n:
            out[:-o] = np.where(line[o:] == line[:-o], cats[o:], 0)
        return cats if o == 0 else out

    return [(near(o - 2) * k + near(o - 1)) * k + near(o) for o in range(3)]


class Field:
    """Weights of a conditional random field, by feature."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray, lexicon: Lexicon):
        self.weights, self.trans, self.lexicon = weights, trans, lexicon
        k = len(CATEGORIES)
        self.order = np.zeros((3, k * k * k, len(LABELS)), np.float32)
        for f, w in weights.items():
            if f[0] == "T":
                o, key = f[1:].split(":")
                self.order[int(o), int(key)] = w
        self._forget()

    def _forget(self) -> None:
        self.known, self.rows, self.extra = {}, np.zeros((1024, 2 * WINDOW + 1, len(LABELS)), np.float32), {}
        self.cats = np.zeros(1024, int)

    def _row(self, prefix: str, features: Iterable[str]) -> np.ndarray:
        out = np.zeros(len(LABELS), np.float32)
        for f in features:
            w = self.weights.get(prefix + f)
            if w is not None:
                out += w
        return out

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Rows of the words in `rows`: the scores that a word gives to the labels of its neighbours, by offset."""
        known = self.known
        for w in set(words) - known.keys():
            i = known[w] = len(known)
            if i == len(self.rows):
                self.rows, self.cats = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.cats))
            self.cats[i] = category(w, self.lexicon)
            f = word_features(w, self.lexicon)
            for o in range(-WINDOW, WINDOW + 1):
                self.rows[i, o + WINDOW] = self._row(f"{o}:", f)
        return np.array([known[w] for w in words])

    def scores(self, texts: list[str], toks: list[tuple[list[str], list[int], list[int]]], free: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the labels of all tokens of all windows, one after another, and their sizes."""
        if len(self.known) > KNOWN_WORDS or len(self.extra) > KNOWN_WORDS:
            self._forget()
        size = np.array([len(t[0]) for t in toks])
        word = self._numbers([w for t in toks for w in t[0]])
        line, at = np.repeat(np.arange(len(toks)), size), np.flatnonzero(np.concatenate(free))
        n = len(word)
        out = np.zeros((n, len(LABELS)), np.float32)
        out[:, 1:] = FORBIDDEN
        got = self.rows[word[at], WINDOW].copy()
        for o in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
            to = np.clip(at + o, 0, n - 1)
            near = (line[to] == line[at]) & (to == at + o)
            got[near] += self.rows[word[to[near]], WINDOW + o]
        for o, key in enumerate(order_keys(self.cats[word], line)):
            got += self.order[o, key[at]]
        start, end = np.array([x for t in toks for x in t[1]]), np.array([x for t in toks for x in t[2]])
        before = np.maximum(at - 1, 0)
        glued = (at > 0) & (start[at] == end[before]) & (line[at] == line[before])
        for flag, name in ((glued, "G1"), (~glued, "G0")):
            if name in self.weights:
                got[flag] += self.weights[name]
        out[at] = got
        base, extra = 0, self.extra
        for text, (_, starts, _), ok in zip(texts, toks, free, strict=True):
            for i, key in extras(text, starts, ok):
                row = extra.get(key)
                if row is None:
                    row = extra[key] = self._row("", extra_features(key))
                out[base + i] += row
            base += len(starts)
        return out, size

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the finds of each text. Texts are cut at line ends, lines into windows, and these decoded in
        batches of like length, of at most BATCH_TOKENS tokens if a single one has no more."""
        parts = [(t, a + x, w, free, first, end) for t, text in enumerate(texts) for a, line, first, end in _lines(text) for x, w, free in windows(line, self.lexicon)]
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        toks = [tokens(x[2]) for x in parts]
        order = sorted((i for i in range(len(parts)) if toks[i][0]), key=lambda i: len(toks[i][0]))
        at = 0
        while at < len(order):  # no more than a quarter of a batch is padding
            most, n = 16 + len(toks[order[at]][0]) * 5 // 4, at + 1
            while n < len(order) and len(toks[order[n]][0]) <= most and (n + 1 - at) * len(toks[order[n]][0]) <= BATCH_TOKENS:
                n += 1
            some, at = order[at:n], n
            mine = [toks[i] for i in some]
            paths = viterbi(*self.scores([parts[i][2] for i in some], mine, [is_free(toks[i][1], parts[i][3]) for i in some]), self.trans)
            for i, path in zip(some, paths, strict=True):
                if path.any():
                    t, a, w, _, first, end = parts[i]
                    found[t] += [(a + x, a + y, k) for x, y, k in spans_of(w, toks[i], path, self.lexicon) if first <= a + x < end]
        return [_apart(sorted(f)) for f in found]


def _lines(text: str, most: int = 20_000, overlap: int = 600) -> Iterator[tuple[int, str, int, int]]:
    """(start, line, first, end): lines; those beyond `most` characters in parts that overlap. A find counts in the part in
    whose range from first to end it begins, so one of up to half the overlap lies whole in its part, with text around it."""
    at = 0
    for line in text.split("\n"):
        a = first = 0
        while len(line) - a > most:
            middle = a + most - overlap // 2
            yield at + a, line[a : a + most], at + first, at + middle
            a, first = a + most - overlap, middle
        if line[a:].strip():
            yield at + a, line[a:], at + first, at + len(line)
        at += len(line) + 1


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without the rest of a find that the part before has whole."""
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def viterbi(flat: np.ndarray, size: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of a batch of texts of like length, from the scores of all their tokens."""
    n, k, b = size.max(), len(LABELS), len(size)
    x = np.zeros((b, n, k), np.float32)
    x[np.repeat(np.arange(b), size), np.concatenate([np.arange(s) for s in size])] = flat
    back = np.zeros((n, b, k), np.int8)
    v, into = x[:, 0] + trans[k], np.ascontiguousarray(trans[:k].T)[None]
    for t in range(1, n):
        step = v[:, None, :] + into
        back[t] = best = step.argmax(2)
        new = np.take_along_axis(step, best[:, :, None], 2)[:, :, 0] + x[:, t]
        v = np.where((t < size)[:, None], new, v)
    best, out = v.argmax(1), np.zeros((b, n), np.int8)
    for t in range(n - 1, -1, -1):
        live = t < size
        out[live, t] = best[live]
        best = np.where(live & (t > 0), back[t, np.arange(b), best], best)
    return [out[i, :s] for i, s in enumerate(size)]


def spans_of(text: str, toks: tuple[list[str], list[int], list[int]], path: np.ndarray, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    words, starts, ends = toks
    out, i = [], 0
    path = path.tolist()
    while i < len(path):
        if path[i] == 0:
            i += 1
            continue
        kind = KINDS[(path[i] - 1) // 2]
        j = i + 1
        while j < len(path) and path[j] == 2 * KINDS.index(kind) + 2:
            j += 1
        a, b = starts[i], ends[j - 1]
        if (s := settle(text, a, b, kind, lexicon)) is not None:
            out.append((*s, kind))
        i = j
    return out


def settle(text: str, a: int, b: int, kind: str, lexicon: Lexicon) -> tuple[int, int] | None:
    """The exact check of a find: its bounds without what doesn't belong to it, or None if it can't be one."""
    if kind == "name":
        while (m := re.match(r"([^\W\d]+)(\.?\s+)", text[a:b])) and m[1].lower() in _TITLES:
            a += m.end()
        if (m := re.match(r"([^,]+?) ([^\s,]+),", text[a:b])) and m[1].split(" ")[-1].lower() not in _PARTICLES:  # before a comma stands one family name
            a += m.end(1) + 1
    if kind == "email" and (mail := next((m for m in _MAIL.finditer(text) if m.start() < b and m.end() > a), None)):
        a, b = max(a, mail.start()), min(b, mail.end())
    if kind == "address":
        while (m := re.match(r"([a-zà-ÿ]+)\s+", text[a:b])) and m[1] not in _ROADS:
            a += m.end()
        if (m := re.match(r" ([A-Za-z]+)\b", text[b : b + 20])) and m[1].lower() in _ROADS_CAPITAL and m[1][0].isupper():
            b += m.end()
    if kind == "address":
        while b - a > 5 and text[a] in "在到至往去是" and text[a + 1] > "㐀":
            a += 1
    if kind in ("id_number", "phone") and re.search(r"\d [a-z]$", text[a:b]) and not text[a : a + 2].islower():
        b -= 2
    if kind == "id_number" and (m := re.match(r"[a-zà-ÿ]{2,} (?!\d\d \d\d \d\d [a-z]$)", text[a:b])):
        a += m.end()
    if kind == "address" and re.match(r"(\S+)", text[a:b])[1].lower() in _ROADS_FIRST and re.search(r"\d [aeoyà]$", text[a:b]):
        b -= 2
    while a < b and not (text[a].isalnum() or (kind == "phone" and text[a] in "+(")):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    han = any("㐀" <= c <= "鿿" for c in s)
    inside = text[a - 1 : a] in _GLUE or text[b : b + 1] == "_" or (s[:1] < "\u2e80" and _LETTER.match(text[a - 1 : a]) or s[-1:] < "\u2e80" and _LETTER.match(text[b : b + 1])) if s else True
    ok = {
        "email": lambda: bool(re.search(r"@|at", s, re.I)) and bool(re.search(r"\.|dot", s, re.I)) and letters > 3,
        "phone": lambda: 7 <= digits <= 15 and not letters and not inside and not _DATE.match(s),
        "id_number": lambda: 6 <= digits <= 18 and letters <= 4 and not inside and not _DATE.match(s),
        "address": lambda: letters >= 2 and not inside and (bool(re.search(r"[路街巷弄道同里村]\d+号", s)) if han else _is_address(s)),
        "name": lambda: not digits and (2 <= len(s) <= 4 if han else len(s) >= 4 and _is_name(s, lexicon)),
    }[kind]()
    return (a, b) if ok else None


_GLUE, _LETTER = tuple("_-#/="), re.compile(r"[A-Za-z0-9]")


_BETWEEN = set("in for of and to from with on at by is are was were".split())


def _is_address(s: str) -> bool:
    """A number before words that end in a road or begin with one, or after words that hold one."""
    if (m := re.match(r"\d+(?:-\d+)?\s?(?:[A-Za-z]\b|bis\b|ter\b)?,?\s+(.+)", s, re.I)) and not re.search(r"\d", m[1]):
        w = [x.lower() for x in re.findall(r"[^\W\d_]+", m[1])]
        return w[0] in _ROADS_FIRST or not _BETWEEN.intersection(w) and any(x in _ROADS_CAPITAL for x in w[1:]) or any(x.endswith(_STREET_END) and len(x) > 4 for x in w)
    w = [x.lower() for x in re.findall(r"[^\W\d_]+|C/", s[: m.start()])] if (m := re.search(r"\d+(?:-\d+)?\s?\w*$", s)) else []
    return not re.search(r"\d", s[: m.start()]) and (any(x in _ROADS_FIRST for x in w[:2]) or any(x.endswith(_STREET_END) for x in w)) if w else False


def _is_name(s: str, lexicon: Lexicon) -> bool:
    """At least two parts, written alike: all with capitals, or all without and at least two of them in the lexicon, one as given."""
    parts = [x for x in re.findall(r"[^\W\d_][^\s,]*", s) if x.lower().rstrip(".") not in _PARTICLES]
    small = [not any(c.isupper() for c in x[:3]) for x in parts]
    first, last = (_CUE.get(x.lower().strip(".,"), ()) for x in (parts or [""])[:: max(1, len(parts) - 1)][:2]) if len(parts) > 1 else ((), ())
    if "org" in first or ({"org", "thing"}.intersection(last) and len(parts) < len(s.split())):  # Team ..., ... von Auftrag
        return False
    return len(parts) > 1 and (not any(small) or all(small) and (roles := [x for y in parts for x in map(lexicon.role.get, re.split(r"[-'’]", y)) if x in ("given", "family", "both")]) and len(roles) > 1 and set(roles) != {"family"})


def _chunk(cases: list, index: dict[str, int], lexicon: Lexicon, r: random.Random):
    """Arrays of a few sequences: features by token, tokens by feature, labels, positions. Only free tokens have features.

    In most of the sequences most words are known by their shape and kinds only, as new words would be, and in a part of
    them the lexicon has none.
    """
    rows, cols, labels, sizes, base, frees = [], [], [], [], 0, []
    for words, starts, ends, run, free, spans, all_known in cases:
        y = np.zeros(len(words), int)
        for a, b, kind in spans:
            inside = [i for i in range(len(words)) if starts[i] < b and ends[i] > a and free[i]]
            if inside:
                y[inside] = 2 * KINDS.index(kind) + 2
                y[inside[0]] -= 1
        strange, listed = not all_known and r.random() < STRANGE[0], r.random() < STRANGE[2]
        feats = [word_features(w, lexicon, not (strange and r.random() < STRANGE[1]), listed) for w in words]
        keys = order_keys(np.array([category(w, lexicon, listed) for w in words]), np.zeros(len(words), int))
        for i in np.flatnonzero(free).tolist():
            names = [f"{o}:{f}" for o in range(-WINDOW, WINDOW + 1) if 0 <= i + o < len(words) for f in feats[i + o]]
            if i in run:
                names += extra_features(run[i], not (strange and r.random() < STRANGE[1]))
            names.append("G1" if i and starts[i] == ends[i - 1] else "G0")
            names += [f"T{o}:{key[i]}" for o, key in enumerate(keys)]
            rows += [base + i] * len(names)
            cols += [index.setdefault(f, len(index)) for f in names]
        labels.append(y)
        frees.append(free)
        sizes.append(len(words))
        base += len(words)
    rows, (used, cols) = np.array(rows), np.unique(cols, return_inverse=True)
    order = np.argsort(cols, kind="stable")
    size, y, free = np.array(sizes), np.concatenate(labels), np.flatnonzero(np.concatenate(frees))
    seq, pos = np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(s) for s in size])
    k = len(LABELS)
    gold, pairs = np.zeros((base, k), np.float32), np.zeros((k + 1, k))
    gold[np.arange(base), y] = 1
    np.add.at(pairs, (np.where(pos == 0, k, np.r_[0, y[:-1]]), y), 1)
    return used, cols, np.searchsorted(rows, free), rows[order], np.searchsorted(cols[order], np.arange(len(used))), size, seq, pos, gold, pairs, free


def _expect(x: np.ndarray, trans: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: the expected labels of each token, and the expected pairs of neighbours."""
    b, n, k = x.shape
    m = np.exp(trans[:k])
    e = np.exp(x - x.max(2, keepdims=True)).transpose(1, 0, 2)
    alpha = np.zeros((n, b, k), x.dtype)
    a = e[0] * np.exp(trans[k])
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ m) * e[t]
        alpha[t] = a / a.sum(1, keepdims=True)
    beta = np.ones((b, k), x.dtype)
    expect, pair = np.zeros((n, b, k), x.dtype), np.zeros((k + 1, k))
    for t in range(n - 1, -1, -1):
        live = (t < size)[:, None]
        beta = np.where((t < size - 1)[:, None], beta, 1.0)
        p = alpha[t] * beta
        expect[t] = p / p.sum(1, keepdims=True)
        if t:
            right = e[t] * beta
            z = ((alpha[t - 1] @ m) * right).sum(1, keepdims=True)
            pair[:k] += m * ((alpha[t - 1] * live / z).T @ right)
            beta = right @ m.T
            beta /= beta.sum(1, keepdims=True)
        else:
            pair[k] = (expect[0] * live).sum(0)
    return expect, pair


def fit(table: list[tuple[str, list[tuple[int, int, str]], bool]], lexicon: Lexicon, epochs: int = 8, rate: float = 0.2, chunk: int = 64, seed: int = 3) -> Field:
    """Weights that make the labels likeliest, by adaptive gradient steps (AdaGrad) over chunks of sequences of like length."""
    index: dict[str, int] = {}
    cases = []
    for text, spans, known in table:
        for at, w, free in windows(text, lexicon):
            words, starts, ends = tokens(w)
            ok = is_free(starts, free)
            cases.append((words, starts, ends, dict(extras(w, starts, ok)), ok, [(a - at, b - at, k) for a, b, k in spans], known))
    cases = sorted((c for c in cases if c[4].any()), key=lambda c: len(c[0]))
    order = random.Random(seed)
    chunks = [_chunk(cases[i : i + chunk], index, lexicon, order) for i in range(0, len(cases), chunk)]
    k = len(LABELS)
    w, trans = np.zeros((len(index), k), np.float32), np.zeros((k + 1, k))
    for i, name in enumerate(LABELS):  # an inside follows its own begin or inside only
        if name[0] == "I":
            trans[[j for j in range(k + 1) if j not in (i, i - 1)], i] = -20.0
    fixed = trans < -10
    gw, gt = np.full(w.shape, 1e-6, np.float32), np.full(trans.shape, 1e-6)
    r = np.random.default_rng(seed)
    total = np.zeros_like(w)
    for epoch in range(epochs):
        for c in r.permutation(len(chunks)):
            used, cols, token_at, rows, feature_at, size, seq, pos, gold, pairs, free = chunks[c]
            x = np.full((len(size), size.max(), k), -30, np.float32)
            x[:, :, 0] = 0
            own = w[used]
            x[seq[free], pos[free]] = np.add.reduceat(own[cols], token_at, axis=0)
            expect, pair = _expect(x, trans.astype(np.float32), size)
            g = np.add.reduceat((gold - expect[pos, seq])[rows], feature_at, axis=0) / len(size) - 1e-5 * own
            h = np.where(fixed, 0, (pairs - pair) / len(size))
            gw[used] += g * g
            gt += h * h
            w[used] = own + rate * g / np.sqrt(gw[used])
            trans += np.where(fixed, 0, rate * h / np.sqrt(gt))
        if epoch >= epochs // 2:
            total += w
    w = total / (epochs - epochs // 2)  # averaged over the later epochs
    keep = np.abs(w).max(1) > 1e-2
    return Field({f: w[i] for f, i in index.items() if keep[i]}, trans.astype(np.float32), lexicon)


def examples(table: list[tuple[str, list[tuple[int, int, str]], bool]], seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]], bool]]:
    """Lines as they occur: sentences of the table among each other, with and without an opener."""
    r, out = random.Random(seed), []
    rest = list(table)
    r.shuffle(rest)
    while rest:
        text, spans, known = r.choice(["", "", "- ", "* ", "user: ", "assistant: "]), [], False
        for _ in range(r.choice([1, 1, 2, 3])):
            if rest:
                more, found, plain = rest.pop()
                known |= plain
                spans += [(a + len(text), b + len(text), k) for a, b, k in found]
                text += more + ("" if more[-1:] in "。！？" else " ")
        out.append((text, spans, known))
    return out


def learn(lexicon_rows: Iterable[tuple[str, str]], scale: float = SCALE, seeds: Iterable[int] = SEEDS, **kw) -> Field:
    """The mean of fields fitted on labelled tables drawn from the seeds, a part of whose names are the lexicon's. Nothing
    else is read, so it is the same whatever it is applied to."""
    names, seeds = sorted(set(lexicon_rows)), list(seeds)
    given, family = ([n for n, r in names if r == role] for role in ("given", "family"))
    fields = [fit(examples(labelled.table(scale, seed, given, family), seed), Lexicon(names), seed=seed, **kw) for seed in seeds]
    weights: dict[str, np.ndarray] = {}
    for field in fields:
        for f, w in field.weights.items():
            weights[f] = weights.get(f, 0) + w / np.float32(len(seeds))
    return Field(weights, np.mean([f.trans for f in fields], axis=0).astype(np.float32), Lexicon(names))


_FITTED: dict[str, Field] = {}


def trained(spark: SparkSession, lexicon_rows: Iterable[tuple[str, str]]) -> Field:
    """The field of a lexicon: fitted once, then taken from the shared folder."""
    names = sorted(set(lexicon_rows))
    made_by = inspect.getsource(labelled) + inspect.getsource(sys.modules[__name__])  # another version's weights don't fit
    key = hashlib.sha256((repr(names) + made_by).encode()).hexdigest()[:24]
    if key not in _FITTED:
        path = f"{shared_dir(spark)}/pii-{key}"
        try:
            rows = spark.read.parquet(path).collect()  # one row per feature, of a table of bounded size
        except AnalysisException:
            rows = []
        if sum(r[0] == "t" for r in rows) != len(LABELS) + 1:  # none yet, or one that is being written
            field = learn(names)
            rows = [("t", f"{i}", x.tolist()) for i, x in enumerate(field.trans)] + [("w", f, x.tolist()) for f, x in field.weights.items()]
            spark.createDataFrame(rows, "part string, name string, row array<float>").coalesce(1).write.mode("ignore").parquet(path)
        trans = {int(n): x for p, n, x in rows if p == "t"}
        _FITTED[key] = Field({n: np.array(x, np.float32) for p, n, x in rows if p == "w"}, np.array([trans[i] for i in range(len(trans))], np.float32), Lexicon(names))
    return _FITTED[key]


def value(find: str) -> str:
    return "".join(c for c in find.lower() if c.isalnum())


def _mapped(items: DataFrame, key: str, text: str, field: Field, whole: bool) -> DataFrame:
    rows = items.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    weights, trans, names = field.weights, field.trans, field.lexicon.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(weights, trans, Lexicon(names))
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                found = f.decode(texts)
                if whole:
                    yield pa.RecordBatch.from_pydict({"_k": batch.column(0), "text": pa.array([replace(t, x) for t, x in zip(texts, found, strict=True)], pa.string()), "n_finds": pa.array([len(x) for x in found], pa.int32())})
                else:
                    take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                    flat = [(k, t[a:b]) for t, x in zip(texts, found, strict=True) for a, b, k in x]
                    yield pa.RecordBatch.from_pydict({"_k": batch.column(0).take(take), "kind": pa.array([k for k, _ in flat], pa.string()), "find": pa.array([s for _, s in flat], pa.string()), "value": pa.array([value(s) for _, s in flat], pa.string())})

    kind = rows.schema["_k"].dataType.simpleString()
    out = f"_k {kind}, text string, n_finds int" if whole else f"_k {kind}, kind string, find string, value string"
    return spread(rows).mapInArrow(run, out).withColumnRenamed("_k", key)


def replace(text: str, finds: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in finds:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def find(items: DataFrame, key: str, text: str, field: Field) -> DataFrame:
    """(key, kind, find, value): every find in every text, repeated ones repeated. Null, empty and blank texts have none;
    very long ones are read whole. Repeated and null keys are read each; extra columns are ignored."""
    return _mapped(items, key, text, field, False)


def redact(items: DataFrame, key: str, text: str, field: Field) -> DataFrame:
    """(key, text, n_finds): each non-null text with its finds replaced by placeholders, all else unchanged."""
    return _mapped(items, key, text, field, True)
