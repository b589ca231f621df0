import random
import re

from palimpsest.llm import pieces

SEP = "。！？；，"


def forced(text, limit):
    return max(map(len, re.split(rf"[\s\x1c-\x1f{SEP}]", text)), default=0) > limit


def check(text, limit, overlap):
    got = pieces.split(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(got, got[1:], strict=False):
        assert a < c <= b < d and b - c <= overlap
    assert all(b - a <= limit for a, b, _ in got)
    assert any(f for *_, f in got) == (len(text) > limit and forced(text, limit))
    return got


def test_properties():
    r = random.Random(3)
    for _ in range(1500):
        text = "".join(r.choices("abcdé́。，. \n", [r.random() * 9 for _ in range(11)], k=r.randrange(0, 300)))
        check(text, r.randrange(5, 60), r.randrange(0, 8))


def test_known_cuts():
    text = "One two three. Four five six\n\nSeven eight nine ten eleven"
    assert [text[a:b] for a, b, _ in pieces.split(text, 32, 0)] == ["One two three. Four five six\n\n", "Seven eight nine ten eleven"]
    assert pieces.split("", 10, 2) == [(0, 0, False)] and pieces.split("a" * 10, 10, 2) == [(0, 10, False)]
    assert pieces.split("a" * 25, 10, 2) == [(0, 10, True), (8, 18, True), (16, 25, False)]
    got = check("word " * 60_000, 1200, 120)  # several segments of the table
    assert all(c == b - 120 for (_, b, _), (c, *_) in zip(got, got[1:], strict=False))


def test_frame(spark):
    df = spark.createDataFrame([("a", "x" * 30, 1), ("b", None, 2), ("c", "", 3), ("d", "short", 4), (None, "ab " * 9, 5), ("a", "x" * 30, 6)], "id string, content string, piece int")
    out = pieces.pieces(df, "id", "content", 12, 3).collect()
    assert sorted(r.id for r in out if r.id) == ["a"] * 6 + ["c", "d"] and sum(r.id is None for r in out) == 3
    assert all(len(r.content) == r.end - r.start <= 12 for r in out)
    assert pieces.pieces(df.limit(0), "id", "content", 12, 3).count() == 0
