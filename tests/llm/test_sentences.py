import random

import pytest

from palimpsest.llm import sentences as s


def texts():
    r = random.Random(4)
    ends = ["We saw {} warnings from the vault.", "How many of the {} cards still point there?", "Please keep it pinned until run {}!", "Dr. Harlow checked item {} twice.", "Ask the crew at Harrow Inc. about shard {}.", 'The note reads: "Keep it cold. Do not warm it {} times."', "We kept notes, cards, etc."]
    zh = ["缓存里有{}个键。", "请不要改动任务{}！", "他写道：“请停掉{}。不要重启！”", "“任务{}完成了吗？”助手又问了一遍。"]
    th = ["เราปรับระบบความจำ {} รายการแล้ว", "กรุณาอย่าแก้ไขไฟล์นี้ก่อนประชุม", "ผู้ใช้ชอบรูปแบบเดิมมากกว่ารูปแบบใหม่"]
    out, truth = [], []
    for i in range(1500):
        pool, gap = [(ends, " "), (zh, ""), (th, " ")][i % 3]
        lines, want = [], []
        for _ in range(r.randrange(1, 4)):
            parts = [r.choice(pool).format(r.randrange(1, 9999)) for _ in range(r.randrange(1, 4))]
            parts[0] = r.choice(["user: ", "* ", "- "]) + parts[0]
            lines.append(gap.join(parts))
            want += parts
        out.append("\n".join(lines))
        truth.append(want)
    return out, truth


@pytest.fixture(scope="module")
def model():
    return s.fit(texts()[0][:1000])


def test_held_out_texts(model):
    out, truth = texts()
    for t, want in zip(out[1000:], truth[1000:], strict=True):
        assert [t[a:b] for a, b in model.split(t)] == want


def test_rules_of_lines(model):
    t = "﻿[2025-01-01] (session s-1)\r\nuser: One two\r\nthree four. Is it?\r\n\r\n# A heading. With two parts\r\nText below.\n○ #1 Do this. Or that\n[Goal]\nLast \n\n \n"
    got = [t[a:b] for a, b in model.split(t)]
    assert got == ["[2025-01-01] (session s-1)", "user: One two\r\nthree four.", "Is it?", "# A heading. With two parts", "Text below.", "○ #1 Do this. Or that", "[Goal]", "Last"]


def test_spans_and_edges(model):
    assert s.spans("a (b. c) d") == [(2, 8)] and s.spans("a (b. c d") == [] and s.spans("can’t “x. y” z") == [(6, 12)]
    assert s.spans("„Ist a? b“ c") == [(0, 10)] and s.spans("`a. b` (c [d] e)") == [(0, 6), (7, 16)]
    assert [model.split(t) for t in (None, "", " \n﻿ ")] == [[], [], []]
    long = "We saw 5 warnings from the vault. " * 20_000 + "(" * 2000
    assert len(model.split(long)) >= 20_000


def test_frame(spark, model):
    df = spark.createDataFrame([(1, "One is here. Two is there.", 3), (2, None, 4), (3, "", 5), (None, "Alone", 6), (1, "x", 7)], "doc_id bigint, text string, start_pos int")
    got = sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in s.split(df, "doc_id", "text", model).collect())
    assert got == [(0, 0, 5), (1, 0, 1), (1, 0, 12), (1, 13, 26)]
    assert {(r.number, r.sentence) for r in s.units(df, "doc_id", "text", model).where("doc_id = 1").collect()} == {(0, "x"), (0, "One is here."), (1, "Two is there.")}
    empty = s.fitted(df.limit(0), "doc_id", "text")
    assert s.split(df.limit(0), "doc_id", "text", empty).count() == 0


def test_outer_closer_after_many_open_ones():
    for a, b in ("“”", "()", '""'):
        inner = "[" if a == "(" else "("
        text = f"x {a}{inner * 100} One. Two.{b} End."
        assert s.spans(text) == [(2, text.index(b, 3) + 1)]
    assert s.spans("(" * 5_000 + ")" * 5_000) == [(0, 10_000)]
