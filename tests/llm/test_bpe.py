import random

import pytest
import tokenizers

from palimpsest.llm import bpe


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_public_library(reference):
    r = random.Random(7)
    enc = bpe.encoder()
    texts = ["", " ", "\n\n \t x", "don't we'll I'M", "<|endoftext|> <|x", "a" * 3000, "ab" * 500, "日本語のテキスト。中文，测试", "ไทย ภาษา", "٣٤ العربية", "हिन्दी में", "🙂👩‍👩‍👧 ✅", "x y z​\u0085\u001c!", "﻿bom", "\r\n\r\n", "é̀", "12 345½²"]
    alphabet = "aeiouthsndr  \n\t.,'’-_/0123456789ÀßñЖ字か🙂 "
    texts += ["".join(r.choices(alphabet, k=r.randrange(1, 200))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x3000), r.randrange(0x4E00, 0x9FFF)])) for _ in range(40)) for _ in range(500)]
    for t in texts:
        assert enc.encode(t) == reference.encode(t, add_special_tokens=False).ids, repr(t)


def test_merges_inside_long_words(reference):
    r = random.Random(8)
    enc = bpe.encoder()
    for _ in range(1500):
        word = "".join(r.choices("etaoinshrdlucm", k=r.randrange(1, 60)))
        assert enc.encode(word) == reference.encode(word, add_special_tokens=False).ids, word


def test_frame(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, None, 0), (3, "", 0), (1, "x y", 0), (None, "z", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode(df, "doc_id", "text").collect())
    ids = lambda t: reference.encode(t).ids
    assert got == sorted([(0, ids("z")), (1, ids("Hello world")), (1, ids("x y")), (2, []), (3, [])])
    assert sorted(r.n_tokens for r in bpe.lengths(df, ["doc_id", "ids"], "text").collect()) == [0, 0, 1, 2, 2]
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
