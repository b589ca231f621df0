import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import render, score, temporal, text


def one(spark, expr, **cols):
    df = spark.range(1).select(*[(v if not isinstance(v, (str, int, float, type(None))) else F.lit(v)).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("word", "want"), [("bringing", "bring"), ("carried", "carry"), ("parties", "party"), ("yes", "yes"), ("bus", "bus"), ("settings", "sett"), ("boxes", "box"), ("9lives", "9lives"), ("using", "using")])
def test_stem(spark, word, want):
    assert one(spark, text.stem(F.col("w")), w=word) == want


def test_tokens_and_overlap(spark):
    assert sorted(one(spark, text.tokens(F.lit("Fix the parser 修复 parser")))) == sorted(["fix", "the", "parser", "修", "复"])
    assert one(spark, text.tokens(F.lit("")) ) == [] and one(spark, text.overlap(text.tokens(F.lit("")), text.tokens(F.lit("a word here")))) == 0.0
    assert one(spark, text.overlap(text.tokens(F.lit("cache parser")), text.tokens(F.lit("parser cache retry loop")))) == 1.0


def test_query_terms_keep_stop_words_if_nothing_else(spark):
    assert one(spark, text.query_terms(F.lit("the of and"))) == ["the", "of", "and"]
    assert one(spark, text.query_terms(F.lit("the cache of x 写"))) == ["cache", "写"]


@pytest.mark.parametrize(("query", "want"), [("fix the retry loop in cache.py", "task"), ("What did you suggest?", "assistant-content"), ("How many trips did I take?", "aggregation"), ("When did I move?", "temporal"), ("my favorite colour", "personal-fact"), ("colour of the sky", "default")])
def test_question_class(spark, query, want):
    assert one(spark, text.question_class(F.lit(query))) == want


def test_user_share(spark):
    share = lambda t: one(spark, text.user_share(F.lit(t)))
    assert share("no prefix at all") == 1.0 and share("") == 0.5
    assert share("[2025-01-01] (session s)\nuser: abcd\nassistant: ab\nmore") == pytest.approx(4 / 10)


def test_decay_and_activation(spark):
    log = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]) if xs else F.array().cast("array<bigint>")
    bla = lambda xs, now: one(spark, score.base_level(log(xs), F.lit(now)))
    assert one(spark, score.retrieval_strength(F.lit(0.9), F.lit(1), F.lit(10001))) == 0 and bla([], 9) == 0
    exact = lambda xs, now: 0.05 * math.log(1 + sum(max(1, now - t) ** -0.5 for t in xs))
    assert bla([1, 4, 9], 12) == pytest.approx(exact([1, 4, 9], 12))
    assert bla(list(range(64)), 64) == pytest.approx(exact(range(64), 64), rel=0.12)


def test_corroboration_and_small_functions(spark):
    blend = lambda a, b, w: one(spark, score.corroborated(F.lit(a), F.lit(b).cast("double"), F.lit(w)))
    assert blend(0.25, 0.9, 0.45) == pytest.approx(0.9 + 0.45 * 0.25) and blend(0.25, None, 0.45) == 0.25 and blend(0.25, 0.9, 0.0) == 0.25
    assert [one(spark, score.semantic_chars(F.lit(200.0), F.lit(n))) for n in (0, 2, 100)] == [200, 177, 106]
    assert one(spark, score.as_of(F.lit(-1))) == 0.6 and one(spark, score.as_of(F.lit(0))) == 1.25 and one(spark, score.as_of(F.lit(None).cast("int"))) == 1.0
    assert score.compression(0.5, 4000, 64_000, 128_000, 0.3, 0.4, 0.28)["threshold"] == pytest.approx(0.405) and score.pressure(1, 0) < 1e-4
    assert one(spark, score.persona_confidence(F.lit(3), F.lit(10), F.lit(10))) == pytest.approx(math.log(4))


def test_time_expressions(spark):
    def hit(q, day, anchor="2025-06-10"):
        return one(spark, temporal.matches(temporal.expressions(F.lit(q)), F.lit(day).cast("date"), F.lit(anchor).cast("date")))

    assert hit("what did I do last week", "2025-06-03") and not hit("what did I do last week", "2025-06-09")
    assert hit("yesterday", "2025-06-08") and hit("3 weeks ago", "2025-05-20") and not hit("room 12 and 40", "2025-06-10")
    assert hit("in May", "2024-05-05") and not hit("in may 2025", "2024-05-05") and hit("on march 3rd, 2024", "2024-03-03")
    assert hit("on 2025-01-02", "2025-01-02") and hit("at 1/2/2025", "2025-01-02") and not hit("at 1/2/2025", "2025-02-01")
    assert str(one(spark, temporal.query_anchor(F.lit("as of Jan 5, 2024, what is it")))) == "2024-01-05" and str(one(spark, temporal.query_anchor(F.lit("截至2024年3月9日")))) == "2024-03-09"
    assert one(spark, temporal.query_anchor(F.lit("nothing"))) is None and one(spark, temporal.question_date(F.lit("2025-01-01"))) is None
    assert one(spark, temporal.epoch_date(F.lit(1_700_000_000))) == one(spark, temporal.epoch_date(F.lit(1_700_000_000_000))) == "2023-11-14"
    assert one(spark, temporal.date_key(F.lit("2025/01/02 (Tue) 09:00"))) == "2025-01-02" and one(spark, temporal.record_date(F.lit("2023-02-31"))) is None


def test_truncation_and_lines(spark):
    cut = lambda t, n: one(spark, render.truncate_words(F.lit(t), n))
    assert cut("the  cat and the dog ran far", 2) == "the cat and the dog…(truncated)" and cut("the cat", 2) == "the cat" and cut("", 3) == ""
    assert one(spark, render.without_self_talk(F.lit("Hmm, actually, yes"))) == "yes"
    rows = spark.createDataFrame([("q", 1, "a" * 50), ("q", 2, "b" * 30), ("q", 3, "c" * 30)], "query_id string, pos int, line string")
    fit = lambda **kw: [len(r.line) for r in render.fit_lines(rows, **kw).orderBy("pos").collect()]
    assert fit(budget=85) == [50, 30] and fit(budget=40) == [40] and fit(budget=40, clip_first=False) == [] and fit(budget=70, clip_last=True) == [50, 20]


def test_text_helpers(spark):
    assert one(spark, text.meaning_key(F.lit(" Hello,  World! "))) == "hello world" and one(spark, text.slug(F.lit("--A b/c--"))) == "a-b-c" and one(spark, text.slug(F.lit("!"))) == "fact"
    assert one(spark, text.trace_id(F.lit(" "), F.lit("[2025-01-01] (session s-9)\nx"))) == "s-9" and one(spark, text.trace_id(F.lit(None).cast("string"), F.lit("x"))) is None
    assert one(spark, text.record_id(F.lit("a"), F.lit("b"))).startswith("mem_") and len(one(spark, text.record_id(F.lit("a")))) == 28
    assert one(spark, text.corrections(F.lit("Please do not touch it. 好的\n记住要先跑测试再提交。ok"))) == ["Please do not touch it", "记住要先跑测试再提交"]
    assert one(spark, text.facts(F.lit("I work as a baker. It takes about 3 hours."))) == ["job: a baker", "duration: 3 hours"]
    assert one(spark, text.counted_entity(F.lit("How many books have I read?"))) == "books"
    assert one(spark, text.chunks(F.lit("x" * 2500))) == ["x" * 1200, "x" * 1200, "x" * 100] and one(spark, text.chunks(F.lit(""))) == [""]
    assert [one(spark, text.note_age(F.lit(0 if m is None else 10**12 - m * 60_000), F.lit(10**12))) for m in (None, 5, 30, 120, 60 * 24 * 3, 60 * 24 * 90)] == ["", "", "updated ~30m ago", "updated ~2h ago", "updated ~3d ago", "updated >1mo ago"]
