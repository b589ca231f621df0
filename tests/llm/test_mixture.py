from pyspark.sql import functions as F

from palimpsest.llm import mixture


def test_rates_fill_and_cap():
    r = mixture.rates({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "none": (0.1, 3)}, {"a": 900, "b": 50, "c": 50})
    assert r["b"] == 2 and r["c"] == 4 and "none" not in r and abs(900 * r["a"] - 700) < 1e-9
    assert mixture.rates({"a": (1.0, 3)}, {}) == {}
    assert mixture.rates({"a": (0.5, 1), "b": (0.5, 1)}, {"a": 10, "b": 10}, total=1000) == {"a": 1.0, "b": 1.0}


def test_draw(spark):
    rows = [("hot", i, 1 + i % 50) for i in range(4000)] + [("few", i, 20) for i in range(40)] + [(None, 1, 5), ("other", 2, 5), ("hot", 9999, 0), ("few", 3, 20)]
    df = spark.createDataFrame(rows, "source string, doc_id bigint, n_tokens bigint").withColumn("rank", F.lit(1))
    out = mixture.draw(df, "doc_id", {"hot": 0.37, "few": 2.5}).cache()
    by = {r.source: r for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("copy").alias("m"), F.min("n_tokens").alias("least")).collect()}
    assert set(by) == {"hot", "few"} and by["few"].m <= 3 and by["hot"].m == 1 and by["hot"].least > 0
    assert abs(by["hot"].n - 0.37 * 4000) <= 1 and abs(by["few"].n - 2.5 * 41) <= 1
    expected = 0.37 * sum(1 + i % 50 for i in range(4000))
    assert abs(by["hot"].t - expected) < 0.005 * expected
    assert mixture.draw(df.limit(0), "doc_id", {"hot": 1.0}).count() == 0


def test_numbered_is_row_number(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("o"))
    got = sorted((r.g, r.o, r["rank"]) for r in mixture.numbered(df, "g", ["o"]).collect())
    for g in range(3):
        assert [x[2] for x in got if x[0] == g] == list(range(1, len([x for x in got if x[0] == g]) + 1))
