import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.operators import graph, lexical, rank, recall


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_levels(spark):
    rows = [("q", i) for i in range(1, 11)] + [("one", 1)]
    got = {}
    for r in rank.fidelity(frame(spark, rows, "query_id string, pos int")).collect():
        got.setdefault(r.query_id, []).append(r.level)
    assert sorted(got["q"]) == ["anchor"] * 3 + ["full"] * 3 + ["summary"] * 4 and got["one"] == ["full"]


def test_budget_prefix_is_the_loop(spark):
    r = random.Random(4)
    rows, want = [], set()
    for q in range(20):
        total, done = 0, False
        for pos in range(1, 15):
            n = r.randrange(1, 60)
            rows.append((f"q{q}", pos, f"id{pos}", "x" * n))
            if not done and pos <= 8 and (total + n <= 100 or pos == 1):
                total += n
                want.add((f"q{q}", pos))
            else:
                done = True
    out = rank.budget_prefix(frame(spark, rows, "query_id string, pos int, id string, content string"), F.lit(100), 8)
    assert {(x.query_id, x.pos) for x in out.collect()} == want


def test_diversity_is_the_greedy_choice(spark):
    r = random.Random(6)
    rows = [("q", f"d{i:02}", round(r.random(), 1), f"t{r.randrange(5)}") for i in range(30)]
    df = rank.placed(frame(spark, rows, "query_id string, id string, score double, trace string"))
    got = [x.id for x in rank.diverse(df, 0.3).orderBy("diverse_pos").collect()]
    left = sorted(rows, key=lambda x: (-x[2], x[1]))
    seen, want = set(), []
    while left:
        best = max(left, key=lambda x: (round(x[2] * (1.3 if x[3] not in seen else 1), 9), -left.index(x)))
        left.remove(best)
        seen.add(best[3])
        want.append(best[1])
    assert got == want


def test_per_trace_and_access(spark):
    df = frame(spark, [("q", i, t) for i, t in enumerate(["a", "a", "b", None, None, "a"], 1)], "query_id string, pos int, trace string")
    assert sorted(r.pos for r in rank.per_trace(df, 1).collect()) == [1, 3, 4, 5]
    log = frame(spark, [("a", 2, 20), ("a", 1, 10), ("a", 2, 20), (None, 1, 1), ("b", 5, None)], "id string, seq bigint, turn bigint")
    assert [(r.id, list(r.extra)) for r in rank.fold_access(log).collect()] == [("a", [10, 20])]
    rec = frame(spark, [("a", 5, [1], 0.5, 0.1), ("z", 5, None, 0.98, 0.1)], "id string, turn bigint, accessLog array<bigint>, storageStrength double, retrievalStrength double")
    out = {r.id: r for r in rank.with_access(rec, rank.fold_access(log), F.lit(30)).collect()}
    assert list(out["a"].log) == [1, 10, 20] and abs(out["a"].ss - 0.6) < 1e-9 and abs(out["a"].rs - 0.88) < 1e-9 and out["z"].ss == 0.98


def test_bm25_rules(spark):
    docs = [("q", "cache retry parser", "a", "portfolio of the cache"), ("q", "cache retry parser", "b", "retry the parser retry"), ("q", "cache retry parser", "c", "nothing"), ("q2", "port", "a", "portfolio of the cache"), ("q2", "port", "b", None)]
    got = {(r.query_id, r.id) for r in recall.bm25(frame(spark, docs, "query_id string, query string, id string, content string")).collect()}
    assert got == {("q", "b"), ("q2", "a")}


def test_lexical_inverted_index(spark):
    q = frame(spark, [("q", "Parsing the cache"), ("none", "zzz")], "query_id string, query string")
    r = frame(spark, [("a", "cached parser"), ("b", "the cache"), ("c", "other"), ("d", None)], "id string, content string")
    assert [(x.query_id, x.id, x.shared, x.overlap) for x in recall.lexical_top(q, r, 5).orderBy("pos").collect()] == [("q", "b", 2, 1.0)]


def test_lexical_search_makes_no_row_for_each_pair(spark):
    r = random.Random(3)
    text = lambda: " ".join(f"word{min(60, int(r.paretovariate(0.7)))}x" for _ in range(r.randrange(1, 12)))
    queries, records = [(f"q{i}", text()) for i in range(60)], [(f"r{i:03}", text()) for i in range(300)]
    q, d = frame(spark, queries, "query_id string, query string"), frame(spark, records, "id string, content string")
    top = recall.lexical_top(q, d, 4)
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()
    want = set()
    for name, ask in queries:
        a, met = set(ask.split()), []
        for id_, content in records:
            b = set(content.split())
            if n := len(a & b):
                met.append((-round(n / min(len(a), len(b)) * (0.5 if n == 1 else 1), 9), -n, id_))
        want |= {(name, id_, -n, pos) for pos, (_, n, id_) in enumerate(sorted(met)[:4], 1)}
    assert {(x.query_id, x.id, x.shared, x.pos) for x in top.collect()} == want


def test_common_tokens_as_sets_change_nothing():
    r = random.Random(5)
    some = lambda n: [sorted({f"t{int(r.paretovariate(0.6))}" for _ in range(r.randrange(9))}) for _ in range(n)]
    q, d = some(40), some(200)
    lists = [pa.array(x, pa.list_(pa.string())) for x in (q, d)]
    sizes = [np.array([len(t) for t in x]) for x in (q, d)]
    run = lambda common: sorted(z for got in lexical.best(lists[0], sizes[0], lists[1], sizes[1], 5, common) for z in zip(*(x.tolist() for x in got), strict=True))
    assert run(0) == run(1) == run(8) == run(256) == run(None) and len(run(0)) > 150


def test_injection_writes_texts_once_and_all_lines_that_fit(spark, monkeypatch):
    from palimpsest.functions import render
    from palimpsest.functions import vocabulary as V
    from palimpsest.plans import injection, search

    data, wide, cut = "/root/testdata/sf0.001", [], injection.cut
    monkeypatch.setattr(injection, "cut", lambda df: (wide.extend([df.columns] if "content" in df.columns else []), cut(df))[1])
    got = {(r.query_id, r.section, r.pos): r.line for r in injection.injection(spark, data).collect()}
    assert len(wide) == 1 and not {"query", "exprs", "options", "log", "extra"} & set(wide[0])
    ranked = rank.fidelity(rank.placed(rank.scored(search.pool(spark, data).where(~F.col("archived")), V.WEIGHTS_CONTEXT)))
    age = F.when((F.col("layer") == "L0") & (F.col("turn") > 0), F.col("now") - F.col("turn")).otherwise(F.lit(0))
    rows = ranked.where((F.round("score", 9) >= V.ACTIVATION) | (F.col("storageStrength") >= V.PINNED)).select("query_id", "pos", render.evidence_line(F.col("content"), F.col("level"), F.col("id"), age).alias("line")).orderBy("query_id", "pos").collect()
    want, used = {}, {}
    for r in rows:
        used[r.query_id] = used.get(r.query_id, sum(len(x) + 1 for (q, section, _), x in got.items() if q == r.query_id and section != 4)) + len(r.line)
        if used[r.query_id] <= injection.BUDGET or r.pos == 1:
            want[r.query_id, 4, r.pos] = r.line
    assert {k: v for k, v in got.items() if k[1] == 4} == want and len(want) < len(rows)


def test_a_pool_sends_its_texts_once_after_the_records_are_read(spark):
    from palimpsest.plans import search

    plan = search.pool(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftOuter")  # accesses join the records, before these go to their queries


def test_timeline_cap_and_contrast(spark):
    rows = [("q", i + 1, f"text {i}", i, f"2025-01-{i + 1:02}") for i in range(20)] + [("single", 1, "x", 1, None)]
    t = recall.timeline(frame(spark, rows, "query_id string, pos int, content string, turn bigint, date_key string")).collect()
    assert sorted(r["at"] for r in t) == [f"2025-01-{d:02}" for d in [*range(1, 9), *range(14, 21)]]
    pairs = frame(spark, [("q", 1, "a", "deploy service alpha today"), ("q", 2, "b", "deploy service beta today"), ("q", 3, "c", "unrelated words entirely")], "query_id string, pos int, id string, content string")
    assert [(r.id_a, r.id_b, r.only_a, r.only_b) for r in recall.contrasts(pairs).collect()] == [("a", "b", "alpha", "beta")]


def test_counting_and_disclosures(spark):
    rows = [("q", 1, "How many books have I read?", "user: I finished Dune last night. More"), ("q", 2, "How many books have I read?", "user: By the way I read Emma too. Is it so?"), ("q", 3, "How many books have I read?", "as an AI model I can")]
    df = frame(spark, rows, "query_id string, pos int, query string, content string")
    assert [(r.number, r.fact) for r in recall.counting_aid(df).orderBy("number").collect()] == [(1, "I finished Dune last night"), (2, "By the way I read Emma too")]
    assert [r.sentence for r in recall.disclosures(df).collect()] == ["By the way I read Emma too."]


def pool(spark, rows):
    return frame(spark, rows, "part string, id string, turn bigint, layer string, kind string, taskref string, path string, paths array<string>, sourceRefs array<string>, supersededBy string")


def test_graph_pairs_and_hubs_agree(spark):
    rows = [("p", f"m{i}", i, "L1", "semantic", "task" if i < 6 else None, f"f{i % 3}", None, [f"s{i % 4}"], None) for i in range(12)]
    p = pool(spark, rows)
    seeds = frame(spark, [("p", "m1", 1.0), ("p", "m8", 0.5)], "part string, id string, energy double")
    run = lambda bound: {r.id: round(r.energy, 9) for r in graph.spread(*graph.edges(p, "part", bound), seeds, "part").collect()}
    assert run(500) == run(1) and len(run(1)) == 4


def test_graph_energy(spark):
    rows = [("p", "a", 1, "L0", "episodic", None, None, None, None, None), ("p", "b", 2, "L0", "episodic", None, None, None, None, "a"), ("p", "c", 3, "L1", "semantic", None, None, None, None, None)]
    pairs, hubs = graph.edges(pool(spark, rows), "part")
    assert {(r.src, r.dst, r.kind) for r in pairs.collect()} == {("a", "b", "supersede"), ("a", "b", "adjacent")}
    seeds = frame(spark, [("p", "a", 1.0)], "part string, id string, energy double")
    assert [(r.id, round(r.energy, 6)) for r in graph.spread(pairs, hubs, seeds, "part").collect()] == [("b", round(0.5 * 1.3, 6))]


def test_edges_of_a_group_above_the_bound(spark, monkeypatch):
    from palimpsest.plans import maintenance

    n = 2 * graph.BOUND + 1
    rows = [("p", f"m{i:04}", i, "L1", "semantic", "task", None, None, ["s"] if i < 3 else None, None) for i in range(n)]
    monkeypatch.setattr(maintenance, "store", lambda *_: pool(spark, rows).withColumnRenamed("part", "scope"))
    got = maintenance.graph_edges(spark, "").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src", "dst").alias("d"), F.count_if(F.col("src") < F.col("dst")).alias("up")).collect()
    assert {(r.kind, r.n, r.d, r.up) for r in got} == {("task", *[n * (n - 1) // 2] * 3), ("source", 3, 3, 3)}


def test_hubs_tie_records_with_several_common_keys_once(spark):
    r = random.Random(8)
    sources = lambda i: [f"s{k}" for k in range(3) if (i + k) % 2 or i < 3] + [f"t{i // 2}"]
    rows = [("p", f"m{i:02}", i, "L1", "semantic", None, f"f{i % 5}", r.sample(["f0", "f1", "f2", "g"], 2), sources(i), None) for i in range(14)]
    p = pool(spark, rows)
    seeds = frame(spark, [("p", "m01", 0.2), ("p", "m08", 0.1)], "part string, id string, energy double")
    run = lambda bound: {(x.id, round(x.energy, 9), x.place) for x in graph.spread(*graph.edges(p, "part", bound), seeds, "part").collect()}
    want = run(500)
    assert len(want) == 4 and run(1) == run(2) == run(4) == want == run(None)


def test_only_evidence_is_suppressed_at_any_place(spark):
    rows = [("q", k, f"far{k}", "L0", f"s{k}", [1.0, 0.0]) for k in range(1, 41)]
    rows += [("q", 41, "kept", "L0", "s", [1.0, 0.0]), ("q", 42, "card", "L1", "s", [1.0, 0.0]), ("q", 43, "repeat", "L0", "s", [2.0, 0.1]), ("q", 44, "other", "L0", "s", [0.0, 1.0]), ("q", 45, "more", "L2", "s", [0.0, 1.0]), ("q", 46, "none", "L0", "s", None)]
    got = recall.suppressed(frame(spark, rows, "query_id string, pos int, id string, layer string, trace string, vec array<double>")).orderBy("pos").collect()
    assert [r.id for r in got] == [*(f"far{k}" for k in range(1, 41)), "kept", "card", "other", "more", "none"]
