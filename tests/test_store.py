import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ingest, maintain, replies
from palimpsest.plans.injection import Config, Memory
from palimpsest.plans.search import Options
from palimpsest.sources import jsonl, records, sinks
from palimpsest.streaming import events


def test_jsonl_reader_skips_what_is_no_record(spark, tmp_path):
    good = {"schema": 1, "id": "mem_a", "layer": "L0", "content": "x", "turn": 3, "metadata": {"date": "2025-01-01", "other": 1}}
    (tmp_path / "scope1.L0.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"schema": 2})]))
    rows = jsonl.read_records(spark, str(tmp_path)).collect()
    assert [(r.id, r.scope, r.metadata.date) for r in rows] == [("mem_a", "scope1", "2025-01-01")]
    assert jsonl.read_lines(spark, str(tmp_path / "absent"), jsonl.ACCESS).count() == 0
    with pytest.raises(ValueError):
        jsonl.read_derived(spark, str(tmp_path), "L0")
    (tmp_path / "n.md").write_text("# note")
    (tmp_path / "blank.md").write_text("  ")
    assert [(r.id, r.content) for r in jsonl.read_notes(spark, str(tmp_path)).collect()] == [("note:n", "# note")]


def test_first_arrivals_and_keys(spark):
    df = spark.createDataFrame([(1, "a", "new", "2025-02-01"), (1, "a", "old", "2025-01-01"), (2, "a", "other", "2024-01-01"), (1, None, "x", "2025-01-01"), (1, "b", None, None)], "schema int, id string, content string, t string").withColumn("ingested_at", F.to_timestamp("t"))
    assert {(r.id, r.content) for r in records.first_arrivals(df, ["id", "content"]).collect()} == {("a", "old"), ("b", None)}
    keys = spark.createDataFrame([(" MEM_A#c3\n",), (" x　",), (" ",), (None,)], "r string").select(records.ref_key(F.col("r")).alias("k")).collect()
    assert [r.k for r in keys] == ["mem_a", "x", None, None]


def test_append_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, seq int")
    assert [sinks.append_new(df, path, ["id"], ["seq"]) for _ in range(2)] == [2, 0] and spark.read.parquet(path).count() == 2
    sinks.replace_version(df, f"file://{tmp_path}/v")
    sinks.replace_version(df.limit(1), f"file://{tmp_path}/v")
    assert sinks.current_version(spark, f"file://{tmp_path}/v").count() == 1


def test_upsert_supersedes_and_refuses(spark):
    schema = "id string, scope string, layer string, topic string, sourceRefs array<string>, seq int, supersededBy string"
    old = spark.createDataFrame([("o", "s", "L1", "t", ["e"], 1, None), ("z", "s", "L1", "u", ["e"], 1, None)], schema)
    new = spark.createDataFrame([("n", "s", "L1", "t", ["e"], 2, None), ("bad", "s", "L1", "t", ["nope"], 3, None), ("none", "s", "L1", "t", [], 4, None), ("l0", "s", "L0", "t", ["e"], 5, None)], schema)
    after, refused = sinks.upsert_derived(old, new, spark.createDataFrame([("e",)], "id string"))
    assert {(r.id, r.supersededBy) for r in after.collect()} == {("o", "n"), ("n", None), ("z", None)} and {r.id for r in refused.collect()} == {"bad", "none", "l0"}
    patched = sinks.patch(old, spark.createDataFrame([("o", "T")], "id string, topic string"), ["topic"])
    assert {(r.id, r.topic) for r in patched.collect()} == {("o", "T"), ("z", "u")}


def pack(lines, limit):
    out, buf, n = [], [], 0
    for x in lines:
        if len(x) > limit:
            out += [buf] * bool(buf) + [[x]]
            buf, n = [], 0
        else:
            if n + len(x) > limit and buf:
                out, buf, n = [*out, buf], [], 0
            buf, n = [*buf, x], n + len(x)
    return ["\n".join(b) for b in [*out, *[buf] * bool(buf)]]


def test_packing_is_the_greedy_loop(spark):
    import random

    r = random.Random(5)
    cases = [["x" * r.randrange(0, 60) for _ in range(r.randrange(0, 12))] for _ in range(200)]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>").select("i", ingest.pack(F.col("l"), 50).alias("p")).collect()
    assert all(list(x.p) == pack(cases[x.i], 50) for x in got)


def test_stitching(spark):
    m = [("s", 0, "user", "Doc A [part 1/3] aa"), ("s", 1, "user", "Doc A [part 2/3] bb"), ("s", 2, "user", "Doc A [part 3/3] cc"), ("s", 3, "user", "Doc A [part 4/3] dd"), ("s", 4, "user", "[part 1/2] x"), ("s", 5, "user", "[part 2/2] y"), ("s", 6, "user", "plain")]
    out = [r.content for r in ingest.stitch(spark.createDataFrame(m, "session string, pos int, role string, content string")).orderBy("pos").collect()]
    assert out == ["Doc A [part 1/3] aa\nDoc A [part 2/3] bb\nDoc A [part 3/3] cc", "Doc A [part 4/3] dd", "[part 1/2] x", "[part 2/2] y", "plain"]


def test_todo_file_and_error_evidence(spark):
    lines = spark.createDataFrame([("d", x) for x in ["○ #1 one", "◐ #2 two now", "✓ #3 three", "✓ #4 four - blocked by #1", "✗ #5 five", "----", "○ no number"]], "doc string, line string")
    items = ingest.todo_items(lines)
    assert {(r.num, r.subject, r.status) for r in items.collect()} == {(1, "one", "pending"), (2, "two now", "in_progress"), (3, "three", "completed"), (4, "four", "blocked"), (5, "five", "blocked")}
    assert {r.content for r in ingest.todo_facts(items, ["doc"]).collect()} == {"task completed: three", "task blocked: four", "task blocked: five"}
    a = ingest.todo_anchor(items, ["doc"]).first()
    assert (a.active, a.pending, a.completed, a.blocked) == ("two now", 1, 1, 2)
    calls = spark.createDataFrame([("s", 1, "write", '{"path": " ", "file_path": "a/b.py"}'), ("s", 2, "read", '{"path": "x"}'), ("s", 3, "edit", "{}"), ("s", 4, "edit", "no json")], "session string, turn int, tool string, args string")
    assert [r.content for r in ingest.file_operations(calls).collect()] == ["wrote a/b.py"]
    t = spark.createDataFrame([("aaaa\nbb\ncc",), ("x" * 20,), ("",)], "t string").select(ingest.error_text(F.col("t"), 7).alias("e")).collect()
    assert [r.e for r in t] == ["aaaa\nbb", "x" * 20, ""]
    seeds = spark.createDataFrame([("# c",), ("",), ("[embodied] likes rain",), ("plain",)], "line string")
    assert {(r.facet, r.seed) for r in ingest.seeds(seeds).collect()} == {("embodied", "likes rain"), ("autobiographical", "plain")}


def test_summary_merge(spark):
    cols = "k string, name string, i int, line string"
    prev = spark.createDataFrame([("a", "Goal", 1, "- one"), ("a", "Goal", 2, "- one"), ("a", "State", 3, "- old"), ("a", "Odd", 4, "- kept")], cols)
    new = spark.createDataFrame([("a", "Goal", 1, "- ONE"), ("a", "Goal", 2, "- two"), ("a", "State", 3, "- new")], cols)
    got = sorted((r.name, r.place, r.line) for r in ingest.merged_sections(prev, new, ["k"], ("Goal",), ("Goal", "State")).collect())
    assert got == [("Goal", 1, "- one"), ("Goal", 2, "- one"), ("Goal", 3, "- two"), ("Odd", 1, "- kept"), ("State", 1, "- new")]


def test_patterns_duplicates_and_goals(spark):
    facts = [(f"m{i}", "s", f"task {k}: {t}") for i, (k, t) in enumerate([("completed", "Fix it"), ("completed", "fix IT!"), ("completed", "fix it"), ("blocked", "a b"), ("blocked", "a b"), ("completed", "solo")])]
    got = {(r.subject, r.success, r.failure, r.status) for r in maintain.task_patterns(spark.createDataFrame(facts, "id string, scope string, content string")).collect()}
    assert got == {("fix it", 3, 0, "reliable"), ("a b", 0, 2, "failing")}
    rows = [("a", "s", "Hello.", 1, 0.5, None, None), ("b", "s", "hello", 2, 0.5, None, None), ("c", "s", "hello!", 2, 0.9, None, None), ("d", "t", "hello", 9, 0.9, None, None), ("e", "s", "hello", 9, 0.9, "x", None)]
    df = spark.createDataFrame(rows, "id string, scope string, content string, turn bigint, storageStrength double, supersededBy string, archived boolean")
    assert {(r.id, r.keeper) for r in maintain.duplicate_marks(df).collect()} == {("a", "c"), ("b", "c")}
    goals = spark.createDataFrame([("s", "g1", "x", 1), ("s", "g2", "x", 2), ("s", "g3", "y", 3), ("s", "g4", "x", 4)], "scope string, id string, focus string, turn bigint")
    assert [(r.id, r.supersedes, r.active) for r in maintain.goal_chain(goals).orderBy("id").collect()] == [("g1", None, False), ("g3", "g1", False), ("g4", "g3", True)]


def test_replies(spark):
    known = spark.createDataFrame([("e1",), ("e2",)], "id string")
    text = 'Sure:\n```json\n{"facts": [{"fact": " A ", "topicKey": "My Topic", "category": "LESSON", "sourceIds": ["e1"]}, {"fact": "B", "sourceIds": ["nope"]}, 7, {"fact": "C", "sourceIds": []}], "ledger": [{"entity": "Car", "state": "sold", "date": "2025", "sourceIds": ["e2"]}]}\n```'
    r = spark.createDataFrame([("r", text), ("bad", "{oops"), ("none", "no json"), ("nofacts", '{"ledger": [{"entity": "x", "state": "y", "sourceIds": ["e1"]}]}')], "reply_id string, reply string")
    assert {(x.reply_id, x.fact, x.topic, x.category) for x in replies.fact_cards(r, known).collect()} == {("r", "A", "my-topic", "lesson"), ("r", "[ledger] Car | sold | 2025", "ledger-car", "fact")}
    v = spark.createDataFrame([("v", '{"verdicts": [{"id": "a", "verdict": "Supported"}, {"id": "b", "verdict": "maybe"}], "steps": [{"id": "c", "steps": [" x ", ""]}], "reactivate": ["d", "d"]}')], "reply_id string, reply string")
    assert [(x.id, x.verdict) for x in replies.verdicts(v).collect()] == [("a", "supported")]
    assert [(x.id, list(x.steps)) for x in replies.steps(v).collect()] == [("c", ["x"])] and [x.id for x in replies.reactivations(v).collect()] == ["d"]
    rows = spark.createDataFrame([("s", "a", "one", 1), ("s", "b", "two", 2)], "scope string, id string, content string, place int")
    asked = replies.prompts(rows, "Check:")
    assert asked.first().prompt == "Check:\n- (a) one\n- (b) two"
    assert replies.complete(asked, lambda p: p.upper()).first().reply.startswith("CHECK:")
    assert replies.complete(asked, lambda p: 1 / 0).first().reply == ""


def test_config_and_facade(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert Config.read(path, {}).provider == "local" and Config.read(path, {"PALIMPSEST_PROVIDER": "nvidia"}).semantic_weight == 0.6
    Config(provider="xfyun", budget=900).write(path)
    assert Config.read(path, {}).budget == 900 and Config(pressure=0.5).settings["p0"] < 0.3
    with pytest.raises(ValueError):
        Options(policy=0)
    with pytest.raises(ValueError):
        Options(semantic_weight=2)
    m = Memory(spark, "/none")
    assert [r.line for r in m.correct("Remember to run the tests. Fine.").collect()] == ["Remember to run the tests"]
    assert m.seed("likes tea\n# no\nlikes tea").count() == 1
    assert [m.write("s", "hello", 1, f"file://{tmp_path}/w") for _ in range(2)] == [1, 0]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):  # the same rows again and again
        spark.createDataFrame([("s", "a", 1, 5), ("s", "b", 2, 6), ("t", "a", 3, 7 + k)], "scope string, id string, seq int, turn bigint").coalesce(1).write.mode("append").parquet(f"file://{src}")
    stream = lambda: spark.readStream.schema("scope string, id string, seq int, turn bigint").option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    path = events.append_once(stream(), ["scope", "id", "seq"], ["turn"], f"file://{tmp_path}/o")
    assert spark.read.parquet(path).count() == 3
    got = {r.scope: (r.turns, r.newest) for r in events.collect_updates(events.clocks(stream()), f"file://{tmp_path}/c", ["scope"], "turns").collect()}
    assert got == {"s": (6, 6), "t": (3, 9)}


def test_forty_candidates_of_a_scope(spark, monkeypatch):
    from palimpsest.plans import maintenance

    rows = [(f"m{i:02}", "s", "x", i, None, None, None, None, None, None, None) for i in range(45)]
    store = spark.createDataFrame(rows, "id string, scope string, content string, turn bigint, accessLog array<bigint>, category string, supersededBy string, archived boolean, origin string, consolidated array<string>, sourceRefs array<string>")
    monkeypatch.setattr(maintenance, "store", lambda *_: store)
    monkeypatch.setattr(maintenance, "_folded", lambda *_: spark.createDataFrame([], "id string, extra array<bigint>"))
    got = maintenance.consolidation_candidates(spark, "").collect()
    assert {(r.place, r.id) for r in got} == {(k, f"m{45 - k:02}") for k in range(1, 41)}


def test_written_records_and_notes_come_back(spark, tmp_path):
    from palimpsest.sources import jsonl, sinks

    df = spark.createDataFrame([(1, "a", None, "L0", "x\ny", 1), (1, "b", "s", "L1", None, None), (2, "c", "s", "L1", "old", 3)], "schema int, id string, scope string, layer string, content string, turn bigint")
    path = f"file://{tmp_path}/store"
    jsonl.write_records(df, path)
    (tmp_path / "store" / "layer=L0" / "bad.json").write_text("{ not json\n\n")
    assert {(r.id, r.scope, r.layer, r.content) for r in jsonl.read_written(spark, path).collect()} == {("a", None, "L0", "x\ny"), ("b", "s", "L1", None)}
    assert [r.id for r in jsonl.read_written(spark, path, "L1").collect()] == ["b"] and jsonl.read_written(spark, f"file://{tmp_path}/none").count() == 0
    lines = spark.createDataFrame([("My Notes", "one", "1"), ("My Notes", "two", "2"), ("b", "three", "1")], "category string, line string, seq string")
    for _ in range(2):  # a task that runs again writes the same
        assert sinks.write_notes(sinks.note_lines(lines), f"file://{tmp_path}/notes") == 2
    got = {r.id: r.content for r in jsonl.read_notes(spark, f"file://{tmp_path}/notes").collect()}
    assert got == {"note:my-notes": "# My Notes\n- one\n- two\n", "note:b": "# b\n- three\n"}
    assert sinks.write_notes(sinks.note_lines(lines.limit(0)), f"file://{tmp_path}/empty") == 0


def test_response_text(spark):
    from palimpsest.operators import replies

    said = ['{"content":"plain"}', '{"content":[{"type":"text","text":"a"},{"type":"tool","text":"x"},{"type":"text"},{"type":"text","text":"b"}]}', '{"content":[]}', "{}", "no json", None]
    df = spark.createDataFrame([(x,) for x in said], "r string")
    assert [x.t for x in df.select(replies.response_text(df.r).alias("t")).collect()] == ["plain", "a\nb", "", "", "", ""]
    with pytest.raises(Exception, match="completion failed: quota"):
        spark.createDataFrame([('{"stopReason":"error","errorMessage":"quota"}',)], "r string").select(replies.response_text(F.col("r"))).collect()


def test_session_sample_and_xml_facts(spark):
    from palimpsest.functions import render
    from palimpsest.operators import rank

    rows = spark.createDataFrame([("s", f"r{i:03}", i, None if i % 2 else f"x{i // 8}") for i in range(40)], "scope string, id string, turn bigint, session string")
    got = [r.id for r in rank.session_sample(rows, ["scope"], "session", ["turn"], most=7).orderBy("number").collect()]
    assert got == ["r000", "r001", "r002", "r003", "r004", "r005", "r008"]
    assert rank.session_sample(rows.limit(0), ["scope"], "session", ["turn"]).count() == 0
    facts = [("q", "a", 1, "L0", None, "user: First. Second.", "2025-01-02 10:00"), ("q", "b", 2, "L1", ["persona"], "Likes tea a lot", None), ("q", "c", 3, "L1", [], "Knows it all! Yes", ""), ("q", "d", 4, "L0", None, "no", None), ("q", "e", 5, "L0", None, None, None)]
    df = spark.createDataFrame(facts, "query_id string, id string, pos int, layer string, tags array<string>, content string, date string")
    out = render.xml_facts(df, ["query_id"], "pos").orderBy("number").collect()
    assert [(r.id, r.category, r.line) for r in out] == [("c", "semantic", "    -Knows it all"), ("a", "episodic", "    -[2025-01-02] First"), ("b", "core", "    -Likes tea a lot")]
    assert [r.id for r in render.xml_facts(df, ["query_id"], "pos", 70).collect()] == ["c"]
