import random
from itertools import combinations

from pyspark.sql import functions as F

from palimpsest.llm import neardup


def corpus():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    docs = {}
    for f in range(60):
        base = r.choices(vocab, k=r.randrange(20, 90))
        docs[f"d{f:03}"] = " ".join(base)
        for k in range(r.randrange(4)):
            w = list(base)
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs[f"d{f:03}-{k}"] = " ".join(w)
    for i in range(30):
        docs[f"copy{i:02}"] = "the same text, copied many times over and over again by all of them"
        docs[f"boiler{i:02}"] = f"the same start of all these texts here then {r.random()} {r.random()} {r.choices(vocab, k=30)}"
    docs |= {"empty": "", "short": "two words", "null": None, "zh": "日本語のテキスト中文测试一二三四五六七八九十"}
    return docs


def brute(docs, least, similarity, width):
    sets = {}
    for k, t in docs.items():
        w = neardup.words(t or "")
        if t is not None and len(w) >= max(least, width):
            sets[k] = set(zip(*[w[i:] for i in range(width)], strict=False))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}, sets


def test_pairs_groups_and_blocks(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()] + [(None, "x y z " * 20, 0)], "id string, content string, run int")
    want, sets = brute(docs, 12, 0.6, 3)
    for rows in (4, neardup.SHARD_ROWS):
        members, pairs = neardup.links(df, "id", "content", 0.6, 3, 12, shard_rows=rows)
        got = [(r.id_a, r.id_b) for r in neardup.expand(members, pairs).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    out = {r.id: (r.group_id, r.n_links) for r in neardup.groups(members, pairs).collect()}
    assert set(out) == set(sets) and len(want) > 500
    assert all(out[k][1] == sum(k in p for p in want) for k in out)
    assert all(out[a][0] == out[b][0] for a, b in want) and out["copy07"] == ("copy00", 29)
    members, pairs = neardup.links(df.limit(0), "id", "content")
    assert neardup.expand(members, pairs).count() == 0 and neardup.groups(members, pairs).count() == 0


def test_large_shards_split_by_further_runs_lose_no_pair(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    want, _ = brute(docs, 12, 0.6, 3)
    monkeypatch.setattr(neardup, "SPLIT", 1)
    monkeypatch.setattr(neardup, "COPIES", 4)
    for rows in (2, 5):
        got = [(r.id_a, r.id_b) for r in neardup.expand(*neardup.links(df, "id", "content", 0.6, 3, 12, shard_rows=rows)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_run_of_all_records_costs_rows_in_proportion(spark, monkeypatch):
    """Records that share one footer and nothing else: splitting sends no more rows for each when there are more."""
    monkeypatch.setattr(neardup, "SPLIT", 1)
    r = random.Random(3)
    rows = []
    for n in (100, 400):
        texts = [(f"d{i}", " ".join(f"u{r.random()}" for _ in range(4)) + " one footer that stands under every single text of this large store") for i in range(n)]
        df = spark.createDataFrame(texts, "id string, content string")
        sets = neardup._sets(df, 3, 0).select("runs", "print", F.monotonically_increasing_id().alias("rid"))
        rows.append(neardup._shards(sets, 0.9, 20).count() / n)
    assert rows[1] <= 2 * rows[0] + 1


def test_tree_finds_what_a_scan_finds():
    r = random.Random(4)
    tree, all_ = neardup.BKTree(), []
    for i in range(500):
        x = r.getrandbits(16)
        tree.add(x, i)
        all_.append(x)
    for radius in (0, 2, 5):
        q = r.getrandbits(16)
        assert sorted(tree.near(q, radius)) == [i for i, x in enumerate(all_) if (x ^ q).bit_count() <= radius]
    tree.visited = 0
    tree.near(all_[7], 1)
    assert tree.visited < 250  # edges outside of the radius are not followed


def test_prints_of_a_batch_are_those_of_each_text():
    r = random.Random(5)
    import numpy as np

    texts = [[r.getrandbits(64) for _ in range(n)] for n in (3, 40, 5000, 7, 3)]
    texts.append(texts[1])
    flat, sizes = np.array([x for t in texts for x in t], np.uint64), np.array([len(t) for t in texts])
    runs, n = neardup.shingles(flat, sizes, 3)
    prints, at = neardup.fingerprints(runs, n), 0
    for t, k, print_ in zip(texts, n, prints, strict=True):
        own, m = neardup.shingles(np.array(t, np.uint64), np.array([len(t)]), 3)
        assert (own == runs[at : at + k]).all() and m[0] == k and neardup.fingerprints(own, m) == [print_]
        at += k
    assert prints[1] == prints[5] and neardup.shingles(np.zeros(0, np.uint64), np.zeros(0, int), 3)[0].size == 0


def test_slices_lose_no_pair(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "id string, content string")
    want, _ = brute(docs, 12, 0.6, 3)
    for name, value in (("SLICE_ROWS", 60), ("SLICES", 3), ("PAIR_ROWS", 40), ("SAMPLE_ROWS", 50)):
        monkeypatch.setattr(neardup, name, value)
    got = [(r.id_a, r.id_b) for r in neardup.expand(*neardup.links(df, "id", "content", 0.6, 3, 12)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_whole_sets_are_not_kept(spark, monkeypatch):
    """No table that is written or sent between stages has a text's whole set of runs: only its rarest runs."""
    kept, held = [], neardup.cut

    def cut(df):
        done = held(df)
        kept.append((done.columns, max((r.n or 0 for r in done.select(F.max(F.size("runs")).alias("n")).collect()), default=0) if "runs" in done.columns else 0))
        return done

    monkeypatch.setattr(neardup, "cut", cut)
    r = random.Random(6)
    df = spark.createDataFrame([(f"d{i}", " ".join(f"u{r.random()}" for _ in range(300))) for i in range(5)], "id string, content string")
    neardup.links(df, "id", "content", 0.6, 3, 12)
    assert any("runs" in c for c, _ in kept) and max(n for _, n in kept) <= 0.4 * 298 * 2.1 + neardup.MOST_RUNS < 298
