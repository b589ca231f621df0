import random

from palimpsest.operators import hierarchy, orphans


def brute(links):
    up = dict(links)
    out = {}
    for n in set(up) | set(up.values()):
        seen, at = [n], n
        while at in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        if at in up:  # runs into a loop
            loop = seen[seen.index(up[at]) :]
            out[n] = (min(loop), -1, None)
        else:
            out[n] = (at, len(seen) - 1, tuple(reversed(seen)))
    return out


def solved(spark, links, **kw):
    df = spark.createDataFrame(links, "node string, parent string")
    return {r.node: (r.root, r.depth, tuple(r.path) if r.path else None) for r in hierarchy.resolve(df, **kw).collect()}


def test_forest_with_loops_at_several_levels(spark):
    rnd = random.Random(5)
    links = [(f"n{i}", f"n{rnd.randrange(max(0, i - 6), i)}") for i in range(1, 260) if rnd.random() > 0.05]
    links += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("self", "self"), ("below", "self")]
    links += [(f"leaf{i}", "n7") for i in range(40)]
    assert solved(spark, links, leaf_rows=40) == brute(links)
    assert solved(spark, links) == brute(links)


def test_chain_and_empty_and_nulls(spark):
    chain = [(f"k{i:03}", f"k{i - 1:03}") for i in range(1, 120)]
    assert solved(spark, [*chain, (None, "k000"), ("x", None)], leaf_rows=30) == brute(chain)
    assert solved(spark, []) == {}
    pairs = hierarchy.descendants(hierarchy.resolve(spark.createDataFrame(chain[:5], "node string, parent string"))).collect()
    assert len(pairs) == 15 and {(r.ancestor, r.descendant, r.distance) for r in pairs} >= {("k000", "k005", 5), ("k004", "k005", 1)}


def test_orphans(spark):
    children = spark.createDataFrame([("f", "a", "2025-01", "x"), ("f", "a", "2025-03", "x"), ("f", "b", "2025-01", "x"), ("f", "b", "2025-01", "x"), ("f", None, "2025-01", "x"), ("g", "a", "2025-01", "x"), ("g", "c", None, "x")], "field string, key string, period string, since string")
    parents = spark.createDataFrame([("f", "a", "2025-02", None, False), ("f", "a", "2025-03", None, False), ("g", "a", None, "2026-01", True)], "field string, key string, since string, gone string, ever boolean")
    got = {(r.field, r.key, r.period, r.n, r.reason) for r in orphans.orphan_keys(children, parents).collect()}
    assert got == {("f", "a", "2025-01", 1, "late"), ("f", "b", "2025-01", 2, "missing"), ("g", "a", "2025-01", 1, "deleted"), ("g", "c", None, 1, "missing")}
    assert orphans.orphan_keys(children.limit(0), parents).count() == 0


def test_spellings_of_an_id_are_nodes_of_their_own(spark, tmp_path):
    from palimpsest.plans import integrity

    rows = [("A", "root"), ("a", None), ("a#c1", "ROOT "), ("root", None), ("x", "a"), ("y", " a"), ("z", "A#c7"), ("lone", "nowhere")]
    at = "timestamp'2025-01-01'"
    spark.createDataFrame(rows, "id string, ref string").selectExpr("1 schema", "id", "ref supersededBy", f"{at} ingested_at").write.parquet(f"{tmp_path}/memory_record.parquet")
    spark.createDataFrame([("a", "x"), ("n", "A")], "id string, ref string").selectExpr("1 schema", "id", "ref supersedes", f"{at} ingested_at").write.parquet(f"{tmp_path}/note_record.parquet")
    got = sorted((r.id, r.root_id, r.depth) for r in integrity.p3_found(spark, str(tmp_path)).collect())
    records = [("A", "root", 1), ("a#c1", "root", 1), ("root", "root", 0), ("x", "a", 1), ("a", "a", 0), ("y", "root", 2), ("z", "root", 2)]
    assert got == sorted([*records, ("n", "a", 1), ("a", "a", 0)])


def test_a_very_long_chain_in_one_task_without_paths():
    import pandas as pd

    n = 200_000
    names = [f"k{i:06}" for i in range(n + 1)]
    out = hierarchy.contract(pd.DataFrame({"node": names[1:], "exit": names[:-1], "hops": 1, "least": names[1:], "frag": [None] * n, "looped": False}))
    assert (out["exit"] == names[0]).all() and out["hops"].tolist() == list(range(1, n + 1)) and not out["looped"].any()


def test_without_paths_the_rest_is_the_same(spark):
    links = [(f"k{i:04}", f"k{i - 1:04}") for i in range(1, 1500)] + [("a", "b"), ("b", "a"), ("c", "a")]
    df = spark.createDataFrame(links, "node string, parent string")
    got = {r.node: (r.root, r.depth, r.path) for r in hierarchy.resolve(df, leaf_rows=400, paths=False).collect()}
    assert got == {k: (root, depth, None) for k, (root, depth, _) in brute(links).items()}
