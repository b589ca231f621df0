import numpy as np

from palimpsest.llm import vectors


def data(n=900, dim=32, seed=1):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    for i in range(0, n // 2, 5):  # families of near copies
        v[i + 1 : i + 5] = v[i] + 0.3 * r.normal(size=(4, dim)) * r.random((4, 1)) * 2
    return v.astype(np.float32)


def frame(spark, v):
    rows = [(f"k{i:04}", [float(x) for x in r], 9.0) for i, r in enumerate(v)]
    odd = [("null", None, 1.0), ("zero", [0.0] * v.shape[1], 1.0), ("nan", [float("nan")] * v.shape[1], 1.0), ("short", [1.0], 1.0), ("empty", [], 1.0), (None, [1.0] * v.shape[1], 1.0), ("inf", [float("inf")] * v.shape[1], 1.0)]
    return spark.createDataFrame(rows + odd, "key string, vec array<float>, cell double")


def test_quantile():
    assert abs(vectors.chi2_quantile(0.95, 2) - 5.991) < 1e-3 and abs(vectors.chi2_quantile(0.999, 16) - 39.252) < 1e-3


def test_pairs_and_neighbours_against_brute_force(spark):
    v = data()
    u = vectors.unit(v)
    s = u @ u.T
    index = vectors.Index(frame(spark, v), "key", "vec", v.shape[1], sample_rows=200, block_rows=150)
    assert index.n == len(v) and len(index.blocks) >= 4
    want = {(f"k{i:04}", f"k{j:04}") for i, j in zip(*np.nonzero(np.triu(s >= 0.8, 1)), strict=True)}
    got = {(r.key_a, r.key_b) for r in index.pairs(0.8).collect()}
    assert got <= want and len(got) >= 0.995 * len(want) > 500
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    near = {}
    for r in index.neighbours(5).collect():
        near.setdefault(r.key, []).append((r.place, r.neighbour))
    assert all(len(x) == 5 for x in near.values()) and len(near) == len(v)
    recall = np.mean([len({k for _, k in near[f"k{i:04}"]} & {f"k{j:04}" for j in top[i]}) / 5 for i in range(len(v))])
    assert recall >= 0.9


def test_copies_and_empty(spark):
    v = np.ones((60, 8), np.float32)
    index = vectors.Index(frame(spark, v), "key", "vec", 8, block_rows=16)
    assert index.pairs(0.88).count() == 60 * 59 // 2
    empty = vectors.Index(frame(spark, v).limit(0), "key", "vec", 8)
    assert empty.pairs(0.88).count() == 0 and empty.neighbours(3).count() == 0


def test_rows_sent_for_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """Pairs come from tables in which a row has one cell each, so a row is sent no oftener when there are four times as many."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 200)
    sent = []
    for n in (1000, 4000):
        v = data(n, seed=n)
        u = vectors.unit(v)
        index = vectors.Index(frame(spark, v), "key", "vec", v.shape[1], block_rows=100)
        seen, held = spark.sparkContext.accumulator(0), vectors.grouped

        def counted(c, *rest, held=held, seen=seen):
            seen.add(len(c))
            yield from held(c, *rest)

        monkeypatch.setattr(vectors, "grouped", counted)
        got = [(r.key_a, r.key_b) for r in index.pairs(0.88).collect()]
        monkeypatch.setattr(vectors, "grouped", held)
        want = {(f"k{i:04}", f"k{j:04}") for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.88, 1)), strict=True)}
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.998 * len(want) > 200
        sent.append(seen.value / n)
    assert 0 < sent[1] <= 1.8 * sent[0]


def test_pairs_of_cells_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    monkeypatch.setattr(vectors, "PASS_ROWS", 1)
    monkeypatch.setattr(vectors, "PASS_TABLES", 2)
    v = data(400)
    u = vectors.unit(v)
    got = [(r.key_a, r.key_b) for r in vectors.Index(frame(spark, v), "key", "vec", v.shape[1]).pairs(0.8).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    want = {(f"k{i:04}", f"k{j:04}") for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.8, 1)), strict=True)}
    assert got <= want and len(got) >= 0.998 * len(want)


def test_chance_of_a_common_cell():
    assert abs(vectors.shared_chance(1, 0.88) - (1 - np.arccos(0.88) / np.pi)) < 0.01  # one direction: the sign alone
    assert vectors.tables(0.5, 0.001) == 10
