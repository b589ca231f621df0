import pytest

from palimpsest.llm import labelled, pii

LEXICON = [("Greta", "given"), ("Timo", "given"), ("Mark", "given"), ("Harrow", "family"), ("Kettelrup", "family"), ("沈", "family")]


@pytest.fixture(scope="module")
def field():
    return pii.learn(LEXICON)


def test_held_out_fillers(field):
    table = labelled.table(0.2, seed=99)
    found = field.decode([t for t, *_ in table])
    want = {(i, k, pii.value(t[a:b])) for i, (t, s, _) in enumerate(table) for a, b, k in s}
    got = {(i, k, pii.value(table[i][0][a:b])) for i, f in enumerate(found) for a, b, k in f}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.93


def test_finds_lie_in_regions(field):
    """What the labelled table holds is never outside of the parts that are scored, but for what the lexicon would tell."""
    spans = [(t, a, b, k) for t, s, _ in labelled.table(0.3, seed=7) for a, b, k in s]
    inside = [any(x <= a and b <= y for x, y in field.lexicon.regions(t)) for t, a, b, k in spans if not (k == "name" and (t[a:b].islower() or t[a] > "\u2e80"))]
    assert sum(inside) / len(inside) > 0.985


def test_windows_give_the_same_scores_as_whole_lines(field):
    """A region's scores are those of the whole line, and so is the best path, as it falls apart at labels that are none."""
    text = "Nobody reads this part of the line at all, it only has to be long enough to be cut away before " + "Tell Greta Kettelrup that the fence is done, and text +44 20 7946 0321 after lunch, or come to 48 Orchard Rise at nine."
    parts = pii.windows(text, field.lexicon)
    assert parts and sum(len(w) for _, w, _ in parts) < len(text)
    whole = pii.tokens(text)
    free = [(at + a, at + b) for at, _, own in parts for a, b in own]
    flat, size = field.scores([text], [whole], [pii.is_free(whole[1], free)])
    path = pii.viterbi(flat, size, field.trans)[0]
    assert [(a, b, k) for a, b, k in pii.spans_of(text, whole, path, field.lexicon)] == field.decode([text])[0] != []


def test_known_finds(field):
    text = "user: The cake is for Greta Kettelrup.\nMy mobile is +44 20 7946 0321 now. Team Harrow moved 14 records.\n手机 07700 900892 ，随时。"
    got = [(k, text[a:b]) for a, b, k in field.decode([text])[0]]
    assert got == [("name", "Greta Kettelrup"), ("phone", "+44 20 7946 0321"), ("phone", "07700 900892")]
    assert pii.replace("call Timo now", [(5, 9, "name")]) == "call [NAME] now"


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    k = len(pii.LABELS)
    trans = r.normal(size=(k + 1, k)).astype(np.float32)
    size = np.array([3, 1, 2])
    flat = r.normal(size=(6, k)).astype(np.float32)
    at = 0
    for path, n in zip(pii.viterbi(flat, size, trans), size, strict=True):
        x = flat[at : at + n]
        score = lambda p, x=x: trans[k, p[0]] + x[0, p[0]] + sum(trans[p[i - 1], p[i]] + x[i, p[i]] for i in range(1, len(p)))
        assert tuple(path) == max(itertools.product(range(k), repeat=int(n)), key=score)
        at += n


def test_edges(field):
    long = "Nothing to see here in row 5. " * 3000 + "My mobile is +44 20 7946 0321 now. " + "word" * 9000
    assert field.decode([None or "", " \n ", "\n\n", long])[:3] == [[], [], []]
    assert [long[a:b] for a, b, _ in field.decode([long])[0]] == ["+44 20 7946 0321"]
    assert pii.settle("see Dr. Greta Kettelrup.", 4, 24, "name", field.lexicon) == (8, 23) and pii.settle("12", 0, 2, "phone", field.lexicon) is None


def test_frame(spark, field):
    df = spark.createDataFrame([("a", "My mobile is 07700 900123 now.", 1), ("b", None, 2), ("c", "", 3), (None, "Her mail: x.y@example.org again.", 4), ("a", "Nothing.", 5)], "id string, content string, kind int")
    got = {(r.id, r.kind, r.value) for r in pii.find(df, "id", "content", field).collect()}
    assert got == {("a", "phone", "07700900123"), (None, "email", "xyexampleorg")}
    texts = {(r.id, r.text, r.n_finds) for r in pii.redact(df, "id", "content", field).collect()}
    assert texts == {("a", "My mobile is [PHONE] now.", 1), ("c", "", 0), (None, "Her mail: [EMAIL] again.", 1), ("a", "Nothing.", 0)}
    assert pii.find(df.limit(0), "id", "content", field).count() == 0


def test_finds_across_a_cut_of_a_long_line(field):
    for shift in range(0, 64, 3):  # the parts of the line end at other places of the name and of the number
        filler = ("the reports were filed and " * 2000)[: 19_960 + shift - 20]
        text = filler + " then we met Greta Kettelrup whose mobile is +44 20 7946 0321 these weeks " + filler
        got = {(k, pii.value(text[a:b])) for a, b, k in field.decode([text])[0]}
        assert got == {("name", "gretakettelrup"), ("phone", "442079460321")}
    parts = list(pii._lines("x" * 50_000 + "\n\nlast"))
    assert [(first, end) for *_, first, end in parts] == [(0, 19_700), (19_700, 39_100), (39_100, 50_000), (50_002, 50_006)]
    assert all(a <= first and end <= a + len(line) for a, line, first, end in parts)
