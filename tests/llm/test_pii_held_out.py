"""Texts that share no template with the training table, and the table against the texts it is applied to."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from palimpsest.llm import labelled, pii

HERE = os.path.dirname(__file__)
LEXICON = [("Greta", "given"), ("Timo", "given"), ("Mark", "given"), ("Harrow", "family"), ("Kettelrup", "family"), ("沈", "family")]


def cases():
    for line in open(os.path.join(HERE, "pii_contexts.txt"), encoding="utf-8"):
        if line[0] != "#":
            text, spans, at = "", [], 0
            for m in re.finditer(r"\{(\w+)\|([^}]*)\}", line.rstrip("\n")):
                text += line[at : m.start()]
                spans.append((m[1], pii.value(m[2])))
                text += m[2]
                at = m.end()
            yield text + line.rstrip("\n")[at:], set(spans)


def test_contexts_never_seen():
    got = list(cases())
    assert len(got) >= 200
    found = pii.learn(LEXICON).decode([t for t, _ in got])
    right, want, have, wrong = Counter(), Counter(), Counter(), []
    for (text, spans), f in zip(got, found, strict=True):
        mine = {(k, pii.value(text[a:b])) for a, b, k in f}
        for kind in pii.KINDS:
            w, h = {x for x in spans if x[0] == kind}, {x for x in mine if x[0] == kind}
            right[kind] += len(w & h)
            want[kind] += len(w)
            have[kind] += len(h)
        if mine != spans:
            wrong.append((text, sorted(spans - mine), sorted(mine - spans)))
    figures = {k: (round(right[k] / want[k], 2), round(right[k] / max(1, have[k]), 2)) for k in pii.KINDS}
    least = {"email": 0.95, "phone": 0.88, "id_number": 0.85, "address": 0.9, "name": 0.82}
    assert all(min(figures[k]) >= x for k, x in least.items()), (figures, wrong)
    assert right.total() / want.total() >= 0.9 and right.total() / have.total() >= 0.9, (figures, wrong)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_no_sentence_of_a_test_table_is_in_the_training_table():
    """No opening with its ending, nor any plain sentence, makes a sentence of a test table, whatever fills the slot."""
    texts = []
    for p in glob.glob("/root/testdata/sf0.01/*.parquet"):
        name = os.path.basename(p)[:-8]
        if name in ("memory_record", "note_record", "documents"):
            texts += [x for (x,) in duckdb.sql(f"select {'text' if name == 'documents' else 'content'} from '{p}'").fetchall() if x]
    whole = "\n".join(texts)
    for group, frames in labelled.FRAMES.items():
        for openings, endings, _ in frames:
            ends = [e for e in endings.split("|") if len(e) > 6]
            for o in openings.split("|"):
                if len(o) > 6 and ends:
                    hit = re.search(re.escape(o) + r"[^\n.!?。！？]{3,60}?(?:" + "|".join(map(re.escape, ends)) + ")", whole)
                    assert not hit, (group, o, hit and hit[0])
    assert not [p for p in labelled.PLAIN if len(p.split()) > 3 and p in whole]
