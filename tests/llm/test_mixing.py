import hashlib
import re

import pytest

from tabsight.llm.mixing import mix_plan, mix_sources


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Resharing by brute force: sizes by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        if not weight:
            break
        more = {s for s in names if s not in full and w[s] * rest / weight > cap * sizes[s]}
        if not more:
            break
        full |= more
    return {s: float(cap * sizes[s]) if s in full else w[s] * rest / weight for s in names}


DOCS = [(k, "w " * (k % 40 + 1), ["a", "b", "c", "d", None][k % 5] if k % 7 else "tiny") for k in range(400)] + [
    (1000, None, "a"), (1001, "", "b"), (1002, "one two\tthree\x0bfour five", "c"), (None, "x y", "a"), (1004, None, "nothing"), (1005, "q", "Z")]


def test_plan_matches_brute_force(make_docs):
    rows = mix_plan(make_docs(DOCS)).collect()
    sizes = {}
    for _, t, s in DOCS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    source = {i: s for i, _, s in DOCS}
    assert len(rows) == len(DOCS)
    taken = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2 ** 52
        assert r.copies == int(rate) + (u < rate - int(rate)) and r.taken == r.size * r.copies <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in ("a", "b", "c", "d"):
        assert taken[s] == pytest.approx(want[s], rel=0.25)


def test_emits_each_document_as_often_as_planned(make_docs):
    docs = make_docs(DOCS)
    plan = {r.doc_id: r.copies for r in mix_plan(docs).collect()}
    out = mix_sources(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in plan.items() if n}


def test_repeated_rows_and_empty_table(make_docs):
    rows = mix_plan(make_docs([(1, "a b", "s"), (1, "a b", "s"), (2, "c", None)])).collect()
    assert len(rows) == 3 and len({r.copies for r in rows if r.doc_id == 1}) == 1
    assert mix_plan(make_docs([])).collect() == [] and mix_sources(make_docs([])).collect() == []
    assert [r.taken for r in mix_plan(make_docs([(1, None, "s"), (2, "", "s")])).collect()] == [0, 0]


def test_many_sources_are_joined_by_a_shuffle(make_docs, monkeypatch):
    import tabsight.llm.mixing as m
    few = sorted(mix_plan(make_docs(DOCS)).collect(), key=str)
    monkeypatch.setattr(m, "FEW_SOURCES", 2)
    assert sorted(mix_plan(make_docs(DOCS)).collect(), key=str) == few
