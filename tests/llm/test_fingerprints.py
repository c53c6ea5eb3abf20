import hashlib
import re

import pytest

from tabsight.llm.fingerprints import document_fingerprints, peel


def paras(t):
    return set(re.findall(r"[^\n]{1,200}", t or ""))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(texts):
    """By brute force; texts in doc_id order."""
    out = []
    for k, t in enumerate(texts):
        t, nx = t or "", texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        e = t[:len(t) - q] + nx[:q]
        out.append((len(t), hashlib.sha256(e.encode()).hexdigest(), likeness(paras(t), paras(e)), likeness(paras(t), paras(nx))))
    return out


TEXTS = ["a\nb\nc\nd", "a\nb\nc\nd", None, "", "x", "é" * 900 + "\n" + "ü" * 10, "\n".join(f"line {i} of a long text" for i in range(3000)),
         "\n".join(f"line {i} of a long text" for i in range(1, 3001)), "same\nsame\nsame", "😀\n" * 5]


def test_matches_brute_force(make_docs):
    got = sorted(document_fingerprints(make_docs([(10 * k, t) for k, t in enumerate(TEXTS)])).collect())
    assert [(r.n_chars, r.edited_sha256) for r in got] == [x[:2] for x in expected(TEXTS)]
    for r, x in zip(got, expected(TEXTS)):
        assert (r.near_edited, r.near_next) == pytest.approx(x[2:])
    assert got[0].fingerprint == got[1].fingerprint != got[4].fingerprint
    assert got[2].fingerprint == got[3].fingerprint


def test_repeated_rows_and_null_ids(make_docs):
    got = document_fingerprints(make_docs([(1, "a\nb"), (1, "a\nb"), (None, "c\nd"), (2, "a\nb")])).collect()
    assert len(got) == 4
    assert len({tuple(r)[1:] for r in got if r.doc_id == 1}) == 1


def test_single_document_is_its_own_next(make_docs):
    r = document_fingerprints(make_docs(["one\ntwo"])).first()
    assert r.near_next == 1.0


def test_empty_table(make_docs):
    assert document_fingerprints(make_docs([])).collect() == []


def test_failed_peel_leaves_cells_and_larger_table_succeeds(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 60), i -> xxhash64(i)) AS mine", "CAST(array() AS array<bigint>) AS other")
    small = df.selectExpr(f"{peel('mine', 'other', 8)} AS st").selectExpr("exists(st.cells, c -> c.cnt <> 0) AS failed").first()
    large = df.selectExpr(f"{peel('mine', 'other', 64)} AS st", "mine").selectExpr(
        "exists(st.cells, c -> c.cnt <> 0) AS failed", "sort_array(st.found.key) = sort_array(mine) AS all_found").first()
    assert small.failed and not large.failed and large.all_found
