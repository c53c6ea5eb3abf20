import random

import numpy as np
import pytest
import xxhash

from tabsight.llm import simhash_trie
from tabsight.llm.common import merged_labels
from tabsight.llm.simhash_trie import simhash, simhash_components, simhash_dedup, trie_components

ASCII_SPACE = " \t\n\x0b\x0c\r"


def plain_simhash(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in ASCII_SPACE:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(v, bits):
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= bits)
    return merged_labels(np.arange(len(v)), i, j)


def clusters(seed, bits=51, most=30):
    rng = np.random.default_rng(seed)
    v = []
    for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64):
        for _ in range(rng.integers(1, most)):
            y = int(x)
            for b in rng.integers(0, bits, rng.integers(0, 6)):
                y ^= 1 << int(b)
            v.append(y & ((1 << bits) - 1))
    return np.unique(np.array(v, np.uint64))


TEXTS = ["", "   ", "One two", "one TWO", "a b c d e f", "É É é é x", "tab\tnew\nline\x0bv\x0cf\rr", "no\xa0break space here is one word",
         "a b a b a b a b a b", "x" * 5000, "w " * 70000]


def test_fingerprint_by_definition():
    for t in TEXTS[:-1]:
        assert simhash(t) == plain_simhash(t), t
    assert simhash("w " * 70000) == plain_simhash("w w w w")


@pytest.mark.parametrize("seed", range(6))
def test_trie_self_join_matches_all_pairs(seed):
    v = clusters(seed)
    assert (trie_components(v, np.array([0, len(v)]), 13, 4) == brute_labels(v, 4)).all()


def test_trie_with_small_frontier_and_several_groups(monkeypatch):
    monkeypatch.setattr(simhash_trie, "FRONTIER", 50)
    a, b = clusters(7), clusters(8)
    got = trie_components(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 13, 4)
    assert (got == np.concatenate([brute_labels(a, 4), brute_labels(b, 4) + len(a)])).all()


def near_docs(n, seed=1):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(30, 120))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out[:n]


@pytest.mark.parametrize("unit", [4096, 4])
def test_components_match_all_pairs(make_docs, monkeypatch, unit):
    monkeypatch.setattr(simhash_trie, "UNIT", unit)  # small: every group is dealt out in chunk pairs
    texts = near_docs(150) + TEXTS[:-1] + ["", "one two"]
    docs = make_docs([(3 * k + 1, t) for k, t in enumerate(texts)])
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash_components(docs).collect()}
    fps = np.array([plain_simhash(t) for t in texts], np.uint64)
    want = brute_labels(fps, 4)
    assert got == {3 * k + 1: (int(fps[k]), 3 * int(want[k]) + 1) for k in range(len(texts))}
    kept = {r.doc_id for r in simhash_dedup(docs).collect()}
    assert kept == {3 * k + 1 for k in range(len(texts)) if want[k] == k}


def test_edge_rows(make_docs):
    docs = make_docs([(5, None), (2, ""), (None, "alone words here now"), (9, "same text of words"), (9, "same text of words"), (None, "same text of words")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(docs).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (None, None), (9, 9), (9, 9), (None, 9)], key=str)
    assert simhash_components(make_docs([])).collect() == []
    assert simhash_dedup(docs).columns == docs.columns
    with pytest.raises(ValueError):
        simhash_components(docs, max_bits=16)


def test_dedup_decides_by_row(make_docs):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    docs = [(None, a), (None, a), (None, a), (4, b), (4, b), (1, c), (7, c), (7, d), (None, c)]
    got = sorted(((r.doc_id, r.text) for r in simhash_dedup(make_docs(docs)).collect()), key=str)
    assert got == sorted([(None, a), (4, b), (1, c), (7, d)], key=str)
    assert simhash_dedup(make_docs([])).collect() == []


def test_map_columns_are_carried(make_docs):
    from pyspark.sql import functions as F
    from tabsight.llm.simhash_trie import simhash_dedup
    docs = make_docs(["a b c d e f", "a b c d e f", "quite another text it is"]).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    assert sorted(r.m["k"] for r in simhash_dedup(docs).collect()) == [0, 2]
