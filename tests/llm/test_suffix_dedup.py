import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabsight.llm import suffix_dedup
from tabsight.llm.suffix_dedup import dedup_substrings, runs_of


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s:s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        starts = sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(d)))
        out.append((len(d), int(gone.sum()), starts, kept))
    return out


def corpus(seed=0, length=400):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop éü") for _ in range(n))
    passage, base = text(length + 30), text(1500)
    exact = text(length)
    while len(exact.encode()) > length:
        exact = exact[:-1]
    exact += "z" * (length - len(exact.encode()))
    out = [text(rng.randint(0, 900)) for _ in range(10)] + [base, base, base[:700] + "EDIT" + base[700:], base[300:], base + text(50)]
    out += [text(200) + passage + text(rng.randint(0, 300)) for _ in range(6)] + [passage * 2]
    out += [text(10) + exact + text(10), text(20) + exact, exact[1:] + "q", exact]
    return out + ["ab" * 600, "a" * 401, "a" * 400, "b" * 399, "", None, "xyz" * 500 + text(20) + "xyz" * 500, text(3 * length)]


@pytest.mark.parametrize("length,piece", [(400, 1 << 20), (100, 1 << 20), (400, 300)])
def test_matches_brute_force(make_docs, monkeypatch, length, piece):
    monkeypatch.setattr(suffix_dedup, "SLICE", piece)  # small: long texts are read in several slices
    texts = corpus(length, length)
    rows = dedup_substrings(make_docs([(7 * k, t) for k, t in enumerate(texts)]), length).collect()
    got = {r.doc_id // 7: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    want = brute(texts, length)
    assert len(rows) == len(texts)
    for k, w in enumerate(want):
        assert got[k] == w, k


def test_runs_cover_every_start_once():
    for n in (400, 401, 1000, 5000):
        data = hashlib.sha512(str(n).encode()).digest() * (n // 64 + 1)
        spans = [(lo, hi) for _, _, lo, hi, _ in runs_of(data[:n], 400)]
        assert spans[0][0] == 0 and spans[-1][1] == n - 400
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_edge_rows(make_docs):
    t = "word " * 100
    u = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(450))
    rows = dedup_substrings(make_docs([(1, u), (1, u), (None, "short"), (None, None), (5, u[:420] + "!")])).collect()
    got = sorted(((r.doc_id, r.n_removed, r.n_spans) for r in rows), key=str)
    assert got == sorted([(1, 450, 1), (1, 450, 1), (None, 0, 0), (None, 0, 0), (5, 420, 1)], key=str)
    assert dedup_substrings(make_docs([t])).first().n_removed == 500
    assert dedup_substrings(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        dedup_substrings(make_docs([]), 50)
