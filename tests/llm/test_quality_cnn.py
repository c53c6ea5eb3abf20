import random
import zlib

import numpy as np
import pytest

from tabsight.llm.quality_cnn import CHUNK, STEP, ByteCNN, chunk_starts, chunks_of, keep_quality, score_documents


def corpus(n):
    rng = random.Random(1)
    words = "the of and river house small tree garden water letter".split()
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) + "."
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(20, 200)))
    return [(good(), 1) if k % 2 else (bad(), 0) for k in range(n)]


def test_chunks_cover_every_byte_and_overlap():
    for n in (0, 1, STEP, CHUNK, CHUNK + 1, 5000):
        starts = chunk_starts(n)
        assert starts[0] == 0 and starts[-1] + CHUNK >= n and (np.diff(starts) < CHUNK).all()
    text = "".join(chr(97 + i % 26) for i in range(1200))
    c = chunks_of(text)
    assert bytes(c[0]).decode() == text[:CHUNK] and bytes(c[1])[:5].decode() == text[STEP:STEP + 5]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, CHUNK)).astype(np.uint8)
    starts, y = np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    net = ByteCNN(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        _, z = net._maps(x)
        h = np.maximum(z.max(axis=1) + net.p["bias"], 0)
        p = net._combine(np.maximum(h @ net.p["dense"] + net.p["shift"], 0), starts)[1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    g = net._gradients(x, starts, y)
    for name, at in (("out", (3,)), ("dense", (4, 5)), ("conv", (7, 2)), ("bias", (1,)), ("shift", (2,)), ("emb", (int(x[0, 0]), 1))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-6
        up = loss()
        net.p[name][at] = keep - 1e-6
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-4 + 0.02 * abs(g[name][at]), name


def test_learns_and_scores_held_out_rows(spark, make_docs):
    rows = corpus(240)
    docs = make_docs([(k, t) for k, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(k, q, 0) for k, (_, q) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 240 and 40 < len(held) < 120
    assert sum(r.predicted == rows[r.doc_id][1] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_long_text_scores_as_its_chunks(monkeypatch):
    import tabsight.llm.quality_cnn as q
    net = ByteCNN(3)
    texts = ["x" * 10, "", "abc " * 4000, "é" * 700]
    whole = net.scores(texts)
    monkeypatch.setattr(q, "SLICE", 4)
    assert np.allclose(net.scores(texts), whole, atol=1e-6)
    assert np.allclose([net.scores([t])[0] for t in texts], whole, atol=1e-6)


def test_edge_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "text"), (4, "a" * 20000), (4, "a" * 20000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(score_documents(docs, none).collect()) == 5
    assert {r.score for r in score_documents(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 0), (4, 7)], "doc_id long, quality int")
    assert len(score_documents(docs, labels).collect()) == 5
    assert score_documents(make_docs([]), labels).collect() == []
    assert keep_quality(docs, none).columns == docs.columns


def test_forward_pass_equals_plain_loops():
    from tabsight.llm.quality_cnn import BLOCK, CHUNK, EMBED, STEP
    model = ByteCNN(seed=3)
    for text in ("", "short", "ä long one " * 130):
        raw, n = text.encode(), 1
        while (n - 1) * STEP + CHUNK < len(raw):
            n += 1
        dense = []
        for c in range(n):
            part = raw[c * STEP:c * STEP + CHUNK].ljust(CHUNK, b"\0")
            best = [-1e30] * len(model.p["bias"])
            for at in range(0, CHUNK - BLOCK, BLOCK):
                window = [float(v) for b in part[at:at + 2 * BLOCK] for v in model.p["emb"][b]]
                for f in range(len(best)):
                    best[f] = max(best[f], sum(w * float(k) for w, k in zip(window, model.p["conv"][:, f])))
            pooled = [max(0.0, b + float(o)) for b, o in zip(best, model.p["bias"])]
            dense.append([max(0.0, sum(p * float(w) for p, w in zip(pooled, model.p["dense"][:, d])) + float(model.p["shift"][d]))
                          for d in range(len(model.p["shift"]))])
        features = [max(x) for x in zip(*dense)] + [sum(x) / n for x in zip(*dense)]
        z = sum(f * float(w) for f, w in zip(features, model.p["out"])) + float(model.p["off"][0])
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_training_takes_whole_texts_and_bounds_their_sum(spark, make_docs, monkeypatch):
    import tabsight.llm.quality_cnn as q
    seen = {}
    monkeypatch.setattr(q.ByteCNN, "fit", lambda self, docs, y, epochs: seen.update(docs=docs, y=y) or self)
    long = next(k for k in range(60, 99) if zlib.crc32(str(k).encode()) % 3 != 1)
    docs = make_docs([(k, "w" * (900 * (k % 7) + 1)) for k in range(60)] + [(0, "a"), (0, "b")] + [(long, "z" * 100_000)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(99)], "doc_id long, quality int, toxic int")
    q.train_quality(docs, labels)
    assert max(len(d) for d in seen["docs"]) == 1 + -(-(100_000 - 512) // 448)
    assert len(seen["docs"]) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(60)) + 1  # one of the three rows with id 0
    q.train_quality(docs, labels, max_chunks=50)
    assert 40 < sum(len(d) for d in seen["docs"]) <= 50 and len(seen["docs"]) == len(seen["y"])
