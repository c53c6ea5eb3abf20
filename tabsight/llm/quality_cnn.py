"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes
are embedded, a layer of learned filters slides over each chunk and a chunk keeps
every filter's maximum. A dense layer on these maxima sees which patterns a chunk
has and which it lacks (one that repeats itself has few); a document combines the
maximum and the mean of its chunks' dense values into one probability.

The network is trained on the driver from a bounded sample of labelled rows, each with
its whole text: about ``max_docs`` rows in the order of a hash of their id, as far as their
texts together have at most ``max_chunks`` chunks (a row that alone has more is passed
over). Scoring reads every byte of every text.

Defined results: null and empty texts are one chunk of zero bytes and get a score
like any other; labels other than 0 and 1 are ignored; of repeated labels of one
document the largest counts, of repeated documents of one id the least text is fitted; without both classes in the sample every score is the
smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import saved, text_of

CHUNK, STEP = 512, 448
EMBED, BLOCK, FILTERS, DENSE = 8, 4, 32, 24
#: Held-out documents: crc32 of the id modulo FOLDS equals HELD.
FOLDS, HELD = 3, 1
MAX_DOCS, MAX_CHUNKS, EPOCHS, RATE, SEED = 4000, 40_000, 20, 4e-3, 42
#: Documents and chunks of a training batch.
BATCH, BATCH_CHUNKS = 64, 1500
SLICE = 1024


def chunk_starts(n_bytes: int) -> np.ndarray:
    """Starts of the chunks that cover ``n_bytes`` bytes."""
    return np.arange(max(1, -(-(n_bytes - (CHUNK - STEP)) // STEP))) * STEP


def chunks_of(text: str) -> np.ndarray:
    """(chunks, CHUNK) bytes of a text, zero beyond its end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts = chunk_starts(len(raw))
    padded = np.zeros(starts[-1] + CHUNK, np.uint8)
    padded[:len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class ByteCNN:
    """Embedding, one convolution of width 2 * BLOCK and stride BLOCK, max-pooling and a logistic output."""

    def __init__(self, seed: int = SEED, prior: float | None = None):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.prior = prior
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(f32),
                  "conv": rng.normal(0, 0.2, (2 * BLOCK * EMBED, FILTERS)).astype(f32), "bias": np.zeros(FILTERS, f32),
                  "dense": rng.normal(0, 0.25, (FILTERS, DENSE)).astype(f32), "shift": np.zeros(DENSE, f32),
                  "out": rng.normal(0, 0.1, 2 * DENSE).astype(f32), "off": np.zeros(1, f32)}

    def _maps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded bytes and filter values (chunks, places, FILTERS)."""
        half = BLOCK * EMBED
        a = self.p["emb"][x].reshape(len(x), CHUNK // BLOCK, half)
        both = a.reshape(-1, half) @ np.hstack([self.p["conv"][:half], self.p["conv"][half:]])
        both = both.reshape(len(x), CHUNK // BLOCK, 2 * FILTERS)
        return a, both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        """Dense values of each chunk."""
        out = np.empty((len(x), FILTERS), np.float32)
        for at in range(0, len(x), SLICE):
            out[at:at + SLICE] = self._maps(x[at:at + SLICE])[1].max(axis=1)
        return np.maximum(np.maximum(out + self.p["bias"], 0) @ self.p["dense"] + self.p["shift"], 0)

    def _combine(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(np.append(starts, len(h)))[:, None]
        f = np.hstack([np.maximum.reduceat(h, starts), np.add.reduceat(h.astype(np.float64), starts) / n])
        return f, 1 / (1 + np.exp(-np.clip(f @ self.p["out"].astype(np.float64) + float(self.p["off"][0]), -30, 30)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out, held, counts, size = [np.zeros(0)], [], [], 0
        for t in texts:
            c = chunks_of(t)
            held.append(self._pooled(c) if len(c) > SLICE else c)
            counts.append(len(c))
            size += len(c)
            if size >= SLICE:
                out.append(self._scored(held, counts))
                held, counts, size = [], [], 0
        if held:
            out.append(self._scored(held, counts))
        return np.concatenate(out)

    def _scored(self, held: list[np.ndarray], counts: list[int]) -> np.ndarray:
        h = np.empty((sum(counts), DENSE), np.float32)
        ends = np.cumsum(counts)
        short = [i for i, c in enumerate(held) if c.dtype == np.uint8]
        for i, c in enumerate(held):
            if c.dtype != np.uint8:
                h[ends[i] - counts[i]:ends[i]] = c
        if short:
            rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in short])
            h[rows] = self._pooled(np.concatenate([held[i] for i in short]))
        return self._combine(h, ends - counts)[1]

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        _, z = self._maps(x)
        place = z.argmax(axis=1)
        m = np.take_along_axis(z, place[:, None], 1)[:, 0] + self.p["bias"]
        h = np.maximum(m, 0)
        u = np.maximum(h @ self.p["dense"] + self.p["shift"], 0)
        f, p = self._combine(u, starts)
        n = np.diff(np.append(starts, len(u)))
        doc = np.repeat(np.arange(len(starts)), n)
        d = (p - y) / len(y)
        df = d[:, None] * self.p["out"]
        top = u == f[doc, :DENSE]
        ties = np.add.reduceat(top, starts, dtype=np.float64)[doc]
        du = (df[doc, :DENSE] * top / ties + df[doc, DENSE:] / n[doc][:, None]) * (u > 0)
        dm = (du @ self.p["dense"].T) * (m > 0)
        at = place[:, :, None] * BLOCK + np.arange(2 * BLOCK)
        xw = x[np.arange(len(x))[:, None, None], at]
        aw = self.p["emb"][xw].reshape(len(x), FILTERS, -1)
        da = dm[:, :, None] * self.p["conv"].T
        emb = np.stack([np.bincount(xw.ravel(), da.reshape(-1, EMBED)[:, k], 256) for k in range(EMBED)], axis=1)
        return {"emb": emb, "conv": np.einsum("bf,bfk->kf", dm, aw), "bias": dm.sum(axis=0),
                "dense": h.T @ du, "shift": du.sum(axis=0), "out": d @ f, "off": d.sum(keepdims=True)}

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> "ByteCNN":
        """Adam over batches of whole documents, of at most BATCH_CHUNKS chunks unless one document has more."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros(v.shape) for k, v in self.p.items()}
        m2 = {k: np.zeros(v.shape) for k, v in self.p.items()}
        sizes = np.array([len(d) for d in docs])

        def batches() -> list[np.ndarray]:
            order, out, held = rng.permutation(len(docs)), [], 0
            first = 0
            for at, i in enumerate(order):
                if at > first and (at - first == BATCH or held + sizes[i] > BATCH_CHUNKS):
                    out.append(order[first:at])
                    first, held = at, 0
                held += sizes[i]
            return out + [order[first:]]

        plan = [pick for _ in range(epochs) for pick in batches()]
        total = len(plan)
        for step, pick in enumerate(plan, 1):
            n = sizes[pick]
            g = self._gradients(np.concatenate([docs[i] for i in pick]), np.cumsum(n) - n, labels[pick])
            now = rate * (1 - 0.9 * step / total)
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                self.p[k] = (self.p[k] - now * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def held_out(folds: int = FOLDS, held: int = HELD) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held


def train_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chunks: int = MAX_CHUNKS,
                  epochs: int = EPOCHS) -> ByteCNN:
    """A network from about ``max_docs`` whole rows that carry a label and are not held out."""
    spark = docs.sparkSession
    known = (labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("quality").cast("int").alias("quality")).filter(~held_out()))
    n = known.count()
    share = min(1.0, max_docs / max(1, n))
    # at most 2 * max_docs small rows, so they can go to every executor
    order = F.xxhash64("doc_id", F.lit("sample"))
    picked = known.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * max_docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    chunks = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - (CHUNK - STEP)) / STEP))
    texts = saved(texts.withColumns({"chunks": chunks.cast("long"), "order": order}), few=True)
    used, chosen = 0, []
    for r in texts.select("doc_id", "chunks", "order").orderBy("order").collect():  # small rows, at most 2 * max_docs
        if used + r["chunks"] <= max_chunks:
            used += r["chunks"]
            chosen.append((r["doc_id"],))
    rows = texts.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id").select("doc_id", "quality", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], float)
    if len(set(y)) < 2:
        return ByteCNN(prior=float((y.sum() + 1) / (len(y) + 2)))
    return ByteCNN().fit([chunks_of(r["text"]) for r in rows], y, epochs)


def quality_score(spark, model: ByteCNN, text: str = "text") -> Column:
    """The probability of label 1 as a column."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(sent.value.scores(s.tolist()))
    return score(text_of(text))


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train_quality(docs, labels, max_docs)
    return (docs.select("doc_id", held_out().alias("held_out"), quality_score(docs.sparkSession, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more; all columns stay."""
    model = train_quality(docs, labels, max_docs)
    return docs.filter(quality_score(docs.sparkSession, model) >= 0.5)
