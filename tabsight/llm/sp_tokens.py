"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into words where no piece can span the cut. The different words of a
batch are grouped by length, and the words of a length advance together: every
substring's hash is looked up among the sorted hashes of the pieces, each place
keeps the best last piece, and the backpointers are followed from the end.

A unigram model keeps the last piece with the largest score sum. A BPE model's
scores are merge ranks, whose sum its own encoder does not maximise (see README);
there, a last piece is admitted if it and the last piece before it come out of the
merges as these two, which holds for exactly one candidate at each place.

Defined results: null and empty texts have no tokens; characters without a piece
become bytes if the model has byte pieces, else the unknown id; U+2581 counts as a
space, as in the model; repeated rows come out alike; an empty table gives an empty
result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import text_of

SPACE = "▁"
MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Code points encoded in one go, words whose ids a worker remembers, code points of one lattice and of one returned batch.
RUN, REMEMBER, LATTICE, RETURNED = 3_000_000, 250_000, 200_000, 4_000_000
UNIGRAM, BPE = 1, 2


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes (words, length + 1) of rows of code points."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * MULT + codes[:, i].astype(np.uint64) + np.uint64(1)
    return out


def _different(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each different stretch of ``codes``, the different stretch of each).

    Stretches are told apart by hash; one that then differs from the first of its hash stands for itself.
    """
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), MULT))), dtype=np.uint64)
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), INVERSE))), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * back[:-1], dtype=np.uint64)))
    end = start + size
    _, first, which = np.unique((sums[end] - sums[start]) * power[end - 1], return_index=True, return_inverse=True)
    other = first[which]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    far = np.minimum(np.repeat(start[other], size) + at, len(codes) - 1)
    same = np.logical_and.reduceat(codes[np.repeat(start, size) + at] == codes[far], np.cumsum(size) - size)
    odd = np.flatnonzero(~same | (size != size[other]))
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), which


class PieceModel:
    """Pieces of a model file as sorted arrays."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        m.ParseFromString(blob)
        spec, n = m.normalizer_spec, len(m.pieces)
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and leading space marks are read")
        self.kind = m.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        self.dummy = spec.add_dummy_prefix
        types = np.array([p.type for p in m.pieces])
        self.unk = int(np.flatnonzero(types == 2)[0])
        self.bytes = np.full(256, -1)
        for i in np.flatnonzero(types == 6):
            self.bytes[int(m.pieces[i].piece[1:-1], 16)] = i
        normal = [i for i in range(n) if types[i] in (1, 4)]
        texts = [m.pieces[i].piece for i in normal]
        self.longest = max(map(len, texts))
        self.pairs = np.array(sorted({ord(t[k]) << 32 | ord(t[k + 1]) for t in texts for k in range(len(t) - 1)}), dtype=np.uint64)
        self.newline_cuts = not any("\n" in t for t in texts)
        # surfaces for decoding: a row of bytes for each id
        faces = [m.pieces[i].piece.replace(SPACE, " ").encode() if types[i] in (1, 4) else b"" for i in range(n)]
        faces[self.unk] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes):
            if i >= 0:
                faces[i] = bytes([b])
        self.face_len = np.array([len(f) for f in faces])
        self.face_at = np.cumsum(self.face_len) - self.face_len
        self.face = np.frombuffer(b"".join(faces), np.uint8)
        # pieces in the order of their hashes
        codes = np.zeros((len(texts), self.longest), np.uint32)
        size = np.array([len(t) for t in texts])
        for k, t in enumerate(texts):
            codes[k, :len(t)] = [ord(c) for c in t]
        h = _hashes(codes)[np.arange(len(texts)), size]
        order = np.argsort(h)
        self.keys, self.size, self.codes = h[order], size[order], codes[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # most substrings are no piece: a table of the keys' mixed leading bits tells them at once
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys * MULT >> np.uint64(44)] = True
        self.ids = np.array(normal)[order]
        self.score = np.array([m.pieces[i].score for i in normal])[order].astype(np.float64)
        self.unk_score = self.score.min() - 10
        self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.longest, MULT))), dtype=np.uint64)
        self.whole = np.ones(len(order), bool)
        if self.kind == BPE:
            self._split_pieces([texts[k] for k in order])

    def _split_pieces(self, texts: list[str]) -> None:
        """The last merge of each piece, and whether the merges yield the piece at all."""
        at = {t: k for k, t in enumerate(texts)}
        n = len(texts)
        self.left, self.right, self.late = np.full(n, -1), np.full(n, -1), np.full(n, -1.0)
        rank = -self.score
        for k in np.argsort(self.size, kind="stable"):
            parts, last = list(texts[k]), None
            if any(c not in at for c in parts):
                self.whole[k] = len(parts) == 1
                continue
            while len(parts) > 1:
                best = min(((rank[at[x + y]], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in at), default=None)
                if best is None:
                    break
                i = best[1]
                last = (at[parts[i]], at[parts[i + 1]])
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.whole[k] = len(parts) == 1
            if self.whole[k] and last:
                self.left[k], self.right[k] = last
                self.late[k] = max(rank[k], self.late[last[0]], self.late[last[1]])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the pieces, -1 where none."""
        out = np.full(h.shape, -1)
        ask = np.nonzero(self.maybe[h * MULT >> np.uint64(44)])
        wanted = h[ask]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        out[ask] = np.where(self.keys[at] == wanted, at, -1)
        return out

    def admitted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the merges of two pieces' joint text end in these two pieces.

        The merges are undone from the latest on; if the symbols that then meet at
        the border had a merge that went first, the pair does not come out.
        """
        packed, back = np.unique(one.astype(np.int64) << 32 | two, return_inverse=True)
        x, y = packed >> 32, packed & 0xFFFFFFFF
        ok = np.ones(len(x), bool)
        limit, on_right = np.full(len(x), np.inf), np.zeros(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            small = self.size[u] + self.size[v] <= self.longest
            joint = np.full(len(live), -1)
            joint[small] = self.find(self.keys[u[small]] * self.power[self.size[v[small]]] + self.keys[v[small]])
            r = np.where(joint >= 0, -self.score[joint], np.inf)
            lost = (joint >= 0) & ((r < limit[live]) | ((r == limit[live]) & on_right[live]))
            ok[live[lost]] = False
            later = self.late[u] > self.late[v]
            done = lost | ((self.left[u] < 0) & (self.left[v] < 0))
            limit[live] = np.where(later, self.late[u], self.late[v])
            on_right[live] = ~later
            x[live], y[live] = np.where(later, self.right[u], u), np.where(later, v, self.left[v])
            live = live[~done]
        return ok[back]

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, rows of ``codes``, one after the other, and how many each word has."""
        b, n = codes.shape
        h = _hashes(codes)
        none, unknown = -1, -2
        # the piece of each substring: a table for each piece length
        found = []
        for size in range(1, min(n, self.longest) + 1):
            piece = self.find(h[:, size:] - h[:, :-size] * self.power[size])
            w, j = np.nonzero(piece >= 0)
            k = piece[w, j]
            text = np.lib.stride_tricks.sliding_window_view(codes, size, axis=1)[w, j]
            wrong = (self.size[k] != size) | ~self.whole[k] | (text != self.codes[k, :size]).any(axis=1)
            piece[w[wrong], j[wrong]] = none
            found.append(piece)
        last = np.full((b, n + 1), none)
        step = np.zeros((b, n + 1), np.int64)
        best = np.full((b, n + 1), -np.inf)
        best[:, 0] = 0
        every = np.arange(b)
        for i in range(1, n + 1):
            sizes = np.arange(min(i, self.longest), 0, -1)  # of equal sums the longest last piece stays
            piece = np.stack([found[size - 1][:, i - size] for size in sizes], axis=1)
            before, reached = last[:, i - sizes], np.isfinite(best[:, i - sizes])
            lone = (piece[:, -1] < 0) & reached[:, -1]
            if self.kind == BPE:
                fits = (piece >= 0) & reached
                ask = fits & (before >= 0)
                w, k = np.nonzero(ask)
                fits[w, k] = self.admitted(before[w, k], piece[w, k])
                score = np.where(fits, 0.0, -np.inf)
            else:
                score = np.where((piece >= 0) & reached, best[:, i - sizes] + self.score[np.maximum(piece, 0)], -np.inf)
            k = score.argmax(axis=1)
            top = score[every, k]
            alone = best[:, i - 1] + self.unk_score
            lone &= ~np.isfinite(top) if self.kind == BPE else alone > top
            ok = np.isfinite(top) | lone
            last[:, i] = np.where(lone, unknown, np.where(ok, piece[every, k], none))
            step[:, i] = np.where(lone, 1, sizes[k])
            best[:, i] = np.where(lone, 0.0 if self.kind == BPE else alone, top)
        # follow all words' backpointers together
        places = np.full(b, n)
        rows, ends, got = [], [], []
        live = np.arange(b)
        while len(live):
            rows.append(live)
            ends.append(places[live])
            got.append(last[live, places[live]])
            places[live] -= step[live, places[live]]
            live = live[places[live] > 0]
        rows, ends, got = np.concatenate(rows), np.concatenate(ends), np.concatenate(got)
        order = np.lexsort((ends, rows))
        rows, ends, got = rows[order], ends[order], got[order]
        ids = np.where(got >= 0, self.ids[np.maximum(got, 0)], -1)
        if (ids < 0).any():
            spelled = {k: self._spelled(chr(codes[rows[k], ends[k] - 1])) for k in np.flatnonzero(ids < 0).tolist()}
            times = np.ones(len(ids), np.int64)
            for k, x in spelled.items():
                times[k] = len(x)
            rows, flat = np.repeat(rows, times), np.repeat(ids, times)
            at = np.cumsum(times) - times
            for k, x in spelled.items():
                flat[at[k]:at[k] + len(x)] = x
            ids = flat
        return ids, np.bincount(rows, minlength=b)

    def _spelled(self, char: str) -> list[int]:
        raw = [int(self.bytes[x]) for x in char.encode("utf-8", "surrogatepass")]
        return [self.unk] if min(raw) < 0 else raw

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of different words (with their space marks)."""
        flat, count = self.encode_flat(words)
        return np.split(flat, np.cumsum(count)[:-1]) if words else []

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - 1
        # cut where no piece spans two characters, and between words
        pair = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        known = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        cut = np.concatenate((~known, [True]))
        cut[last] = True
        end = np.flatnonzero(cut) + 1
        start = np.concatenate(([0], end[:-1]))
        size = end - start
        first, which = _different(codes, start, size)
        start, size_of = start[first], size[first]
        at, n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        found, used = [], 0
        for length in np.unique(size_of).tolist():
            mine = np.flatnonzero(size_of == length)
            rows = max(1, LATTICE // length)
            for k in range(0, len(mine), rows):
                part = mine[k:k + rows]
                got, count = self._viterbi(codes[start[part][:, None] + np.arange(length)])
                at[part], n[part] = used + np.cumsum(count) - count, count
                found.append(got)
                used += len(got)
        ids = np.concatenate(found)
        # the parts of a word one after the other
        times = n[which]
        flat = ids[np.arange(times.sum()) + np.repeat(at[which] - (np.cumsum(times) - times), times)]
        return flat, np.diff(np.cumsum(times)[np.searchsorted(end, last + 1)], prepend=0)


class Tokenizer:
    """Encodes and decodes batches of texts; remembers the ids of recent words."""

    def __init__(self, model: PieceModel):
        self.m = model
        # word -> its number; the ids of word k are flat[begin[k]:begin[k] + size[k]]
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0
        for t in texts:
            t = t.replace(SPACE, " ")
            held.append(" " + t if t and self.m.dummy else t)
            size += len(t)
            if size > RUN:
                out += self._run(held)
                held, size = [], 0
        return out + self._run(held)

    def _words(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts joined, the codes, where words start, and the words before each text's end.

        A word is a run of other characters with the spaces before it; a line break, and spaces
        before one or at the end, are words of their own.
        """
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        space = codes == 32
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        if self.m.newline_cuts:
            line = codes == 10
            starts |= line
            starts[1:] |= line[:-1]
        starts[np.concatenate(([0], ends[:-1]))[np.diff(ends, prepend=0) > 0]] = True
        at = np.flatnonzero(starts)
        return whole, codes, at, np.searchsorted(at, ends)

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        if not any(texts):
            return [np.zeros(0, np.int32) for _ in texts]
        whole, codes, start, words = self._words(texts)
        end = np.append(start[1:], len(codes))
        first, at = _different(codes, start, end - start)
        place = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        number = np.fromiter((self.known.get(w, -1) for w in place), np.int64, len(place))
        if (number < 0).sum() + len(self.known) > REMEMBER:
            self._forget(number)
            number = np.fromiter((self.known.get(w, -1) for w in place), np.int64, len(place))
        self.again[number[number >= 0]] = True
        fresh = [place[k] for k in np.flatnonzero(number < 0).tolist()]
        flat, count = self.m.encode_flat([w.replace(" ", SPACE) for w in fresh])
        number[number < 0] = len(self.known) + np.arange(len(fresh))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.size = np.concatenate((self.size, count))
        self.again = np.concatenate((self.again, np.zeros(len(fresh), bool)))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
        size, begin, flat = self.size[number], self.begin[number], self.flat
        n = size[at]
        ends = np.cumsum(n)
        stream = flat[np.arange(ends[-1]) + np.repeat(begin[at] - (ends - n), n)]
        return np.split(stream, np.concatenate(([0], ends))[words][:-1])

    def _forget(self, needed: np.ndarray) -> None:
        """Keep the words of this run, and those that came again unless these are too many, too."""
        keep = self.again if self.again.sum() < REMEMBER // 2 else np.zeros(len(self.again), bool)
        keep = keep.copy()
        keep[needed[needed >= 0]] = True
        self.known = {w: k for k, w in enumerate(w for w, old in self.known.items() if keep[old])}
        n, first = self.size[keep], self.begin[keep]
        at = np.cumsum(n) - n
        self.flat = self.flat[np.arange(n.sum()) + np.repeat(first - at, n)]
        self.begin, self.size, self.again = at, n, np.zeros(len(n), bool)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        out = []
        for x in ids:
            n = self.m.face_len[x]
            ends = np.cumsum(n)
            raw = self.m.face[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.m.face_at[x] - (ends - n), n)].tobytes()
            text = raw.decode("utf-8", "replace")
            out.append(text[1:] if self.m.dummy and text[:1] == " " else text)
        return out


_TOKENIZERS: dict[int, Tokenizer] = {}


def _tokenizer(sent) -> Tokenizer:
    """One tokenizer for each broadcast model in a worker."""
    if sent.id not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[sent.id] = Tokenizer(sent.model.value)
    return _TOKENIZERS[sent.id]


class _Sent:
    def __init__(self, spark, path: str):
        with open(path, "rb") as f:  # on the driver; executors get the broadcast model
            self.model = spark.sparkContext.broadcast(PieceModel(f.read()))
        self.id = id(self.model)


def _parts(batches: Iterator[pd.Series]) -> Iterator[list[str]]:
    """Texts in lists of about RETURNED code points, so that no large batch of ids is held."""
    for s in batches:
        held, size = [], 0
        for t in s:
            held.append(t)
            size += len(t)
            if size >= RETURNED:
                yield held
                held, size = [], 0
        if held:
            yield held


def encoder(spark, path: str, text: str = "text") -> Column:
    """The ids of a text column as an array column."""
    sent = _Sent(spark, path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in _parts(batches):
            yield pd.Series(_tokenizer(sent).encode(texts), dtype=object)
    return encode(text_of(text))


def decoder(spark, path: str, ids: str = "ids") -> Column:
    """The text of an array column of ids."""
    sent = _Sent(spark, path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_tokenizer(sent).decode([np.asarray(x, np.int64) for x in s]), dtype=object)
    return decode(F.coalesce(F.col(ids), F.array().cast("array<int>")))


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the columns ``ids`` and ``n_tokens``."""
    return docs.withColumn("ids", encoder(docs.sparkSession, path)).withColumn("n_tokens", F.size("ids").cast("long"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact): ids digested as little-endian 32-bit words."""
    sent = _Sent(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256
        for texts in _parts(batches):
            tok = _tokenizer(sent)
            ids = tok.encode(texts)
            back = tok.decode(ids)
            yield pd.DataFrame({"n_tokens": [len(x) for x in ids], "ids_sha256": [sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
                                "decoded_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
                                "exact": [a == b for a, b in zip(back, texts)]})
    return docs.select("doc_id", digest(text_of()).alias("x")).select("doc_id", "x.*")
