"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own hashed vector next to the scaled sum of the hashed vectors of
its byte n-grams; in training the former is often left out, so that parts of words count. Two gated recurrent layers read a window of words in both directions,
attention pools their states, and a linear unit scores the window. Windows overlap by
half and cover the whole text; the most toxic one speaks for the document, and a logistic
curve turns its score into a probability.

The network is trained in numpy, by back-propagation through time, on at most
``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled documents, of at most ``MAX_TRAINING_SIZE``
in all, chosen by a hash of the id. Only documents are labelled, so
each pass first scores all windows of a document and then learns from its highest one.

Words come again and again: what a word adds to the gates is kept in a table of at most
``TABLE_ROWS`` words per worker.

Defined results: a null text counts as empty, which scores as a window without words;
of disagreeing labels for a document none is learnt from, and of rows that repeat a
doc_id one; without both kinds of label
all scores are 0 or 1, as the labels are, and 0 without any; repeated rows score alike;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import map_texts, portions
from marginalia.llm.quality import MAX_TRAINING_SIZE, logistic, training_labels, training_texts

FOLDS, HELD = 5, 0
MAX_POSITIVE, MAX_NEGATIVE = 1_500, 2_000
WINDOW, STRIDE = 32, 16
STATE, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5, 6)
EPOCHS, BATCH, RATE = 6, 128, 0.01
WORD_DROPOUT, RIDGE = 0.5, 1e-4
TABLE_ROWS = 200_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its bucket; all n-gram buckets in word order; n-grams per word."""
    coded = [b"<" + w.encode() + b">" for w in words]
    buckets = np.fromiter(map(zlib.crc32, coded), dtype=np.int64, count=len(coded)) % WORD_BUCKETS
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    flat = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    rolled = np.zeros(flat.size, dtype=np.uint64)
    for k in range(max(GRAMS)):
        size = flat.size - k
        if size <= 0:
            break
        rolled = (rolled[:size] + np.uint64(1)) * np.uint64(0x100000001B3) ^ flat[k:]
        if k + 1 in GRAMS:
            inside = word[:size] == word[k:]
            mixed = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            found.append((mixed[inside] % np.uint64(CHAR_BUCKETS)).astype(np.int32))
            owner.append(word[:size][inside].astype(np.int32))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return buckets, found[order], np.bincount(owner, minlength=len(words))


def window_starts(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word of every window; a document without words has one."""
    count = np.maximum(1, -(-(n_words - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n_words)), count)
    first = np.cumsum(count) - count
    return doc, (np.arange(len(doc)) - first[doc]) * STRIDE


def gather_windows(ids: np.ndarray, n_words: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(windows x WINDOW) word rows, 0 where a window runs past its text."""
    base = np.cumsum(n_words) - n_words
    at = (start[:, None] + np.arange(WINDOW)).astype(np.int32)
    inside = at < n_words[doc][:, None]
    where = np.where(inside, base[doc][:, None] + at, 0)
    return np.where(inside, ids[where] if ids.size else 0, 0).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        s = STATE
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (0.05 * rng.standard_normal((WORD_BUCKETS, WORD_DIM))).astype(np.float32),
            "char": (0.05 * rng.standard_normal((CHAR_BUCKETS, CHAR_DIM))).astype(np.float32),
            "v": draw(2 * s), "w": draw(2 * s), "b": np.zeros(1, dtype=np.float32),
        }
        for d in "fb":
            self.p |= {f"W{d}": draw(WORD_DIM + CHAR_DIM, 3 * s), f"U{d}": draw(s, 3 * s), f"c{d}": np.zeros(3 * s, dtype=np.float32)}
        self.curve = (1.0, 0.0)
        self.constant: float | None = None

    def inputs(self, buckets: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Word and character input of each word, some thousand words at a time."""
        chars = np.zeros((len(counts), CHAR_DIM), dtype=np.float32)
        stops = np.cumsum(counts)
        for at in range(0, len(counts), 10_000):
            own = counts[at : at + 10_000]
            if not own.sum():
                continue
            low = stops[at] - own[0]
            some = own > 0
            first = (np.cumsum(own) - own)[some]
            block = chars[at : at + 10_000]
            block[some] = np.add.reduceat(self.p["char"][grams[low : low + own.sum()]], first) / np.sqrt(own[some, None])
        return np.concatenate([self.p["word"][buckets], chars], axis=1)

    def table(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, forward then backward; row 0 is no word."""
        gates = np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)
        return np.concatenate([np.zeros((1, gates.shape[1]), dtype=np.float32), gates])

    def score_windows(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Window scores, a block of windows at a time."""
        out = np.empty(len(rows), dtype=np.float32)
        for at in range(0, len(rows), 4096):
            out[at : at + 4096] = self._block(table, rows[at : at + 4096])
        return out

    def _block(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        s, n = STATE, len(rows)
        read = np.stack([self.p["v"], self.p["w"]], axis=1)
        seen = np.zeros((WINDOW, n, 2), dtype=np.float32)
        steps = np.ascontiguousarray(rows.T)
        live = steps > 0
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            half = table[:, : 3 * s] if d == "f" else table[:, 3 * s :]
            half = np.ascontiguousarray(half)
            u, out = self.p[f"U{d}"], read[:s] if d == "f" else read[s:]
            h = np.zeros((n, s), dtype=np.float32)
            for t in order:
                own = half[steps[t]]
                g = h @ u
                zr = _sigmoid(own[:, : 2 * s] + g[:, : 2 * s])
                m = own[:, 2 * s :] + zr[:, s:] * g[:, 2 * s :]
                m *= 2
                m = _sigmoid(m)
                m *= 2
                m -= 1
                new = m + zr[:, :s] * (h - m)
                h = new if live[t].all() else np.where(live[t][:, None], new, h)
                seen[t] += h @ out
        weight = np.where(live, seen[:, :, 0], -np.inf)
        weight[0][~live[0]] = 0.0  # a window without words
        weight = np.exp(weight - weight.max(0))
        return (weight * seen[:, :, 1]).sum(0) / weight.sum(0) + self.p["b"][0]

    def gradients(self, x: np.ndarray, rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, parameter gradients and gradient of ``x`` (row 0 no word) for the windows."""
        s, n = STATE, len(rows)
        live = (rows.T > 0)[:, :, None]
        xs = x[rows.T]
        states, kept = np.zeros((WINDOW, n, 2 * s)), {}
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            own = xs @ self.p[f"W{d}"] + self.p[f"c{d}"]
            h = np.zeros((n, s))
            for t in order:
                g = h @ self.p[f"U{d}"]
                zr = 1 / (1 + np.exp(-np.clip(own[t, :, : 2 * s] + g[:, : 2 * s], -60, 60)))
                z, r = zr[:, :s], zr[:, s:]
                m = np.tanh(own[t, :, 2 * s :] + r * g[:, 2 * s :])
                kept[d, t] = (h, z, r, m, g[:, 2 * s :])
                h = np.where(live[t], m + z * (h - m), h)
                states[t][:, (slice(0, s) if d == "f" else slice(s, 2 * s))] = h
        att = np.where(live[:, :, 0], states @ self.p["v"], -np.inf)
        att[0][~live[0, :, 0]] = 0.0
        alpha = np.exp(att - att.max(0))
        alpha /= alpha.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -float((weight * (target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9))).sum() / n)
        up = weight * (prob - target) / n
        grads = {"w": pooled.T @ up, "b": np.array([up.sum()])}
        d_pooled = up[:, None] * self.p["w"]
        d_alpha = (states * d_pooled).sum(2)
        d_att = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        grads["v"] = (d_att[:, :, None] * states).sum((0, 1))
        d_states = alpha[:, :, None] * d_pooled + d_att[:, :, None] * self.p["v"]
        d_xs = np.zeros_like(xs, dtype=np.float64)
        for d, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            part = slice(0, s) if d == "f" else slice(s, 2 * s)
            u = self.p[f"U{d}"]
            du, d_own = np.zeros_like(u, dtype=np.float64), np.zeros((WINDOW, n, 3 * s))
            dh = np.zeros((n, s))
            for t in order:
                h, z, r, m, q = kept[d, t]
                dh = dh + d_states[t][:, part]
                new = np.where(live[t], dh, 0)
                dm = new * (1 - z) * (1 - m * m)
                dz = new * (h - m) * z * (1 - z)
                dr = dm * q * r * (1 - r)
                dg = np.concatenate([dz, dr, dm * r], axis=1)
                d_own[t] = np.concatenate([dz, dr, dm], axis=1)
                du += h.T @ dg
                dh = np.where(live[t], new * z + dg @ u.T, dh)
            grads[f"U{d}"] = du
            grads[f"c{d}"] = d_own.sum((0, 1))
            grads[f"W{d}"] = np.einsum("tni,tnj->ij", xs, d_own)
            d_xs += d_own @ self.p[f"W{d}"].T
        dx = np.zeros(x.shape)
        np.add.at(dx, rows.T, d_xs)
        return loss, grads, dx


class Lexicon:
    """Words of the training texts, once each, with their buckets and n-grams."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        ids, self.n_words = [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            own = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
            self.n_words[k] = len(own)
            ids.append(np.array(own, dtype=np.int64))
        self.ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        self.buckets, self.grams, self.counts = grams_of(list(number)) if number else (np.zeros(0, dtype=np.int64),) * 3
        self.first = np.cumsum(self.counts) - self.counts

    def pick(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, n-grams and counts of some words (numbers from 1)."""
        at = words - 1
        counts = self.counts[at]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.buckets[at], self.grams[np.repeat(self.first[at], counts) + inner], counts


def _log_odds(net: Network, lex: Lexicon, doc_of_word: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Starts the first number of every vector at how toxic its documents are; per word."""
    size = np.int64(len(lex.counts) + 1)
    pairs = np.unique(doc_of_word * size + lex.ids)
    toxic, word = label[pairs // size] == 1, pairs % size - 1
    # Documents that hold each word, by label; an n-gram has those of its words.
    docs = [np.bincount(word[toxic == y], minlength=len(lex.counts)).astype(np.float64) for y in (False, True)]
    total = [max(int((label == y).sum()), 1) for y in (0, 1)]

    def odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        return np.clip(np.log((n1 + 0.5) / total[1]) - np.log((n0 + 0.5) / total[0]), -4, 4).astype(np.float32)

    net.p["word"][:, 0] = odds(*[np.bincount(lex.buckets, weights=d, minlength=WORD_BUCKETS) for d in docs]) / 2
    net.p["char"][:, 0] = odds(*[np.bincount(lex.grams, weights=np.repeat(d, lex.counts), minlength=CHAR_BUCKETS) for d in docs])
    x = net.inputs(lex.buckets, lex.grams, lex.counts)
    return np.append(np.float32(0), x[:, 0] + x[:, WORD_DIM])


def train(texts: list[str], label: np.ndarray, seed: int = 7) -> Network:
    """A network fitted on whole texts with one label each."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if len(label) == 0 or label.min() == label.max():
        net.constant = float(label[0]) if len(label) else 0.0
        return net
    lex = Lexicon(texts)
    doc, start = window_starts(lex.n_words)
    rows = gather_windows(lex.ids, lex.n_words, doc, start)
    begin = np.searchsorted(doc, np.arange(len(texts)))
    score = _log_odds(net, lex, np.repeat(np.arange(len(texts)), lex.n_words), label)[rows].sum(1)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) ** 0.5
    moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch:
            score = net.score_windows(net.table(net.inputs(lex.buckets, lex.grams, lex.counts)), rows)
        top = np.lexsort((-score, doc))[begin]
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            words, back = np.unique(rows[top[some]], return_inverse=True)
            if words[0] != 0:
                words, back = np.append(0, words), back + 1
            buckets, grams, counts = lex.pick(words[1:])
            x = np.concatenate([np.zeros((1, WORD_DIM + CHAR_DIM), dtype=np.float32), net.inputs(buckets, grams, counts)])
            x[1:, :WORD_DIM] *= (drop := rng.random((len(x) - 1, 1)) >= WORD_DROPOUT)
            _, grads, dx = net.gradients(x, back.reshape(len(some), WINDOW), label[some], weight[some])
            dx = dx[1:]
            dx[:, :WORD_DIM] *= drop
            grads["word"], grads["char"] = np.zeros(net.p["word"].shape), np.zeros(net.p["char"].shape)
            np.add.at(grads["word"], buckets, dx[:, :WORD_DIM])
            spread = np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(counts, 1))[:, None], counts, axis=0)
            np.add.at(grads["char"], grams, spread)
            step += 1
            rate = RATE * (1 - step / (EPOCHS * -(-len(order) // BATCH) + 1))
            for k, g in grads.items():
                g = g + RIDGE * net.p[k]
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    score = net.score_windows(net.table(net.inputs(lex.buckets, lex.grams, lex.counts)), rows)
    net.curve = logistic(np.maximum.reduceat(score, begin).astype(np.float64), label)
    return net


class Scorer:
    """A worker's network with its table of known words."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1, 6 * STATE), dtype=np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        split = [words_of(t) for t in texts]
        if len(self.number) > TABLE_ROWS:
            self.clear()
        new = list({w for words in split for w in words}.difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number) + 1, len(self.number) + len(new) + 1), strict=True))
            self.table = np.concatenate([self.table, self.net.table(self.net.inputs(*grams_of(new)))[1:]])
        n_words = np.array([len(words) for words in split], dtype=np.int64)
        ids = np.fromiter((i for words in split for i in map(self.number.__getitem__, words)), dtype=np.int32, count=int(n_words.sum()))
        doc, start = window_starts(n_words)
        score = np.empty(len(doc), dtype=np.float64)
        for at in range(0, len(doc), 16_384):
            part = slice(at, at + 16_384)
            score[part] = self.net.score_windows(self.table, gather_windows(ids, n_words, doc[part], start[part]))
        top = np.maximum.reduceat(score, np.searchsorted(doc, np.arange(len(texts))))
        slope, begin = self.net.curve
        return 1 / (1 + np.exp(-np.clip(slope * top + begin, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Network:
    chosen = training_labels(labels, column, FOLDS, HELD, MAX_POSITIVE, 1).unionByName(
        training_labels(labels, column, FOLDS, HELD, MAX_NEGATIVE, 0)
    )
    rows = training_texts(docs, chosen, MAX_TRAINING_SIZE).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.int64))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score per row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(sent.value)
        for batch in batches:
            scores = [scorer.score(texts) for texts in portions(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"]
            )

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
