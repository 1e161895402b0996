"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character classes,
lengths, repeats and word variety, each in quantile bins, of the line itself and of its
two neighbours; neighbouring labels are tied by transition weights. Forward-backward
marginals, weighted by line length, give a document's share of good text, and a logistic
curve turns that into a score.

The model is fitted in numpy on at most ``MAX_TRAINING_DOCS`` labelled documents of at
most ``MAX_TRAINING_SIZE`` in all, chosen by a hash of the id; a document's label stands
for all its lines. Line features are computed where the texts lie; only the sample's
features reach the driver.

Defined results: a null text counts as empty, which is one empty line; lines without
text count alike if all are; documents without a label, or with labels that disagree,
are not learnt from; of rows that repeat a doc_id one is learnt from; without both kinds
of label all scores are the share of good ones, or 1 if there is none; repeated rows
score alike; other columns pass ``keep_good``, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import operator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fresh_names, held_out, map_texts, own_columns, portions

FOLDS, HELD = 3, 1
MAX_TRAINING_DOCS = 4_000
#: Bound on all labelled texts that are learnt from: characters, and LINE_SIZE for a line.
MAX_TRAINING_SIZE, LINE_SIZE = 40_000_000, 100
BINS = 8
STEPS, RATE, RIDGE = 120, 0.15, 1e-3

FEATURES = (
    "log_length", "words", "word_length", "upper", "digits", "stops", "marks", "quotes", "bars", "symbols",
    "foreign", "runs", "repeated", "variety", "echoes", "controls",
)
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _MARK, _QUOTE, _BAR, _SYMBOL, _LEAD, _TAIL, _CONTROL = range(12)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, dtype=np.int64)
    table[:32], table[127], table[128:192], table[192:] = _CONTROL, _CONTROL, _TAIL, _LEAD
    for chars, kind in ((b" \t\n\r\x0b\x0c", _SPACE), (b".,;:", _STOP), (b"!?", _MARK), (b"'\"()-", _QUOTE), (b"|", _BAR)):
        table[list(chars)] = kind
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    return table


CLASS = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, characters per line, lines per text)."""
    split = [t.split("\n") for t in texts]
    n_lines = np.array([len(s) for s in split], dtype=np.int64)
    buf = np.frombuffer(("\n".join(texts) + "\n").encode(), dtype=np.uint8)
    is_end = buf == 10
    line = np.cumsum(is_end) - is_end
    n = int(n_lines.sum())
    kind = CLASS[buf]
    kind[is_end] = _SPACE
    counts = np.bincount(line * 12 + kind, minlength=12 * n).reshape(n, 12).astype(np.float64)
    counts[:, _SPACE] -= 1  # the line's end
    space = kind == _SPACE
    starts = ~space & np.append(True, space[:-1])
    words = np.bincount(line[starts], minlength=n).astype(np.float64)
    same = np.zeros(buf.size, dtype=bool)
    same[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & ~space[2:]
    runs = np.bincount(line[same], minlength=n).astype(np.float64)
    repeated, variety, echoes = np.zeros(n), np.ones(n), np.zeros(n)
    at = 0
    for lines in split:
        seen: set[str] = set()
        for own in lines:
            if own:
                if own in seen:
                    repeated[at] = 1.0
                seen.add(own)
                if words[at] > 1:
                    spoken = own.split()
                    variety[at] = len(set(spoken)) / words[at]
                    echoes[at] = sum(map(operator.eq, spoken, spoken[1:])) / words[at]
            at += 1
    chars = counts.sum(1) - counts[:, _TAIL]
    size = np.maximum(chars, 1.0)
    share = lambda k: counts[:, k] / size
    return (
        np.stack([
            np.log2(chars + 1), words, size / np.maximum(words, 1), share(_UPPER), share(_DIGIT), share(_STOP),
            share(_MARK), share(_QUOTE), share(_BAR), share(_SYMBOL), share(_LEAD), runs / size, repeated, variety, echoes,
            share(_CONTROL),
        ], axis=1).astype(np.float32),
        chars, n_lines,
    )


class Chains:
    """Lines of several documents, so that step t of all that are long enough is one slice."""

    def __init__(self, n_lines: np.ndarray):
        self.n_lines = n_lines
        self.first = np.cumsum(n_lines) - n_lines
        self.order = np.argsort(-n_lines, kind="stable")
        by_size = n_lines[self.order]
        self.steps = int(by_size[0]) if by_size.size else 0
        self.alive = np.searchsorted(-by_size, -np.arange(self.steps), side="left")
        self.heads = self.first[self.order]

    def step(self, t: int) -> np.ndarray:
        """Line numbers of step t."""
        return self.heads[: self.alive[t]] + t

    def marginals(self, unary: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) per line and expected transitions (2 x 2). unary: log-odds of good."""
        emit = np.stack([1 / (1 + np.exp(unary)), 1 / (1 + np.exp(-unary))], axis=1)
        move = np.exp(tie - tie.max())
        forward = np.empty_like(emit)
        for t in range(self.steps):
            at = self.step(t)
            a = emit[at] if t == 0 else (forward[at - 1] @ move) * emit[at]
            forward[at] = a / a.sum(1, keepdims=True)
        good = np.empty(len(emit))
        pairs = np.zeros((2, 2))
        backward = np.ones((0, 2))
        for t in range(self.steps - 1, -1, -1):
            at = self.step(t)
            b = np.ones((len(at), 2))
            if t + 1 < self.steps:
                nxt = self.step(t + 1)
                ahead = emit[nxt] * backward
                joint = forward[nxt - 1][:, :, None] * move * ahead[:, None, :]
                total = joint.sum((1, 2), keepdims=True)
                pairs += (joint / total).sum(0)
                grown = ahead @ move.T
                b[: len(nxt)] = grown / grown.sum(1, keepdims=True)
            both = forward[at] * b
            good[at] = both[:, 1] / both.sum(1)
            backward = b
        return good, pairs


def neighbours(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the line before and after it in its document, or -1."""
    n = int(n_lines.sum())
    before, after = np.arange(n) - 1, np.arange(n) + 1
    first = np.cumsum(n_lines) - n_lines
    before[first] = -1
    after[first + n_lines - 1] = -1
    return before, after


class LineField:
    """The fitted model; small, and sent to the tasks as it is."""

    def __init__(self, edges: list[np.ndarray], prior: float):
        self.edges = edges
        self.weights = np.zeros((3, len(FEATURES), BINS + 1))
        self.bias, self.tie = 0.0, np.zeros((2, 2))
        self.curve = (0.0, prior)

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def unary(self, bins: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        own = [self.weights[k][np.arange(len(FEATURES)), bins].sum(1) for k in range(3)]
        out = self.bias + own[0]
        for k, side in enumerate(neighbours(n_lines), start=1):
            out = out + np.where(side >= 0, own[k][side], 0.0)
        return out

    def share(self, features: np.ndarray, chars: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted share of good text, per document."""
        good, _ = Chains(n_lines).marginals(self.unary(self.bins(features), n_lines), self.tie)
        first = np.cumsum(n_lines) - n_lines
        total = np.add.reduceat(chars, first)
        weight = np.where(np.repeat(total, n_lines) > 0, chars, 1.0)
        m = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        m = np.clip(m, 1e-6, 1 - 1e-6)
        return np.log(m / (1 - m))

    def score(self, texts: list[str]) -> np.ndarray:
        slope, start = self.curve
        z = slope * self.share(*line_features(texts)) + start
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def learn(self, features: np.ndarray, chars: np.ndarray, n_lines: np.ndarray, good: np.ndarray) -> LineField:
        """Ascends the conditional likelihood of the lines' labels by Adam steps."""
        bins, chains = self.bins(features), Chains(n_lines)
        label = np.repeat(good.astype(np.float64), n_lines)
        balance = np.where(label > 0, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
        before, after = neighbours(n_lines)
        seen = np.zeros((2, 2))
        inner = before >= 0
        np.add.at(seen, (label[before[inner]].astype(int), label[inner].astype(int)), 1.0)
        at = bins + np.arange(len(FEATURES)) * (BINS + 1)
        flat = len(FEATURES) * (BINS + 1)

        def gradient(residual):
            parts = [residual]
            for side in (before, after):
                # A line's residual also falls on the weights of the neighbour it looks at.
                moved = np.zeros_like(residual)
                ok = side >= 0
                np.add.at(moved, side[ok], residual[ok])
                parts.append(moved)
            return np.stack([
                np.bincount(at.ravel(), weights=np.repeat(p, len(FEATURES)), minlength=flat).reshape(len(FEATURES), BINS + 1)
                for p in parts
            ])

        state = [np.zeros_like(self.weights), 0.0, np.zeros((2, 2))]
        speed = [np.zeros_like(self.weights), 0.0, np.zeros((2, 2))]
        n = len(label)
        for step in range(1, STEPS + 1):
            marginal, pairs = chains.marginals(self.unary(bins, n_lines), self.tie)
            residual = (label - marginal) * balance
            grads = [gradient(residual) / n - RIDGE * self.weights, residual.mean(), (seen - pairs) / n - RIDGE * self.tie]
            for k, g in enumerate(grads):
                state[k] = 0.9 * state[k] + 0.1 * g
                speed[k] = 0.99 * speed[k] + 0.01 * g * g
                move = RATE * (state[k] / (1 - 0.9**step)) / (np.sqrt(speed[k] / (1 - 0.99**step)) + 1e-8)
                if k == 0:
                    self.weights = self.weights + move
                elif k == 1:
                    self.bias += float(move)
                else:
                    self.tie = np.clip(self.tie + move, -3, 3)
        self.curve = logistic(self.share(features, chars, n_lines), good)
        return self


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and start of the ridged logistic curve through (x, y)."""
    design = np.stack([x / max(np.abs(x).max(), 1e-9), np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(hess, design.T @ (y - p) - 1e-2 * w)
    return float(w[0] / max(np.abs(x).max(), 1e-9)), float(w[1])


def training_labels(
    labels: DataFrame, column: str, folds: int, fold: int, most: int, only: int | None = None
) -> DataFrame:
    """doc_id, label: at most ``most`` rows outside the held-out fold, chosen by a hash."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(column).cast("int").alias("label"), F.max(column).alias("high"))
        .filter("label = high" if only is None else f"label = high AND label = {only}").select("doc_id", "label")
    )
    n = known.count()
    share = int((1 << 20) * min(1.0, 1.1 * most / max(n, 1)))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    return known.filter(drawn < share).orderBy(drawn, "doc_id").limit(most)


def training_texts(docs: DataFrame, chosen: DataFrame, most_size: int) -> DataFrame:
    """doc_id, label, text of the chosen documents (doc_id, label), one row per doc_id.

    Of rows that repeat a doc_id the text with the least hash counts. Texts are taken in
    order of the id's hash while their sizes (characters, and ``LINE_SIZE`` for every line)
    add up to ``most_size`` at most; one that does not fit any more is not learnt from.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    sizes = (
        rows.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", F.struct("key", (F.length("text") + LINE_SIZE * lines).cast("long").alias("size")).alias("own"))
        .groupBy("doc_id", "label").agg(F.min("own").alias("own"))
        .select("doc_id", "label", "own.key", "own.size", F.xxhash64("doc_id").alias("drawn")).collect()
    )
    picked, room = [], most_size
    for r in sorted(sizes, key=lambda r: (r["drawn"], r["doc_id"])):
        if r["size"] <= room:
            room -= r["size"]
            picked.append((r["doc_id"], r["key"], r["label"]))
    named = docs.sparkSession.createDataFrame(picked, "doc_id long, key long, label int")
    return rows.join(F.broadcast(named), ["doc_id", "key"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MAX_TRAINING_DOCS) -> LineField:
    """The model for ``column`` of ``labels``; at most ``most`` documents are learnt from."""
    chosen = training_labels(labels, column, FOLDS, HELD, most)

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            labels_of = iter(batch.column(0).to_pylist())
            for texts in portions(batch.column(1)):
                own, chars, n_lines = line_features(texts)
                stops = np.cumsum(n_lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(labels_of) for _ in texts], pa.int32()),
                     pa.array([own[b - n : b].tobytes() for b, n in zip(stops, n_lines, strict=True)], pa.binary()),
                     pa.array([chars[b - n : b].tobytes() for b, n in zip(stops, n_lines, strict=True)], pa.binary())],
                    names=["label", "features", "chars"],
                )

    texts = training_texts(docs, chosen, MAX_TRAINING_SIZE).select("label", "text")
    rows = map_texts(texts, features, "label int, features binary, chars binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))  # the same sums in every run
    good = np.array([r["label"] for r in rows], dtype=np.float64)
    if good.size == 0 or good.min() == good.max():
        share = float(good.mean()) if good.size else 1.0
        return LineField([np.zeros(0)] * len(FEATURES), 30.0 if share >= 0.5 else -30.0)
    lines = [np.frombuffer(r["features"], dtype=np.float32).reshape(-1, len(FEATURES)) for r in rows]
    own = np.concatenate(lines)
    chars = np.concatenate([np.frombuffer(r["chars"], dtype=np.float64) for r in rows])
    edges = [np.unique(np.quantile(own[:, f], np.linspace(0, 1, BINS + 1)[:-1])).astype(np.float32) for f in range(own.shape[1])]
    # Shares are often zero: bins above zero come from the lines that have any.
    for f, e in enumerate(edges):
        if e.size < BINS // 2 and (some := own[own[:, f] > 0, f]).size:
            edges[f] = np.unique(np.append(np.float32(0), np.quantile(some, np.linspace(0, 1, BINS)[1:-1]))).astype(np.float32)
    return LineField(edges, 0.0).learn(own, chars, np.array([len(x) for x in lines]), good)


def score(docs: DataFrame, model: LineField) -> DataFrame:
    """doc_id, score per row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [model.score(texts) for texts in portions(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"]
            )

    return map_texts(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double"
    )


def keep_good(docs: DataFrame, model: LineField) -> DataFrame:
    """The rows that score one half or more, with all their columns."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [model.score(texts) for texts in portions(batch.column(batch.num_columns - 1))]
            keep = np.concatenate(scores) >= 0.5 if scores else np.zeros(0, dtype=bool)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    (text,) = fresh_names(docs, "text_")
    return map_texts(docs.select(*own_columns(docs), F.col("text").cast("string").alias(text)), run, docs.schema)
