"""The registered queries that SQL cannot express, over the small driver tables, against brute force."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import quality, queries, toxicity
from marginalia.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def toxic_score(net, text):
    """One document, window by window and word by word, as the network is defined."""
    words = toxicity.words_of(text)
    x = net.inputs(*toxicity.grams_of(words)).astype(np.float64) if words else np.zeros((0, 16))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    best = -np.inf
    start = 0
    while True:
        own = x[start : start + toxicity.WINDOW]
        states = []
        for d, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
            h, seen = np.zeros(toxicity.STATE), {}
            for t in order:
                gate = own[t] @ p[f"W{d}"] + p[f"c{d}"]
                past = h @ p[f"U{d}"]
                z, r = sigmoid(gate[:8] + past[:8]), sigmoid(gate[8:16] + past[8:16])
                m = np.tanh(gate[16:] + r * past[16:])
                h = (1 - z) * m + z * h
                seen[t] = h
            states.append([seen[t] for t in range(len(own))])
        if len(own):
            both = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
            weight = np.exp(both @ p["v"] - (both @ p["v"]).max())
            best = max(best, float((weight / weight.sum()) @ (both @ p["w"]) + p["b"][0]))
        else:
            best = max(best, float(p["b"][0]))
        if start + toxicity.WINDOW >= len(x):
            break
        start += toxicity.STRIDE
    slope, begin = net.curve
    return sigmoid(slope * best + begin)


def check_classifier(rows, wanted, module, sure=1e-3):
    assert len(rows) == len(wanted)
    for r in rows:
        assert r.held_out == held(r.doc_id, module.FOLDS, module.HELD)
        assert abs(r.score - wanted[r.doc_id]) < sure and r.predicted == (r.score >= 0.5)


def test_toxicity(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(docs, labels)
    short = [(i, t) for i, t in texts if len(t) < 6000]  # the word-by-word twin is slow; the query scores all
    short += sorted(texts, key=lambda x: len(x[1]))[-5:]
    rows = queries.op1_toxicity(spark, SF).collect()
    assert len(rows) == len(texts) and len(short) > 0.8 * len(texts)
    wanted = {i: toxic_score(net, t) for i, t in dict(short).items()}
    assert max(len(t) for _, t in short) == max(len(t) for _, t in texts) > 6000
    check_classifier([r for r in rows if r.doc_id in wanted], wanted, toxicity)


def good_score(field, text):
    """One document by the sum over paths of line labels, in logarithms."""
    features, chars, n_lines = quality.line_features([text])
    unary = field.unary(field.bins(features), n_lines)
    n = len(unary)
    emit = np.stack([np.zeros(n), unary], axis=1)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = emit[0]
    for t in range(1, n):
        ahead[t] = np.logaddexp(ahead[t - 1, 0] + field.tie[0], ahead[t - 1, 1] + field.tie[1]) + emit[t]
    for t in range(n - 2, -1, -1):
        after = behind[t + 1] + emit[t + 1]
        behind[t] = np.logaddexp(field.tie[:, 0] + after[0], field.tie[:, 1] + after[1])
    both = ahead + behind
    good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    weight = chars if chars.sum() else np.ones(n)
    m = np.clip((good * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    slope, start = field.curve
    return sigmoid(slope * np.log(m / (1 - m)) + start)


def test_quality(spark, texts):
    field = quality.fit(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    check_classifier(queries.op7_quality_classifier(spark, SF).collect(), {i: good_score(field, t) for i, t in texts}, quality, 1e-6)


def test_packing(spark, texts):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    wanted = set()
    for i, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], dtype="<u4")
            wanted.add((i, piece, at, len(own), zlib.crc32(own.tobytes())))
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    assert len(rows) == len(wanted) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == wanted
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    total = sum(r.length for r in rows)
    assert len(used) <= -(-total // 4096) + 1


def test_bpe(spark, texts):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    wanted = set()
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        own = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        wanted.add((i, len(ids), own, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    rows = queries.op6_bpe(spark, SF).collect()
    assert len(rows) == len(wanted) and {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == wanted


def test_chat(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", queries.PROBE), ("assistant", queries.PROBE)]
    rows = {r.conv_id: r for r in queries.op10_chat_formatting(spark, SF).collect()}
    assert rows.keys() == turns.keys()
    for i, own in turns.items():
        said = "".join(t for role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in own)
        r = rows[i]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest()), i
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()), i
        assert r.formatted_chars > sum(len(t) for _, t in own)
