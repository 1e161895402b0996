import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import packing
from marginalia.llm.common import tokenizer_path


def bins_of(packer):
    used = defaultdict(list)
    for length, lo, hi, sequence, copies, offset in packer.events:
        for q in range(lo, hi):
            used[sequence + (q - lo) // copies].append((offset + (q - lo) % copies * length, length))
    return used


def optimum(items, capacity):
    """Fewest bins by search over all partitions of a few items."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            go(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [capacity - items[k]])

    go(0, [])
    return best[0]


sizes = st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6)


@settings(max_examples=150, deadline=None)
@given(sizes)
def test_every_piece_once_without_gaps(counts):
    packer = packing.Packer(counts, 30).run()
    used = bins_of(packer)
    assert sorted(x for b in used.values() for _, x in b) == sorted(k for k, n in counts.items() for _ in range(n))
    assert len(used) == packer.sequences
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_reduction_keeps_the_optimum(items):
    counts = {x: items.count(x) for x in items}
    packer = packing.Packer(counts, 30)
    packer.reduce()
    left = [x for x in range(31) for _ in range(int(packer.left[x]))]
    assert packer.fixed + optimum(left, 30) == optimum(items, 30)


def test_interval_count_does_not_follow_the_corpus():
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in enumerate(rng.integers(0, 5, 4096), start=1) if v}
    small, large = (packing.Packer({k: v * m for k, v in counts.items()}).run() for m in (1, 1000))
    assert len(large.events) < 3 * len(small.events)
    assert large.sequences <= 1000 * small.sequences


ROWS = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 9000), (None, "x"), (1, "one two three"), (5, "y " * 4095), (6, "y " * 4096)]


def test_pack(spark):
    frame = spark.createDataFrame([(i, t, 0, "p") for i, t in ROWS], "doc_id long, text string, length int, part string")
    got = packing.pack(frame.repartition(3)).collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    wanted = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], dtype="<u4")
            wanted.append((i, k, at, len(own), zlib.crc32(own.tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(wanted, key=key)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(frame.limit(0)).count() == 0


def test_many_intervals_are_joined_by_ranges_of_ranks(spark, monkeypatch):
    frame = spark.createDataFrame([(i, "same text " * (1 + i % 3)) for i in range(40)], "doc_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.piece, r.sequence_id, r.offset, r.ids_crc32) for r in rows)
    pieces = packing.cut(packing.pieces(frame, tokenizer_path("word_bpe_49k.json"), 16), "pieces")
    wanted = key(packing.place(pieces, 16).collect())
    monkeypatch.setattr(packing, "MAX_BROADCAST_INTERVALS", 0)
    monkeypatch.setattr(packing, "RANKS", 3)
    assert key(packing.place(pieces, 16).collect()) == wanted and len(wanted) == 40
