import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe, tokens
from marginalia.llm.common import tokenizer_path

ODD = [
    "", " ", "  a  b \n\n  c\t", "x<|endoftext|>y <|endoftext|> z", "aaaaaaa aa", "don't WE'LL I'd 's", "\x1c\x1d a\x1eb", "\x85 a\xa0b\u3000c\u2028d",
    "日本語🎉🎉", "é ́", "ſecret K", "\u180e x", "٣٤ ½ Ⅷ ²", "a\x00b", "ß" * 3000, "lorem ipsum " * 3000,
]


def texts():
    rng = random.Random(1)
    alphabet = "abAB 'sé\n\t\xa0\x1cß1²—🎉x.,!"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(800)]


def test_bytes_encode_and_decode_as_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    every = texts()
    for text, ids in zip(every, own.encode(every), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text[:50]
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_words_encode_as_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.encoder(path)
    every = [*texts(), "a<|startoftext|>b", "İI Σας ΟΔΟΣ", "e\u0301 a\u0308"]
    for text, ids in zip(every, own.encode(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    own = bpe.MergeRounds(tokenizer_path("byte_bpe_50k.json"))
    first = own.encode(["one two three four five six seven eight nine ten eleven twelve"])
    assert own.encode(["one two three four five six seven eight nine ten eleven twelve"]) == first
    own.encode(["other"])
    assert len(own.cache) <= 13


def test_round_trip(spark):
    rows = [(1, "Hello  World"), (2, None), (2, ""), (None, "x"), (3, "ab " * 50000), (1, "Hello  World")]
    frame = spark.createDataFrame([(i, t, 0, "d") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = bpe.round_trip(frame).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.decoded_sha256 for r in got) == sorted(sha(t) for _, t in rows)
    assert [r.n_tokens for r in got if r.doc_id == 2] == [0, 0]
    assert bpe.round_trip(frame.limit(0)).count() == 0


@pytest.mark.parametrize("word", [b"a", b"aaaa", bytes(range(256))])
def test_merge_of_one_word(word):
    own = bpe.codec(tokenizer_path("byte_bpe_50k.json"))
    (ids,) = own.merge([word])
    assert b"".join(own.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()) == word
