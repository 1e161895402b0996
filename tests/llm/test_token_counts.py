import os
import random

import pytest
from tokenizers import Tokenizer

from marginalia.llm import queries
from marginalia.llm import token_counts as c
from marginalia.llm.bpe import codec
from marginalia.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n\n\t x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "naïve café", "日本語のテキスト です", "🙂🙂 x", "it's we'll I'M",
    "x" * 5000, "don't  stop   now\r\n", "\x00\x01", "a　b c d", "1234567890 12.5%", "ﬁ ſ ß İ", "é ्",
]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_one_token_in_the_library(path, library):
    whole = sorted(c.whole_tokens(codec(path)))
    assert len(whole) > 45_000 and "<|endoftext|>" not in whole
    assert set(library(whole)) == {1}


def test_vocabulary_strings_that_are_not_whole(path, library):
    own = codec(path)
    whole = c.whole_tokens(own)
    texts = [raw.decode() for raw in own.bytes_of.values() if raw.decode(errors="ignore").encode() == raw]
    single = [t for t in texts if len(own.words(t)) == 1 and t not in own.special]
    assert [t for t, n in zip(single, library(single), strict=True) if (n == 1) != (t in whole)] == []


def test_counts_equal_the_library(spark, library):
    rng = random.Random(3)
    alphabet = "abc deEtaoin   \n\t.,'0129äé字🙂"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(200)]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(7, "again", "x", 1), (7, "again", "x", 1), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, whole int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in c.count_tokens(frame, limit=50).collect()), key=repr)
    want = [(i, len((t or "").encode()), n, n > 50) for (i, t, *_), n in zip(rows, library([t or "" for _, t, *_ in rows]), strict=True)]
    assert got == sorted(want, key=repr)


def test_pieces_change_no_count(path, library):
    rng = random.Random(5)
    counter = c.TokenCounter(codec(path), c.whole_tokens(codec(path)))
    for _ in range(100):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", "  ", "<|endoftext|>", "9", "é"]) for _ in range(80))
        cut = list(c.pieces(text, 7))
        assert "".join(cut) == text
        assert sum(n for n, _ in counter.count(cut)) == library([text])[0]
    assert list(c.pieces("x" * 30, 7)) == ["x" * 30]


def test_most_words_are_looked_up(spark):
    frame = spark.createDataFrame([(1, "The people of the city would often speak about their history " * 50)], "doc_id long, text string")
    row = c.count_tokens(frame).first()
    assert row.n_whole == row.n_tokens == 551  # the last space is a pre-token, too


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_registered_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(docs, library(list(docs.values())), strict=True))
    rows = queries.QUERIES["op13_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    assert all(r.over_limit == (r.n_tokens > 1024) and r.n_bytes == len(docs[r.doc_id].encode()) for r in rows)


def test_empty_table(spark):
    assert c.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
