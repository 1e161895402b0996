"""Token counts of whole texts, most of them without a merge.

The proof is made once, before any text is read: every string of the vocabulary goes
through the merge rounds by itself, and those that come out as one token are whole. BPE
encodes a pre-token by itself, so a pre-token that equals a whole string is one token
wherever it stands and is counted by looking it up. Only the other pre-tokens are merged,
each distinct one once as long as a bounded cache holds it.

Long texts are counted in pieces that end before white space behind another character,
which no pre-token spans, so a worker never holds the pre-tokens of a whole long text.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special token's string
in a text is that one token; rows that repeat a doc_id are counted one by one; a null
doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import filterfalse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe import CACHE_ENTRIES, PLAIN, PLAIN_WORD, SPACE, MergeRounds, codec
from marginalia.llm.common import PORTION, map_texts, tokenizer_path

#: Tokens above which a text is over the limit, unless the caller names a number.
LIMIT = 1024

_EDGE = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def whole_tokens(own: MergeRounds) -> frozenset[str]:
    """Vocabulary strings that alone give one token, each shown by merging it.

    Bytes that are no text of their own (part of a character) cannot equal a pre-token.
    """
    strings = {}
    for raw in own.bytes_of.values():
        try:
            strings[raw.decode()] = raw
        except UnicodeDecodeError:
            continue
    strings = {t: raw for t, raw in strings.items() if raw and t not in own.special}
    ids = own.merge(list(strings.values()))
    return frozenset(t for t, found in zip(strings, ids, strict=True) if len(found) == 4)


def pieces(text: str, size: int = PORTION) -> Iterator[str]:
    """The text in pieces of ``size`` characters or a little more; one without white space stays whole."""
    at = 0
    while len(text) - at > size and (edge := _EDGE.search(text, at + size)):
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:]


class TokenCounter:
    def __init__(self, own: MergeRounds, whole: frozenset[str]):
        self.own, self.whole = own, whole
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand between them."""
        own = self.own
        if not any(s in text for s in own.special):
            return (PLAIN_WORD.findall(text) if PLAIN.fullmatch(text) else own.words(text)), 0
        found, special = [], 0
        for part in own.split_special.split(text):
            if part in own.special:
                special += 1
            else:
                found += own.words(part)
        return found, special

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens that were looked up) of each text."""
        cut_up = [self.pre_tokens(t) for t in texts]
        rest = [list(filterfalse(self.whole.__contains__, words)) for words, _ in cut_up]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*rest).difference(self.known))
        merged = self.own.merge([w.encode() for w in new])
        self.known.update((w, len(ids) // 4) for w, ids in zip(new, merged, strict=True))
        out = []
        for (words, special), others in zip(cut_up, rest, strict=True):
            looked_up = len(words) - len(others)
            out.append((looked_up + special + sum(map(self.known.__getitem__, others)), looked_up))
        return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row, and n_whole, the pre-tokens looked up."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    sent = docs.sparkSession.sparkContext.broadcast(whole_tokens(codec(path)))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = TokenCounter(codec(path), sent.value)
        for batch in batches:
            tokens, looked_up = [0] * batch.num_rows, [0] * batch.num_rows
            rows, own, held = [], [], 0

            def settle():
                for row, (n, whole) in zip(rows, counter.count(own), strict=True):
                    tokens[row] += n
                    looked_up[row] += whole

            for row, text in enumerate(batch.column(1)):
                for piece in pieces(text.as_py() or ""):
                    rows.append(row)
                    own.append(piece)
                    held += len(piece)
                    if held >= PORTION:
                        settle()
                        rows, own, held = [], [], 0
            settle()
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()), n,
                 pc.greater(n, limit), pa.array(looked_up, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long"
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
