"""Ids of whole texts from a tokenizer whose tokens never span white space.

Texts of ASCII and Latin letters are lower-cased and cut into words by the tokenizer's
own pattern; words come again and again, so their ids are kept, up to ``CACHE_ENTRIES``
of them, and new ones go through the batched merge rounds. Other texts are cut at white
space, and new chunks go through the tokenizers library, as do whole texts with unusual
white space.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

import numpy as np

from marginalia.llm.bpe import CACHE_ENTRIES, SPACE, MergeRounds

#: White space on which Python and the tokenizer may differ; such texts are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\u180e\u200b\ufeff" + SPACE.replace("\t-\r ", "") + "]")
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(f"[\t-\r -~{_LETTER}]*")
# The tokenizer's word pattern, for such texts once lower-cased.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\t-\r {_LETTER}0-9]+")


class ChunkEncoder:
    def __init__(self, path: str):
        self.path = path
        self.rounds = MergeRounds(path)
        self.cache: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """Loaded for the first text that needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.no_padding()
        own.no_truncation()
        return own

    def _library(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, dtype="<u4").tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        known = self.rounds.known
        cut_up = [_WORDS.findall(t.lower()) for t in texts]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list(set().union(*cut_up).difference(known))
        known.update(zip(new, self.rounds.merge([w.encode() for w in new]), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in cut_up]

    def _by_chunks(self, text: str) -> bytes:
        chunks = text.split()
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = list(set(chunks).difference(self.cache))
        self.cache.update(zip(new, self._library(new), strict=True))
        return b"".join(map(self.cache.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        words = iter(self._by_words([t for t, p in zip(texts, plain, strict=True) if p]))
        return [
            next(words) if p else self._library([t])[0] if _ODD_SPACE.search(t) else self._by_chunks(t)
            for t, p in zip(texts, plain, strict=True)
        ]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
