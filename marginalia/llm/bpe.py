"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks up every adjacent pair
by binary search over the sorted pair keys, takes each word's lowest rank and merges all
its occurrences; words without a mergeable pair leave the array. Words are cut out of
white-space chunks, whose ids are kept in a bounded cache.

Defined results: null counts as empty, which has no tokens; a special token's string in
a text is that token; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import map_texts, portions, tokenizer_path

# Unicode white space, and the tokenizer's word pattern over it.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Chunks a worker keeps the ids of.
CACHE_ENTRIES = 200_000
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

# The same pattern for texts of ASCII and Latin letters alone, where its classes are short.
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
PLAIN = re.compile(f"[\t-\r -~{LETTER}]*")
PLAIN_WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+"
    rf"| ?[^\t-\r {LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MergeRounds:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        # Where the pairs of single bytes stand, looked up once: most pairs of a first round.
        single = np.concatenate([self.first, self.last])
        self.opening = self._find((single[:, None] * self.size + single).ravel())
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t.removesuffix(suffix)) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(WORD).findall
        self.cache: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted pair keys, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian unsigned 32-bit bytes."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        code = flat.astype(np.int64)
        code[np.cumsum(sizes) - 1] += 256  # the last byte of a word
        sym = np.where(code < 256, self.first[flat], self.last[flat])
        none = np.iinfo(np.int64).max
        pair, rank = np.zeros(sym.size, dtype=np.int64), np.full(sym.size, none)
        look = np.arange(sym.size)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while sym.size:
            # Only pairs next to a merged symbol are new; the others keep their rank.
            look = look[look < sym.size - 1]
            if code is not None:
                at, code = self.opening[code[:-1] * 512 + code[1:]], None
            else:
                at = self._find(sym[look] * self.size + sym[look + 1])
            hit = (at >= 0) & (word[look] == word[look + 1])
            pair[look], rank[look] = at, np.where(hit, self.ranks[at], none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, sym.size)))
            done = low == none
            if done.any():
                ready.append((word[done], sym[done]))
            # Of overlapping occurrences (a run of one letter) every second one merges.
            where = np.flatnonzero((rank == low) & ~done)
            fresh = np.append(True, np.diff(where) != 1)[: where.size]
            run_start = where[np.maximum.accumulate(np.where(fresh, np.arange(where.size), 0))]
            where = where[(where - run_start) % 2 == 0]
            sym[where] = self.merged[pair[where]]
            changed = np.zeros(sym.size, dtype=bool)
            changed[where] = True
            keep = ~done
            keep[where + 1] = False
            sym, word, pair, rank, changed = sym[keep], word[keep], pair[keep], rank[keep], changed[keep]
            if sym.size:
                rank[-1] = none
                look = np.flatnonzero(changed | np.append(changed[1:], False))
                rank[look] = none
        owner = np.concatenate([w for w, _ in ready])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate([x for _, x in ready])[order].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [ids[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def ids_of(self, words: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words; new words are merged together."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list({w for ws in words for w in ws}.difference(self.known))
        self.known.update(zip(new, self.merge(new), strict=True))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]

    def _chunks(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return _CHUNK.findall(text)
        chunks: list[str] = []
        for part in self.split_special.split(text):
            chunks += [part] if part in self.special else _CHUNK.findall(part)
        return chunks

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        plain = [bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        cut_up = [PLAIN_WORD.findall(t) if p else self._chunks(t) for t, p in zip(texts, plain, strict=True)]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        # A plain text's word and another text's chunk of the same letters have the same ids.
        words = list(set().union(*[ws for ws, p in zip(cut_up, plain, strict=True) if p]).difference(self.cache))
        self.cache.update(zip(words, self.merge([w.encode() for w in words]), strict=True))
        new = list(set().union(*[cs for cs, p in zip(cut_up, plain, strict=True) if not p]).difference(self.cache))
        parts = [[w.encode() for w in self.words(c)] if c not in self.special else [] for c in new]
        self.cache.update(zip(new, self.ids_of(parts), strict=True))
        for chunk in self.special.keys() & new:
            self.cache[chunk] = np.array([self.special[chunk]], dtype="<u4").tobytes()
        return [b"".join(map(self.cache.__getitem__, chunks)) for chunks in cut_up]

    def decode(self, ids: bytes) -> str:
        found = map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(found).decode("utf-8", errors="replace")


_LOADED: dict[str, MergeRounds] = {}


def codec(path: str) -> MergeRounds:
    if path not in _LOADED:
        _LOADED[path] = MergeRounds(path)
    return _LOADED[path]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for texts in portions(batch.column(1)):
                for ids in own.encode(texts):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
