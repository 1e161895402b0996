"""Leak scanning: hashed n-grams against a denylist, and privacy shapes."""

from __future__ import annotations

import hashlib
import operator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.unicode import plain_tokens, tokens
from marginalia.scratch import cut, temporary
from marginalia.sketch import hash_bitmap

LONGEST = 12
#: Words of a text whose runs a task holds at a time.
WORDS_AT_ONCE = 100_000
#: Rows that leave a task in one batch.
HITS_AT_ONCE = 10_000
#: Bits of a bitmap of phrases; 32 MB.
PHRASE_BITS = 1 << 28
# Shapes of what must not be published, what they are called, and mail
# domains and addresses that belong to nobody.
MACHINE_PATH = r"(?i)(?<![a-z0-9])[a-z]:\\(?:users|projects)\\[^\s\"']+"
HOME_PATH = r"(?<![a-z0-9])/(?:home|users)/[^/\s]+/"
PRIVATE_ADDRESS = (
    r"(?<!\d)(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|"
    r"172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})(?!\d)"
)
LOCAL_ENDPOINT = r"(?i)(?:https?://)?(?:localhost|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3}|\[?::1\]?)(?::\d+)?(?:[/?#]|\b)"
SECRET_SHAPE = r"(?i)\b(?:sk|key|token|secret)[-_][a-z0-9]{16,}\b"
KNOWN_CREDENTIAL = (
    r"(?:-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----|\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|"
    r"\bgithub_pat_[A-Za-z0-9_]{40,}\b|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b)"
)
EMAIL = r"(?i)\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}\b"
SAFE_DOMAINS = (".example", ".invalid", "example.com", "example.org", "example.net", "users.noreply.github.com")
SAFE_ADDRESSES = ("noreply@github.com", "support@github.com")


@dataclass(frozen=True)
class Shape:
    """Values that give something away, and what a finding of them says."""

    says: str
    patterns: tuple[str, ...]
    safe_endings: tuple[str, ...] = ()
    safe_values: tuple[str, ...] = ()

    def found_in(self, text: Column) -> Column:
        if not self.safe_endings and not self.safe_values:
            return reduce(operator.or_, [text.rlike(p) for p in self.patterns])
        values = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in self.patterns]))
        harmless = lambda v: reduce(operator.or_, [v.isin(*self.safe_values), *map(v.endswith, self.safe_endings)])
        return F.exists(values, lambda v: ~harmless(F.lower(v)))


SHAPES = (
    Shape("absolute machine path", (MACHINE_PATH, HOME_PATH)),
    Shape("private network endpoint", (PRIVATE_ADDRESS, LOCAL_ENDPOINT)),
    Shape("credential-shaped value", (SECRET_SHAPE, KNOWN_CREDENTIAL)),
    Shape("non-placeholder email address", (EMAIL,), SAFE_DOMAINS, SAFE_ADDRESSES),
)


def grams(words: Column, longest: int = LONGEST) -> Column:
    """Distinct runs of 1 to ``longest`` words of an array, joined by a space."""

    def run(w: Column) -> Column:
        n = F.size(w)
        of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), n))
        return F.when(n > 0, F.array_distinct(F.flatten(F.transform(sizes, of)))).otherwise(F.array().cast("array<string>"))

    return T.bound(words, run)


def gram_hashes(texts: DataFrame, key: str, words: Column | None = None, longest: int = LONGEST) -> DataFrame:
    """key, sha256 of every distinct n-gram of the normalised tokens."""
    words = tokens(F.col("text")) if words is None else words
    return texts.select(key, words.alias("__w")).select(key, F.explode(grams(F.col("__w"), longest)).alias("gram")).select(
        key, F.sha2("gram", 256).alias("sha256")
    )


def _in_chunks(rows, schema):
    """Arrow batches of at most ``HITS_AT_ONCE`` of the tuples that ``rows`` gives."""
    import pyarrow as pa

    while chunk := list(islice(rows, HITS_AT_ONCE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), schema, strict=True)], schema=schema)


def _hits(texts: DataFrame, key: str, find, what: str) -> DataFrame:
    """key, place and a string named ``what``: what ``find`` yields of the words of texts and of names.

    What is found leaves the task in batches of a bounded number of rows.
    """
    asked = texts.select(F.col(key).alias("key_"), F.col(key).cast("string").alias("name_"), "text")
    own = texts.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def found(batch):
            for at in range(batch.num_rows):
                name, as_text, text = (batch.column(c)[at].as_py() for c in range(3))
                for place, said in (("text", text), ("path", as_text)):
                    for one in find(plain_tokens(said or "")):
                        yield name, place, one

        for batch in batches:
            yield from _in_chunks(found(batch), pa.schema([(key, batch.schema.field(0).type), ("place", pa.string()), (what, pa.string())]))

    return asked.mapInArrow(run, f"{key} {own}, place string, {what} string")


def _portions(words: list[str], longest: int):
    """The words in portions that overlap so that no run of ``longest`` is cut, and how many runs start in each."""
    for at in range(0, len(words), WORDS_AT_ONCE):
        yield words[at : at + WORDS_AT_ONCE + longest - 1], min(WORDS_AT_ONCE, len(words) - at)


def denied(texts: DataFrame, denylist: DataFrame, key: str = "path", longest: int = LONGEST) -> DataFrame:
    """key, place (text or path), sha256: n-grams of texts or names that the denylist holds.

    Hashes are taken where the texts are: every start's digests grow word by word. A bitmap
    of the denylist, of bounded size, lets few of them out of the task; those alone are
    shuffled, to the denylist itself, which may be of any size.
    """
    denylist = denylist.select("sha256").filter("sha256 IS NOT NULL").distinct()
    held = texts.sparkSession.sparkContext.broadcast(
        hash_bitmap(denylist.select(F.conv(F.left("sha256", F.lit(16)), 16, -10).cast("long").alias("h")), denylist.count())
    )

    def find(words: list[str]):
        found = set()
        for portion, starts in _portions(words, longest):
            raw = [w.encode() for w in portion]
            digests = []
            for i in range(starts):
                grown = hashlib.sha256()
                for k, word in enumerate(raw[i : i + longest]):
                    grown.update(b" " + word if k else word)
                    digests.append(grown.digest())
            heads = np.frombuffer(b"".join(d[:8] for d in digests), dtype=">i8").astype(np.int64)
            found.update(digests[k].hex() for k in np.flatnonzero(held.value.holds(heads)).tolist())
        return found

    return _hits(texts, key, find, "sha256").join(denylist, "sha256", "left_semi").select(key, "place", "sha256").distinct()


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 200_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(run: np.ndarray) -> np.ndarray:
    mixed = (run ^ (run >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def run_hashes(hashes: np.ndarray, lengths=range(1, LONGEST + 1)):
    """For each of ``lengths``: a 64-bit hash of every run of so many words, each from the shorter ones."""
    run = np.zeros(hashes.size, dtype=np.uint64)
    for n in range(1, min(max(lengths, default=0), hashes.size) + 1):
        run = run[: hashes.size - n + 1] * _BASE + hashes[n - 1 :] + np.uint64(1)
        if n in lengths:
            yield n, _mixed(run)


def phrase_hashes(phrases: list[list[str]], known: dict[str, int]) -> np.ndarray:
    """The hash of each list of words as one run."""
    sizes = np.array([len(p) for p in phrases], dtype=np.int64)
    words = _word_hashes([w for p in phrases for w in p], known)
    starts, run = np.cumsum(sizes) - sizes, np.zeros(sizes.size, dtype=np.uint64)
    for k in range(sizes.max(initial=0)):
        longer = np.flatnonzero(sizes > k)
        run[longer] = run[longer] * _BASE + words[starts[longer] + k] + np.uint64(1)
    return _mixed(run)


def word_runs(texts: DataFrame, n: int = LONGEST) -> DataFrame:
    """phrase: every run of ``n`` words of texts (text), once a text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = (plain_tokens(t.as_py() or "") for t in batch.column(0))
            runs = ((p,) for w in words for p in dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))
            yield from _in_chunks(runs, pa.schema([("phrase", pa.string())]))

    return texts.select("text").mapInArrow(run, "phrase string")


def _hashed(phrases: DataFrame, longest: int) -> DataFrame:
    """phrase, size, h of the phrases' normalised words, if they are 1 to ``longest``."""

    def run(batches):
        import pyarrow as pa

        known: dict[str, int] = {}
        for batch in batches:
            words = [w for w in (plain_tokens(p.as_py() or "") for p in batch.column(0)) if 0 < len(w) <= longest]
            columns = [pa.array([" ".join(w) for w in words], pa.string()), pa.array([len(w) for w in words], pa.int32()), pa.array(phrase_hashes(words, known))]
            yield pa.RecordBatch.from_arrays(columns, names=["phrase", "size", "h"])

    return phrases.select("phrase").mapInArrow(run, "phrase string, size int, h long")


def denied_phrases(texts: DataFrame, phrases: DataFrame, key: str = "path", longest: int = LONGEST, most: int = PHRASE_BITS) -> DataFrame:
    """key, place, phrase: phrases of up to ``longest`` words that texts or names hold.

    phrases: phrase, whose normalised words count. The lengths that phrases have are hashed
    in one pass over a text's words, and a bitmap of the phrases, of ``most`` bits, decides
    what is compared with them. Where there are too many phrases for the bitmap to tell much,
    a pass before this one sends hashes alone to the phrases, and only those that some text
    seems to hold are looked for as phrases.
    """
    with temporary() as keep:
        wanted = cut(_hashed(phrases, longest).distinct(), "phrases")
        n = wanted.count()
        if 8 * n > most:
            held = _runs_held(texts, key, _sent(wanted, n, most))
            wanted = cut(wanted.join(held, "h", "left_semi"), "phrases")
            n = wanted.count()
        lengths, bitmap = _sent(wanted, n, most)
        known: dict[str, int] = {}

        def find(words: list[str]):
            found = set()
            for portion, starts in _portions(words, max(lengths, default=1)):
                for k, runs in run_hashes(_word_hashes(portion, known), lengths):
                    found.update(" ".join(portion[i : i + k]) for i in np.flatnonzero(bitmap.value.holds(runs[:starts])).tolist())
            return found

        found = _hits(texts, key, find, "phrase").join(wanted, "phrase", "left_semi").select(key, "place", "phrase").distinct()
        return keep(cut(found, "denied"))


def _sent(phrases: DataFrame, n: int, most: int):
    """The lengths of the phrases (size, h), and a bitmap of their hashes for every task."""
    lengths = [r[0] for r in phrases.select("size").distinct().collect()]
    return lengths, phrases.sparkSession.sparkContext.broadcast(hash_bitmap(phrases.select("h"), n, most, probes=4))


def _runs_held(texts: DataFrame, key: str, sent) -> DataFrame:
    """h: distinct hashes of the runs of texts and names that the bitmap holds."""
    lengths, bitmap = sent

    def run(batches):
        import pyarrow as pa

        known: dict[str, int] = {}
        for batch in batches:
            for said in (said.as_py() for column in batch.columns for said in column):
                for portion, starts in _portions(plain_tokens(said or ""), max(lengths, default=1)):
                    for _, runs in run_hashes(_word_hashes(portion, known), lengths):
                        runs = runs[:starts]
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(runs[bitmap.value.holds(runs)]))], names=["h"])

    return texts.select(F.col(key).cast("string").alias("name_"), "text").mapInArrow(run, "h long").distinct()


def privacy_findings(text: Column) -> Column:
    """Array of what a text gives away, without the values themselves."""
    return F.array_compact(F.array(*[F.when(shape.found_in(text), F.lit(shape.says)) for shape in SHAPES]))
