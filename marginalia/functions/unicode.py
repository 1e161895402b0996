"""Unicode forms and free JSON.

Texts of ASCII and of letters of Latin-1, which compatibility forms leave alone but for
accents, are done by expressions in the JVM. Only other texts are sent to Python, as Arrow
batches; of plain ones it sees a null. Both ways give the same.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marginalia.functions import text as T

#: Share of letters that must be ASCII, and shortest comparable key.
RETENTION, SHORTEST_KEY = 0.80, 25
_FOLDED = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'} | {chr(c): "-" for c in range(0x2010, 0x2016)})


def normalised(text: str) -> str:
    """The form in which quotation and source are compared."""
    composed = unicodedata.normalize("NFKC", text)
    joined = re.sub("\xad\\s*", "", composed).translate(_FOLDED)
    return re.sub(r"\s+", " ", joined).strip().lower()


def latin(text: str) -> tuple[str, float]:
    """ASCII letters and digits in lower case, and their share of all letters and digits."""
    letters = [c for c in unicodedata.normalize("NFKD", text) if c.isalnum()]
    ascii_only = [c for c in letters if c.isascii()]
    all_kinds = sum(not unicodedata.combining(c) for c in letters)
    return "".join(ascii_only).lower(), (len(ascii_only) / all_kinds if all_kinds else 0.0)


def comparable(text: str) -> tuple[str, str, int, int]:
    """A source text without white space, its Latin key, and the letters that the key keeps and all of them."""
    raw = latin_1(text)
    if raw is not None:
        key = raw.translate(_KEYS, _NOT_KEYS).decode("ascii")
        return raw.translate(_LOWER, _SPACES).decode("latin-1"), key, len(key), len(raw.translate(None, _NOT_LETTERS))
    normal = normalised(text)
    letters = [c for c in unicodedata.normalize("NFKD", normal) if c.isalnum()]
    key = "".join(c for c in letters if c.isascii()).lower()
    return normal.replace(" ", ""), key, len(key), sum(not unicodedata.combining(c) for c in letters)


#: By byte of Latin-1: in lower case, its letter of a Latin key; and those that no form, no key or no count of letters has.
_BASE_OF = [unicodedata.normalize("NFKD", chr(c))[0].lower() for c in range(256)]
_LOWER = bytes(ord(low) if (low := chr(c).lower()) < "\u0100" else c for c in range(256))
_KEYS = bytes(ord(b) if b.isascii() else 32 for b in _BASE_OF)
_SPACES = bytes(c for c in range(128) if chr(c).isspace())
_NOT_KEYS = bytes(c for c, b in enumerate(_BASE_OF) if not (b.isascii() and b.isalnum()))
_NOT_LETTERS = bytes(c for c, b in enumerate(_BASE_OF) if not b.isalnum())


def latin_parts(parts: list[str]) -> list[str] | None:
    """The Latin keys of a quotation's parts, if all of them may be compared so."""
    keys = [latin(p) for p in parts]
    return [k for k, _ in keys] if all(kept >= RETENTION and len(k) >= SHORTEST_KEY for k, kept in keys) else None


#: Characters of Latin-1 that compatibility forms may change, but for accented letters.
_ODD = re.compile(rb"[\x80-\xbf]")


def latin_1(text: str) -> bytes | None:
    """A byte per character, where compatibility forms change none but accented letters."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if _ODD.search(raw) else raw


#: By byte: the letter or digit of a token, or a space.
_IN_TOKENS = bytes(
    ord(b) if (b := unicodedata.normalize("NFKD", chr(c))[0].lower()).isascii() and b.isalnum() else 32 for c in range(256)
)


def plain_tokens(text: str) -> list[str]:
    raw = latin_1(text)
    if raw is not None:
        return raw.translate(_IN_TOKENS).decode("ascii").split()
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", bare.lower()).split()


_LATIN_1 = [chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()]
_ACCENTED = [c for c in _LATIN_1 if unicodedata.normalize("NFKD", c)[0].isascii()]
_BASES = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)
_OTHER_LETTERS = "".join(c for c in _LATIN_1 if c not in _ACCENTED)
#: Texts that need no Python: printing ASCII, usual white space, letters of Latin-1.
_PLAIN_CHARS = "\t\n\r" + "".join(map(chr, range(32, 127))) + "".join(_LATIN_1)
#: What a plain character is in a Latin key; the others are left out of it.
_IN_KEY = {c: b for c in _PLAIN_CHARS if (b := unicodedata.normalize("NFKD", c)[0].lower()).isascii() and b.isalnum()}
PLAIN = r"\A[\t\n\r -~" + "".join(_LATIN_1) + r"]*\z"


def _plain_or(text: Column, plain: Column, other) -> Column:
    """``plain`` for plain texts, ``other`` of the text for the rest; a null text gives what ``other`` gives."""
    is_plain = F.coalesce(text.rlike(PLAIN), F.lit(False))
    return F.when(is_plain, plain).otherwise(other(F.when(~is_plain, text)))


def _bare(text: Column) -> Column:
    return F.translate(text, "".join(_ACCENTED), _BASES)


@F.pandas_udf(S.StringType())
def _normalise(texts: pd.Series) -> pd.Series:
    return texts.map(normalised, na_action="ignore")


def normalise(text: Column) -> Column:
    """The form in which quotation and source are compared."""
    spaces = r"(?: [\t\n\r ]|[\t\n\r])[\t\n\r ]*"  # a single space stays as it is
    return _plain_or(text, F.trim(F.regexp_replace(F.lower(text), spaces, " ")), _normalise)


@F.pandas_udf(S.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.str.casefold()


def casefold(text: Column) -> Column:
    return _plain_or(text, F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _casefold)


@F.pandas_udf(S.StructType([S.StructField("key", S.StringType()), S.StructField("retention", S.DoubleType())]))
def _latin_key(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([latin(t or "") for t in texts], columns=["key", "retention"])


def latin_key(text: Column) -> Column:
    """key and retention; a null text counts as empty."""
    key = F.translate(text, "".join(_IN_KEY) + "".join(c for c in _PLAIN_CHARS if c not in _IN_KEY), "".join(_IN_KEY.values()))
    others = F.length(text) - F.length(F.translate(text, _OTHER_LETTERS, ""))

    def both(p: Column) -> Column:
        kept = F.length(p["key"])
        return F.struct(p["key"].alias("key"), F.when(kept + p["others"] > 0, kept / (kept + p["others"])).otherwise(0.0).alias("retention"))

    return _plain_or(text, T.bound(F.struct(key.alias("key"), others.alias("others")), both), _latin_key)


@F.pandas_udf(S.StructType([
    S.StructField("tight", S.StringType()), S.StructField("latin", S.StringType()), S.StructField("kept", S.LongType()), S.StructField("letters", S.LongType())
]))
def comparable_forms(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([comparable(t or "") for t in texts], columns=["tight", "latin", "kept", "letters"])


@F.pandas_udf(S.ArrayType(S.StringType()))
def comparable_parts(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: latin_parts(list(p)))


@F.pandas_udf(S.ArrayType(S.StringType()))
def _tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: plain_tokens(t or ""))


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits in lower case, accents aside; a null text has none."""
    flat = F.trim(F.regexp_replace(F.lower(_bare(text)), "[^a-z0-9]+", " "))
    return _plain_or(text, F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ")), _tokens)


@F.pandas_udf(S.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first decodable JSON object in a text, as canonical JSON; null without one."""
    decoder = json.JSONDecoder()

    def find(text):
        at = (text or "").find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                if isinstance(value, dict):
                    return canonical_json(value)
            except ValueError:
                pass
            at = text.find("{", at + 1)
        return None

    return texts.map(find)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def redacted(value, secrets: tuple[str, ...], sensitive: tuple[str, ...]):
    """Masks known secrets in strings and every value under a sensitive key."""
    if isinstance(value, dict):
        hidden = {k.casefold() for k in sensitive}
        return {
            k: "[REDACTED]" if str(k).casefold() in hidden else redacted(v, secrets, sensitive) for k, v in value.items()
        }
    if isinstance(value, list):
        return [redacted(v, secrets, sensitive) for v in value]
    if isinstance(value, str):
        for secret in sorted(filter(None, secrets), key=len, reverse=True):
            value = value.replace(secret, "[REDACTED]")
    return value


SENSITIVE_KEYS = ("api_key", "apikey", "authorization", "password", "secret", "token", "access_token")


def redact_json(column, secrets: tuple[str, ...] = (), sensitive: tuple[str, ...] = SENSITIVE_KEYS):
    """JSON texts with credentials masked; a text that is no JSON is masked as a string."""

    @F.pandas_udf(S.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return canonical_json(redacted(json.loads(text), secrets, sensitive))
            except ValueError:
                return redacted(text, secrets, sensitive)

        return texts.map(one)

    return run(column)
