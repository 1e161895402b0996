import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import unicode as U


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, wanted",
    [("a\xa0 b\n", "a b"), ("  ", "—"), ("", "—"), ("x|y", "x\\|y"), ("w" * 64, "w" * 64), ("w" * 63 + "  " + "y" * 5, "w" * 63 + "…")],
)
def test_opening(spark, text, wanted):
    assert one(spark, T.opening(F.col("t")), t=text) == wanted


@pytest.mark.parametrize("text, part, n", [("aaaa", "aa", 2), ("abc", "x", 0), ("concatenate cat", "cat", 2)])
def test_occurrences(spark, text, part, n):
    assert one(spark, T.occurrences(F.col("t"), F.col("p")), t=text, p=part) == n


@pytest.mark.parametrize(
    "spec, wanted", [("1-4,7,9-10", [1, 2, 3, 4, 7, 9, 10]), ("3, 1 - 2,3", [1, 2, 3]), ("0", None), ("4-2", None), ("x", None), ("1,,2", None)]
)
def test_page_spec(spark, spec, wanted):
    assert one(spark, T.page_spec(F.col("t")), t=spec) == wanted


def test_ranges_slugs_and_names(spark):
    assert tuple(one(spark, T.entry_range(F.col("t")), t=" 3-9 ")) == (3, 9)
    assert one(spark, T.entry_range(F.col("t")), t="9-3") is None
    assert one(spark, T.slugify(F.col("t")), t="--Héllo  World!") == "h-llo-world"
    assert one(spark, T.slugify(F.col("t"), "none"), t="!!!") == "none"
    assert one(spark, T.person_slug(F.col("t"), F.lit("ch1")), t="Ada B. Writer") == "ada-b-writer-in-ch1"
    assert one(spark, T.safe_name(F.col("t")), t='a/b:c*?."') == "a_b_c_._"
    assert one(spark, T.page_file(F.lit(7), F.lit(12000), ".txt"), t="") == "page-00007.txt"
    for slug, plain, ordered in (("a-b1", True, False), ("01-a", True, True), ("A", False, False), ("a--b", False, False), ("a\n", False, False)):
        assert one(spark, T.is_slug(F.col("t")), t=slug) == plain
        assert one(spark, T.is_slug(F.col("t"), True), t=slug) == ordered


@pytest.mark.parametrize(
    "raw, wiki, markdown",
    [("a%20b|Shown", "a b", "a b|Shown"), ("x\\y#part", "x/y", "x/y"), ("<p q.md>", "<p q.md>", "p q.md"), ("a+b%2", "a+b%2", "a+b%2"), (" #x ", "", "")],
)
def test_targets(spark, raw, wiki, markdown):
    assert one(spark, T.wikilink_target(F.col("t")), t=raw) == wiki
    assert one(spark, T.markdown_target(F.col("t")), t=raw) == markdown


@pytest.mark.parametrize("target, out", [("", True), ("#a", True), ("HTTP://x", True), ("mailto:a", True), ("a/b.md", False), ("data.md", False)])
def test_external(spark, target, out):
    assert one(spark, T.is_external(F.col("t")), t=target) == out


@pytest.mark.parametrize(
    "path, wanted", [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("a/b/../../c.md", "c.md"), ("../x", None), ("", ""), ("a/../../x", None)]
)
def test_normal_path(spark, path, wanted):
    assert one(spark, T.normal_path(F.col("t")), t=path) == wanted


def test_titles_headings_and_blocks(spark):
    block = "---\ntype: X\ntitle: \"From block\"\nsemantic_note: true\n---\n\n# Heading\n"
    assert one(spark, T.note_title(F.lit("d/stem.md"), F.col("t")), t=block) == "From block"
    assert one(spark, T.note_title(F.lit("d/stem.md"), F.col("t")), t="x\n# Head \n") == "Head"
    assert one(spark, T.note_title(F.lit("d/stem.md"), F.col("t")), t="x") == "stem"
    assert one(spark, T.without_block(F.col("t")), t=block) == "# Heading\n"
    assert one(spark, T.without_block(F.col("t")), t="---\nopen") == "---\nopen"
    assert one(spark, T.is_semantic(F.col("t")), t=block) is True
    assert one(spark, T.is_semantic(F.col("t")), t="text\n" + block) is False
    assert one(spark, T.is_semantic(F.col("t")), t="﻿" + block.replace("\n", "\r\n")) is True
    for body, wanted in (("a\n # b \n# c", "b"), ("#\n# c", ""), ("## a", None), ("#a", None)):
        assert one(spark, T.first_h1(F.col("t")), t=body) == wanted
    assert one(spark, T.first_line(F.col("t")), t="\n \n# x\ny") == "# x"
    assert one(spark, T.fenced_text(F.col("t")), t="h\n````text\nin\nner\n````\n") == "in\nner"


def test_constructed_sections(spark):
    body = "a\n## Evidence limits \nhidden\n### More\nshown\n## Connections\nhidden"
    assert one(spark, T.without_constructed(F.col("t")), t=body) == "a\n### More\nshown"


def test_pages(spark):
    row = spark.sql("SELECT array(1,2) a, array(2,1) b, array(1,1) c, array(9) d, CAST(array() AS array<int>) e, array(1,2,3) s")
    got = row.select(*[T.valid_pages(F.col(c), F.col("s")) for c in "abcde"]).first()
    assert list(got) == [True, False, False, False, False]


def test_unicode_forms(spark):
    assert U.normalised("ﬁnd  mul\xad tistep “Q” — ‘x’ …") == 'find multistep "q" - \'x\' ...'
    assert U.latin("Élan, 3□ x") == ("elan3x", 1.0) or U.latin("Élan, 3 x")[0] == "elan3x"
    assert U.latin("日本ab")[1] == 0.5 and U.latin("")[1] == 0.0
    assert one(spark, U.normalise(F.col("t")), t="A\xa0B") == "a b"
    assert one(spark, U.casefold(F.col("t")), t="Straße") == "strasse"
    assert one(spark, U.first_json_object(F.col("t")), t='say {bad} then {"b": 1, "a": {"c": 2}} end') == '{"a":{"c":2},"b":1}'
    assert one(spark, U.first_json_object(F.col("t")), t="none") is None
    hidden = one(spark, U.redact_json(F.col("t"), ("hush",)), t='{"Token": "x", "a": ["say hush", 1]}')
    assert hidden == '{"Token":"[REDACTED]","a":["say [REDACTED]",1]}'


def test_plain_texts_need_no_python(spark):
    """Expressions and Python give the same; Python sees a null for a plain text."""
    import random
    import unicodedata

    from marginalia.functions import unicode as U

    rng = random.Random(2)
    latin_1 = [chr(c) for c in range(0x20, 0x100)]
    texts = ["", " ", "\t a\r\n b ", "Straße ÆØÅ ÀÉÎ ñ ÿ þ Ð", "½ ² ª", "“x” – y\u00ad z", "ﬁ ſ İ Σας", "a\u0301 e\u0300", "\x1c a\x0bb \x85", "日本 語", "A" * 300]
    texts += ["".join(rng.choice(latin_1 if rng.random() < 0.5 else latin_1[:95]) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["".join(rng.choice("abcXYZ àéÖß,.12\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string")
    t = F.col("t")
    rows = {r.k: r for r in frame.select("k", U.normalise(t).alias("n"), U.casefold(t).alias("c"), U.latin_key(t).alias("l"), U.tokens(t).alias("w")).collect()}
    for k, text in enumerate(texts):
        r = rows[k]
        assert (r.n, r.c, r.w) == (U.normalised(text), text.casefold(), U.plain_tokens(text)), text
        key, kept = U.latin(text)
        assert r.l.key == key and abs(r.l.retention - kept) < 1e-12, text
    assert (rows[-1].n, rows[-1].c, rows[-1].w, tuple(rows[-1].l)) == (None, None, [], ("", 0.0))
    plain = frame.filter(t.rlike(U.PLAIN)).count()
    assert 200 < plain < len(texts) and not unicodedata.normalize("NFKC", "½").isalpha()


def test_a_latin_key_is_made_once(spark):
    """A text's key is one translation, whatever is asked of it, and every plain character is in it as Python says."""
    texts = [c + "é X" for c in U._PLAIN_CHARS] + [" a  b\t\tc\n d \r\n", "", "  ", None, "a b", "\ta"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    asked = frame.select(F.round(U.latin_key(F.col("t"))["retention"], 6).alias("r"))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2 and "regexp_replace" not in plan
    for r in frame.select("t", U.latin_key(F.col("t")).alias("l"), U.normalise(F.col("t")).alias("n")).collect():
        assert tuple(r.l) == U.latin(r.t or "") and r.n == (None if r.t is None else U.normalised(r.t)), r.t
