"""The positional index of running texts, and quotations sought through it, against plain search."""

import random

import pytest

from marginalia.functions import unicode as U
from marginalia.operators import passages as P
from marginalia.operators import quotations as Q


def find_all(text, part):
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def in_order(text, parts):
    at = 0
    for part in parts:
        found = text.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return True


def pages_of(seed, n, letters="abcé字🙂"):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 20, 90]))) for _ in range(n)]
    for k in range(0, n, 7):
        pieces[k] = pieces[0] + pieces[k]
    return [(f"s{s}", k * 3, pieces[k] if s == 0 else pieces[-1 - k]) for s in range(2) for k in range(n)]


def build(spark, tmp_path, rows, **how):
    frame = spark.createDataFrame(rows, "scope string, page long, text string").repartition(3)
    return P.PassageIndex(spark, str(tmp_path / "index"), **how).build(frame)


@pytest.mark.parametrize(("span", "reach", "block"), [(50, 16, 3), (64, 40, 4096), (4096, 1024, 5)])
def test_windows_and_occurrences(spark, tmp_path, monkeypatch, span, reach, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = pages_of(1, 40)
    index = build(spark, tmp_path, rows, span=span, reach=reach)
    text = {s: "".join(t for scope, _, t in rows if scope == s) for s in ("s0", "s1")}
    for r in index.windows.collect():
        assert r.text == text[r.scope][r.number * span : (r.number + 1) * span + reach]
    rng = random.Random(2)
    asked = set()
    for s in text:
        for n in (1, 2, 4, P.SURE - 1, P.SURE, 16, 17, 40, 41, 90, 200, 500):
            at = rng.randrange(len(text[s]) - n)
            asked |= {(s, text[s][at : at + n]), (s, text["s0"][at : at + n]), (s, text[s][at : at + n - 1] + "x")}
    frame = spark.createDataFrame(sorted(asked), "scope string, passage string")
    got = {}
    for r in index.occurrences(frame).collect():
        got.setdefault((r.scope, r.passage), []).append(r.pos)
    want = {(s, p): find_all(text[s], p) for s, p in asked}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    index.drop()


@pytest.mark.parametrize(("span", "reach", "block"), [(50, 16, 3), (4096, 1024, 5)])
def test_a_scan_finds_what_an_index_finds(spark, monkeypatch, span, reach, block):
    """Passages within pages, across their ends, over whole pages and in segments, without shuffling a text."""
    monkeypatch.setattr(P, "BLOCK", block)
    rows = pages_of(1, 40)
    text = {s: "".join(t for scope, _, t in rows if scope == s) for s in ("s0", "s1")}
    rng = random.Random(2)
    asked = set()
    for s in text:
        for n in (1, 2, 4, 7, 16, 17, 31, 32, 33, 41, 90, 200, 500):
            at = rng.randrange(len(text[s]) - n)
            asked |= {(s, text[s][at : at + n]), (s, text["s0"][at : at + n]), (s, text[s][at : at + n - 1] + "x")}
    pages = spark.createDataFrame([*rows, ("other", 1, text["s0"])], "scope string, page long, text string").repartition(3)
    got = {}
    for r in P.scanned(pages, spark.createDataFrame(sorted(asked), "scope string, passage string"), reach, span).collect():
        got.setdefault((r.scope, r.passage), []).append(r.pos)
    want = {(s, p): find_all(text[s], p) for s, p in asked}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("text", ["", "Crème brûlée × 3\t\x1fÆß ÷ Ÿ", "Ab, c-D 9\n\x0b_ÿÞ"])
def test_bytes_of_latin_1_have_the_same_forms(monkeypatch, text):
    fast = U.comparable(text), U.plain_tokens(text)
    monkeypatch.setattr(U, "latin_1", lambda text: None)
    assert fast == (U.comparable(text), U.plain_tokens(text))


def test_lists_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHORT_AT_ONCE", 5)
    rows = pages_of(3, 30, "ab字")
    text = {s: "".join(t for scope, _, t in rows if scope == s) for s in ("s0", "s1")}
    index = build(spark, tmp_path, rows, span=60, reach=20)
    rng = random.Random(4)
    lists = []
    for _ in range(60):
        s = rng.choice(["s0", "s1"])
        parts = []
        for _ in range(rng.choice([1, 2, 2, 3, 5])):
            at, n = rng.randrange(len(text[s]) - 40), rng.choice([2, 5, 18, 39])
            parts.append(text[s][at : at + n])
        lists += [(s, parts), (s, sorted(parts, key=text[s].find))]
    got = {(r.scope, tuple(r.parts)) for r in index.in_order(spark.createDataFrame(lists, "scope string, parts array<string>")).collect()}
    assert got == {(s, tuple(p)) for s, p in lists if in_order(text[s], p)}
    assert 0 < len(got) < len(lists)
    none = spark.createDataFrame([], "scope string, parts array<string>")
    assert index.in_order(none).count() == 0
    index.drop()


def test_an_index_is_opened_again(spark, tmp_path):
    rows = [("s", 1, "the harbour lay quiet under "), ("s", 2, "the tide")]
    first = build(spark, tmp_path, rows)
    first.close()
    again = P.PassageIndex(spark, first.path, buckets=first.buckets).open()
    asked = spark.createDataFrame([("s", "quiet under the tide"), ("other", "quiet under the tide")], "scope string, passage string")
    assert [tuple(r) for r in again.occurrences(asked).collect()] == [("s", "quiet under the tide", 16)]
    again.drop()


def test_postings_are_not_shuffled_for_a_probe(spark, tmp_path):
    index = build(spark, tmp_path, pages_of(5, 20))
    asked = spark.createDataFrame([("s0", 5)], "scope string, gram long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.postings.join(asked, ["scope", "gram"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the probes alone
    index.drop()


def test_one_long_scope_is_many_tasks(spark):
    rows = spark.range(50_000).selectExpr("'s' AS scope", "id AS page", "1L AS size")
    placed = P.offsets(rows, ["scope"], "page", "size")
    assert placed.filter("start <> page").count() == 0
    assert placed.groupBy(P.F.floor(P.F.col("page") / P.BLOCK)).count().count() == 13


def brute_status(asked, pages):
    def carried(needle, hay):
        import re

        parts = [p.strip() for p in re.split(r"\s*(?:…|\.\.\.)\s*", needle) if len(p.strip()) >= 4] or [needle]
        if in_order(hay, parts) or in_order(hay.replace(" ", ""), [p.replace(" ", "") for p in parts]):
            return True
        key, kept = U.latin(hay)
        keys = [U.latin(p) for p in parts]
        return kept >= 0.8 and all(k >= 0.8 and len(t) >= 25 for t, k in keys) and in_order(key, [t for t, _ in keys])

    whole = U.normalised(" ".join(pages[p] for p in sorted(pages)))
    out = {}
    for note, needle, cites in asked:
        cited = U.normalised(" ".join(pages[p] for p in sorted(set(cites)) if p in pages))
        out[note, needle] = "supported" if carried(needle, cited) else "elsewhere" if carried(needle, whole) else "unsupported"
    return out


def test_few_quotations_need_no_index(spark, monkeypatch):
    """Quotations are brought to the pages; postings of all pages are not written."""
    monkeypatch.setattr(P.PassageIndex, "build", None)
    pages = spark.createDataFrame([(1, "The harbour lay quiet"), (2, "under the tide.")], "page int, text string")
    asked = spark.createDataFrame([("n", 0, "q", "quiet under", [7]), ("n", 1, "r", "quiet tide", [7])], "note string, ord int, quote string, needle string, pages array<int>")
    assert {(r.quote, r.status) for r in Q.status(asked, pages, 0).collect()} == {("q", "elsewhere"), ("r", "unsupported")}


@pytest.mark.parametrize("direct", [0, 300, 1 << 20])
def test_status_is_the_same_through_the_index(spark, direct):
    rng = random.Random(6)
    words = ["harbour", "tide", "night,", "cité", "the", "of", "字典", "“lamp”", "quiet-", "soft\xadly", "ﬁsh", "0123"]
    pages = {k: " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 40, 80]))) for k in range(25)}
    pages[30] = "日本語の文章" * 40
    running = " ".join(pages[p] for p in sorted(pages))
    asked = set()
    cites = [tuple(rng.sample(range(32), rng.choice([0, 1, 3, 30]))) for _ in range(20)]
    for k in range(60):
        at, n = rng.randrange(len(running) - 160), rng.choice([20, 45, 120])
        quote = running[at : at + n]
        style = rng.randrange(5)
        if style == 1:
            quote = quote[: n // 3] + "… " + quote[-n // 3 :]
        elif style == 2:
            quote = quote[-n // 3 :] + " ... " + quote[: n // 3]
        elif style == 3:
            quote = quote[: n // 2] + "□" + quote[n // 2 :]
        elif style == 4:
            quote = quote.replace("harbour", "castle")
        needle = U.normalised(quote).strip(" .,;:!?'\"-–—").strip("…").strip()
        if needle:
            asked.add((f"n{k % 20}", needle, cites[k % 20]))
    frame = spark.createDataFrame([(n, 0, q, q, list(c)) for n, q, c in asked], "note string, ord int, quote string, needle string, pages array<int>")
    texts = spark.createDataFrame(sorted(pages.items()), "page int, text string")
    got = {(r.note, r.quote): r.status for r in Q.status(frame, texts, direct).collect()}
    want = brute_status(asked, pages)
    assert got == want and set(want.values()) == {"supported", "elsewhere", "unsupported"}
