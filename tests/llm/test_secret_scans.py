import random
import re

from marginalia.llm import secret_scans as s

KEY = "AKIA" + "ABCDEFGHIJKL1234"
HEX = "0123456789abcdef" * 2
WORD = "pass" + "word"
TEXTS = [
    (1, f"Deutsch ß {WORD} = 'abcdefgh12' then {KEY} and {HEX}."),
    (2, f"{WORD}=short token:also {WORD}: longenough1"),
    (3, "nothing here"), (4, ""), (5, None), (6, f"secret=token:abcdefghij {WORD}=token:abcdefghij"),
    (7, "user=alice key Ab3" + "xYz9" * 6 + " at https://host.example.com/x"),
    (8, "Ab3" + "xYz9" * 6 + " alone"), (9, "https://host.example.com alone"),
    (10, "user=alice" + " " * 600 + "Ab3" + "xYz9" * 6), (11, ("é" * 50 + f" api_key: {HEX} ") * 40), (None, f"{KEY}"),
    (12, "AKIAAKIA AKIASHORT " + HEX.upper() + " " + "a" * 31),
]


def base(text):
    out = []
    for rank, kind in enumerate(s.KINDS[: s.BASE]):
        for m in re.finditer(s.PATTERNS[kind], text or "", re.A):
            if kind != "assign" or len(m[2]) >= 8:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def weak(text):
    """All pairs of parts, as the definition says."""
    parts = []
    for rank, kind in enumerate(s.KINDS):
        for m in re.finditer(s.PATTERNS[kind], text or "", re.A):
            value = m[s.VALUE_GROUP.get(kind, 0)]
            if len(value) < s.SHORTEST_VALUE.get(kind, 0):
                continue
            if kind == "bare" and not all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]")):
                continue
            parts.append((m.start(), rank, kind, m.end()))
    out = []
    for a in parts:
        if a[1] < s.BASE:
            continue
        near = [b for b in parts if b[2] != a[2] and b[0] - s.SCOPE < a[3] and b[3] + s.SCOPE > a[0]]
        covered = any(b[1] < s.BASE and b[0] <= a[0] and b[3] >= a[3] for b in near)
        if not covered and all(r in {s.ROLE[b[2]] for b in near} for r in s.NEEDS[a[2]]):
            out.append(a)
    return out


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "c", 1, len(t or "")) for i, t in rows], "doc_id long, text string, spans string, start int, n_chars long")


def test_spans_against_brute_force(spark):
    rows = {(r.doc_id, r.row_no): r.spans for r in s.scan(frame(spark)).collect()}
    assert len(rows) == len(TEXTS)
    got = {i: spans for (i, _), spans in rows.items()}
    for i, t in TEXTS:
        assert [(x.start, x.rank, x.kind, x.end) for x in got[i] if x.base] == base(t), i
        assert [(x.start, x.rank, x.kind, x.end) for x in got[i]] == sorted(base(t) + weak(t)), i
    assert {x.kind for x in got[7]} == {"account", "bare", "endpoint"}
    assert not got[8] and not got[9] and not got[10]


def test_companions_behind_weak_parts_that_cross_bins(spark):
    """Gaps about the scope behind weak parts that start in one bin and end in another."""
    token = lambda n: ("Ab3" + "xYz9" * (n // 4 + 1))[:n]
    texts = [(190, 28, 183), (0, 500, 1), (390, 28, 150), (190, 28, 198), (190, 28, 199), (190, 28, 200), (150, 250, 199), (399, 450, 160)]
    rows = [(i, " " * at + token(n) + " " * gap + KEY) for i, (at, n, gap) in enumerate(texts)]
    rows.append((len(rows), " " * 150 + "https://" + "host." * 40 + "com" + " " * 170 + f"{KEY} {HEX}"))
    found = {r.doc_id: [(x.start, x.rank, x.kind, x.end) for x in r.spans] for r in s.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        assert found[i] == sorted(base(t) + weak(t)), i
    assert [len(found[i]) for i, _ in rows] == [2, 2, 2, 2, 2, 1, 2, 2, 3]


def test_redact(spark):
    source = frame(spark, [*TEXTS, TEXTS[0]])
    out = s.redact(source)
    assert out.schema.names == source.schema.names
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1
    by_id = {r.doc_id: r for r in rows}
    for i, t in TEXTS:
        own = by_id[i]
        for start, _, _, end in base(t):
            assert t[start:end] not in own.text
        if not base(t) and not weak(t):
            assert own.text == t
        assert own.n_chars == len(own.text or "")
    assert by_id[1].text == f"Deutsch ß {s.MASK}' then {s.MASK} and {s.MASK}."


def test_empty(spark):
    assert s.scan(frame(spark, [])).count() == 0
    assert s.redact(frame(spark, [])).count() == 0


def masked(text, spans):
    out, at = "", 0
    for start, _, _, end in sorted(spans):
        if start >= at:
            out += text[at:start] + s.MASK
        at = max(at, end)
    return out + text[at:]


def test_redact_against_brute_force_with_many_spans(spark):
    """More masks than one piece holds, at its edges too, in a text of wide characters."""
    rng = random.Random(2)
    filler = lambda: "".join(rng.choice("äß漢𝔘 e") for _ in range(rng.randrange(30)))
    rows = [(n, "".join(filler() + rng.choice([KEY, HEX, f"token={HEX}", KEY + HEX]) + " " for _ in range(n)) + filler()) for n in (1, 63, 64, 65, 128, 300)]
    rows += [(1000, KEY), (1001, KEY + HEX), (1002, " " + KEY)]
    out = {r.doc_id: r.text for r in s.redact(frame(spark, rows)).collect()}
    spans = {r.doc_id: r.spans for r in s.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        assert out[i] == masked(t, [(x.start, x.rank, x.kind, x.end) for x in spans[i]]), i


def test_names_that_the_operator_might_use(spark):
    names = ["__id", "__spans", "__h", "id_", "KEY_", "masks_", "h_", "masked_", "s"]
    source = spark.createDataFrame([(1, f"x {KEY}", *range(9)), (2, None, *range(9))], ["doc_id", "text", *names])
    out = s.redact(source)
    assert out.columns == source.columns
    assert sorted(map(tuple, out.collect())) == [(1, f"x {s.MASK}", *range(9)), (2, None, *range(9))]
