"""Scoping, integrity, plans, evidence, leak scan, extraction and full-text cases."""

import json
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from marginalia.operators import evidence, eventlog, extraction, fulltext, integrity, inventory, leakscan, scoping
from marginalia.plans import fixtures
from marginalia.plans import profile as P

PAGES = [
    (1, "HEAD 1\nbefore the start\nSTART of it\nmore text\n"), (2, "HEAD 2\nmiddle page with mul\xadtistep\n"),
    (3, "HEAD 3\n1. first entry,\n42. not one\n2. second entry\nEND\n3. outside\n"),
]
RULES = [(r"(?m)^HEAD \d+\n", "running head of the edition")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page int, text string")


def scoped(spark, boundaries=((1, "START", "after", "cut start"), (3, "END", "before", "cut end"))):
    sections = spark.createDataFrame([(1, "primary_text"), (2, "primary_text"), (3, "citation_apparatus")], "page int, section string")
    rules = spark.createDataFrame(list(boundaries), "page int, marker string, keep string, action string")
    return scoping.scope(pages(spark), sections, RULES, rules)


def test_scope(spark):
    rows = {r.page: r for r in scoped(spark).collect()}
    assert rows[1].text == "START of it\nmore text\n" and rows[1].boundary_action == "cut start" and rows[2].boundary_action == "none"
    assert rows[3].text == "1. first entry,\n42. not one\n2. second entry\n"
    assert all(r.furniture_removed == ["running head of the edition"] for r in rows.values())
    assert rows[1].discarded == "the discarded portion is about 3 words of adjoining material"
    text = scoping.canonical(scoped(spark), "P", "A").first()
    assert text.canonical == "P\nSTART of it\nmore text\nmiddle page with mul\xadtistep\nA\n1. first entry,\n42. not one\n2. second entry\n"
    assert scoping.unused_furniture(scoped(spark), [*RULES, ("zzz", "never there at all")]).collect()[0].reason == "never there at all"
    assert [(r.page, r.soft_hyphens) for r in scoping.soft_hyphens(pages(spark)).collect()] == [(2, 1)]


def test_missing_marker_fails(spark):
    with pytest.raises(SparkRuntimeException, match="boundary marker missing on page 2"):
        scoped(spark, ((2, "NOWHERE", "after", "x"),)).collect()


def test_discarded_entries(spark):
    row = spark.createDataFrame([("7. a\n8. b\n",), ("8. a\n7. b\n",), ("",)], "discarded_text string").select(scoping.discarded().alias("x")).collect()
    assert row[0].x == "the discarded portion carries 2 numbered entries (7-8) belonging to an adjoining division"
    assert row[1].x.startswith("the discarded portion is about 4 words") and row[2].x == ""


@pytest.mark.parametrize("numbers, wanted", [([1, 42, 2], [1, 2]), ([2, 1], [1]), ([], []), ([1, 2, 3, 4], [1, 2, 3]), ([5], [])])
def test_running_sequence(spark, numbers, wanted):
    row = spark.createDataFrame([(numbers,)], "n array<int>").select(scoping.running_sequence(F.col("n"), F.lit(1), F.lit(3)).alias("x")).first()
    assert row.x == wanted


def test_entries(spark):
    rows = [("d", 1, "1. one\nmore\n9. no\n2. two"), ("d", 2, "carried on\n3. three\n"), ("e", 1, "none"), ("f", 1, None)]
    got = scoping.entries(spark.createDataFrame(rows, "doc string, page int, text string"), "doc").orderBy("doc", "number").collect()
    assert [(r.doc, r.page, r.number, r.text) for r in got] == [("d", 1, 1, "one more 9. no"), ("d", 1, 2, "two"), ("d", 2, 3, "three")]
    assert [r.numbers for r in scoping.entries_per_page(spark.createDataFrame(got)).orderBy("page").collect()] == [[1, 2], [3]]


def brute_block(text):
    flat = " ".join(text.split())
    for s in range(0, max(0, len(flat) - 120), 20):
        if flat.count(flat[s : s + 120]) > 1:
            return flat[s : s + 110].strip()
    return None


@pytest.mark.parametrize("text", ["x", "ab " * 200, "".join(f"w{k} " for k in range(80)) * 2, "intro " + "".join(f"w{k} " for k in range(80)) * 2, "é" * 300])
def test_duplicate_block(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(scoping.duplicate_block(F.col("t")).alias("x")).first().x == brute_block(text)


def test_patterns_that_do_not_carry_over():
    assert scoping.java_pattern(r"(?P<n>a)") == "(?<n>a)"
    for bad in (r"a\Z", r"(?P<a>x)(?P=a)", r"(a)?(?(1)b|c)", "("):
        with pytest.raises(Exception):
            scoping.java_pattern(bad)


def test_page_ranges(spark):
    got = scoping.page_ranges(spark.createDataFrame([(p,) for p in (3, 4, 5, 9, 10)], "page int")).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in got] == [(3, 5), (9, 10)]


def test_inventories(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    old, new = make([("a", "1"), ("b", "2"), ("c", "3")]), make([("a", "1"), ("b", "9"), ("d", "4")])
    assert {(r.path, r.status) for r in integrity.checksum_diff(old, new).collect()} == {("b", "changed"), ("c", "missing"), ("d", "extra")}
    assert {(r.path, r.status) for r in integrity.artifact_check(old, new).collect()} == {("b", "changed"), ("c", "missing")}
    assert {r.path for r in integrity.page_hash_mismatches(new, old).collect()} == {"b", "d"}
    allowed = make([("b", "")])
    assert {r.path for r in integrity.unchanged(old, new, allowed).collect()} == {"c", "d"}


def test_sequences(spark):
    log = spark.createDataFrame([("r", 1), ("r", 2), ("r", 4), ("s", 2)], "run_id string, sequence long")
    assert {(r.run_id, r.sequence, r.expected) for r in integrity.sequence_faults(log).collect()} == {("r", 4, 3), ("s", 2, 1)}
    child = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, sequence long")
    got = integrity.resequence(log.filter("run_id = 'r'"), child).orderBy("sequence").collect()
    assert [(r.sequence, r.child_sequence) for r in got] == [(1, None), (2, None), (4, None), (5, 1), (6, 2)]


def test_documents(spark):
    a, b = {"x": {"k": 1, "l": [1, 2]}, "y": True}, {"x": {"k": 2, "l": [1]}, "y": 1}
    assert integrity.first_difference(spark, a, b) == "lock.x.k: expected 1, got 2"
    assert integrity.first_difference(spark, a, a) == ""
    with pytest.raises(ValueError, match="repeated key"):
        integrity.load_strict('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        integrity.load_strict("[1]")


@pytest.mark.parametrize(
    "change, reason",
    [({}, None), ({"status": "failed"}, "smoke did not pass"), ({"corrected": True}, "smoke was corrected"), ({"expires_at": "2000-01-02T00:00:00+00:00"}, "smoke has expired"),
     ({"binding_sha256": "z"}, "smoke belongs to another binding"), ({"creates_published_wiki": True}, "smoke published a wiki"), ({"status": None}, "smoke did not pass")],
)
def test_smoke_gate(spark, change, reason):
    row = {"run_id": "r", "status": "passed", "corrected": False, "creates_published_wiki": False, "created_at": "2000-01-01T00:00:00+00:00", "expires_at": "2999-01-01T00:00:00+00:00", "binding_sha256": "b"} | change
    schema = "run_id string, status string, corrected boolean, creates_published_wiki boolean, created_at string, expires_at string, binding_sha256 string"
    got = integrity.smoke_gate(spark.createDataFrame([tuple(row.values())], schema), "b").first()
    assert got.reason == reason and got.open == (reason is None)


def test_files_and_labels(spark):
    files = spark.createDataFrame([("index.md",), ("junk.txt",), ("cases/a.md",), ("tmp/b.md",)], "path string")
    assert {r.path for r in integrity.stray_files(files, ["index.md"], ["cases"]).collect()} == {"junk.txt", "tmp/b.md"}
    need, have = spark.createDataFrame([("survey",), ("review",)], "prefix string"), spark.createDataFrame([("survey:outline",)], "label string")
    assert [r.prefix for r in integrity.missing_prefixes(need, have).collect()] == ["review"]
    tools = spark.createDataFrame([("read_file",), ("Web_Search",)], "tool string")
    assert [r.tool for r in integrity.isolation(tools, ("web", "memory")).collect()] == ["Web_Search"]
    none = spark.createDataFrame([], "kind string")
    assert integrity.seal_gate(none, none, none).first().sealed and not integrity.seal_gate(tools, none, none).first().sealed


def violations(spark, change):
    data = fixtures.INVENTORY | change
    return [r.violation for r in inventory.violations(inventory.load_inventory(spark, data), [1, 2], "ada writer", {"claims": 1}).collect()]


def edit(relation, k, **fields):
    rows = [dict(r) for r in fixtures.INVENTORY[relation]]
    rows[k] |= fields
    return {relation: rows}


@pytest.mark.parametrize(
    "change, wanted",
    [
        ({}, []),
        ({"chapter": fixtures.INVENTORY["chapter"] | {"argument_steps": ["a"]}}, ["argument_steps needs at least four"]),
        (edit("sections", 1, order=1), ["duplicate section order 1", "section_order does not name"]),
        (edit("sections", 0, pdf_pages=[9]), ["section 01-tide has invalid"]),
        (edit("episodes", 1, slug="boats-wait"), ["duplicate episode slug boats-wait"]),
        (edit("episodes", 0, slug="tide"), ["concept slug tide collides"]),
        (edit("episodes", 0, section_order=7), ["section_order does not name"]),
        (edit("concepts", 0, kind="epistemic"), ["must cover substantive"]),
        (edit("concepts", 0, kind="odd"), ["kind is invalid", "must cover"]),
        (edit("people", 1, group="author"), ["exactly one author"]),
        (edit("people", 0, name="Someone"), ["author does not match"]),
        ({"claims": []}, ["inventory.claims is empty", "needs at least 1"]),
        ({"motifs": [" "]}, ["motifs must be a non-empty string list"]),
        (edit("sections", 0, pdf_pages=[2, 1]), ["section 01-tide has invalid"]),
    ],
)
def test_plan_rules(spark, change, wanted):
    got = violations(spark, change)
    assert len(got) == len(wanted) and all(any(w in g for g in got) for w in wanted), got


def test_missing_relation_and_first_violation(spark):
    data = inventory.load_inventory(spark, {k: v for k, v in fixtures.INVENTORY.items() if k != "claims"})
    found = inventory.violations(data, [1], "x")
    assert inventory.first_violation(found) == "inventory is missing ['claims']"
    assert inventory.first_violation(found.filter("false")) is None


def test_expected_notes_and_narrowing(spark):
    data = inventory.load_inventory(spark, fixtures.INVENTORY)
    paths = {r.path for r in inventory.expected_notes(data, "demo").collect()}
    assert {"people/ada-writer-in-demo.md", "people/witnesses.md", "cases/lamp-burns.md", "chapters/01-the-harbour.md"} <= paths and len(paths) == 17
    parts = {r.order: (r.episodes, r.concepts) for r in inventory.section_parts(data["sections"], data["episodes"], data["concepts"]).collect()}
    assert parts[1] == (["boats-wait"], ["reading", "tide"]) and parts[2] == (["lamp-burns"], ["reading", "tide", "witness"])
    small = inventory.narrow(data)
    assert [r.slug for r in small["episodes"].collect()] == ["boats-wait"] and small["concepts"].count() == 3 and small["people"].count() == 2
    assert [r.slug for r in inventory.in_page_range(data["episodes"], 2, 5).collect()] == ["lamp-burns"]
    assert {r.group: r.members for r in inventory.role_groups(data["people"]).collect()} == {"author": ["Ada Writer"], "witnesses": ["Keeper"]}


def test_packets_and_budget(spark):
    notes = spark.createDataFrame([(f"n{k}", "t" * 7000, [9 - k] if k else []) for k in range(7)], "path string, text string, pages array<int>")
    packed = evidence.packets(notes).orderBy("packet", "path").collect()
    assert [(r.packet, r.path) for r in packed] == [(0, f"n{k}") for k in (2, 3, 4, 5, 6)] + [(1, "n0"), (1, "n1")]
    assert all(len(r.text) == evidence.NOTE_CHARACTERS for r in packed)
    kept, skipped = evidence.cap(evidence.packets(notes), 1)
    assert kept.count() == 5 and skipped.first().skipped == 1 and evidence.cap(kept, None)[1].first().skipped == 0
    two = spark.createDataFrame([(0, "a", [1, 2]), (0, "b", [1]), (1, "c", [])], "packet int, path string, pages array<int>")
    sizes = spark.createDataFrame([(1, 60), (2, 10)], "page int, chars int")
    got = {r.packet: (r.supplied, r.omitted) for r in evidence.packet_pages(two, sizes, budget=50).collect()}
    assert got == {0: ([1], [2]), 1: ([1], [])}


def test_budget_skips_and_goes_on(spark):
    ranked = spark.sql("SELECT array(named_struct('page', 5, 'chars', 40L), named_struct('page', 3, 'chars', 30L), named_struct('page', 9, 'chars', 10L)) r")
    assert ranked.select(evidence.within_budget(F.col("r"), 50).alias("x")).first().x == [5, 9]


def test_global_numbering(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    got = evidence.chunk(rows, 64, "k").collect()
    assert all(r.chunk == r.k // 64 for r in got) and len(got) == 1000


def test_rounds(spark):
    rounds = spark.createDataFrame(
        [(1, ["a", "b"], ["b"], [1], [1, 2]), (2, ["b"], ["a"], [2], [2]), (3, ["a"], [], [2], [2])],
        "round int, reviewed array<string>, repaired array<string>, supplied array<int>, cited array<int>",
    )
    names = F.array(F.lit("a"), F.lit("b"))
    done = evidence.coverage(rounds, names).first()
    assert (done.coverage, done.page_coverage, done.notes_pending) == ("complete", "complete", [])
    early = evidence.coverage(rounds.filter("round < 3"), names).first()
    assert (early.coverage, early.notes_pending) == ("partial", ["a"])
    packets = spark.createDataFrame([("1", ["a"], [1], [1, 2], 0, None, 0, 0), ("2", ["b"], [2], [2], 0, None, 0, 0)], "round string, notes array<string>, pages_supplied array<int>, pages_cited array<int>, findings int, error string, skipped int, reduced int")
    got = {r["round"]: (r.coverage, r.finding_status, r.pages_never_supplied) for r in evidence.round_report(packets).collect()}
    assert got == {"1": ("partial", "clear", [2]), "2": ("complete", "clear", [])}


def test_leaks(spark):
    texts = spark.createDataFrame([("a", "Das Wört hier"), ("secret-name", "clean")], "path string, text string")
    deny = spark.createDataFrame([(__import__("hashlib").sha256(w.encode()).hexdigest(),) for w in ("wort hier", "secret name")], "sha256 string")
    assert {(r.path, r.place) for r in leakscan.denied(texts, deny).collect()} == {("a", "text"), ("secret-name", "path")}
    shapes = {
        "C:" + "\\Users\\me\\x": "absolute machine path", "/ho" + "me/me/x": "absolute machine path", "at 10." + "1.2.3 now": "private network endpoint",
        "local" + "host:80": "private network endpoint", "token" + "_" + "a" * 16: "credential-shaped value", "me@" + "mail.org": "non-placeholder email address",
    }
    for text, finding in shapes.items():
        assert spark.createDataFrame([(text,)], "t string").select(leakscan.privacy_findings(F.col("t")).alias("x")).first().x == [finding], text
    assert spark.createDataFrame([("a@mail.example.com 8.8.8.8",)], "t string").select(leakscan.privacy_findings(F.col("t")).alias("x")).first().x == []


def test_extraction_records(spark):
    own = spark.createDataFrame([(1, 0, 5, 1, 2), (2, 7, 7, 0, 0), (3, 0, 0, 0, 0)], "page int, native_text_characters int, raw_characters int, vectors int, images int")
    assert [r.page for r in extraction.ocr_targets(own, "missing").orderBy("page").collect()] == [1, 3]
    assert extraction.ocr_targets(own, "all").count() == 3 and extraction.ocr_targets(own, "none").count() == 0
    assert extraction.fallback_grid(own).count() == 16
    text = spark.createDataFrame([(1, "x")], "page int, text string")
    assert [r.text for r in extraction.all_pages_text(text, 3).orderBy("page").collect()] == ["x", "", ""]
    assert [r.page for r in extraction.recovered_pages(own, text).collect()] == [1]
    seen = spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "page int, occurrence int, xref int")
    objects = spark.createDataFrame([(5, None), (6, "cannot render")], "xref int, error string")
    report = extraction.validation(own, seen, objects, 3, 2).first()
    assert report.status == "passed" and report.image_errors == 1 and report.pages_without_native_text == [1, 3] and report.native_characters == 7
    assert extraction.validation(own, seen, objects, 3, 1).first().status == "failed"
    assert [(r.xref, r.referenced_on_pages) for r in extraction.pages_of_images(seen).collect()] == [(5, [1])]
    blocks = spark.sql("SELECT array(named_struct('kind',0,'lines',array(named_struct('spans',array(named_struct('chars',array('a','b')))))), named_struct('kind',1,'lines',array(named_struct('spans',array(named_struct('chars',array('a'))))))) b")
    assert blocks.select(extraction.raw_characters(F.col("b")).alias("n")).first().n == 2
    best = spark.createDataFrame([(1, 0, 6, 5), (1, 90, 6, 9), (1, 90, 11, 9)], "page int, rotation int, mode int, characters int")
    assert tuple(extraction.best_variant(best).first()) == (1, 90, 6, 9)


def test_fulltext(spark):
    notes = spark.createDataFrame([("b.md", "# Cat\nconcatenate"), ("cat/a.md", "a cat"), ("c.md", "dog")], "path string, text string")
    got = fulltext.search(notes, "Cat cat", 5).collect()
    assert [(r.path, r.score) for r in got] == [("b.md", 20), ("cat/a.md", 8)]
    assert fulltext.search(notes, "cat dog").count() == 0
    for bad in (("!!", 5), ("cat", 0)):
        with pytest.raises(ValueError):
            fulltext.search(notes, *bad)


def test_events(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("s", "a", 3)], "run_id string, event string, at int")
    assert {(r.run_id, r.n_a, r.n_b, r.n) for r in eventlog.event_metrics(rows, ("a", "b")).collect()} == {("r", 1, 1, 2), ("s", 1, 0, 1)}
    assert {(r.run_id, r.event) for r in eventlog.latest(rows, "run_id", "at").collect()} == {("r", "b"), ("s", "a")}
    errors = spark.createDataFrame([("ReadTimeout",), ("AuthenticationError",), ("Odd",)], "e string")
    assert [r.x for r in errors.select(eventlog.retryable(F.col("e")).alias("x")).collect()] == [True, False, False]


PROFILE = {
    "schema_version": 1, "profile_id": "demo", "source": {"pdf": "book.pdf", "extraction": "out"}, "document": {"id": "b", "title": "B", "author": "A"},
    "scope": {
        "id": "s", "title": "S", "label": "scope", "primary_pages": [1, 2], "apparatus_pages": [3], "canonical_banners": {"primary": "P", "apparatus": "A"},
        "boundaries": [{"page": 1, "marker": "START", "keep": "after", "action": "cut", "note": "n"}, {"page": 3, "marker": "END", "keep": "before", "action": "cut", "note": "n"}],
        "page_furniture": [{"pattern": RULES[0][0], "reason": RULES[0][1]}],
        "apparatus": {"id": "n", "label": "Notes", "entry_first": 1, "entry_last": 2, "entry_pattern": r"(?m)^(\d{1,3})\.\s"},
    },
    "architecture": {"rationale": "r", "minimums": {"case_dossiers": 1, "concept_notes": 1, "section_notes": 1, "claims": 1, "motifs": None}, "nullable_rationales": {"motifs": "none here"}, "required_note_types": ["Concept"]},
    "output": {"format": "okf", "okf_version": "0.2"},
}


def changed(**scope):
    return PROFILE | {"scope": PROFILE["scope"] | scope}


@pytest.mark.parametrize(
    "bad",
    [PROFILE | {"more": 1}, {k: v for k, v in PROFILE.items() if k != "output"}, PROFILE | {"schema_version": True}, changed(primary_pages=[2, 1]), changed(primary_pages=[1, 3]),
     changed(apparatus=None), changed(apparatus_pages=[]), changed(page_furniture=[{"pattern": "(", "reason": "long enough reason"}]), changed(page_furniture=[{"pattern": "a", "reason": "short"}]),
     changed(boundaries=[PROFILE["scope"]["boundaries"][0]] * 2), changed(apparatus=PROFILE["scope"]["apparatus"] | {"entry_pattern": "x"}), PROFILE | {"source": {"pdf": "/abs", "extraction": "x"}},
     PROFILE | {"architecture": PROFILE["architecture"] | {"nullable_rationales": {}}}],
)
def test_bad_profiles(bad):
    with pytest.raises(P.ProfileError):
        P.check_profile(bad)


def test_lock(spark):
    own = P.check_profile(PROFILE)
    rows = pages(spark).select("page", F.concat(F.lit("p"), F.col("page").cast("string")).alias("path"), "text", F.sha2("text", 256).alias("sha256"))
    lock = P.build_lock(spark, own, rows, rows.select("path", "sha256"), {"pdf": "x"})
    assert lock["scope"]["apparatus_entries"] == [1, 2] and set(lock["scope"]["pages"]) == {"1", "2", "3"}
    P.verify_lock(spark, lock, P.build_lock(spark, own, rows, rows.select("path", "sha256"), {"pdf": "x"}))
    with pytest.raises(P.ProfileError, match="drifted"):
        P.verify_lock(spark, lock, lock | {"profile_id": "other"})
    with pytest.raises(P.ProfileError, match="checksum mismatch"):
        P.build_lock(spark, own, rows, rows.select("path", F.lit("0").alias("sha256")), {})
    with pytest.raises(P.ProfileError, match="matched nothing"):
        more = changed(page_furniture=[*PROFILE["scope"]["page_furniture"], {"pattern": "zzz", "reason": "never on any page"}])
        P.build_lock(spark, P.check_profile(more), rows, rows.select("path", "sha256"), {})
    with pytest.raises(P.ProfileError, match="not continuous"):
        longer = changed(apparatus=PROFILE["scope"]["apparatus"] | {"entry_last": 3})
        P.build_lock(spark, P.check_profile(longer), rows, rows.select("path", "sha256"), {})


def test_settings():
    assert P.RunSettings.of({"smoke_seconds": 5}).smoke_seconds == 5
    for bad in ({"x": 1}, {"smoke_seconds": 0}, {"smoke_seconds": True}):
        with pytest.raises(P.ProfileError):
            P.RunSettings.of(bad)


def flat(document, at="lock"):
    """Every node of a parsed document, as the rule says."""
    kind = type(document).__name__
    if isinstance(document, dict):
        return [(at, kind, "")] + [row for k in document for row in flat(document[k], f"{at}.{k}")]
    if isinstance(document, list):
        return [(at, kind, str(len(document)))] + [row for k, v in enumerate(document) for row in flat(v, f"{at}[{k}]")]
    return [(at, kind, json.dumps(document, ensure_ascii=False))]


def test_documents_come_apart_inside_spark(spark):
    rng = random.Random(3)

    def made(depth):
        kind = rng.randrange(8 if depth else 6)
        if kind == 6:
            return {rng.choice("abcdé"): made(depth - 1) for _ in range(rng.randrange(4))}
        if kind == 7:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return [None, True, rng.randrange(-5, 10**12), 0.5, "text \"q\" ü", ""][kind]

    documents = [(k, {"x": made(5), "y": made(5)}) for k in range(40)]
    changed = [(k, {"x": d["x"], "y": made(5)} if k % 2 else d) for k, d in documents] + [(99, {})]
    frame = lambda ds: spark.createDataFrame([(k, json.dumps(d)) for k, d in ds] + [(-1, None), (-2, "{no")], "id int, document string")
    got = [tuple(r) for r in integrity.flattened(frame(documents), "id").collect()]
    assert sorted(got) == sorted((k, *row) for k, d in documents for row in flat(d))
    old, new = ({(k, at): (kind, value) for k, d in ds for at, kind, value in flat(d)} for ds in (documents, changed))
    want = {}
    for at in old.keys() | new.keys():
        a, b = old.get(at), new.get(at)
        if a != b:
            want[at] = "unexpected field" if a is None else "missing field" if b is None else f"expected {a[0]}, got {b[0]}" if a[0] != b[0] else f"expected {a[1]}, got {b[1]}"
    diff = integrity.differences(frame(documents), frame(changed), "id")
    assert {(r.id, r.location): r.problem for r in diff.collect()} == want and want
    first = {r.id: r.location for r in integrity.first_differences(frame(documents), frame(changed), "id").collect()}
    assert first == {k: min(at for i, at in want if i == k) for k, _ in want}
