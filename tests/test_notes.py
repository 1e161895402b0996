"""Metadata, lint, audit, links and quotations over invented notes."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import frontmatter as M
from marginalia.operators import linkgraph, lint, quotations
from marginalia.plans import fixtures


def frame(spark, notes):
    return spark.createDataFrame(sorted(notes.items()), "path string, text string")


def test_values():
    assert M.value_of("[a, 'b', \"c, d\"]") == ["a", "b", "c, d"]
    assert M.value_of('{ resource: "x:y", at: 1 }') == {"resource": "x:y", "at": "1"}
    assert (M.value_of("true"), M.value_of("False"), M.value_of("yes"), M.value_of("12"), M.value_of("")) == (True, False, "yes", "12", "")


def test_blocks():
    f = M.fields("﻿---\ntitle: A\n  folded line\ntags:\n  - x\n  - { k: v }\nnote: a # cut\nquoted: \"a # b\"\npdf_pages: [2, 1]\n---\nbody")
    assert f["opened"] and f["closed"] and f["title"] == "A folded line" and f["tags"] == 2
    assert f["truncated"] == ["note"] and f["pages"] == [1, 2] and f["body"] == "body"
    assert M.fields("no block")["opened"] is False
    open_ = M.fields("---\ntitle: x\n")
    assert open_["opened"] and not open_["closed"] and open_["meta"] == {}
    assert M.fields(None)["opened"] is False
    assert M.fields("---\npdf_pages: 3\n---\n")["pages_kind"] == "not-list"
    assert M.fields("---\npdf_pages: [a]\n---\n")["pages_kind"] == "not-number"
    assert M.fields("---\nsources:\n  - { page: 1 }\n---\n")["sources_bad"]


CLEAN = {
    "index.md": "# Index\n\n- [Overview](overview.md)\n- [Harbour](concepts/harbour.md)\n",
    "log.md": "## [2024-01-02] start\n",
    "overview.md": fixtures.note("Overview", "Overview", "[Harbour](concepts/harbour.md)").replace("../sources", "sources"),
    "concepts/harbour.md": fixtures.note("Concept", "Harbour", "[O](../overview.md)\n\n## Instances in scope\n\nx\n\n## Evidence status\n\ny"),
    "sources/pdf-pages/page-0001.md": fixtures.gateway(1, "text"),
}


def kinds(spark, notes, files=None):
    rows = lint.lint(frame(spark, notes), files).collect()
    return sorted((r.kind, r.file) for r in rows)


def test_clean_corpus_has_no_issues(spark):
    assert kinds(spark, CLEAN) == []
    assert lint.audit(frame(spark, CLEAN)).count() == 0


@pytest.mark.parametrize(
    "change, wanted",
    [
        ({"index.md": None}, [("no-index", "index.md")]),
        ({"log.md": "# Log\n"}, [("empty-log", "log.md")]),
        ({"log.md": None}, [("empty-log", "log.md")]),
        ({"index.md": CLEAN["index.md"] + "- [x](cases/none.md)\n"}, [("broken-link", "index.md"), ("index-ghost", "index.md")]),
        ({"index.md": "- [[overview]]\n"}, [("not-in-index", "concepts/harbour.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("[Harbour](concepts/harbour.md)", "none")}, [("orphan", "concepts/harbour.md")]),
        ({"overview.md": CLEAN["overview.md"] + "![i](a.png) ![j](https://x/y.png) [[nobody]]"}, [("broken-image", "overview.md"), ("broken-link", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("## Sources", "## Other")}, [("no-sources", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("# Overview\n", "Overview\n", 1)}, [("no-title", "overview.md")]),
        ({"concepts/harbour.md": CLEAN["concepts/harbour.md"].replace("## Instances in scope", "## I").replace("## Evidence status", "## E")},
         [("no-guardrail", "concepts/harbour.md"), ("no-instances", "concepts/harbour.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("pdf_pages: [1]", "pdf_pages: [1, 2]")}, [("bad-locators", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("pdf_pages: [1]", "pdf_pages: one")}, [("bad-locators", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("pdf_pages: [1]", "pdf_pages: [x]")}, [("bad-locators", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("title: Overview", "title: Other")}, [("bad-front-matter", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("type: Overview", "type: Person")}, [("bad-front-matter", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("status: draft", "status: final")}, [("bad-front-matter", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("status: draft", "status: draft\nverified: false")}, []),
        ({"overview.md": CLEAN["overview.md"].replace("status: draft", "status: draft\nverified: []")}, [("bad-front-matter", "overview.md")]),
        ({"overview.md": CLEAN["overview.md"].replace("title: Overview", "title: Overview # x")}, [("bad-front-matter", "overview.md")] * 2),
        ({"overview.md": None, "index.md": "- [H](concepts/harbour.md)\n"}, [("broken-link", "concepts/harbour.md"), ("orphan", "concepts/harbour.md")]),
        ({"_plan/x.md": "# junk"}, []),
        ({"README.md": "[x](nowhere.md)"}, []),
    ],
)
def test_one_rule_at_a_time(spark, change, wanted):
    notes = {k: v for k, v in (CLEAN | change).items() if v is not None}
    assert kinds(spark, notes) == sorted(wanted)


def test_unreadable_notes_and_shared_titles(spark):
    assert ("bad-encoding", "odd.md") in kinds(spark, CLEAN | {"odd.md": None})
    twin = CLEAN | {"concepts/twin.md": CLEAN["concepts/harbour.md"]}
    assert ("duplicate-title", "concepts/harbour.md") in kinds(spark, twin)


def test_case_dossiers_name_an_absence(spark):
    for limits, found in (("", True), ("## Evidence limits\n\nMuch praise.\n", True), ("## Evidence limits\n\nNo witness is named.\n", False)):
        notes = CLEAN | {"cases/a.md": fixtures.note("Case Dossier", "A", f"[O](../overview.md)\n\n{limits}")}
        assert (("no-evidence-limits", "cases/a.md") in kinds(spark, notes)) == found


def test_audit_kinds(spark):
    base = fixtures.note("Concept", "A", "x")
    cases = {
        "concepts/a.md": (base, []),
        "concepts/b.md": ("# no block", ["missing-fm"]), "concepts/c.md": ("---\n---\n# c", ["missing-fm"]), "concepts/d.md": ("---\ntitle: d", ["missing-fm"]),
        "concepts/e.md": (base.replace("type: Concept\n", ""), ["missing-type"]), "people/f.md": (base, ["wrong-type"]), "odd/g.md": (base, ["unknown-location"]),
        "concepts/h.md": (base.replace("title: A\n", ""), ["missing-title"]), "concepts/i.md": (base.replace("# A", "# B"), ["title-mismatch"]),
        "concepts/j.md": (base.replace("# A", "A"), ["title-mismatch"]), "concepts/k.md": (base.replace("A short invented description that has eight words", "too short"), ["weak-description"]),
        "concepts/l.md": (base.replace("tags: [demo, note]", "tags: x"), ["missing-tags"]), "concepts/m.md": (base.replace("semantic_note: true", "semantic_note: 1"), ["not-draft-unverified"]),
        "concepts/n.md": (base.replace("resource: book.pdf, ", ""), ["missing-sources"]), "concepts/index.md": ("---\na: b\n---\n", ["no-fm-expected"]), "README.md": ("x", []),
    }
    notes = frame(spark, {k: v for k, (v, _) in cases.items()})
    got = {}
    for r in lint.audit(notes).collect():
        got.setdefault(r.relpath, []).append(r.kind)
    assert got == {k: v for k, (_, v) in cases.items() if v}
    table = lint.audit_table(notes.withColumn("dir", F.lit("d"))).first().asDict()
    assert table["notes"] == 14 and table["errors"] == sum(len(v) for _, v in cases.values()) and table["missing-fm"] == 3 and table["wrong-type"] == 1


def test_wikilinks_resolve_in_order(spark):
    notes = {
        "a/one.md": "[[b/two]] [[two.md]] [[local]] [[TWIN]] [[Uniq]] [[none]] [[#here]] [[one|x]]", "b/two.md": "# t", "a/local.md": "", "local.md": "",
        "c/twin.md": "", "d/Twin.md": "", "e/uniq.md": "", "two.md": "",
    }
    own = frame(spark, notes)
    got = {r.raw: (r.resolved, r.problem) for r in linkgraph.resolve_wikilinks(own, own.select("path")).collect()}
    assert got["b/two"] == ("b/two.md", None) and got["two.md"] == ("two.md", None) and got["local"] == ("local.md", None)
    assert got["TWIN"] == (None, "ambiguous; candidates: c/twin.md, d/Twin.md") and got["Uniq"] == ("e/uniq.md", None)
    assert got["none"] == (None, "target does not exist") and got["#here"] == ("a/one.md", None) and got["one|x"] == ("a/one.md", None)


def test_markdown_links_and_vault_report(spark):
    notes = {"a/one.md": "[x](../b) [y](/b/index.md) [z](http://q) [w](gone.md#p) ![i](p.png)", "b/index.md": "[o](../a/one.md)", "Lone.md": "# one"}
    own = frame(spark, notes)
    report = linkgraph.vault_report(own, own.select("path"))
    got = {r.raw: (r.resolved, r.external, r.problem) for r in linkgraph.resolve_markdown(own, own.select("path")).collect()}
    assert got["../b"] == ("b/index.md", False, None) and got["/b/index.md"][0] == "b/index.md" and got["http://q"][1]
    assert got["gone.md#p"] == (None, False, "target does not exist")
    counts = report["counts"].first()
    assert (counts.markdown_files, counts.external_links, counts.broken_or_ambiguous_links, counts.orphan_notes, counts.status) == (3, 1, 1, 1, "failed")
    assert counts.duplicate_titles == 1


PAGES = {1: fixtures.PAGE_ONE, 2: fixtures.PAGE_TWO}


def quote_notes(body, cites=(1,)):
    links = "".join(f"[p](../sources/pdf-pages/page-{p:04d}.md)" for p in cites)
    notes = {"concepts/a.md": f"---\nsemantic_note: true\ntitle: “{'t' * 50}”\n---\n# A\n\n{body}\n\n{links}\n"}
    return notes | {f"sources/pdf-pages/page-{p:04d}.md": fixtures.gateway(p, t) for p, t in PAGES.items()}


ONE, TWO = fixtures.PAGE_ONE, fixtures.PAGE_TWO


@pytest.mark.parametrize(
    "body, cites, wanted",
    [
        (f"“{ONE[:50]}”", (1,), ["supported"]),
        (f"“{ONE[:39]}”", (1,), []),
        (f"“{ONE[:40]}”", (1,), ["supported"]),
        (f'He says "{ONE[:45]}" and prose "{ONE[10:60]}" here', (1,), ["supported", "supported"]),
        (f"“{TWO[:50]}”", (1,), ["elsewhere"]),
        (f"“{ONE[-30:]} {TWO[:30]}”", (1, 2), ["supported"]),
        (f"“{ONE[:20]}… {ONE[40:70]}”", (1,), ["supported"]),
        (f"“{ONE[40:70]}… {ONE[:20]}”", (1,), ["unsupported"]),
        (f"“{ONE[:50].replace('tide', 'wind').replace('harbour', 'castle')}”", (1,), ["unsupported"]),
        (f"“{ONE[:50].replace(' ', '', 2)}”", (1,), ["supported"]),
        (f"“{ONE[:20]}□{ONE[20:60]}”", (1,), ["supported"]),
        (f"“{ONE[:50]}.”", (1,), ["supported"]),
        (f"| “{ONE[:50]}” |", (1,), []),
        (f"## Evidence limits\n“{'never said by any one at all in it ' * 2}”\n## Next\n", (1,), []),
        (f"“[{ONE[:50]}](x)”", (1,), []),
        (f"“{'日本語の文章は本にない' * 5}”", (1,), ["unsupported"]),
        (f"“{ONE[:50]}” and again “{ONE[:50]}”", (1,), ["supported"]),
    ],
)
def test_quotations(spark, body, cites, wanted):
    got = quotations.verify(frame(spark, quote_notes(body, cites))).orderBy("ord").collect()
    assert [r.status for r in got] == wanted


def test_verdicts(spark):
    verdict = lambda body: quotations.report(frame(spark, quote_notes(body))).first()
    assert verdict("none").verdict == "inconclusive" and verdict("none").support_rate is None
    assert verdict(f"“{ONE[:50]}”").verdict == "clear"
    row = verdict(f"“{ONE[:50]}” “{TWO[:50]}” “{'never said by any one at all ' * 2}”")
    assert (row.verdict, row.checked, row.supported, row.elsewhere, row.unsupported, row.support_rate) == ("findings", 3, 1, 1, 1, 0.3333)
