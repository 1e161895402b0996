"""Operators over a few invented notes and inventories; no query is registered for these."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import eventlog, integrity, inventory, linkgraph, lint, quotations
from marginalia.plans import fixtures

#: What they must give, read off those notes by hand.
EXPECTED = {
    "lint_kinds": {
        ("bad-front-matter", 7), ("bad-locators", 1), ("broken-image", 1), ("broken-link", 4), ("duplicate-title", 1), ("index-ghost", 1), ("no-evidence-limits", 1),
        ("no-guardrail", 1), ("no-instances", 1), ("no-sources", 1), ("not-in-index", 4), ("orphan", 4),
    },
    "okf_pivot": {("demo", 9, 6, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 0)},
    "quote_support_full": {
        ("cases/lamp.md", 0, "and nobody on the northern shore could say who had… amp in the tower that winter n", "elsewhere"),
        ("cases/lamp.md", 1, "This sentence was never written by anybody in that book at all.", "unsupported"),
        ("concepts/harbour.md", 0, "The harbour master wrote that the tide had turned before the", "supported"),
        ("concepts/harbour.md", 1, "and nobody on the northern shore could say who had lit", "elsewhere"),
    },
    "quote_report": {(6, 4, 1, 2, 1, 0.25, "findings")},
    "vault_links": {
        ("index.md", "cases/gone.md", "markdown-link", "target does not exist"), ("people/twin.md", "../cases/none.md", "markdown-link", "target does not exist"),
        ("people/twin.md", "nowhere", "wikilink", "target does not exist"),
    },
    "plan_violations": {
        (4, 2, 0, "duplicate episode slug boats-wait"), (4, 3, 0, "duplicate episode slug lamp-burns"), (8, -1, 0, "inventory.motifs needs at least 2 entries"),
        (8, 0, 0, "inventory.motifs must be a non-empty string list"),
    },
    "missing_notes": {
        ("cases/boats-wait.md", "episode: Boats"), ("cases/lamp-burns.md", "episode: Lamp"), ("chapters/01-the-harbour.md", "scope hub"), ("concepts/reading.md", "concept: Reading"),
        ("concepts/tide.md", "concept: Tide"), ("concepts/witness.md", "concept: Witness"), ("people/ada-writer-in-demo.md", "author in scope: Ada Writer"),
        ("people/witnesses.md", "role roster: witnesses (1 named)"), ("reading-guide.md", "reading guide"), ("sections/01-tide.md", "section: Tide"), ("sections/02-lamp.md", "section: Lamp"),
        ("synthesis/argument-map.md", "argument map"), ("synthesis/claim-evidence-matrix.md", "claim-evidence matrix"), ("synthesis/critical-reading.md", "critical reading"),
        ("synthesis/motif-matrix.md", "motif matrix"),
    },
    "lock_diff": {
        ("lock.a.b", "expected 1, got 2"), ("lock.a.c", "expected 2, got 1"), ("lock.a.c[1]", "missing field"), ("lock.d", "missing field"), ("lock.e", "unexpected field"),
    },
}


def lint_kinds(spark):
    return eventlog.kind_counts(lint.lint(fixtures.notes(spark)))


def okf_pivot(spark):
    return lint.audit_table(fixtures.notes(spark).withColumn("dir", F.lit("demo")))


def quote_support_full(spark):
    return quotations.verify(fixtures.notes(spark))


def quote_report(spark):
    return quotations.report(fixtures.notes(spark))


def vault_links(spark):
    own = fixtures.notes(spark)
    return linkgraph.vault_report(own, own.select("path"))["problems"]


def plan_violations(spark):
    broken = fixtures.INVENTORY | {"episodes": fixtures.INVENTORY["episodes"] * 2, "motifs": [" "]}
    return inventory.violations(inventory.load_inventory(spark, broken), [1, 2], "Ada Writer", {"motifs": 2})


def missing_notes(spark):
    return inventory.missing_notes(inventory.load_inventory(spark, fixtures.INVENTORY), "demo", fixtures.notes(spark))


def lock_diff(spark):
    return integrity.document_diff(spark, {"a": {"b": 1, "c": [1, 2]}, "d": "x"}, {"a": {"b": 2, "c": [1]}, "e": "x"})


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_invented_notes(spark, name):
    got = [tuple(r) for r in globals()[name](spark).collect()]
    assert set(got) == EXPECTED[name] and len(got) == len(EXPECTED[name])
