"""Small invented corpora with every shape that the driver tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def note(kind: str, title: str, body: str, pages: str = "[1]", **other: str) -> str:
    fields = {
        "type": kind, "title": title, "description": "A short invented description that has eight words", "tags": "[demo, note]",
        "pdf_pages": pages, "semantic_note": "true", "status": "draft", "sources": "\n  - { resource: book.pdf, page: 1 }",
    } | other
    head = "\n".join(f"{k}: {v}" for k, v in fields.items() if v != "-")
    return f"---\n{head}\n---\n# {title}\n\n{body}\n\n[page](../sources/pdf-pages/page-0001.md)\n\n## Sources\n\n- Book\n"


PAGE_ONE = "The harbour master wrote that the tide had turned before the boats were ready to leave the quay"
PAGE_TWO = "and nobody on the northern shore could say who had lit the lamp in the tower that winter night."


def gateway(page: int, text: str) -> str:
    return (
        f"---\ntype: Source Page\ntitle: Page {page}\ndescription: The verbatim scoped text of one source page\ntags: [page]\n---\n# Page {page}\n\n"
        f"````text\n{text}\n````\n\n## Sources\n\n- Book\n"
    )


NOTES = {
    "index.md": "# Index\n\n- [Overview](overview.md)\n- [Harbour](concepts/harbour.md)\n- [Gone](cases/gone.md)\n- [[lamp]]\n",
    "log.md": "# Log\n\n- started\n",
    "overview.md": note("Overview", "Overview", "See [Harbour](concepts/harbour.md) and [[lamp|the lamp]] and ![map](img/map.png)."),
    "concepts/harbour.md": note(
        "Concept", "Harbour",
        f"He says “{PAGE_ONE[:60]}” and also \"{PAGE_TWO[:55]}\" here.\n\n## Instances in scope\n\n- [Lamp](../cases/lamp.md)\n\n"
        "## Evidence status\n\nGood.",
    ),
    "cases/lamp.md": note(
        "Case Dossier", "The lamp", f"“{PAGE_TWO[:50]}… {PAGE_TWO[60:90]}” and “This sentence was never written by anybody in that book at all.”"
        "\n\n[Overview](../overview.md)\n\n## Evidence limits\n\nOnly praise.",
    ),
    "people/keeper.md": note("Person", "Keeper", "Nothing.", verified="[2024-01-01]", status="final", sources="-"),
    "people/twin.md": note("Concept", "Keeper", "Wrong folder. [[nowhere]] [lost](../cases/none.md)", pages="[1, 2]", tags="-"),
    "odd/place.md": "# Bare\n\nNo block here.\n",
    "synthesis/open-questions.md": note("Open Question", "Open questions", "Why? # not a comment", description="Few words # cut"),
    "sources/pdf-pages/page-0001.md": gateway(1, PAGE_ONE),
    "sources/pdf-pages/page-0002.md": gateway(2, PAGE_TWO),
}

INVENTORY = {
    "chapter": {
        "number": 1, "slug": "01-the-harbour", "title": "The harbour", "organizing_question": "Who lit the lamp?",
        "argument_steps": ["a", "b", "c", "d"], "establishes": ["tide"], "leaves_open": ["lamp"],
    },
    "sections": [
        {"order": 1, "slug": "01-tide", "title": "Tide", "pdf_pages": [1], "summary": "The tide turns."},
        {"order": 2, "slug": "02-lamp", "title": "Lamp", "pdf_pages": [1, 2], "summary": "The lamp is lit."},
    ],
    "episodes": [
        {"slug": "boats-wait", "title": "Boats", "pdf_pages": [1], "summary": "They wait.", "support": "One line.", "section_order": 1},
        {"slug": "lamp-burns", "title": "Lamp", "pdf_pages": [2], "summary": "It burns.", "support": "None.", "section_order": 2},
    ],
    "concepts": [
        {"slug": "tide", "title": "Tide", "kind": "substantive", "pdf_pages": [1], "summary": "Water."},
        {"slug": "witness", "title": "Witness", "kind": "epistemic", "pdf_pages": [2], "summary": "Who saw."},
        {"slug": "reading", "title": "Reading", "kind": "methodological", "pdf_pages": [1], "summary": "How."},
    ],
    "people": [
        {"name": "Ada Writer", "group": "author", "pdf_pages": [1], "role": "writes", "caution": "late"},
        {"name": "Keeper", "group": "witnesses", "pdf_pages": [2], "role": "sees", "caution": "alone"},
    ],
    "claims": [{"claim": "The tide turned.", "owner": "author", "evidence": "a line", "limit": "one source"}],
    "motifs": ["light"],
}


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTES.items()), "path string, text string")
