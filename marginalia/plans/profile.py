"""Profiles, locks and run settings: small strict documents, checked on the driver."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.unicode import canonical_json
from marginalia.operators import integrity, scoping
from marginalia.sources import sinks

# Schema versions, sections, keep rules, floors and note types of a profile.
PROFILE_VERSION, LOCK_VERSION = 1, 1
SECTIONS = ("primary_text", "citation_apparatus")
KEEP = ("before", "after")
FLOORS = ("case_dossiers", "concept_notes", "section_notes", "claims", "motifs")
NOTE_TYPES = (
    "Overview", "Reading Guide", "Chapter", "Section", "Case Dossier", "Concept", "Person", "Synthesis", "Source Guide", "Open Question",
)
SHORTEST_REASON = 12
DIGEST = re.compile(r"[0-9a-f]{64}")
IDENT = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


class ProfileError(ValueError):
    """A profile or lock that must not be used."""


def _need(ok: bool, say: str) -> None:
    if not ok:
        raise ProfileError(say)


def _keys(value: Any, at: str, required: set[str], optional: set[str] = frozenset()) -> dict:
    _need(isinstance(value, dict), f"{at} must be an object")
    _need(not required - value.keys(), f"{at} is missing {sorted(required - value.keys())}")
    _need(not value.keys() - required - optional, f"{at} has unknown fields {sorted(value.keys() - required - optional)}")
    return value


def _text(value: Any, at: str) -> str:
    _need(isinstance(value, str) and bool(value.strip()), f"{at} must be a non-empty string")
    return value


def _number(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _pages(value: Any, at: str, empty: bool = False) -> list[int]:
    good = isinstance(value, list) and all(_number(p) and p > 0 for p in value) and value == sorted(set(value))
    _need(good and (empty or bool(value)), f"{at} must be ascending distinct page numbers")
    return value


def _furniture(rules: Any) -> list[tuple[str, str]]:
    _need(isinstance(rules, list), "page_furniture must be a list")
    out = []
    for k, rule in enumerate(rules):
        at = f"page_furniture[{k}]"
        _keys(rule, at, {"pattern", "reason"})
        reason = _text(rule["reason"], f"{at}.reason")
        _need(len(reason) >= SHORTEST_REASON, f"{at}.reason must say why")
        try:
            scoping.java_pattern(_text(rule["pattern"], f"{at}.pattern"))
        except (re.error, ValueError) as e:
            raise ProfileError(f"{at}.pattern: {e}") from e
        out.append((rule["pattern"], reason))
    _need(len({p for p, _ in out}) == len(out) and len({r for _, r in out}) == len(out), "page_furniture repeats a pattern or reason")
    return out


def _apparatus(value: Any, pages: list[int]) -> dict | None:
    _need((value is None) == (not pages), "apparatus and apparatus_pages must be declared together")
    if value is None:
        return None
    _keys(value, "apparatus", {"id", "label", "entry_first", "entry_last", "entry_pattern"})
    _need(_number(value["entry_first"]) and _number(value["entry_last"]) and 0 < value["entry_first"] <= value["entry_last"], "apparatus entries must ascend")
    try:
        _need(re.compile(value["entry_pattern"]).groups >= 1, "apparatus.entry_pattern needs a group")
    except re.error as e:
        raise ProfileError(f"apparatus.entry_pattern: {e}") from e
    return value


@dataclass(frozen=True)
class Profile:
    data: dict
    primary: list[int]
    apparatus_pages: list[int]
    furniture: list[tuple[str, str]]
    boundaries: list[dict]
    apparatus: dict | None
    banners: dict
    floors: dict[str, int | None] = field(default_factory=dict)

    @property
    def sha256(self) -> str:
        return sha256_json(self.data)

    @property
    def scope_pages(self) -> list[int]:
        return self.primary + self.apparatus_pages


def sha256_json(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def check_profile(data: dict) -> Profile:
    """A profile whose every field is known and right; anything else is an error."""
    _keys(data, "profile", {"schema_version", "profile_id", "source", "document", "scope", "architecture", "output"})
    _need(data["schema_version"] == PROFILE_VERSION and _number(data["schema_version"]), "unsupported schema_version")
    _need(isinstance(data["profile_id"], str) and bool(IDENT.fullmatch(data["profile_id"])), "profile_id must be a slug")
    for name, keys in (("source", {"pdf", "extraction"}), ("document", {"id", "title", "author"}), ("output", {"format", "okf_version"})):
        own = _keys(data[name], name, keys)
        for k in keys:
            _text(own[k], f"{name}.{k}")
    for k in ("pdf", "extraction"):
        _need(not data["source"][k].startswith("/") and ".." not in data["source"][k].split("/"), f"source.{k} must be a relative path")
    scope = _keys(
        data["scope"], "scope", {"id", "title", "label", "primary_pages", "apparatus_pages", "canonical_banners", "boundaries", "page_furniture"}, {"apparatus"}
    )
    primary, extra = _pages(scope["primary_pages"], "primary_pages"), _pages(scope["apparatus_pages"], "apparatus_pages", True)
    _need(not set(primary) & set(extra), "primary_pages and apparatus_pages overlap")
    apparatus = _apparatus(scope.get("apparatus"), extra)
    banners = _keys(scope["canonical_banners"], "canonical_banners", {"primary"}, {"apparatus"})
    _need(("apparatus" in banners) == bool(extra), "canonical_banners.apparatus goes with apparatus pages")
    for k, b in enumerate(scope["boundaries"]):
        _keys(b, f"boundaries[{k}]", {"page", "marker", "keep", "action", "note"})
        _need(b["page"] in primary + extra, f"boundaries[{k}].page is out of scope")
        _need(b["keep"] in KEEP, f"boundaries[{k}].keep must be one of {KEEP}")
        _text(b["marker"], f"boundaries[{k}].marker")
    _need(len({b["page"] for b in scope["boundaries"]}) == len(scope["boundaries"]), "a page has two boundaries")
    plan = _keys(data["architecture"], "architecture", {"rationale", "minimums", "nullable_rationales", "required_note_types"})
    floors = _keys(plan["minimums"], "minimums", set(FLOORS))
    for k, n in floors.items():
        _need(n is None or (_number(n) and n >= 0), f"minimums.{k} must be a count or null")
        _need(n is not None or bool(str(plan["nullable_rationales"].get(k, "")).strip()), f"minimums.{k} is null without a rationale")
    _need(set(plan["required_note_types"]) <= set(NOTE_TYPES), "required_note_types has an unknown type")
    return Profile(data, primary, extra, _furniture(scope["page_furniture"]), scope["boundaries"], apparatus, banners, floors)


def infer_profile(
    metadata: DataFrame, pages: DataFrame, pdf: str, extraction: str, *, primary: list[int] | None = None,
    apparatus_pages: list[int] | None = None, apparatus: dict | None = None,
) -> dict:
    """A starter profile from what an extraction left: metadata (key, value) and pages (page).

    Title and author come from the metadata, else from the file's name and as unknown; all
    pages are primary unless chosen. Floors are zero, to be reviewed.
    """
    known = {r["key"]: r["value"].strip() for r in metadata.filter("key IN ('title', 'author') AND value IS NOT NULL").collect()}
    page_count = pages.agg(F.max("page")).first()[0] or 0
    _need(page_count > 0, "the extraction has no pages")
    title = known.get("title") or re.sub(r"\.[^.]*$", "", pdf.rsplit("/", 1)[-1]).replace("_", " ").strip()
    slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or "document"
    extra = sorted(set(apparatus_pages or []))
    own = sorted(set(primary)) if primary else list(range(1, page_count + 1))
    _need(max(own + extra) <= page_count, f"a selected page exceeds the extraction's {page_count} pages")
    # Banners, and what an unnamed author is called.
    banners = {"primary": "=== PRIMARY TEXT ==="} | ({"apparatus": "=== CITATION APPARATUS ==="} if extra else {})
    data = {
        "schema_version": PROFILE_VERSION, "profile_id": f"{slug}-selected-scope", "source": {"pdf": pdf, "extraction": extraction},
        "document": {"id": slug, "title": title, "author": known.get("author") or "Unknown author"},
        "scope": {
            "id": "selected-scope", "title": "Selected scope", "label": f"{len(own)} selected primary PDF page(s)",
            "primary_pages": own, "apparatus_pages": extra, "canonical_banners": banners, "boundaries": [], "page_furniture": [],
        } | ({"apparatus": apparatus} if apparatus else {}),
        "architecture": {
            "rationale": "Floors are zero and must be reviewed against the source before any run.",
            "minimums": dict.fromkeys(FLOORS, 0), "nullable_rationales": {}, "required_note_types": list(NOTE_TYPES),
        },
        "output": {"format": "Open Knowledge Format", "okf_version": "0.2"},
    }
    check_profile(data)
    return data


#: Where the settings of a run lie in a profile and, if there is one, in its lock.
RUNTIME = {
    "profile_id": "profile_id", "document_id": "document.id", "document_title": "document.title", "document_author": "document.author",
    "scope_id": "scope.id", "scope_title": "scope.title", "scope_label": "scope.label", "primary_pages": "scope.primary_pages",
    "apparatus_pages": "scope.apparatus_pages", "apparatus_label": "scope.apparatus.label", "apparatus_slug": "scope.apparatus.id",
    "apparatus_entry_pattern": "scope.apparatus.entry_pattern", "canonical_banners": "scope.canonical_banners", "boundaries": "scope.boundaries",
    "page_furniture": "scope.page_furniture", "architecture": "architecture", "output": "output", "source_pdf": "source.pdf",
    "extraction_root": "source.extraction",
}
RUNTIME_LOCK = {
    "source_pdf_sha256": "source.pdf", "canonical_scope_sha256": "scope.canonical_sha256",
    "canonical_scope_characters": "scope.canonical_characters", "page_text_characters": "scope.page_text_characters",
}


def flat(profile: Profile, lock: dict | None = None) -> dict:
    """The profile's (and its lock's) settings under one name each; absent ones are null."""

    def at(value: Any, path: str) -> Any:
        for step in path.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        return value

    out = {name: at(profile.data, path) for name, path in RUNTIME.items()}
    ends = profile.apparatus or {}
    out["apparatus_range"] = [ends["entry_first"], ends["entry_last"]] if ends else []
    return out | ({name: at(lock, path) for name, path in RUNTIME_LOCK.items()} if lock else {})


def scoped_pages(spark: SparkSession, profile: Profile, pages: DataFrame) -> DataFrame:
    sections = spark.createDataFrame(
        [(p, SECTIONS[0]) for p in profile.primary] + [(p, SECTIONS[1]) for p in profile.apparatus_pages], "page int, section string"
    )
    rules = spark.createDataFrame(
        [(b["page"], b["marker"], b["keep"], b["action"]) for b in profile.boundaries], "page int, marker string, keep string, action string"
    )
    return scoping.scope(pages, sections, profile.furniture, rules)


def build_lock(spark: SparkSession, profile: Profile, pages: DataFrame, inventory: DataFrame, source: dict[str, str]) -> dict:
    """The hashes that fix a profile's source. pages: page, path, text, sha256.

    Fails on bytes that differ from the inventory, on a rule that matched nothing, on a
    missing page and on an apparatus that does not run through.
    """
    wanted = pages.filter(F.col("page").isin(profile.scope_pages))
    bad = integrity.page_hash_mismatches(wanted, inventory).limit(1).collect()
    _need(not bad, f"page checksum mismatch: {bad[0]['path'] if bad else ''}")
    scoped = scoped_pages(spark, profile, wanted.select("page", "text")).join(wanted.select("page", F.col("sha256").alias("file_sha256")), "page").persist()
    unused = [r["reason"] for r in scoping.unused_furniture(scoped, profile.furniture).orderBy("reason").collect()]
    _need(not unused, f"page_furniture patterns matched nothing: {'; '.join(unused)}")
    rows = scoped.select(
        "page", "section", "boundary_action", "furniture_removed", "sha256", "file_sha256", F.length("text").alias("n")
    ).orderBy("page").collect()
    _need([r["page"] for r in rows] == sorted(profile.scope_pages), "scoped pages are missing")
    whole = scoping.canonical(scoped, profile.banners["primary"], profile.banners.get("apparatus")).first()
    found: list[int] = []
    if profile.apparatus:
        first, last = profile.apparatus["entry_first"], profile.apparatus["entry_last"]
        text = scoped.filter(F.col("section") == SECTIONS[1]).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("t")
        )
        numbers = scoping.running_sequence(scoping.entry_numbers(F.col("t"), profile.apparatus["entry_pattern"]), F.lit(first), F.lit(last))
        found = text.select(numbers.alias("n")).first()["n"]
        _need(found == list(range(first, last + 1)), f"{profile.apparatus['label']} are not continuous {first}-{last}; found {found}")
    lock = {
        "lock_version": LOCK_VERSION, "profile_id": profile.data["profile_id"], "profile_sha256": profile.sha256, "source": dict(source),
        "scope": {
            "canonical_sha256": whole["canonical_sha256"], "canonical_characters": whole["canonical_characters"],
            "page_text_characters": sum(r["n"] for r in rows),
            "pages": {str(r["page"]): {
                "native_sha256": r["file_sha256"], "scoped_sha256": r["sha256"], "scoped_characters": r["n"], "section": r["section"],
                "boundary_action": r["boundary_action"], "furniture_removed": r["furniture_removed"],
            } for r in rows},
            "apparatus_entries": found,
        },
    }
    scoped.unpersist()
    return check_lock(lock)


def check_lock(lock: dict) -> dict:
    _keys(lock, "lock", {"lock_version", "profile_id", "profile_sha256", "source", "scope"})
    _need(lock["lock_version"] == LOCK_VERSION, "unsupported lock_version")
    _need(bool(DIGEST.fullmatch(str(lock["profile_sha256"]))), "lock.profile_sha256 is no digest")
    scope = _keys(lock["scope"], "lock.scope", {"canonical_sha256", "canonical_characters", "page_text_characters", "pages", "apparatus_entries"})
    for page, own in scope["pages"].items():
        _need(page.isdigit() and own["section"] in SECTIONS, f"lock.scope.pages.{page} is malformed")
        for k in ("native_sha256", "scoped_sha256"):
            _need(bool(DIGEST.fullmatch(str(own[k]))), f"lock.scope.pages.{page}.{k} is no digest")
    return lock


def verify_lock(spark: SparkSession, lock: dict, now: dict) -> None:
    """Fails with the first difference between a stored and a recomputed lock."""
    if lock != now:
        raise ProfileError("source drifted: " + integrity.first_difference(spark, lock, now))


def stage(spark: SparkSession, profile: Profile, lock: dict, pages: DataFrame, inventory: DataFrame, source: dict[str, str], folder: str) -> dict:
    """Verifies the lock against the source as it is now and leaves the scope in a fresh folder.

    ``folder`` gets the scoped pages as Parquet and, last of all, manifest.json, which is
    also returned: without it a stage is incomplete. An existing folder is an error.
    """
    _need(not sinks.exists(spark, folder), f"{folder} exists")
    verify_lock(spark, lock, build_lock(spark, profile, pages, inventory, source))
    wanted = pages.filter(F.col("page").isin(profile.scope_pages)).select("page", "text")
    sinks.exclusive(scoped_pages(spark, profile, wanted).orderBy("page"), f"{folder}/pages")
    settings = flat(profile, lock)
    manifest = {
        "status": "passed", "profile_sha256": profile.sha256, "profile_lock_sha256": sha256_json(lock), "pages": lock["scope"]["pages"], "staged": "pages",
    } | {k: settings[k] for k in ("profile_id", "source_pdf", "extraction_root", *RUNTIME_LOCK)}
    sinks.atomic_text(spark, f"{folder}/manifest.json", canonical_json(manifest), overwrite=False)
    return manifest


def freeze(spark: SparkSession, inventory: dict, path: str) -> dict:
    """Writes an accepted inventory once, with its digest; a second time is an error."""
    record = {"inventory_sha256": sha256_json(inventory), "inventory": inventory}
    sinks.atomic_text(spark, path, canonical_json(record), overwrite=False)
    return record


@dataclass(frozen=True)
class RunSettings:
    """Limits of a run, in seconds and counts."""

    # Default budgets.
    smoke_seconds: int = 5_400
    build_seconds: int = 18_000
    heartbeat_seconds: int = 15
    smoke_fresh_hours: int = 24
    review_rounds: int = 5
    lint_rounds: int = 6
    completeness_rounds: int = 3

    @classmethod
    def of(cls, data: dict) -> RunSettings:
        unknown = data.keys() - cls.__dataclass_fields__.keys()
        _need(not unknown, f"unknown settings {sorted(unknown)}")
        for k, v in data.items():
            _need(_number(v) and v > 0, f"{k} must be a positive integer")
        return cls(**data)
