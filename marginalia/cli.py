"""python -m marginalia: query, lint, verify, status, profiles and their locks over a note folder."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from marginalia.operators import fulltext, integrity, linkgraph, lint, quotations
from marginalia.plans import profile as profiles
from marginalia.session import local_session
from marginalia.sources import files, sinks


def _show(rows, as_json: bool) -> None:
    for r in rows:
        d = r.asDict(recursive=True)
        print(json.dumps(d, ensure_ascii=False, default=str) if as_json else "  ".join(str(v) for v in d.values()))


def run_query(spark, args) -> int:
    if args.limit < 1:
        print("limit must be at least 1", file=sys.stderr)
        return 2
    try:
        found = fulltext.search(files.markdown(spark, args.wiki), args.terms, args.limit)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    _show(found.collect(), args.json)
    return 0


def run_lint(spark, args) -> int:
    notes = files.markdown(spark, args.wiki).persist()
    every = files.file_inventory(spark, args.wiki).select("path")
    issues = lint.lint(notes, every).orderBy("kind", "file", "detail").collect()
    audit = lint.audit(notes.filter("text IS NOT NULL")).orderBy("relpath", "kind").collect()
    _show(issues + audit, args.json)
    return 1 if issues or audit else 0


def run_links(spark, args) -> int:
    notes = files.markdown(spark, args.wiki).filter("text IS NOT NULL").persist()
    report = linkgraph.vault_report(notes, files.file_inventory(spark, args.wiki).select("path"))
    counts = report["counts"].collect()
    _show(counts + report["problems"].collect(), args.json)
    return 0 if counts[0]["status"] == "passed" else 1


def run_verify(spark, args) -> int:
    notes = files.markdown(spark, args.wiki).filter("text IS NOT NULL").persist()
    if args.checksums:
        listed = files.read_checksums(spark, args.checksums)
        actual = files.file_inventory(spark, args.wiki).filter(F.col("path") != args.checksums.rsplit("/", 1)[-1])
        faults = integrity.checksum_diff(listed, actual).orderBy("path").collect()
        if faults:
            _show(faults, args.json)
            return 1
    row = quotations.report(notes, args.min_length).first()
    _show([row], args.json)
    _show(quotations.verify(notes, args.min_length).filter("status <> 'supported'").orderBy("note", "ord").collect(), args.json)
    return 1 if row["verdict"] == "inconclusive" else 0


def run_status(spark, args) -> int:
    index = files.read_checksums(spark, f"{args.run}/artifacts.sha256")
    faults = integrity.artifact_check(index, files.file_inventory(spark, args.run)).orderBy("path").collect()
    _show(faults, args.json)
    return 5 if faults else 0


def run_profile_init(spark, args) -> int:
    """A starter profile beside an extraction that left metadata.json and page texts."""
    try:
        known = files.json_document(spark, f"{args.extraction}/metadata.json", "metadata").get("pdf", {}).get("metadata", {})
        rows = spark.createDataFrame([(k, v) for k, v in known.items() if isinstance(v, str)], "key string, value string")
        name = args.extraction.rstrip("/").rsplit("/", 1)[-1]
        data = profiles.infer_profile(rows, files.page_texts(spark, args.extraction).select("page"), args.pdf, name)
        sinks.atomic_text(spark, args.output, files.dumps(data), overwrite=False)
    except (ValueError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 2
    print(profiles.sha256_json(data))
    return 0


def run_profile(spark, args) -> int:
    try:
        own = profiles.check_profile(files.json_document(spark, args.profile, "profile"))
        if args.action == "lock":
            root = args.extraction
            sources = {k: profiles.sha256_json(v) for k, v in own.data["source"].items()}
            lock = profiles.build_lock(spark, own, files.page_texts(spark, root), files.read_checksums(spark, f"{root}/checksums.sha256"), sources)
            sinks.atomic_text(spark, args.output, files.dumps(lock), overwrite=False)
    except (ValueError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 2
    print(own.sha256)
    return 0


def run_init(spark, args) -> int:
    try:
        sinks.atomic_text(spark, args.output, files.dumps(profiles.RunSettings().__dict__), overwrite=False)
    except FileExistsError:
        print(f"{args.output} exists", file=sys.stderr)
        return 2
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    commands = top.add_subparsers(required=True)

    def add(name, run, *positional):
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.add_argument("--json", action="store_true")
        p.set_defaults(call=run)
        return p

    add("query", run_query, "wiki", "terms").add_argument("--limit", type=int, default=10)
    add("lint", run_lint, "wiki")
    add("links", run_links, "wiki")
    verify = add("verify", run_verify, "wiki")
    verify.add_argument("--min-length", type=int, default=quotations.SHORTEST)
    verify.add_argument("--checksums")
    add("status", run_status, "run")
    add("init", run_init, "output")
    add("profile-init", run_profile_init, "extraction", "pdf", "output")
    own = add("profile", run_profile, "action", "profile")
    own.add_argument("--extraction")
    own.add_argument("--output")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    return args.call(spark or local_session(), args)
