"""Profile inference, staging, frozen plans, extraction checks, digests and privacy shapes."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import cli
from marginalia.functions.unicode import plain_tokens
from marginalia.operators import extraction, leakscan, linkgraph, scoping
from marginalia.plans import profile as P
from marginalia.sources import sinks

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def pages(spark, texts=("one\n", "two\n", "three\n")):
    return spark.createDataFrame([(k, f"text/page-{k:04}.txt", t, SHA(t)) for k, t in enumerate(texts, start=1)], "page int, path string, text string, sha256 string")


def test_a_profile_is_inferred_from_metadata(spark):
    meta = spark.createDataFrame([("title", " The Tide, Vol. 2 "), ("author", None), ("producer", "x")], "key string, value string")
    data = P.infer_profile(meta, pages(spark), "books/the_tide.pdf", "out/tide")
    assert data["document"] == {"id": "the-tide-vol-2", "title": "The Tide, Vol. 2", "author": "Unknown author"}
    assert data["scope"]["primary_pages"] == [1, 2, 3] and data["profile_id"] == "the-tide-vol-2-selected-scope"
    bare = P.infer_profile(meta.limit(0), pages(spark), "books/the_tide.pdf", "out/tide", primary=[2])
    assert bare["document"]["title"] == "the tide" and bare["scope"]["label"].startswith("1 selected")
    notes = {"id": "notes", "label": "Notes", "entry_first": 1, "entry_last": 2, "entry_pattern": r"(?m)^(\\d+)\\."}
    with_notes = P.infer_profile(meta, pages(spark), "b.pdf", "out", primary=[1, 2], apparatus_pages=[3], apparatus=notes)
    assert with_notes["scope"]["canonical_banners"].keys() == {"primary", "apparatus"}
    for wrong in ({"primary": [9]}, {"primary": [1], "apparatus_pages": [1], "apparatus": notes}, {"apparatus_pages": [3], "primary": [1]}):
        with pytest.raises(P.ProfileError):
            P.infer_profile(meta, pages(spark), "b.pdf", "out", **wrong)
    with pytest.raises(P.ProfileError):
        P.infer_profile(meta, pages(spark).limit(0), "b.pdf", "out")


def test_stage_verifies_and_writes_once(spark, tmp_path):
    own = P.check_profile(P.infer_profile(spark.createDataFrame([("title", "T")], "key string, value string"), pages(spark), "b.pdf", "out", primary=[1, 3]))
    rows = pages(spark)
    inventory, source = rows.select("path", "sha256"), {"pdf": "x"}
    lock = P.build_lock(spark, own, rows, inventory, source)
    settings = P.flat(own, lock)
    assert settings["canonical_scope_sha256"] == lock["scope"]["canonical_sha256"] and settings["document_title"] == "T"
    assert settings["apparatus_range"] == [] and settings["apparatus_label"] is None and "source_pdf_sha256" not in P.flat(own)
    manifest = P.stage(spark, own, lock, rows, inventory, source, f"{tmp_path}/stage")
    assert json.load(open(f"{tmp_path}/stage/manifest.json")) == manifest
    staged = spark.read.parquet(f"{tmp_path}/stage/pages")
    assert sorted(r.page for r in staged.collect()) == [1, 3]
    with pytest.raises(P.ProfileError, match="exists"):
        P.stage(spark, own, lock, rows, inventory, source, f"{tmp_path}/stage")
    changed = pages(spark, ("one\n", "two\n", "other\n"))
    with pytest.raises(P.ProfileError, match="drifted"):
        P.stage(spark, own, lock, changed, changed.select("path", "sha256"), source, f"{tmp_path}/again")
    assert not sinks.exists(spark, f"{tmp_path}/again")


def test_a_plan_is_frozen_once(spark, tmp_path):
    record = P.freeze(spark, {"motifs": ["light"]}, f"{tmp_path}/plan.json")
    assert record["inventory_sha256"] == P.sha256_json({"motifs": ["light"]}) and json.load(open(f"{tmp_path}/plan.json")) == record
    with pytest.raises(FileExistsError):
        P.freeze(spark, {"motifs": ["other"]}, f"{tmp_path}/plan.json")
    assert json.load(open(f"{tmp_path}/plan.json")) == record


def test_profile_init_from_the_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "tide"
    (folder / "text" / "native-pages").mkdir(parents=True)
    for k in (1, 2):
        (folder / "text" / "native-pages" / f"page-{k:04}.txt").write_text(f"page {k}")
    (folder / "metadata.json").write_text(json.dumps({"pdf": {"metadata": {"title": "The Tide", "pages": 2}}}))
    out = f"{tmp_path}/profile.json"
    assert cli.main(["profile-init", str(folder), "the_tide.pdf", out], spark) == 0
    data = json.load(open(out))
    assert data["document"]["id"] == "the-tide" and data["scope"]["primary_pages"] == [1, 2] and data["source"] == {"pdf": "the_tide.pdf", "extraction": "tide"}
    assert capsys.readouterr().out.strip() == P.check_profile(data).sha256
    assert cli.main(["profile-init", str(folder), "the_tide.pdf", out], spark) == 2


def test_extraction_checks(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    own = frame([(1,), (2,)], "page int")
    seen = frame([(1, 1, 5), (2, 1, 5), (2, 2, 6)], "page int, occurrence int, xref int")
    objects = frame([(5, "e", "n", None), (6, "e", None, "r")], "xref int, encoded_stream_file string, native_file string, rendered_file string")
    kinds = [(k, f"{k}/{p}") for k in ("text", "layout") for p in (1, 2)]
    outputs = [(1, f"ocr/{x}") for x in ("a.txt", "a.tsv")]
    grid = [(2, r, m, f"grid/{r}-{m}") for r in extraction.ROTATIONS for m in extraction.MODES]
    there = frame([(p,) for p in [p for _, p in kinds] + [p for _, p in outputs] + [g[3] for g in grid]], "path string")

    def run(**change):
        given = {
            "listed": objects.select("xref"), "page_files": frame(kinds, "kind string, path string"), "files": there, "targets": own.filter("page = 1"),
            "recognised": frame(outputs, "page int, path string"), "variants": frame(grid, "page int, rotation int, mode int, path string"),
            "variant_pages": own.filter("page = 2"), "counted_images": 3, "written_images": 2, "hashes": ("a", "a"), "pages": own, "occurrences": seen, "objects": objects,
        } | change
        first = [given.pop(k) for k in ("pages", "occurrences", "objects")]
        return {r.check: r.ok for r in extraction.checks(*first, 2, **given).collect()}

    good = run()
    assert all(good.values()) and len(good) == 12
    bad = lambda **change: {k for k, ok in run(**change).items() if not ok}
    assert bad(pages=own.limit(1)) == {"page_record_count"}
    assert bad(listed=frame([(5,), (6,), (7,)], "xref int")) == bad(listed=frame([(5,)], "xref int")) == {"listed_objects_extracted"}
    assert bad(counted_images=4, written_images=4) == {"image_count_matches", "no_image_missed"}
    assert bad(files=there.filter("path <> 'layout/2'")) == {"layout_pages_complete"}
    assert bad(files=there.filter("path <> 'ocr/a.tsv'")) == {"recognition_outputs_exist"}
    assert bad(variants=frame(grid[1:], "page int, rotation int, mode int, path string")) == {"fallback_complete"}
    assert bad(targets=own) == {"recognition_complete"} and bad(hashes=("a", "b")) == {"source_unchanged"}
    assert bad(occurrences=seen.withColumn("page", F.col("page") + 1)) == {"occurrences_have_pages"}
    assert bad(objects=objects.withColumn("encoded_stream_file", F.lit(None).cast("string"))) == {"objects_have_data"}


def test_canonical_digests_are_those_of_the_text(spark):
    rows = [("b", 2, "x  ", "primary_text"), ("a", 1, "", "primary_text"), ("a", 3, "n", "citation_apparatus"), ("b", 1, "é\n\n", "primary_text"), ("c", 1, "only", "citation_apparatus")]
    scoped = spark.createDataFrame(rows, "key string, page int, text string, section string")
    one = {r.key: (r.canonical_characters, r.canonical_sha256) for r in scoping.canonical(scoped, "P", "A", key="key").collect()}
    two = {r.key: (r.canonical_characters, r.canonical_sha256) for r in scoping.canonical_digest(scoped, "P", "A", key="key").collect()}
    assert one == two and len(two) == 3
    assert scoping.canonical_digest(scoped.limit(0), "P", "A", key="key").count() == 0


def test_without_inbound(spark):
    nodes = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c"), (4, None), (5, "/a")], "id int, path string")
    links = spark.createDataFrame([(1, "/a"), (2, "/b"), (2, "/c"), (3, "/c"), (5, "/x")], "source int, path string")
    assert sorted(r.id for r in linkgraph.without_inbound(nodes, links, "id").collect()) == [1, 2, 4]


def findings(text):
    """The rule, shape by shape, with Python's own patterns."""
    out = [shape.says for shape in leakscan.SHAPES[:3] if any(re.search(p, text) for p in shape.patterns)]
    for m in re.findall(leakscan.EMAIL, text):
        own = m.lower()
        if own not in leakscan.SAFE_ADDRESSES and not own.rsplit("@", 1)[1].endswith(leakscan.SAFE_DOMAINS):
            return [*out, leakscan.SHAPES[3].says]
    return out


def test_privacy_shapes_against_brute_force(spark):
    long_ = "Ab3" * 12
    texts = [
        "", "plain", "c:\\Users\\ann\\x", "xc:\\users\\ann", "/home/ann/x", "a/home/ann/", "10.1.2.3", "110.1.2.3", "172.15.0.1", "172.31.0.1", "192.168.1.2345",
        "http://localhost:80/", "127.0.0.1", "[::1]:99", "localhosts", "sk-" + long_, "key_" + "a" * 15, "AKIA" + "A1" * 8, "AKIA" + "A1" * 9, "ghp_" + long_, "ghx_" + long_,
        "github_pat_" + long_ * 2, "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "-----BEGIN RSA PRIVATE " + "KEY-----", "-----BEGIN PRIVATE " + "KEY-----",
        "a@x.test", "a@mail.example.com", "a@b.example", "a@b.invalid", "1+a@users.noreply.github.com", "noreply@github.com", "Support@GitHub.com", "other@github.com",
        "a@example.org then b@corp.org", "A@EXAMPLE.NET",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", leakscan.privacy_findings(F.col("t")).alias("f")).collect()
    for r in rows:
        assert r.f == findings(texts[r.i]), texts[r.i]
    assert {f for r in rows for f in r.f} == {s.says for s in leakscan.SHAPES}


def test_denylists_of_any_size(spark, monkeypatch):
    texts = spark.createDataFrame([("a b", "The Quick, brown fox"), ("quick", "nothing")], "path string, text string")
    deny = spark.createDataFrame([(SHA("quick brown"),), (SHA("quick"),), (SHA("fox the"),)], "sha256 string")
    wanted = {("a b", "text", SHA("quick brown")), ("a b", "text", SHA("quick")), ("quick", "path", SHA("quick"))}
    assert {tuple(r) for r in leakscan.denied(texts, deny).collect()} == wanted
    monkeypatch.setattr(leakscan, "WORDS_AT_ONCE", 1)
    assert {tuple(r) for r in leakscan.denied(texts, deny).collect()} == wanted
    assert leakscan.denied(texts, deny.limit(0)).count() == 0


def runs_of(text, longest=12):
    words = plain_tokens(text or "")
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("at_once", [5, 100_000])
def test_denied_runs_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(leakscan, "WORDS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    words = ["Straße", "the", "of", "café", "x9", "naïve-ly", "a", "b", "c", "d"]
    texts = [(f"n/{k} of the", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 12, 13, 60])))) for k in range(30)] + [(None, "the of the"), ("null", None)]
    every = sorted(set().union(*[runs_of(t) for _, t in texts]))
    phrases = rng.sample(every, 200) + ["of the", "THE  of", "not there", "", "of the a b c d of the a b c d of the"]
    frame = spark.createDataFrame(texts, "path string, text string").repartition(3)
    deny = {p for p in (" ".join(plain_tokens(p)) for p in phrases) if 0 < len(p.split()) <= 12}
    want = {(path, place, p) for path, text in texts for place, said in (("text", text), ("path", path)) for p in runs_of(said) & deny}
    got = leakscan.denied_phrases(frame, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    got = leakscan.denied(frame, spark.createDataFrame([(SHA(p),) for p in deny], "sha256 string")).collect()
    assert {tuple(r) for r in got} == {(path, place, SHA(p)) for path, place, p in want} and len(got) == len(want)


def test_a_million_denied_hashes_meet_few_runs(spark):
    """Of all runs of the texts only those the bitmap lets through are shuffled."""
    deny = spark.range(1_000_000).select(F.sha2(F.concat(F.lit("w"), F.col("id")), 256).alias("sha256"))
    texts = spark.range(2_000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.concat_ws(" ", F.lit("none of these"), F.concat(F.lit("w"), F.col("id") * 1000), F.lit("is denied")).alias("text"))
    got = leakscan.denied(texts, deny)
    assert got.count() == 1000
    held = leakscan.hash_bitmap(deny.select(F.conv(F.left("sha256", F.lit(16)), 16, -10).cast("long").alias("h")), 1_000_000)
    rng = np.random.default_rng(1)
    assert held.holds(rng.integers(-(2**63), 2**63 - 1, 100_000)).mean() < 0.07 and held.bits.nbytes <= 8 << 20


def test_more_phrases_than_the_bitmap_tells_apart(spark, monkeypatch):
    """Hashes meet the phrases first; of runs only those of the phrases' lengths, and only what some phrase says, leave a task."""
    monkeypatch.setattr(leakscan, "HITS_AT_ONCE", 7)
    texts = [(k, " ".join(f"w{(k // 5 * i) % 997}" for i in range(k // 5 % 90))) for k in range(600)] + [(600, None)]
    frame = spark.createDataFrame(texts, "path long, text string").repartition(3)
    phrases = leakscan.word_runs(frame.filter("path % 10 = 0"), 12)
    said = [" ".join(w[i : i + 12]) for k, t in texts if k % 10 == 0 for w in [(t or "").split()] for i in range(len(w) - 11)]
    assert sorted({r.phrase for r in phrases.collect()}) == sorted(set(said))
    more = spark.range(9_000).select(F.concat_ws(" ", *[F.concat(F.lit(f"v{i}x"), F.col("id")) for i in range(12)]).alias("phrase"))
    rest = frame.filter("path % 10 <> 0")
    want = {(k, "text", p) for k, t in texts if k % 10 for p in runs_of(t) & set(said)}
    sent = []
    kept = leakscan._sent
    monkeypatch.setattr(leakscan, "_sent", lambda wanted, n, most: sent.append(n) or kept(wanted, n, most))
    got = leakscan.denied_phrases(rest, phrases.unionByName(more), most=1 << 16).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0
    assert sent == [9_000 + len(set(said)), len({p for _, _, p in want})]
