"""Repair rounds that look only at what changed, against rounds over all notes."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.plans import rounds

LINK = r"\[([a-z0-9]+)\]"


def targets(look):
    return look.select("path", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target")).distinct()


def find(look, known):
    """Links to notes that do not exist, or that say they moved."""
    links = targets(look)
    there = known(links.select(F.col("target").alias("path"))).select(F.col("path").alias("target"), F.col("text").alias("says"))
    moved = F.col("says").startswith("moved ")
    return links.join(there, "target", "left").filter(F.col("says").isNull() | moved).select(
        "path", "target", F.when(moved, F.regexp_extract("says", r"^moved ([a-z0-9]+)", 1)).alias("to")
    )


def fix(known, findings):
    """A moved target is replaced; a missing one of an odd number gets a stub, another one loses its brackets."""
    swaps = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("target", "to"))).alias("swaps"))
    new = lambda s: F.when(s["to"].isNotNull(), F.concat(F.lit("["), s["to"], F.lit("]"))).when(
        s["target"].rlike("[13579]$"), F.concat(F.lit("["), s["target"], F.lit("]"))).otherwise(s["target"])
    text = F.aggregate("swaps", F.col("text"), lambda t, s: F.replace(t, F.concat(F.lit("["), s["target"], F.lit("]")), new(s)))
    changed = known(findings.select("path")).join(swaps, "path").select("path", text.alias("now"), "text").filter("now <> text").select("path", F.col("now").alias("text"))
    digits = F.regexp_extract("target", r"(\d+)$", 1).cast("long")
    stubs = findings.filter("to IS NULL AND target RLIKE '[13579]$'").select("target").distinct().select(
        F.col("target").alias("path"), F.when(digits > 20, F.concat(F.lit("stub ["), F.lit("n"), F.floor(digits / 2).cast("string"), F.lit("]"))).otherwise("stub").alias("text")
    )
    return changed.unionByName(stubs)


RULES = rounds.Rules(find, targets, fix)


def plainly(notes, most):
    """The same rules over a dictionary, every note in every round."""
    notes = dict(notes)
    for used in range(most + 1):
        found = []
        for p, t in notes.items():
            for x in set(re.findall(LINK, t)):
                says = notes.get(x)
                if says is None or says.startswith("moved "):
                    found.append((p, x, None if says is None else re.match("moved ([a-z0-9]+)", says)[1]))
        if not found or used == most:
            return notes, used, len(found)
        now = dict(notes)
        for p, x, to in sorted(found):
            now[p] = now[p].replace(f"[{x}]", f"[{to}]" if to else f"[{x}]" if x[-1] in "13579" else x)
        for _, x, to in found:
            if to is None and x[-1] in "13579":
                n = int(re.search(r"(\d+)$", x)[1])
                now[x] = f"stub [n{n // 2}]" if n > 20 else "stub"
        notes = now


def corpus(seed, n=80):
    rng = random.Random(seed)
    notes = {}
    for k in range(n):
        links = " ".join(f"[n{rng.randrange(n * 3) if rng.random() < 0.1 else rng.randrange(n)}]" for _ in range(rng.randrange(4)))
        notes[f"n{k}"] = f"moved n{rng.randrange(k)}" if k and rng.random() < 0.1 else f"text {links}"
    return notes


def frame(spark, notes):
    return spark.createDataFrame(sorted(notes.items()), "path string, text string")


@pytest.mark.parametrize(("seed", "most"), [(1, 9), (2, 9), (3, 1), (4, 0)])
def test_same_notes_as_looking_at_all(spark, tmp_path, seed, most):
    notes = corpus(seed)
    want, used, left = plainly(notes, most)
    got, reports = rounds.Repair(spark, str(tmp_path / "r"), RULES).run(frame(spark, notes), most)
    assert {r.path: r.text for r in got.collect()} == want
    assert (reports[-1]["round"], reports[-1]["left"]) == (used, left)
    if most > 2:
        looked = [r["looked"] for r in reports]
        assert used >= 2 and looked[0] == len(notes) and all(n < looked[0] for n in looked[1:]) and looked[-1] < looked[0] / 4


def test_a_lost_driver_goes_on(spark, tmp_path):
    notes = corpus(5)
    want, used, left = plainly(notes, 9)
    calls = []

    def failing(known, findings):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return fix(known, findings)

    folder = str(tmp_path / "r")
    with pytest.raises(KeyboardInterrupt):
        rounds.Repair(spark, folder, rounds.Rules(find, targets, failing)).run(frame(spark, notes), 9)
    before = rounds.Repair(spark, folder, RULES).reports()
    assert [r["round"] for r in before] == [0, 1]
    # A driver lost between writing a round and publishing it: the round is done again.
    os.remove(f"{folder}/published/1")
    looked = []
    counting = rounds.Rules(lambda look, known: (looked.append(look.count()), find(look, known))[1], targets, fix)
    got, reports = rounds.Repair(spark, folder, counting).run(frame(spark, {"ignored": "[n2]"}), 9)
    assert {r.path: r.text for r in got.collect()} == want and (reports[-1]["round"], reports[-1]["left"]) == (used, left)
    assert len(looked) == used and max(looked) < len(notes)


def test_nothing_to_do_and_no_progress(spark, tmp_path):
    clean = {"a1": "[b1]", "b1": "x"}
    got, reports = rounds.Repair(spark, str(tmp_path / "a"), RULES).run(frame(spark, clean), 5)
    assert {r.path: r.text for r in got.collect()} == clean and [r["left"] for r in reports] == [0]
    idle = rounds.Rules(find, targets, lambda known, findings: findings.select("path", F.lit("x").alias("text")).filter("false"))
    _, reports = rounds.Repair(spark, str(tmp_path / "b"), idle).run(frame(spark, {"a1": "[gone2]"}), 5)
    assert [(r["round"], r["changed"], r["left"]) for r in reports] == [(0, 0, 1), (1, 0, 1)]


def test_removed_notes(spark, tmp_path):
    """A null text takes a note away, and what links to it is looked at again."""
    def drop(known, findings):
        return findings.filter("target = 'gone2'").select("path", F.lit(None).cast("string").alias("text")).unionByName(
            known(findings.filter("target <> 'gone2'").select("path")).select("path", F.lit("plain").alias("text")))

    got, reports = rounds.Repair(spark, str(tmp_path / "r"), rounds.Rules(find, targets, drop)).run(
        frame(spark, {"a1": "[gone2]", "b1": "[a1]", "c1": "text"}), 5)
    assert {r.path: r.text for r in got.collect()} == {"b1": "plain", "c1": "text"}
    assert [(r["looked"], r["changed"], r["left"]) for r in reports] == [(3, 0, 1), (1, 1, 1), (1, 1, 0)]
