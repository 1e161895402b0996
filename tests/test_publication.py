"""Trees of notes that are published as a whole."""

import os

import pytest

from marginalia.sources import files, sinks


def frame(spark, notes):
    return spark.createDataFrame(sorted(notes.items()), "path string, text string").repartition(3)


def tree(spark, root):
    rows = files.published_notes(spark, root).collect()
    assert all(r.sha256 == r.listed for r in rows)
    return {r.path: r.text for r in rows}


def test_a_reader_sees_the_old_tree_or_the_new_one(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "wiki")
    old = {f"cases/n {k}.md": f"text {k} ü\n" for k in range(20)} | {"index.md": ""}
    sinks.publish_notes(frame(spark, old), root)
    assert tree(spark, root) == old
    new = {"index.md": "new", "people/a.md": "b"}
    swap = sinks.atomic_text

    def lost(*a):
        assert tree(spark, root) == old  # all of the new one is written, none of it is seen
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "atomic_text", lost)
    with pytest.raises(RuntimeError):
        sinks.publish_notes(frame(spark, new), root)
    assert tree(spark, root) == old
    monkeypatch.setattr(sinks, "atomic_text", swap)
    sinks.publish_notes(frame(spark, new), root)
    assert tree(spark, root) == new
    assert not [f for _, _, names in os.walk(root) for f in names if f.startswith(".index") and not f.endswith(".crc")]


def test_damage_is_seen(spark, tmp_path):
    root = str(tmp_path / "wiki")
    version = sinks.publish_notes(frame(spark, {"a.md": "one", "b.md": "two"}), root)
    with open(f"{root}/versions/{version}/tree/a.md", "w") as out:
        out.write("changed")
    os.remove(f"{root}/versions/{version}/tree/b.md")
    rows = {r.path: r for r in files.published_notes(spark, root).collect()}
    assert rows["a.md"].sha256 != rows["a.md"].listed and rows["b.md"].sha256 is None and rows["b.md"].listed


@pytest.mark.parametrize("paths", [["a.md", "a.md"], ["../a.md"], ["/a.md"], ["x//a.md"], [None]])
def test_paths_that_no_tree_can_hold(spark, tmp_path, paths):
    rows = spark.createDataFrame([(p, "x") for p in paths], "path string, text string")
    with pytest.raises(ValueError, match="no tree"):
        sinks.publish_notes(rows, str(tmp_path / "wiki"))
    assert not os.path.exists(tmp_path / "wiki")
