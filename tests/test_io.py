"""Sources, sinks, streams and the command line, over files."""

import hashlib
import json
import os
import subprocess
import sys

import pytest

from marginalia import cli
from marginalia.operators import integrity
from marginalia.plans import fixtures
from marginalia.sources import files, sinks
from marginalia.streaming import logs
from tests.test_notes import CLEAN


def put(root, notes):
    for path, text in notes.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_markdown_scan(spark, tmp_path):
    root = put(tmp_path, {"a.md": "x\ny", "d e/b.md": "é", ".git/c.md": "no", "n.txt": "no", "bad.md": b"\xff\xfe"})
    got = {r.path: r.text for r in files.markdown(spark, root).collect()}
    assert got == {"a.md": "x\ny", "d e/b.md": "é", "bad.md": None}
    assert {r.path for r in files.file_inventory(spark, root).collect()} >= {"a.md", "n.txt", "d e/b.md"}


def test_page_texts_and_checksums(spark, tmp_path):
    root = put(tmp_path, {"text/native-pages/page-0001.txt": "one", "text/native-pages/page-0012.txt": "two"})
    got = {r.page: r for r in files.page_texts(spark, root).collect()}
    assert got[12].text == "two" and got[1].path == "text/native-pages/page-0001.txt" and got[1].sha256 == hashlib.sha256(b"one").hexdigest()
    good = f"{'a' * 64}  x/y z\n\n{'b' * 64}  q\\r\n"
    read = lambda text: {r.path for r in files.read_checksums(spark, put(tmp_path, {"sums": text}) + "/sums").collect()}
    assert read(good) == {"x/y z", "q/r"}
    for bad in ("nonsense\n", f"{'a' * 64}  x\n{'b' * 64}  x\n"):
        with pytest.raises(Exception, match="checksum"):
            read(bad)


def test_json(spark, tmp_path):
    texts = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("{}",), ("no",)], "text string")
    assert [r.value and r.value.a for r in files.fenced_json(texts, "a int").collect()] == [1, None, None]
    root = put(tmp_path, {"log.jsonl": '{"sequence": 1}\n\n{"sequence": 2}\n', "p.json": '{"a": 1, "a": 2}'})
    assert files.json_lines(spark, f"{root}/log.jsonl", "sequence long").count() == 2
    with pytest.raises(ValueError):
        files.json_document(spark, f"{root}/p.json")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "x"), ("c.md", "y")], "path string, text string")
    sinks.exclusive(df, f"{tmp_path}/e")
    with pytest.raises(Exception):
        sinks.exclusive(df, f"{tmp_path}/e")
    sinks.staged(df, f"{tmp_path}/s")
    with pytest.raises(FileExistsError):
        sinks.staged(df, f"{tmp_path}/s")
    sinks.atomic_text(spark, f"{tmp_path}/t.txt", "é")
    sinks.atomic_text(spark, f"{tmp_path}/t.txt", "ü")
    assert open(f"{tmp_path}/t.txt", encoding="utf-8").read() == "ü"
    with pytest.raises(FileExistsError):
        sinks.atomic_text(spark, f"{tmp_path}/t.txt", "z", overwrite=False)
    sinks.write_notes(df, f"{tmp_path}/n")
    assert open(f"{tmp_path}/n/a/b.md").read() == "x" and sorted(os.listdir(f"{tmp_path}/n")) == ["a", "c.md"]
    inventory = files.file_inventory(spark, f"{tmp_path}/n").select("path", "sha256").persist()
    inventory.count()
    sinks.publish(spark, f"{tmp_path}/n", f"{tmp_path}/out", integrity.checksum_diff(inventory, files.file_inventory(spark, f"{tmp_path}/n")))
    assert sinks.exists(spark, f"{tmp_path}/out/c.md") and not sinks.exists(spark, f"{tmp_path}/n")
    sinks.append_log(df, f"{tmp_path}/l")
    sinks.append_log(df, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 4


def test_rendered_notes(spark):
    scoped = spark.createDataFrame([(7, "text\n", "primary_text", "f" * 64)], "page int, text string, section string, sha256 string")
    own = sinks.gateway_notes(scoped, "Book", "s", ["page"])
    row = own.first()
    assert row.path == "sources/pdf-pages/page-0007.md" and "````text\ntext\n````" in row.text
    index = {r.path: r.text for r in sinks.folder_index(own).collect()}
    assert index["sources/pdf-pages/index.md"] == "# Index\n\n- [Book, PDF page 7](page-0007.md)\n"


def test_table_notes_and_images(spark):
    rows = spark.createDataFrame([(2, "b|c"), (1, None)], "page int, what string")
    note = sinks.table_note(rows, "reference/x.md", "X", "page").first()
    assert note.text == "# X\n\n| page | what |\n|-|-|\n| 1 | — |\n| 2 | b\\|c |\n"
    notes = spark.createDataFrame([("a.md", "![m](../images/p1.png) ![n](images/p1.png)")], "path string, text string")
    images = spark.createDataFrame([("p1.png",), ("p2.png",)], "name string")
    assert [r.name for r in sinks.staged_images(notes, images).collect()] == ["p1.png"]


def test_rounds(spark):
    from pyspark.sql import functions as F

    from marginalia.plans import rounds

    notes = spark.createDataFrame([("a", "xx"), ("b", "x")], "path string, text string")
    find = lambda n: n.filter(F.contains("text", F.lit("x")))
    fix = lambda n, bad: n.withColumn("text", F.regexp_replace("text", "^x", ""))
    assert rounds.repair(notes, find, fix, 3)[1:] == (2, 0) and rounds.repair(notes, find, fix, 1)[1:] == (1, 1)
    assert rounds.binding({"a": "1", "b": "2"}) == rounds.binding({"b": "2", "a": "1"})


def stream_rows(spark, query, name):
    q = query.queryName(name).format("memory").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    line = lambda run, n, t, s: json.dumps({"run_id": run, "sequence": n, "time": f"2024-01-01T00:00:{t:02d}Z", "status": s})
    root = put(tmp_path, {"log/a.json": "\n".join([line("r", 1, 1, "x"), line("r", 2, 2, "y"), line("r", 4, 3, "z"), line("s", 2, 1, "w")])})
    log = logs.stream_json(spark, f"{root}/log")
    got = stream_rows(spark, logs.sequence_faults(log).writeStream.outputMode("append"), "faults")
    assert {(r.run_id, r.sequence, r.expected) for r in got} == {("r", 4, 3), ("s", 2, 1)}
    beat = stream_rows(spark, logs.heartbeat(log).writeStream.outputMode("complete"), "beat")
    assert {(r.run_id, r.status) for r in beat} == {("r", "z"), ("s", "w")}
    counts = stream_rows(spark, logs.running_metrics(log, ("x",), kind="status").writeStream.outputMode("complete"), "counts")
    assert {(r.run_id, r.n_x, r.n) for r in counts} == {("r", 1, 3), ("s", 0, 1)}
    windows = stream_rows(spark, logs.windowed_counts(log, "time", key="status").writeStream.outputMode("complete"), "windows")
    assert sum(r.n for r in windows) == 4
    for _ in range(2):
        logs.append_new(log.select("run_id", "sequence", "status"), f"{root}/sink", f"{root}/check", "status").awaitTermination()
    assert spark.read.parquet(f"{root}/sink").count() == 4


def test_commands(spark, tmp_path, capsys):
    root = put(tmp_path / "wiki", CLEAN)
    assert cli.main(["lint", root], spark) == 0
    assert cli.main(["query", root, "harbour", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["path"] == "concepts/harbour.md"
    assert cli.main(["query", root, "harbour", "--limit", "0"], spark) == 2 and cli.main(["query", root, "!"], spark) == 2
    assert cli.main(["verify", root], spark) == 1
    messy = put(tmp_path / "messy", fixtures.NOTES)
    assert cli.main(["lint", messy], spark) == 1 and cli.main(["verify", messy], spark) == 0 and cli.main(["links", messy], spark) == 1
    assert cli.main(["init", f"{tmp_path}/run.json"], spark) == 0 and cli.main(["init", f"{tmp_path}/run.json"], spark) == 2
    digest = hashlib.sha256(b"x").hexdigest()
    run = put(tmp_path / "run", {"a": "x", "extra": "y", "artifacts.sha256": f"{digest}  a\n"})
    assert cli.main(["status", run], spark) == 0
    put(run, {"a": "changed"})
    assert cli.main(["status", run], spark) == 5


def test_library_stands_without_the_training_data_package():
    code = (
        "import sys; sys.modules['marginalia.llm'] = None\n"
        "import marginalia.cli, marginalia.plans.catalogue, marginalia.streaming.logs\n"
        "assert not [m for m in sys.modules if m.startswith('marginalia.llm.')]"
    )
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_entry_without_the_training_data_package(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("marginalia", "__spark_entry__.py"):
        os.symlink(f"{here}/{name}", tmp_path / name) if name.endswith("py") else None
    os.makedirs(tmp_path / "marginalia")
    for name in os.listdir(f"{here}/marginalia"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{here}/marginalia/{name}", tmp_path / "marginalia" / name)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr
