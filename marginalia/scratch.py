"""Scratch tables in the folder that a cluster shares: lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in
    local tests, a temporary folder of this process is used, and removed at its end.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    global _OWN
    if _OWN is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        _OWN = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    return _OWN


_OWN: str | None = None


def run_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one.

    The store is told to delete it when the driver's JVM ends, with or without a session.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{RUN}{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        where, store = _store(spark, path)
        store.mkdirs(where)
        store.deleteOnExit(where)
        _RUNS.add(path)
    return path


RUN = "marginalia-"
_RUNS: set[str] = set()


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Delete the folders of runs that have written nothing for so long, as after a killed driver."""
    root = shared_dir(spark).rstrip("/")
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    gone = []
    for name in listed(spark, root):
        path = f"{root}/{name}"
        if not name.startswith(RUN) or path in _RUNS:
            continue
        where, store = _store(spark, path)
        latest = max([store.getFileStatus(where).getModificationTime(), *[f.getModificationTime() for f in store.listStatus(where)]])
        if now - latest >= hours * 3_600_000:
            store.delete(where, True)
            gone.append(name)
    return gone


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"


#: Rows of a narrow table in one file, where the number of rows is known.
FILE_ROWS = 400_000


#: Rows of an Arrow batch while a scratch table is written: rows with texts may be long.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few rows, unless the session names a number; what it said before holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    default = spark.conf.get(key) == "10000"
    if default:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        if default:
            spark.conf.set(key, "10000")


def cut(df: DataFrame, what: str = "cut", rows: int | None = None, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The rows survive a lost executor and later steps do not repeat the work before
    them. The columns keep their names and types. ``rows``, the rough number of rows,
    keeps narrow tables from becoming one small file per shuffle partition: they are
    dealt anew, so the work before them runs in as many tasks as it would without.
    ``files`` bounds the last stage's tasks instead, without another shuffle.
    What is not released is deleted when the driver's JVM ends.
    """
    path = scratch_path(df.sparkSession, what)
    dealt = df if rows is None else df.repartition(1 + rows // FILE_ROWS)
    with small_batches(df.sparkSession):
        (dealt if files is None else dealt.coalesce(files)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if _WITHIN:
        _WITHIN[-1].append(out)
    return out


_WITHIN: list[list[DataFrame]] = []


@contextmanager
def temporary():
    """Deletes at the end what is cut inside, but for frames handed to the function it gives."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _WITHIN.append(own)
    try:
        yield keep
    finally:
        _WITHIN.pop()
        release(*[df for df in own if not any(df is k for k in kept)])
        if _WITHIN:
            _WITHIN[-1].extend(kept)


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that no plan needs any more, in whatever store it is."""
    where, store = _store(spark, path)
    store.delete(where, True)


def release(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that no plan needs any more; other frames own nothing."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            delete(df.sparkSession, path)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    where, store = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there already, which the store decides."""
    where, store = _store(spark, path)
    try:
        out = store.create(where, False)
    except Py4JJavaError as refused:
        if "FileAlreadyExists" not in refused.java_exception.getClass().getName():
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    where, store = _store(spark, path)
    stream = store.open(where)
    try:
        return bytes(stream.readNBytes(1 << 16)).decode()
    finally:
        stream.close()
