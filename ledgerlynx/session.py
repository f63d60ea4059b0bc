"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: State on disk that does not look up a row to count it before it is written, and holds both sides of a join together.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_STATE,
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def settings_of(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the streams that are started within."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def build_session(app: str = "ledgerlynx", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing depends on them for correct results; ``conf`` overrides any.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_STATE,
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session on one machine (tests) that names none gets a local folder,
    remembered for the session. On a cluster that is an error: executors would
    each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^\[\]]*\])?$", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="ledgerlynx-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop(spark, path)
    return files.exists(at)


def move_path(spark: SparkSession, source: str, target: str) -> bool:
    """Rename into a place that does not exist yet; false if it does."""
    files, at = _hadoop(spark, source)
    to = _hadoop(spark, target)[1]
    files.mkdirs(to.getParent())
    return not files.exists(to) and files.rename(at, to)


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it does not exist."""
    files, at = _hadoop(spark, folder)
    return [s.getPath().toString() for s in files.listStatus(at)] if files.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, at = _hadoop(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
