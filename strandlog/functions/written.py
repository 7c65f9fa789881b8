"""Plans ended by a written table, so that loops don't grow them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if driver and
    executors are one machine (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return _LOCAL[app]


_SCOPES: list[str] = []
_KEPT: dict[tuple, str] = {}


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of a query that runs in here are removed at its end, not when the driver comes to collect its plan."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written to the shared folder and read back; lost executors don't lose it. What was shuffled for it is removed."""
    path = "/".join([shared_dir(df.sparkSession), *_SCOPES[-1:], f"{name}-{uuid.uuid4().hex}"])
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, lengths and times of the files of some tables, those in folders of partitions too."""
    out = []
    for path in paths:
        fs, at = _fs(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def kept(spark: SparkSession, name: str, tables: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of ``tables`` (their paths), written once for a session and read again as long as neither they
    nor it have changed. What was cut on the way is removed."""
    key = (spark.conf.get("spark.app.id"), name, _state(spark, tables))
    if key not in _KEPT or not _fs(spark, _KEPT[key])[0].exists(_fs(spark, f"{_KEPT[key]}/_SUCCESS")[1]):
        path, scope = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", f"rounds-{uuid.uuid4().hex}"
        _SCOPES.append(scope)
        try:
            found = build()
            with _shuffles_removed(spark):
                found.write.parquet(path)
        finally:
            _SCOPES.pop()
            fs, at = _fs(spark, f"{shared_dir(spark)}/{scope}")
            fs.delete(at, True)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])
