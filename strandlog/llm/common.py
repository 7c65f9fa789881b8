"""What the training-data operators share: reading tables, writing them between steps, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if driver and executors
    are one machine (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return _LOCAL[app]


_ROUNDS: list[str] = []


@contextmanager
def rounds(spark: SparkSession) -> Iterator[None]:
    """What is saved within is removed at the end, but for what is saved as ``lasting``; so read nothing else later."""
    _ROUNDS.append(f"rounds-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_ROUNDS.pop()}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, name: str, lasting: bool = False, by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder, in folders ``by`` columns, and reads it back: ends its plan and survives lost executors."""
    spark = df.sparkSession
    path = "/".join([shared_dir(spark), *([] if lasting else _ROUNDS[-1:]), f"{name}-{uuid.uuid4().hex}"])
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.array_remove(F.split(text, SPACES), "")


def n_words_of(text: Column) -> Column:
    """The number of words, without building an array of them for the caller."""
    return F.size(words_of(text)).cast("long")


def as_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that columns computed beside it can't clash with any; ``row.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
