"""Token counts as delta-maintained rollups.

Texts are counted once into a narrow table. A batch holds signed events on counted documents: +1 inserts one, -1 deletes
it, a revision is -1 of the old counts and +1 of the new. A batch is reduced to signed sums by source, lang and
tokenizer, before the shuffle already, and committed as one folder
``batch=<id>`` that is written aside and then moved into place, so a batch is there whole or not at all, and committing
it again changes nothing. The totals are the sum of the committed deltas, which is additive: a new batch costs its own
rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import save, shared_dir
from strandlog.llm.tokens import encoder, vocabulary_path

TOKENIZERS = ("byte_bpe_50k", "byte_bpe_multi_50k")
KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(texts: DataFrame, tokenizers=TOKENIZERS, paths: dict | None = None, revised: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of every row of texts (doc_id, source, lang, text): a narrow table, so
    that later joins don't move texts. Null texts have no tokens; null sources and langs are keys like others. With
    ``revised``, the name of a column with the text that takes each row's place (null: none does), also n_revised, its
    tokens (null where there is none): old and new counts of one row stay together, whatever its doc_id."""
    paths = paths or {name: vocabulary_path(f"{name}.tiktoken") for name in tokenizers}
    names = ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_revised"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [(name, encoder(path, special=False).encode) for name, path in paths.items()]
        for batch in batches:
            for name, encode in encoders:
                n = [len(encode(text.as_py())) for text in batch.column(3)]
                new = [len(encode(text.as_py())) if text.is_valid else None for text in batch.column(4)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64()), pa.array(new, pa.int64())], names=names)

    new = F.col(revised) if revised else F.lit(None)
    given = texts.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang", "text")], new.cast("string").alias("revised"))
    out = given.mapInArrow(count, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_revised long")
    return out if revised else out.drop("n_revised")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """The events that insert (1) or delete (-1) counted documents, as deltas."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals under ``path``, a folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        at, fs = self._at(f"batch={batch}")
        return fs.exists(at)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed deltas; False if it was there already, and then nothing is read again."""
        if self.committed(batch):
            return False
        aside = f"_aside-{uuid.uuid4().hex}"
        _summed(deltas).write.parquet(f"{self.path}/{aside}")
        (source, fs), (target, _) = self._at(aside), self._at(f"batch={batch}")
        if not fs.rename(source, target):
            raise OSError(f"batch {batch} could not be committed")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys whose documents are all deleted are left out."""
        deltas = self.spark.read.schema(_DELTA).parquet(f"{self.path}/batch=*")
        return _summed(deltas).filter("n_docs <> 0 or n_tokens <> 0")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The totals after three batches over all documents, each committed twice: every document is inserted, those
    labelled toxic are deleted again, and the others are revised to have no line twice (old counts out, new ones in).

    Every row of docs is a document of its own, whether its doc_id is null or also another row's: its old and new counts
    come from one pass over that row. A label holds for all rows with its doc_id, a null one for those with none; several
    labels of an id count as one. A null or empty text has no tokens but is a document. Other columns are ignored. Empty
    tables give no totals.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    lines = F.split("text", "\n")
    fewer = F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n"))
    given = docs.select("doc_id", "source", "lang", "text", fewer.alias("_revised"))
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("toxic_id"), F.lit(True).alias("toxic")).distinct()
    rows = save(counted(given, revised="_revised"), "token-counts")
    rows = rows.join(toxic, F.col("doc_id").eqNullSafe(F.col("toxic_id")), "left")
    stays = rows.filter("toxic is null and n_revised is not null")
    batches = {
        "0-inserts": signed(rows, 1),
        "1-deletes": signed(rows.filter("toxic"), -1),
        "2-revisions": signed(stays, -1).unionByName(signed(stays.withColumn("n_tokens", F.col("n_revised")), 1)),
    }
    for _ in range(2):
        for name, deltas in batches.items():
            rollup.commit(name, deltas)
    return rollup.totals()
