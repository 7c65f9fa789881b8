"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit packing.

Each distinct five-word shingle is hashed once; the top bits choose one of BINS bins and each bin keeps its least hash.
An empty bin borrows from a full one, which it finds by trying bins in a random order of its own that is the same for
all documents (optimal densification). The low BITS bits of each bin are packed; two bins agree by chance with
probability 2 ** -BITS, which the likeness takes off again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import text_of
from strandlog.llm.shingles import mix64, shingle_sets

WORDS = 5
BINS = 512
BITS = 8
_BIN_BITS = BINS.bit_length() - 1


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS bytes for each set of shingle hashes (ascending); an empty set's row is zero."""
    out = np.zeros((len(sets), BINS), dtype=np.uint8)
    full = np.zeros((len(sets), BINS), dtype=bool)
    for i, hashes in enumerate(sets):
        if len(hashes):
            bins = (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
            first = np.concatenate(([True], bins[1:] != bins[:-1]))
            out[i, bins[first]] = hashes[first].astype(np.uint8)  # the low eight bits
            full[i, bins[first]] = True
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        seed = bin_.astype(np.uint64) + np.uint64(attempt * BINS)
        source = (mix64(seed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        found = full[row, source]
        out[row[found], bin_[found]] = out[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]
    return out


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of texts, and whether each has any shingle."""
    sets = list(shingle_sets(texts, WORDS))
    return _sketches(sets), np.array([len(s) > 0 for s in sets], dtype=bool)


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard likeness of rows of sketches, 0 to 1. Two texts without words are alike, one of them isn't."""
    chance = 2.0**-BITS
    equal = (a == b).mean(axis=1)
    out = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, out, np.where(some_a | some_b, 0.0, 1.0))


def _hex(sketches: np.ndarray, some: np.ndarray) -> list[str]:
    return [row.tobytes().hex() if any_ else "" for row, any_ in zip(sketches, some)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal; empty for a null text or one without words) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(*fingerprints(batch.column(1))), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    """The rows of consecutive documents; ``following`` is the text after the last."""
    after = [*texts[1:], following]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after)]
    own, some = fingerprints(pa.array([*texts, following], pa.string()))
    other, some_other = fingerprints(pa.array(edited, pa.string()))
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], _hex(own[:-1], some[:-1]), _hex(other, some_other),
        likeness(own[:-1], other, some[:-1], some_other), likeness(own[:-1], own[1:], some[:-1], some[1:]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares rows (doc_id, text, bucket, tail) in order; a bucket's tail is the text after its last row."""
    held: list[tuple] = []
    for batch in batches:
        for doc_id, text, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if tail or len(held) >= 500:
                yield _compared([x[0] for x in held], [x[1] for x in held], text)
                held = []
            if not tail:
                held.append((doc_id, text))


def compare_edited(docs: DataFrame) -> DataFrame:
    """The fingerprints of every row's text and of its edited text, whose last quarter is taken from the next row's.

    Rows follow one another by doc_id (null first), rows with the same one by text; after the last comes the first.
    Quantiles of doc_id part the rows into buckets of much the same size; the first text of each goes to the one before
    as well, one row a bucket. Then a bucket is sorted and read through, and each text is shuffled once. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 50 * n)).first()[0] or []
    bounds = np.unique(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        null = doc_id.isna()
        at = 1 + np.searchsorted(bounds, doc_id.fillna(0).astype("int64"), side="right")
        return pd.Series(np.where(null, 0, at).astype("int32"))

    rows = rows.withColumn("bucket", bucket_of("doc_id"))
    # at most a head for each bound, one for the ids before the first and one for null
    heads = sorted((r.bucket, r.head) for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect())
    wanted = F.col("doc_id").isin([h for _, h in heads if h is not None])
    if any(h is None for _, h in heads):
        wanted = wanted | F.col("doc_id").isNull()
    before = {b: heads[k - 1][0] for k, (b, _) in enumerate(heads)}
    tails = rows.filter(wanted).groupBy("bucket").agg(F.min("text").alias("text"))
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    tails = tails.select(F.lit(None).cast("long").alias("doc_id"), "text", to[F.col("bucket")].alias("bucket"), F.lit(True).alias("tail"))
    both = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    ordered = both.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    return ordered.mapInArrow(_followed, _DDL)
