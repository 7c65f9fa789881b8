"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes what the one before it kept. All but the last return the columns of documents, extra ones and their
names untouched; the last returns the packed pieces. An empty table gives an empty one at every stage. Rows are told
apart by doc_id and text; a null doc_id is an id like others, and rows that are equal in both share their fate until one
of them stays at the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import line_dedup, mixing, ngram_join, packing, quality
from strandlog.llm.common import rounds, save, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go: fewer than 50 words (so null and empty texts), mostly repeated words, or a
    distribution too far from that of their language, documents without a lang being one."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies (by doc_id, null first) of repeated line runs are cut out, n_chars counted anew; documents that were
    nothing else go."""
    return line_dedup.without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of links at 80 % likeness of five-word shingles: that of least doc_id, null
    last; of equal rows one, the least by all columns."""
    return ngram_join.keep_first(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken no times, once or twice, so that each source (a null one is one) has its share of words."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized pieces with their places in sequences of at most 1024 tokens; each copy of a document is packed by itself."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Line dedup, components and packing have no SQL form that runs on whole tables; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written to the shared folder and read again by the next; what a
    stage saved on its way is removed when its rows are there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with rounds(spark):
            docs = save(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
