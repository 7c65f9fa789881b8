"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from strandlog.llm import chat_format, fingerprints, html_extract, inverted_index, lexical, line_dedup, mixing, ngram_join, packing, quality, secret_scan, token_counts, variants
from strandlog.llm.common import table


def op9_fingerprints(spark, sf_dir):
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_token_counts(spark, sf_dir):
    return token_counts.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark, sf_dir):
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.secrets_digest(table(spark, sf_dir, "documents"))


def op6_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op11_lexical(spark, sf_dir):
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark, sf_dir):
    return inverted_index.search(table(spark, sf_dir, "embeddings"))


def op13_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_counts": op3_token_counts,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_html_extract": op6_html_extract,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
    "op11_lexical": op11_lexical,
    "op12_neighbours": op12_neighbours,
    "op13_variants": op13_variants,
}

SQL = {
    "op4_chat_format": chat_format.SQL,
    "op8_quality": quality.SQL,
    "op10_mixing": mixing.SQL,
}
