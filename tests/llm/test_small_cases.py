"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import pytest

import corpus_pipeline
from strandlog.llm import chat_format, fingerprints, html_extract, line_dedup, mixing, ngram_join, packing, quality, secret_scan, token_counts

LONG = " ".join(f"word{i % 977} runs" for i in range(30_000))
DOCS = [
    (1, "one two three four five six " * 12, "en", "a", 0), (1, "one two three four five six " * 12, "en", "a", 0), (2, None, None, None, None), (None, "a null id", "en", None, 3), (3, "", "", "", 0),
    (4, LONG, "en", "a", 0), (5, " \t\n\x0b\x0c\r ", "en", "b", 0), (6, "token = abcdef123456 🙂", None, "b", 0), (7, LONG, "de", "c", 0), (1, "another text with the same id", "en", "a", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("size", "copies", "n", "words", "runs", "ref", "kept", "digest", "_hash", "component", "d", "text_hash", "__hash", "__size", "__taken", "__runs", "row", "left", "id", "hash", "k")

OPERATORS = {
    "line_dedup": line_dedup.dedup_digest, "ngram_join": lambda d: ngram_join.jaccard_components(d, 3, 90), "secrets": secret_scan.secrets_digest, "packing": packing.pack,
    "quality": quality.quality_digest, "fingerprints": fingerprints.compare_edited, "fingerprint": fingerprints.fingerprint, "mixing": mixing.mix_digest,
    "counts": token_counts.counted, "keep_good": quality.keep_good, "without_copies": line_dedup.without_copies, "keep_first": ngram_join.keep_first, "mix": mixing.mix,
}
PER_ROW = {"line_dedup", "ngram_join", "secrets", "quality", "fingerprints", "fingerprint", "mixing"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    wide = docs
    for c in EXTRA:
        wide = wide.withColumn(c, wide["doc_id"])
    rows = OPERATORS[name](wide).collect()
    if name in PER_ROW:
        assert len(rows) == len(DOCS)
    if name == "counts":
        assert len(rows) == 2 * len(DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_stay_keep_their_columns(docs):
    wide = docs
    for c in EXTRA:
        wide = wide.withColumn(c, wide["doc_id"] + 1)
    for stage in (quality.keep_good, line_dedup.without_copies, ngram_join.keep_first, mixing.mix):
        assert stage(docs).columns == docs.columns
        assert all(r[c] == (None if r.doc_id is None else r.doc_id + 1) for r in stage(wide).collect() for c in EXTRA)


def test_one_row_of_each_component_stays(docs):
    """Of equal rows one, of near ones that of least id, null last; rows without words are linked with nothing."""
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(docs).collect()), key=str)
    texts = {(i, t) for i, t, *_ in DOCS if i != 7}
    assert kept == sorted(texts, key=str)


def test_rows_that_share_an_id_are_matched_for_themselves(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join(w if i != 7 * k else f"x{k}" for i, w in enumerate(base))
    rows = [(5, near(1)), (5, "nothing like it"), (5, "something else again, of other words"), (None, near(2)), (None, "nothing like it"), (3, near(3)), (9, "")]
    got = [(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (5, 5), (5, 5), (None, 3), (None, 5), (3, 3), (9, 9)], key=str)


def test_equal_rows_get_equal_results(docs):
    for f in (quality.quality_digest, secret_scan.secrets_digest, line_dedup.dedup_digest):
        same = [r for r in f(docs).collect() if r.doc_id == 1]
        assert len(set(map(str, same))) <= 2 and len(same) == 3


def test_chat_and_pages(spark):
    turns = [(1, 1, "user", "hi"), (1, 2, None, None), (2, 1, "user", "hi"), (None, 1, "user", "x"), (3, None, "user", ""), (3, 1, "user", ""), (3, 1, "user", "")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r.conv_id: r for r in chat_format.render(spark.createDataFrame(turns, schema)).collect()}
    assert set(got) == {1, None, 3} and got[3].n_turns == 2 and got[1].text.startswith("<|user|>\nhi<|end|>")
    assert chat_format.render(spark.createDataFrame([], schema)).count() == 0
    from pyspark.sql import functions as F

    wide = spark.createDataFrame(turns, schema).withColumns({c: F.lit(1) for c in ("k", "n", "x1", "piece", "n_copies")})
    assert {r.conv_id for r in chat_format.render(wide).collect()} == set(got)
    long = [(7, k, "user" if k % 2 else "bot", "word " * 50) for k in range(4_000)] + [(8, k, "user" if k % 2 else "bot", "word " * 50) for k in range(3_999)]
    assert [(r.conv_id, r.n_turns) for r in chat_format.render(spark.createDataFrame(long, schema)).collect()] == [(7, 4_000)]
    pages = "page_id long, url string, html string"
    assert html_extract.extract(spark.createDataFrame([], pages)).count() == 0
    assert [r.text for r in html_extract.extract(spark.createDataFrame([(1, None, None), (None, "u", "")], pages)).collect()] == ["", ""]


def test_token_counts_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert token_counts.digest(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, 4, 7}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
