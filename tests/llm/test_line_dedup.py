"""A passage that a row without an id shares with others."""

from strandlog.llm import line_dedup

PASSAGE = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(5))


def deleted(spark, docs):
    rows = line_dedup.dedup_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.runs, r.text) for r in rows)


def test_copies_of_a_row_without_an_id_go(spark):
    got = deleted(spark, [(None, PASSAGE + "\nnull"), (7, "seven\n" + PASSAGE)])
    assert got == [(False, 0, "", PASSAGE + "\nnull"), (True, 7, "1-5", "seven")]


def test_copies_in_rows_without_an_id_go(spark):
    got = deleted(spark, [(None, f"{PASSAGE}\nhere\n{PASSAGE}"), (None, f"other\n{PASSAGE}")])
    assert sum(text.count("w4x9") for *_, text in got) == 1 and sorted(len(text.split("\n")) for *_, text in got) == [1, 6]
