"""Markdown files as lines: empty lines, line ends and letters at a file's edges."""

import os

import pandas as pd

from strandlog import plans
from strandlog.sources import sinks as K
from tests.oracle import TABLES, assert_same

LONG = "x" * 250
TEXTS = ["", None, "\n", "\n\n\n", "a\n", "a\n\n", f"{LONG}\n\n", f"{LONG}\r\n{LONG}\r\n", "a\r\nb\r\n", f"{LONG}\r", f"{LONG}\u0085\n", "\r\n" * 3, f"{LONG}\n{'İ' * 100}\n"]


def test_a_files_last_lines_may_be_empty(spark, tmp_path):
    said = {"none": "a", "one": "a\n", "two": "a\n\n", "three": "a\n\n\n", "blank": "\n", "blanks": "\n\n", "other": "a\r\n\r\nb\r\n\r\n"}
    for name, text in said.items():
        (tmp_path / name).write_bytes(text.encode())
    found = {}
    for r in K.read_markdown_lines(spark, f"file://{tmp_path}").orderBy("file", "n").collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(r.line)
    assert found == {name: text.splitlines() for name, text in said.items()}


def test_odd_texts_at_a_files_edges_equal_the_sql(spark, data, tmp_path):
    """Each text alone in its file of 200 documents, as a file's last one and as its first."""
    rows = [x for i, t in enumerate(TEXTS) for x in [(i * 200, t), (10_000 + i * 200, "one\ntwo"), (10_199 + i * 200, t), (20_000 + i * 200, t), (20_001 + i * 200, "then")]]
    for t in TABLES:
        os.symlink(f"{data}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.unlink(tmp_path / "documents.parquet")
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet", index=False)
    assert_same(spark, plans.queries()["scan_markdown_lines"], plans.oracle_sql()["scan_markdown_lines"], str(tmp_path))
