"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Words that are one edit apart have reduced words that are equal or one edit apart,
so the one-edit neighbourhood of every distinct reduced word is joined with the distinct reduced words, and the words behind
each pair are verified on their original letters. Of an unordered pair of reduced words only one side makes it: a replaced
symbol is made from the side with the smaller symbol, and a missing one from the longer side, where the insertion into
the shorter one is the same pair. Reduced words are compared by a 64-bit code; a collision costs a candidate, no link.

Many words may share a reduced word. A pair of groups is expanded while one of them has at most ``GROUP`` words; where
both have more, their words are neighbours in the full alphabet, by the same join without any reduction, so that no group
is compared with itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import rounds, save
from strandlog.llm.letters import n_letters, runs

SYMBOLS = 8
GROUP = 256
LEAST_LETTERS = 6
LEAST_N = 5
RATIO = 5
DELETED_EVERY = 199
HELD = 150_000

ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
#: The symbol of each letter; a multiplicative hash spreads letters that are near in frequency or in the alphabet.
REDUCED = "".join(chr(0x61 + (0x9E3779B1 * ord(c) >> 16) % SYMBOLS) for c in ALPHABET)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, deleted_every: int = DELETED_EVERY, least_letters: int = LEAST_LETTERS, least_n: int = LEAST_N) -> DataFrame:
    """word, n: the letter runs of all texts after the stated deletions. A null text has no runs, a null doc_id is written as nothing."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                own: Counter = Counter()
                for some in runs(text.as_py() or b""):
                    own.update(some)
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in own.items():
                    letters = n_letters(run)
                    if letters < least_letters:
                        continue
                    h = zlib.crc32(run, start)
                    if h % deleted_every == 0:
                        if letters == least_letters:  # too short without it
                            continue
                        word, at = run.decode(), h % letters
                        run = (word[:at] + word[at + 1 :]).encode()
                    held[run] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    some = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(counts, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _codes(symbols: np.ndarray) -> np.ndarray:
    """64-bit codes of words of one length, given as a matrix of symbols from 0."""
    return ((symbols.astype(np.uint64) + np.uint64(1)) * _powers(symbols.shape[1])).sum(axis=1, dtype=np.uint64)


def _neighbours(symbols: np.ndarray, n_symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, rows): each row's own code, those of larger symbols in one place, those with one symbol left out."""
    m, n = symbols.shape
    power, plus = _powers(n + 1), (symbols.astype(np.uint64) + np.uint64(1))
    before = np.zeros((m, n + 1), np.uint64)
    np.cumsum(plus * power[:n], axis=1, out=before[:, 1:])
    own = before[:, n]
    yield own, np.arange(m)
    for by in range(1, n_symbols):
        rows, at = np.nonzero(symbols + by < n_symbols)
        yield own[rows] + np.uint64(by) * power[at], rows
    first = np.ones((m, n), bool)
    first[:, 1:] = symbols[:, 1:] != symbols[:, :-1]
    rows, at = np.nonzero(first)
    yield before[rows, at] + (own[rows] - before[rows, at + 1]) * np.uint64(_INVERSE), rows


def _by_length(words: list[str], alphabet: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, matrix of symbols) for each length, at most some 200,000 symbols at a time."""
    place = np.zeros(0x100, np.int64)
    place[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths[lengths > 0]):
        rows, step = np.flatnonzero(lengths == n), max(1, (1 << 18) // int(n) // max(1, len(alphabet) // 8))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            text = "".join(words[i] for i in some).encode("latin-1")
            yield some, place[np.frombuffer(text, np.uint8)].reshape(len(some), n)


def _coded(words: DataFrame, col: str, alphabet: str, around: bool) -> DataFrame:
    """(code, id) for each row's own code, or for its whole neighbourhood."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for some, symbols in _by_length(batch.column(1).to_pylist(), alphabet):
                for code, rows in _neighbours(symbols, len(alphabet)) if around else [(_codes(symbols), np.arange(len(some)))]:
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(ids[some[rows]])], names=["code", "id"])

    return words.select("id", F.col(col)).mapInArrow(codes, "code long, id long")


def _near_codes(words: DataFrame, col: str, alphabet: str) -> DataFrame:
    """Pairs (id, id2), once each, of rows whose words may be equal or one edit apart."""
    around = _coded(words, col, alphabet, True)
    own = _coded(words, col, alphabet, False).withColumnRenamed("id", "id2")
    return around.join(own, "code").select("id", "id2").distinct()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Pairs (word, n, near, near_n), each in both directions, of the words (distinct, over ALPHABET) that differ by one edit."""
    words = words.withColumn("reduced", F.translate("word", ALPHABET, REDUCED))
    groups = save(words.groupBy("reduced").agg(F.count("*").alias("size")).withColumn("id", F.monotonically_increasing_id()), "variants-groups")
    words = save(words.join(groups, "reduced").select("id", "word", "n", "size"), "variants-words")
    symbols = "".join(sorted(set(REDUCED)))
    pairs = save(_near_codes(groups, "reduced", symbols), "variants-pairs")
    b = words.select(F.col("id").alias("id2"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("size").alias("near_size"))
    found = pairs.join(words, "id").join(b, "id2").filter((F.col("size") <= group) | (F.col("near_size") <= group))
    found = found.filter((F.col("id") != F.col("id2")) | (F.col("word") < F.col("near"))).filter("levenshtein(word, near, 1) = 1").select("word", "n", "near", "near_n")
    hot = words.filter(F.col("size") > group)
    if not hot.isEmpty():
        hot = save(hot.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "variants-hot")
        full = _near_codes(hot, "word", "".join(sorted(ALPHABET))).filter("id != id2")
        full = full.join(hot, "id").join(hot.select(F.col("id").alias("id2"), F.col("word").alias("near"), F.col("n").alias("near_n")), "id2")
        found = found.unionByName(full.filter("levenshtein(word, near, 1) = 1").select("word", "n", "near", "near_n"))
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def variants(docs: DataFrame, ratio: int = RATIO, group: int = GROUP, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs.

    Null texts, texts without letters and an empty table give no words; rows that are repeated count again, since their
    words occur again. A run with a deletion that is left too short is no word. Columns of docs other than doc_id and text
    play no part. Ties for the form go to the smallest word in code-point order.
    """
    spark = docs.sparkSession
    with rounds(spark):
        words = save(word_counts(docs, **options), "variants-counts")
        near = near_words(words, group)
        best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
        best = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
        forms = words.join(best, "word", "left").withColumn("taken", F.col("form_n") >= ratio * F.col("n"))
        forms = save(
            forms.select("word", F.when(F.col("taken"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("taken"), F.col("form_n")).alias("form_n")),
            "variants-forms",
        )
        up = forms.filter("form is not null").select("word", F.col("form").alias("root"))
        # n grows ratio-fold at each step, so a chain has as many steps as its logarithm; each round doubles the reach
        most = forms.agg(F.max("n")).first()[0] or 1
        steps = int(np.ceil(np.log(max(most, 2)) / np.log(ratio))) + 1 if ratio > 1 else 64
        for _ in range(max(1, int(np.ceil(np.log2(steps))))):
            up = save(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")
        out = forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return save(out, "variants", lasting=True)
